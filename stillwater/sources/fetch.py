"""Bounded downloads by the driver: texts and labels within a size, products within a byte budget, verified before they count."""

from __future__ import annotations

import hashlib
import os
import urllib.parse
import urllib.request

TEXT_BYTES = 1_000_000
CHUNK = 1 << 20
TEXT_SUFFIXES = (".txt", ".lbl", ".xml", ".json", ".md", ".html", ".csv", ".tab", ".cat")


def checked_url(url: str) -> str:
    parts = urllib.parse.urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.netloc:
        raise ValueError(f"not a web address: {url}")
    return url


def target(root: str, destination: str) -> str:
    """A relative destination below the root."""
    if not destination or os.path.isabs(destination) or ".." in destination.replace("\\", "/").split("/"):
        raise ValueError(f"not a path below the root: {destination!r}")
    return os.path.join(root, destination)


def text(url: str, destination: str, most: int = TEXT_BYTES, opener=urllib.request.urlopen) -> str:
    """Fetches a text; a longer one, or something that is no text, is refused."""
    with opener(checked_url(url)) as r:
        kind, length = r.headers.get("Content-Type", ""), r.headers.get("Content-Length")
        if not (kind.startswith("text/") or "xml" in kind or "json" in kind or urllib.parse.urlsplit(url).path.lower().endswith(TEXT_SUFFIXES)):
            raise ValueError(f"{url} is no text ({kind})")
        if length is not None and int(length) > most:
            raise ValueError(f"{url} has {length} bytes; the limit is {most}")
        raw = r.read(most + 1)
    if len(raw) > most:
        raise ValueError(f"{url} exceeds {most} bytes")
    os.makedirs(os.path.dirname(destination) or ".", exist_ok=True)
    with open(destination, "wb") as f:
        f.write(raw)
    return destination


def binary(url: str, destination: str, most: int, opener=urllib.request.urlopen) -> str:
    """Fetches in chunks to a side file that takes the destination's place once whole; nothing is left of a failed one."""
    os.makedirs(os.path.dirname(destination) or ".", exist_ok=True)
    part = f"{destination}.part"
    try:
        with opener(checked_url(url)) as r, open(part, "wb") as f:
            got = 0
            while chunk := r.read(CHUNK):
                got += len(chunk)
                if got > most:
                    raise ValueError(f"{url} exceeds {most} bytes")
                f.write(chunk)
        os.replace(part, destination)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return destination


def digest(path: str, algorithm: str) -> str:
    h = hashlib.new(algorithm)
    with open(path, "rb") as f:
        while chunk := f.read(CHUNK):
            h.update(chunk)
    return h.hexdigest()


def products(rows: list[dict], root: str, budget: int, opener=urllib.request.urlopen) -> list[str]:
    """Fetches planned products (url, destination, expected_size, checksum) if their sizes fit the budget; verifies each."""
    if any(r.get("expected_size") is None for r in rows):
        raise ValueError("a product without a declared size cannot be budgeted")
    total = sum(r["expected_size"] for r in rows)
    if total > budget:
        raise ValueError(f"{total} bytes exceed the budget of {budget}")
    out = []
    for r in rows:
        path = binary(r["url"], target(root, r["destination"]), r["expected_size"], opener)
        if os.path.getsize(path) != r["expected_size"]:
            raise ValueError(f"{path} has {os.path.getsize(path)} bytes, not {r['expected_size']}")
        if r.get("checksum"):
            algorithm, expected = r["checksum"].split(":", 1)
            if digest(path, algorithm.lower()) != expected.lower():
                raise ValueError(f"{path} does not have its checksum")
        out.append(path)
    return out


def documents(rows: list[dict], root: str, opener=urllib.request.urlopen) -> list[str]:
    """Fetches a manifest's small documents (url, local_path, expected_max_bytes), in their order."""
    return [text(r["url"], target(root, r["local_path"]), min(r.get("expected_max_bytes") or TEXT_BYTES, TEXT_BYTES), opener) for r in rows]


def product_labels(rows: list[dict], root: str, opener=urllib.request.urlopen) -> list[str]:
    """Fetches the labels that product files declare, each destination once."""
    wanted: dict[str, str] = {}
    for r in rows:
        if r.get("label_url") and r.get("label_local_path"):
            wanted.setdefault(r["label_local_path"], r["label_url"])
    return [text(url, target(root, path), TEXT_BYTES, opener) for path, url in wanted.items()]


def named(rows: list[dict], names: list[str] | None) -> list[dict]:
    """The products of these names, in their order; all without names. An unknown name fails."""
    if not names:
        return rows
    unknown = sorted(set(names) - {r["name"] for r in rows})
    if unknown:
        raise ValueError(f"no such product: {', '.join(unknown)}")
    return [r for r in rows if r["name"] in set(names)]
