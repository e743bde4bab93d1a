"""Personal data: fixed patterns, and weakly supervised spans beside them.

Fixed patterns find e-mail addresses, IP addresses, payment cards and phone numbers. Wider
patterns propose further spans; regex, gazetteer and context labelers vote on each (yes, no,
abstain). Counts of the vote patterns over the whole corpus go to expectation-maximisation, which
estimates every labeler's reliability without labels, and its posteriors train a logistic span
classifier. A proposed span is described by a bounded code (kind, votes, size, make-up), so what
reaches the driver is a table of codes with counts, not of spans.

Defined results: a null or empty text has no spans; a proposed span that overlaps a fixed one is
dropped; repeated rows are scanned alike; texts of any
length are scanned whole, in time that grows with the length; of proposals that overlap, the kinds first named go first, and within a kind the leftmost;
further columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm.common import cut, id_type, map_texts, texts_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("contact", "number", "secret")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where no digit precedes it: the lookbehind spares a long run of digits its restarts.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """From each @ outwards: the local part can only be the run before it, the domain what follows."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        after = at + 1
        if domain := DOMAIN.match(text, after):
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                after = free = domain.end()
                found.append(("email", start, free))
        at = text.find("@", after)
    return found


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by kind and start; offsets count code points."""
    found = emails(text)
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdecimal() for c in m.group()) <= 15]
    return found


#: What proposes a span, of any length. No match starts within a run that it could have begun with, and runs
#: are possessive: the work is linear in the text.
PROPOSE = {
    "contact": re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]++)+"),
    "number": re.compile(r"(?<![0-9A-Za-z.,+-])(?:[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,}(?: [A-Z0-9]{1,3})?|\(?[0-9]++\)?(?:[ ./-][0-9(][0-9)]++){2,})(?![0-9A-Za-z])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+"),
}
DIGIT = re.compile(r"[0-9]")
#: The gazetteers.
CUES = re.compile(r"phone|tel|call|fax|mobile|ssn|social|passport|iban|account|token|key|secret|passw|api|auth|mail|contact|write to", re.I)
COUNTERCUES = re.compile(r"isbn|issn|doi|page|version|release|total|price|year|figure|fig\.|table|chapter|section|http|www", re.I)
SHAPE = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})|(?:AKIA|ghp_|sk-|xox[bp]-)[A-Za-z0-9_-]{16,}|.*(?:\(at\)|\[at\]|\{at\}).*(?:\.|dot).*")
PLAIN = re.compile(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}|([0-9])(?:\1|[ ./-])*|[0-9]{1,3}(?:[ .][0-9]{3})+|[A-Za-z/_=+-]+[0-9]{1,3}")
ASSIGNED = re.compile(r"[=:]\s{0,2}[\"']?$")
MEASURED = re.compile(r"[$€£#]\s?$")
UNIT = re.compile(r"\s?(?:%|km|kg|cm|mm|px|GB|MB|°)")
YES, NO, ABSTAIN = 1, 2, 0


def votes(text: str, start: int, end: int) -> list[int]:
    """One vote a labeler: two by regex, two by gazetteer, four by context and make-up."""
    span, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 4]
    letters = [c for c in span if c.isalnum()]
    variety = len(set(letters)) / max(1, min(len(letters), 16))
    return [
        YES if SHAPE.fullmatch(span) else ABSTAIN,
        NO if PLAIN.fullmatch(span) else ABSTAIN,
        YES if CUES.search(before) else ABSTAIN,
        NO if COUNTERCUES.search(before) else ABSTAIN,
        YES if ASSIGNED.search(before) else ABSTAIN,
        NO if MEASURED.search(before) or UNIT.match(after) else ABSTAIN,
        YES if before[-1:] in "\"'" and before[-1:] and after[:1] == before[-1:] else ABSTAIN,
        YES if variety >= 0.6 else NO if variety < 0.3 else ABSTAIN,
    ]


LABELERS = 8


def code_of(kind: str, span: str, vote: list[int]) -> int:
    """kind, votes, length band, share of digits: all that the span classifier reads."""
    code = ADDED.index(kind)
    for v in vote:
        code = code * 3 + v
    digits = sum(c.isdigit() for c in span)
    return (code * 8 + min(7, len(span) // 8)) * 5 + min(4, 5 * digits // len(span))


def parts_of(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    code, share = np.divmod(code, 5)
    code, length = np.divmod(code, 8)
    vote = np.empty((len(code), LABELERS), np.int64)
    for i in reversed(range(LABELERS)):
        code, vote[:, i] = np.divmod(code, 3)
    return code, vote, length, share


def proposed(text: str, taken: list[Span]) -> list[tuple[str, int, int, int]]:
    """Kind, start, end and code of every proposed span that meets no fixed span and no earlier one."""
    found: list[tuple[str, int, int, int]] = []
    starts, ends = disjoint((a, b) for _, a, b in taken)
    for kind in ADDED:
        if kind == "contact" and not ("(at)" in text or "[at]" in text or "{at}" in text):
            continue
        own = []
        for m in PROPOSE[kind].finditer(text):
            a, b = m.span()
            if kind == "secret" and not DIGIT.search(text, a, b):
                continue
            at = bisect.bisect_left(ends, a + 1)  # the first held span that ends after this one's start
            if at == len(starts) or starts[at] >= b:
                own.append((a, b))
                found.append((kind, a, b, code_of(kind, m.group(), votes(text, a, b))))
        if own:
            starts, ends = disjoint([*zip(starts, ends, strict=True), *own])
    return found


def disjoint(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans, as ascending spans apart from each other."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def reliabilities(vote: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: each pattern's probability of being personal data, and P(vote | class)."""
    start = np.array([[0.6, 0.1, 0.3], [0.6, 0.3, 0.1]])  # [class][abstain, yes, no]: labelers do better than chance
    start[1] = [0.6, 0.35, 0.05]
    p = np.repeat(start[None], LABELERS, 0)
    prior = 0.5
    truth = np.zeros(len(vote))
    each = np.arange(LABELERS)
    for _ in range(rounds):
        log = [np.log(p[each, c, vote]).sum(1) for c in (0, 1)]
        truth = 1 / (1 + np.exp(np.clip(log[0] + np.log1p(-prior) - log[1] - np.log(prior), -50, 50)))
        prior = float(np.clip((truth * count).sum() / max(1, count.sum()), 0.02, 0.98))
        for c, w in ((0, (1 - truth) * count), (1, truth * count)):
            for v in range(3):
                p[:, c, v] = ((vote == v) * w[:, None]).sum(0) + 8 * start[c, v]
            p[:, c] /= p[:, c].sum(1, keepdims=True)
    return truth, p


def design(code: np.ndarray) -> np.ndarray:
    kind, vote, length, share = parts_of(code)
    one = lambda x, n: np.eye(n)[x]
    return np.concatenate([one(kind, len(ADDED)), *(one(vote[:, i], 3) for i in range(LABELERS)), one(length, 8), one(share, 5)], 1)


def classifier(code: np.ndarray, count: np.ndarray, steps: int = 400, decay: float = 1e-3) -> dict[int, float]:
    """Logistic regression on the posteriors; each code's probability."""
    if not len(code):
        return {}
    truth, _ = reliabilities(parts_of(code)[1], count)
    x, weight = design(code), count / count.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (weight * (p - truth)) + decay * w)
    return dict(zip(code.tolist(), (1 / (1 + np.exp(-x @ w))).tolist(), strict=True))


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (array of kind, start, end) and added (those with a probability) for every row."""
    kind = id_type(docs, id_col)

    def scan():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            base, more = [], []
            for text in part.column(1).to_pylist():
                own = base_spans(text)
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in own])
                more.append([dict(zip(("kind", "start", "end", "code"), s, strict=True)) for s in proposed(text, own)])
            span = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(base, pa.list_(pa.struct(span))), pa.array(more, pa.list_(pa.struct([*span, ("code", pa.int64())])))], names=["doc_id", "base", "proposed"])

        return work

    found = cut(map_texts(texts_of(docs, id_col, text_col), scan, f"doc_id {kind}, base array<struct<kind:string,start:bigint,end:bigint>>, proposed array<struct<kind:string,start:bigint,end:bigint,code:bigint>>"))
    codes = found.select(F.explode("proposed.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy("code").toPandas()  # at most as many as there are codes
    scores = classifier(codes["code"].to_numpy(np.int64), codes["n"].to_numpy(np.float64))
    good = docs.sparkSession.sparkContext.broadcast(np.array(sorted(c for c, p in scores.items() if p >= threshold), np.int64))  # of the codes, too

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The proposed spans of accepted codes."""
        for part in batches:
            column = part.column("proposed")
            span, owner = column.flatten(), pc.list_parent_indices(column).to_numpy()
            accepted = np.isin(span.field("code").to_numpy(zero_copy_only=False), good.value)
            offsets = np.r_[0, np.cumsum(np.bincount(owner[accepted], minlength=len(part)))]
            span = span.filter(pa.array(accepted))
            added = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([span.field(c) for c in ("kind", "start", "end")], ["kind", "start", "end"]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("base"), added], names=["doc_id", "base", "added"])

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return found.mapInArrow(keep, f"doc_id {kind}, base {spans}, added {spans}")


def report(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, a count for each fixed kind, base_sha256, spans, a count for each added kind."""
    found = find(docs, threshold)
    of_kind = lambda k: lambda s: s["kind"] == k
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *(F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(text(F.col("base")), 256).alias("base_sha256"),
        text(F.concat("base", "added")).alias("spans"),
        *(F.size(F.filter("added", of_kind(k))).cast("long").alias(f"n_{k}") for k in ADDED),
    )


def sha_of(spans: list[Span]) -> str:
    return hashlib.sha256(spelled(spans).encode()).hexdigest()
