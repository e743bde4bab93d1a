"""Greyscale TIFF: one uncompressed strip, 8 or 16 bits, black is zero; values as doubles in [0, 1]."""

from __future__ import annotations

import struct

import numpy as np

#: Tag numbers of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, X_RES, Y_RES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 282, 283
SHORT, LONG, RATIONAL = 3, 4, 5


def decode(raw: bytes) -> np.ndarray:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(f"{order}H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(f"{order}I", raw, 4)
    (count,) = struct.unpack_from(f"{order}H", raw, at)
    tags = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(f"{order}HHI", raw, at + 2 + 12 * i)
        field = at + 2 + 12 * i + 8
        if n == 1 and kind in (SHORT, LONG):
            tags[tag] = struct.unpack_from(f"{order}{'H' if kind == SHORT else 'I'}", raw, field)[0]
        elif tag in (STRIP_AT, STRIP_BYTES):
            raise ValueError("more than one strip")
    bits = tags.get(BITS, 1)
    if tags.get(COMPRESSION, 1) != 1 or tags.get(PHOTOMETRIC, 1) != 1 or tags.get(SAMPLES, 1) != 1 or bits not in (8, 16):
        raise ValueError("only uncompressed 8- and 16-bit black-is-zero images are read")
    h, w = tags[HEIGHT], tags[WIDTH]
    if len(raw) < tags[STRIP_AT] + h * w * bits // 8:
        raise ValueError("the strip is short")
    samples = np.frombuffer(raw, f"{order}u{bits // 8}", h * w, tags[STRIP_AT]).reshape(h, w)
    return samples / float(2**bits - 1)


def encode(image: np.ndarray) -> bytes:
    """16 bits, little-endian; values outside [0, 1] are refused."""
    if image.ndim != 2 or not np.isfinite(image).all() or image.min() < 0 or image.max() > 1:
        raise ValueError("an image to write is two-dimensional, finite and within [0, 1]")
    h, w = image.shape
    strip = np.rint(image * 65535).astype("<u2").tobytes()
    at, res = 8, 8 + len(strip)
    entries = [
        (WIDTH, LONG, w), (HEIGHT, LONG, h), (BITS, SHORT, 16), (COMPRESSION, SHORT, 1), (PHOTOMETRIC, SHORT, 1), (STRIP_AT, LONG, at),
        (SAMPLES, SHORT, 1), (ROWS_PER_STRIP, LONG, h), (STRIP_BYTES, LONG, len(strip)), (X_RES, RATIONAL, res), (Y_RES, RATIONAL, res),
    ]
    table = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", tag, kind, 1, value) for tag, kind, value in entries) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, res + 8) + strip + struct.pack("<II", 72, 1) + table
