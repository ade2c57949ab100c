"""Balanced values inside scripts: one automaton over bytes finds where an object or list ends."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that are looked at together; what ends sooner costs no more.
BLOCK = 1 << 16
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1


def balanced_end(data: bytes, start: int) -> int:
    """The end of the value that opens at ``start`` with a brace or bracket; -1 if it never closes.

    Braces inside double-quoted strings don't count, nor quotes after an odd number of backslashes.
    """
    depth, quoted, slashes, at = 0, 0, 0, start
    while at < len(data):
        b = np.frombuffer(data, np.uint8, min(BLOCK, len(data) - at), at)
        # The length of the run of backslashes that ends before each byte.
        other = np.where(b != 0x5C, np.arange(len(b)), -1)
        last = np.maximum.accumulate(np.concatenate([[-1], other[:-1]]))
        run = np.arange(len(b)) - last - 1
        run[last == -1] += slashes
        marks = (b == 0x22) & (run % 2 == 0)
        inside = (np.cumsum(marks) + quoted) % 2
        steps = np.where((inside == 0) & ~marks, _STEP[b], 0)
        level = depth + np.cumsum(steps, dtype=np.int64)
        ends = np.flatnonzero((level == 0) & (steps < 0))
        if len(ends):
            return at + int(ends[0]) + 1
        depth, quoted = int(level[-1]), int(inside[-1])
        tail = int(other.max())
        slashes = len(b) - 1 - tail if tail >= 0 else slashes + len(b)
        at += len(b)
    return -1


def embedded(text: str | None, marker: re.Pattern) -> list[str]:
    """The balanced values that follow matches of ``marker``, which end before the value's first byte."""
    if not text:
        return []
    out, data, at, seen = [], text.encode("utf-8", "surrogatepass"), 0, 0
    for match in marker.finditer(text):
        at += len(text[seen : match.end()].encode("utf-8", "surrogatepass"))
        seen = match.end()
        if text[seen : seen + 1] in ("{", "["):
            end = balanced_end(data, at)
            if end > 0:
                out.append(data[at:end].decode("utf-8", "surrogatepass"))
    return out


def embedded_values(text: Column, marker: str) -> Column:
    """array<string>: what ``embedded`` finds in each text, in order; a null text has none."""
    pattern = re.compile(marker)

    @F.pandas_udf("array<string>")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: embedded(t, pattern))

    return read(text)
