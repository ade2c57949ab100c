"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewire.llm.common import byte_slices

#: Texts longer than this many characters are cut at safe boundaries before encoding.
LONG = 200_000
#: A rank file beyond this size is refused instead of broadcast.
MAX_RANK_BYTES = 64 << 20
#: Between a non-space and "one space, then a non-space" no match of the pattern can reach across: a space can only
#: open a match or stand in a run of white space.
_SAFE = regex.compile(r"(?<=\S)(?= \S)")


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def safe_pieces(text: str, size: int = LONG) -> Iterator[str]:
    """Cut ``text`` into pieces of about ``size`` characters at boundaries which the pre-split never crosses."""
    lo = 0
    while len(text) - lo > size:
        cut = _SAFE.search(text, lo + size)
        if cut is None:
            break
        yield text[lo : cut.start()]
        lo = cut.start()
    yield text[lo:]


def encode_text(encoding, text: str, size: int = LONG) -> np.ndarray:
    if len(text) <= size:
        return np.asarray(encoding.encode_ordinary(text), np.uint32)
    return np.concatenate([np.asarray(encoding.encode_ordinary(p), np.uint32) for p in safe_pieces(text, size)])


def encode_decode(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each whole text and decode the ids again.

    Returns (key, n_tokens long, ids binary: little-endian unsigned 32-bit integers, decoded binary: raw bytes). A null
    text counts as empty and has no ids; repeated rows are encoded each; a null key stays null; other columns of ``df``
    are not read. Special tokens do not exist: their strings are ordinary text. The rank file is read on the driver,
    its size checked, and broadcast, so executors need no copy of it.
    """
    with open(rank_file, "rb") as f:
        content = f.read(MAX_RANK_BYTES + 1)
    if len(content) > MAX_RANK_BYTES:
        raise ValueError(f"rank file {rank_file} is larger than {MAX_RANK_BYTES} bytes")
    ranks = df.sparkSession.sparkContext.broadcast(content)
    out = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks.value, pattern)
        for batch in batches:
            for part in byte_slices(batch, text):
                counts, ids, decoded = [], [], []
                for t in part.column(text).to_pylist():
                    got = encode_text(encoding, t or "")
                    counts.append(len(got))
                    ids.append(got.astype("<u4").tobytes())
                    decoded.append(encoding.decode_bytes(got.tolist()))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], [key, "n_tokens", "ids", "decoded"])

    return df.select(key, text).mapInArrow(run, out)
