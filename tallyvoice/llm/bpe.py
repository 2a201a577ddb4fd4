"""Byte-level BPE encoding and decoding with a local rank file (operator 9).

Each text is split by the pre-tokeniser pattern and merged by tiktoken; special-token strings are
ordinary text. Long texts are cut where a character that is no white space precedes a space or a
line break: no match of the pattern crosses such a place, so the ids are those of the whole text.
Decoding joins the raw bytes of the ids, without any repair of UTF-8.

The work is a map over rows: no shuffle, nothing broadcast (executors read the rank file that is
installed beside their Python), and memory bounded by one Arrow slice.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows give equal
rows; a null id stays null; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
#: Texts longer than this many characters are encoded in parts.
PART_CHARS = 1 << 15
#: Python's \s holds every character that the encoder's \s holds, so this never cuts inside a match.
SAFE_CUT = re.compile(r"\S(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file, made once in each Python worker."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut at safe places only."""
    start = 0
    while len(text) - start > size:
        cut = SAFE_CUT.search(text, start + size - 1)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


def encode(enc: tiktoken.Encoding, text: str, size: int = PART_CHARS) -> np.ndarray:
    """The ids of a whole text as unsigned 32-bit integers."""
    if len(text) <= size:
        return np.array(enc.encode_ordinary(text), dtype="<u4")
    return np.concatenate([np.array(enc.encode_ordinary(p), dtype="<u4") for p in parts(text, size)])


def _encoder(ranks: Callable[[], str] | str, pattern: str, part_chars: int, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks if isinstance(ranks, str) else ranks(), pattern)
        for whole in batches:
            for batch in slices(whole, 1, slice_bytes):
                ids = [encode(enc, text, part_chars) for text in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([x.tobytes() for x in ids], pa.binary()),
                        pa.array([enc.decode_bytes(x.tolist()) for x in ids], pa.binary()),
                    ],
                    names=["id", "n_tokens", "ids", "decoded"],
                )

    return run


def default_ranks() -> str:
    """The installed 50k rank file, looked up on the machine that encodes."""
    return public_tokenizers.path(DEFAULT_RANKS)


def encode_decode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks: Callable[[], str] | str = default_ranks,
    pattern: str = public_tokenizers.PATTERN,
    part_chars: int = PART_CHARS,
    slice_bytes: int = 4 << 20,
) -> DataFrame:
    """Per row: the id, ``n_tokens``, ``ids`` (little-endian uint32, packed) and ``decoded`` bytes."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(
        _encoder(ranks, pattern, part_chars, slice_bytes),
        f"id {kind}, n_tokens long, ids binary, decoded binary",
    )
    return out.withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from the operator's ids and bytes."""
    return encoded.select(
        id_col,
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
