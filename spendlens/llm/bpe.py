"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm.common import bounded_batches

#: Places where no match of the splitting pattern can reach across: before ASCII white space that follows something
#: else, and between an ASCII letter and a digit. A match holds white space only at its start, and never both of the
#: other two; what precedes a cut decides nothing after it.
_SAFE_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")

#: Characters after which a long text is cut at the next safe place.
PIECE_CHARS = 1 << 20


@functools.lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """One per worker process."""
    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding(
        "local", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={}
    )


def pieces(text: str, chars: int = PIECE_CHARS) -> Iterator[str]:
    """The text in order, cut at safe places only; a stretch without one stays whole."""
    at = 0
    while len(text) - at > chars:
        cut = _SAFE_CUT.search(text, at + chars)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(encoding: tiktoken.Encoding, text: str, chars: int = PIECE_CHARS) -> bytes:
    """Ids of the text as little-endian unsigned 32-bit integers."""
    return b"".join(
        np.asarray(encoding.encode_to_numpy(p, disallowed_special=()), "<u4").tobytes() for p in pieces(text, chars)
    )


class ByteBpe:
    """Encoder and decoder of one rank file. The file is read on the driver and broadcast: it is a vocabulary, of a size
    that does not depend on the data (about 1 MB)."""

    def __init__(self, spark: SparkSession, rank_file: str, pattern: str) -> None:
        with open(rank_file, "rb") as file:
            self._ranks = spark.sparkContext.broadcast(file.read())
        self._pattern = pattern
        bounded_batches(spark)

    def encode(self, text: Column) -> Column:
        """Ids as a binary of little-endian unsigned 32-bit integers; null and empty texts have none (empty binary)."""
        ranks, pattern = self._ranks, self._pattern

        @F.pandas_udf(T.BinaryType())
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encoding = _encoding(ranks.value, pattern)
            for texts in batches:
                yield pd.Series([encode_text(encoding, t or "") for t in texts], dtype=object)

        return encode(text)

    def decode(self, ids: Column) -> Column:
        """Raw bytes of the ids, which need not be valid UTF-8 if ids were cut off; null gives empty bytes. An id that is
        not in the rank file raises an error."""
        ranks, pattern = self._ranks, self._pattern

        @F.pandas_udf(T.BinaryType())
        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encoding = _encoding(ranks.value, pattern)
            for rows in batches:
                yield pd.Series(
                    [encoding.decode_bytes(np.frombuffer(r or b"", "<u4").tolist()) for r in rows], dtype=object
                )

        return decode(ids)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """Documents with ``n_tokens``, ``token_ids`` (little-endian unsigned 32-bit) and ``decoded`` (bytes of those ids).

    Columns of these names are replaced. Each row is encoded by itself, whole, without special tokens (their strings are
    ordinary text), in the task that reads it: nothing is shuffled. Null is like empty: no tokens. Long texts are cut at
    places no token can span, so the ids are those of the whole text.
    """
    bpe = ByteBpe(docs.sparkSession, rank_file, pattern)
    rest = [c for c in docs.columns if c not in ("n_tokens", "token_ids", "decoded")]
    ids = docs.select(*rest, bpe.encode(F.col(text)).alias("token_ids"))
    return ids.select(
        *rest,
        "token_ids",
        F.expr("cast(octet_length(token_ids) div 4 as bigint)").alias("n_tokens"),
        bpe.decode(F.col("token_ids")).alias("decoded"),
    )
