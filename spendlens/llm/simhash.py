"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by Hamming distance through pivot tables."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm.common import bounded_batches, packed, text_key, unpacked
from spendlens.llm.components import components
from spendlens.session import materialize

#: Reference fingerprints whose distances make up the pivot table.
PIVOTS = 16
#: Fingerprints per bucket above which it is compared in tiles.
TILE = 256
_BLOCK = 1 << 16  # shingles hashed at a time


def _mixed(n: int) -> np.ndarray:
    """n well-spread 64-bit numbers (the finaliser of a 64-bit mixer over a Weyl sequence)."""
    z = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Bit b is set if more than half of the shingles' XXH64 (seed 42) have it. No words: zero."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z, and the six ASCII blanks
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    firsts, lasts = starts[:n], ends[min(shingle, len(words)) - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        spans = zip(firsts[at : at + _BLOCK].tolist(), lasts[at : at + _BLOCK].tolist(), strict=True)
        hashes = np.array([digest(line[s:e], 42) for s, e in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")


def as_hex(print_: Column) -> Column:
    return F.lpad(F.lower(F.hex(print_)), 16, "0")


def _masks(blocks: int, differing: int) -> list[int]:
    """Bit masks of every choice of blocks - differing blocks: two prints within the distance agree on one of them."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in itertools.pairwise(cuts)]
    masks = [sum(c) for c in itertools.combinations(each, blocks - differing)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _linked(prints: np.ndarray, buckets: np.ndarray, distance: int, pivots: np.ndarray) -> np.ndarray:
    """For each row, sorted by bucket, the first row of the group it is linked with inside its bucket.

    Pairs whose pivot distances differ anywhere by more than the distance are discarded; survivors are verified.
    """
    table = np.bitwise_count(prints[:, None] ^ pivots[None, :]).astype(np.int8)
    root, left, step, found = np.arange(len(prints)), np.arange(len(prints)), 0, []
    while True:
        step += 1
        left = left[left + step < len(prints)]
        left = left[buckets[left] == buckets[left + step]]
        if not len(left):
            break
        near = left
        for k in range(table.shape[1]):  # each pivot leaves fewer pairs to the next
            near = near[np.abs(table[near, k] - table[near + step, k]) <= distance]
        near = near[np.bitwise_count(prints[near] ^ prints[near + step]) <= distance]
        if len(near):
            found.append((near, near + step))
    if found:
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        while True:
            before = root.copy()
            np.minimum.at(root, a, root[b])
            np.minimum.at(root, b, root[a])
            root = root[root]
            if (root == before).all():
                break
    return root


def _bucket_links(distance: int):
    pivots = _mixed(PIVOTS)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket. A bucket that a batch may cut is held back for the next one."""
        held_b, held_p = np.empty(0, np.int64), np.empty(0, np.uint64)

        def linked(b: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
            root = _linked(p, b, distance, pivots)
            other = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays(
                [pa.array(p[root[other]].view(np.int64)), pa.array(p[other].view(np.int64))], names=["a", "b"]
            )

        for batch in batches:
            b = np.concatenate((held_b, batch.column(0).to_numpy(zero_copy_only=False)))
            p = np.concatenate((held_p, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            whole = int(np.searchsorted(b, b[-1])) if len(b) else 0
            if whole:
                yield linked(b[:whole], p[:whole])
            held_b, held_p = b[whole:], p[whole:]
        if len(held_b):
            yield linked(held_b, held_p)

    return links


def near_links(prints: DataFrame, distance: int = 4, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect all distinct values of ``_print`` within the distance: a spanning forest per bucket.

    Two prints within the distance agree on all but ``distance`` of the blocks that 64 bits are cut into; every such
    choice of blocks is a bucket key, so no pair is lost. There are as many blocks as keep a bucket of unrelated prints
    at about one, whatever the number of prints. Buckets of over ``tile`` prints (related ones) are compared as pairs
    of bounded tiles in separate tasks; of no bucket are all pairs put out.
    """
    bounded_batches(prints.sparkSession)
    distinct = prints.select("_print").distinct()
    n = distinct.count()
    blocks = next(b for b in range(distance + 2, 17) if 2 ** (64 * (b - distance) / b) >= n)
    keys = [F.xxhash64(F.lit(i), F.col("_print").bitwiseAND(F.lit(m))) for i, m in enumerate(_masks(blocks, distance))]
    rows = materialize(distinct.select("_print", F.explode(F.array(*keys)).alias("_key")), "keys")
    counts = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    tiles = F.ceil(F.col("_n") / tile).cast("int")
    mine = F.pmod(F.xxhash64(F.lit("tile"), "_print"), F.col("_tiles")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("_tiles") - 1), lambda j: (j != F.col("_mine")) | (F.col("_tiles") == 1))
    dealt = (
        rows.join(counts, "_key")
        .withColumn("_tiles", tiles)
        .withColumn("_mine", mine)
        .select("_print", "_key", "_mine", F.explode(others).alias("_other"))
        .select(
            F.xxhash64("_key", F.least("_mine", "_other"), F.greatest("_mine", "_other")).alias("_bucket"), "_print"
        )
    )
    return (
        dealt.repartition(F.col("_bucket"))
        .sortWithinPartitions("_bucket")
        .mapInArrow(_bucket_links(distance), "a long, b long")
    )


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 4) -> DataFrame:
    """A row per document: its id, the key of its text, ``print`` and ``component_id``, the smallest id among the
    documents it reaches over links of ``distance`` or fewer differing bits (null if none of them has an id).

    Null, empty and blank texts have print 0 and are linked like others. Documents of one print are one node, so copies
    cost nothing; repeated rows each stay. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    ids = docs.select(F.col(doc_id).alias("_id"), *text_key(F.col(text)), _fingerprints(F.col(text)).alias("_print"))
    prints = materialize(ids, "prints")
    return named(prints, materialize(components(near_links(prints, distance)), "roots"))


def named(prints: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``prints`` with ``component_id``; ``roots`` are the components of their values of ``_print``."""
    least = prints.groupBy("_print").agg(F.min("_id").alias("_least"))
    placed = materialize(
        least.join(roots, F.col("_print") == F.col("node"), "left").select(
            "_print", "_least", F.coalesce("root", "_print").alias("_root")
        ),
        "placed",
    )
    names = placed.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return prints.join(placed.select("_print", "_root").join(names, "_root").drop("_root"), "_print")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 4) -> DataFrame:
    """One document of each group, with its own columns: the one that names the group (of repeated ids, the first by a
    hash of the text; without ids, likewise; of equal ids and texts, the first by a hash of the row)."""
    return keep_first(docs, groups(docs, doc_id, text, distance), doc_id, text)


def keep_first(docs: DataFrame, grouped: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The document of each group of ``grouped`` that ``keep_one`` takes."""
    chosen = (
        grouped.where(F.col("_id").eqNullSafe(F.col("component_id")))
        .groupBy(F.coalesce(F.col("component_id").cast("string"), F.col("_print").cast("string")).alias("_group"), F.col("component_id").isNull().alias("_nameless"))
        .agg(F.min(F.struct("_id", "_k1", "_k2")).alias("_first"))
        .select("_first.*")
    )
    keyed = docs.select(packed(docs), F.col(doc_id).alias("_own"), *text_key(F.col(text))).alias("d")
    same = (
        F.col("_own").eqNullSafe(F.col("_id"))
        & (F.col("d._k1") == F.col("c._k1"))
        & (F.col("d._k2") == F.col("c._k2"))
    )
    kept = keyed.join(chosen.alias("c"), same, "left_semi")
    # equal id and text, but perhaps other columns: the first by content, so that a repeated task takes the same row
    one = kept.groupBy("_own", "_k1", "_k2").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return one.select(*unpacked(docs))
