"""LM scoring: a log-frequency Bloom filter of quantised pair counts; the frequent part of it is broadcast."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm.common import bounded_batches, packed, unpacked
from spendlens.llm.words import Words, mix
from spendlens.session import materialize

_U = np.uint64

#: Bits of the part of the filter that is broadcast (64 MiB) and probes per level; it takes as many pairs, from the most
#: frequent down, as leave it half full. The blocks it has, which tasks build; the rest of the filter has blocks of the
#: same size, as many as it needs.
BITS, PROBES, BLOCKS = 1 << 29, 5, 64
#: Words whose exact counts are broadcast (16 bytes each); the counts of rarer ones are joined.
FREQUENT = 1 << 20
#: Occurrences of a context at which its pairs get half of their weight, and the most weight of a pair: the best of a grid
#: on the held-out texts of the 10,000 documents of sf0.1 (see the README).
SMOOTHING, PAIR_SHARE = 2.0, 0.5
#: n-grams a task gathers before it hands on their counts.
_GATHER = 1 << 20
#: The end of a text, and the context of its first word.
END = _U(0x5851F42D4C957F2D)


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _U(0xD1342543DE82EF95) + right)


def _sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all rows (words, then an end), the token before each (an end for the first), tokens per row."""
    words = Words(texts, lower=True)
    lengths = np.diff(words.rows) + 1
    last = np.cumsum(lengths) - 1
    tokens = np.full(int(lengths.sum()), END, np.uint64)
    inner = np.ones(len(tokens), bool)
    inner[last] = False
    tokens[inner] = words.hashes
    before = np.empty_like(tokens)
    before[1:], before[:1] = tokens[:-1], END
    return tokens, before, lengths


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words (order 1) and word pairs (order 2), summed over a million tokens at a time."""

    def flush(parts: list[np.ndarray], order: int) -> pa.RecordBatch:
        grams, counts = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(grams), order, np.int8)), pa.array(grams.view(np.int64)), pa.array(counts)],
            names=["order", "gram", "n"],
        )

    held, size = [], 0
    for batch in batches:
        tokens, before, _ = _sequences(batch.column(0))
        held.append((tokens, _pairs(before, tokens)))
        size += len(tokens)
        if size >= _GATHER:
            yield flush([x[0] for x in held], 1)
            yield flush([x[1] for x in held], 2)
            held, size = [], 0
    if held:
        yield flush([x[0] for x in held], 1)
        yield flush([x[1] for x in held], 2)


def level(count: np.ndarray) -> np.ndarray:
    """Quantised count: 1 + floor(log2 count)."""
    return np.frexp(count.astype(np.float64))[1]


def _positions(grams: np.ndarray, at_level: int, probe: int, block_bits: int) -> np.ndarray:
    """Bit of each gram within its block."""
    return mix(grams + _U((at_level * 64 + probe) * 0x9E3779B97F4A7C15 % (1 << 64))) % _U(block_bits)


def _blocks(grams: np.ndarray) -> np.ndarray:
    """The top bits, as in ``_block_column``; BLOCKS is 64."""
    return grams >> _U(58)


def _block_column(gram: str, parts: int) -> Column:
    """Blocks are numbered through all parts; the part is told by other bits than the block."""
    part = F.shiftrightunsigned(gram, 34).bitwiseAND(F.lit(0xFFFFFF)) % parts
    return (part * BLOCKS + F.shiftrightunsigned(gram, 58)).cast("int")


def _insert(block_bits: int):
    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bits of each block from rows (block, gram, n) that come block by block; one block is held at a time."""

        def made(block: int, flags: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([flags.tobytes()], pa.binary())], names=["block", "flags"]
            )

        current, flags = None, None
        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            grams = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            levels = level(batch.column(2).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                if blocks[low] != current:
                    if current is not None:
                        yield made(current, flags)
                    current, flags = int(blocks[low]), np.zeros(block_bits // 8, np.uint8)
                g, top = grams[low:high], levels[low:high]
                for at_level in range(1, int(top.max()) + 1):
                    g, top = g[top >= at_level], top[top >= at_level]
                    for probe in range(PROBES):
                        position = _positions(g, at_level, probe, block_bits)
                        np.bitwise_or.at(
                            flags, (position >> _U(3)).astype(np.int64), (1 << (position & _U(7))).astype(np.uint8)
                        )
        if current is not None:
            yield made(current, flags)

    return insert


def _probed(flags: np.ndarray, base: np.ndarray, grams: np.ndarray, block_bits: int) -> np.ndarray:
    """Highest level up to which all probes hit: never below the true one, seldom above. ``base`` is the first bit of each
    gram's block."""
    out = np.zeros(len(grams), np.int64)
    alive, at_level = np.arange(len(grams)), 0
    while len(alive) and at_level < 63:
        at_level += 1
        for probe in range(PROBES):
            position = base[alive] + _positions(grams[alive], at_level, probe, block_bits)
            hit = flags[(position >> _U(3)).astype(np.int64)] >> (position & _U(7)).astype(np.uint8) & 1
            alive = alive[hit.astype(bool)]
        out[alive] = at_level
    return out


class LogFrequencyFilter:
    """Bits of all blocks of the broadcast part in order."""

    def __init__(self, flags: np.ndarray) -> None:
        self.flags, self.block_bits = flags, len(flags) * 8 // BLOCKS

    def levels(self, grams: np.ndarray) -> np.ndarray:
        return _probed(self.flags, _blocks(grams) * _U(self.block_bits), grams, self.block_bits)


@dataclass(frozen=True)
class Model:
    """A trained model. What is broadcast of it has a fixed size; the rarer pairs and the word counts are tables."""

    flags: Broadcast | None  # the filter of the pairs that occur ``least`` times or more
    rest: DataFrame | None  # the blocks of the filter of all rarer pairs, if there are any
    parts: int  # that ``rest`` has, each of BLOCKS blocks
    least: int
    bits: int
    train_tokens: int
    distinct: int
    frequent: np.ndarray  # sorted hashes
    counts: np.ndarray
    smoothing: float = SMOOTHING
    pair_share: float = PAIR_SHARE

    @property
    def denominator(self) -> float:
        return self.train_tokens + 0.5 * (self.distinct + 1)


def probability_parts(word: np.ndarray, context: np.ndarray, smoothing: float, pair_share: float, denominator: float) -> tuple[np.ndarray, np.ndarray]:
    """Factor and summand that turn a pair's count into the probability of its word: pair * factor + summand.

    The pair's share of its context is interpolated with the word's own frequency; the better known the context, the more
    the pair counts. Word counts are exact and a pair's quantised count is the least of its octave, so the shares of all
    words after a context add up to 1 at most, and so do the frequencies of all words and an unknown one: with the pairs'
    true levels, the model gives no more than 1 to all words together.
    """
    weight = pair_share * context / (context + smoothing)
    factor = np.divide(weight, context, out=np.zeros(len(weight)), where=context > 0)
    return factor, (1 - weight) * (word + 0.5) / denominator


def pair_count(levels: np.ndarray, word: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Least count of a level; a pair is no more frequent than its parts, whatever the filter says."""
    least = np.where(levels > 0, 2.0 ** (levels - 1), 0.0)
    return np.minimum(least, np.minimum(word, context))


def train(
    docs: DataFrame, text: str = "text", bits: int = BITS, frequent: int = FREQUENT, fill: float = 0.69
) -> tuple[Model, DataFrame]:
    """The model, and the table of exact word counts (gram, n) it comes with.

    All words and pairs of all given texts are counted, in shuffles that grow with the corpus, and all pairs are kept in
    the filter. Its blocks are built each by the task that has their pairs, until about ``fill`` / ln 2 of half full, so that
    it errs as seldom for any corpus. The pairs that are frequent enough to fit into ``bits`` bits are broadcast (the driver
    holds that part, of fixed size); the blocks of all others stay a table. No texts: no tokens, an empty filter. Repeated
    rows and ids count as often as they come.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    counted = (
        docs.select(F.col(text))
        .mapInArrow(_count, "order tinyint, gram long, n long")
        .groupBy("order", "gram")
        .agg(F.sum("n").alias("n"))
    )
    grams = materialize(counted, "grams")
    words, pairs = (grams.where(F.col("order") == order).select("gram", "n") for order in (1, 2))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()

    # how many entries, and how many words, there are of each count; counts are told apart by their 8 leading bits
    rounded = F.col("n") - F.col("n") % F.expr("shiftleft(1L, greatest(length(bin(n)) - 8, 0))")
    sizes = (
        grams.groupBy(rounded.alias("count"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("order") == 2, F.length(F.bin("n")))), F.lit(0)).alias("entries"),
            F.count(F.when(F.col("order") == 1, 1)).alias("words"),
        )
        .orderBy(F.desc("count"))
        .collect()  # at most some 7,000 rows
    )
    room = int(bits * fill / PROBES)
    least = _fitting([(r["count"], r["entries"]) for r in sizes], room)
    often = _fitting([(r["count"], r["words"]) for r in sizes], frequent)
    parts = -(-sum(r["entries"] for r in sizes if r["count"] < least) // room)

    def built(rows: DataFrame, n: int, name: str) -> DataFrame:
        blocked = rows.select(_block_column("gram", n).alias("block"), "gram", "n")
        met = blocked.repartition(F.col("block")).sortWithinPartitions("block")
        return materialize(met.mapInArrow(_insert(bits // BLOCKS), "block int, flags binary"), name)

    width = bits // BLOCKS // 8
    flags = np.zeros(bits // 8, np.uint8)
    for block, made in built(pairs.where(F.col("n") >= least), 1, "filter").toLocalIterator():  # of fixed size
        flags[block * width : (block + 1) * width] = np.frombuffer(made, np.uint8)
    rest = built(pairs.where(F.col("n") < least), parts, "rest") if parts else None
    top = words.where(F.col("n") >= often).toArrow()  # at most `frequent` rows of two numbers
    hashes = top["gram"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    sent = spark.sparkContext.broadcast(flags.tobytes())
    return Model(sent, rest, parts, least, bits, int(total), int(distinct), hashes[order], top["n"].to_numpy()[order]), words


def _fitting(sizes: list[tuple[int, int]], room: int) -> int:
    """The smallest count down to which everything fits; sizes come in falling order of the count."""
    least = 2 * sizes[0][0] + 1 if sizes else 1  # above all counts: they are told by their leading bits
    for count, size in sizes:
        room -= size
        if room < 0:
            break
        least = count
    return least


_OPEN = "array<struct<word:bigint,n_word:bigint,context:bigint,n_context:bigint,pair:bigint,level:int>>"


def _rest_levels(pairs: DataFrame, model: Model, block_bits: int) -> DataFrame:
    """``pair`` and ``level`` of those distinct pairs that the blocks beyond the broadcast part know: each pair goes to the
    task that has its block."""
    asked = pairs.distinct().select(_block_column("pair", model.parts).alias("block"), "pair", F.lit(None).cast("binary").alias("flags"))
    met = model.rest.select("block", F.lit(None).cast("long").alias("pair"), "flags").unionByName(asked)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, flags = None, None
        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(low, high - low)
                if not part.num_rows:
                    continue
                if part.column(2)[0].is_valid:  # the block itself comes first
                    current, flags = int(blocks[low]), np.frombuffer(part.column(2)[0].as_py(), np.uint8)
                    part = part.slice(1)
                if current != blocks[low] or not part.num_rows:
                    continue  # no pair has that block
                grams = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                levels = _probed(flags, np.zeros(len(grams), np.uint64), grams, block_bits)
                columns = [pa.array(grams[levels > 0].view(np.int64)), pa.array(levels[levels > 0].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["pair", "level"])

    # in each block first the row with its bits
    sorted_ = met.repartition(F.col("block")).sortWithinPartitions("block", F.col("flags").isNull())
    return sorted_.mapInArrow(probed, "pair long, level int")


def score(docs: DataFrame, model: Model, words: DataFrame, text: str = "text") -> DataFrame:
    """A row per document: its columns without the text, ``n_tokens``, ``n_known`` (tokens seen in training),
    ``train_tokens``, ``base_score`` (smoothed word frequencies) and ``score``, the log10 probability by the model.

    Columns of these names are replaced. Null and empty texts are an end and nothing else; null and repeated ids and rows
    do not matter, each row is scored by itself. Broadcast are the filter of the frequent pairs and the counts of the most
    frequent words, both of fixed size. Tokens they do not settle are put aside: rarer words go through a join with the
    exact counts, pairs that the broadcast part does not know go, distinct, to the blocks of the rest, and levels come back
    by a join. So all of it grows in proportion to the tokens. Texts themselves are not shuffled.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    flags, asks = model.flags, model.rest is not None
    sent = spark.sparkContext.broadcast(replace(model, flags=None, rest=None))
    own = ("n_tokens", "n_known", "train_tokens", "base_score", "score", text)
    made = "n_tokens long, n_known long, base_score double, score double"
    ordered = docs.select(packed(docs, *own), F.monotonically_increasing_id().alias("_n"), F.col(text).alias("_text"))
    schema = T.StructType([*ordered.schema.fields[:-1], *T.StructType.fromDDL(f"{made}, _open {_OPEN}").fields])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model: Model = sent.value
        held = LogFrequencyFilter(np.frombuffer(flags.value, np.uint8))
        frequent, counts, denominator = own_model.frequent, own_model.counts, own_model.denominator
        for batch in batches:
            tokens, before, lengths = _sequences(batch.column(batch.num_columns - 1))
            row, n = np.repeat(np.arange(batch.num_rows), lengths), batch.num_rows
            kinds, where = np.unique(tokens, return_inverse=True)
            count = np.full(len(kinds), -1, np.int64)  # -1: not among the frequent words
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, kinds), len(frequent) - 1)
                found = frequent[at] == kinds
                count[found] = counts[at[found]]
            word = count[where]
            context = np.roll(word, 1)  # each token follows the one before it, and the first an end, as the last one is
            grams, which = np.unique(_pairs(before, tokens), return_inverse=True)
            levels = held.levels(grams)[which]
            known = word >= 0
            settled = known & (context >= 0) & ((levels > 0) if asks else True)
            parts = probability_parts(word[settled], context[settled], own_model.smoothing, own_model.pair_share, denominator)
            logs = np.zeros(len(tokens))
            logs[settled] = np.log10(pair_count(levels[settled], word[settled], context[settled]) * parts[0] + parts[1])
            base = np.where(known, np.log10((word + 0.5) / denominator, where=known, out=np.zeros(len(word))), 0.0)
            aside = ~settled
            cuts = np.concatenate(([0], np.cumsum(np.bincount(row[aside], minlength=n))))
            fields = [tokens[aside].view(np.int64), word[aside], before[aside].view(np.int64), context[aside], grams[which][aside].view(np.int64), levels[aside].astype(np.int32)]
            structs = pa.StructArray.from_arrays([pa.array(f) for f in fields], ["word", "n_word", "context", "n_context", "pair", "level"])
            columns = [batch.column(i) for i in range(batch.num_columns - 1)] + [
                pa.array(lengths.astype(np.int64)),
                pa.array(np.bincount(row, known, n).astype(np.int64)),
                pa.array(np.bincount(row, base, n)),
                pa.array(np.bincount(row, logs, n)),
                pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), structs),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    scored = materialize(ordered.mapInArrow(scores, schema), "scored")
    aside = _with_counts(scored.select("_n", F.explode("_open").alias("t")).select("_n", "t.*"), words)
    if asks:
        aside = materialize(aside, "aside")
        more = _rest_levels(aside.where("level = 0").select("pair"), model, model.bits // BLOCKS)
        aside = aside.join(more.withColumnRenamed("level", "more"), "pair", "left").withColumn("level", F.greatest("level", F.coalesce("more", F.lit(0))))
    sums = aside.groupBy("_n").agg(
        F.sum(_log10_probability(model)).alias("_log"),
        F.sum(F.when(F.col("rare"), F.log10((F.col("n_word") + 0.5) / F.lit(model.denominator)))).alias("_base"),
        F.count_if(F.col("rare") & (F.col("n_word") > 0)).alias("_known"),
    )
    return scored.drop("_open").join(sums, "_n", "left").select(
        *unpacked(docs, *own),
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("_log", F.lit(0.0))).alias("score"),
    )


def _with_counts(aside: DataFrame, words: DataFrame) -> DataFrame:
    """The counts that the broadcast words did not settle, from the table of all; ``rare`` words are those looked up."""
    for column, n in (("word", "n_word"), ("context", "n_context")):
        # what is known already has a key that no word has, and not one in common
        key = F.when(F.col(n) < 0, F.col(column)).otherwise(F.xxhash64("pair", "_n"))
        counted = words.select(F.col("gram").alias("_key"), F.col("n").alias("_found"))
        aside = aside.withColumns({"_key": key, "_asked": F.col(n) < 0}).join(counted, "_key", "left")
        value = F.when(F.col("_asked"), F.coalesce("_found", F.lit(0))).otherwise(F.col(n))
        aside = aside.withColumn(n, value).withColumnRenamed("_asked", f"_asked_{column}").drop("_key", "_found")
    return aside.withColumn("rare", F.col("_asked_word")).drop("word", "context", "_asked_word", "_asked_context")


def _log10_probability(model: Model) -> Column:
    """As ``probability_parts`` and ``pair_count`` say, on columns."""
    context = F.col("n_context").cast("double")
    weight = F.lit(model.pair_share) * context / (context + F.lit(model.smoothing))
    least = F.when(F.col("level") > 0, F.pow(F.lit(2.0), F.col("level") - 1)).otherwise(0.0)
    pair = F.least(least, F.col("n_word").cast("double"), context)
    share = F.when(context > 0, weight * pair / context).otherwise(0.0)
    return F.log10(share + (1 - weight) * (F.col("n_word") + 0.5) / F.lit(model.denominator))
