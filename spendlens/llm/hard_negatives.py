"""Hard-negative mining: exact windows of inner products over blocks in Hilbert order with zone maps per dimension."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import bounded_batches
from spendlens.session import materialize

#: Rows of a block, which has a zone map; rows of a group of blocks, which one task holds at a time.
BLOCK, GROUP = 256, 1 << 17
#: Least and most groups: few enough for their zone maps to be sent to all tasks, in memory too (see ``Shape``).
LEAST_GROUPS, MOST_GROUPS = 24, 1 << 14
#: Anchors that are compared with a group together.
TILE = 256
#: Bits per dimension of a place on the Hilbert curve.
CURVE_BITS = 3
#: Components of this size or more (after scaling) could give scores beyond 64 bits.
TOO_LARGE = 1 << 28
_NONE = -(1 << 62)


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


@dataclass(frozen=True)
class Shape:
    """What one pass over the vectors tells: their number, longest length, and largest component."""

    rows: int
    dims: int
    top: int

    @property
    def groups(self) -> int:
        """Each group holds GROUP rows, more only if the zone maps would be too many."""
        return min(max(LEAST_GROUPS, -(-self.rows // GROUP)), MOST_GROUPS)

    @property
    def kind(self) -> type:
        return np.int16 if self.top < 1 << 15 else np.int32

    @property
    def exact_floats(self) -> bool:
        """Whether every sum of products is a whole number that a double holds."""
        return self.dims * self.top**2 < 1 << 53


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: Column, scale: int) -> DataFrame:
    """``id``, ``label`` and ``v``, the components times ``scale`` rounded down, of the rows that take part."""
    x = F.transform(F.col(embedding), lambda c: F.floor(c.cast("double") * scale))
    fine = F.forall(F.col(embedding), lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * scale < TOO_LARGE), F.lit(False)))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.col(embedding).alias(embedding))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col(embedding).isNotNull() & fine).select("id", "label", x.cast("array<int>").alias("v"))


def hilbert_keys(points: np.ndarray, bits: int) -> list[bytes]:
    """Place of each row of ``points`` (whole numbers below 2 ** bits) on the Hilbert curve, as bytes that sort alike.

    Bits of a coordinate below the current one are flipped or swapped with those of the first dimension, from the top bit
    down; then Gray decoding over the dimensions gives the place, bit plane by bit plane.
    """
    x, n = points.astype(np.int64).T.copy(), points.shape[1]
    for shift in range(bits - 1, 0, -1):
        low = (1 << shift) - 1
        for i in range(n):
            high = x[i] >> shift & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap if i else 0
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for shift in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> shift & 1 == 1, (1 << shift) - 1, 0)
    x ^= turn
    planes = np.stack([x >> shift & 1 for shift in range(bits - 1, -1, -1)])  # bits, dimensions, rows
    packed = np.packbits(planes.reshape(bits * n, -1).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims)[None, :] < lengths[:, None]] = flat
    return out


def _rows(column: pa.Array, kind: type, dims: int) -> list[np.ndarray]:
    return [np.frombuffer(b, kind).reshape(-1, dims) for b in column.to_pylist()]


def index(rows: DataFrame, shape: Shape) -> DataFrame:
    """A row per block of up to BLOCK vectors, in the order of label, place on the Hilbert curve and id: ``grp``,
    ``block``, ``ids``, ``labels`` and ``vectors`` (bytes), and its zone map: ``low`` and ``high`` per dimension (bytes),
    ``least_label`` and ``most_label``. Written as Parquet, a file per range of the order.
    """
    dims, kind, top = shape.dims, shape.kind, max(shape.top, 1)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column(2), dims)
            cells = np.clip((values + top) * (1 << CURVE_BITS) // (2 * top + 1), 0, (1 << CURVE_BITS) - 1)
            vectors = [row.tobytes() for row in values.astype(kind)]
            columns = [batch.column(0), batch.column(1), pa.array(hilbert_keys(cells, CURVE_BITS), pa.binary()), pa.array(vectors, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "place", "vector"])

    order = ["label", "place", "id"]
    placed = rows.mapInArrow(places, "id long, label long, place binary, vector binary")
    ranged = placed.repartitionByRange(shape.groups, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "id", "label", "vector")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done, part = [], 0, 0

        def block_of(batch: pa.RecordBatch, number: int) -> tuple:
            vectors = np.stack([np.frombuffer(v, kind) for v in batch.column(3).to_pylist()])
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            return (
                (part << 20) + number * BLOCK // GROUP, number, ids.tobytes(), labels.tobytes(), vectors.tobytes(),
                vectors.min(0).tobytes(), vectors.max(0).tobytes(), int(labels.min()), int(labels.max()),
            )

        def table(made: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=_names(INDEX))

        for batch in batches:
            part = batch.column(0)[0].as_py() if batch.num_rows else part
            held.append(batch)
            if sum(b.num_rows for b in held) < BLOCK:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            full = whole.num_rows // BLOCK
            yield table([block_of(whole.slice(i * BLOCK, BLOCK), done + i) for i in range(full)])
            held, done = [whole.slice(full * BLOCK)], done + full
        rest = [b for b in held if b.num_rows]
        if rest:
            yield table([block_of(pa.Table.from_batches(rest).combine_chunks().to_batches()[0], done)])

    return materialize(ranged.mapInArrow(cut, INDEX), "blocks")


INDEX = "grp long, block long, ids binary, labels binary, vectors binary, low binary, high binary, least_label long, most_label long"


def zone_maps(blocks: DataFrame, shape: Shape) -> tuple[np.ndarray, ...]:
    """Of all groups: number, low, high, least and most label. At most some MOST_GROUPS rows of two vectors."""
    kind, dims = shape.kind, shape.dims

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for grp, low, high, least, most in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high = np.frombuffer(low, kind), np.frombuffer(high, kind)
                old = held.get(grp, [low, high, least, most])
                held[grp] = [np.minimum(old[0], low), np.maximum(old[1], high), min(old[2], least), max(old[3], most)]
        for grp, (low, high, least, most) in held.items():
            columns = [[grp], [low.tobytes()], [high.tobytes()], [least], [most]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    names = ["grp", "low", "high", "least_label", "most_label"]
    parts = blocks.select(*names).mapInArrow(folded, "grp long, low binary, high binary, least_label long, most_label long").toArrow()
    low, high = (np.frombuffer(b"".join(parts[c].to_pylist()), kind).reshape(-1, dims).astype(np.int64) for c in ("low", "high"))
    return parts["grp"].to_numpy(), low, high, parts["least_label"].to_numpy(), parts["most_label"].to_numpy()


def _bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with anything between ``low`` and ``high``."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


class _Best:
    """The first ``k`` rows (score falling, then id) found so far in each window of each anchor of a tile."""

    def __init__(self, low: np.ndarray, k: int) -> None:
        self.k, self.floor = k, low.copy()  # what a score must reach: the window's end, or the k-th found
        self.found = np.empty((0, 4), np.int64)  # slot (anchor * windows + window), score, id, and a spare

    def add(self, anchor: np.ndarray, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot = anchor * self.floor.shape[1] + window
        every = np.concatenate((self.found, np.stack((slot, score, ids, slot), axis=1)))
        every = every[np.lexsort((every[:, 2], -every[:, 1], every[:, 0]))]
        first = np.searchsorted(every[:, 0], every[:, 0])
        rank = np.arange(len(every)) - first
        self.found = every[rank < self.k]
        kth = every[rank == self.k - 1]
        flat = self.floor.reshape(-1)
        flat[kth[:, 0]] = np.maximum(flat[kth[:, 0]], kth[:, 1])


def _search(group: list[tuple], anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool, floats: bool) -> np.ndarray:
    """Rows (anchor, window, score, id): the first ``k`` in [low, high] of the rows of the anchor's label or of others.

    Blocks are read from the most promising on; an anchor reads a block only if, by the block's zone map, one of its
    windows can still gain from it. Equal scores are read too, as a smaller id may win.
    """
    best, kind = _Best(low, k), np.float64 if floats else np.int64
    work = anchors.astype(kind)
    zones = [np.stack([b[i] for b in group]).astype(kind) for i in (3, 4)]
    least, most = _bounds(work, *zones)
    for j in np.argsort(-most.max(0), kind="stable").tolist():
        their_ids, their_labels, vectors = group[j][:3]
        reach = ((most[:, j, None] >= best.floor) & (least[:, j, None] <= high)).any(1)
        if not same:
            reach &= (their_labels.min() != labels) | (their_labels.max() != labels)
        else:
            reach &= (their_labels.min() <= labels) & (labels <= their_labels.max())
        rows = np.flatnonzero(reach)
        if not len(rows):
            continue
        scores = (work[rows] @ vectors.T.astype(kind)).astype(np.int64)
        fits = (their_labels[None, :] == labels[rows, None]) == same
        if same:
            fits &= their_ids[None, :] != ids[rows, None]
        hits = [np.nonzero(fits & (scores >= best.floor[rows, w, None]) & (scores <= high[rows, w, None])) for w in range(low.shape[1])]
        anchor, other = (np.concatenate([h[i] for h in hits]) for i in (0, 1))
        window = np.repeat(np.arange(len(hits)), [len(h[0]) for h in hits])
        if len(anchor):
            best.add(rows[anchor], window, scores[anchor, other], their_ids[other])
    anchor, window = np.divmod(best.found[:, 0], low.shape[1])
    return np.stack((anchor, window, best.found[:, 1], best.found[:, 2]), axis=1)


ASKED = "grp long, key long, id long, label long, vector binary, low array<long>, high array<long>"
FOUND = "key long, window int, score long, id long"


def first_in_windows(asked: DataFrame, blocks: DataFrame, shape: Shape, k: int, same: bool) -> DataFrame:
    """For each anchor (``key``, ``id``, ``label``, ``vector``) and each of its windows (``low`` to ``high``, arrays of one
    length): the first ``k`` rows of its label (but those of its id), or of other labels; candidates per group of blocks,
    of which the first k by score and id are the answer.

    An anchor is sent to the groups whose zone map can hold something for it, and meets one group at a time there.
    """
    spark = asked.sparkSession
    zones = spark.sparkContext.broadcast(zone_maps(blocks, shape))
    kind, dims, floats = shape.kind, shape.dims, shape.exact_floats

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, low, high, least_label, most_label = zones.value
        for whole in batches:
            for at in range(0, whole.num_rows, TILE):
                batch = whole.slice(at, TILE)
                least, most = _bounds(np.concatenate(_rows(batch.column(3), kind, dims)).astype(np.int64), low, high)
                labels = batch.column(2).to_numpy(zero_copy_only=False)[:, None]
                if same:
                    fits = (least_label <= labels) & (labels <= most_label)
                else:
                    fits = (least_label != labels) | (most_label != labels)
                start, stop = (np.stack(batch.column(i).to_numpy(zero_copy_only=False)) for i in (4, 5))
                fits &= ((most[:, :, None] >= start[:, None, :]) & (least[:, :, None] <= stop[:, None, :])).any(2)
                anchor, group = np.nonzero(fits)
                if len(anchor):
                    rows = batch.take(pa.array(anchor))
                    yield pa.RecordBatch.from_arrays([pa.array(grp[group]), *rows.columns], names=_names(ASKED))

    tables = asked.mapInArrow(sent, ASKED).withColumn("block", F.lit(None).cast("long"))
    stored = ["ids", "labels", "vectors", "low", "high"]
    met = (
        blocks.select("grp", "block", F.struct(*stored).alias("rows"))
        .unionByName(tables.withColumn("anchor", F.struct("key", "id", "label", "vector", "low", "high")).select("grp", "block", "anchor"), allowMissingColumns=True)
        .repartition(shape.groups, "grp")
        .sortWithinPartitions("grp", F.col("block").asc_nulls_last())
    )

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, group, waiting = None, [], []

        def answers() -> Iterator[pa.RecordBatch]:
            while waiting:
                tile, waiting[:] = waiting[:TILE], waiting[TILE:]
                key, ids, labels = (np.array([a[c] for a in tile], np.int64) for c in ("key", "id", "label"))
                vectors = np.concatenate([np.frombuffer(a["vector"], kind).reshape(1, dims) for a in tile])
                start, stop = (np.array([a[c] for a in tile], np.int64) for c in ("low", "high"))
                out = _search(group, vectors, ids, labels, start, stop, k, same, floats)
                columns = [key[out[:, 0]], out[:, 1].astype(np.int32), out[:, 2], out[:, 3]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_names(FOUND))

        for batch in batches:
            for grp, block, rows, anchor in zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "rows", "anchor")), strict=True):
                if grp != current:
                    yield from answers()
                    current, group = grp, []
                if block is not None:
                    ids, labels = (np.frombuffer(rows[c], np.int64) for c in ("ids", "labels"))
                    low, high = (np.frombuffer(rows[c], kind) for c in ("low", "high"))
                    group.append((ids, labels, np.frombuffer(rows["vectors"], kind).reshape(-1, dims), low, high))
                else:
                    waiting.append(anchor)
                    if len(waiting) == TILE:
                        yield from answers()
        yield from answers()

    found = met.mapInArrow(searched, FOUND)
    first = Window.partitionBy("key", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)


def mine(
    vectors: DataFrame,
    is_anchor: Column | str,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    least_percent: int = 30,
    most_percent: int = 90,
    scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor (``is_anchor``, over
    ``id``) and each of its first ``positives`` other rows of its label, the first ``negatives`` rows of other labels whose
    score lies between the two percentages of the positive's. Scores are inner products of components times ``scale``
    rounded down; higher ones come first, ties by smaller id. All answers are exact.

    Rows with a null id, label, vector or component, one that is not finite, or one of 2 ** 28 or more after scaling (its
    scores might not fit 64 bits) take no part. Vectors of unequal length are filled up with zeros. Rows of one id are
    separate rows, but none is a positive of another; each one that is an anchor is answered. Positives below zero have no
    window. Empty tables and anchors without positives or negatives give no rows. Other columns are ignored.

    All rows are indexed once, as blocks with zone maps; anchors are dealt to groups of blocks in two rounds, for positives
    and then for windows. A task holds one group and one tile of anchors, whatever the labels and copies.
    """
    bounded_batches(vectors.sparkSession)
    rows = materialize(usable(vectors, vec_id, embedding, F.col("label") if label is None else label, scale), "vectors")
    n, dims, top = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))).first()
    shape = Shape(n, max(dims or 1, 1), top or 0)
    kind, width = shape.kind, shape.dims
    blocks = index(rows, shape)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [*batch.columns[:3], pa.array([v.tobytes() for v in _matrix(batch.column(3), width).astype(kind)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "label", "vector"])

    anchors = rows.where(is_anchor).select(F.monotonically_increasing_id().alias("key"), "id", "label", "v")
    anchors = materialize(anchors.mapInArrow(packed, "key long, id long, label long, vector binary"), "anchors")
    ends = [F.array(F.lit(x).cast("long")) for x in (_NONE, -_NONE)]
    near = materialize(
        first_in_windows(anchors.select("*", ends[0].alias("low"), ends[1].alias("high")), blocks, shape, positives, same=True)
        .select("key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "place")
        .where("positive_score >= 0"),
        "positives",
    )
    # 30 p <= 100 s <= 90 p in whole numbers: from the quotient rounded up to the other one rounded down
    low = F.expr(f"(positive_score * {least_percent} + 99) div 100")
    high = F.expr(f"positive_score * {most_percent} div 100")
    windows = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score", low.alias("low"), high.alias("high")))).alias("w"))
    # all anchors of a batch have as many windows; those that lack some get empty ones
    filled = [
        F.array(*[F.coalesce(F.get(F.col(f"w.{name}"), F.lit(i)), F.lit(none).cast("long")) for i in range(positives)]).alias(name)
        for name, none in (("low", -_NONE), ("high", _NONE))
    ]
    asked = materialize(anchors.join(windows, "key").select("key", "id", "label", "vector", *filled), "windows")
    found = first_in_windows(asked, blocks, shape, negatives, same=False).withColumn("place", F.col("place").cast("int"))
    pairs = near.select("key", (F.col("place") - 1).alias("window"), "positive_id", "positive_score")
    return (
        found.join(pairs, ["key", "window"])
        .join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
        .select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
