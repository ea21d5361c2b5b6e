"""Prefix trie of conversations: ROLLUP over positional turn columns, in column blocks keyed by the node before them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import blank_words, bounded_batches
from spendlens.session import materialize

#: Turn columns of a block; blocks of a conversation whose keys are added up in one task.
WIDTH, SPAN = 8, 1024
#: Bytes of ids that are joined to one string, about.
_LIST = 1 << 16


def ordered_turns(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Columns ``conv_id``, ``pos`` (from 1, by turn, null first) and ``t``: two hashes of role and text, and its words.

    Null roles and texts are empty; rows of one turn number are ordered by those hashes, and repeated rows are turns of
    their own. Rows without a conversation id are left out. Positions come from a range sort and counts per partition, so
    a conversation may be spread over many tasks.
    """
    said = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.xxhash64(*said).alias("a"),
        F.xxhash64(F.lit("turn"), *said[::-1]).alias("b"),
        F.size(blank_words(F.col(text))).cast("long").alias("words"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "a", "b"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(ranged.drop("turn").withColumn("_row", F.monotonically_increasing_id()), "turns")
    parted = stored.withColumn("_part", F.shiftright("_row", 33))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        parted.groupBy("conv_id", "_part")
        .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return parted.join(firsts, ["conv_id", "_part"]).select(
        "conv_id", (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("pos"), F.struct("a", "b", "words").alias("t")
    )


def grafted(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations that share openings: of conversation c the first h turns give way to those that conversation
    c - c % every has there (fewer, if it has fewer), where h is the checksum of c modulo ``most``.

    A remainder has the sign of c, as in SQL. A conversation that is left without turns is one row with null ``pos`` and
    ``t``.
    """
    turns = materialize(turns, "ordered")
    openings = (
        turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most))
        .groupBy(F.col("conv_id").alias("giver"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("opening"))
    )
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    plans = materialize(
        turns.groupBy("conv_id")
        .agg(F.max("pos").alias("n"))
        .withColumns({"giver": F.col("conv_id") - F.col("conv_id") % every, "h": h.cast("int")})
        .join(openings, "giver", "left")
        .withColumn("opening", F.slice(F.coalesce("opening", F.array()), F.lit(1), F.col("h")))
        .select("conv_id", "n", "h", "opening"),
        "plans",
    )
    given = plans.select("conv_id", F.explode("opening").alias("x")).select("conv_id", "x.pos", "x.t")
    kept = turns.join(plans.select("conv_id", "h", F.size("opening").alias("k")), "conv_id").where("pos > h")
    bare = plans.where("n <= h AND size(opening) = 0").select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast(turns.schema["t"].dataType).alias("t"))
    return given.unionByName(kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "t")).unionByName(bare)


def _keys(pos: Column, t: Column) -> tuple[Column, Column]:
    """A turn at its place. The key of a node is the exclusive or of those on its path, 128 bits; the root's is zero."""
    return F.xxhash64(pos, t["a"], t["b"]), F.xxhash64(F.lit("node"), t["b"], pos, t["a"])


def _columns(width: int) -> list[str]:
    return [f"t{i}" for i in range(1, width + 1)]


def blocks(turns: DataFrame, width: int = WIDTH, span: int = SPAN) -> DataFrame:
    """A row per conversation and ``block`` of ``width`` turns, which are its columns ``t1``, ``t2`` and so on (null past
    the end), with the key ``p1, p2`` of the node before them, the exclusive or ``x1, x2`` of its own turns, and ``upto``:
    the last position of the block, or one more if the conversation goes on.

    Keys before a block are running exclusive ors, within spans of blocks and over spans, so the blocks of one long
    conversation are dealt to many tasks.
    """
    at = F.col("pos") - 1
    places = F.array(
        F.struct(F.expr(f"(pos - 1) div {width}").alias("block"), (at % width).alias("slot")),
        # the first turn of a later block also tells the block before that there is more
        F.when((at % width == 0) & (at > 0), F.struct((F.expr(f"(pos - 1) div {width}") - 1).alias("block"), F.lit(width).cast("long").alias("slot"))),
    )
    placed = (
        turns.select("conv_id", "pos", "t", F.explode(F.array_compact(places)).alias("x"))
        .select("conv_id", "pos", "t", F.coalesce("x.block", F.lit(0)).alias("block"), "x.slot")
        .withColumn("span", F.expr(f"block div {span}"))
        .repartition("conv_id", "span")
    )
    own = F.when(F.col("slot") < width, True)
    h1, h2 = _keys(F.col("pos"), F.col("t"))
    rows = placed.groupBy("conv_id", "span", "block").agg(
        F.coalesce(F.bit_xor(F.when(own, h1)), F.lit(0)).alias("x1"),
        F.coalesce(F.bit_xor(F.when(own, h2)), F.lit(0)).alias("x2"),
        F.coalesce(F.max("pos"), F.lit(0)).alias("upto"),
        *[F.max(F.when(F.col("slot") == i, F.col("t"))).alias(c) for i, c in enumerate(_columns(width))],
    )
    before = Window.partitionBy("conv_id", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    near = materialize(
        rows.withColumns({f"p{i}": F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)) for i in (1, 2)}), "near"
    )
    earlier = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        near.groupBy("conv_id", "span")
        .agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
        .select("conv_id", "span", F.bit_xor("x1").over(earlier).alias("s1"), F.bit_xor("x2").over(earlier).alias("s2"))
        .where("span > 0")
    )
    return near.join(spans, ["conv_id", "span"], "left").select(
        "conv_id",
        "block",
        *[F.col(f"p{i}").bitwiseXOR(F.coalesce(f"s{i}", F.lit(0))).alias(f"p{i}") for i in (1, 2)],
        "x1",
        "x2",
        "upto",
        *_columns(width),
    )


def _rolled_up(rows: DataFrame, width: int, measures: str) -> DataFrame:
    """One row per node: the block and key before it, the turns of its path within the block (null beyond), ``level`` (how
    many), ``last`` turn, ``depth``, its key ``id1, id2``, and the measures over all rows that begin with it."""
    columns = _columns(width)
    made = rows.sparkSession.sql(
        f"""SELECT block, p1, p2, {", ".join(columns)}, {width} - bit_count(grouping_id()) AS level, {measures}
            FROM {{rows}} GROUP BY block, p1, p2, ROLLUP ({", ".join(columns)})""",
        rows=rows,
    )
    last = F.coalesce(*[F.when(F.col("level") == i, F.col(c)) for i, c in enumerate(columns, 1)])
    depth = F.col("block") * width + F.col("level")
    keys: list[Column] = [F.col("p1"), F.col("p2")]
    for i, c in enumerate(columns, 1):
        keys = [k.bitwiseXOR(F.when(F.col(c).isNull(), 0).otherwise(h)) for k, h in zip(keys, _keys(F.col("block") * width + i, F.col(c)), strict=True)]
    # Levels below the end of a conversation are none; the empty path of a later block is the node before it.
    nodes = made.withColumns({"last": last, "depth": depth}).where("last IS NOT NULL OR (level = 0 AND block = 0)")
    return nodes.withColumns({"id1": keys[0], "id2": keys[1]})


def _below(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """For each node that a later block starts from: ``children`` in it, and the ``leaves`` and ``saved`` tokens of all its
    subtree, later blocks included.

    Sums reach all ancestors by doubling: after k rounds they hold what is less than 2 ** k blocks below. The start of a
    block is looked up by a conversation that passes it, which no other block start of that depth shares.
    """
    sums = materialize(
        nodes.where("block > 0")
        .groupBy("block", "p1", "p2")
        .agg(
            F.count_if(F.col("level") == 1).alias("children"),
            F.sum("leaf").alias("leaves"),
            F.sum("saved").alias("saved"),
            F.min("conv").alias("conv"),
        ),
        "below",
    )
    starts = rows.select(F.col("conv_id").alias("conv"), F.col("block").alias("at"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
    deepest = sums.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    step = 1
    while step < deepest:
        up = (
            sums.where(F.col("block") > step)
            .select("conv", (F.col("block") - step).alias("at"), "leaves", "saved")
            .join(starts, ["conv", "at"])
            .groupBy(F.col("at").alias("block"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
            .agg(F.sum("leaves").alias("more"), F.sum("saved").alias("gain"))
        )
        sums = materialize(
            sums.join(up, ["block", "p1", "p2"], "left").select(
                "block",
                "p1",
                "p2",
                "children",
                (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("gain", F.lit(0))).alias("saved"),
                "conv",
            ),
            "below",
        )
        step *= 2
    return sums.select(F.col("p1").alias("id1"), F.col("p2").alias("id2"), "children", "leaves", F.col("saved").alias("gain"))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, id) to strings of ids that follow each other under one key."""
    for batch in batches:
        id1, id2, ids = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(ids):
            continue
        cuts = np.flatnonzero((id1[1:] != id1[:-1]) | (id2[1:] != id2[:-1])) + 1
        long = np.arange(0, len(ids), _LIST // 16)
        cuts = np.union1d(cuts, long[long > 0]).tolist()
        firsts = [0, *cuts]
        joined = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(firsts, [*cuts, len(ids)], strict=True)]
        columns = [pa.array(c[firsts]) for c in (id1, id2, ids)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(joined)], names=["id1", "id2", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted strings of ids to one hash per key, fed string by string."""
    key, digest = None, None
    for batch in batches:
        done = []
        for id1, id2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (id1, id2) == key:
                digest.update(b",")
            else:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (id1, id2), hashlib.sha256()
            digest.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["id1", "id2", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], names=["id1", "id2", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end at a node, ascending and joined by commas, by the node's key.

    However many end at one node, their ids are sorted in ranges over many tasks, joined there to strings of bounded
    length, and only these strings meet in one task, one after the other.
    """
    bounded_batches(rows.sparkSession)
    last = rows.groupBy("conv_id").agg(F.bit_xor("x1").alias("id1"), F.bit_xor("x2").alias("id2"))
    order = ["id1", "id2", "conv_id"]
    lists = last.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    lists = lists.mapInArrow(_lists, "id1 long, id2 long, first long, ids string")
    met = lists.repartition("id1", "id2").sortWithinPartitions("id1", "id2", "first")
    return met.mapInArrow(_digests, "id1 long, id2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, width: int = WIDTH, span: int = SPAN) -> DataFrame:
    """A row per node of the trie of ``turns`` (see ``ordered_turns``), from the root, the empty path, on: ``conv_id``
    (smallest member), ``depth``, ``parent_conv_id`` (the parent's; null for the root), ``n_convs`` (members),
    ``n_children``, ``n_leaves`` (childless nodes of its subtree, which includes it), ``saved_tokens`` (over its subtree, a
    node's members but one times the words of its last turn) and ``ends_sha256`` (see ``ends``).

    One ROLLUP over the turn columns counts all prefixes of all conversations, a second one over the nodes sums subtrees.
    Longer conversations go on in further blocks of columns, keyed by the node before the block; all blocks are rows of
    the same two aggregates, and only the sums of whole blocks are handed up, in a number of rounds that grows with the
    logarithm of the longest conversation. Equal turns are told by 128 bits. No conversations: no nodes, not even a root.
    Conversations without turns (a row with null ``pos``) are members of the root.
    """
    rows = materialize(blocks(turns, width, span), "blocks")
    saved = F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("last.words")).otherwise(0)
    nodes = materialize(
        _rolled_up(rows, width, "min(conv_id) AS conv, count(1) AS n_convs, max(upto) AS upto")
        .withColumns({"leaf": (F.col("upto") == F.col("depth")).cast("long"), "saved": saved})
        .drop("last", "upto"),
        "nodes",
    )
    full = F.when(F.col("level") == width, F.col("id1")), F.when(F.col("level") == width, F.col("id2"))
    on = _below(nodes, rows)
    whole = (
        nodes.withColumns({"f1": full[0], "f2": full[1]})
        .drop("id1", "id2", "depth")
        .join(on, (F.col("f1") == F.col("id1")) & (F.col("f2") == F.col("id2")), "left")
        .select(
            "block", "p1", "p2", *_columns(width), F.col("level").alias("own"), "conv", "n_convs",
            (F.col("leaf") + F.coalesce("leaves", F.lit(0))).alias("leaf"),
            (F.col("saved") + F.coalesce("gain", F.lit(0))).alias("saved"),
            F.coalesce("children", F.lit(0)).alias("children"),
        )
    )
    counts = ", ".join(f"count_if(own = {i}) AS c{i}" for i in range(1, width + 1))
    summed = _rolled_up(
        whole,
        width,
        "min(conv) AS conv, max(n_convs) AS n_convs, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens, "
        f"max(struct(own, children)).children AS onward, {counts}",
    )
    h1, h2 = _keys(F.col("depth"), F.col("last"))
    children = F.coalesce(*[F.when(F.col("level") == i - 1, F.col(f"c{i}")) for i in range(1, width + 1)], F.col("onward"))
    trie = materialize(
        summed.select(
            "id1", "id2",
            F.when(F.col("depth") > 0, F.col("id1").bitwiseXOR(h1)).alias("up1"),
            F.when(F.col("depth") > 0, F.col("id2").bitwiseXOR(h2)).alias("up2"),
            F.col("conv").alias("conv_id"), "depth", "n_convs", children.alias("n_children"), "n_leaves", "saved_tokens",
        ).join(ends(rows), ["id1", "id2"], "left"),
        "trie",
    )
    above = trie.select(F.col("id1").alias("up1"), F.col("id2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    none = F.sha2(F.lit(b""), 256)
    return trie.join(above, ["up1", "up2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
