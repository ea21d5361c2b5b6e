"""Word windows that a corpus holds more than once, found around content-selected anchors.

Every window of ``width`` words is owned by one anchor: the smallest hash among its runs of ANCHOR words. Equal windows
have equal anchors, so a window can only repeat among the occurrences of its anchor; most anchors occur once and are
done with after one count. The words around an anchor that its windows span are its context. Contexts are compared only
where an anchor occurs in different ones; how is up to the operator that asks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import KEY, bounded_batches, let, text_key
from spendlens.llm.words import FACTOR, INVERSE, Words, mix, power_table, spread, window_minima, windows
from spendlens.session import materialize

_U = np.uint64

#: Words of an anchor.
ANCHOR = 8
#: Different contexts of one anchor that are compared in one task; of anchors with more, windows are counted instead.
MOST_CONTEXTS = 400

#: Gets contexts (arrays of word hashes) of one anchor, and how often each occurs; yields (context, first, last + 1) for
#: ranges of window starts that occur more than once.
Compare = Callable[[list[np.ndarray], list[int], list[int], int], Iterator[tuple[int, int, int]]]


def _anchors(width: int):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_k1", "_k2", "_id", "start", "owned", "at", "gram", "context"]
        for batch in batches:
            words = Words(batch.column(3))
            h, n = words.hashes, len(words.hashes)
            if n < width:
                continue
            row = np.repeat(np.arange(batch.num_rows), np.diff(words.rows))
            starts = np.flatnonzero(row[: n - width + 1] == row[width - 1 :])
            if not len(starts):
                continue
            grams = windows(h, ANCHOR)
            best = window_minima(grams, width - ANCHOR + 1)[starts]
            new = np.ones(len(starts), bool)
            new[1:] = (best[1:] != best[:-1]) | (starts[1:] != starts[:-1] + 1)
            run = np.flatnonzero(new)
            first, owned, at = starts[run], np.diff(np.append(run, len(starts))), best[run]
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(h * power_table(FACTOR, n)[:n], out=sums[1:])
            length = owned + width - 1
            body = mix((sums[first + length] - sums[first]) * power_table(INVERSE, n)[first])
            context = mix(body ^ mix((length.astype(np.uint64) << _U(32)) + (at - first).astype(np.uint64)))
            of = row[first]
            taken = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(taken) for i in range(3)]
                + [
                    pa.array((first - words.rows[of]).astype(np.int32)),
                    pa.array(owned.astype(np.int32)),
                    pa.array((at - first).astype(np.int32)),
                    pa.array(grams[at].view(np.int64)),
                    pa.array(context.view(np.int64)),
                ],
                names=names,
            )

    return anchors


def _context_words(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Word hashes of the asked contexts: column 0 has the text, column 1 the list of contexts in it."""
        for batch in batches:
            words = Words(batch.column(0))
            asked = batch.column(1)
            of, flat = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy()), asked.flatten()
            start, owned = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("start", "owned"))
            first = words.rows[of] + start
            last = first + owned + width - 1
            packed = [words.hashes[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [flat.field(x) for x in ("gram", "context", "times", "at", "crowded")] + [pa.array(packed, pa.binary())],
                names=["gram", "context", "times", "at", "crowded", "words"],
            )

    return cut


def _compared(width: int, compare: Compare):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by gram; an anchor has MOST_CONTEXTS different contexts at most."""
        now, held, out = None, {}, []

        def finish() -> None:
            names, rows = list(held), list(held.values())
            bodies = [np.frombuffer(r[2], np.uint64) for r in rows]
            for i, a, b in compare(bodies, [r[0] for r in rows], [r[1] for r in rows], width):
                out.append((now, names[i], a, b))

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            made = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, names=["gram", "context", "a", "b"])

        for batch in batches:
            for gram, context, times, at, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if gram != now:
                    if len(held) > 1:
                        finish()
                    now, held = gram, {}
                held[context] = (times, at, words)
            yield flush()
        if len(held) > 1:
            finish()
        yield flush()

    return run


def _counted(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two hashes of all windows of the contexts, both made of the 64-bit hashes of their words."""
        salt = spread(1, 99)[0]
        for batch in batches:
            gram, context, times, words = (batch.column(i) for i in (0, 1, 2, 4))
            bodies = [np.frombuffer(x, np.uint64) for x in words.to_pylist()]
            each = np.array([len(x) - width + 1 for x in bodies])
            of = pa.array(np.repeat(np.arange(len(bodies)), each))
            one, two = (
                np.concatenate([windows(x if s is None else mix(x + s), width) for x in bodies] or [np.empty(0, np.uint64)])
                for s in (None, salt)
            )
            offset = np.concatenate([np.arange(n) for n in each] or [np.empty(0, np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [gram.take(of), context.take(of), times.take(of), pa.array(offset)]
                + [pa.array(x.view(np.int64)) for x in (one, two)],
                names=["gram", "context", "times", "a", "w1", "w2"],
            )

    return run


def repeated_spans(docs: DataFrame, doc_id: str, text: str, width: int, compare: Compare) -> DataFrame:
    """Maximal spans of words that repeated windows cover: key of the text, ``start``, ``end`` (exclusive), disjoint.

    A window repeats if its words start at another place as well, in the same or another document. Every shuffle is of
    rows per anchor, of which there are about two per ``width - ANCHOR`` words; texts of documents with undecided
    contexts move once. Anchors and contexts are counted by partial aggregates and joined back in plans that may split
    a frequent one, so that a passage in a third of all documents is no single task's work.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(*text_key(F.col(text)), F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    id_type = own.schema["_id"].dataType.simpleString()
    anchors = materialize(
        own.mapInArrow(
            _anchors(width),
            f"_k1 long, _k2 long, _id {id_type}, start int, owned int, at int, gram long, context long",
        ),
        "anchors",
    )
    again = materialize(
        anchors.groupBy("gram")
        .agg(F.count(F.lit(1)).alias("n"), (F.min("context") == F.max("context")).alias("same"))
        .where("n > 1")
        .select("gram", "same"),
        "repeated-anchors",
    )
    found = materialize(anchors.join(again, "gram"), "repeated")
    mixed = found.where("not same")
    contexts = materialize(
        mixed.groupBy("gram", "context").agg(
            F.count(F.lit(1)).alias("times"), F.min(F.struct("_k1", "_k2", "_id", "start", "owned", "at")).alias("one")
        ),
        "contexts",
    )
    # stored, so that the join may split an anchor with very many contexts
    crowded = materialize(
        contexts.groupBy("gram").agg((F.count(F.lit(1)) > MOST_CONTEXTS).alias("crowded")), "crowded-anchors"
    )
    asked = (
        contexts.join(crowded, "gram")
        .select("gram", "context", "times", "crowded", "one.*")
        .groupBy("_k1", "_k2", "_id")
        .agg(F.collect_list(F.struct("gram", "context", "times", "crowded", "start", "owned", "at")).alias("_asked"))
    )
    same_row = (
        (F.col("d._k1") == F.col("q._k1")) & (F.col("d._k2") == F.col("q._k2")) & F.col("d._id").eqNullSafe(F.col("q._id"))
    )
    bodies = materialize(
        own.alias("d")
        .join(asked.alias("q"), same_row)
        .select("_text", "_asked")
        .mapInArrow(
            _context_words(width), "gram long, context long, times long, at int, crowded boolean, words binary"
        ),
        "context-words",
    )
    columns = ["gram", "context", "times", "at", "words"]
    ranges = (
        bodies.where("not crowded")
        .select(*columns)
        .repartition(F.col("gram"))
        .sortWithinPartitions("gram")
        .mapInArrow(_compared(width, compare), "gram long, context long, a int, b int")
    )
    counted = materialize(
        bodies.where("crowded")
        .dropDuplicates(["gram", "context"])
        .select(*columns)
        .mapInArrow(_counted(width), "gram long, context long, times long, a int, w1 long, w2 long"),
        "windows",
    )
    often = counted.groupBy("w1", "w2").agg(F.sum("times").alias("n")).where("n > 1")
    ranges = ranges.unionByName(
        counted.join(often, ["w1", "w2"], "left_semi").select("gram", "context", "a", (F.col("a") + 1).alias("b"))
    )
    repeated = contexts.where("times > 1").select("gram", "context", F.lit(0).alias("a"), F.col("one.owned").alias("b"))
    single = materialize(ranges.unionByName(repeated).distinct(), "ranges")
    spans = found.where("same").select(
        *KEY, "start", (F.col("start") + F.col("owned") + (width - 1)).alias("end")
    ).unionByName(
        mixed.join(single, ["gram", "context"]).select(
            *KEY, (F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("b") + (width - 1)).alias("end")
        )
    )
    return materialize(_merged(spans.distinct()), "spans")


def _merged(spans: DataFrame) -> DataFrame:
    """Unions of the overlapping and adjoining spans of a text; a text has no more spans than words."""
    order = Window.partitionBy(*KEY).orderBy("start", "end")
    upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("start") > upto).cast("int"), F.lit(1))
    return (
        spans.withColumn("_begins", begins)
        .withColumn("_run", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*KEY, "_run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .select(*KEY, "start", "end")
    )


def spans_by_text(spans: DataFrame) -> DataFrame:
    return spans.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def outside(words: Column, spans: Column) -> Column:
    """The words before, between and after sorted disjoint spans, each copied once."""
    def pieces(x: Column) -> Column:
        w, s = x["w"], x["s"]
        n = F.size(s)
        return F.flatten(
            F.transform(
                F.sequence(F.lit(0), n),
                lambda j: F.slice(
                    w,
                    F.when(j == 0, 0).otherwise(s[F.greatest(j - 1, F.lit(0))]["end"]) + 1,
                    F.when(j == n, F.size(w)).otherwise(s[F.least(j, n - 1)]["start"])
                    - F.when(j == 0, 0).otherwise(s[F.greatest(j - 1, F.lit(0))]["end"]),
                ),
            )
        )

    return let(F.struct(words.alias("w"), spans.alias("s")), pieces)
