"""Benchmark decontamination by a prefix-filtered join of word windows with exact verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import KEY, ascii_lower, let, packed, text_key, unpacked
from spendlens.session import materialize

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # ASCII other than digits and lower-case letters

#: Windows whose prefix tokens are broadcast together: about 50 MB. A larger benchmark is joined in several passes.
WINDOWS_PER_PASS = 200_000


def item_words(text: Column) -> Column:
    """Words of A-Z-lower-cased text: runs of digits, letters and non-ASCII characters. Null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP), lambda w: w != "")


def item_windows(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """Distinct (window, item) pairs: each run of ``width`` words, or all words of a shorter item."""
    words = items.select(F.col(item_id).alias("_item"), item_words(F.col(text)).alias("_words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - width + 1, F.lit(1)))
    windows = let(
        F.col("_words"),
        lambda w: F.transform(starts, lambda i: F.slice(w, i, width)),
    )
    return (
        words.where(F.size("_words") > 0)
        .select("_item", F.explode(windows).alias("_window"))
        .distinct()
    )


def _prefixes(windows: DataFrame, docs_words: DataFrame) -> DataFrame:
    """For each window its rarest word in the documents: a document that holds the window holds that word.

    Only windows all of whose words occur are kept. Whole containment is asked for, so one prefix token is enough.
    """
    each = windows.select("_window", F.posexplode("_window").alias("_offset", "_word"))
    vocabulary = each.select("_word").distinct()
    frequency = (
        docs_words.select(F.explode("_words").alias("_word"))
        .join(F.broadcast(vocabulary), "_word", "left_semi")
        .groupBy("_word")
        .agg(F.count(F.lit(1)).alias("_freq"))
    )
    return (
        each.join(frequency, "_word", "left")
        .groupBy("_window")
        .agg(F.min(F.struct(F.coalesce("_freq", F.lit(0)).alias("f"), "_word", "_offset")).alias("_rarest"))
        .where(F.col("_rarest.f") > 0)
        .select("_window", F.col("_rarest._word").alias("_word"), F.col("_rarest._offset").alias("_offset"))
    )


def _covered(spans: Column) -> Column:
    """Words inside the union of the sorted spans (start, end)."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(
        spans,
        start,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["end"] - F.greatest(acc["upto"], s["start"]), F.lit(0))).cast("long").alias("n"),
            F.greatest(acc["upto"], s["end"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )


def benchmark_hits(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    windows_per_pass: int = WINDOWS_PER_PASS,
) -> DataFrame:
    """What of the benchmark each distinct text holds: key of the text, ``n_words``, ``spans`` (sorted, start and end of
    each occurrence of a window), ``n_hit``, ``items`` (sorted ids as strings).

    Words are matched by a broadcast of the windows' rarest words only, inside the scan of the documents; positional
    and length bounds and the comparison of all words follow in the same stage, so only true occurrences are shuffled.
    Benchmarks over ``windows_per_pass`` windows are joined in blocks, each of bounded size.
    """
    pairs = materialize(item_windows(items, item_id, item_text, width), "item-windows")
    windows = pairs.select("_window").distinct()
    words = docs.select(*text_key(F.col(text)), item_words(F.col(text)).alias("_words"))
    passes = max(1, -(-pairs.count() // windows_per_pass))

    found = None
    for block in range(passes):
        part = windows.where(F.pmod(F.xxhash64("_window"), F.lit(passes)) == block)
        prefixes = materialize(_prefixes(part, words), "prefixes")
        start = F.col("_pos") - F.col("_offset")
        length = F.size("_window")
        fits = (start >= 0) & (start + length <= F.size("_words"))
        same = F.when(fits, F.slice("_words", start + 1, length) == F.col("_window")).otherwise(F.lit(False))
        joined = (
            words.select(*KEY, "_words", F.posexplode_outer("_words").alias("_pos", "_word"))
            .join(F.broadcast(prefixes), "_word", "left")
            .withColumn("_hit", F.col("_window").isNotNull() & same)
            .where(F.col("_hit") | F.coalesce(F.col("_pos") == 0, F.lit(True)))  # each text keeps a row
            .select(
                *KEY,
                F.size("_words").alias("_n"),
                F.when(F.col("_hit"), F.struct(start.alias("start"), (start + length).alias("end"))).alias("_span"),
                F.when(F.col("_hit"), F.col("_window")).alias("_window"),
            )
        )
        found = joined if found is None else found.unionByName(joined)
    texts = materialize(
        found.groupBy(*KEY).agg(
            F.max("_n").cast("long").alias("n_words"),
            F.sort_array(F.collect_set("_span")).alias("spans"),
            F.collect_set("_window").alias("_windows"),
        ),
        "hits",
    )
    ids = (
        texts.select(*KEY, F.explode("_windows").alias("_window"))
        .join(pairs, "_window")
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_set(F.col("_item").cast("string"))).alias("items"))
    )
    found = texts.join(ids, KEY, "left").select(
        *KEY,
        "n_words",
        "spans",
        _covered(F.col("spans")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    return materialize(found, "benchmark-hits")  # a join with the documents may then split a text with many copies


def mark_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """Documents with ``n_words``, ``n_hit`` (words inside occurrences of windows), ``items``, ``contaminated`` and
    ``spans``; columns of these names are replaced, all others stay.

    A null text and one without words have no words and no hits; items without words match nothing. Repeated documents
    each get their row, repeated items count once; an item without an id makes hits but is not listed. Empty tables of
    documents or items give no rows, or rows without hits.
    """
    added = ("n_words", "n_hit", "items", "contaminated", "spans")
    hits = benchmark_hits(docs, items, text, **options)
    return (
        docs.select(packed(docs, *added), *text_key(F.col(text)))
        .join(hits, KEY, "left")
        .select(*unpacked(docs, *added), *added[:3], (F.col("n_hit") > 0).alias("contaminated"), "spans")
    )


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """Documents that hold no window of the benchmark, with their own columns."""
    hits = benchmark_hits(docs, items, text, **options).where(F.col("n_hit") > 0).select(*KEY)
    return docs.select(packed(docs), *text_key(F.col(text))).join(hits, KEY, "left_anti").select(*unpacked(docs))
