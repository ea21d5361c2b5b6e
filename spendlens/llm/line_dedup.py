"""Line dedup: lines that many documents share are dropped everywhere, the rest is reassembled by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import BLANKS, KEY, ascii_lower, let, packed, text_key, unpacked
from spendlens.session import materialize


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_keys(text: Column) -> Column:
    return F.transform(_lines(ascii_lower(text)), lambda line: F.btrim(line, F.lit(BLANKS)))


def _hashes(key: str) -> list[Column]:
    """128 bits per line key: at any corpus size two different lines do not meet by chance."""
    return [F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit("line"), key).alias("_h2")]


def shared_lines(docs: DataFrame, text: str, min_chars: int, min_docs: int) -> DataFrame:
    """Hashes of the line keys that at least ``min_docs`` documents hold; a document counts once per key."""
    return (
        docs.select(F.explode(F.array_distinct(_line_keys(F.col(text)))).alias("_key"))
        .where(F.char_length("_key") >= min_chars)
        .select(*_hashes("_key"))
        .groupBy("_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= min_docs)
        .select("_h1", "_h2")
    )


def _without(lines: Column, dropped: Column) -> Column:
    """The lines between the sorted dropped positions, each copied once."""

    def pieces(parts: Column) -> Column:
        kept, bounds = parts["lines"], parts["bounds"]
        return F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.size(bounds) - 2),
                lambda j: F.slice(kept, bounds[j] + 2, bounds[j + 1] - bounds[j] - 1),
            )
        )

    bounds = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))
    return let(F.struct(lines.alias("lines"), bounds.alias("bounds")), pieces)


def drop_shared_lines(docs: DataFrame, text: str = "text", min_chars: int = 1, min_docs: int = 10) -> DataFrame:
    """Documents with the lines gone whose key at least ``min_docs`` documents hold.

    All columns stay; ``text`` holds the kept lines joined by line feeds, ``n_lines`` and ``n_dropped`` are added
    (columns of these names are replaced). A key is the line without blanks at both ends and with A-Z lower-cased; keys
    under ``min_chars`` code points are never dropped. A null or empty text is one empty line and stays as it is if
    nothing is dropped. Each row is a document, also if its id or text is repeated or null. If every line goes, the
    text is empty. An empty table gives an empty table.

    Texts move at most once: counting sends 16 bytes per line, the positions to drop are gathered per distinct text.
    """
    shared = materialize(shared_lines(docs, text, min_chars, min_docs), "shared-lines")
    positions = (
        docs.select(*text_key(F.col(text)), F.posexplode(_line_keys(F.col(text))).alias("_pos", "_key"))
        .where(F.char_length("_key") >= min_chars)
        .select(*KEY, "_pos", *_hashes("_key"))
        .join(shared, ["_h1", "_h2"], "left_semi")
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_set("_pos")).alias("_dropped"))
    )
    positions = materialize(positions, "dropped-lines")  # the join below may then split a text with many copies
    own = ("n_lines", "n_dropped")
    lines = _lines(F.col("_text"))
    kept = F.when(F.col("_dropped").isNull(), F.col("_text")).otherwise(
        F.concat_ws("\n", _without(lines, F.col("_dropped")))
    )
    return (
        docs.select(packed(docs, *own, text), F.col(text).alias("_text"), *text_key(F.col(text)))
        .join(positions, KEY, "left")
        .select(
            *unpacked(docs, *own, **{text: kept}),
            F.size(lines).cast("long").alias("n_lines"),
            F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        )
    )
