"""Training-data pipeline over ``documents``: filter, deduplicate, decontaminate, encode.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a table that is written and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import bpe, decontaminate, line_dedup, quality_rules, simhash
from spendlens.llm.common import packed, read_table, unpacked
from spendlens.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base limits nor the learned rules reject.

    Null, empty and blank texts have no words and fail the base limits. Repeated rows are judged alike, each by itself;
    an empty table stays empty. Columns keep their names and values, whatever they are called.
    """
    rules = quality_rules.learn_rules(docs, read_table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, rules)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that ten or more documents share; ``n_chars`` follows the text.

    Every row stays, a null text as null, an empty one as empty, and a text all of whose lines are shared becomes empty.
    Repeated rows of one id count as one document and lose the same lines. Of the other columns none changes; a table
    without ``n_chars`` does not get it.
    """
    shorter = line_dedup.drop_shared_lines(docs)
    if "n_chars" in docs.columns:
        shorter = shorter.withColumn("n_chars", F.char_length("text").cast("long"))
    return shorter.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links: four-word shingles, prints within four bits.

    Null, empty and blank texts share print zero, so one of them stays. Of repeated rows one stays; of rows with equal
    id and text that differ elsewhere, the first by a hash of the row. An empty table stays empty.
    """
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold no passage and stay; repeated rows are judged alike. An empty benchmark removes nothing.
    """
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


#: The columns that the last stage puts in place of the text.
TOKEN_COLUMNS = ("n_tokens", "token_ids", "round_trip")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text, checked against it: ``round_trip`` says that they decode to the same bytes.

    A null text is like an empty one: no tokens. Rows are encoded one by one, so ties and repeated rows stay as they are.
    Columns of the names in TOKEN_COLUMNS are replaced; every other column passes unchanged, ``decoded`` too.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    aside = ("text", *TOKEN_COLUMNS)
    rows = docs.select(packed(docs, *aside), F.col("text").alias("_text"))
    coded = bpe.encode_documents(rows, path, public_tokenizers.PATTERN, "_text")
    return coded.select(
        *unpacked(docs, *aside),
        "n_tokens",
        "token_ids",
        (F.col("decoded") == F.coalesce(F.col("_text"), F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

#: The rules of the first stage are learned, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
