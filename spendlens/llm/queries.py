"""The named queries of this package, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import (
    bloom_lm, bpe, decontaminate, hard_negatives, line_dedup, packing, prefix_trie, quality_rules, sharding, simhash,
    substring_dedup, suffix_dedup, toxicity,
)
from spendlens.llm.common import read_table


RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.groups(docs).select(
        F.col("_id").alias("doc_id"), simhash.as_hex(F.col("_print")).alias("fingerprint"), "component_id"
    )


def op3_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    away = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    model, words = bloom_lm.train(docs.where(~away))
    return bloom_lm.score(docs.withColumn("held_out", away), model, words)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark_contaminated(docs, read_table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


def op5_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.repeated_passages(docs)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn_rules(docs, read_table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_by_bytes(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def op9_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_shared_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(read_table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.grafted(turns))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    made = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.place(made.withColumn("ids_crc32", F.crc32("token_ids")).drop("token_ids"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_simhash": op2_simhash,
    "op3_bloom_lm": op3_bloom_lm,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_arrays": op5_suffix_arrays,
    "op6_quality_rules": op6_quality_rules,
    "op7_sharding": op7_sharding,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_automata": op9_suffix_automata,
    "op10_line_dedup": op10_line_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_best_fit_packing": op13_best_fit_packing,
}

ORACLES = {
    "op4_decontamination": """
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM documents
        ), b AS (
            SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM benchmark
        ), w AS (
            SELECT DISTINCT item_id, least(10, len(words)) AS n, list_slice(words, i, i + 9) AS win
            FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i
                  FROM b WHERE len(words) > 0)
        ), lens AS (SELECT DISTINCT n FROM w
        ), p AS (
            SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
            FROM d, lens WHERE len(words) >= n
        ), h AS (
            SELECT p.doc_id, p.i, p.n, w.item_id FROM p JOIN w ON w.n = p.n AND list_slice(words, i, i + p.n - 1) = w.win
        ), hit AS (
            SELECT doc_id, count(DISTINCT k) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id
        ), ids AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
    """,
    "op9_suffix_automata": """
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                                       lambda w: w <> '') AS words FROM documents
        ), w AS (
            SELECT doc_id, i, array_to_string(list_slice(words, i, i + 34), ' ') AS win
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35)
        ), again AS (SELECT win FROM w GROUP BY win HAVING count(*) > 1
        ), gone AS (
            SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(range(i, i + 35)) AS k FROM w JOIN again USING (win))
        ), each AS (
            SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM d
        ), marked AS (
            SELECT each.doc_id, each.k, word, gone.k IS NOT NULL AS gone
            FROM each LEFT JOIN gone ON each.doc_id = gone.doc_id AND each.k = gone.k
        ), kept AS (
            SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
                   string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT gone) AS kept
            FROM marked GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
    """,
    "op10_line_dedup": """
        WITH l AS (
            SELECT doc_id, line, pos,
                   translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
                  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
        ), shared AS (
            SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
        )
        SELECT doc_id, count(*) AS n_lines, count(shared.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE shared.key IS NULL), ''))
                   AS kept_sha256
        FROM l LEFT JOIN shared ON l.key = shared.key GROUP BY doc_id
    """,
    "op11_prefix_trie": """
        WITH own AS (
            SELECT conv_id, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST, role, text) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), h AS (
            SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295,
                list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                         lambda v, _: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 4 AS h
            FROM own
        ), p AS (
            SELECT h.conv_id, list_concat(list_slice(coalesce(giver.turns, []), 1, h), list_slice(h.turns, h + 1, len(h.turns)))
                AS path FROM h LEFT JOIN own AS giver ON giver.conv_id = h.conv_id - h.conv_id % 20
        ), n AS (
            SELECT list_slice(path, 1, depth) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                                   FILTER (WHERE depth = len(path)), '')) AS ends_sha256
            FROM (SELECT *, unnest(range(0, len(path) + 1)) AS depth FROM p) GROUP BY ALL
        ), m AS (
            SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(list_filter(
                regexp_split_to_array(node[depth][2], '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) END AS saved
            FROM n LEFT JOIN (SELECT list_slice(node, 1, depth - 1) AS node, count(*) AS n_children FROM n
                              WHERE depth > 0 GROUP BY 1) AS c USING (node)
        ), below AS (
            SELECT list_slice(node, 1, up) AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
            FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM m) GROUP BY 1
        )
        SELECT m.conv_id, m.depth, parent.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves,
               CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
        FROM m JOIN below USING (node) LEFT JOIN n AS parent ON m.depth > 0 AND parent.node = list_slice(m.node, 1, m.depth - 1)
    """,
    "op12_hard_negatives": """
        WITH r AS (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM r AS a JOIN r AS b ON a.id % 100 = 0 AND a.id <> b.id
        ), p AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score
            FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
        )
        SELECT anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank,
               id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10
    """,
}
