"""Each operator against its plain version, on a table of the small scale and on odd rows; and on empty tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spendlens.llm import (
    bloom_lm, bpe, components, decontaminate, line_dedup, quality_rules, repeats, sharding, simhash, substring_dedup,
    suffix_dedup, toxicity,
)
from spendlens.llm.common import KEY, read_table, text_key
from spendlens.llm.words import CHUNK, Words, window_minima, windows
from tests.llm import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def both(small, edges):
    return (rows_of(small, "doc_id", "text"), small), (rows_of(edges, "doc_id", "text"), edges)


def same_extras(docs, made, *replaced):
    """Columns the operator does not own keep their names, order and values."""
    kept = [c for c in docs.columns if c not in replaced]
    assert [c for c in made.columns if c in kept] == kept


# byte-level BPE


def test_bpe_equals_the_library(small, edges):
    encoding = bpe._encoding(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    for rows, docs in both(small, edges):
        made = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
        same_extras(docs, made)
        want = Counter((i, np.array(encoding.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
        assert Counter((a, bytes(b), bytes(c)) for a, b, c in rows_of(made, "doc_id", "token_ids", "decoded")) == want


def test_bpe_pieces_do_not_change_ids():
    encoding = bpe._encoding(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    random.seed(5)
    for _ in range(400):
        text = "".join(random.choices(["a", "Z", "7", "'s", "'", "\n", " ", "  ", "\t", "é", "　", "\x1c", "!", "\U0001f600"], k=60))
        want = np.array(encoding.encode_ordinary(text), "<u4").tobytes()
        for chars in (1, 7, 30):
            assert "".join(bpe.pieces(text, chars)) == text
            assert bpe.encode_text(encoding, text, chars) == want


def test_bpe_decodes_partial_characters(spark):
    codec = bpe.ByteBpe(spark, RANKS, public_tokenizers.PATTERN)
    cut = spark.createDataFrame([("\U0001f600é",)], "t string").select(codec.encode(F.col("t")).alias("ids"))
    first = cut.select(F.expr("substring(ids, 1, 4)").alias("ids")).select(codec.decode(F.col("ids"))).first()[0]
    assert "\U0001f600é".encode().startswith(bytes(first)) and first


# SimHash


def test_simhash_groups(small, edges):
    for rows, docs in both(small, edges):
        prints = [brute.fingerprint(t) for _, t in rows]
        root = brute.linked(prints)
        least = {}
        for (i, _), p in zip(rows, prints, strict=True):
            if i is not None:
                least[root[p]] = min(i, least.get(root[p], i))
        want = Counter((i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(rows, prints, strict=True))
        made = simhash.groups(docs).select("_id", simhash.as_hex(F.col("_print")), "component_id")
        assert Counter(map(tuple, made.collect())) == want
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns
        assert Counter(root[brute.fingerprint(t)] for _, t in rows_of(kept, "doc_id", "text")) == Counter(set(root.values()))


@pytest.mark.parametrize("tile", [8, 256])
def test_simhash_links_lose_nothing(spark, tile):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    values = {int(b) for b in base}
    for b in [*base, *[base[0]] * 150]:
        x = int(b)
        for k in rng.integers(0, 64, rng.integers(1, 6)):
            x ^= 1 << int(k)
        values.add(x)
    prints = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "_print long")
    roots = {r.node: r.root for r in components.components(simhash.near_links(prints, tile=tile)).collect()}
    groups = Counter()
    for v in values:
        node = int(np.uint64(v).astype(np.int64))
        groups[roots.get(node, node)] += 1
    assert sorted(groups.values()) == sorted(Counter(brute.linked(values).values()).values())


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 70)] + [(5, 5), (100, 101), (101, 100)], "a long, b long")
    roots = {r.node: r.root for r in components.components(links).collect()}
    assert roots == {**{i: 1 for i in range(2, 71)}, 101: 100}


# LM scoring


def test_lm_counts_and_scores(small, edges):
    for rows, docs in both(small, edges):
        away = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
        for frequent in (1 << 20, 50):  # with and without rare words
            model, words = bloom_lm.train(docs.where(~away), bits=1 << 22, frequent=frequent)
            made = bloom_lm.score(docs, model, words)
            same_extras(docs, made, "text", "score")
            got = sorted(rows_of(made, "n_tokens", "n_known", "train_tokens", "base_score"))
            want = sorted(brute.base_scores(rows))
            assert [g[:3] for g in got] == [w[:3] for w in want]
            assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-9)
            assert all(s < 0 for (s,) in rows_of(made, "score"))


def test_lm_is_better_than_word_counts_on_held_out_texts(small):
    away = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    model, words = bloom_lm.train(small.where(~away), bits=1 << 24)
    made = bloom_lm.score(small.where(away), model, words).agg(F.sum("score"), F.sum("base_score")).first()
    assert made[0] > made[1]


def test_filter_never_understates(spark):
    rng = np.random.default_rng(3)
    grams, counts = rng.integers(0, 2**64, 3000, dtype=np.uint64), rng.integers(1, 5000, 3000)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(bloom_lm._blocks(grams).astype(np.int32)), pa.array(grams.view(np.int64)), pa.array(counts)],
        names=["block", "gram", "n"],
    )
    bits = 1 << 20
    flags = np.zeros(bits // 8, np.uint8)
    batch = batch.sort_by("block")
    for made in bloom_lm._insert(bits // bloom_lm.BLOCKS)(iter([batch.slice(0, 1000), batch.slice(1000)])):
        for block, part in zip(*(c.to_pylist() for c in made.columns), strict=True):
            width = bits // bloom_lm.BLOCKS // 8
            flags[block * width : (block + 1) * width] = np.frombuffer(part, np.uint8)
    held = bloom_lm.LogFrequencyFilter(flags)
    exact, got = bloom_lm.level(counts), held.levels(grams)
    assert (got >= exact).all() and (got == exact).mean() > 0.95
    assert (held.levels(rng.integers(0, 2**64, 3000, dtype=np.uint64)) > 0).mean() < 0.05


# decontamination

ITEMS = [(1, "a b c d e f g h i j k l"), (2, "One"), (2, "One"), (None, "w0 w2916 w829"), (4, None), (5, ""), (6, "É SSI")]


def test_contamination(spark, small, edges):
    odd = spark.createDataFrame(ITEMS, "item_id long, text string")
    tables = ((rows_of(small, "doc_id", "text"), small, read_table(spark, SF, "benchmark")), (rows_of(edges, "doc_id", "text"), edges, odd))
    for rows, docs, items in tables:
        want = brute.contamination([t for _, t in rows], rows_of(items, "item_id", "text"))
        expected = Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))
        for per_pass in (decontaminate.WINDOWS_PER_PASS, 3 if docs is edges else 1000):
            made = decontaminate.mark_contaminated(docs, items, windows_per_pass=per_pass)
            same_extras(docs, made, "n_words", "spans")
            ids = F.col("items")
            columns = ("doc_id", "n_words", "n_hit", F.size(ids), F.sha2(F.concat_ws(",", ids), 256), "contaminated")
            assert Counter(rows_of(made, *columns)) == expected
        clean = decontaminate.decontaminate(docs, items)
        assert clean.columns == docs.columns
        assert Counter(rows_of(clean, "doc_id")) == Counter((i,) for (i, _), w in zip(rows, want, strict=True) if not w[-1])


# repeated windows


@pytest.mark.parametrize("most_contexts", [1, 400])
@pytest.mark.parametrize("compare", [suffix_dedup.by_suffixes, substring_dedup.by_automaton])
def test_repeated_spans(spark, monkeypatch, compare, most_contexts):
    monkeypatch.setattr(repeats, "MOST_CONTEXTS", most_contexts)
    random.seed(3)
    base, texts = [random.choice([f"w{i}" for i in range(40)]) for _ in range(300)], []
    for _ in range(60):
        words = [f"u{random.randrange(2000)}" for _ in range(random.randint(0, 60))]
        for _ in range(random.randint(0, 3)):
            at = random.randint(0, 280)
            part = base[at : at + random.randint(5, 120)]
            if random.random() < 0.4:
                part[random.randrange(len(part))] = f"Z{random.randint(0, 3)}"
            words += part + [random.choice("abc")] * random.randint(0, 50)
        texts.append(" ".join(words))
    texts += [None, "", texts[5], "x " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = docs.select("doc_id", *text_key(docs.text)).join(repeats.repeated_spans(docs, "doc_id", "text", 14, compare), KEY)
    want = {(i, a, b) for i, (_, hit) in enumerate(brute.covered(texts, 14)) for a, b in runs_of(hit)}
    assert set(rows_of(spans, "doc_id", "start", "end")) == want


def runs_of(hit):
    return brute.runs(hit) if hit else []


def test_passages_and_removal(small, edges):
    for rows, docs in both(small, edges):
        found = brute.covered([t for _, t in rows], 50)
        want = Counter((i, a, b) for (i, _), (_, hit) in zip(rows, found, strict=True) for a, b in runs_of(hit))
        made = suffix_dedup.repeated_passages(docs)
        same_extras(docs, made, "text")
        assert Counter(rows_of(made, "doc_id", "start_word", "end_word")) == want
        found = brute.covered([t for _, t in rows], 35)
        want = Counter(
            (i, len(w), sum(hit), " ".join(x for x, h in zip(w, hit, strict=True) if not h))
            for (i, _), (w, hit) in zip(rows, found, strict=True)
        )
        made = substring_dedup.remove_repeats(docs)
        same_extras(docs, made, "n_words", "spans")
        assert Counter(rows_of(made, "doc_id", "n_words", "n_removed", "text")) == want


# quality rules


def test_statistics(small, edges):
    for rows, docs in both(small, edges):
        made = quality_rules.judge(docs, [])
        same_extras(docs, made, "n_words")
        want = Counter((i, *brute.counts(t)) for i, t in rows)
        assert Counter(rows_of(made, "doc_id", *quality_rules.COUNTS, "base_failed")) == want
        kept = quality_rules.keep_good(docs, [])
        assert kept.columns == docs.columns and kept.count() == sum(not brute.counts(t)[-1] for _, t in rows)


def test_rules_tell_held_out_labels(spark):
    docs, labels = (read_table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    rules = quality_rules.learn_rules(docs, labels.where("doc_id % 2 = 0"))
    judged = quality_rules.judge(docs.select("doc_id", "text"), rules).join(labels.where("doc_id % 2 = 1"), "doc_id")
    table = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert table.get((0, True), 0) <= 0.1 * (table.get((0, True), 0) + table[0, False])
    wrong = judged.where("quality = 1 and rule is not null and not base_failed").count()
    assert wrong <= 0.02 * judged.where("quality = 1").count()


def test_learning_without_rows_or_classes():
    one = np.ones((30, len(quality_rules.FEATURES)))
    assert quality_rules.learn(one[:0], np.zeros(0, bool)) == []
    assert quality_rules.learn(one, np.zeros(30, bool)) == []


# sharding


def test_shards(small, edges):
    for rows, docs in both(small, edges):
        made = sharding.shard_by_bytes(docs, 16)
        same_extras(docs, made, "text", "size", "text_crc32")
        got = rows_of(made, "doc_id", "size", "text_crc32", "shard", "slot")
        import zlib

        want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
        assert Counter(g[:3] for g in got) == want
        total, most = sum(g[1] for g in got), max(g[1] for g in got)
        for shard in {g[3] for g in got}:
            assert sorted(g[4] for g in got if g[3] == shard) == list(range(sum(g[3] == shard for g in got)))
            assert abs(sum(g[1] for g in got if g[3] == shard) - total / 16) <= most
        ordered = sorted(got, key=lambda g: (g[3], g[4]))
        ids = [-1 if g[0] is None else g[0] for g in ordered]
        assert ids == sorted(ids)


# toxicity


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (read_table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    judged = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    table = {(r.toxic, r.predicted): r["count"] for r in judged.groupBy("toxic", "predicted").count().collect()}
    assert table[1, 1] >= 0.8 * (table[1, 1] + table.get((1, 0), 0))
    assert table.get((0, 1), 0) <= 0.03 * table[0, 0]


def test_toxicity_of_odd_rows(edges):
    weights = np.zeros(toxicity.BUCKETS)
    made = toxicity.score(edges, toxicity.Classifier(weights, -1.0))
    same_extras(edges, made, "score")
    got = rows_of(made, "score", "predicted")
    assert len(got) == edges.count() and all(abs(s - 1 / (1 + np.e)) < 1e-9 and p == 0 for s, p in got)


def test_risk_needs_positives():
    assert toxicity.fit([], [np.array([1])], 0.1).weights.sum() == 0
    rng = np.random.default_rng(0)
    texts = [np.unique(rng.integers(10, 500, 30)) for _ in range(400)]
    for x in range(0, 400, 8):
        texts[x] = np.append(texts[x], 1)
    model = toxicity.fit([t for t in texts if 1 in t][:40], texts, 0.125)
    assert model.weights[1] > 1 and model.bias < 0


# line dedup


def test_lines(small, edges):
    for rows, docs in both(small, edges):
        for min_docs in (2, 10):
            want = brute.kept_lines([t for _, t in rows], min_docs)
            made = line_dedup.drop_shared_lines(docs, min_docs=min_docs)
            same_extras(docs, made)
            got = Counter((i, n, d, t or "") for i, n, d, t in rows_of(made, "doc_id", "n_lines", "n_dropped", "text"))
            assert got == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))


# words


def test_words_are_told_apart():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abAB é\n\t x"), int(n))) for n in rng.integers(0, 60, 200)]
    texts += [None, "", "   ", "x" * (CHUNK + 5), "a " * (CHUNK // 2 + 7)]
    import re

    for lower in (False, True):
        words, one, two = Words(pa.array(texts), lower=lower), {}, {}
        for i, text in enumerate(texts):
            each = re.findall(brute.BLANK, brute.lower(text) if lower else text or "")
            hashes = words.hashes[words.rows[i] : words.rows[i + 1]].tolist()
            assert len(each) == len(hashes)
            assert all(one.setdefault(w, h) == h and two.setdefault(h, w) == w for w, h in zip(each, hashes, strict=True))
    values = rng.integers(0, 5, 50).astype(np.uint64)
    for width in (1, 2, 3, 7, 50, 51):
        assert window_minima(values, width).tolist() == [i + int(np.argmin(values[i : i + width])) for i in range(51 - width)]
    assert len(set(windows(values, 3).tolist())) == len({tuple(values[i : i + 3]) for i in range(48)})


# empty tables


def test_empty_tables(spark, empty, edges):
    no_items = spark.createDataFrame([], "item_id long, text string")
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert simhash.groups(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    model, words = bloom_lm.train(empty, bits=1 << 20)
    assert bloom_lm.score(empty, model, words).count() == 0
    assert bloom_lm.score(edges, model, words).where("n_known = 0 and score <= 0").count() == edges.count()
    assert decontaminate.mark_contaminated(empty, no_items).count() == 0
    assert decontaminate.mark_contaminated(edges, no_items).where("not contaminated").count() == edges.count()
    assert suffix_dedup.repeated_passages(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert quality_rules.learn_rules(empty, no_labels) == [] and quality_rules.learn_rules(edges, no_labels) == []
    assert quality_rules.judge(empty, []).count() == 0
    assert sharding.shard_by_bytes(empty).count() == 0
    assert toxicity.score(empty, toxicity.train(empty, no_labels)).count() == 0
    assert toxicity.score(edges, toxicity.train(edges, no_labels)).count() == edges.count()
    assert line_dedup.drop_shared_lines(empty).count() == 0
