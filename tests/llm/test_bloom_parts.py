"""Scores against a plain model with exact quantised counts, however little of the filter is broadcast; their sum over words."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.llm import bloom_lm
from tests.llm import brute


def sequences(rows):
    return [[*re.findall(brute.BLANK, brute.lower(t)), None] for _, t in rows]


class Plain:
    """Word counts and pair counts of texts; None is the end, and the context of the first word."""

    def __init__(self, rows):
        self.words, self.pairs = Counter(), Counter()
        for tokens in sequences(rows):
            self.words.update(tokens)
            self.pairs.update(zip([None, *tokens], tokens))
        self.denominator = sum(self.words.values()) + 0.5 * (len(self.words) + 1)

    def probability(self, context, word, smoothing, pair_share):
        c, w, n = self.words[context], self.words[word], self.pairs[context, word]
        weight = pair_share * c / (c + smoothing)
        pair = 2 ** math.floor(math.log2(n)) if n else 0
        return (weight * pair / c if c else 0) + (1 - weight) * (w + 0.5) / self.denominator


def scores(made):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, round(r.score, 7)) for r in made.select("doc_id", "n_tokens", "score").collect())


@pytest.mark.parametrize("table", ["small", "edges"])
@pytest.mark.parametrize(("bits", "frequent"), [(1 << 26, 1 << 20), (1 << 18, 40), (1 << 20, 0)])
def test_scores_are_those_of_the_plain_model(request, table, bits, frequent):
    """With so thin a filter that it hardly errs: all pairs broadcast, some, and hardly any, and likewise for words."""
    docs = request.getfixturevalue(table)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    learnt = docs.where(F.coalesce(F.col("doc_id") % 3, F.lit(0)) != 1)
    plain = Plain([r for r in rows if (r[0] or 0) % 3 != 1])
    model, words = bloom_lm.train(learnt, bits=bits, frequent=frequent, fill=0.02)
    assert len(model.flags.value) == bits // 8 and len(model.frequent) <= frequent
    if table == "small":
        assert (model.rest is None) == (bits == 1 << 26) and (model.parts > 20) == (bits == 1 << 18)
    want = []
    for (i, _), tokens in zip(rows, sequences(rows), strict=True):
        total = sum(math.log10(plain.probability(c, w, model.smoothing, model.pair_share)) for c, w in zip([None, *tokens], tokens))
        want.append((i is None, i or 0, len(tokens), total))
    for got, expected in zip(scores(bloom_lm.score(docs, model, words)), sorted(want), strict=True):
        assert got[:3] == expected[:3] and got[3] == pytest.approx(expected[3], rel=1e-6, abs=1e-6)


def test_probabilities_add_up_to_one_at_most(small):
    """Over all words and an unknown one, after every context, by the functions the scores use."""
    plain = Plain([tuple(r) for r in small.select("doc_id", "text").orderBy("doc_id").limit(40).collect()])
    names = [*plain.words, "\x00 unknown"]
    counts = np.array([plain.words[w] for w in names])
    for context in names:
        seen = np.full(len(names), plain.words[context])
        levels = np.array([plain.pairs[context, w].bit_length() for w in names])
        factor, summand = bloom_lm.probability_parts(counts, seen, bloom_lm.SMOOTHING, bloom_lm.PAIR_SHARE, plain.denominator)
        p = bloom_lm.pair_count(levels, counts, seen) * factor + summand
        assert 0.5 < p.sum() <= 1 + 1e-9 and (p > 0).all()
    alone = bloom_lm.probability_parts(counts, np.zeros(len(names)), bloom_lm.SMOOTHING, bloom_lm.PAIR_SHARE, plain.denominator)[1]
    assert alone.sum() == pytest.approx(1)


def test_half_full_blocks_seldom_err(small):
    made = {}
    for bits in (1 << 17, 1 << 26):
        model, words = bloom_lm.train(small, bits=bits)
        made[bits] = np.array([r.score / r.n_tokens for r in bloom_lm.score(small, model, words).orderBy("doc_id").collect()])
    assert np.abs(made[1 << 17] - made[1 << 26]).max() < 0.05
