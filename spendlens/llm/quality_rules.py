"""Quality rules: a decision list of threshold conjunctions, learned from labelled statistics by sequential covering."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import blank_words, let, packed, unpacked

#: Labelled rows the rules are learned from, taken in the order of a hash of the id. The sample bounds the learner only.
TRAINING_ROWS = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "capital_rate", "mark_rate")


def _repeat_words(words: Column, width: int) -> Column:
    """Words inside windows of ``width`` words that the array holds twice or more."""
    n = F.size(words)
    windows = F.when(
        n >= width, F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        twice = F.filter(
            F.sequence(F.lit(0), last),
            lambda j: ((j > 0) & (ordered[F.greatest(j - 1, F.lit(0))]["h"] == ordered[j]["h"]))
            | ((j < last) & (ordered[F.least(j + 1, last)]["h"] == ordered[j]["h"])),
        )
        starts = F.sort_array(F.transform(twice, lambda j: ordered[j]["i"]))
        first = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("at"))
        return F.aggregate(
            starts,
            first,
            lambda acc, s: F.struct((acc["n"] + F.least(s - acc["at"], F.lit(width))).alias("n"), s.alias("at")),
            lambda acc: acc["n"],
        )

    def count(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, covered))

    return let(windows, count)


def statistics(text: Column) -> Column:
    """Struct of the counts of a text; null is like empty."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.concat_ws("", words)).cast("long").alias("word_chars"),
            _repeat_words(words, 5).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    chars = F.char_length(text)
    return F.struct(
        let(blank_words(text), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        (chars - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (chars - F.char_length(F.regexp_replace(text, r"[A-ZÀ-Þ]+", ""))).cast("long").alias("n_capitals"),
        (chars - F.char_length(F.regexp_replace(text, r"[!?]+", ""))).cast("long").alias("n_marks"),
    )


def with_statistics(docs: DataFrame, text: str) -> DataFrame:
    """Documents with a column for each of COUNTS and FEATURES (rates are 0 where there is nothing to divide by)."""
    s = "_stats"
    own = (*COUNTS, *FEATURES)
    rows = docs.select(packed(docs, *own), statistics(F.col(text)).alias(s))
    words, chars = F.col(f"{s}.w.n_words"), F.greatest(F.col(f"{s}.w.word_chars"), F.lit(1))
    per_word = F.greatest(words, F.lit(1))
    return rows.select(
        *unpacked(docs, *own),
        words.alias("n_words"),
        F.col(f"{s}.w.word_chars").alias("word_chars"),
        F.col(f"{s}.n_symbols").alias("n_symbols"),
        F.col(f"{s}.l.n_dup_lines").alias("n_dup_lines"),
        F.col(f"{s}.w.n_repeat_words").alias("n_repeat_words"),
        (F.col(f"{s}.w.word_chars") / per_word).alias("word_length"),
        (F.col(f"{s}.n_symbols") / chars).alias("symbol_rate"),
        (F.col(f"{s}.l.n_dup_lines") / F.greatest(F.col(f"{s}.l.n_lines"), F.lit(1))).alias("dup_line_rate"),
        (F.col(f"{s}.w.n_repeat_words") / per_word).alias("repeat_rate"),
        (F.col(f"{s}.n_capitals") / chars).alias("capital_rate"),
        (F.col(f"{s}.n_marks") / chars).alias("mark_rate"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def holds(self, x: np.ndarray) -> np.ndarray:
        values = x[:, FEATURES.index(self.feature)]
        return values > self.threshold if self.above else values <= self.threshold


Rule = tuple[Condition, ...]


def _matches(rule: Rule, x: np.ndarray) -> np.ndarray:
    held = np.ones(len(x), bool)
    for condition in rule:
        held &= condition.holds(x)
    return held


def _grow(x: np.ndarray, bad: np.ndarray, conditions: list[Condition], most: int, first: str) -> Rule:
    """Add the condition with the largest information gain until only bad rows match, beginning with one on ``first``."""
    rule, inside = (), np.ones(len(x), bool)
    while len(rule) < most and (~bad[inside]).any() and bad[inside].any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best, gain = None, 1e-9
        for condition in conditions:
            if not rule and condition.feature != first:
                continue
            held = inside & condition.holds(x)
            p, n = (held & bad).sum(), (held & ~bad).sum()
            if p and (value := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                best, gain = condition, value
        if best is None:
            break
        best = _centred(best, x[inside])
        rule, inside = (*rule, best), inside & best.holds(x)
    return rule


def _centred(condition: Condition, x: np.ndarray) -> Condition:
    """The same split of these rows, with the threshold in the middle of the gap it lies in."""
    values = x[:, FEATURES.index(condition.feature)]
    low, high = values[values <= condition.threshold], values[values > condition.threshold]
    if not len(low) or not len(high):
        return condition
    return Condition(condition.feature, condition.above, float(low.max() + high.min()) / 2)


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Cut conditions from the end while (bad - good) / all does not fall on rows that did not grow the rule."""

    def worth(r: Rule) -> float:
        held = _matches(r, x)
        p, n = (held & bad).sum(), (held & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(
    x: np.ndarray, bad: np.ndarray, precision: float = 0.97, support: int = 10, most_rules: int = 24,
    most_conditions: int = 4, cuts: int = 48,
) -> list[Rule]:
    """Ordered rules for bad rows. x: a column per name in FEATURES.

    From each feature a rule is grown on two thirds of the rows that no earlier rule took, and pruned on the other third;
    the one that takes most bad rows is added. Rules that are right in less than ``precision`` of their rows, or take
    fewer than ``support`` bad ones, do not count; learning ends when none is left. One class, or no rows, give no rules. The order of the rows decides which third a row is in.
    """
    rules: list[Rule] = []
    conditions = []
    if len(x):
        for i, name in enumerate(FEATURES):
            for cut in np.unique(np.quantile(x[:, i], np.linspace(0, 1, cuts + 1)[:-1])):
                conditions += [Condition(name, True, float(cut)), Condition(name, False, float(cut))]
    part, left = np.arange(len(x)) % 3, np.ones(len(x), bool)
    while len(rules) < most_rules and (left & bad).sum() >= support:
        growing, pruning = left & (part < 2), left & (part == 2)
        best, taken = None, left
        for first in FEATURES:
            grown = _grow(x[growing], bad[growing], conditions, most_conditions, first)
            for rule in (_prune(grown, x[pruning], bad[pruning]), grown) if grown else ():
                held = left & _matches(rule, x)
                right = (held & bad).sum()
                if right >= max(support, precision * held.sum()) and (best is None or right > (taken & bad).sum()):
                    best, taken = rule, held
        if best is None:
            break
        rules.append(best)
        left &= ~taken
    return rules


def learn_rules(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality",
    training_rows: int = TRAINING_ROWS, **options,
) -> list[Rule]:
    """Rules from the labelled documents (quality 0: bad). Labels without an id or a quality are left out; of
    contradicting labels the lower counts. At most ``training_rows`` labels are used, the first by a hash of the id."""
    chosen = (
        labels.where(F.col(doc_id).isNotNull() & F.col(quality).isNotNull())
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(F.min(quality).alias("_quality"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(training_rows)
    )
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    rows = (
        with_statistics(texts.join(F.broadcast(chosen), "_id"), "_text")
        .groupBy("_id")  # an id that many rows share is one training row
        .agg(F.min("_quality").alias("_quality"), *[F.min(c).alias(c) for c in FEATURES])
        .orderBy(F.xxhash64("_id"), "_id")
        .collect()
    )
    x = np.array([[float(r[c]) for c in FEATURES] for r in rows]).reshape(len(rows), len(FEATURES))
    return learn(x, np.array([r["_quality"] == 0 for r in rows], bool), **options)


def rule_number(rules: list[Rule]) -> Column:
    """Number of the first rule that a row with FEATURES meets, null if none: one ordered conditional expression."""
    verdict = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules))):
        met = rule[0].column()
        for condition in rule[1:]:
            met = met & condition.column()
        verdict = F.when(met, F.lit(number)).otherwise(verdict)
    return verdict


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Documents with their counts, ``base_failed``, ``rule`` (number of the deciding rule or null) and ``kept``.

    Columns of these names are replaced. A null or empty text has no words, so it fails; every row is judged by itself,
    repeated rows alike. Whole texts are counted, whatever their length; no text leaves its task.
    """
    own = {"base_failed", "rule", "kept"}
    rows = with_statistics(docs.select(*[c for c in docs.columns if c not in own]), text)
    return rows.withColumns({"base_failed": base_failed(), "rule": rule_number(rules)}).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )


def keep_good(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Documents that neither the base limits nor a rule rejects, with their own columns."""
    marked = docs.select(packed(docs).alias("_kept_row"), F.col(text).alias("_judged"))
    return judge(marked, rules, "_judged").where("kept").select(F.col("_kept_row").alias("_row")).select(*unpacked(docs))
