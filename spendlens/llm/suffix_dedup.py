"""Suffix-array dedup: sparse suffix arrays over minimiser positions find passages that documents share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import KEY, packed, text_key, unpacked
from spendlens.llm.repeats import repeated_spans


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def by_suffixes(
    contexts: list[np.ndarray], times: list[int], at: list[int], width: int
) -> Iterator[tuple[int, int, int]]:
    """Sort the suffixes that start at the anchor, compare neighbours, extend matches to the left.

    Neighbours further away share no more words to the right, so looking outward ends where too few are left for a
    window that reaches the left end of the context.
    """
    right = [c[p:] for c, p in zip(contexts, at, strict=True)]
    left = [c[:p][::-1] for c, p in zip(contexts, at, strict=True)]
    order = sorted(range(len(contexts)), key=lambda i: right[i].astype(">u8").tobytes())
    shared = [_common(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    hits = [np.zeros(max(len(c) - width + 1, 0), bool) for c in contexts]

    def mark(i: int, before: int, after: int) -> None:
        first = at[i] - before
        if before + after >= width:
            hits[i][first : at[i] + after - width + 1] = True

    for rank, i in enumerate(order):
        follow = len(right[i])
        for other in range(rank + 1, len(order)):
            follow = min(follow, shared[other - 1])
            j = order[other]
            if follow + max(len(left[i]), len(left[j])) < width:
                break
            before = _common(left[i], left[j])
            mark(i, before, follow)
            mark(j, before, follow)
    for i, hit in enumerate(hits):
        if times[i] == 1:
            edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                yield i, a, b


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = 50) -> DataFrame:
    """A row per maximal passage of a document that only consists of runs of ``least_words`` words which also occur at
    another place: the document's other columns, ``start_word``, ``end_word`` (exclusive) and ``passage_words``.

    Documents without such a passage have no row; a null or short text has none; each of several equal rows is an
    occurrence and gets its rows. Columns of the added names are replaced. Words count as written
    and are compared by 64-bit hashes. Only suffixes at minimiser positions are kept, and of those only the ones whose first words occur again are sorted.
    """
    spans = repeated_spans(docs, doc_id, text, least_words, by_suffixes)
    own = ("start_word", "end_word", "passage_words")
    rows = docs.select(packed(docs, *own, text), *text_key(F.col(text)))
    return rows.join(spans, KEY).select(
        *unpacked(docs, *own, text),
        F.col("start").alias("start_word"),
        F.col("end").alias("end_word"),
        (F.col("end") - F.col("start")).alias("passage_words"),
    )
