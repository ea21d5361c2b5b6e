"""Substring dedup: suffix automata of reference shards give matching statistics, spans above a length are removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import KEY, blank_words, packed, text_key, unpacked
from spendlens.llm.repeats import outside, repeated_spans, spans_by_text


class SuffixAutomaton:
    """All substrings of several sequences, with the number of places each ends at."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [0]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(0)
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int], times: int) -> None:
        last = 0
        for word in sequence:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
            else:
                new, p = self._state(self.length[last] + 1, 0, {}), last
                while p != -1 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p != -1:
                    q = self.next[p][word]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
                last = new
            self.ends[last] += times

    def close(self) -> None:
        """Pass the counts on to the suffixes, longest first."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]

    def repeated_ends(self, sequence: list[int], width: int) -> Iterator[int]:
        """Positions at which a match of ``width`` words ends that the references hold more than once."""
        state = size = 0
        for i, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            while self.link[state] > 0 and self.length[self.link[state]] >= width:
                state = self.link[state]  # the shortest class that still has the match of this width
                size = self.length[state]
            if size >= width and self.ends[state] > 1:
                yield i


def by_automaton(
    contexts: list[np.ndarray], times: list[int], at: list[int], width: int
) -> Iterator[tuple[int, int, int]]:
    automaton = SuffixAutomaton()
    sequences = [c.tolist() for c in contexts]
    for sequence, n in zip(sequences, times, strict=True):
        automaton.add(sequence, n)
    automaton.close()
    for i, sequence in enumerate(sequences):
        if times[i] > 1:
            continue  # repeated as a whole
        begin = before = None
        for end in automaton.repeated_ends(sequence, width):
            start = end - width + 1
            if before is None or start != before + 1:
                if before is not None:
                    yield i, begin, before + 1
                begin = start
            before = start
        if before is not None:
            yield i, begin, before + 1


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 35) -> DataFrame:
    """Documents with each word removed that lies in a window of ``width`` words which also starts somewhere else.

    ``text`` becomes the kept words joined by one space; ``n_words``, ``n_removed`` and ``spans`` (removed words, start
    and end) are added. Columns of these names are replaced, others stay. Windows are judged on the input; words
    count as written and are compared by 64-bit hashes. All occurrences go. A null text has no words and gives an empty text; texts shorter
    than a window keep all words; each of several equal rows is an occurrence.

    The reference shards are the contexts around an anchor (see ``repeats``), each in the task that has all of the
    anchor's occurrences. Automata of the whole corpus cannot be broadcast within any bound, and streaming every document
    through every shard is quadratic; anchors bring together just the places that can match. Of anchors with very many
    contexts windows are counted instead (README has the shares).
    """
    spans = spans_by_text(repeated_spans(docs, doc_id, text, width, by_automaton))
    own = ("n_words", "n_removed", "spans")
    rows = docs.select(packed(docs, *own, text), F.col(text).alias("_text"), *text_key(F.col(text)))
    joined = rows.join(spans, KEY, "left")
    removed = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    words = blank_words(F.col("_text"))
    kept = F.when(F.col("spans").isNull(), words).otherwise(outside(words, F.col("spans")))
    return joined.select(
        *unpacked(docs, *own, **{text: F.concat_ws(" ", kept)}),
        F.size(words).cast("long").alias("n_words"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        "spans",
    )
