"""Packing: pieces against the library's ids, sequences against exact search and bounds."""

import random
import string
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spendlens.llm import packing
from spendlens.llm.queries import op13_best_fit_packing

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def want_pieces(rows, capacity):
    tokenizer = Tokenizer.from_file(WORDS)
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4").tobytes()
            yield i, k, at, len(part) // 4, part


def check_places(rows, capacity):
    """Sequences are gapless from 0, filled from 0 without gaps and never above the capacity."""
    held = defaultdict(list)
    for length, sequence, offset in rows:
        held[sequence].append((offset, length))
    assert sorted(held) == list(range(len(held)))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("table", ["small", "edges"])
@pytest.mark.parametrize("capacity", [2048, 37])
def test_pieces_and_places(request, table, capacity):
    docs = request.getfixturevalue(table)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    made = packing.pieces(docs, WORDS, capacity)
    assert made.columns == ["doc_id", "piece", "start", "length", "token_ids"]
    placed = [tuple(r) for r in packing.place(made, capacity).collect()]
    assert Counter((*r[:4], bytes(r[4])) for r in placed) == Counter(want_pieces(rows, capacity))
    assert check_places([(r[3], *r[5:]) for r in placed], capacity) >= -(-sum(r[3] for r in placed) // capacity)


def test_stretches_and_words_give_the_ids_of_the_whole_text(monkeypatch):
    tokenizer, random_ = Tokenizer.from_file(WORDS), random.Random(3)
    words = packing.WordIds(open(WORDS, encoding="utf-8").read())
    some = ["a", "Z", "7", "'s", "'", "n't", "\n", " ", "\t", "é", "é", "́", "　", "\x1c", "!", ".", ",", ".,", "²", "ǆ", "Σ", "İ", "<|endoftext|>", "\U0001f600", "​", "ा", "\u0958", "ß", "Ä", "\x01", "\x85", "\xa0", "\u2028", "\u180e", "\ufeff", "\u2000"]
    monkeypatch.setattr(packing, "PIECE_CHARS", 11)
    for _ in range(600):
        text = "".join(random_.choices(some, k=50))
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert words.encode([text]) == [want]
        assert b"".join(words.stretches(text)) == want


def test_remembered_words_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 1 << 16, raising=False)
    tokenizer, random_ = Tokenizer.from_file(WORDS), random.Random(5)
    words, made = packing.WordIds(open(WORDS, encoding="utf-8").read()), []
    encode_words = words._encode_words
    monkeypatch.setattr(words, "_encode_words", lambda new: made.extend(new) or encode_words(new))
    words.encode(["the and of"])
    tracemalloc.start()
    for _ in range(40):  # long words, as in texts without blanks: some 2.5 kB each with their ids
        text = " ".join(["the", *("".join(random_.choices(string.ascii_lowercase, k=1000)) for _ in range(20)), "of"])
        assert words.encode([text]) == [np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    made.clear()
    held = tracemalloc.get_traced_memory()[0]
    words.encode(["and the of"])
    tracemalloc.stop()
    assert held < 1 << 18 and made == []  # the words met first are still known


def test_all_letters_that_take_the_short_way():
    tokenizer = Tokenizer.from_file(WORDS)
    words = packing.WordIds(open(WORDS, encoding="utf-8").read())
    for text in ("".join(map(chr, range(0xC0, 0x100))), " ".join(map(chr, range(0x21, 0x180))), " ".join(f"x{chr(n)}Y{chr(n)}." for n in range(0x21, 0x180))):
        assert words.encode([text]) == [np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    with pytest.raises(ValueError, match="tokenizer"):
        packing.WordIds(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())


def test_fullest_is_exact():
    random_ = random.Random(9)
    for _ in range(200):
        items = [random_.randint(1, 30) for _ in range(random_.randint(0, 9))]
        room, counts = random_.randint(0, 80), Counter(items)
        taken = packing.fullest(counts, room, sorted(counts, reverse=True))
        assert all(c <= counts[n] for n, c in taken.items())
        best = max(s for k in range(len(items) + 1) for c in combinations(items, k) if (s := sum(c)) <= room)
        assert sum(n * c for n, c in taken.items()) == best


def test_fillings_use_every_piece_once_and_few_sequences():
    random_ = random.Random(4)
    for n in (0, 1, 50, 20_000):
        counts = Counter(min(2048, int(random_.lognormvariate(5.5, 1)) + 1) for _ in range(n))
        made, used = packing.fillings(counts, 2048), Counter()
        for filling in made:
            assert sum(a * b for a, b in filling.taken.items()) <= 2048
            used.update({a: b * filling.times for a, b in filling.taken.items()})
        assert used == counts
        least = -(-sum(a * b for a, b in counts.items()) // 2048)
        assert sum(f.times for f in made) <= least + 1
        assert len(made) <= 4 * len(counts)


def test_one_length_holds_most_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 50)
    made = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 40 + 1).alias("length"), F.lit("x").alias("offset"))
    rows = [tuple(r) for r in packing.place(made, 64).select("length", "sequence_id", "offset").collect()]
    total = sum(r[0] for r in rows)
    assert len(rows) == 3000 and check_places(rows, 64) <= -(-total // 64) + 2


def test_lengths_that_do_not_fit_raise(spark):
    for bad in (0, 65, None):
        with pytest.raises(ValueError, match="1 to 64"):
            packing.place(spark.createDataFrame([(bad,)], "length long"), 64)


def test_empty_tables(spark, empty):
    made = packing.pieces(empty, WORDS)
    assert packing.place(made).count() == 0 and packing.sequences(packing.place(made)).count() == 0


def test_sequences_hold_their_pieces(small):
    placed = packing.place(packing.pieces(small, WORDS)).cache()
    want = defaultdict(bytes)
    for r in sorted(placed.collect(), key=lambda r: r.offset):
        want[r.sequence_id] += bytes(r.token_ids)
    assert {r.sequence_id: bytes(r.token_ids) for r in packing.sequences(placed).collect()} == want
    placed.unpersist()


def test_query(spark, small):
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    made = op13_best_fit_packing(spark, SF)
    assert made.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert Counter(tuple(r)[:5] for r in made.collect()) == Counter((*w[:4], zlib.crc32(w[4])) for w in want_pieces(rows, 2048))
