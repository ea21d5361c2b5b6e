"""Packing of tokenised documents into sequences: minimum bin slack by subset-sum dynamic programming over lengths."""

from __future__ import annotations

import functools
import json
import re
import struct
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate, count, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from spendlens.llm.common import bounded_batches, packed, unpacked
from spendlens.session import materialize

#: Tokens of a sequence.
CAPACITY = 2048
#: Pieces that are numbered in one task, about; a length that more pieces have is numbered in several.
BUCKET = 20_000
#: Characters after which a long text is cut at the next blank.
PIECE_CHARS = 1 << 20
#: Bytes that the words and ids a worker remembers may take, apart from those of the batch or long text at hand; and of one
#: of them beside its two strings.
REMEMBERED_BYTES, _ENTRY = 1 << 27, 150
#: Bytes of ids after which a task hands on what it has.
_GATHER = 1 << 22

_BLANK = re.compile(r"[\x20\x09-\x0D]")
#: A word of Latin-1 letters, and perhaps other ASCII after it. No token reaches across white space, which the tokenizer
#: drops, or across the end of such letters, and their case does not count. (Other letters may, normalised or in lower
#: case, end in a combining mark, which goes with the punctuation; and < | > may belong to a special token.)
_LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-;=?-{}~]*)\Z")
#: Byte-level form of the letters that are not ASCII: a character for each byte of their UTF-8. Bytes from A1 to AC and from
#: AE on stand for themselves, the rest for characters from U+0100 on, 33 and a space and DEL before them.
_BYTES = [chr(b) if 0xA1 <= b <= 0xAC or b >= 0xAE else chr(0x100 + 34 + min(b - 0x80, 33)) for b in range(0x80, 0x100)]
_BYTE_LEVEL = {n: "".join(_BYTES[b - 0x80] for b in chr(n).encode()) for n in range(0xC0, 0x100)}
#: The steps of a tokenizer that ``WordIds`` relies on.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Python's split takes these for white space, the tokenizer does not.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


class WordIds:
    """Ids of texts, from the library's ids of their words; words met before are not encoded again."""

    def __init__(self, tokenizer: str) -> None:
        steps = json.loads(tokenizer)
        kinds = [n["type"] for n in (steps["normalizer"] or {}).get("normalizers", [])]
        if kinds != _NORMALIZERS or json.dumps(_SPLIT) not in json.dumps(steps["pre_tokenizer"]):
            raise ValueError("not a tokenizer that lower-cases, drops white space and takes letters and punctuation apart")
        self._tokenizer = Tokenizer.from_str(tokenizer)
        self._model = self._tokenizer.model
        self._numbers = defaultdict(count().__next__)  # of the words met, in the order met
        self._ids: list[bytes] = []  # of each
        self._bytes = 0  # of both
        self._first = 0, 0  # words, and their bytes, that stay

    def _forget(self) -> None:
        """All words but those met first, as frequent ones are met early."""
        words, self._bytes = self._first
        self._numbers = defaultdict(count(words).__next__, zip(islice(self._numbers, words), range(words)))
        del self._ids[words:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        What is remembered is bounded by its bytes: where blanks are rare, words are of any length.
        """
        if self._bytes > REMEMBERED_BYTES:
            self._forget()
        number = self._numbers.__getitem__
        numbered = [list(map(number, _words(text))) for text in texts]
        new = list(islice(reversed(self._numbers), len(self._numbers) - len(self._ids)))
        made = self._encode_words(new[::-1])
        self._ids += made
        self._bytes += sum(map(sys.getsizeof, new)) + sum(map(sys.getsizeof, made)) + _ENTRY * len(new)
        if self._bytes <= REMEMBERED_BYTES // 4:
            self._first = len(self._ids), self._bytes
        return [b"".join(map(self._ids.__getitem__, own)) for own in numbered]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word; words that differ by their case or punctuation only are encoded once."""
        cut = [(m[1].lower(), m[2]) if (m := _LETTERS.match(word)) else ("", word) for word in words]
        parts = dict.fromkeys((other for _, other in cut), False) | dict.fromkeys((word for word, _ in cut if word), True) | {"": False}
        ids, met = {}, len(self._ids)
        for part, letters in parts.items():
            number = self._numbers.get(part, met)
            if number < met:  # a part is encoded like the word of the same characters
                ids[part] = self._ids[number]
                continue
            if letters:
                made = [token.id for token in self._model.tokenize(part if part.isascii() else part.translate(_BYTE_LEVEL))]
            else:
                made = self._tokenizer.encode(part, add_special_tokens=False).ids
            ids[part] = struct.pack(f"<{len(made)}I", *made)
        return [ids[word] + ids[other] for word, other in cut]

    def stretches(self, text: str) -> Iterator[bytes]:
        """Ids of a long text in order, a stretch at a time; a stretch without a blank stays whole."""
        at = 0
        while len(text) - at > PIECE_CHARS:
            cut = _BLANK.search(text, at + PIECE_CHARS)
            if cut is None:
                break
            yield from self.encode([text[at : cut.start()]])
            at = cut.start()
        yield from self.encode([text[at:]])


def _words(text: str) -> list[str]:
    """Runs without white space, by the tokenizer's meaning of it or a narrower one."""
    if any(c in text for c in _SEPARATORS):
        return _BLANK.split(text)
    return text.split()


@functools.lru_cache(maxsize=2)
def _word_ids(tokenizer: str) -> WordIds:
    """One per worker process."""
    return WordIds(tokenizer)


def pieces(
    docs: DataFrame,
    tokenizer_file: str,
    capacity: int = CAPACITY,
    end: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """A row per piece: the document's id column, ``piece`` (from 0), ``start`` (its document's ids before it), ``length``
    and ``token_ids`` (little-endian unsigned 32-bit).

    A document is the tokenizer's ids of its whole text without special tokens, then the id ``end``; only longer ones than
    ``capacity`` are cut, every piece but the last to just that length. Null and empty texts are one piece, the end. Rows
    are encoded one by one where they are read, so null ids, ties and repeated rows stay as they are; columns other than
    the two named are left out. An empty table gives no rows. Long texts are encoded in stretches between blanks. The
    tokenizer is read on the driver and sent along: a vocabulary, whose size the data do not change.
    """
    bounded_batches(docs.sparkSession)
    with open(tokenizer_file, encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kinds = [
        T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("token_ids", T.BinaryType()),
    ]
    schema = T.StructType([rows.schema["_id"], *kinds])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = _word_ids(vocabulary.value), 4 * capacity
        last = np.array([end], "<u4").tobytes()

        def batch_of(made: list[tuple], ids: pa.Array) -> pa.RecordBatch:
            row, number, start, tokens = zip(*made, strict=True)
            columns = [
                ids.take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                pa.array([len(t) // 4 for t in tokens], pa.int64()), pa.array(tokens, pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            short = [i for i, t in enumerate(texts) if len(t) <= PIECE_CHARS]
            whole = dict(zip(short, encoder.encode([texts[i] for i in short]), strict=True))
            made, size = [], 0
            for i, t in enumerate(texts):
                held, at = b"", 0
                parts = [whole[i]] if i in whole else encoder.stretches(t)
                for tokens in (x for group in (parts, [last]) for x in group):
                    held += tokens
                    if len(held) > width:  # the last piece, full or not, is put out below
                        full = (len(held) - 1) // width
                        made += [(i, at + k, (at + k) * capacity, held[k * width : (k + 1) * width]) for k in range(full)]
                        at, held, size = at + full, held[full * width :], size + full * width
                    if size > _GATHER:
                        yield batch_of(made, ids)
                        made, size = [], 0
                made.append((i, at, at * capacity, held))
                size += len(held)
            if made:
                yield batch_of(made, ids)

    return rows.mapInArrow(cut, schema).withColumnRenamed("_id", doc_id)


def fullest(counts: dict[int, int], room: int, lengths: list[int]) -> dict[int, int]:
    """The pieces (copies by length) whose sum comes closest to ``room`` from below.

    Bit s of ``reach`` says that some pieces add up to s. Lengths are taken from the longest on and only until the room
    can be filled, so that short pieces, which fit anywhere, are left for later.
    """
    reach, within, steps = 1, (2 << room) - 1, []
    for length in lengths:
        if length > room or not counts[length]:
            continue
        before, left, some = reach, min(counts[length], room // length), 1
        while left:  # any number of copies up to `left`, as sums of 1, 2, 4, ... and a rest
            some = min(some, left)
            reach |= reach << some * length & within
            left, some = left - some, 2 * some
        if reach != before:
            steps.append((length, before))
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> total & 1:
            total -= length
            taken[length] = taken.get(length, 0) + 1
    return taken


class Filling(NamedTuple):
    """``times`` sequences that all hold ``taken``."""

    taken: dict[int, int]
    times: int


def fillings(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Sequences for so many pieces of each length, by least slack: each takes the longest piece left and the fullest
    combination beside it.

    As the next sequence would choose the same as long as there is enough of it, a combination is used as often as its
    pieces last. Each so uses up a length, or halves it at least, and work is bounded by the lengths, not by the pieces.
    """
    counts, made = Counter({n: c for n, c in counts.items() if c}), []
    lengths = sorted(counts, reverse=True)
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        taken = fullest(counts, capacity - longest, lengths)
        counts[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(counts[n] // c for n, c in taken.items())
        for n, c in taken.items():
            counts[n] -= times * c
        made.append(Filling(taken, times))
        lengths = [n for n in lengths if counts[n]]
    return made


def _places(made: list[Filling]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in a sequence, offset of the first copy), by length and rank."""
    rows, used = [], Counter()
    firsts = accumulate((f.times for f in made), initial=0)
    for filling, first in zip(made, firsts):
        offset = 0
        for length, copies in filling.taken.items():
            rows.append((length, used[length], first, copies, offset))
            used[length] += filling.times * copies
            offset += length * copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(made: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """The rows of ``made`` (pieces of 1 to ``capacity`` tokens) with ``sequence_id`` (from 0, without gaps) and ``offset``
    in it; columns of these two names are replaced, all others pass, whatever their names.

    Only lengths matter: how many pieces have each (at most ``capacity`` numbers, the only thing the driver gets) decides
    the sequences, and the piece of rank r among those of its length finds its place in their list, which is broadcast and
    of a size that the lengths bound. Ranks come from counts by length and bucket, so that no length is gathered in a task.
    Rows without a length raise; equal rows are separate pieces. No rows: no sequences.
    """
    spark = made.sparkSession
    bounded_batches(spark)
    rows = made.select(packed(made, "sequence_id", "offset"), F.col(length).cast("long").alias("_length"))
    stored = materialize(rows.withColumn("_n", F.monotonically_increasing_id()), "pieces")
    counts = {n: c for n, c in stored.groupBy("_length").count().collect()}  # at most `capacity` rows
    if any(n is None or not 0 < n <= capacity for n in counts):
        raise ValueError(f"pieces must have 1 to {capacity} tokens")
    places = spark.sparkContext.broadcast(_places(fillings(counts, capacity)))

    buckets = -(-sum(counts.values()) // BUCKET)
    dealt = stored.withColumn("_bucket", F.pmod(F.xxhash64("_n"), F.lit(max(buckets, 1))))
    before = Window.partitionBy("_length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        dealt.groupBy("_length", "_bucket")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_length", "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    )
    own = Window.partitionBy("_length", "_bucket").orderBy("_n")
    ranked = (
        dealt.withColumn("_own", F.row_number().over(own) - 1)
        .join(firsts, ["_length", "_bucket"])
        .select("_row", "_length", (F.col("_first") + F.col("_own")).alias("_rank"))
    )
    schema = T.StructType([ranked.schema["_row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            n, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            _, first, sequence, copies, offset = table[np.searchsorted(keys, (n << 44) + rank, "right") - 1].T
            columns = [batch.column(0), pa.array(sequence + (rank - first) // copies), pa.array(offset + (rank - first) % copies * n)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return ranked.mapInArrow(slots, schema).select(*unpacked(made, "sequence_id", "offset"), "sequence_id", "offset")


def sequences(placed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """A row per sequence: ``sequence_id``, ``length``, ``token_ids`` and ``doc_ids`` of its pieces in order.

    Each sequence gathers at most as many tokens as it holds. Needs the columns of ``pieces`` and ``place``.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", F.col(doc_id).alias("doc_id"), "token_ids")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("_parts")).select(
        "sequence_id",
        "length",
        F.aggregate("_parts", F.lit(b""), lambda all_, p: F.concat(all_, p.token_ids)).alias("token_ids"),
        F.transform("_parts", lambda p: p.doc_id).alias("doc_ids"),
    )
