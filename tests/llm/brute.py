"""Plain versions of the operators' rules, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

BLANK = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def fingerprint(text):
    words = re.findall(BLANK, lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, distance=4):
    """Root of each distinct value: the smallest it reaches."""
    values = sorted(set(values))
    array, root = np.array(values, dtype=np.uint64), list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= distance):
            a, b = sorted((find(i), find(i + 1 + int(j))))
            root[b] = a
    return {v: values[find(i)] for i, v in enumerate(values)}


def covered(rows, width):
    """For each row its words and which of them lie in a window that starts at another place as well."""
    words = [re.findall(BLANK, t or "") for t in rows]
    count = Counter(tuple(w[j : j + width]) for w in words for j in range(len(w) - width + 1))
    out = []
    for w in words:
        hit = [False] * len(w)
        for j in range(len(w) - width + 1):
            if count[tuple(w[j : j + width])] > 1:
                hit[j : j + width] = [True] * width
        out.append((w, hit))
    return out


def runs(hit):
    edges = np.flatnonzero(np.diff(np.concatenate(([0], np.array(hit, np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def kept_lines(rows, min_docs, min_chars=1):
    lines = [(t or "").split("\n") for t in rows]
    keys = [[lower(x.strip(" \t\n\x0b\x0c\r")) for x in doc] for doc in lines]
    count = Counter(k for doc in keys for k in set(doc))
    gone = {k for k, n in count.items() if n >= min_docs and len(k) >= min_chars}
    return [(len(a), sum(k in gone for k in b), "\n".join(x for x, k in zip(a, b, strict=True) if k not in gone))
            for a, b in zip(lines, keys, strict=True)]


def contamination(rows, items):
    windows = {}
    for item, text in items:
        w = re.findall(ALNUM, lower(text))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for text in rows:
        w, hit, found = re.findall(ALNUM, lower(text)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (at := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= at
        ids = sorted(str(x) for x in found if x is not None)
        out.append((len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


def counts(text):
    w = re.findall(BLANK, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(BLANK, x)]
    five = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {k for i in range(len(w) - 4) if five[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), failed)


def remainder(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5


def base_scores(rows):
    """(n_tokens, n_known, N, base) for (doc_id, text) rows."""
    tokens = [[*re.findall(BLANK, lower(t)), "\n"] for _, t in rows]
    seen = Counter(w for (i, _), doc in zip(rows, tokens, strict=True) if remainder(i) != 1 for w in doc)
    total, distinct = sum(seen.values()), len(seen)
    return [(len(d), sum(w in seen for w in d), total,
             sum(math.log10((seen[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in d)) for d in tokens]
