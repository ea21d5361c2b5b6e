"""The prefix trie against a plain one."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from spendlens.llm import prefix_trie
from tests.llm import brute

SCHEMA = "conv_id long, turn long, role string, text string, pos int, t string, block int, words string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA)


def originals(rows):
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            held[c].append((turn is not None, turn or 0, (role or "", text or "")))
    return {c: [x[2] for x in sorted(turns, key=lambda x: x[:2])] for c, turns in held.items()}


def rebuilt(rows):
    own = originals(rows)
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[: h[c]] + own[c][h[c] :] for c in own}  # the sign as in SQL


def trie(paths):
    members, ended = defaultdict(list), defaultdict(list)
    for c, path in paths.items():
        ended[tuple(path)].append(c)
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        children[node[:-1]] += bool(node)
    for node, own in members.items():
        words = len(re.findall(brute.BLANK, node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own) - 1) * words
    return Counter(
        (min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children[node], leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(ended[node]))).encode()).hexdigest())
        for node, own in members.items()
    )


def found(made):
    assert made.columns == COLUMNS
    return Counter(map(tuple, made.collect()))


def grown(seed, n, longest, kinds, base=0):
    random_ = random.Random(seed)
    rows = []
    for c in range(base, base + n):
        for turn in range(random_.randint(1, longest)):
            rows.append((c, turn, random_.choice("ab"), random_.choice(["", "one", "two  words", "x y\nz"][:kinds])))
    random_.shuffle(rows)
    return rows


ODD = [
    (20, None, "a", "first"), (20, 0, None, "b c"), (20, 5, "a", None), (21, 1, "a", "x"), (39, None, None, None), (40, 1, "", ""),
    (None, 1, "a", "no conversation"), (-3, 1, "q", "r"), (-20, 2, "q", "r s"), (2**40, 1, "a", "x"), (20, 7, "a", "x"),
]


@pytest.mark.parametrize(("width", "span"), [(8, 1024), (3, 2), (1, 2), (2, 1)])
@pytest.mark.parametrize("rows", [grown(1, 150, 7, 3), grown(2, 60, 25, 2, -30), ODD, grown(3, 90, 2, 1)])
def test_trie_equals_the_plain_one(spark, rows, width, span):
    turns = prefix_trie.grafted(prefix_trie.ordered_turns(table(spark, rows).repartition(5)))
    assert found(prefix_trie.prefix_trie(turns, width, span)) == trie(rebuilt(rows))


def test_a_conversation_of_thousands_of_turns_and_a_common_opening(spark):
    rows = [(5, i, "a", f"w{i % 9}") for i in range(3000)] + [(6, i, "a", f"w{i % 9}") for i in range(2500)]
    rows += [(100 + c, i, "a", f"w{i}" if i < 2 else f"{c} v") for c in range(300) for i in range(3)]
    made = prefix_trie.prefix_trie(prefix_trie.ordered_turns(table(spark, rows).repartition(7)), span=16)
    assert found(made.where("depth < 40")) == Counter({k: v for k, v in trie_of_long(rows).items() if k[1] < 40})
    assert made.count() == 3000 + 1 + 1 - 0 + 300 - 1 + 0


def trie_of_long(rows):
    """As ``trie``, with leaves and savings of long single paths added up from below."""
    own = originals(rows)
    whole = trie({c: p[:60] for c, p in own.items()})
    n, out = {c: len(p) for c, p in own.items()}, Counter()
    shared = min(n[5], n[6])
    for (conv, depth, parent, convs, children, leaves, saved, ends), k in whole.items():
        if convs > 1 and conv == 5 or depth == 0:
            saved += shared - 60
        out[(conv, depth, parent, convs, children, leaves, saved, ends)] += k
    return out


def test_many_ends_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_LIST", 16 * 50)
    rows = [(c, 0, "a", "same") for c in range(700)]
    made = prefix_trie.prefix_trie(prefix_trie.ordered_turns(table(spark, rows).repartition(6)))
    assert found(made) == trie(originals(rows))


def test_no_conversations(spark):
    turns = prefix_trie.ordered_turns(table(spark, []))
    assert prefix_trie.prefix_trie(turns).count() == 0 and prefix_trie.prefix_trie(prefix_trie.grafted(turns)).count() == 0
