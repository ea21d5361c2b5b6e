"""Hard negatives against a plain search over all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from spendlens.llm import hard_negatives
from spendlens.llm.queries import op12_hard_negatives

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, id string, grp int, v string"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
ANCHOR = "id % 100 = 0"


def plain(rows, every=100):
    kept = []
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((i, [math.floor(256 * x) for x in vector], label))
    out = Counter()
    for a, va, la in kept:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, v, label in kept)
        for p, pid in [(-s, i) for s, i, label in scored if label == la and i != a][:5]:
            fit = [(-s, i) for s, i, label in scored if label != la and 30 * p <= 100 * -s <= 90 * p][:10]
            out.update((a, pid, k, i, p, s) for k, (s, i) in enumerate(fit, 1))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def found(made):
    assert made.columns == COLUMNS
    return Counter(map(tuple, made.collect()))


def clustered(seed, n, dims, labels=4):
    random_ = random.Random(seed)
    centres = [[random_.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    f = lambda x: float(np.float32(x))
    return [(i, [f(c + random_.gauss(0, 0.3)) for c in random_.choice(centres)], random_.randrange(labels)) for i in range(n)]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "GROUP", 64)
    monkeypatch.setattr(hard_negatives, "LEAST_GROUPS", 5)
    monkeypatch.setattr(hard_negatives, "TILE", 3)


@pytest.mark.parametrize(("n", "dims"), [(900, 5), (400, 64), (60, 1)])
def test_equals_the_plain_search(spark, small_blocks, n, dims):
    rows = clustered(n, n, dims)
    made = hard_negatives.mine(table(spark, rows).repartition(4), ANCHOR)
    want = plain(rows)
    assert want and found(made) == want


def test_copies_ties_and_odd_rows(spark, small_blocks):
    copy = [0.5, 0.25, -1.0]
    rows = [(i, copy, i % 2) for i in range(0, 600, 2)] + [(i, copy, 3) for i in range(1, 300)]
    rows += [(700, None, 1), (800, [1.0, None, 2.0], 1), (900, [1.0, float("nan"), 0.0], 1), (1000, [float("inf"), 0.0, 0.0], 2), (1100, copy, None)]
    rows += [(None, copy, 1), (1200, [], 0), (1300, [0.4], 1), (100, [0.3, 0.2, -0.9], 3), (100, copy, 0), (1400, [-1.0, 0.0, 0.0], 9)]
    want = plain([(i, None if v is None else (v + [0.0] * 3)[:3], label) for i, v, label in rows])
    assert found(hard_negatives.mine(table(spark, rows).repartition(3), ANCHOR)) == want


def test_large_components_stay_exact(spark, small_blocks):
    random_ = random.Random(7)
    rows = [(i, [float(np.float32(random_.gauss(0, 3e5))) for _ in range(8)], i % 3) for i in range(300)]
    assert found(hard_negatives.mine(table(spark, rows), "id % 50 = 0")) == plain(rows, 50)


def test_empty_tables(spark):
    assert hard_negatives.mine(table(spark, []), ANCHOR).count() == 0
    assert hard_negatives.mine(table(spark, [(0, [1.0], 1)]), ANCHOR).count() == 0


def test_neighbours_on_the_curve_are_neighbours_in_space():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = hard_negatives.hilbert_keys(cells, bits)
        assert len(set(keys)) == len(cells)
        path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_blocks_are_skipped_by_their_bounds(monkeypatch):
    near, far = np.full((4, 2), 10), np.full((4, 2), -10)
    ids, labels = np.arange(4), np.zeros(4, np.int64)
    made = []
    for vectors, shift in ((near, 0), (far, 4)):
        made.append((ids + shift, labels, vectors, vectors.min(0), vectors.max(0)))
    reads = []

    class Read(np.ndarray):
        def __array_finalize__(self, other):
            reads.append(None)

    made[1] = (*made[1][:2], made[1][2].view(Read), *made[1][3:])
    reads.clear()
    one = np.ones((1, 1), np.int64)
    out = hard_negatives._search(made, np.array([[1, 1]]), np.array([99]), np.array([5]), one * 5, one * 100, 10, False, True)
    assert [r[3] for r in out.tolist()] == [0, 1, 2, 3] and not reads


def test_query(spark):
    rows = [(r.vec_id, r.embedding, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert found(op12_hard_negatives(spark, SF)) == plain(rows)
