"""Hard negatives against all pairs, scored one by one."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leagueflow.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, size string, row string, angles string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", "z") for i, v, label in rows], SCHEMA)


def plain(rows, every=100, positives=5, count=5):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    down = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for n, (i, v, label) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=False)), j, other) for m, (j, w, other) in enumerate(kept) if m != n]
        for ps, pid, _ in sorted((s for s in scored if s[2] == label), key=down)[:positives]:
            inside = sorted((s for s in scored if s[2] != label and 80 * ps <= 100 * s[0] <= 100 * ps), key=down)
            out += [(i, pid, k, j, ps, s) for k, (s, j, _) in enumerate(inside[:count], 1)]
    return sorted(out, key=repr)


def got(df, **kw):
    every = kw.pop("every", 100)
    out = negatives.hard_negatives(df, F.col("id") % every == 0, **kw)
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in out.collect()), key=repr)


def clustered(n, dims, seed, labels=4):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, dims))
    out = []
    for i in range(n):
        v = centres[rnd.integers(6)] + 0.3 * rnd.normal(size=dims)
        out.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(rnd.integers(labels))))
    return out


def test_clusters_in_any_layout(spark, monkeypatch):
    rows = clustered(700, 16, 1)
    want = plain(rows, every=20)
    assert want
    monkeypatch.setattr(negatives, "ROWS_AT_ONCE", 16)
    monkeypatch.setattr(negatives, "ANCHORS_AT_ONCE", 7)
    df = vectors(spark, rows)
    assert got(df, every=20) == want
    assert got(df.repartition(7), every=20, anchors_at_once=9) == want


def test_ties_and_very_many_copies_of_one_vector(spark):
    rnd = random.Random(2)
    rows = [(i, [0.5, 0.25, -0.5] if i % 3 else [rnd.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)], i % 3) for i in range(400)]
    rnd.shuffle(rows)
    assert got(vectors(spark, rows), every=25) == plain(rows, every=25)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = clustered(60, 4, 3, labels=2)
    rows += [(100, [1.0, None, 0.0, 0.0], 1), (200, None, 1), (300, [0.1, 0.2, 0.3, 0.4], None), (400, [nan, 0.0, 0.0, 0.0], 0), (500, [0.0, inf, 0.0, 0.0], 0)]
    rows += [(600, [], 0), (700, [0.0] * 4, 1), (None, rows[3][1], 0), (None, rows[4][1], 1), (800, [0.5], 0), (20, rows[20][1], rows[20][2]), (30, rows[5][1], rows[5][2]), (30, rows[5][1], rows[5][2])]
    rows += [(900, [3000.0, -2000.0, 1.0, 0.0], 1), (901, [2999.0, -2000.0, 1.0, 0.0], 0), (902, [2999.5, -2000.0, 0.0, 0.0], 1)]
    assert got(vectors(spark, rows).repartition(3), every=10) == plain(rows, every=10)


def test_empty_tables_and_single_rows(spark):
    assert got(vectors(spark, [])) == []
    assert got(vectors(spark, [(0, [1.0, 0.0], 1)])) == []
    assert got(vectors(spark, [(0, [], 1), (1, [], 1), (2, [], 2)])) == [(0, 1, 1, 2, 0, 0)]


def test_a_component_without_integer_is_refused(spark):
    with pytest.raises(Exception, match="32-bit integer"):
        got(vectors(spark, [(0, [1e30, 0.0], 1), (1, [1.0, 0.0], 1)]))


def test_bounds_hold_and_skip_rows(spark):
    rnd = np.random.default_rng(4)
    vec = np.floor(256 * np.array([r[1] for r in clustered(400, 32, 5)]))
    norm = np.sqrt((vec**2).sum(1))
    angle = negatives.angles_to(vec.astype(np.int64), norm, negatives.pick_references(vec[:100])).astype(np.float64)
    own = negatives.Block(np.arange(400), np.arange(400), np.zeros(400, bool), np.zeros(400), vec, norm, angle)
    a, b = own.take(np.arange(50)), own.take(rnd.permutation(400)[:300])
    low, high = negatives.score_bounds(a, b)
    exact = a.vector @ b.vector.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (negatives.slice_bound(a, b) >= exact.max(1)).all()
    assert (high < 0.8 * 256 * 256).mean() > 0.5  # other clusters need no scoring
