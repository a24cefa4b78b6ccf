"""Hard negatives against a plain search."""

import math
import random

import numpy as np
import pytest

from cohortmill.llm import negatives

KINDS = "vec_id bigint, embedding array<float>, label int, no string, v string, windows int"


def vectors(n=420, dims=19):
    rnd = random.Random(17)
    centres = [[rnd.gauss(0, .3) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [float(np.float32(c + rnd.gauss(0, .1))) for c in rnd.choice(centres)], rnd.choice([0, 1, 1, 1, 2, None]))
            for i in range(n)]
    same = rows[40][1]
    rows += [(1000 + i, same, i % 3) for i in range(60)]
    rows += [(2000, None, 1), (2010, [0.0] * dims, 1), (2020, [float("nan")] * dims, 1), (2030, [float("inf")] * dims, 0),
             (2040, [None] * dims, 0), (2050, [1.0, 2.0], 1), (2060, [1.5, 2.5], 0), (2070, [1.5, 2.0], 1), (2080, [], 0),
             (None, rows[0][1], 1), (None, rows[1][1], 0), (20, rows[20][1], 1), (20, rows[20][1], 1), (2090, [3e8] * dims, 1),
             (3000, [-x for x in same], 5), (3010, [-x for x in same], 5), (3001, [-x for x in rows[40][1]], 5)]
    return [(*r, "own", "v", 3) for r in rows]


def brute(rows, every):
    part = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab, *_ in rows
            if lab is not None and v is not None and all(x is not None and math.isfinite(x) and abs(x) < 1e5 for x in v)]
    key = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for a, (i, v, lab) in enumerate(part):
        if i is None or i % every:
            continue
        scored = [(j, sum(x * y for x, y in zip(v, w)), other == lab) for b, (j, w, other) in enumerate(part)
                  if b != a and len(w) == len(v)]
        others = sorted((s for s in scored if not s[2]), key=key)
        for p in sorted((s for s in scored if s[2]), key=key)[:5]:
            held = [s for s in others if 30 * p[1] <= 100 * s[1] <= 90 * p[1]][:10]
            out += [(i, p[0], r + 1, s[0], p[1], s[1]) for r, s in enumerate(held)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("sizes", [(7, 50, 16, 3), (2048, 16_384, 4096, 8)])
def test_against_plain_search(spark, monkeypatch, sizes):
    for name, size in zip(("ANCHOR_BLOCK", "CANDIDATE_BLOCK", "ROWS", "STEP"), sizes):
        monkeypatch.setattr(negatives, name, size)
    rows = vectors()
    got = negatives.hard_negatives(spark.createDataFrame(rows, KINDS), lambda i: i % 10 == 0)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows, 10)


def test_bounds_prune_and_lose_nothing():
    rnd = np.random.default_rng(3)
    v = rnd.integers(-90, 90, (3000, 64)).astype(float)
    v[:20, :] = v[0] + rnd.integers(-9, 9, (20, 64))
    block = negatives.Block(v, np.arange(3000), np.arange(3000), np.zeros(3000, int))
    seen = []

    def matters(low, high):
        seen.append(len(low))
        return high >= negatives.largest(low, 5)

    rows, scores = block.scan(v[0], np.ones(3000, bool), matters)
    exact = v @ v[0]
    assert (scores == exact[rows]).all() and set(np.argsort(-exact)[:5]) <= set(rows)
    assert seen[-1] < 600 and seen == sorted(seen, reverse=True)


def test_large_components_stay_exact(spark):
    rows = [(0, [60_000.0 + 1 / 256] * 600, 0), (1, [60_000.0] * 600, 0), (2, [30_000.0] * 600, 1), (3, [30_000.0 + 1 / 256] * 600, 1)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), lambda i: i == 0)
    x = 60_000 * 256 + 1
    assert [(r["rank"], r["negative_id"], r["negative_score"]) for r in got.orderBy("rank").collect()] == [
        (1, 3, x * (30_000 * 256 + 1) * 600), (2, 2, x * 30_000 * 256 * 600)]


def test_empty_and_no_anchor(spark):
    empty = spark.createDataFrame([], KINDS)
    assert negatives.hard_negatives(empty, lambda i: i % 10 == 0).collect() == []
    some = spark.createDataFrame(vectors(60), KINDS)
    assert negatives.hard_negatives(some, lambda i: i == 7777).collect() == []
