"""Sums of overlaps without pairs, against pairs."""

from __future__ import annotations

import random

from chronolex.operators import intervals as iv
from chronolex.operators import speakers as sp


def made(seed, n, m):
    r = random.Random(seed)
    at = lambda: round(r.uniform(0, 40), 1)
    turns = [(r.randrange(3), i, r.choice("abc"), s, s + r.choice([0.0, 0.5, 3.0, 20.0])) for i in range(n) for s in (at(),)]
    pieces = [(r.randrange(4), i, None, s, s + r.choice([0.5, 2.0, 10.0])) for i in range(m) for s in (at(),)]
    return pieces, turns


def over(p, t):
    return p[0] == t[0] and p[3] < t[4] and t[3] < p[4]


def test_talked_and_assigned_against_pairs(spark):
    for seed in range(6):
        pieces, turns = made(seed, 60, 50)
        p = spark.createDataFrame(pieces, "media_id long, piece_idx long, speaker string, start double, end double")
        t = spark.createDataFrame(turns, "media_id long, turn_idx long, speaker string, start double, end double")
        want, who = {}, {}
        for x in pieces:
            for s in "abc":
                own = [y for y in turns if y[2] == s and over(x, y)]
                if own:
                    want[x[1], s] = (round(sum(min(x[4], y[4]) - max(x[3], y[3]) for y in own), 6), len(own), max(y[1] for y in own))
            best = sorted((-v[0], v[2], s) for (i, s), v in want.items() if i == x[1])
            who[x[1]] = best[0][2] if best else None
        got = {(r["piece_idx"], r["speaker"]): (round(r["seconds"], 6), r["n"], r["last"]) for r in iv.talked(p.drop("speaker"), t).collect()}
        assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
        assert all(v[2] in (None, want[k][2]) for k, v in got.items())
        assert {r["piece_idx"]: r["speaker"] for r in sp.assign(p, t).collect()} == who


def test_no_turns(spark):
    p = spark.createDataFrame([(1, 1, "x", 0.0, 1.0)], "media_id long, piece_idx long, speaker string, start double, end double")
    t = spark.createDataFrame([], "media_id long, turn_idx long, speaker string, start double, end double")
    assert iv.talked(p.drop("speaker"), t).count() == 0
    assert [r["speaker"] for r in sp.assign(p, t).collect()] == ["x"]
