"""The resampler: chunks against the whole, tones kept and removed, counts, gaps."""

from __future__ import annotations

import math

import numpy as np
import pytest

from chronolex.operators import resample as rs


def run(spark, v, a, b, **options):
    rows = v if len(v) == 0 or isinstance(v[0], tuple) else [(1, i, float(x)) for i, x in enumerate(v)]
    out = rs.resampled(spark.createDataFrame(rows, "media_id long, sample_idx long, v double"), a, b, **options).collect()
    return [r["v"] for r in sorted(out, key=lambda r: (r["media_id"], r["sample_idx"]))]


def plain(v, a, b):
    """Sum over all samples, one output after the other."""
    g = math.gcd(a, b)
    up, down = b // g, a // g
    reach, taps = rs.phases(up, down)
    out = []
    for n in range(-(-len(v) * up // down)):
        base, phase = n * down // up, n * down % up
        out.append(math.fsum(v[base + j] * taps[phase][j + reach] for j in range(-reach, reach + 1) if 0 <= base + j < len(v)))
    return out


@pytest.mark.parametrize(("a", "b"), [(48_000, 16_000), (44_100, 16_000), (16_000, 48_000), (8_000, 8_000)])
@pytest.mark.parametrize("chunk", [64, 100, 100_000])
def test_chunks_give_what_the_whole_gives(spark, a, b, chunk):
    v = np.random.default_rng(2).normal(size=1003).tolist()
    got = run(spark, v, a, b, chunk=chunk)
    assert len(got) == -(-1003 * b // a)
    assert np.allclose(got, plain(v, a, b), atol=1e-12)


def test_tones(spark):
    t = np.arange(9600) / 48_000
    low, high = np.sin(2 * np.pi * 1000 * t), np.sin(2 * np.pi * 10_000 * t)
    kept, gone = run(spark, low, 48_000, 16_000), run(spark, high, 48_000, 16_000)
    middle = slice(200, -200)
    assert np.abs(np.array(kept)[middle] - low[::3][middle]).max() < 1e-3
    assert np.abs(np.array(gone)[middle]).max() < 1e-3
    assert np.abs(high[::3][middle]).max() > 0.5  # plain decimation keeps it as another tone
    assert np.allclose(run(spark, np.ones(3000), 44_100, 16_000)[200:-200], 1.0)


def test_gaps_nulls_and_empty_signals(spark):
    rows = [(1, 0, 1.0), (1, 5000, 2.0), (2, 3, None), (3, 0, 4.0)]
    got = run(spark, rows, 48_000, 16_000, chunk=128)
    assert len(got) == 1667 + 2 + 1
    v = [0.0] * 5001
    v[0], v[5000] = 1.0, 2.0
    assert np.allclose(got[:1667], plain(v, 48_000, 16_000))
    assert got[1667:1669] == [0.0, 0.0]
    assert run(spark, [], 48_000, 16_000) == []
