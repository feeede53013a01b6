"""Change of a signal's rate by a polyphase windowed-sinc filter, over chunks of samples.

A chunk's task gets the samples of its neighbours that the filter reaches into, so one long medium is spread over many tasks
and chunks give what the whole would.  Signals are (media_id, sample_idx, v).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Zero crossings of the sinc on each side, and input samples in a chunk.
CROSSINGS, CHUNK = 16, 16_384
#: Share of the new band that is let through.
PASSED = 0.94


def kernel(x: float, cutoff: float, half: float) -> float:
    """Sinc low-pass of `cutoff` (1: half the input rate) at x input samples, in a Blackman window of `half` on each side."""
    if abs(x) >= half:
        return 0.0
    sinc = 1.0 if x == 0 else math.sin(math.pi * cutoff * x) / (math.pi * cutoff * x)
    return sinc * (0.42 + 0.5 * math.cos(math.pi * x / half) + 0.08 * math.cos(2 * math.pi * x / half))


def phases(up: int, down: int, crossings: int = CROSSINGS) -> tuple[int, list[list[float]]]:
    """(reach, taps): for each of `up` phases the weights of the input samples from -reach to +reach around an output sample's
    place, rounded down; they add up to 1, so a constant stays what it is."""
    cutoff = min(1.0, up / down) * PASSED
    half = crossings / cutoff
    reach = math.ceil(half)
    rows = []
    for phase in range(up):
        taps = [kernel(j - phase / up, cutoff, half) for j in range(-reach, reach + 1)]
        total = math.fsum(taps)
        rows.append([x / total for x in taps])
    return reach, rows


def resampled(samples: DataFrame, source_rate: int, target_rate: int, *, crossings: int = CROSSINGS, chunk: int = CHUNK) -> DataFrame:
    """samples at target_rate: output sample n stands at input place n * source_rate / target_rate.

    A medium whose last sample is N - 1 has ceil(N * target_rate / source_rate) samples then.  Samples that are missing or
    null are silence, as is what lies outside.
    """
    common = math.gcd(source_rate, target_rate)
    up, down = target_rate // common, source_rate // common
    reach, taps = phases(up, down, crossings)
    sizes = samples.groupBy("media_id").agg((F.max("sample_idx") + 1).cast("long").alias("size"))
    at = F.col("sample_idx").cast("long")
    chunks = F.sequence(F.floor(F.greatest(at - reach, F.lit(0)) / chunk), F.floor((at + reach) / chunk))
    rows = samples.select("media_id", at.alias("sample_idx"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"), F.explode(chunks).alias("chunk"))
    # Chunks without own samples, in a gap that is longer than one, have outputs too; the last halo reaches beyond the end.
    held = rows.groupBy("media_id", "chunk").agg(F.collect_list("sample_idx").alias("at"), F.collect_list("v").alias("v"))
    every = sizes.select("media_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / chunk))).alias("chunk"))
    parts = every.join(held, ["media_id", "chunk"], "left")

    def run(frames):
        import numpy as np
        import pandas as pd

        weights = np.array(taps)
        for frame in frames:
            out = []
            for media, size, c, at, v in zip(frame["media_id"], frame["size"], frame["chunk"], frame["at"], frame["v"], strict=True):
                window = np.zeros(chunk + 2 * reach)
                if at is not None:
                    window[np.asarray(at, np.int64) - (c * chunk - reach)] = v
                first = -(-c * chunk * up // down)
                last = min(-(-(c + 1) * chunk * up // down), -(-size * up // down))
                n = np.arange(first, last)
                base, phase = n * down // up - c * chunk, n * down % up
                views = np.lib.stride_tricks.sliding_window_view(window, 2 * reach + 1)
                made = np.empty(len(n))
                for p in range(up):
                    made[phase == p] = views[base[phase == p]] @ weights[p]
                out.append(pd.DataFrame({"media_id": media, "sample_idx": n, "v": made}))
            if out:
                yield pd.concat(out)

    return parts.mapInPandas(run, "media_id long, sample_idx long, v double")
