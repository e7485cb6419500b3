"""Structured Streaming monitors: windowed rates and PSI of an event stream against fixed bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.binning import MISSING, SPECIAL, BinModel
from ..operators.stability import psi_term


def windowed_rate(events: DataFrame, ts: str, flag: Column, window: str = "1 day", delay: str = "1 hour", by: list[str] | None = None, slide: str | None = None) -> DataFrame:
    """(start, end, by..., n, bad, bad_rate) per tumbling or sliding window; rows later than ``delay`` behind the watermark are dropped by the stream.

    Works on streams and tables alike; state is one row per open window and group.
    """
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    t = events.withWatermark(ts, delay).groupBy(w.alias("w"), *(by or [])).agg(F.count("*").alias("n"), F.count_if(flag).alias("bad"))
    return t.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(by or []), "n", "bad", (F.col("bad") / F.col("n")).alias("bad_rate"))


def windowed_psi(events: DataFrame, ts: str, model: BinModel, expected: dict[int, float], window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(start, n, psi) of each window against fixed expected bin shares; bins that ``expected`` lacks count as 0 there.  One state row per window."""
    bins = sorted({*expected, MISSING, SPECIAL, *range(model.n_bins)})
    x = events.withColumn("_b", model.index())
    t = x.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("n"), *[F.count_if(F.col("_b") == b).alias(f"c{i}") for i, b in enumerate(bins)])
    total = sum((psi_term(F.lit(float(expected.get(b, 0.0))), F.col(f"c{i}") / F.col("n")) for i, b in enumerate(bins)), F.lit(0.0))
    return t.select(F.col("w.start").alias("start"), "n", total.alias("psi"))
