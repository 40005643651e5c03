"""Structured Streaming use of the batch operators.

The reference is batch-only; these are the streaming forms of the parts
that need no global order: per-row cleaning, scoring with a fitted
``PipelineModel``, conformal intervals with a fixed q_hat, and event-time
block medians with a watermark (W12 on a stream: a block is emitted once
the watermark passes its end, so state stays bounded).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sinter.functions.clean import SENTINEL, clean_number


def clean_stream(stream: DataFrame, text_cols, sentinels=(SENTINEL,)) -> DataFrame:
    """P12-P15 on a stream (stateless projection)."""
    return stream.withColumns({c: clean_number(c, sentinels) for c in text_cols})


def score_stream(stream: DataFrame, model, q_hat: float | None = None,
                 prediction: str = "prediction") -> DataFrame:
    """Apply a fitted pipeline; with ``q_hat`` add the conformal interval."""
    out = model.transform(stream)
    if q_hat is not None:
        out = out.withColumns({"lower": F.col(prediction) - F.lit(q_hat),
                               "upper": F.col(prediction) + F.lit(q_hat)})
    return out


def block_medians_stream(stream: DataFrame, ts: str, key: str, value: str,
                         every: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Event-time tumbling-window median per key (long form: window start,
    key, median); late rows beyond the watermark are dropped by Spark."""
    if dict(stream.dtypes).get(ts) == "timestamp_ntz":
        # watermarks need TIMESTAMP; with a UTC session the wall time is kept
        stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return (stream.withWatermark(ts, watermark)
            .groupBy(F.window(ts, every).alias("w"), key)
            .agg(F.percentile(value, 0.5).alias("median"), F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("ts"), key, "median", "n"))
