"""Embedding drift: a one-row fingerprint of the embedding model, and the verdict on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..settings import get_settings

FINGERPRINT = "model_name string, probe_text string, probe_embedding array<double>, recorded_at timestamp"
PROBE = "The quick brown fox jumps over the lazy dog."


def record(probe: DataFrame, model_name: str) -> DataFrame:
    """The fingerprint of (probe_embedding); empty where the embedder is unavailable."""
    return probe.where("probe_embedding is not null").limit(1).select(
        F.lit(model_name).alias("model_name"), F.lit(PROBE).alias("probe_text"), F.col("probe_embedding").cast("array<double>"), F.current_timestamp().alias("recorded_at")
    )


def check(fingerprint: DataFrame, probe: DataFrame, model_name: str, threshold: float | None = None) -> DataFrame:
    """For each row of probe (probe_embedding, and any columns that name it): drifted, reason, similarity. The first that holds decides:
    no_fingerprint, model_changed, embedder_unavailable, vector_changed, same.
    """
    threshold = get_settings().drift_similarity_threshold if threshold is None else threshold
    named = [c for c in probe.columns if c != "probe_embedding"]
    old = fingerprint.limit(1).agg(F.first("model_name").alias("_model"), F.first("probe_embedding").alias("_then"))
    both = probe.join(F.broadcast(old))  # one row
    now, then = F.col("probe_embedding"), F.col("_then")
    sim = F.when(F.size(now) == F.size(then), cosine(now, then)).otherwise(F.lit(0.0))
    reason = (
        F.when(F.col("_model").isNull(), "no_fingerprint")
        .when(F.col("_model") != model_name, "model_changed")
        .when(now.isNull(), "embedder_unavailable")
        .when(sim < threshold, "vector_changed")
        .otherwise("same")
    )
    out = both.select(*named, reason.alias("reason"), sim.alias("_s"))
    return out.select(
        *named,
        F.col("reason").isin("model_changed", "vector_changed").alias("drifted"),
        "reason",
        F.when(F.col("reason").isin("model_changed"), F.lit(0.0)).when(F.col("reason").isin("no_fingerprint", "embedder_unavailable"), F.lit(1.0)).otherwise(F.col("_s")).alias("similarity"),
    )
