"""Evaluation rollups of generation results against acceptance gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.measures import gates, rates


def rollup(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row of rates and means per group of (valid, render_enabled, rendered, succeeded, latency, ttft, tokens_per_second).

    Rates of no rows are 0; the render rate counts rows that tried; means pass over nulls.
    """
    by = by or []
    flags = {"validity_rate": F.coalesce(F.col("valid"), F.lit(False)), "render_rate": F.when(F.col("render_enabled"), F.coalesce(F.col("rendered"), F.lit(False))), "success_rate": F.coalesce(F.col("succeeded"), F.lit(False))}
    means = {"mean_latency": "latency", "mean_ttft": "ttft", "mean_tokens_per_second": "tokens_per_second"}
    parts = [F.coalesce(F.round(F.avg(c.cast("double")), 6), F.lit(0.0)).alias(n) for n, c in flags.items()]
    parts += [F.round(F.avg(c), 6).alias(n) for n, c in means.items()]
    return results.groupBy(*by).agg(F.count("*").alias("samples"), *parts)


def gated(results: DataFrame, by: list[str], thresholds: dict[str, float]) -> DataFrame:
    names = sorted({t[4:] for t in thresholds})
    return gates(rollup(results, by), by, names, thresholds)


def latency_stages(df: DataFrame, by: list[str], stages: list[str]) -> DataFrame:
    """Sums of the stages' seconds and of them all, rounded."""
    total = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in stages), F.lit(0.0))
    return df.groupBy(*by).agg(*[F.round(F.sum(s), 6).alias(s) for s in stages], F.round(F.sum(total), 6).alias("total"))


def report(metrics: DataFrame) -> tuple[dict, str]:
    """The single row of an evaluation as a dictionary and as text."""
    row = metrics.first().asDict()
    return row, "\n".join(f"{k}: {v}" for k, v in row.items())


__all__ = ["gated", "latency_stages", "rates", "report", "rollup"]
