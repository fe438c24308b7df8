"""Drift between a reference and a current table: population stability and mean shift, for many columns at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import checkpointed, quantiles
from ..functions.scalars import div


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    rows = df.select(*[F.col(c).cast("double") for c in columns]).unpivot([], columns, "feature", "x")
    return rows.filter(F.col("x").isNotNull() & ~F.isnan("x"))


def stability(reference: DataFrame, current: DataFrame, columns: list[str], bins: int = 10, epsilon: float = 1e-8, psi_from: float = 0.2, shift_from: float = 3.0) -> DataFrame:
    """Per column: psi over the reference's quantile bins, mean_shift in reference deviations, and whether either is beyond its threshold.

    Equal edges are one. Current values beyond the outer edges count in no bin. The last bin includes its right edge.
    One row for each column and bin leaves the aggregations, whatever the size of the tables.
    """
    ref, cur = _long(reference, columns), _long(current, columns)
    moments = ref.groupBy("feature").agg(F.avg("x").alias("_m"), F.stddev_samp("x").alias("_s"), F.count("x").alias("_n"))
    cuts = quantiles(ref, "x", [k / bins for k in range(bins + 1)], ("feature",)).select("feature", F.array_sort(F.array_distinct("q")).alias("edges"))
    stats = checkpointed(moments.join(F.broadcast(cuts), "feature"))  # one row for each column of the table, worked out once
    edges = F.broadcast(stats.select("feature", "edges"))

    def histogram(rows: DataFrame, name: str) -> DataFrame:
        inside = rows.join(edges, "feature").filter((F.col("x") >= F.get("edges", F.lit(0))) & (F.col("x") <= F.get("edges", F.size("edges") - 1)))
        # The last edge at or below the value, but at most the one before the last.
        bin_ = F.least(F.size(F.filter("edges", lambda e: e <= F.col("x"))) - 1, F.greatest(F.size("edges") - 2, F.lit(0)))
        return inside.groupBy("feature", bin_.alias("bin")).agg(F.count(F.lit(1)).alias(name))

    totals = cur.groupBy("feature").agg(F.count("x").alias("_cn"), F.avg("x").alias("_cm"))
    grid = stats.withColumn("bin", F.explode(F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0)))))
    both = grid.join(histogram(ref, "_r"), ["feature", "bin"], "left").join(histogram(cur, "_c"), ["feature", "bin"], "left").join(totals, "feature", "left")
    inside = both.groupBy("feature").agg(F.sum("_c").alias("_inside"))
    both = both.join(inside, "feature", "left")
    r = F.greatest(div(F.coalesce("_r", F.lit(0)), F.col("_n"), 0.0), F.lit(epsilon))
    c = F.greatest(div(F.coalesce("_c", F.lit(0)), F.col("_inside"), 0.0), F.lit(epsilon))
    out = both.groupBy("feature").agg(F.sum(F.when(F.size("edges") > 1, (c - r) * F.ln(c / r)).otherwise(0.0)).alias("psi"), F.first("_m").alias("_m"), F.first("_s").alias("_s"), F.first("_cm").alias("_cm"))
    shift = F.abs(F.col("_cm") - F.col("_m")) / (F.coalesce("_s", F.lit(0.0)) + epsilon)
    return out.select("feature", "psi", shift.alias("mean_shift"), ((F.col("psi") > psi_from) | (shift > shift_from)).alias("drifted"))


def metric_drop(reference: float, current: float, threshold: float = 0.05) -> bool:
    return reference - current > threshold
