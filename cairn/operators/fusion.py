"""Evidence of several kinds fused into a status, its conflicts and its confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .conditions import STATUSES, status_of

#: Severity that a fused status may differ between two kinds without a conflict.
AGREE = 1.0


def fuse(components: DataFrame) -> DataFrame:
    """slug, eval_date, severity, status, conflicts, spread, score, confidence.

    ``components``: long rows (slug, eval_date, kind, severity, weight, age). Severity is
    the weighted mean. Kinds in conflict differ by more than AGREE. Confidence
    counts kinds, freshness and agreement.
    """
    one = F.struct("kind", "severity")
    out = components.groupBy("slug", "eval_date").agg(
        F.round(F.sum(F.col("severity") * F.col("weight")) / F.sum("weight"), 6).alias("severity"),
        F.array_sort(F.collect_list(one)).alias("parts"),
        F.count("*").alias("kinds"),
        F.min("age").alias("age"),
        (F.max("severity") - F.min("severity")).alias("spread"),
    )
    pairs = F.flatten(
        F.transform(
            "parts",
            lambda a: F.transform(
                F.filter("parts", lambda b: (b["kind"] > a["kind"]) & (F.abs(b["severity"] - a["severity"]) > AGREE)),
                lambda b: F.concat(a["kind"], F.lit("~"), b["kind"]),
            ),
        )
    )
    penalty = F.when(F.col("spread") > 1.5, 2).when(F.col("spread") > 0.8, 1).otherwise(0)
    score = F.col("kinds") * 2 + F.when(F.col("age") <= 2, 1).otherwise(0) - penalty
    out = out.withColumn("score", score.cast("int"))
    grade = F.when(F.col("score") >= 5, "high").when(F.col("score") >= 2.5, "moderate").otherwise("low")
    return out.select(
        "slug", "eval_date", "severity", status_of(F.col("severity")).alias("status"), F.array_join(pairs, ",").alias("conflicts"), "score", grade.alias("confidence")
    )


def status_strings(fused: DataFrame) -> DataFrame:
    """slug, codes: a digit per date in order of date; unknown is 9."""
    code = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")), F.lit(0)) - 1, F.lit(9)).cast("string")
    row = F.array_sort(F.collect_list(F.struct("eval_date", code.alias("c"))))
    return fused.groupBy("slug").agg(F.array_join(F.transform(row, lambda x: x["c"]), "").alias("codes"))
