"""What kind of project a project is: weighted evidence, the two best kinds and how sure the best is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dimensions


def project_kinds(files: DataFrame, evidence: list[tuple] = dimensions.PROJECT_EVIDENCE) -> DataFrame:
    """project_id, primary and secondary kind, score of the first and its share of all scores.

    Evidence holds where the share of a project's files with one of its extensions is large enough. Files are counted
    per project and extension first; evidence is held against those counts. Ties go by name. Projects without evidence
    are unknown, with score and confidence 0.
    """
    plain = files.where(~F.coalesce("is_dir", F.lit(False)))
    counts = plain.groupBy("project_id", "extension").agg(F.count(F.lit(1)).alias("n"))
    share = lambda ext: F.sum(F.when(F.col("extension").isin(*ext), F.col("n")).otherwise(0)) / F.sum("n")
    scores = [F.when(share(e) > least, F.lit(w)).otherwise(0.0).alias(f"e{i}") for i, (_, w, least, e) in enumerate(evidence)]
    per = counts.groupBy("project_id").agg(*scores)
    kinds = sorted({k for k, *_ in evidence})
    total = {k: sum((F.col(f"e{i}") for i, (kind, *_) in enumerate(evidence) if kind == k), F.lit(0.0)) for k in kinds}
    table = F.array(*[F.struct((-v).alias("minus"), F.lit(k).alias("kind")) for k, v in total.items()])
    best = F.filter(F.array_sort(table), lambda x: x["minus"] < 0)
    per = per.withColumn("_best", best)
    all_ = F.aggregate("_best", F.lit(0.0), lambda a, x: a - x["minus"])
    score = F.coalesce(-F.get("_best", F.lit(0))["minus"], F.lit(0.0))
    return per.select(
        "project_id", F.coalesce(F.get("_best", F.lit(0))["kind"], F.lit("unknown")).alias("kind"), F.coalesce(F.get("_best", F.lit(1))["kind"], F.lit("")).alias("second"),
        score.alias("score"), F.round(F.coalesce(F.try_divide(score, all_), F.lit(0.0)), 6).alias("confidence"),
    )
