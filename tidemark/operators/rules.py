"""Rules over the contents of files: keywords, regular expressions, imports that must be there, and gates.

All rules of a kind are held against a file in one pass: they lie in the plan as one array, so a file is read once
and no file is joined with the rules. What is left after the pass are the hits, which are counted per rule with the
first examples in walk order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXAMPLES = 3


def sources(files: DataFrame, contents: DataFrame, largest: int | None = None) -> DataFrame:
    """file_id, project_id, path, extension, relative, content and walk_ord of files with a content.

    ``largest``: contents of more bytes are left out; by default all are read, whatever their size.
    """
    c = contents.select(F.col("file_id").alias("_id"), "content", "walk_ord")
    df = files.where(~F.coalesce("is_dir", F.lit(False))).join(c, F.col("file_id") == F.col("_id"))
    fits = F.col("content").isNotNull() if largest is None else F.octet_length("content") <= largest
    return df.where(fits).select("file_id", "project_id", "path", "extension", "relative", "content", "walk_ord")


def _literal(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def keyword_hits(src: DataFrame, rules: list[tuple]) -> DataFrame:
    """file_id, path, walk_ord, section and name of each keyword in a file of its languages, if one of its imports is there or it asks for none."""
    table = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("name"), _literal(e).alias("ext"), _literal(i).alias("imports")) for s, k, e, i in rules])
    met = F.filter(
        table,
        lambda r: F.array_contains(r["ext"], F.col("extension")) & F.contains(F.col("content"), r["name"])
        & ((F.size(r["imports"]) == 0) | F.exists(r["imports"], lambda i: F.contains(F.col("content"), i))),
    )
    return src.select("file_id", "project_id", "path", "walk_ord", F.explode(met).alias("r")).select("file_id", "project_id", "path", "walk_ord", "r.section", "r.name")


def regex_hits(src: DataFrame, rules: list[tuple]) -> DataFrame:
    """file_id, path, walk_ord, section, name and number of matches of each regular expression that occurs in a file of its languages."""
    counts = F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), F.when(F.col("extension").isin(*e), F.regexp_count("content", F.lit(p))).otherwise(0).alias("matches"))
        for s, n, p, e in rules
    ])
    met = F.filter(counts, lambda r: r["matches"] > 0)
    return src.select("file_id", "project_id", "path", "walk_ord", F.explode(met).alias("r")).select("file_id", "project_id", "path", "walk_ord", "r.section", "r.name", "r.matches")


def patterns(hits: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """section, name, number of files and the paths of the first files in walk order.

    Examples are chosen in each task before the shuffle (the smallest few of partial aggregates), so a rule that every
    file meets costs no more than any other.
    """
    per = hits.groupBy("section", "name").agg(F.count(F.lit(1)).alias("files"))
    rank = Window.partitionBy("section", "name").orderBy("walk_ord", "file_id")
    # Spark keeps the first rows of each group before the shuffle (window group limit)
    first = hits.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= examples)
    shown = first.groupBy(F.col("section").alias("_s"), F.col("name").alias("_k")).agg(F.array_sort(F.collect_list(F.struct("_n", "path"))).alias("e"))
    return per.join(shown, F.expr("section = _s and name = _k")).select("section", "name", "files", F.col("e.path").alias("examples"))


def merged(base: DataFrame, more: DataFrame) -> DataFrame:
    """``base`` and those rows of ``more`` whose name it doesn't have yet."""
    return base.unionByName(more.join(base.select(F.col("name").alias("_k")).distinct(), F.col("name") == F.col("_k"), "left_anti"))


def gated(src: DataFrame, gate: Column, shut: bool = False) -> DataFrame:
    """Files of the projects in which the gate holds for a file, or (shut) for none."""
    open_ = src.where(gate).select(F.col("project_id").alias("_p")).distinct()
    return src.join(open_, F.col("project_id") == F.col("_p"), "left_anti" if shut else "left_semi")


def first_of_each(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group in a total order, for rules that look at samples."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= n).drop("_n")


def leading(hits: DataFrame, keys: tuple[str, ...] = ("project_id", "section"), least: int = 3) -> DataFrame:
    """keys, name and files: the rule that most files of a group meet, the first by name of equals, where at least ``least`` do."""
    counts = hits.groupBy(*keys, "name").agg(F.countDistinct("file_id").alias("files")).where(F.col("files") >= least)
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("files"), "name"))
    return counts.withColumn("_n", best).where("_n = 1").drop("_n")


def consolidated(hits: DataFrame, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """kind and number of files that meet any rule of it; rules without a kind are kinds of their own."""
    table = F.create_map(*[F.lit(x) for kind, names in kinds.items() for n in names for x in (n, kind)])
    kind = F.coalesce(F.try_element_at(table, F.col("name")), F.col("name"))
    return hits.groupBy(kind.alias("kind")).agg(F.countDistinct("file_id").alias("files"))
