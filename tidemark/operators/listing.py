"""The listing of files: what lies where, in which language, and what is left out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dimensions
from tidemark.functions.text import base_name, clean_path, extension


def latest_scan(files: DataFrame) -> DataFrame:
    """Each path once, from its latest scan, with clean separators, the extension read from the path and null sizes kept.

    Rows of one path in one project are told apart by scanned_at, then file_id; a null path is a path like any other.
    """
    df = files.withColumn("path", clean_path(F.col("path"))).withColumn("extension", extension(base_name(F.col("path"))))
    newest = Window.partitionBy("project_id", "path").orderBy(F.desc_nulls_last("scanned_at"), F.desc("file_id"))
    return df.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def below(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Files with ``relative``, the path below their project's root; null where the file lies elsewhere.

    Projects are a dimension of fixed size, so Spark broadcasts them.
    """
    roots = projects.select(F.col("project_id").alias("_p"), F.concat(F.rtrim("root_path", F.lit("/")), F.lit("/")).alias("_root"))
    df = files.join(roots, F.col("project_id") == F.col("_p"), "left")
    return df.withColumn("relative", F.when(F.col("path").startswith(F.col("_root")), F.expr("substring(path, length(_root) + 1)"))).drop("_p", "_root")


def languages(files: DataFrame, least: float = 1.0, names: dict = dimensions.LANGUAGES) -> DataFrame:
    """language, files and share of all files in known languages, in per cent; languages below ``least`` are left out."""
    spark = files.sparkSession
    dim = dimensions.frame(spark, names.items(), "_ext string, language string")
    known = files.where(~F.coalesce("is_dir", F.lit(False))).join(F.broadcast(dim), F.col("extension") == F.col("_ext"))
    counts = known.groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    share = F.col("files") * 100.0 / counts.agg(F.sum("files")).scalar()
    return counts.withColumn("share", F.round(share, 6)).where(F.col("share") >= least)


def structure(files: DataFrame, purposes: dict = dimensions.PURPOSES) -> DataFrame:
    """directory, purpose and number of files: of top folders, or of second levels below those that are expanded."""
    spark = files.sparkSession
    parts = F.split("relative", "/")
    deep = parts[0].isin(*dimensions.EXPANDED) & (F.size(parts) >= 3)
    df = files.where(~F.coalesce("is_dir", F.lit(False)) & F.col("relative").contains("/"))
    counts = df.groupBy(F.when(deep, F.concat_ws("/", parts[0], parts[1])).otherwise(parts[0]).alias("directory")).agg(F.count(F.lit(1)).alias("files"))
    dim = lambda a: F.broadcast(dimensions.frame(spark, purposes.items(), f"_{a} string, _purpose_{a} string"))
    whole = counts.join(dim("whole"), F.lower("directory") == F.col("_whole"), "left")
    last = whole.join(dim("last"), F.substring_index(F.lower("directory"), "/", -1) == F.col("_last"), "left")
    return last.select("directory", F.coalesce("_purpose_whole", "_purpose_last", F.lit("")).alias("purpose"), "files")


def ignore_pattern(pattern: str) -> str | None:
    """Regular expression for a line of an ignore file, over a path below the root; null for blanks, comments, negations.

    A glob matches the name or the whole path and a star no slash; a leading slash binds to the root. A plain word
    matches anywhere in the path, as the listing has always done. A trailing slash is for folders, whose paths end in one.
    """
    pattern = pattern.strip()
    if not pattern or pattern[0] in "#!":
        return None
    tail = "/" if pattern.endswith("/") else ""
    pattern = pattern.rstrip("/")
    glob = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in pattern.lstrip("/"))
    if pattern.startswith("/"):
        return f"^{glob}{tail or '/?'}$"
    if "*" in pattern:
        return f"(?:^|/){glob}{tail or '/?'}$"
    return glob + tail


def ignored(patterns: tuple[str, ...] = dimensions.IGNORED, path: str = "relative") -> Column:
    """Whether a listing leaves a path out, by one expression for all patterns; a folder takes all below it along."""
    parts = [p for p in map(ignore_pattern, patterns) if p]
    # a pattern bound to the end of the path also holds for every folder above
    spread = [p[:-1] + "(?:$|/)" if p.endswith("/?$") else p for p in parts]
    return F.coalesce(F.col(path).rlike("|".join(s.replace("/?(?:$|/)", "(?:$|/)") for s in spread)), F.lit(False))


def key_files(files: DataFrame, names: dict = dimensions.KEY_FILES) -> DataFrame:
    """project_id, name, purpose and path of the first file of each name of note, the shallowest and then by path."""
    dim = dimensions.frame(files.sparkSession, names.items(), "_name string, purpose string")
    df = files.where(~F.coalesce("is_dir", F.lit(False))).withColumn("name", base_name(F.col("path")))
    df = df.join(F.broadcast(dim), F.col("name") == F.col("_name"))
    first = F.min(F.struct(F.size(F.split("path", "/")).alias("depth"), "path"))
    return df.groupBy("project_id", "name", "purpose").agg(first.alias("f")).select("project_id", "name", "purpose", F.col("f.path").alias("path"))


def workspaces(files: DataFrame, projects: DataFrame) -> DataFrame:
    """One row per project: name, files, bytes, folders, extensions and the most frequent extension (the first by name of equals)."""
    plain = ~F.coalesce("is_dir", F.lit(False))
    per = files.groupBy("project_id", "extension").agg(
        F.count_if(plain).alias("n"), F.sum(F.when(plain, F.coalesce("size", F.lit(0))).otherwise(0)).alias("b"), F.count_if(~plain).alias("d")
    )
    most = F.max_by(F.col("extension"), F.struct(F.col("n"), F.transform(F.split("extension", ""), lambda c: -F.ascii(c))))
    total = per.groupBy("project_id").agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"), F.sum("d").alias("folders"), F.count_if(F.col("n") > 0).alias("extensions"), most.alias("main_extension"))
    return projects.select("project_id", "name", "main_lang").join(total, "project_id", "left").fillna(0, ["files", "bytes", "folders", "extensions"])
