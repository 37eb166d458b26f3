"""Source trees, log folders and manifests as tables."""

from __future__ import annotations

import json
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tidemark.functions.instants import instant
from tidemark.functions.text import base_name, extension

_PAIRS = T.MapType(T.StringType(), T.StringType())
MANIFEST = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("version", T.StringType()), T.StructField("dependencies", _PAIRS),
    T.StructField("tools", T.ArrayType(T.StringType())), T.StructField("scripts", _PAIRS),
])


def tree(spark: SparkSession, root: str) -> DataFrame:
    """path below the root, name, extension, size and content (null where it isn't UTF-8 text) of all files below a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    inner = F.expr(f"substring(_path, length('{root.rstrip('/')}') + 2)")
    df = df.withColumn("_path", path).select(inner.alias("path"), F.col("length").alias("size"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"))
    return df.select("path", base_name(F.col("path")).alias("name"), extension(base_name(F.col("path"))).alias("extension"), "size", "content")


def folders(files: DataFrame) -> DataFrame:
    """Every folder above a file, each once: path."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.where(F.size(parts) > 1).select(F.explode(above).alias("path")).distinct()


def logs(spark: SparkSession, folder: str, since: str | None = None) -> DataFrame:
    """file_name, line and raw of all ``*.jsonl`` files of a folder, changed since a time if one is given."""
    reader = spark.read.format("text").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True)
    df = (reader.option("modifiedAfter", since) if since else reader).load(folder)
    return df.select(base_name(F.col("_metadata.file_path")).alias("file_name"), F.col("value").alias("raw"))


def _text(value) -> str:
    return value if isinstance(value, str) else value.get("version", "*") if isinstance(value, dict) else "*"


def _manifest(content: str | None, toml: bool) -> dict | None:
    try:
        d = tomllib.loads(content) if toml else json.loads(content)
    except (ValueError, TypeError):
        return None
    if not isinstance(d, dict):
        return None
    table = lambda x: x if isinstance(x, dict) else {}
    project, tool = table(d.get("project")), table(d.get("tool"))
    poetry, package = table(tool.get("poetry")), table(d.get("package"))
    wanted = {**table(d.get("devDependencies" if not toml else "dev-dependencies")), **table(d.get("dependencies")), **table(poetry.get("dependencies"))}
    listed = project.get("dependencies")
    for entry in listed if isinstance(listed, list) else []:
        name = entry.split(";")[0].split("[")[0].split("=")[0].split(">")[0].split("<")[0].split("~")[0].strip()
        wanted[name] = entry.split(";")[0].removeprefix(name).strip() or "*"
    wanted.pop("python", None)
    source = project or poetry or package or d
    first = lambda k: source.get(k) if isinstance(source.get(k), str) else None
    return {
        "name": first("name"), "version": first("version"), "dependencies": {k: _text(v) for k, v in wanted.items()}, "tools": sorted(tool),
        "scripts": {k: v for k, v in {**table(d.get("scripts")), **table(project.get("scripts")), **table(poetry.get("scripts"))}.items() if isinstance(v, str)},
    }


@pandas_udf(MANIFEST)
def toml_manifest(contents: pd.Series) -> pd.DataFrame:
    """Name, version, dependencies, tools and scripts of TOML manifests; all null where one doesn't parse."""
    return _frame(_manifest(x, True) for x in contents)


@pandas_udf(MANIFEST)
def json_manifest(contents: pd.Series) -> pd.DataFrame:
    """The same of JSON manifests."""
    return _frame(_manifest(x, False) for x in contents)


def _frame(rows) -> pd.DataFrame:
    names = MANIFEST.names
    return pd.DataFrame([r or dict.fromkeys(names) for r in rows], columns=names)


def ignore_patterns(files: DataFrame, names: tuple[str, ...] = (".gitignore", ".ignore")) -> DataFrame:
    """project_id and pattern: the lines of the ignore files at a project's root that name something. files: project_id, relative, content."""
    rows = F.explode(F.split(F.regexp_replace("content", r"\r\n?", "\n"), "\n"))
    line = files.where(F.col("relative").isin(*names)).select("project_id", rows.alias("pattern"))
    return line.withColumn("pattern", F.trim("pattern", F.lit(" \t"))).where("pattern <> '' and not startswith(pattern, '#')").distinct()


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """hash, author, at, subject of commits from text files with a commit a line, its parts separated by tabs.

    Such files are written by a version control system's own log command. Lines without four parts or with a time that
    can't be read are left out; the subject may hold tabs.
    """
    parts = F.split("value", "\t", 4)
    df = spark.read.text(folder, recursiveFileLookup=True).where(F.size(parts) == 4)
    return df.select(parts[0].alias("hash"), parts[1].alias("author"), instant(parts[2]).alias("at"), parts[3].alias("subject")).where("at is not null")


def repository(remote: Column) -> Column:
    """host, owner and name of a repository from the address of its remote, by web or by shell; null for other texts."""
    pattern = r"^(?:(?:https?|ssh|git)://(?:[^@/]+@)?|[^@/:]+@)([\w.-]+)(?::\d+)?[/:](.+)/([^/]+?)(?:\.git)?/?$"
    part = lambda g: F.regexp_extract(remote, pattern, g)
    return F.when(remote.rlike(pattern), F.struct(part(1).alias("host"), part(2).alias("owner"), part(3).alias("name")))


def project_folder(path: Column) -> Column:
    """The name of the folder in which sessions of a project at ``path`` are logged: its path with every sign but letters and digits as a hyphen."""
    return F.regexp_replace(path, "[^A-Za-z0-9]", "-")
