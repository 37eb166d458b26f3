"""Imports of source files: what they name, which frameworks they tell of, and what the folders of a project need of each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dimensions

#: Own rules: how the languages write an import, with the name as the only group.
PATTERNS = {
    (".js", ".ts", ".jsx", ".tsx", ".mjs"): r"(?:\bfrom|\bimport|\brequire\()\s*['\"]([^'\"]+)['\"]",
    (".py",): r"(?m)^[ \t]*(?:import|from)[ \t]+([\w.]+)",
    (".java", ".kt"): r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+)",
    (".rs",): r"(?m)^[ \t]*(?:pub )?use[ \t]+([\w:]+)",
    (".c", ".h", ".cpp"): r"(?m)^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"]+)[>\"]",
    (".go",): r"(?m)^(?:import[ \t]+|[ \t]+)(?:[\w.]+[ \t]+)?\"([^\"\n]+)\"",
}
#: Own table: what imports of a name, or of anything below it, tell of a project: name, category.
AREAS = {
    "os": ("operating system", "platform"), "sys": ("operating system", "platform"), "fmt": ("formatted text", "text"), "std::fmt": ("formatted text", "text"), "stdio.h": ("standard streams", "io"), "std": ("standard library", "platform"),
    "java": ("standard library", "platform"), "java.util": ("collections", "data"), "std::collections": ("collections", "data"), "json": ("JSON", "data"), "encoding/json": ("JSON", "data"), "logging": ("logging", "operation"),
    "flask": ("Flask", "web"), "fastapi": ("FastAPI", "web"), "django": ("Django", "web"), "express": ("Express", "web"), "react": ("React", "web"), "vue": ("Vue", "web"), "net/http": ("HTTP", "web"), "github.com/gin-gonic/gin": ("Gin", "web"),
    "torch": ("PyTorch", "learning"), "tensorflow": ("TensorFlow", "learning"), "sklearn": ("scikit-learn", "learning"), "jax": ("JAX", "learning"), "xgboost": ("XGBoost", "learning"), "transformers": ("Transformers", "learning"), "numpy": ("NumPy", "data"),
    "pandas": ("pandas", "data"), "pyspark": ("PySpark", "data"), "pytest": ("pytest", "tests"), "unittest": ("unittest", "tests"), "testing": ("testing", "tests"), "jest": ("Jest", "tests"), "click": ("click", "commands"), "argparse": ("argparse", "commands"),
    "flag": ("flag", "commands"), "github.com/spf13/cobra": ("Cobra", "commands"), "clap": ("clap", "commands"), "sqlalchemy": ("SQLAlchemy", "storage"), "database/sql": ("database/sql", "storage"), "org.springframework": ("Spring", "web"),
}
_BREAK = r"[./:]+"


def every_import(src: DataFrame) -> DataFrame:
    """project_id, file_id, path, extension, relative, walk_ord and name: each name that a file imports, once."""
    names = F.lit(None).cast("array<string>")
    for extensions, pattern in PATTERNS.items():
        names = F.when(F.col("extension").isin(*extensions), F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).otherwise(names)
    return src.select("project_id", "file_id", "path", "extension", "relative", "walk_ord", F.explode(F.array_distinct(names)).alias("name"))


def prefixes(name: Column) -> Column:
    """A name and all that it stands below, from the longest: ``a.b.c``, ``a.b``, ``a``; also for ``/`` and ``::``."""
    ends = F.regexp_extract_all(name, F.lit(rf"(.*?)(?:{_BREAK}|$)"), F.lit(1))
    marks = F.regexp_extract_all(name, F.lit(rf".*?({_BREAK}|$)"), F.lit(1))
    pieces = F.zip_with(ends, marks, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    counts = F.sequence(F.size(pieces), F.lit(1), F.lit(-1))
    joined = lambda n: F.aggregate(F.slice(pieces, F.lit(1), n), F.lit(""), lambda s, x: F.concat(s, x["a"], x["b"]))
    return F.array_distinct(F.filter(F.transform(counts, lambda n: F.regexp_replace(joined(n), rf"{_BREAK}$", "")), lambda x: x != ""))


def told(imports: DataFrame, areas: dict = AREAS, examples: int = 3) -> DataFrame:
    """framework, category, number of files and the first files in walk order: of each import the longest name counts that the table holds."""
    dim = dimensions.frame(imports.sparkSession, [(k, *v) for k, v in areas.items()], "_prefix string, framework string, category string")
    names = imports.select("name").distinct().select("name", F.posexplode(prefixes(F.col("name"))).alias("pos", "prefix"))
    met = names.join(F.broadcast(dim), F.col("prefix") == F.col("_prefix")).groupBy(F.col("name").alias("_name")).agg(F.min_by(F.struct("framework", "category"), "pos").alias("t"))
    hits = imports.join(met, F.col("name") == F.col("_name")).select("file_id", "path", "walk_ord", "t.framework", "t.category").distinct()
    rank = Window.partitionBy("framework", "category").orderBy("walk_ord", "file_id")
    first = hits.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= examples)
    shown = first.groupBy(F.col("framework").alias("_f"), F.col("category").alias("_c")).agg(F.array_sort(F.collect_list(F.struct("_n", "path"))).alias("e"))
    counts = hits.groupBy("framework", "category").agg(F.count(F.lit(1)).alias("files"))
    return counts.join(shown, F.expr("framework = _f and category = _c")).select("framework", "category", "files", F.col("e.path").alias("examples"))


def packages(src: DataFrame, imports: DataFrame) -> DataFrame:
    """project_id, package (folder), files, tests, names (distinct imports, in order) and main: whether it holds an entry point.

    Names are a set per folder, as large as what its files import.
    """
    folder = F.regexp_replace("relative", "/?[^/]*$", "")
    name = F.substring_index("relative", "/", -1)
    own = src.where("relative is not null").groupBy("project_id", folder.alias("package")).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(name.rlike(r"(?:_test|\.test|\.spec)\.[a-z]+$|^test_")).alias("tests"), F.bool_or(name.rlike(r"^(?:main|index|__main__)\.[a-z]+$")).alias("main")
    )
    used = imports.where("relative is not null").groupBy(F.col("project_id").alias("_p"), folder.alias("_f")).agg(F.array_sort(F.collect_set("name")).alias("names"))
    return own.join(used, F.expr("project_id <=> _p and package = _f"), "left").select("project_id", "package", "files", "tests", "main", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def layer_needs(edges: DataFrame) -> DataFrame:
    """project_id, layer and needs: the other top folders that the files below a top folder import, in order. edges: project_id, src, dst."""
    top = lambda c: F.substring_index(c, "/", 1)
    pairs = edges.select("project_id", top("src").alias("layer"), top("dst").alias("need")).where("layer <> need").distinct()
    return pairs.groupBy("project_id", "layer").agg(F.array_sort(F.collect_set("need")).alias("needs"))
