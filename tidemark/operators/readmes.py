"""What a readme tells: bullets of named sections, shell commands in fences, model figures, the kind of project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lines import fenced

#: File names of readmes, the first that exists counts.
NAMES = ("README.md", "readme.md", "README", "README.rst", "README.txt", "Readme.md")
#: Sections that list what must be there beforehand.
PREREQUISITES = ("prerequisites", "requirements", "system requirements", "dependencies")
#: How shell commands begin.
COMMANDS = (
    "pip ", "npm ", "yarn ", "pnpm ", "cargo ", "go ", "python ", "python3 ", "node ", "npx ", "docker ", "docker-compose ", "kubectl ",
    "git ", "make ", "brew ", "apt ", "curl ", "wget ", "cd ", "mkdir ", "export ", "source ", "./", "$ ", "> ",
)
#: Own table: words that speak for a kind of document; callers may pass another.
KINDS = {
    "service": ("endpoint", "request", "server", "latency", "deploy"), "tool": ("command", "flag", "terminal", "option", "prompt"), "library": ("function", "import", "class", "package", "interface"),
    "data": ("table", "column", "query", "index", "schema"), "process": ("meeting", "decision", "review", "team", "owner"),
}
#: Own table: labels under which figures of models stand.
FIGURES = {
    "parameters": ("parameters", "parameter count", "params", "model size"), "context_length": ("context length", "context window", "sequence length", "max tokens"),
    "layers": ("layers", "number of layers"), "heads": ("heads", "attention heads", "number of heads"), "embedding": ("embedding size", "embedding dimension", "hidden size", "hidden dimension"),
}
#: A line or a row of a table that gives a number under a label.
_LABELLED = r"(?m)^[^\w\n]*([A-Za-z][A-Za-z _-]*?)[^\w\n]*[:|=][^\w\n]*([0-9][0-9.,]*(?: ?[A-Za-z]+)?)"


def section_bullets(rows: DataFrame, key: str, titles: tuple[str, ...] = PREREQUISITES) -> DataFrame:
    """key, ord and item: bullets under headings of these titles, in any case, each item once; nothing inside fences counts."""
    df = fenced(rows, key)
    head = F.when(~F.col("inside") & ~F.col("fence"), F.nullif(F.regexp_extract("row", r"^#{1,6} +(.+?)\s*$", 1), F.lit("")))
    df = df.withColumn("_head", head)
    so_far = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_title", F.lower(F.last("_head", ignorenulls=True).over(so_far)))
    item = F.regexp_extract("row", r"^[ \t]*[-*+] +(.*\S)", 1)
    df = df.where(F.col("_title").isin(*titles) & ~F.col("inside") & ~F.col("fence")).withColumn("item", item).where("item <> ''")
    once = df.groupBy(key, "item").agg(F.min("line").alias("_line"))
    order = F.row_number().over(Window.partitionBy(key).orderBy("_line"))
    return once.select(key, order.cast("bigint").alias("ord"), "item")


def shell_commands(rows: DataFrame, key: str, most: int = 15, longest: int = 200) -> DataFrame:
    """key, ord and command: lines in fences that begin like a command, without their prompt, each once, the first ``most``."""
    df = fenced(rows, key).where("inside").withColumn("_row", F.trim("row", F.lit(" \t")))
    likely = F.exists(F.array(*map(F.lit, COMMANDS)), lambda c: F.startswith(F.lower("_row"), c))
    df = df.where(likely & ~F.col("_row").startswith("#")).withColumn("command", F.regexp_replace(F.regexp_replace("_row", r"^\$ ", ""), "^> ", ""))
    df = df.where((F.col("command") != "") & (F.octet_length("command") < longest))
    once = df.groupBy(key, "command").agg(F.min("line").alias("_line"))
    order = F.row_number().over(Window.partitionBy(key).orderBy("_line"))
    return once.withColumn("ord", order.cast("bigint")).where(F.col("ord") <= most).select(key, "ord", "command")


def kind(text: Column, kinds: dict = KINDS, least: int = 2) -> Column:
    """The kind of which most words occur, the first of equals; other where fewer than ``least`` do. Null stays null."""
    low = F.lower(text)
    met = lambda words: F.aggregate(F.array(*[F.contains(low, F.lit(w)).cast("int") for w in words]), F.lit(0), lambda a, x: a + x)
    best = F.array_max(F.array(*[F.struct(met(words).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("kind")) for i, (name, words) in enumerate(kinds.items())]))
    return F.when(text.isNotNull(), F.when(best["n"] >= least, best["kind"]).otherwise("other"))


def figures(text: Column, labels: dict = FIGURES) -> Column:
    """Figures by name as a text gives them, digits without separators, the first of each; null if there are fewer than two."""
    table = F.create_map(*[F.lit(x) for name, words in labels.items() for w in words for x in (w, name)])
    every = lambda g: F.regexp_extract_all(text, F.lit(_LABELLED), F.lit(g))
    named = F.transform(every(1), lambda x: F.try_element_at(table, F.lower(F.regexp_replace(x, "[ _-]+", " "))))
    values = F.transform(every(2), lambda x: F.regexp_replace(x, ",(?=[0-9])|[.,]$", ""))
    pairs = F.filter(F.arrays_zip(named.alias("name"), values.alias("value")), lambda x: x["name"].isNotNull())
    names = F.transform(pairs, lambda x: x["name"])
    once = F.filter(pairs, lambda x, i: F.array_position(names, x["name"]) == i + 1)
    return F.when(F.size(once) >= 2, F.map_from_entries(once))


def first_of(files: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """The readme of each project: the first of the names that lies at its root. files: project_id, relative, content."""
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("relative"))
    return files.where(rank > 0).groupBy("project_id").agg(F.min_by("content", rank).alias("content"), F.min_by("relative", rank).alias("name"))
