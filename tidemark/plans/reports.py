"""Results as text for people, and generated documents that keep what people wrote into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import bar, format_count
from tidemark.session import numbered

#: Marks around text that people keep in generated documents.
BEGIN, END = "<!-- custom:begin -->", "<!-- custom:end -->"


def bars(counts: DataFrame, name: str, n: str, width: int = 25) -> DataFrame:
    """One line of text per row: the name, its count and a bar against the largest; ordered by ``rank``."""
    most = counts.agg(F.max(n)).scalar()
    line = F.concat(F.rpad(name, 24, " "), F.lit(" "), F.lpad(format_count(F.col(n)), 8, " "), F.lit(" "), bar(F.col(n), F.col("_most"), width))
    return numbered(counts, "rank", -F.col(n), F.col(name)).withColumn("_most", most).select("rank", line.alias("line"))


def custom_blocks(existing: Column) -> Column:
    """The marked blocks of a document, with their marks, in order."""
    return F.regexp_extract_all(existing, F.lit(f"(?s){BEGIN}.*?{END}"), F.lit(0))


def merged(existing: Column, generated: Column) -> Column:
    """The generated text followed by the marked blocks of the document that it replaces, a blank line before each."""
    kept = F.coalesce(custom_blocks(existing), F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(F.rtrim(generated)), kept), "\n\n")


def yaml_text(value: Column) -> Column:
    """Quoted where YAML would read it otherwise."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(value.rlike(r"[:#\[\]{},&*!|>'\"%@`\n]|^\s|\s$|^$"), quoted).otherwise(value)


def tree_lines(files: DataFrame, depth: int = 3) -> DataFrame:
    """project_id, path and line: folders and files of a project drawn as a tree, in order of path. files: project_id, relative."""
    parts = F.split("relative", "/")
    above = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    df = files.where("relative is not null").select("project_id", F.explode(above).alias("path")).distinct()
    level = F.size(F.split("path", "/")) - 1
    return df.select("project_id", "path", F.concat(F.repeat(F.lit("  "), level), F.lit("- "), F.substring_index("path", "/", -1)).alias("line"))


def has_custom(existing: Column) -> Column:
    """Whether a document holds a marked block with something visible in it."""
    return F.coalesce(F.exists(custom_blocks(existing), lambda b: F.trim(F.regexp_replace(F.replace(F.replace(b, F.lit(BEGIN), F.lit("")), F.lit(END), F.lit("")), r"\s+", " ")) != ""), F.lit(False))


def without_marks(existing: Column) -> Column:
    """A document without its marks; what stood between them stays."""
    return F.replace(F.replace(existing, F.lit(BEGIN), F.lit("")), F.lit(END), F.lit(""))


def parts(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, ord, kind (custom or generated), title (the first heading of second order, or null) and body of the stretches of a document between marks."""
    marked = F.regexp_extract_all(text, F.lit(f"(?s){BEGIN}.*?{END}|(?:(?!{BEGIN}).)+"), F.lit(0))
    df = documents.select(key, F.posexplode(marked).alias("_at", "body"))
    df = df.withColumn("kind", F.when(F.startswith("body", F.lit(BEGIN)) & F.endswith("body", F.lit(END)), "custom").otherwise("generated"))
    title = F.nullif(F.regexp_extract("body", r"(?m)^##[ \t]+(.+?)[ \t]*$", 1), F.lit(""))
    return df.select(key, (F.col("_at") + 1).cast("bigint").alias("ord"), "kind", title.alias("title"), without_marks(F.col("body")).alias("body"))


def merged_by_title(existing: DataFrame, generated: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and text: the generated document with every marked block of the existing one behind the section of its title, else at the end."""
    old = parts(existing, key, text).where("kind = 'custom'").select(key, "ord", "title", F.concat(F.lit(BEGIN), "body", F.lit(END)).alias("block"))
    sections = F.regexp_extract_all(text, F.lit(r"(?s)(?:^|(?<=\n))(?:## |(?!## ).)(?:(?!\n## ).)*"), F.lit(0))
    new = generated.select(key, F.posexplode(sections).alias("_at", "body")).withColumn("title", F.nullif(F.regexp_extract("body", r"^\s*##[ \t]+(.+?)[ \t]*(?:\n|$)", 1), F.lit("")))
    place = new.where("title is not null").groupBy(F.col(key).alias("_k"), F.col("title").alias("_t")).agg(F.min("_at").alias("_p"))
    kept = old.join(place, F.expr(f"{key} <=> _k and title = _t"), "left").select(key, F.coalesce("_p", F.lit(1 << 30)).alias("_at"), "ord", F.col("block").alias("body"))
    every = new.select(key, "_at", F.lit(0).cast("bigint").alias("ord"), "body").unionByName(kept)
    items = F.array_sort(F.collect_list(F.struct("_at", "ord", F.trim("body", F.lit("\n")).alias("body"))))  # as many as a document has sections
    return every.groupBy(key).agg(F.array_join(F.transform(items, lambda x: x["body"]), "\n\n").alias(text))
