"""Commands of projects: categories by ordered rules, one of each kind by priority, and a short list of the most useful."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dimensions
from tidemark.functions.text import normalize_command
from tidemark.operators.lines import commented, lines

#: Categories of which a short list shows one each before it shows a second.
IMPORTANT = ("build", "test", "lint", "format", "run", "install")


def category(command: Column, rules: list[tuple[str, str]] = dimensions.COMMAND_RULES) -> Column:
    """Category by the first rule that matches, in any case; other if none does."""
    out = F.lit("other")
    for pattern, name in reversed(rules):
        out = F.when(F.lower(command).rlike(pattern), name).otherwise(out)
    return out


def priority(name: Column) -> Column:
    order = F.array(*map(F.lit, dimensions.CATEGORIES))
    return F.array_position(order, name).cast("bigint")


def prioritized(commands: DataFrame, keys: list[str]) -> DataFrame:
    """keys, command, category, priority and rank: commands that differ in spelling only are one, the first by priority and name.

    commands: keys and command. Null commands are left out.
    """
    df = commands.where("command is not null").withColumn("category", category(F.col("command")))
    df = df.withColumns({"priority": priority(F.col("category")), "_norm": normalize_command(F.col("command"))})
    first = Window.partitionBy(*keys, "_norm").orderBy("priority", "command")
    df = df.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("priority", "command"))
    return df.withColumn("rank", rank.cast("bigint")).select(*keys, "command", "category", "priority", "rank")


def quick(ranked: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """The short list: one command of each important category, then the others by rank, at most so many."""
    of_kind = F.row_number().over(Window.partitionBy(*keys, "category").orderBy("rank"))
    late = F.when(F.col("category").isin(*IMPORTANT) & (of_kind == 1), 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_late", "rank"))
    df = ranked.withColumn("_late", late).withColumn("place", place.cast("bigint"))
    return df.where(F.col("place") <= most).select(*keys, "place", "command", "category")


#: Own table: commands that a project has because of a file at its root: file, pattern of its content (empty: any), commands with their purpose.
GIVEN = (
    ("go.mod", "", (("go build ./...", "Build all packages"), ("go test ./...", "Run all tests"), ("go vet ./...", "Look for mistakes"))),
    ("Cargo.toml", "", (("cargo build", "Build"), ("cargo test", "Run all tests"), ("cargo clippy", "Look for mistakes"), ("cargo fmt", "Format"))),
    ("pyproject.toml", r"(?m)^\[tool\.pytest|\bpytest\b", (("pytest", "Run all tests"),)), ("pyproject.toml", r"(?m)^\[tool\.ruff", (("ruff check .", "Look for mistakes"), ("ruff format .", "Format"))),
    ("pyproject.toml", r"(?m)^\[tool\.mypy", (("mypy .", "Check types"),)), ("requirements.txt", "", (("pip install -r requirements.txt", "Install what is needed"),)), ("manage.py", "", (("python manage.py runserver", "Start the server"), ("python manage.py test", "Run all tests"))),
    ("pom.xml", "", (("mvn package", "Build"), ("mvn test", "Run all tests"))), ("docker-compose.yml", "", (("docker compose up", "Start all services"),)),
)


def of_scripts(manifests: DataFrame, managers: DataFrame) -> DataFrame:
    """project_id, command and purpose of each script of a manifest, called by the project's package manager; npm without one.

    manifests: project_id and m (see sources.trees). managers: project_id and manager.
    """
    df = manifests.select("project_id", F.explode("m.scripts").alias("script", "purpose"))
    by = managers.select(F.col("project_id").alias("_p"), "manager")
    name = F.coalesce("manager", F.lit("npm"))
    run = F.when(name == "yarn", F.lit("yarn ")).otherwise(F.concat(name, F.lit(" run ")))
    return df.join(by, F.expr("project_id <=> _p"), "left").select("project_id", F.concat(run, "script").alias("command"), "purpose")


def of_makefiles(src: DataFrame) -> DataFrame:
    """project_id, command and purpose of each target of a makefile; the purpose is the comment before it, or behind it after ``##``.

    src: file_id, project_id, path, content. Targets that begin with a dot or hold variables or patterns aren't commands.
    """
    rows = lines(src.where(F.col("path").rlike(r"(?:^|/)(?:GNUm|M|m)akefile$")), "file_id", "content", ("project_id",))
    named = commented(rows, "file_id", r"^([A-Za-z0-9][\w./-]*)[ \t]*:(?![=])", r"^#+[ \t]*(.+?)[ \t]*$", keep=("project_id", "row"))
    behind = F.nullif(F.regexp_extract("row", r"##[ \t]*(.+?)[ \t]*$", 1), F.lit(""))
    return named.select("project_id", F.concat(F.lit("make "), "name").alias("command"), F.coalesce(behind, "comment").alias("purpose")).distinct()


def of_programs(src: DataFrame) -> DataFrame:
    """project_id, command and purpose of the subcommands that sources declare with a use and a short text.

    A declaration is a use text followed by a short text, with no other use between them; the command is its first word.
    """
    pattern = r"(?s)\bUse:\s*\"([^\"\s]+)[^\"]*\"(?:(?!\bUse:).)*?\bShort:\s*\"([^\"]*)\""
    every = lambda g: F.regexp_extract_all("content", F.lit(pattern), F.lit(g))
    pairs = F.arrays_zip(every(1).alias("c"), every(2).alias("s"))
    return src.where(F.contains("content", F.lit("Short:"))).select("project_id", F.explode(pairs).alias("x")).select("project_id", F.col("x.c").alias("command"), F.col("x.s").alias("purpose")).distinct()


def given(src: DataFrame, table=GIVEN) -> DataFrame:
    """project_id, command and purpose of the commands that a file at a project's root brings along. src: project_id, relative, content."""
    rows = F.flatten(F.array(*[
        F.when((F.col("relative") == f) & (F.col("content").rlike(p) if p else F.lit(True)), F.array(*[F.struct(F.lit(c).alias("command"), F.lit(t).alias("purpose")) for c, t in told])).otherwise(
            F.array().cast("array<struct<command:string,purpose:string>>")
        )
        for f, p, told in table
    ]))
    return src.where(F.col("relative").isin(*sorted({f for f, _, _ in table}))).select("project_id", F.explode(rows).alias("r")).select("project_id", "r.command", "r.purpose").distinct()
