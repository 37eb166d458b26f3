"""The architecture of projects as their folders show it: style, layers, entry point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folders that are layers, in order, with their purpose.
LAYERS = (
    ("cmd", "Entry points / CLI"), ("api", "API handlers"), ("routers", "API routes"), ("blueprints", "Flask blueprints"), ("apps", "Django apps"), ("internal", "Private packages"),
    ("pkg", "Public packages"), ("domain", "Business logic"), ("services", "Service layer"), ("handlers", "Request handlers"), ("views", "View layer"), ("controllers", "Controllers"),
    ("models", "Data models"), ("schemas", "Data schemas"), ("repository", "Data access"), ("config", "Configuration"), ("middleware", "Middleware"),
)
#: Names of entry points, the first that exists counts; words of commands that only help.
ENTRIES = ("manage.py", "wsgi.py", "asgi.py", "app.py", "main.py", "run.py", "__main__.py")
HELPERS = ("gen", "doc", "test", "mock", "tool", "util", "example", "demo")
#: Styles in order: name and the folders of which each set needs one.
STYLES = (
    ("Standard Go Layout", (("cmd",), ("internal", "pkg"))), ("Clean Architecture", (("domain",), ("infrastructure", "adapters", "usecase", "delivery"))), ("Hexagonal Architecture", (("ports",), ("adapters",))),
    ("Monorepo", (("packages", "apps"),)), ("Feature-based Architecture", (("features", "modules"),)), ("Package Layout", (("internal", "pkg"),)), ("Source Layout", (("src", "lib", "app"),)),
)


def styles(files: DataFrame) -> DataFrame:
    """project_id and style: the first whose folders lie at the project's root; Flat Layout if none does. files: project_id, relative."""
    top = F.when(F.contains("relative", F.lit("/")), F.split_part("relative", F.lit("/"), F.lit(1)))
    names = sorted({n for _, sets in STYLES for s in sets for n in s})
    has = files.groupBy("project_id").agg(*[F.coalesce(F.bool_or(top == n), F.lit(False)).alias(f"_{n}") for n in names])
    out = F.lit("Flat Layout")
    for name, sets in reversed(STYLES):
        holds = F.lit(True)
        for s in sets:
            holds = holds & F.expr(" or ".join(f"_{n}" for n in s))
        out = F.when(holds, name).otherwise(out)
    return has.select("project_id", out.alias("style"))


def layers(files: DataFrame) -> DataFrame:
    """project_id, place, layer, purpose and packages (folders of the second level, in order) of each layer with any."""
    parts = F.split("relative", "/")
    names = F.array(*[F.lit(n) for n, _ in LAYERS])
    df = files.where(F.size(parts) >= 3).select("project_id", parts[0].alias("layer"), parts[1].alias("package")).where(F.array_contains(names, F.col("layer")))
    place = F.array_position(names, F.col("layer"))
    purpose = F.element_at(F.array(*[F.lit(p) for _, p in LAYERS]), place.cast("int"))
    # distinct folders only, so the set is as large as the second level of one folder
    return df.distinct().groupBy("project_id", "layer").agg(F.array_sort(F.collect_set("package")).alias("packages")).select("project_id", place.cast("bigint").alias("place"), "layer", purpose.alias("purpose"), "packages")


def entry_points(files: DataFrame) -> DataFrame:
    """project_id and path of the entry point: a name of ENTRIES at the root, else the main file of a command, the largest that isn't a helper."""
    root = F.array_position(F.array(*map(F.lit, ENTRIES)), F.col("relative"))
    main = F.col("relative").rlike(r"^(?:cmd/[^/]+/)?main\.[a-z]+$")
    helper = F.col("relative").rlike(f"^cmd/[^/]*(?:{'|'.join(HELPERS)})")
    order = F.struct(
        F.when(root > 0, root).otherwise(99), F.when(helper, 1).otherwise(0), -F.coalesce("size", F.lit(0)), F.col("relative"),
    )
    return files.where((root > 0) | main).groupBy("project_id").agg(F.min_by("relative", order).alias("path"))
