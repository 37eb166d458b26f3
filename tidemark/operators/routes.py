"""Routes of web services, read from source lines by tables of rules.

A rule says how the documentation of a framework writes a route: where the path stands and which part of the text names
the methods. A framework's rules apply in projects whose sources name its package. Contents are split once; each line is
held against all rules of its language by one expression, and what matches is exploded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lines import lines

#: Order of methods.
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
_ANY = "|".join(METHODS)


@dataclass(frozen=True)
class Route:
    """package: what the sources of its projects name. pattern: one match per route, with a group for the path and one for
    the text that names the methods (0: none). A text without a method means ``method``. base: pattern of a path that
    stands before all others of the file. absent: the rule holds where no source names the package."""

    framework: str
    package: str
    extensions: tuple[str, ...]
    pattern: str
    path: int = 2
    methods: int = 1
    method: str = "ALL"
    base: str = ""
    absent: bool = False


def _call(name: str, *arguments: str) -> str:
    """A call or decorator with its first arguments; blanks may stand between them."""
    return rf"{name}\(\s*" + r"\s*,\s*".join(arguments)


#: A quoted text, and one that is kept.
_TEXT, _KEPT = r"""[rf]?["'`][^"'`]*["'`]""", r"""[rf]?["'`]([^"'`]*)["'`]"""
_ON = rf"(?i:\.({_ANY}|all|any))"
#: What follows a path up to the end of the statement, where methods may be named.
_REST = r"([^;\n]*)"
_JS, _GO = (".js", ".ts", ".mjs", ".jsx", ".tsx"), (".go",)
_GO_WEB = "gin-gonic/gin|labstack/echo|gofiber/fiber|go-chi/chi|gorilla/mux"
_CALL = _call(_ON, _KEPT)

ROUTES = (
    *[
        Route(name, package, _JS, pattern, path, methods)
        for name, package in (("express", r"['\"]express['\"]"), ("fastify", r"['\"]fastify['\"]"), ("hono", r"['\"]hono['\"/]"))
        for pattern, path, methods in ((_CALL, 2, 1), (_call(r"\.route", _KEPT) + r"\s*\)" + _REST, 1, 2))
    ],
    Route("fastify", r"['\"]fastify['\"]", _JS, rf"method:\s*((?:\[[^\]]*\]|{_TEXT}))\s*,\s*(?:url|path):\s*{_KEPT}"),
    Route("hono", r"['\"]hono['\"/]", _JS, _call(r"\.on", rf"(\[[^\]]*\]|{_TEXT})", _KEPT)),
    # a router of this package takes the name of a route before its path
    Route("koa", r"koa", _JS, _call(_ON, rf"(?:{_TEXT}\s*,\s*)?{_KEPT}")),
    Route("nest", "@nestjs/", (".ts",), r"@(?i:(get|post|put|patch|delete|all))\(\s*(?:[\"'`]([^\"'`]*)[\"'`])?", base=_call("@Controller", _KEPT)),
    Route("fastapi", "fastapi", (".py",), "@\\w+" + _CALL),
    Route("fastapi", "fastapi", (".py",), _call(r"@\w+\.api_route", _KEPT) + _REST, 1, 2),
    Route("flask", "flask|Flask", (".py",), _call(r"@\w+\.route", _KEPT) + _REST, 1, 2, "GET"),
    Route("flask", "flask|Flask", (".py",), "@\\w+" + _CALL),
    Route("django", "django", (".py",), _call(r"\b(?:re_)?path", rf"r?[\"']\^?([^\"'$]*)\$?[\"']"), 1, 0),
    Route("spring", "springframework", (".java", ".kt"), r"@(Get|Post|Put|Patch|Delete)Mapping\b(?:\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*\"([^\"]*)\")?", base=r"(?s)@RequestMapping\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*\"([^\"]*)\"[^)]*\)[^;{}]*\bclass\b"),
    Route("spring", "springframework", (".java", ".kt"), r"@RequestMapping\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*\"([^\"]*)\"([^)]*RequestMethod[^)]*)", 1, 2),
    *[Route(name, package, _GO, "\\b\\w+" + _CALL) for name, package in (("gin", "gin-gonic/gin"), ("echo", "labstack/echo"), ("fiber", "gofiber/fiber"), ("chi", "go-chi/chi"))],
    Route("gin", "gin-gonic/gin", _GO, _call(r"\.Handle", rf"\"({_ANY})\"", _KEPT)),
    Route("chi", "go-chi/chi", _GO, _call(r"\.Method(?:Func)?", r"\"(\w+)\"", _KEPT)),
    Route("mux", "gorilla/mux", _GO, _call(r"\.Handle(?:Func)?", _KEPT) + _REST, 1, 2),
    # patterns of the standard library may begin with a method
    Route("net/http", _GO_WEB, _GO, rf"\.Handle(?:Func)?\(\s*\"(?:(\w+) )?(?:[\w.]*)(/[^\"]*)\"", absent=True),
    Route("actix", "actix", (".rs",), rf"#\[(?i:(get|post|put|patch|delete|head))\(\s*\"([^\"]*)\""),
    Route("actix", "actix", (".rs",), r"web::resource\(\s*\"([^\"]*)\"\s*\)([^;]*)", 1, 2),
    Route("actix", "actix", (".rs",), r"\.route\(\s*\"([^\"]*)\"\s*,\s*(web::\w+)", 1, 2),
    Route("axum", "axum", (".rs",), r"\.route\(\s*\"([^\"]*)\"\s*,([^;\n]*)", 1, 2),
)
#: Own words for code that asks who is there.
AUTH = r"(?i)\b(?:require|is|ensure|check|verify)?_?(?:auth(?:enticated?|orized?|enticate|orize)?|jwt|logged_?in|login_required)\b|\bdepends\(\s*\w*user|@(?:preauthorize|secured|rolesallowed)"
#: Own rule: tests and packages of others show routes that no service of the project has.
SKIPPED = r"(?:^|/)(?:node_modules|vendor|testdata|__tests__)/|(?:_test|\.test|\.spec)\.[a-z]+$|(?:^|/)test_[^/]*$"


def method_rank(method: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, METHODS)), method), F.lit(0)), F.lit(99)).cast("bigint")


def routes(src: DataFrame, rules: tuple[Route, ...] = ROUTES) -> DataFrame:
    """framework, method, route, file, line, auth and handler of each route, in projects that name the framework.

    src: file_id, project_id, path, extension, content. A route that names several methods gives a row for each. A base
    path found in the file stands before the paths of its routes. Routes begin with a slash; where a framework writes
    them without one (by annotations, or in tables of paths) they get it. Lines may hold several routes, each a row; a
    method and route that two rules read from one line is one row.
    """
    bare = ("django", "nest", "spring", "axum")
    plain = src.where(~F.col("path").rlike(SKIPPED))
    packages = sorted({r.package for r in rules})
    gates = src.groupBy(F.col("project_id").alias("_p")).agg(*[F.coalesce(F.bool_or(F.col("content").rlike(p)), F.lit(False)).alias(f"g{i}") for i, p in enumerate(packages)])
    named = lambda r: F.col(f"g{packages.index(r.package)}")
    opened = F.array(*[~named(r) if r.absent else named(r) for r in rules]).alias("_open")
    df = plain.join(gates.select("_p", opened), F.expr("project_id <=> _p"))
    df = df.withColumn("_base", F.array(*[F.regexp_extract("content", r.base, 1) if r.base else F.lit("") for r in rules]))
    rows = lines(df, "file_id", "content", ("path", "extension", "_open", "_base"))
    part = lambda x: F.when(x == "", x).otherwise(F.concat(F.lit("/"), F.trim(x, F.lit("/"))))

    def found(i: int, r: Route) -> Column:
        every = lambda g: F.regexp_extract_all("row", F.lit(r.pattern), F.lit(g))
        told = every(r.methods) if r.methods else F.transform(every(r.path), lambda _: F.lit(""))
        hits = F.transform(
            F.arrays_zip(told.alias("m"), every(r.path).alias("p")),
            lambda x: F.struct(
                F.lit(r.framework).alias("framework"), F.array_distinct(F.regexp_extract_all(F.upper(x["m"]), F.lit(rf"\b({_ANY})\b"), F.lit(1))).alias("methods"), F.lit(r.method).alias("default"),
                (F.concat(part(F.get("_base", F.lit(i))), part(x["p"])) if r.framework in bare else x["p"]).alias("route"),
            ),
        )
        nothing = F.array().cast("array<struct<framework:string,methods:array<string>,default:string,route:string>>")
        return F.when(F.get("_open", F.lit(i)) & F.col("extension").isin(*r.extensions), hits).otherwise(nothing)

    hits = rows.withColumn("h", F.explode(F.flatten(F.array(*[found(i, r) for i, r in enumerate(rules)]))))
    hits = hits.withColumn("route", F.when(F.col("h.framework").isin(*bare) & (F.col("h.route") == ""), "/").otherwise(F.col("h.route"))).where(F.col("route").startswith("/"))
    hits = hits.withColumn("method", F.explode(F.when(F.size("h.methods") > 0, F.col("h.methods")).otherwise(F.array("h.default"))))
    return hits.select(
        "h.framework", "method", "route", F.col("path").alias("file"), "line",
        F.when(F.col("row").rlike(AUTH), "Required").otherwise("").alias("auth"), F.regexp_extract("row", r",\s*(?:\w+\()?([\w.:]+)\)", 1).alias("handler"),
    ).distinct()


def page_route(path: Column) -> Column:
    """The route of a page file by its place: below pages, or a route file below app; null for other files."""
    inner = F.regexp_replace(path, "^src/", "")
    page = F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, "^pages", ""), r"\.[jt]s$", ""), "/index$", "")
    app = F.regexp_replace(F.regexp_replace(inner, "^app", ""), r"/route\.[jt]s$", "")
    whole = F.when(inner.rlike("^pages/api/"), page).when(inner.rlike(r"^app/(?:.*/)?route\.[jt]s$"), app)
    return F.when(whole == "", "/").otherwise(whole)


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy("route", method_rank(F.col("method")), "file", "line")
