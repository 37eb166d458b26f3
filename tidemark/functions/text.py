"""Scalar functions on texts, names and paths, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_path(path: Column) -> Column:
    """Separators of either kind, repeated or not, become one slash; steps to the folder itself go."""
    return F.regexp_replace(F.regexp_replace(path, r"[/\\]+", "/"), r"/(?:\./)+", "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Lower case, with its dot; empty where there is none. A name that starts with its only dot is all extension."""
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]*)$", 1))


def normalize_model(model: Column) -> Column:
    """A model's name without a date of eight digits at its end; unknown where it is null or empty."""
    return F.coalesce(F.nullif(F.regexp_replace(model, r"(?<=.)-[0-9]{8}\z", ""), F.lit("")), F.lit("unknown"))


def make_relative(path: Column, root: Column) -> Column:
    """The path below the root; a path elsewhere stays whole, as do all where the root is null or empty."""
    inside = root.isNotNull() & (root != "") & path.startswith(F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))
    return F.when(inside, path.substr(F.length(F.rtrim(root, F.lit("/"))) + 2, F.length(path))).otherwise(path)


def clean_version(version: Column) -> Column:
    """Without one each of the range signs, in this order."""
    for sign in (r"\^", "~", ">=", ">", "<=", "<"):
        version = F.regexp_replace(version, f"^{sign}", "")
    return version


def naming_style(name: Column) -> Column:
    """kebab, snake, pascal, camel or unknown, for a name without its extension."""
    hyphen, underscore = name.contains("-"), name.contains("_")
    return (
        F.when(name.isNull() | (F.length(name) < 2), "unknown")
        .when(hyphen & ~underscore, "kebab")
        .when(underscore & ~hyphen & (name == F.lower(name)), "snake")
        .when(~hyphen & ~underscore & name.rlike("^[A-Z]"), "pascal")
        .when(~hyphen & ~underscore & name.rlike("^[a-z].*[A-Z]"), "camel")
        .otherwise("unknown")
    )


def normalize_command(command: Column) -> Column:
    """One text for commands that differ in case, in the package manager or in a note about the folder."""
    c = F.trim(F.lower(command))
    c = F.regexp_replace(c, r"(?s)(?<=.) \(in .*$", "")
    for manager in ("yarn ", "pnpm ", "bun "):
        c = F.replace(c, F.lit(manager), F.lit("npm "))
    return F.replace(c, F.lit("npm run "), F.lit("npm "))


def resource_prefix(path: Column) -> Column:
    """The resource of a route: its first segment, after a prefix such as api or v2; parameters are no resources."""
    parts = F.split(F.trim(path, F.lit("/")), "/", -1)
    prefixed = F.lower(parts[0]).rlike(r"^(?:api$|v[0-9])")
    at = F.when(prefixed, 1).otherwise(0)
    main = F.get(parts, at)
    fixed = main.isNotNull() & ~main.rlike(r"^[:{\[]|^\*$")
    kept = F.array_compact(F.array(F.when(prefixed, parts[0]), F.when(fixed, main)))
    return F.when(path.isNull(), F.lit(None)).when(F.size(kept) == 0, "/").otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))


def title_case(text: Column) -> Column:
    """Upper case after each blank, hyphen or underscore; the rest is kept as it is."""
    words = F.filter(F.split(text, r"[\s_-]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def clean_markdown(text: Column) -> Column:
    """Without marks of bold, italics and code, and with links as their labels."""
    t = F.regexp_replace(text, r"\*\*([^*]+)\*\*", "$1")
    t = F.regexp_replace(t, r"\*([^*]+)\*", "$1")
    t = F.regexp_replace(t, r"`([^`]+)`", "$1")
    return F.regexp_replace(t, r"\[([^\]]+)\]\([^)]+\)", "$1")


def clean_html(text: Column) -> Column:
    """Without tags, and with six entities as their characters."""
    t = F.regexp_replace(text, "<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(t)


def format_count(n: Column) -> Column:
    """A count for people: one decimal with K, M or B from a thousand on."""
    out = n.cast("string")
    for size, sign in ((1_000, "K"), (1_000_000, "M"), (1_000_000_000, "B")):
        out = F.when(n >= size, F.format_string(f"%.1f{sign}", n / float(size))).otherwise(out)
    return out


def bar(n: Column, most: Column, width: int = 25) -> Column:
    """A bar as long as n's share of the largest, in whole signs."""
    return F.repeat(F.lit("#"), F.when(most > 0, F.floor(n * width / most)).otherwise(0).cast("int"))
