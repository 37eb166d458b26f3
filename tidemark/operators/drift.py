"""Schemas that drift between files: a lifespan catalogue, a report of changes and one consistent table.

Every file gives a footer: one row per member path and type. Footers are aggregated where the records are read, so
what is shuffled grows with files and members, not with records. Within a producer, files are numbered in order;
neighbouring files in which a member has one type form an island, found with lag, and the starts and ends of islands
are the changes. An alias table says which paths carry the same information; an end and a start of the same
information at one file are a renaming. The same table gives the casts by which all records enter one table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.schemas import flat
from tidemark.operators.nested import Exact, parsed, utf8

#: Paths under which producers write the same information, and its type in the consistent table.
ALIASES = {
    "session_id": ("string", ("sessionId", "session_id", "session")),
    "record_type": ("string", ("type", "record_type", "entryType", "kind")),
    "subtype": ("array<string>", ("subtype", "sub_type", "subType", "noticeType")),
    "duration_ms": ("double", ("durationMs", "duration_ms", "tookMs", "elapsedMs", "data.durationMs")),
    "data_type": ("array<string>", ("data.type", "data.eventType", "data.kind", "dataType")),
    "data_query": ("string", ("data.query", "data.q", "data.searchText")),
    "recorded_at": ("string", ("timestamp",)),
    "data_elapsed": ("double", ("data.elapsed",)),
    "data_cached": ("boolean", ("data.cached",)),
    "data_total": ("double", ("data.total",)),
    "data_worker": ("string", ("data.worker",)),
    "priority": ("double", ("priority",)),
    "retry_count": ("double", ("retryCount",)),
    "request_id": ("string", ("requestId",)),
    "tags": ("array<string>", ("tags",)),
    "version": ("array<string>", ("version",)),
    "user_type": ("array<string>", ("userType",)),
    "git_branch": ("array<string>", ("gitBranch",)),
    "is_sidechain": ("boolean", ("isSidechain",)),
}
#: Members of which neither they nor what is in them counts.
OPAQUE = ("message",)
_LEAF = flat("field string, type string")


def _type(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, Exact):
        return "integer" if value.whole else "number"
    return {int: "integer", float: "number", str: "string", list: "array"}[type(value)]


def _leaves(record: dict) -> list[tuple[str, str | None]]:
    """Paths of the members that aren't objects, dotted, with their types."""
    out, todo = [], [("", record)]
    while todo:
        prefix, value = todo.pop()
        for k, v in value.items():
            if not prefix and k in OPAQUE:
                continue
            if isinstance(v, dict):
                todo.append((f"{prefix}{k}.", v))
            else:
                out.append((utf8(prefix + k), _type(v)))
    return out


def footers(records: DataFrame) -> DataFrame:
    """One row per producer, file and member path: its type there (null if all values are null), with counts.

    records: producer, file_name, file_seq, raw. A record that doesn't parse, is null or isn't an object adds the file
    without members, so that files in which nothing parses still count as files. Integers and fractions in one file
    make ``number``; other mixtures are written together, in order, with a bar between. Repeated records change counts
    only. Columns beyond the four are ignored.
    """
    keys = ["producer", "file_name", "file_seq"]
    df = records.select(*keys, "raw")
    kept = [df.schema[k] for k in keys]

    def leaves(batches):
        for batch in batches:
            # rows of one batch that have the same file, path and type are counted here
            seen: dict[tuple, int] = {}
            names = [batch.column(k).to_pylist() for k in keys]
            for i, raw in enumerate(batch.column("raw").to_pylist()):
                record = parsed(raw)
                file = (names[0][i], names[1][i], names[2][i])
                for leaf in (_leaves(record) if isinstance(record, dict) else []) or [(None, None)]:
                    seen[file + leaf] = seen.get(file + leaf, 0) + 1
            columns = list(zip(*seen)) or [()] * 5
            types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)] + [pa.array(list(seen.values()), pa.int64())],
                names=keys + ["field", "type", "n"],
            )

    made = T.StructType([T.StructField(f.name, t) for f, t in zip(kept, (T.StringType(), T.StringType(), T.IntegerType()))] + list(_LEAF) + [T.StructField("n", T.LongType())])
    types = F.array_sort(F.collect_set("type"))  # at most five
    return (
        df.withColumn("file_seq", F.col("file_seq").cast("int"))
        .mapInArrow(leaves, made)
        .groupBy(*keys, "field")
        .agg(types.alias("t"), F.sum("n").alias("n"), F.sum(F.when(F.col("type").isNotNull(), F.col("n")).otherwise(0)).alias("n_set"))
        .select(
            *keys, "field",
            F.when(F.size("t") == 0, F.lit(None)).when(F.array_join("t", "|") == "integer|number", "number").otherwise(F.array_join("t", "|")).alias("type"),
            "n", "n_set",
        )
    )


def information(aliases: dict = ALIASES, path: str = "field") -> Column:
    """What a path tells, by the alias table; paths that it doesn't name are compared without case, dots and underscores."""
    known = {p: concept for concept, (_, paths) in aliases.items() for p in paths}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(path)), F.lower(F.regexp_replace(path, r"[._-]", "")))


def lifespans(records: DataFrame, aliases: dict = ALIASES) -> DataFrame:
    """Islands: producer, field, type, information, first and last file of each unbroken use of a member with one type.

    ``first_ord``/``last_ord`` number the producer's files by file_seq; a file without a type for the member (nulls
    only) continues the island. ``next_file`` is the file after the island, null if the producer has none.
    """
    foot = footers(records)
    order = Window.partitionBy("producer").orderBy("file_seq", "file_name")
    # the files of a producer are far fewer than its records
    files = foot.select("producer", "file_name", "file_seq").distinct()
    files = files.withColumns({"ord": F.row_number().over(order), "next_file": F.lead("file_name").over(order)})
    member = Window.partitionBy("producer", "field").orderBy("ord")
    uses = (
        foot.where(F.col("field").isNotNull())
        .join(files.select(*[F.col(c).alias(f"_{c}") for c in ("producer", "file_name", "file_seq")], "ord", "next_file"),
              F.expr("producer <=> _producer and file_name <=> _file_name and file_seq <=> _file_seq"))
        .select("producer", "field", "type", "file_name", "ord", "next_file")
        .withColumn("kind", F.coalesce("type", F.last("type", True).over(member.rowsBetween(Window.unboundedPreceding, -1))))
    )
    broken = (F.col("ord") != F.lag("ord").over(member) + 1) | ~F.col("kind").eqNullSafe(F.lag("kind").over(member))
    return (
        uses.withColumn("_new", F.coalesce(broken, F.lit(True)).cast("int"))
        .withColumn("_island", F.sum("_new").over(member.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("producer", "field", "_island")
        .agg(
            F.max("kind").alias("type"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"),
            F.min_by("file_name", "ord").alias("first_file"), F.max_by("file_name", "ord").alias("last_file"),
            F.max_by("next_file", "ord").alias("next_file"),
        )
        .drop("_island")
        .withColumn("information", information(aliases))
    )


def changes(records: DataFrame, aliases: dict = ALIASES) -> DataFrame:
    """file_name, field, change (added, removed, renamed, retyped), with old and new path and type of each change.

    A file's changes are those against the producer's file before it; the first file has none. Two paths with the
    same information that end and start at one file are one renaming, the nth with the nth by name if there are more.
    """
    spans = lifespans(records, aliases)
    start = spans.where("first_ord > 1").select(
        "producer", "information", F.col("first_ord").alias("at"), F.col("first_file").alias("file_name"), F.col("field").alias("new"), F.col("type").alias("new_type")
    )
    end = spans.where("next_file is not null").select(
        "producer", "information", (F.col("last_ord") + 1).alias("at"), F.col("next_file").alias("file_name"), F.col("field").alias("old"), F.col("type").alias("old_type")
    )
    # an end and a start of one path at one file are a change of its type; what is left is paired by what it tells
    sides = end.select("producer", "information", "at", "file_name", F.col("old").alias("path"), F.col("old_type").alias("type"), F.lit(0).alias("side")).unionByName(
        start.select("producer", "information", "at", "file_name", F.col("new").alias("path"), F.col("new_type").alias("type"), F.lit(1).alias("side"))
    )
    same = Window.partitionBy("producer", "at", "information", "path")
    sides = sides.withColumn("_both", F.count(F.lit(1)).over(same) == 2)
    rank = Window.partitionBy("producer", "at", "information", "_both", "side").orderBy("path")
    pairs = (
        sides.withColumn("_n", F.row_number().over(rank))
        .groupBy("producer", "at", "information", "_both", "_n")
        .agg(
            F.max("file_name").alias("file_name"),
            *[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{name}_{c}") for s, name in ((0, "old"), (1, "new")) for c in ("path", "type")],
        )
    )
    old, new = F.col("old_path"), F.col("new_path")
    retyped = old.isNotNull() & new.isNotNull() & (F.col("old_type") != F.col("new_type"))
    kinds = F.array_compact(
        F.array(
            F.when(old.isNull(), "added").when(new.isNull(), "removed").when(old != new, "renamed"),
            F.when(retyped, "retyped"),
        )
    )
    return pairs.select(
        "producer", "file_name", F.coalesce(old, new).alias("field"), F.explode(kinds).alias("change"), "old_path", "new_path", "old_type", "new_type"
    )


def unified(records: DataFrame, aliases: dict = ALIASES) -> DataFrame:
    """All records in one table with a column per information of the alias table, each cast to one type.

    Numbers in quotes become numbers, a lone text in place of an array an array of one, an array of one in place of a
    number or boolean what is in it, true and false in quotes booleans. What isn't there or is null gives null; records
    that don't parse keep their id with ``parsed`` false. Where a record holds several aliases of one information, the
    first in the table counts. ``message`` is that member as text.

    ``rest`` holds all that has no place in a column, as text by path: members that the table doesn't name, values that
    can't be cast or would be rounded, other aliases of an information that is told already, and under the path "" a
    record that doesn't parse. Names with a dot or a quote stand in quotes there, with quotes doubled. Nulls are left out.
    """
    df = records.select("record_id", "producer", "file_name", "file_seq", "raw")
    # maps, not structs: paths may differ in case only
    members = F.from_json("raw", "map<string,string>")
    df = df.withColumn("_top", members).withColumn("_data", F.from_json(F.try_element_at("_top", F.lit("data")), "map<string,string>"))
    df = df.withColumn("_ok", F.json_object_keys("raw").isNotNull())

    def at(path: str) -> Column:
        return F.try_element_at("_data", F.lit(path[5:])) if path.startswith("data.") else F.try_element_at("_top", F.lit(path))

    def cast(kind: str, text: Column) -> Column:
        items = F.when(text.startswith("["), F.from_json(text, "array<string>"))
        if kind == "array<string>":
            return F.when(text.startswith("["), items).when(text.isNotNull(), F.array(text))
        return F.coalesce(text.try_cast(kind), F.when(F.size(items) == 1, F.get(items, F.lit(0))).try_cast(kind)) if kind != "string" else text

    def entries(of: str, prefix: str, without: Column) -> Column:
        named = lambda k: F.concat(F.lit(prefix), F.when(k.rlike(r'[."]'), F.concat(F.lit('"'), F.replace(k, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(k))
        kept = F.filter(F.map_entries(of), lambda e: e["value"].isNotNull() & ~F.array_contains(without, e["key"]))
        return F.coalesce(F.transform(kept, lambda e: F.struct(named(e["key"]).alias("key"), e["value"].alias("value"))), F.expr("array()"))

    texts = {name: F.coalesce(*[at(p) for p in ps]) for name, (_, ps) in aliases.items()}
    df = df.withColumns({f"_t_{name}": text for name, text in texts.items()})
    df = df.withColumns({f"_c_{name}": cast(kind, F.col(f"_t_{name}")) for name, (kind, _) in aliases.items()})
    # the path that each column was read from, if the value is whole there
    whole = {name: F.col(f"_c_{name}").isNotNull() & ~((F.lit(kind) == "double") & F.col(f"_t_{name}").rlike(r"\d{16}")) for name, (kind, _) in aliases.items()}
    used = F.array(*[F.when(whole[name], F.coalesce(*[F.when(at(p).isNotNull(), F.lit(p)) for p in ps])) for name, (_, ps) in aliases.items()])
    opened = F.when(F.col("_data").isNotNull(), F.array(F.lit("message"), F.lit("data"))).otherwise(F.array(F.lit("message")))
    rest = F.concat(entries("_top", "", opened), entries("_data", "data.", F.expr("cast(array() as array<string>)")))
    df = df.withColumn("_used", F.array_compact(used)).withColumn("_rest", F.filter(rest, lambda e: ~F.array_contains("_used", e["key"])))
    # a member that stands twice counts once, as in the columns
    once = F.filter("_rest", lambda e, i: F.array_position(F.transform("_rest", lambda x: x["key"]), e["key"]) == i + 1)
    rest = F.when(F.col("_top").isNotNull(), F.map_from_entries(once)).when(F.col("raw").isNotNull(), F.create_map(F.lit(""), "raw"))
    return df.select(
        "record_id", "producer", "file_name", "file_seq", F.col("_ok").alias("parsed"), *[F.col(f"_c_{name}").alias(name) for name in aliases],
        at("message").alias("message"), rest.alias("rest"),
    )
