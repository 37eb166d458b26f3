"""Usage of tools, files and models in session logs.

One row per log entry goes in, each delivery of an entry once; calls and turns are read from it and aggregated by
tool, file, model and session. Everything is an aggregate with partial sums before the shuffle; rankings end in a
total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.instants import instant
from tidemark.functions.text import make_relative, normalize_model

TOKENS = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
#: Names of the tools that read, change and write files.
READ, EDIT, WRITE = "Read", "Edit", "Write"
#: Reads from which a file counts as read again and again; edits that make a write a rewrite.
REREADS, REWRITES = 10, 2
TOP_FILES, TOP_PAINS = 15, 10


def entries_once(entries: DataFrame) -> DataFrame:
    """The latest delivery of each log entry, with its session, instant and message parts.

    A message counts only if its content is an array or absent; other shapes keep the entry with null parts. A null
    entry_uuid makes an entry of its own.
    """
    usage = ", ".join(f"{t}:string" for t in TOKENS)
    message = F.from_json("message_json", f"model string, usage struct<{usage}>, content string")
    block = "type string, name string, input struct<file_path:string, path:string>"
    session = F.coalesce(F.nullif("session_id", F.lit("")), F.regexp_replace(F.regexp_extract("file_name", r"([^/\\\\]+)$", 1), r"\.jsonl$", ""))
    df = entries.withColumns({"session": session, "at": instant(F.col("logged_at")), "_m": message})
    blocks = F.transform(F.from_json("_m.content", "array<string>"), lambda b: F.from_json(b, block))
    path = lambda b: F.coalesce(F.nullif(b["input"]["file_path"], F.lit("")), F.nullif(b["input"]["path"], F.lit("")))
    named = F.transform(F.filter(blocks, lambda b: (b["type"] == "tool_use") & (b["name"] != "")), lambda b: F.struct(b["name"].alias("tool"), path(b).alias("path")))
    count = lambda c: F.coalesce(F.when(F.col(f"_m.usage.{c}").rlike(r"^[0-9]{1,18}$"), F.col(f"_m.usage.{c}").try_cast("bigint")), F.lit(0)).alias(c)
    # messages are read where they lie; only what is counted travels to the other deliveries of an entry
    df = df.select(
        "entry_id", "received_at", F.coalesce("entry_uuid", F.concat(F.lit("#"), F.col("entry_id").cast("string"))).alias("_key"), "session", "entry_type", "at",
        normalize_model(F.col("_m.model")).alias("model"), *[count(t) for t in TOKENS],
        F.coalesce(F.when(F.col("_m.content").startswith("["), named), F.array().cast("array<struct<tool:string,path:string>>")).alias("calls"),
    )
    latest = Window.partitionBy("_key").orderBy(F.desc("received_at"), F.desc("entry_id"))
    return df.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "_key", "received_at")


def since(once: DataFrame, start: Column | None) -> DataFrame:
    """Assistant entries with a readable time, from ``start`` on if it is given."""
    df = once.where((F.col("entry_type") == "assistant") & F.col("at").isNotNull())
    return df if start is None else df.where(F.col("at") >= start)


def turns(once: DataFrame, start: Column | None = None) -> DataFrame:
    """Entries that spent input or output tokens; the cache tokens of others don't count."""
    return since(once, start).where("input_tokens > 0 or output_tokens > 0").drop("calls")


def tool_calls(once: DataFrame, start: Column | None = None) -> DataFrame:
    """One row per tool_use block with a name: session, at, model, tool and path (file_path, else path, else null)."""
    return since(once, start).select("entry_id", "session", "at", "model", F.posexplode("calls").alias("ord", "c")).select("entry_id", "session", "at", "model", "ord", "c.tool", "c.path")


def tool_usage(calls: DataFrame) -> DataFrame:
    """tool, calls and their share of all calls in per cent; no rows where there are no calls."""
    counts = calls.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"))
    total = counts.agg(F.sum("calls")).scalar()  # of the counts, whose shuffle Spark reuses
    return counts.select("tool", "calls", F.round(F.col("calls") * 100.0 / total, 6).alias("share"))


def file_operations(calls: DataFrame, root: Column) -> DataFrame:
    """Operations per file, relative to ``root``: of any tool, and of those that read, edit and write."""
    one = lambda tool: F.count_if(F.col("tool") == tool)
    return (
        calls.where(F.col("path").isNotNull()).withColumn("path", make_relative(F.col("path"), root)).groupBy("path")
        .agg(F.count(F.lit(1)).alias("operations"), one(READ).alias("reads"), one(EDIT).alias("edits"), one(WRITE).alias("writes"))
    )


def hot_files(operations: DataFrame, most: int = TOP_FILES) -> DataFrame:
    return operations.orderBy(F.desc("operations"), "path").limit(most)


def pain_points(operations: DataFrame, most: int = TOP_PAINS, rereads: int = REREADS, rewrites: int = REWRITES) -> DataFrame:
    """Files read at least ``rereads`` times, and files written and then edited at least ``rewrites`` times; the most frequent first."""
    again = operations.where(F.col("reads") >= rereads).select(F.lit("repeated_reads").alias("kind"), "path", F.col("reads").alias("count"))
    rewritten = operations.where((F.col("writes") > 0) & (F.col("edits") >= rewrites))
    rewritten = rewritten.select(F.lit("write_then_edit").alias("kind"), "path", F.col("edits").alias("count"))
    return again.unionByName(rewritten).orderBy(F.desc("count"), "path", "kind").limit(most)


def models(spent: DataFrame) -> DataFrame:
    """Turns and tokens per model."""
    return spent.groupBy("model").agg(F.count(F.lit(1)).alias("turns"), *[F.sum(t).alias(t) for t in TOKENS])


def sessions(once: DataFrame) -> DataFrame:
    """Turns, tool calls, first and last time (epoch microseconds) per session; those with neither turn nor call are left out.

    User entries widen the time of a session and count nothing.
    """
    spent = (F.col("entry_type") == "assistant") & F.col("at").isNotNull() & ((F.col("input_tokens") > 0) | (F.col("output_tokens") > 0))
    calls = F.when((F.col("entry_type") == "assistant") & F.col("at").isNotNull(), F.size("calls")).otherwise(0)
    timed = F.when(F.col("entry_type").isin("user", "assistant"), F.unix_micros("at"))
    return (
        once.withColumns({"_turn": spent.cast("bigint"), "_calls": calls.cast("bigint"), "_at": timed})
        .groupBy(F.col("session").alias("session_id"))
        .agg(F.sum("_turn").alias("turns"), F.sum("_calls").alias("calls"), F.min("_at").alias("start_us"), F.max("_at").alias("end_us"))
        .where("turns > 0 or calls > 0")
    )


def summary(per_session: DataFrame, spent: DataFrame) -> DataFrame:
    """One row: sessions, turns, calls, time range and token totals."""
    a = per_session.agg(F.count(F.lit(1)).alias("sessions"), F.sum("turns").alias("turns"), F.sum("calls").alias("calls"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    total = spent.agg(F.struct(*[F.sum(t).alias(t) for t in TOKENS])).scalar()
    return a.withColumn("_t", total).select(*a.columns, *[F.col(f"_t.{t}").alias(t) for t in TOKENS])


def stale_sessions(listed: DataFrame, per_session: DataFrame) -> DataFrame:
    """Listed sessions whose counts differ from their log, are missing there, or lack a count; repeated rows count once."""
    told = listed.groupBy("session_id").agg(F.max("turn_count").alias("told_turns"), F.max("tool_count").alias("told_calls"))
    df = told.join(per_session.select(F.col("session_id").alias("_s"), "turns", "calls"), F.col("session_id") == F.col("_s"), "left")
    state = (
        F.when(F.col("_s").isNull(), "no log")
        .when(F.col("told_turns").isNull() | F.col("told_calls").isNull(), "no count")
        .when((F.col("told_turns") != F.col("turns")) | (F.col("told_calls") != F.col("calls")), "stale")
        .otherwise("current")
    )
    return df.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("sessions"))
