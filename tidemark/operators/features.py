"""A table of features per entity, maintained with signed deltas.

Each event adds to the features of its entity: a count, a total and the time of the latest event, per event type.
A delta is an event with a sign: 1 inserts it, -1 retracts it. Counts and totals are sums of signed deltas and need
nothing but the old table. The latest time is a maximum, which a retraction can lower: it is computed anew from the
history, and only for those features whose retracted event was the latest one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.instants import instant
from tidemark.operators import nested
from tidemark.session import stored

KEYS = ("entity", "feature")


def aggregate(deltas: DataFrame) -> DataFrame:
    """Features of signed deltas: entity, feature, n, total, latest (of inserts), retracted (latest time of a retraction).

    deltas: entity, feature, at, amount, sign. Null amounts count as 0, null times never are the latest; a null
    entity or feature is a key like any other. Partial sums before the shuffle spread an entity with most of the rows.
    """
    sign = F.col("sign")
    return deltas.groupBy(*KEYS).agg(
        F.sum(sign).cast("bigint").alias("n"),
        F.sum(sign * F.coalesce("amount", F.lit(0))).cast("bigint").alias("total"),
        F.max(F.when(sign > 0, F.col("at"))).alias("latest"),
        F.max(F.when(sign < 0, F.col("at"))).alias("retracted"),
    )


def maintain(state: DataFrame, deltas: DataFrame, history: DataFrame) -> DataFrame:
    """The feature table after ``deltas``.

    state: entity, feature, n, total, latest. history: the events (entity, feature, at) that hold after the deltas; it
    is read for the features of which the latest event was retracted, and for no others. Features with no events left
    are dropped.
    """
    change = aggregate(deltas)
    merged = (
        state.select(*KEYS, "n", "total", "latest", F.lit(None).cast("timestamp").alias("retracted"))
        .unionByName(change)
        .groupBy(*KEYS)
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("latest").alias("latest"), F.max("retracted").alias("retracted"))
        .where("n > 0")
        .withColumn("_stale", F.coalesce(F.col("retracted") >= F.col("latest"), F.lit(False)))
    )
    stale = merged.where("_stale").select(*[F.col(k).alias(f"_{k}") for k in KEYS])
    hit = " and ".join(f"{k} <=> _{k}" for k in KEYS)
    again = history.join(stale, F.expr(hit), "left_semi").groupBy(*[F.col(k).alias(f"_{k}") for k in KEYS]).agg(F.max("at").alias("_again"))
    return merged.join(again, F.expr(hit), "left").select(
        *KEYS, "n", "total", F.when(F.col("_stale"), F.col("_again")).otherwise(F.col("latest")).alias("latest")
    )


def _delivered(entries: DataFrame) -> DataFrame:
    """Adds to each delivery its ``entry`` and ``entity``. An entry without a uuid is an entry of its own; the session is
    told by the file where session_id is missing or empty."""
    named = F.nullif(F.col("session_id"), F.lit(""))
    return entries.select(
        "entry_id", "message_json", "logged_at", "received_at",
        F.coalesce("entry_uuid", F.concat(F.lit("#"), F.col("entry_id").cast("string"))).alias("entry"),
        F.coalesce(named, F.regexp_replace(F.regexp_extract("file_name", r"([^/\\\\]+)$", 1), r"\.jsonl$", "")).alias("entity"),
    )


def tool_events(entries: DataFrame) -> DataFrame:
    """One row per delivered log entry and tool in its message: the entry's session, time, calls and output tokens.

    Tool names stand in tool_use blocks at any depth; blocks without a name don't count. A message's output tokens
    count once for each tool that it names; a count that is missing, negative or no whole number is 0. The time is told
    by received_at where logged_at can't be read. ``version`` numbers the deliveries of one entry by received_at, then
    entry_id, and ``last`` marks the calls of the latest; deliveries without calls are numbered too, so calls before a
    latest delivery that names no tool or doesn't parse aren't the last.
    """
    tokens = F.get_json_object("message_json", "$.usage.output_tokens")
    deliveries = _delivered(entries)
    df = deliveries.select(
        "entry_id", "message_json", "received_at", "entry", "entity",
        F.coalesce(instant(F.col("logged_at")), F.col("received_at")).alias("at"),
        F.coalesce(F.when(tokens.rlike(r"^\d+$"), tokens.try_cast("bigint")), F.lit(0)).alias("amount"),
    )
    keep = ("entry_id", "entry", "entity", "at", "amount", "received_at")
    # the message is parsed where it is read; only the tool names travel on
    blocks = nested.occurrences(df, {"message": "message_json"}, keep, payload=False, every=False)
    calls = blocks.where("type = 'tool_use' and name <> ''").select(*keep, F.col("name").alias("feature"), "block_path")
    # one narrow row per delivery, which stands for it where it has no calls
    marks = deliveries.select("entry_id", "entry", "received_at")
    order = Window.partitionBy("entry").orderBy("received_at", "entry_id")
    all_ = Window.partitionBy("entry")
    # every row of a delivery has the same received_at and entry_id
    return (
        calls.unionByName(marks, allowMissingColumns=True)
        .withColumn("version", F.dense_rank().over(order))
        .withColumn("last", F.col("version") == F.max("version").over(all_))
        .where("feature is not null")
        .select("entry", "version", "last", "entity", "feature", "at", "amount", "entry_id", "block_path")
    )


def _events(calls: DataFrame) -> DataFrame:
    """Events of ``aggregate``: each call counts, a message's tokens count at its first call of a tool."""
    first = Window.partitionBy("entry", "version", "feature").orderBy("block_path")
    return calls.withColumn("amount", F.when(F.row_number().over(first) == 1, F.col("amount")).otherwise(0))


def session_tools(calls: DataFrame) -> DataFrame:
    """entity (session), feature (tool), n (calls), total (output tokens), latest: each log entry counted once.

    calls: those of ``tool_calls``, stored, since they are read as inserts, as retractions and as history.
    The first deliveries build the table. A later delivery of an entry retracts what the one before it added and
    inserts itself, so that the latest delivery counts.
    """
    first = calls.where("version = 1")
    state = aggregate(first.withColumn("sign", F.lit(1))).drop("retracted")
    inserts = calls.where("version > 1").withColumn("sign", F.lit(1))
    retracts = calls.where("not last").withColumn("sign", F.lit(-1))
    deltas = inserts.unionByName(retracts).select(*KEYS, "at", "amount", "sign")
    return maintain(state, deltas, calls.where("last"))


def tool_calls(entries: DataFrame) -> DataFrame:
    """The events of ``tool_events`` with their amounts, parsed once and stored."""
    return stored(_events(tool_events(entries)), "tool-calls")


def applied(features: DataFrame, calls: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The feature table and the calls that hold, after a batch of deliveries that arrived later than all before.

    features: what ``session_tools`` gives. calls: the last calls of ``tool_calls``. An entry that the batch delivers
    again, with calls or without, loses its old ones; only features whose latest call is lost read the calls again.
    """
    again = _delivered(batch).select(F.col("entry").alias("_entry")).distinct()
    same = F.col("entry").eqNullSafe(F.col("_entry"))
    new = tool_calls(batch).where("last").select(*calls.columns)
    lost = calls.join(again, same, "left_semi")
    holding = stored(calls.join(again, same, "left_anti").unionByName(new), "calls")
    deltas = new.withColumn("sign", F.lit(1)).unionByName(lost.withColumn("sign", F.lit(-1))).select(*KEYS, "at", "amount", "sign")
    return maintain(features, deltas, holding), holding


def session_features(entries: DataFrame) -> DataFrame:
    """One row per session with arrays by tool, in order of tool: calls, seconds since the last call, output tokens.

    Seconds count to the latest call of all sessions. Sessions of any entry have a row; without a named tool its arrays
    are empty.
    """
    calls = tool_calls(entries)
    now = calls.where("last").agg(F.max("at")).scalar()
    features = session_tools(calls).withColumn("since", F.unix_seconds(now) - F.unix_seconds("latest"))
    sessions = _delivered(entries).select("entity").distinct()
    item = F.when(F.col("feature").isNotNull(), F.struct("feature", "n", "since", "total"))
    rows = features.unionByName(sessions, allowMissingColumns=True).groupBy(F.col("entity").alias("session_id")).agg(
        # one item per tool name, so an array is as long as there are tools, however many events a session has
        F.array_sort(F.collect_list(item)).alias("f")
    )
    return rows.select(
        "session_id", F.col("f.feature").alias("tools"), F.col("f.n").alias("calls"),
        F.col("f.since").alias("seconds_since_last"), F.col("f.total").alias("output_tokens"),
    )
