"""Changes of files as a stream: bursts, what they touch, and results that follow them.

A stream of (path, at) is cut into bursts, a burst ends when nothing comes for a while and keeps all that
belongs to it. Results kept per key follow the stream by merging, so that after all changes they equal a full run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.functions import dimensions


def impacts(path: Column, rules: list[tuple] = dimensions.IMPACTS) -> Column:
    """What a changed file touches, by the first rule that matches; an empty array if none does."""
    out = F.array().cast("array<string>")
    for pattern, touched in reversed(rules):
        out = F.when(path.rlike(pattern), F.array(*map(F.lit, touched))).otherwise(out)
    return out


def touched(changes: DataFrame) -> DataFrame:
    """One row per change and result that it touches."""
    return changes.withColumn("impact", F.explode(impacts(F.col("path"))))


def bursts(changes: DataFrame, key: str, gap: int, at: str = "at", members: str | None = None, slice_: int = 86_400) -> DataFrame:
    """Bursts of a key: number of events, first and last time and, if ``members`` names a column, its distinct values in order.

    A burst ends when no event comes within ``gap`` seconds; events without a time don't count. On a stream, behind a
    watermark, Spark's session windows find them. A table is cut by time into slices of ``slice_`` seconds (at least
    ``gap``), so that a key with most of the rows lies in many tasks; only the first and last burst of a slice can go on
    in another, and only those are put together afterwards.
    """
    values = [F.array_sort(F.collect_set(members)).alias(members)] if members else []
    if changes.isStreaming:
        window = F.session_window(at, f"{gap} seconds")
        return changes.groupBy(key, window.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.min(at).alias("first"), F.max(at).alias("last"), *values).drop("w")
    far = lambda later, earlier: F.coalesce(F.unix_micros(later) - F.unix_micros(earlier) >= gap * 1_000_000, F.lit(True))
    df = changes.select(key, at, *([members] if members else [])).where(F.col(at).isNotNull()).withColumn("_slice", F.floor(F.unix_seconds(F.col(at)) / max(gap, slice_)))
    inside = Window.partitionBy(key, "_slice").orderBy(at)
    df = df.withColumn("_new", far(F.col(at), F.lag(at).over(inside)).cast("int"))
    df = df.withColumn("_n", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    part = df.groupBy(key, "_slice", "_n").agg(F.count(F.lit(1)).alias("events"), F.min(at).alias("first"), F.max(at).alias("last"), *values)
    part = part.withColumn("_ends", (F.col("_n") == 1) | (F.col("_n") == F.max("_n").over(Window.partitionBy(key, "_slice"))))
    columns = [key, "events", "first", "last", *([members] if members else [])]
    along = Window.partitionBy(key).orderBy("first")
    seams = part.where("_ends").withColumn("_new", far(F.col("first"), F.lag("last").over(along)).cast("int"))
    seams = seams.withColumn("_n", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(members)))).alias(members)] if members else []
    whole = seams.groupBy(key, "_n").agg(F.sum("events").alias("events"), F.min("first").alias("first"), F.max("last").alias("last"), *joined)
    return part.where("not _ends").select(*columns).unionByName(whole.select(*columns))


def read_changes(spark: SparkSession, folder: str, late: str = "10 minutes") -> DataFrame:
    """Stream of JSON lines {path, at} from files that appear in a folder; events later than ``late`` may be dropped."""
    stream = spark.readStream.schema("path string, at timestamp").json(folder)
    return stream.withWatermark("at", late)


def follow(stream: DataFrame, keys: list[str], count: str, target: str, checkpoint: str) -> StreamingQuery:
    """Counts per key kept in Parquet folders below ``target``, one per batch; each batch writes the sums of its keys.

    A batch is written under its number, so a batch that runs again after a failure replaces itself: exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def followed(spark: SparkSession, keys: list[str], count: str, target: str) -> DataFrame:
    """The sums of all batches so far."""
    return spark.read.parquet(target).groupBy(*keys).agg(F.sum(count).alias(count))


#: Own rules: changes that no result follows: what tools write for themselves, and what they leave behind while saving.
QUIET = r"(?:^|/)(?:\.git|node_modules|__pycache__|\.venv|target|dist)(?:/|$)|(?:~|\.sw[a-z]|\.tmp|\.lock|\.pyc)$|(?:^|/)(?:\.#|#)[^/]*$"


def relevant(changes: DataFrame, quiet: str = QUIET) -> DataFrame:
    """Changes that results follow: with a path, and not one of a tool's own files."""
    return changes.where(F.col("path").isNotNull() & ~F.col("path").rlike(quiet))


def dispatched(bursts_: DataFrame, results: dict[str, tuple[str, ...]], known: tuple[str, ...] | None = None, paths: str = "path") -> DataFrame:
    """Adds to each burst ``rerun``, the names of the results to compute anew, and ``full``, whether everything is.

    bursts_: those of ``bursts`` with the paths as members. results: which impacts each result follows. A burst is full
    where one of its paths touches nothing that is known, or where ``known`` (results that can be kept up) misses one
    that has to follow.
    """
    touched_ = F.array_distinct(F.flatten(F.transform(paths, lambda p: impacts(p))))
    names = F.array_compact(F.array(*[F.when(F.arrays_overlap(touched_, F.array(*map(F.lit, needs))), F.lit(name)) for name, needs in sorted(results.items())]))
    missing = F.size(F.array_except(names, F.array(*map(F.lit, known)).cast("array<string>"))) > 0 if known is not None else F.lit(False)
    full = F.exists(paths, lambda p: F.size(impacts(p)) == 0) | missing
    everything = F.array(*[F.lit(n) for n in sorted(results)])
    return bursts_.withColumn("full", full).withColumn("rerun", F.when(F.col("full"), everything).otherwise(names))


def described(paths: Column, shown: int = 3) -> Column:
    """A burst in words: its first paths and how many more there are."""
    first = F.array_join(F.slice(paths, F.lit(1), F.lit(shown)), ", ")
    more = F.size(paths) - shown
    return F.when(F.size(paths) == 0, "nothing").when(more > 0, F.concat(first, F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(first)
