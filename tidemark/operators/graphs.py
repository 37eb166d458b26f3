"""Graphs of what depends on what: edges, degrees, layers and cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dimensions
from tidemark.session import stored

#: Imports of a neighbour by its relative name, as source files of some languages write them.
IMPORT = r"from '\./([A-Za-z_]+)'"


def edges(src: DataFrame, files: DataFrame, pattern: str = IMPORT) -> DataFrame:
    """project_id, src and dst: a folder and the folder of the same project that its files import, each pair once.

    src: project_id, relative and content. files: project_id, relative. An import names a folder by its last part; of
    several folders of one name in a project the first by path is meant. Imports that no folder provides give no edge.
    """
    folder = lambda: F.when(F.contains("relative", F.lit("/")), F.regexp_replace("relative", "/[^/]*$", ""))
    given = files.select(F.col("project_id").alias("_p"), folder().alias("dst")).where("dst is not null")
    given = given.groupBy("_p", F.substring_index("dst", "/", -1).alias("_n")).agg(F.min("dst").alias("dst"))
    names = F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))
    asked = src.select("project_id", folder().alias("src"), F.explode(names).alias("name")).where("src is not null").distinct()
    return asked.join(given, F.expr("project_id = _p and name = _n")).where("src <> dst").select("project_id", "src", "dst").distinct()


def degrees(pairs: DataFrame, least: int = 0) -> DataFrame:
    """node, out and in degree of nodes with more than ``least`` of either."""
    one = pairs.select("src", "dst").distinct()
    both = one.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(one.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree")).where((F.col("out_degree") > least) | (F.col("in_degree") > least))


def layer(path: Column, layers: dict = dimensions.LAYERS) -> tuple[Column, Column]:
    """Name and level of the first segment that is a layer, null where none is."""
    table = F.create_map(*[F.lit(x) for kv in layers.items() for x in kv])
    name = F.get(F.filter(F.split(path, "/"), lambda p: F.map_contains_key(table, p)), F.lit(0))
    return name, F.try_element_at(table, name)


def violations(pairs: DataFrame, layers: dict = dimensions.LAYERS) -> DataFrame:
    """Edges from a lower layer to a higher one. pairs: from_path, to_path."""
    (a, low), (b, high) = layer(F.col("from_path"), layers), layer(F.col("to_path"), layers)
    return pairs.where(low < high).select("from_path", "to_path", a.alias("from_layer"), b.alias("to_layer"))


def reachable(pairs: DataFrame, longest: int) -> DataFrame:
    """src, dst and hops: all pairs joined by a path of at most ``longest`` edges, by the shortest. pairs: src, dst.

    One join per hop, each on the end of the paths so far; pairs known before are dropped, so cycles end.
    """
    edge = pairs.select("src", "dst").distinct()
    known = stored(edge.withColumn("hops", F.lit(1).cast("bigint")), "paths")
    step = known
    for hop in range(2, longest + 1):
        more = step.select("src", F.col("dst").alias("_via")).join(edge.select(F.col("src").alias("_from"), "dst"), F.col("_via") == F.col("_from")).select("src", "dst").distinct()
        old = known.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
        step = stored(more.join(old, F.expr("src = _s and dst = _d"), "left_anti").withColumn("hops", F.lit(hop).cast("bigint")), "paths")
        if step.isEmpty():
            break
        known = known.unionByName(step)
    return known


def cycles(pairs: DataFrame, trims: int = 4) -> DataFrame:
    """nodes: for each edge that lies on a cycle one of the shortest cycles through it, of whatever length; each cycle once, from its smallest node on, with its length.

    So every edge of a cycle is in a row; of equally short ways back the first by the names on it counts. Paths grow by
    an edge per round from the ends of the edges, one path per pair of nodes, until each edge is closed or no pair is
    new; a start leaves when its edges are closed. Before that, ``trims`` rounds drop edges whose ends lead nowhere.
    """
    edge = pairs.select("src", "dst").where("src <> dst").distinct()
    for _ in range(trims):
        ends = edge.select(F.col("src").alias("_n")).intersect(edge.select("dst"))
        edge = stored(edge.join(ends, F.col("src") == F.col("_n"), "left_semi").join(ends, F.col("dst") == F.col("_n"), "left_semi"), "edges")
    rest = stored(edge.select("src", "dst"), "open")
    new = stored(rest.select(F.col("dst").alias("start"), F.col("dst").alias("end"), F.array("dst").alias("nodes")).distinct(), "paths")
    known, closed, rounds = new.select("start", "end"), new.select("nodes").limit(0), 0
    while not new.isEmpty():
        rounds += 1
        old = known.select(F.col("start").alias("_b"), F.col("end").alias("_e"))
        step = new.join(edge.select(F.col("src").alias("_s"), F.col("dst").alias("_d")), F.col("end") == F.col("_s")).select("start", F.col("_d").alias("end"), F.concat("nodes", F.array("_d")).alias("nodes"))
        step = stored(step.join(old, F.expr("start = _b and end = _e"), "left_anti").groupBy("start", "end").agg(F.min("nodes").alias("nodes")), "paths")
        known = known.unionByName(step.select("start", "end"))
        closed = closed.unionByName(rest.join(step, F.expr("dst = start and src = end")).select("nodes"))
        rest = stored(rest.join(step, F.expr("dst = start and src = end"), "left_anti"), "open")
        new = step.join(rest.select(F.col("dst").alias("_b")).distinct(), F.col("start") == F.col("_b"), "left_semi")
        if rounds % 16 == 0:  # else the plan grows with the rounds
            known, closed = stored(known, "pairs"), stored(closed, "cycles")
    at = F.array_position("nodes", F.array_min("nodes")).cast("int")
    turned = closed.select(F.concat(F.slice("nodes", at, F.size("nodes")), F.slice("nodes", F.lit(1), at - 1)).alias("nodes")).distinct()
    return turned.select("nodes", F.size("nodes").cast("bigint").alias("length"))


def components(pairs: DataFrame) -> DataFrame:
    """node and component (its smallest node): nodes joined by edges of either direction.

    Labels are lowered along edges and along labels in turn, so the number of rounds grows with the logarithm of the
    longest path; every round is a join and an aggregate on nodes, with nothing on the driver but whether it ended.
    """
    one = pairs.select("src", "dst").where("src is not null and dst is not null")
    edge = stored(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    label = held = stored(edge.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")), "labels")
    while True:
        near = edge.join(label.select(F.col("node").alias("_n"), F.col("component").alias("_c")), F.col("dst") == F.col("_n")).groupBy("src").agg(F.min("_c").alias("_near"))
        lower = label.join(near, F.col("node") == F.col("src"), "left").select("node", F.least("component", F.coalesce("_near", "component")).alias("component"), F.col("component").alias("_old"))
        jump = lower.select(F.col("node").alias("_j"), F.col("component").alias("_k"))
        now = lower.join(jump, F.col("component") == F.col("_j"), "left").select("node", F.least("component", F.coalesce("_k", "component")).alias("component"), "_old")
        now = stored(now.withColumn("_moved", F.col("component") != F.col("_old")), "labels", instead=held)
        held = now
        ended = now.where("_moved").isEmpty()
        label = now.select("node", "component")
        if ended:
            return label


def ranked(rows: DataFrame, by: str, most: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The largest ``most`` rows of each group by a number, ties by all other columns in order."""
    others = [c for c in rows.columns if c != by and c not in keys]
    rank = Window.partitionBy(*keys).orderBy(F.desc(by), *others)
    return rows.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= most).drop("_n")
