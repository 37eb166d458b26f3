"""Texts as lines, and what a reader's state tells about each line: fences, blocks, sections, the comment before.

Each state is a window over the lines of one text. The lines are kept in an array until a state is needed, so a text
is split once; a text's lines make one group, whose size is that of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import clean_markdown


def lines(texts: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns kept, line (from 1) and its text, without line ends of any kind; a null text has no lines, an empty one has one."""
    split = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n", -1)
    return texts.select(key, *keep, F.posexplode(split).alias("line", "row")).withColumn("line", (F.col("line") + 1).cast("bigint"))


def _strip(text) -> Column:
    """Without blanks and tabs at both ends."""
    return F.trim(text, F.lit(" \t"))


def _so_far(key: str):
    return Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)


def fenced(rows: DataFrame, key: str, fence: str = "```") -> DataFrame:
    """Adds ``fence`` (the line opens or closes a block) and ``inside`` (it stands within one); an open block lasts to the end."""
    mark = _strip("row").startswith(fence)
    df = rows.withColumn("fence", mark)
    odd = F.sum(F.col("fence").cast("int")).over(_so_far(key)) % 2 == 1
    return df.withColumn("inside", ~F.col("fence") & odd)


def depths(rows: DataFrame, key: str, opening: str = "{", closing: str = "}") -> DataFrame:
    """Adds ``depth`` after each line: opening less closing signs so far."""
    count = lambda sign: F.length("row") - F.length(F.replace("row", F.lit(sign), F.lit("")))
    return rows.withColumn("depth", F.sum(count(opening) - count(closing)).over(_so_far(key)).cast("bigint"))


def sections(rows: DataFrame, key: str) -> DataFrame:
    """key, level, title, first and last line and number of lines with text of each section under a heading outside fences."""
    df = fenced(rows, key)
    head = F.when(~F.col("inside") & ~F.col("fence"), F.regexp_extract("row", r"^(#{1,6}) +\S", 1))
    df = df.withColumn("_mark", F.nullif(head, F.lit("")))
    df = df.withColumn("_no", F.count("_mark").over(_so_far(key)))
    by_line = F.min(F.struct("line", "row")).alias("h")
    return (
        df.where("_no > 0").groupBy(key, "_no")
        .agg(by_line, F.max("line").alias("last"), F.count_if(_strip("row") != "").alias("_full"))
        .select(
            key, F.length(F.regexp_extract("h.row", "^(#+)", 1)).cast("bigint").alias("level"), F.trim(F.regexp_replace("h.row", "^#+ +", "")).alias("title"),
            F.col("h.line").alias("first"), "last", (F.col("_full") - 1).alias("filled"),
        )
    )


def bullets(rows: DataFrame, key: str, most: int = 10, longest: int = 200) -> DataFrame:
    """The first bullets of each text outside fences: key, ord and item. Items of ``longest`` bytes or more are left out."""
    df = fenced(rows, key).where("not inside and not fence").withColumn("item", F.trim(F.regexp_extract("row", r"^[ \t]*[-*+] +(.+)$", 1)))
    df = df.where((F.col("item") != "") & (F.octet_length("item") < longest))
    order = F.row_number().over(Window.partitionBy(key).orderBy("line"))
    return df.withColumn("ord", order.cast("bigint")).where(F.col("ord") <= most).select(key, "ord", "item")


def descriptions(rows: DataFrame, key: str) -> DataFrame:
    """The first paragraph after the title: key and description, with markup cleaned. Texts without title or prose give no row.

    Fenced and indented lines aren't prose. The paragraph ends at an empty line or a heading.
    """
    df = fenced(rows, key).where("not inside and not fence and not row rlike '^(    |\\t)'")
    so_far = _so_far(key)
    blank, head = _strip("row") == "", F.ltrim("row", F.lit(" \t")).startswith("#")
    df = df.withColumns({"_blank": blank, "_head": head, "_titled": F.max(F.when(F.ltrim("row", F.lit(" \t")).startswith("# "), F.col("line"))).over(Window.partitionBy(key))})
    first_title = F.min(F.when(F.ltrim("row", F.lit(" \t")).startswith("# "), F.col("line"))).over(Window.partitionBy(key))
    df = df.withColumn("_title", first_title).where("line > _title")
    df = df.withColumn("_prose", ~F.col("_blank") & ~F.col("_head"))
    # the paragraph: prose lines before the first break that follows a prose line; a heading before any prose ends the search
    df = df.withColumn("_seen", F.max(F.col("_prose").cast("int")).over(so_far))
    stop = F.sum((F.col("_head") | (F.col("_blank") & (F.col("_seen") == 1))).cast("int")).over(so_far)
    df = df.withColumn("_stop", stop).where("_stop = 0 and _prose")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", _strip("row").alias("t")))), lambda x: x["t"]), " ")
    return df.groupBy(key).agg(clean_markdown(joined).alias("description"))


def commented(rows: DataFrame, key: str, target: str, comment: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines that match ``target`` with the last comment since the target before, or null: key, line, name, comment and ``keep``.

    ``target`` and ``comment`` are regular expressions whose first group is the name and the text.
    """
    df = rows.withColumns({"_name": F.nullif(F.regexp_extract("row", target, 1), F.lit("")), "_said": F.nullif(F.regexp_extract("row", comment, 1), F.lit(""))})
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_part", F.coalesce(F.count("_name").over(before), F.lit(0)))
    within = Window.partitionBy(key, "_part").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("comment", F.last("_said", ignorenulls=True).over(within)).where("_name is not null").select(key, "line", F.col("_name").alias("name"), "comment", *keep)


def required(rows: DataFrame, key: str, indirect: str = "// indirect") -> DataFrame:
    """Module requirements: key, module and version, from single lines and ``require (`` blocks; indirect ones are left out."""
    opens, closes = _strip("row").rlike(r"^require\s*\($"), _strip("row") == ")"
    df = rows.withColumns({"_open": opens, "_close": closes})
    # a block is open if the last of the two signs before the line opened it
    last = F.last(F.when(F.col("_open"), True).when(F.col("_close"), False), ignorenulls=True)
    df = df.withColumn("_in", F.coalesce(last.over(_so_far(key)), F.lit(False)) & ~F.col("_open"))
    line = F.when(F.col("_in"), _strip("row")).otherwise(F.regexp_extract("row", r"^\s*require\s+([^(].*)$", 1))
    df = df.withColumn("_req", line).where(~F.contains("row", F.lit(indirect)))
    df = df.withColumns({"module": F.regexp_extract("_req", r"^(\S+)\s+v", 1), "version": F.regexp_extract("_req", r"^\S+\s+(v\S+)", 1)})
    return df.where("module <> ''").select(key, "line", "module", "version")
