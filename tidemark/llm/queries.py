"""Queries of the text operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import conversations, handwritten, packing, reading, tokens
from tidemark.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, folder) under its name, with its SQL if it has one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query()
def p1_found(spark, d):
    return handwritten.found(table(spark, d, "files"), table(spark, d, "files_content", spread=True))


@query()
def p1_kinds(spark, d):
    return handwritten.classify(table(spark, d, "files"), table(spark, d, "files_content", spread=True))


CONVERSATIONS_SQL = r"""
WITH once AS (
  SELECT *, coalesce(nullif(session_id, ''), regexp_replace(regexp_extract(file_name, '([^/\\]+)$', 1), '\.jsonl$', '')) AS session, CASE WHEN json_valid(message_json) THEN message_json::JSON END AS j,
    CASE WHEN regexp_matches(logged_at, '^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt]([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$')
      THEN TRY_CAST(regexp_replace(upper(logged_at), '(\.\d{6})\d+', '\1') AS TIMESTAMPTZ) END AS seen
  FROM session_entries QUALIFY row_number() OVER (PARTITION BY coalesce(entry_uuid, '#' || entry_id::VARCHAR) ORDER BY received_at DESC, entry_id DESC) = 1),
parts AS (
  SELECT *, CASE json_type(j, '$.content') WHEN 'ARRAY' THEN json_extract(j, '$.content[*]') WHEN 'OBJECT' THEN [json_extract(j, '$.content')] ELSE [] END AS blocks,
    '[^\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{2800}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}]' AS shown FROM once WHERE entry_type IN ('user', 'assistant')),
facts AS (
  SELECT session, entry_type, seen, entry_uuid, entry_id, line_no, coalesce(TRY_CAST(rpad(regexp_extract(logged_at, '\.\d{6}(\d{1,3})', 1), 3, '0') AS INT), 0) AS nanos,
    coalesce(json_type(j) = 'OBJECT' AND j->>'$.role' = entry_type AND json_type(j, '$.role') = 'VARCHAR', false) AND seen IS NOT NULL AS good,
    coalesce((json_type(j, '$.content') = 'VARCHAR' AND regexp_matches(j->>'$.content', shown)), false)
      OR len(list_filter(blocks, lambda b: coalesce(b->>'$.type' = 'text' AND json_type(b, '$.text') = 'VARCHAR' AND regexp_matches(b->>'$.text', shown), false))) > 0 AS has_text,
    CASE WHEN json_type(j) = 'OBJECT' THEN CASE WHEN json_type(j, '$.content') = 'VARCHAR' THEN j->>'$.content'
      ELSE array_to_string(list_transform(list_filter(blocks, lambda b: coalesce(b->>'$.type' = 'text' AND json_type(b, '$.text') = 'VARCHAR', false)), lambda b: b->>'$.text'), chr(10)) END END AS body,
    CASE WHEN json_type(j, '$.role') = 'VARCHAR' THEN j->>'$.role' END AS role,
    list_transform(list_filter(blocks, lambda b: coalesce(b->>'$.type' = 'tool_use' AND json_type(b, '$.id') = 'VARCHAR', false)), lambda b: b->>'$.id') AS calls,
    list_transform(list_filter(blocks, lambda b: coalesce(b->>'$.type' = 'tool_result' AND json_type(b, '$.tool_use_id') = 'VARCHAR', false)), lambda b: b->>'$.tool_use_id') AS answers,
    len(list_filter(blocks, lambda b: coalesce(b->>'$.type' = 'tool_use', false))) > 0 AS uses, len(list_filter(blocks, lambda b: coalesce(b->>'$.type' = 'tool_result', false))) > 0 AS results FROM parts),
events AS (
  SELECT *, row_number() OVER w AS place, CASE WHEN entry_type = 'user' AND has_text THEN 1 WHEN entry_type = 'assistant' AND (has_text OR uses) THEN 2 END AS kind FROM facts
  WINDOW w AS (PARTITION BY session ORDER BY seen NULLS FIRST, nanos, line_no, coalesce(entry_uuid, '#' || entry_id::VARCHAR))),
waiting AS (SELECT session FROM (SELECT session, kind, lead(kind) OVER (PARTITION BY session ORDER BY place) AS next FROM events WHERE kind IS NOT NULL) WHERE kind = 1 AND coalesce(next, 1) = 1),
dropped AS (SELECT DISTINCT s.session FROM (SELECT DISTINCT session FROM once) s
  WHERE s.session NOT IN (SELECT session FROM facts WHERE has_text OR uses OR results) OR s.session IN (SELECT session FROM facts WHERE NOT good)
    OR s.session IN (SELECT session FROM events WHERE place = 1 AND entry_type <> 'user') OR s.session IN (SELECT session FROM waiting))
"""

#: Best parents by brute force over all pairs of messages of a session, and their trees.
_W = conversations.WEIGHTS
TREES_SQL = CONVERSATIONS_SQL.replace("WITH once", "WITH RECURSIVE once") + rf"""
, m AS (
  SELECT *, place - 1 AS p, list_distinct(list_filter(regexp_split_to_array(lower(body), '[\s\x0b\x1c-\x1f\x85\p{{Z}}]+'), lambda w: w <> '')) AS words,
    max(CASE WHEN kind = 1 THEN place - 1 END) OVER b AS asked, coalesce(max(CASE WHEN kind = 2 THEN place - 1 END) OVER b, -1) AS replied FROM events WINDOW b AS (PARTITION BY session ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
calls AS (SELECT session, p, unnest(calls) AS id FROM m),
told AS (SELECT DISTINCT a.session, a.p, max(c.p) AS i FROM (SELECT session, p, unnest(answers) AS id FROM m) a JOIN calls c ON a.session = c.session AND a.id = c.id AND c.p < a.p GROUP BY a.session, a.p, a.id),
scored AS (
  SELECT m.session, m.p, c.p AS i, m.kind,
    CASE WHEN m.kind = 2 AND c.p = m.asked AND m.replied < m.asked THEN {_W["turn"]}::DOUBLE WHEN t.i IS NOT NULL THEN {_W["mention"]}::DOUBLE
      ELSE {_W["words"]}::DOUBLE * (len(list_intersect(m.words, c.words))::DOUBLE / greatest(least(len(m.words), len(c.words)), 1)) END
    + {_W["time"]}::DOUBLE * ln(1::DOUBLE + CASE WHEN m.seen IS NULL THEN 0 WHEN c.seen IS NULL THEN {conversations.UNKNOWN}::DOUBLE ELSE greatest(epoch_us(m.seen) - epoch_us(c.seen), 0) / 1e6::DOUBLE END + {conversations.STEP}::DOUBLE * (m.p - c.p))
    + CASE WHEN m.entry_type <> c.entry_type THEN {_W["speaker"]}::DOUBLE ELSE 0::DOUBLE END AS score
  FROM m JOIN m c ON m.session = c.session AND c.p < m.p LEFT JOIN told t ON t.session = m.session AND t.p = m.p AND t.i = c.p),
best AS (SELECT session, p, i AS parent, score, kind FROM scored QUALIFY row_number() OVER (PARTITION BY session, p ORDER BY score DESC, i DESC) = 1),
linked AS (SELECT m.session, m.p, CASE WHEN m.kind = 1 AND score <= {conversations.TIED} THEN NULL ELSE parent END AS parent FROM m LEFT JOIN best b ON b.session = m.session AND b.p = m.p),
trees AS (SELECT session, p, parent, p AS root, 0 AS depth FROM linked WHERE parent IS NULL UNION ALL SELECT l.session, l.p, l.parent, root, depth + 1 FROM trees t JOIN linked l ON l.session = t.session AND l.parent = t.p)
SELECT m.session AS session_id, p AS position, role, entry_id, epoch_us(seen) AS at_us, body AS text, uses AS tool_use, results AS tool_result, parent, root, depth
FROM m JOIN trees USING (session, p) WHERE session NOT IN (SELECT session FROM dropped)
"""


@query(CONVERSATIONS_SQL + "SELECT session AS session_id FROM dropped")
def p6_found(spark, d):
    return conversations.found(table(spark, d, "session_entries", spread=True))


@query(TREES_SQL)
def p6_conversations(spark, d):
    df = conversations.conversations(table(spark, d, "session_entries", spread=True))
    return df.withColumn("at", F.unix_micros("at")).withColumnRenamed("at", "at_us")


@query()
def p7_ids(spark, d):
    return tokens.encode(table(spark, d, "documents", spread=True))


@query("SELECT doc_id, coalesce(text, '') AS decoded FROM documents")
def p7_decoded(spark, d):
    """Every text put together again from its ids and the offsets of its pieces."""
    return tokens.decode(tokens.encode(table(spark, d, "documents", spread=True), offsets=True)).select("doc_id", "decoded")


@query()
def p8_containers(spark, d):
    return packing.containers(table(spark, d, "documents", spread=True))


@query()
def p8_summary(spark, d):
    """How full the containers are."""
    packed = packing.containers(table(spark, d, "documents", spread=True)).where("container is not null")
    filled = packed.groupBy("container").agg(F.count(F.lit(1)).alias("texts"), F.sum("n_tokens").alias("used"))
    return filled.groupBy().agg(
        F.count(F.lit(1)).alias("containers"), F.sum("texts").alias("texts"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count(F.lit(1)) * packing.CAPACITY), 4).alias("filled"),
    )


@query()
def p9_found(spark, d):
    return reading.found(table(spark, d, "documents", spread=True), table(spark, d, "labels"))


@query()
def p9_levels(spark, d):
    return reading.levels(table(spark, d, "documents", spread=True), table(spark, d, "labels"))


@query()
def p9_rounds(spark, d):
    """Log likelihood of the labels and change of the levels, round by round."""
    return reading.rounds(table(spark, d, "documents", spread=True), table(spark, d, "labels"))


@query()
def p9_profile(spark, d):
    """Documents per language, kind and level."""
    docs = table(spark, d, "documents")
    levels = reading.levels(table(spark, d, "documents", spread=True), table(spark, d, "labels")).select("doc_id", "level")
    lang = F.substring(F.lower("lang"), 1, 2).alias("language")
    return docs.select("doc_id", lang, "doc_kind").join(levels, "doc_id").groupBy("language", "doc_kind", "level").agg(F.count(F.lit(1)).alias("documents"))
