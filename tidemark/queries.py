"""Queries of the core and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dimensions
from tidemark.functions import text
from tidemark.operators import architecture, commands, conventions, drift, facts, features, graphs, imports, lines, listing, nested, readmes, rejects, rules, scoring, selections, syntax, usage
from tidemark.plans import reports
from tidemark.streaming import changes
from tidemark.session import stored, table

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


def _values(rows, names: str) -> str:
    quote = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "[" + ", ".join(map(quote, x)) + "]::VARCHAR[]" if isinstance(x, tuple) else "'" + str(x).replace("'", "''") + "'"  # noqa: E731, E501
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") {names}"


NESTED_SQL = """
WITH RECURSIVE m AS (
  SELECT entry_id, CASE WHEN json_valid(message_json) THEN message_json::JSON END AS j, CASE WHEN json_valid(data_json) THEN data_json::JSON END AS d FROM session_entries),
top AS (SELECT entry_id, CASE json_type(j, '$.content') WHEN 'ARRAY' THEN json_extract(j, '$.content[*]') WHEN 'OBJECT' THEN [json_extract(j, '$.content')] ELSE [] END AS e FROM m WHERE json_type(j) = 'OBJECT'),
blocks AS (
  SELECT * FROM (SELECT entry_id, unnest(range(len(e)))::VARCHAR AS block_path, unnest(e) AS b FROM top) WHERE json_type(b) = 'OBJECT'
  UNION ALL
  SELECT * FROM (SELECT entry_id, block_path || '.' || unnest(range(len(e)))::VARCHAR AS block_path, unnest(e) AS b FROM (
    SELECT entry_id, block_path, CASE json_type(b, '$.content') WHEN 'ARRAY' THEN json_extract(b, '$.content[*]') WHEN 'OBJECT' THEN [json_extract(b, '$.content')] ELSE [] END AS e FROM blocks)) WHERE json_type(b) = 'OBJECT'),
results AS (
  SELECT * FROM (SELECT entry_id, 'results.' || unnest(range(len(e)))::VARCHAR AS block_path, unnest(e) AS b FROM (
    SELECT entry_id, CASE json_type(d, '$.results') WHEN 'ARRAY' THEN json_extract(d, '$.results[*]') WHEN 'OBJECT' THEN [json_extract(d, '$.results')] ELSE [] END AS e FROM m WHERE json_type(d) = 'OBJECT')) WHERE json_type(b) = 'OBJECT'),
hits AS (
  SELECT * FROM (SELECT entry_id, block_path || '.hits.' || unnest(range(len(e)))::VARCHAR AS block_path, unnest(e) AS b FROM (
    SELECT entry_id, block_path, CASE json_type(b, '$.hits') WHEN 'ARRAY' THEN json_extract(b, '$.hits[*]') WHEN 'OBJECT' THEN [json_extract(b, '$.hits')] ELSE [] END AS e FROM results)) WHERE json_type(b) = 'OBJECT')
"""


@query(NESTED_SQL + "SELECT entry_id, block_path FROM blocks UNION ALL SELECT entry_id, block_path FROM results UNION ALL SELECT entry_id, block_path FROM hits")
def p3_found(spark, d):
    return nested.found(table(spark, d, "session_entries", spread=True))


@query()
def p3_objects(spark, d):
    return nested.objects(nested.occurrences(table(spark, d, "session_entries", spread=True), roots=True))


@query()
def p3_bridge(spark, d):
    return nested.occurrences(table(spark, d, "session_entries", spread=True), payload=False, roots=True).drop("payload")


@query("""
WITH RECURSIVE r AS (
  SELECT entry_id, source, j AS v, '' AS path, NULL::VARCHAR AS parent_path, NULL::VARCHAR AS member, 0 AS ordinal, 0 AS depth, 'record' AS kind, []::INT[] AS places FROM (
    SELECT entry_id, 'message' AS source, CASE WHEN json_valid(message_json) THEN message_json::JSON END AS j FROM session_entries
    UNION ALL SELECT entry_id, 'data', CASE WHEN json_valid(data_json) THEN data_json::JSON END FROM session_entries) WHERE json_type(j) = 'OBJECT'
  UNION ALL
  -- an array stands as a row of its own (kind null) with the path of the object that it lies in, until its objects are reached
  SELECT entry_id, source, c, CASE WHEN json_type(c) = 'ARRAY' THEN path WHEN named = 'block' THEN prefix || place::VARCHAR WHEN named IS NOT NULL THEN prefix || name || '.' || place::VARCHAR
      ELSE prefix || array_to_string(list_prepend(label, list_transform(spots, lambda x: x::VARCHAR)), '.') END,
    CASE WHEN json_type(c) = 'ARRAY' THEN up ELSE path END, name, place, CASE WHEN json_type(c) = 'ARRAY' THEN depth ELSE depth + 1 END,
    CASE WHEN json_type(c) = 'ARRAY' THEN 'array of ' || owner ELSE coalesce(named, 'object') END, CASE WHEN json_type(c) = 'ARRAY' THEN spots ELSE [] END
  FROM (SELECT *, CASE WHEN len(spots) < 2 THEN CASE WHEN source = 'message' AND owner IN ('record', 'block') AND name = 'content' THEN 'block' WHEN source = 'data' AND owner = 'record' AND name = 'results' THEN 'result'
      WHEN source = 'data' AND owner = 'result' AND name = 'hits' THEN 'hit' END END AS named, coalesce(spots[-1], 0) AS place, CASE WHEN path = '' THEN '' ELSE path || '.' END AS prefix,
      CASE WHEN regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*') THEN name ELSE to_json(name)::VARCHAR END AS label
    FROM (SELECT entry_id, source, path, parent_path AS up, depth, replace(kind, 'array of ', '') AS owner, x.k AS name, x.s AS spots, x.c AS c FROM (
      SELECT *, unnest(CASE json_type(v) WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: {'k': k, 's': []::INT[], 'c': json_extract(v, '$."' || k || '"')})
        WHEN 'ARRAY' THEN list_transform(range(json_array_length(v)::BIGINT), lambda i: {'k': member, 's': list_append(places, i::INT), 'c': json_extract(v, '$[' || i || ']')}) END) AS x FROM r)))
  WHERE json_type(c) IN ('OBJECT', 'ARRAY'))
SELECT entry_id, source, path AS block_path, parent_path, member, ordinal, depth, kind, CASE WHEN json_type(v, '$.type') = 'VARCHAR' THEN v->>'$.type' END AS type, CASE WHEN json_type(v, '$.name') = 'VARCHAR' THEN v->>'$.name' END AS name
FROM r WHERE NOT starts_with(kind, 'array')
""")  # fmt: skip
def p3_places(spark, d):
    """The bridge without identities, which SQL can't compute: every object with its place, its parent's and its depth."""
    return nested.occurrences(table(spark, d, "session_entries", spread=True), payload=False, roots=True).drop("payload", "object_id", "parent_id")


@query("""
WITH m AS (SELECT entry_id, session_id, entry_type, CASE WHEN json_valid(message_json) THEN message_json::JSON END AS j FROM session_entries)
SELECT entry_id, session_id, entry_type, j->>'$.role' AS role, j->>'$.model' AS model,
  CASE WHEN regexp_matches(j->>'$.usage.input_tokens', '^[0-9]+$') THEN TRY_CAST(j->>'$.usage.input_tokens' AS BIGINT) END AS input_tokens,
  CASE WHEN regexp_matches(j->>'$.usage.output_tokens', '^[0-9]+$') THEN TRY_CAST(j->>'$.usage.output_tokens' AS BIGINT) END AS output_tokens,
  CASE WHEN regexp_matches(j->>'$.usage.cache_creation_input_tokens', '^[0-9]+$') THEN TRY_CAST(j->>'$.usage.cache_creation_input_tokens' AS BIGINT) END AS cache_creation_input_tokens,
  CASE WHEN regexp_matches(j->>'$.usage.cache_read_input_tokens', '^[0-9]+$') THEN TRY_CAST(j->>'$.usage.cache_read_input_tokens' AS BIGINT) END AS cache_read_input_tokens
FROM m
""")
def p3_messages(spark, d):
    return nested.messages(table(spark, d, "session_entries", spread=True))


@query("""
SELECT entry_id, session_id, entry_type, j->>'$.type' AS type, j->>'$.query' AS query FROM (SELECT *, CASE WHEN json_valid(data_json) THEN data_json::JSON END AS j FROM session_entries) WHERE json_type(j) = 'OBJECT'
""")
def p3_requests(spark, d):
    """The flat table of data without identities, which SQL can't compute."""
    return nested.data(table(spark, d, "session_entries", spread=True)).drop("object_id")


@query()
def p3_data(spark, d):
    return nested.data(table(spark, d, "session_entries", spread=True))


DRIFT_SQL = f"""
WITH RECURSIVE r AS (SELECT producer, file_name, file_seq, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM log_records),
members AS (
  SELECT producer, file_name, file_seq, k AS path, json_extract(j, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(j)) AS k FROM r WHERE json_type(j) = 'OBJECT') WHERE k <> 'message'
  UNION ALL
  SELECT producer, file_name, file_seq, path || '.' || k, json_extract(v, '$."' || k || '"') FROM (SELECT *, unnest(json_keys(v)) AS k FROM members WHERE json_type(v) = 'OBJECT')),
kinds AS (
  SELECT producer, file_seq, path, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'HUGEINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number'
    WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' END AS kind FROM members WHERE json_type(v) <> 'OBJECT'),
fields AS (SELECT producer, file_seq, path, replace(array_to_string(list_sort(list(DISTINCT kind) FILTER (kind IS NOT NULL)), '|'), 'integer|number', 'number') AS kind FROM kinds GROUP BY ALL),
files AS (SELECT *, lag(file_seq) OVER w AS before, lead(file_name) OVER w AS next_file, row_number() OVER w AS ord FROM (SELECT DISTINCT producer, file_seq, file_name FROM log_records) WINDOW w AS (PARTITION BY producer ORDER BY file_seq, file_name)),
names AS (SELECT * FROM {_values([(p, c) for c, (_, ps) in drift.ALIASES.items() for p in ps], "v(path, told)")}),
told AS (SELECT f.*, coalesce(n.told, lower(regexp_replace(f.path, '[._-]', '', 'g'))) AS told FROM fields f LEFT JOIN names n USING (path)),
ended AS (SELECT files.producer, file_name, told, path, kind, row_number() OVER (PARTITION BY file_name, told ORDER BY path) AS n FROM files JOIN told t ON t.producer = files.producer AND t.file_seq = before
  WHERE NOT EXISTS (SELECT 1 FROM fields x WHERE x.producer = files.producer AND x.file_seq = files.file_seq AND x.path = t.path)),
begun AS (SELECT files.producer, file_name, told, path, kind, row_number() OVER (PARTITION BY file_name, told ORDER BY path) AS n FROM files JOIN told t ON t.producer = files.producer AND t.file_seq = files.file_seq
  WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fields x WHERE x.producer = files.producer AND x.file_seq = before AND x.path = t.path)),
pairs AS (SELECT coalesce(e.producer, b.producer) AS producer, coalesce(e.file_name, b.file_name) AS file_name, e.path AS old_path, b.path AS new_path, e.kind AS old_type, b.kind AS new_type
  FROM ended e FULL JOIN begun b ON e.file_name = b.file_name AND e.told = b.told AND e.n = b.n),
changes AS (
  SELECT producer, file_name, coalesce(old_path, new_path) AS field, CASE WHEN old_path IS NULL THEN 'added' WHEN new_path IS NULL THEN 'removed' ELSE 'renamed' END AS change, old_path, new_path, old_type, new_type FROM pairs
  UNION ALL SELECT producer, file_name, old_path, 'retyped', old_path, new_path, old_type, new_type FROM pairs WHERE old_path IS NOT NULL AND new_path IS NOT NULL AND old_type <> new_type
  UNION ALL SELECT files.producer, file_name, a.path, 'retyped', a.path, b.path, a.kind, b.kind FROM files JOIN fields a ON a.producer = files.producer AND a.file_seq = before JOIN fields b ON b.producer = files.producer AND b.file_seq = files.file_seq AND b.path = a.path WHERE a.kind <> b.kind)
"""


@query(DRIFT_SQL + "SELECT file_name, field, change FROM changes")
def p2_found(spark, d):
    return drift.changes(table(spark, d, "log_records", spread=True)).select("file_name", "field", "change")


@query(DRIFT_SQL + "SELECT * FROM changes")
def p2_changes(spark, d):
    return drift.changes(table(spark, d, "log_records", spread=True))


@query(DRIFT_SQL + """
, uses AS (SELECT t.producer, path, told, kind, file_name, ord, next_file, CASE WHEN ord = lag(ord) OVER w + 1 AND kind = lag(kind) OVER w THEN 0 ELSE 1 END AS new
  FROM told t JOIN files USING (producer, file_seq) WINDOW w AS (PARTITION BY t.producer, path ORDER BY ord)),
islands AS (SELECT *, sum(new) OVER (PARTITION BY producer, path ORDER BY ord) AS island FROM uses)
SELECT producer, path AS field, any_value(kind) AS type, min(ord) AS first_ord, max(ord) AS last_ord, arg_min(file_name, ord) AS first_file, arg_max(file_name, ord) AS last_file,
  arg_max_null(next_file, ord) AS next_file, any_value(told) AS information FROM islands GROUP BY producer, path, island
""")
def p2_catalogue(spark, d):
    return drift.lifespans(table(spark, d, "log_records", spread=True))


@query()
def p2_unified(spark, d):
    return drift.unified(table(spark, d, "log_records", spread=True))


def _separated_sql(form: str, sep: str) -> str:
    """Verdicts on the lines of one separated format; patterns without possessive loops, which RE2 doesn't know and doesn't need."""
    cell = f"""(?:"(?:[^"]|"")*"|[^"{sep}\\r\\n]*)"""
    text = lambda name: f"list_position(names, '{name}') AS _{name}"
    value = lambda name: f"CASE WHEN starts_with(cells[_{name}], '\"') THEN replace(substr(cells[_{name}], 2, length(cells[_{name}]) - 2), '\"\"', '\"') ELSE cells[_{name}] END AS {name}"
    typed = lambda p: f"NOT regexp_full_match(c, '(?:\"{p}\"|{p})')"
    return f"""
{form}_l AS (SELECT l.*, list_transform(string_split(header, '{sep}'), lambda n: trim(n, ' "')) AS names FROM l LEFT JOIN h USING (file_name) WHERE form = '{form}' AND line_no <> 1),
{form}_c AS (SELECT *, CASE WHEN regexp_full_match(raw, '{cell}(?:{sep}{cell})*') THEN regexp_extract_all('{sep}' || raw, '{sep}({cell})', 1) END AS cells,
  len(regexp_extract_all(regexp_extract(raw, '^((?:{cell}{sep})*)', 1), '({cell}){sep}', 1)) AS before, {", ".join(map(text, rejects.COLUMNS))} FROM {form}_l),
{form}_b AS (SELECT *, list_filter(range(1, len(cells) + 1), lambda i: CASE names[i] WHEN 'logged_at' THEN {typed("@TIME@").replace("(c,", "(cells[i],")} WHEN 'entry_type' THEN {typed("(?:user|assistant|system|progress)").replace("(c,", "(cells[i],")}
  WHEN 'output_tokens' THEN {typed("[0-9]*").replace("(c,", "(cells[i],")} ELSE false END) AS bad FROM {form}_c),
{form}_v AS (SELECT line_id, file_name, line_no, CASE WHEN cells IS NULL THEN 'syntax' WHEN names IS NULL OR len(cells) <> len(names) THEN 'columns' WHEN len(bad) > 0 THEN 'value' END AS reason,
  CASE WHEN cells IS NULL THEN names[before + 1] WHEN len(cells) <> len(names) THEN names[len(cells) + 1] ELSE names[bad[1]] END AS field, {", ".join(map(value, rejects.COLUMNS))} FROM {form}_b)"""


REJECTS_SQL = (r"""
WITH l AS (SELECT line_id, file_name, lower(file_format) AS form, line_no, raw FROM raw_lines),
h AS (SELECT file_name, arg_min(raw, line_id) AS header FROM l WHERE line_no = 1 AND form IN ('csv', 'tsv') GROUP BY 1),""" + _separated_sql("csv", ",") + "," + _separated_sql("tsv", "\t") + r""",
o AS (SELECT *, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' AND NOT regexp_matches(regexp_replace(raw, '"(?:[^"\\]|\\.)*"', '""', 'g'), ',\s*[}\]]') THEN raw::JSON END AS o FROM l WHERE form = 'jsonl'),
k AS (SELECT *, coalesce(json_keys(o), []) AS k, coalesce(json_keys(o, '$.message'), []) AS m, coalesce(json_keys(o, '$.message.content[0]'), []) AS c FROM o),
f AS (SELECT *, CASE WHEN o IS NULL THEN NULL WHEN NOT list_contains(k, 'session_id') THEN 'session_id' WHEN NOT list_contains(k, 'logged_at') THEN 'logged_at' WHEN NOT list_contains(k, 'entry_type') THEN 'entry_type'
    WHEN NOT list_contains(m, 'role') THEN 'message.role' WHEN NOT list_contains(c, 'text') THEN 'message.content[0].text' END AS missing,
  CASE WHEN NOT coalesce(regexp_full_match(o->>'$.logged_at', '@TIME@'), false) THEN 'logged_at' WHEN NOT coalesce(o->>'$.entry_type' IN ('user', 'assistant', 'system', 'progress'), false) THEN 'entry_type'
    WHEN NOT coalesce(regexp_full_match(o->>'$.output_tokens', '[0-9]*'), true) THEN 'output_tokens' END AS bad FROM k),
json_v AS (SELECT line_id, file_name, line_no, CASE WHEN o IS NULL THEN 'syntax' WHEN missing IS NOT NULL THEN 'columns' WHEN bad IS NOT NULL THEN 'value' END AS reason, CASE WHEN o IS NOT NULL THEN coalesce(missing, bad) END AS field,
  o->>'$.session_id' AS session_id, o->>'$.logged_at' AS logged_at, o->>'$.entry_type' AS entry_type, o->>'$.message.role' AS role, o->>'$.output_tokens' AS output_tokens, o->>'$.message.content[0].text' AS text FROM f),
v AS (SELECT * FROM csv_v UNION ALL SELECT * FROM tsv_v UNION ALL SELECT * FROM json_v)
""").replace("@TIME@", rejects.TIME.replace("++", "+"))


@query(REJECTS_SQL + "SELECT line_id, reason FROM v WHERE reason IS NOT NULL")
def p4_found(spark, d):
    return rejects.found(table(spark, d, "raw_lines", spread=True))


@query(REJECTS_SQL + "SELECT line_id, reason, field FROM v WHERE reason IS NOT NULL")
def p4_fields(spark, d):
    return rejects.fields(table(spark, d, "raw_lines", spread=True))


@query(REJECTS_SQL + r"""
SELECT line_id, file_name, line_no, session_id, epoch_us(CAST(regexp_replace(upper(logged_at), '(\.\d{6})\d+', '\1') AS TIMESTAMPTZ)) AS logged_at_us, entry_type, nullif(role, '') AS role,
  TRY_CAST(output_tokens AS BIGINT) AS output_tokens, text FROM v WHERE reason IS NULL
""")  # fmt: skip
def p4_loaded(spark, d):
    df = rejects.loaded(table(spark, d, "raw_lines", spread=True))
    return df.select("line_id", "file_name", "line_no", "session_id", F.unix_micros("logged_at").alias("logged_at_us"), "entry_type", "role", "output_tokens", "text")


#: Latest delivery of each entry, its calls at any depth, and their features per session.
FEATURES_SQL = r"""
WITH RECURSIVE e AS (
  SELECT entry_id, coalesce(entry_uuid, '#' || entry_id::VARCHAR) AS entry, received_at,
    coalesce(nullif(session_id, ''), regexp_replace(regexp_extract(file_name, '([^/\\]+)$', 1), '\.jsonl$', '')) AS entity,
    CASE WHEN regexp_matches(logged_at, '^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt]([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$')
      THEN TRY_CAST(regexp_replace(upper(logged_at), '(\.\d{6})\d+', '\1') AS TIMESTAMPTZ) END AS logged,
    CASE WHEN json_valid(message_json) THEN message_json::JSON END AS m
  FROM session_entries),
last AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY entry ORDER BY received_at DESC, entry_id DESC) = 1),
kids AS (
  SELECT entry, unnest(CASE json_type(m, '$.content') WHEN 'ARRAY' THEN json_extract(m, '$.content[*]') WHEN 'OBJECT' THEN [json_extract(m, '$.content')] ELSE [] END) AS b FROM last WHERE json_type(m) = 'OBJECT'
  UNION ALL
  SELECT entry, unnest(CASE json_type(b, '$.content') WHEN 'ARRAY' THEN json_extract(b, '$.content[*]') WHEN 'OBJECT' THEN [json_extract(b, '$.content')] ELSE [] END) FROM kids WHERE json_type(b) = 'OBJECT'),
calls AS (
  SELECT entry, json_extract_string(b, '$.name') AS feature, count(*) AS n FROM kids
  WHERE json_type(b) = 'OBJECT' AND json_extract_string(b, '$.type') = 'tool_use' AND json_type(b, '$.name') = 'VARCHAR' AND json_extract_string(b, '$.name') <> ''
  GROUP BY ALL),
f AS (
  SELECT entity, feature, sum(n)::BIGINT AS n, max(coalesce(logged, received_at)) AS latest,
    sum(CASE WHEN regexp_matches(json_extract_string(m, '$.usage.output_tokens'), '^\d+$') THEN TRY_CAST(json_extract_string(m, '$.usage.output_tokens') AS BIGINT) ELSE 0 END)::BIGINT AS total
  FROM calls JOIN last USING (entry) GROUP BY ALL)
"""
LONG_SQL = FEATURES_SQL + "SELECT entity, feature, n, total, epoch_us(latest) AS latest_us FROM f"


@query(FEATURES_SQL + """
, wide AS (
  SELECT entity, list(feature ORDER BY feature) AS tools, list(n ORDER BY feature) AS calls,
    list(((floor(epoch(mx)) - floor(epoch(latest)))::BIGINT) ORDER BY feature) AS seconds_since_last, list(total ORDER BY feature) AS output_tokens
  FROM f, (SELECT max(latest) AS mx FROM f) GROUP BY entity)
SELECT s.entity AS session_id, coalesce(tools, []) AS tools, coalesce(calls, []) AS calls, coalesce(seconds_since_last, []) AS seconds_since_last, coalesce(output_tokens, []) AS output_tokens
FROM (SELECT DISTINCT entity FROM e) s LEFT JOIN wide w ON s.entity IS NOT DISTINCT FROM w.entity
""")  # fmt: skip
def p5_features(spark, d):
    return features.session_features(table(spark, d, "session_entries", spread=True))


def _long(df: DataFrame) -> DataFrame:
    return df.select("entity", "feature", "n", "total", F.unix_micros("latest").alias("latest_us"))


@query(LONG_SQL)
def p5_long(spark, d):
    return _long(features.session_tools(features.tool_calls(table(spark, d, "session_entries", spread=True))))


@query(LONG_SQL)
def p5_applied(spark, d):
    """The same table, built from the deliveries of the first nine tenths of the time and kept up with the rest as one batch."""
    entries = table(spark, d, "session_entries", spread=True)
    cut = entries.agg(F.percentile_approx(F.unix_micros("received_at"), 0.9)).scalar()
    late = F.coalesce(F.unix_micros("received_at") >= cut, F.lit(False))
    calls = features.tool_calls(entries.where(~late))
    state = stored(features.session_tools(calls), "features")
    return _long(features.applied(state, calls.where("last"), entries.where(late))[0])


# --- usage ---------------------------------------------------------------------------------------------------------

#: Latest delivery of each entry, its parts and its calls, as the operators of usage read them.
USAGE_SQL = r"""
WITH once AS (
  SELECT *, coalesce(nullif(session_id, ''), regexp_replace(regexp_extract(file_name, '([^/\\]+)$', 1), '\.jsonl$', '')) AS session,
    CASE WHEN regexp_matches(logged_at, '^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt]([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$')
      THEN TRY_CAST(regexp_replace(upper(logged_at), '(\.\d{6})\d+', '\1') AS TIMESTAMPTZ) END AS seen,
    CASE WHEN json_valid(message_json) THEN message_json::JSON END AS m
  FROM session_entries
  QUALIFY row_number() OVER (PARTITION BY coalesce(entry_uuid, '#' || entry_id::VARCHAR) ORDER BY received_at DESC, entry_id DESC) = 1),
parts AS (
  SELECT entry_id, session, entry_type, seen, m,
    coalesce(nullif(regexp_replace(m->>'$.model', '(.)-[0-9]{8}$', '\1'), ''), 'unknown') AS model,
    CASE WHEN regexp_matches(m->>'$.usage.input_tokens', '^[0-9]{1,18}$') THEN (m->>'$.usage.input_tokens')::BIGINT ELSE 0 END AS input_tokens,
    CASE WHEN regexp_matches(m->>'$.usage.output_tokens', '^[0-9]{1,18}$') THEN (m->>'$.usage.output_tokens')::BIGINT ELSE 0 END AS output_tokens,
    CASE WHEN regexp_matches(m->>'$.usage.cache_creation_input_tokens', '^[0-9]{1,18}$') THEN (m->>'$.usage.cache_creation_input_tokens')::BIGINT ELSE 0 END AS cache_creation_input_tokens,
    CASE WHEN regexp_matches(m->>'$.usage.cache_read_input_tokens', '^[0-9]{1,18}$') THEN (m->>'$.usage.cache_read_input_tokens')::BIGINT ELSE 0 END AS cache_read_input_tokens
  FROM once),
assistant AS (SELECT * FROM parts WHERE entry_type = 'assistant' AND seen IS NOT NULL),
turns AS (SELECT * FROM assistant WHERE input_tokens > 0 OR output_tokens > 0),
blocks AS (SELECT entry_id, session, seen, model, unnest(CASE WHEN json_type(m, '$.content') = 'ARRAY' THEN json_extract(m, '$.content[*]') ELSE [] END) AS b FROM assistant),
calls AS (
  SELECT session, seen, model, b->>'$.name' AS tool, coalesce(nullif(b->>'$.input.file_path', ''), nullif(b->>'$.input.path', '')) AS path
  FROM blocks WHERE json_type(b) = 'OBJECT' AND b->>'$.type' = 'tool_use' AND b->>'$.name' <> ''),
ops AS (
  SELECT CASE WHEN starts_with(path, '/srv/work/') THEN substr(path, 11) ELSE path END AS path, count(*) AS operations,
    count(*) FILTER (tool = 'Read') AS reads, count(*) FILTER (tool = 'Edit') AS edits, count(*) FILTER (tool = 'Write') AS writes
  FROM calls WHERE path IS NOT NULL GROUP BY 1),
per_session AS (
  SELECT p.session AS session_id, sum(CASE WHEN entry_type = 'assistant' AND seen IS NOT NULL AND (input_tokens > 0 OR output_tokens > 0) THEN 1 ELSE 0 END)::BIGINT AS turns,
    coalesce(any_value(c.n), 0)::BIGINT AS calls,
    min(CASE WHEN entry_type IN ('user', 'assistant') THEN epoch_us(seen) END) AS start_us, max(CASE WHEN entry_type IN ('user', 'assistant') THEN epoch_us(seen) END) AS end_us
  FROM parts p LEFT JOIN (SELECT session, count(*) AS n FROM calls GROUP BY 1) c ON c.session = p.session
  GROUP BY p.session HAVING turns > 0 OR calls > 0)
"""
ROOT = "/srv/work"


def _once(spark, d):
    return usage.entries_once(table(spark, d, "session_entries", spread=True))


def _operations(spark, d):
    return usage.file_operations(usage.tool_calls(_once(spark, d)), F.lit(ROOT))


@query(USAGE_SQL + "SELECT tool, count(*) AS calls, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share FROM calls GROUP BY tool")
def usage_tools(spark, d):
    return usage.tool_usage(usage.tool_calls(_once(spark, d)))


@query(USAGE_SQL + "SELECT * FROM ops ORDER BY operations DESC, path LIMIT 15")
def usage_hot_files(spark, d):
    return usage.hot_files(_operations(spark, d))


@query(USAGE_SQL + """
SELECT * FROM (SELECT 'repeated_reads' AS kind, path, reads AS count FROM ops WHERE reads >= 10
  UNION ALL SELECT 'write_then_edit', path, edits FROM ops WHERE writes > 0 AND edits >= 2) ORDER BY count DESC, path, kind LIMIT 10
""")  # fmt: skip
def usage_pain_points(spark, d):
    return usage.pain_points(_operations(spark, d))


@query(USAGE_SQL + """
SELECT * FROM (SELECT 'repeated_reads' AS kind, path, reads AS count FROM ops WHERE reads >= 2
  UNION ALL SELECT 'write_then_edit', path, edits FROM ops WHERE writes > 0 AND edits >= 1) ORDER BY count DESC, path, kind LIMIT 100
""")  # fmt: skip
def usage_pain_points_low(spark, d):
    """The same report with lower thresholds, for logs in which few files come up often."""
    return usage.pain_points(_operations(spark, d), 100, rereads=2, rewrites=1)


@query(USAGE_SQL + """
SELECT model, count(*) AS turns, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
  sum(cache_creation_input_tokens)::BIGINT AS cache_creation_input_tokens, sum(cache_read_input_tokens)::BIGINT AS cache_read_input_tokens
FROM turns GROUP BY model
""")  # fmt: skip
def usage_models(spark, d):
    return usage.models(usage.turns(_once(spark, d)))


@query(USAGE_SQL + "SELECT * FROM per_session")
def usage_sessions(spark, d):
    return usage.sessions(_once(spark, d))


@query(USAGE_SQL + """
SELECT count(*) AS sessions, sum(turns)::BIGINT AS turns, sum(calls)::BIGINT AS calls, min(start_us) AS start_us, max(end_us) AS end_us,
  (SELECT sum(input_tokens)::BIGINT FROM turns) AS input_tokens, (SELECT sum(output_tokens)::BIGINT FROM turns) AS output_tokens,
  (SELECT sum(cache_creation_input_tokens)::BIGINT FROM turns) AS cache_creation_input_tokens, (SELECT sum(cache_read_input_tokens)::BIGINT FROM turns) AS cache_read_input_tokens
FROM per_session
""")  # fmt: skip
def usage_summary(spark, d):
    once = _once(spark, d)
    return usage.summary(usage.sessions(once), usage.turns(once))


@query(USAGE_SQL + """
SELECT strftime(seen AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS turns, sum(output_tokens)::BIGINT AS output_tokens
FROM turns WHERE seen >= TIMESTAMPTZ '2026-01-15 00:00:00+00' GROUP BY 1
""")  # fmt: skip
def usage_since(spark, d):
    spent = usage.turns(_once(spark, d), F.to_timestamp(F.lit("2026-01-15")))
    return spent.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("turns"), F.sum("output_tokens").alias("output_tokens"))


@query(USAGE_SQL + """
SELECT state, count(*) AS sessions FROM (
  SELECT CASE WHEN p.session_id IS NULL THEN 'no log' WHEN t.turns IS NULL OR t.calls IS NULL THEN 'no count'
    WHEN t.turns <> p.turns OR t.calls <> p.calls THEN 'stale' ELSE 'current' END AS state
  FROM (SELECT session_id, max(turn_count) AS turns, max(tool_count) AS calls FROM sessions GROUP BY 1) t LEFT JOIN per_session p USING (session_id)) GROUP BY state
""")  # fmt: skip
def usage_stale_sessions(spark, d):
    return usage.stale_sessions(table(spark, d, "sessions"), usage.sessions(_once(spark, d)))


# --- listing and rules -----------------------------------------------------------------------------------------------

LISTING_SQL = r"""
WITH scan AS (
  SELECT file_id, project_id, regexp_replace(regexp_replace(path, '[/\\]+', '/', 'g'), '/(\./)+', '/', 'g') AS path, size, is_dir, scanned_at FROM files),
listing AS (
  SELECT *, lower(regexp_extract(path, '(\.[^./]*)$', 1)) AS extension FROM scan
  QUALIFY row_number() OVER (PARTITION BY project_id, path ORDER BY scanned_at DESC NULLS LAST, file_id DESC) = 1),
below AS (
  SELECT l.*, p.name AS project, CASE WHEN starts_with(path, p.root_path || '/') THEN substr(path, length(p.root_path) + 2) END AS relative
  FROM listing l LEFT JOIN projects p USING (project_id)),
src AS (
  SELECT l.file_id, l.project_id, l.path, l.extension, l.relative, c.content, c.walk_ord FROM below l JOIN files_content c USING (file_id)
  WHERE NOT coalesce(is_dir, false) AND c.content IS NOT NULL)
"""


def _listing(spark, d):
    return listing.below(listing.latest_scan(table(spark, d, "files")), table(spark, d, "projects"))


def _sources(spark, d):
    return rules.sources(_listing(spark, d), table(spark, d, "files_content", spread=True))


@query(LISTING_SQL + f"""
SELECT language, count(*) AS files, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share
FROM listing JOIN {_values(dimensions.LANGUAGES.items(), "v(e, language)")} ON extension = e WHERE NOT coalesce(is_dir, false) GROUP BY language QUALIFY share >= 1
""")
def listing_languages(spark, d):
    return listing.languages(_listing(spark, d))


@query(LISTING_SQL + f"""
, counts AS (SELECT CASE WHEN split_part(relative, '/', 1) IN {dimensions.EXPANDED} AND len(string_split(relative, '/')) >= 3
    THEN split_part(relative, '/', 1) || '/' || split_part(relative, '/', 2) ELSE split_part(relative, '/', 1) END AS directory, count(*) AS files
  FROM below WHERE NOT coalesce(is_dir, false) AND contains(relative, '/') GROUP BY 1),
v AS (SELECT * FROM {_values(dimensions.PURPOSES.items(), "v(e, purpose)")})
SELECT directory, coalesce(a.purpose, b.purpose, '') AS purpose, files FROM counts LEFT JOIN v a ON a.e = lower(directory) LEFT JOIN v b ON b.e = lower(regexp_extract(directory, '[^/]*$'))
""")
def listing_structure(spark, d):
    return listing.structure(_listing(spark, d))


@query(LISTING_SQL + r"""
SELECT file_id, relative FROM below WHERE relative IS NOT NULL AND NOT regexp_matches(relative,
  '\.git|node_modules|vendor|__pycache__|\.venv|venv|dist|build|\.next|\.nuxt|target|bin|obj|\.idea|\.vscode|(^|/)[^/]*\.log(/|$)|(^|/)[^/]*\.lock(/|$)|package-lock\.json|yarn\.lock|pnpm-lock\.yaml|go\.sum|Cargo\.lock|(^|/)[^/]*\.min\.js(/|$)|(^|/)[^/]*\.min\.css(/|$)|(^|/)[^/]*\.map(/|$)')
""")
def listing_walk(spark, d):
    return _listing(spark, d).where(F.col("relative").isNotNull() & ~listing.ignored()).select("file_id", "relative")


@query(LISTING_SQL + f"""
SELECT project_id, e AS name, purpose, arg_min(path, (len(string_split(path, '/')), path)) AS path
FROM listing JOIN {_values(dimensions.KEY_FILES.items(), "v(e, purpose)")} ON regexp_extract(path, '[^/]*$') = e WHERE NOT coalesce(is_dir, false) GROUP BY ALL
""")
def listing_key_files(spark, d):
    return listing.key_files(_listing(spark, d))


@query(LISTING_SQL + """
, per AS (SELECT project_id, extension, count(*) FILTER (NOT coalesce(is_dir, false)) AS n, sum(CASE WHEN coalesce(is_dir, false) THEN 0 ELSE coalesce(size, 0) END) AS b, count(*) FILTER (coalesce(is_dir, false)) AS d
  FROM listing GROUP BY ALL)
SELECT p.project_id, p.name, p.main_lang, coalesce(sum(n), 0)::BIGINT AS files, coalesce(sum(b), 0)::BIGINT AS bytes, coalesce(sum(d), 0)::BIGINT AS folders,
  count(*) FILTER (n > 0) AS extensions, first(extension ORDER BY n DESC, extension) AS main_extension
FROM projects p LEFT JOIN per USING (project_id) GROUP BY ALL
""")
def listing_workspaces(spark, d):
    return listing.workspaces(_listing(spark, d), table(spark, d, "projects"))


KEYWORD_SQL = f"""
, hits AS (SELECT section, name, path, walk_ord, file_id FROM src JOIN {_values(dimensions.KEYWORDS, "v(section, name, ext, imports)")}
  ON list_contains(ext, extension) AND contains(content, name) AND (len(imports) = 0 OR len(list_filter(imports, lambda i: contains(content, i))) > 0))
"""
PATTERNS_SQL = "SELECT section, name, count(*) AS files, list(path ORDER BY walk_ord, file_id)[1:3] AS examples FROM hits GROUP BY ALL"


@query(LISTING_SQL + KEYWORD_SQL + PATTERNS_SQL)
def rules_keywords(spark, d):
    return rules.patterns(rules.keyword_hits(_sources(spark, d), dimensions.KEYWORDS))


REGEX_SQL = f"""
, hits AS (SELECT section, name, path, walk_ord, file_id, len(regexp_extract_all(content, p)) AS matches FROM src JOIN {_values(dimensions.REGEXES, "v(section, name, p, ext)")}
  ON list_contains(ext, extension) WHERE regexp_matches(content, p))
"""


@query(LISTING_SQL + REGEX_SQL + PATTERNS_SQL)
def rules_regexes(spark, d):
    return rules.patterns(rules.regex_hits(_sources(spark, d), dimensions.REGEXES))


@query(LISTING_SQL + REGEX_SQL + "SELECT section, name, sum(matches)::BIGINT AS matches, max(matches) AS most FROM hits GROUP BY ALL")
def rules_regex_counts(spark, d):
    hits = rules.regex_hits(_sources(spark, d), dimensions.REGEXES)
    return hits.groupBy("section", "name").agg(F.sum("matches").alias("matches"), F.max("matches").cast("bigint").alias("most"))


@query(LISTING_SQL + KEYWORD_SQL + """
, a AS (SELECT section, name, count(*) AS files FROM hits WHERE section = 'errors' GROUP BY ALL), b AS (SELECT 'second' AS section, name, count(*) AS files FROM hits GROUP BY name)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE name NOT IN (SELECT name FROM a)
""")
def rules_merged(spark, d):
    hits = rules.keyword_hits(_sources(spark, d), dimensions.KEYWORDS)
    count = lambda df: df.groupBy("section", "name").agg(F.count(F.lit(1)).alias("files"))
    return rules.merged(count(hits.where("section = 'errors'")), count(hits.withColumn("section", F.lit("second"))))


@query(LISTING_SQL + REGEX_SQL + """
, c AS (SELECT project_id, section, name, count(DISTINCT file_id) AS files FROM hits JOIN (SELECT file_id, project_id FROM src) USING (file_id) GROUP BY ALL HAVING files >= 3)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY project_id, section ORDER BY files DESC, name) = 1
""")
def rules_leading(spark, d):
    """The way in which most files of a project do each thing: its comments, errors, logs."""
    return rules.leading(rules.regex_hits(_sources(spark, d), dimensions.REGEXES))


#: Rules that tell of one thing.
KINDS = {"failures": ("err check", "try block", "option type"), "described": ("docstring", "javadoc", "rustdoc", "go doc"), "output": ("console", "python logger", "stdout")}


@query(LISTING_SQL + REGEX_SQL + f"""
SELECT coalesce(kind, name) AS kind, count(DISTINCT file_id) AS files FROM hits LEFT JOIN {_values([(n, k) for k, ns in KINDS.items() for n in ns], "v(name, kind)")} USING (name) GROUP BY 1
""")
def rules_consolidated(spark, d):
    return rules.consolidated(rules.regex_hits(_sources(spark, d), dimensions.REGEXES), KINDS)


GATE = "extension = '.rs' AND contains(content, 'impl ')"


@query(LISTING_SQL + f"SELECT project_id, count(*) AS files FROM src WHERE project_id IN (SELECT project_id FROM src WHERE {GATE}) GROUP BY ALL")
def rules_gate(spark, d):
    return rules.gated(_sources(spark, d), F.expr(GATE)).groupBy("project_id").agg(F.count(F.lit(1)).alias("files"))


@query(LISTING_SQL + f"SELECT project_id, count(*) AS files FROM src WHERE project_id NOT IN (SELECT project_id FROM src WHERE {GATE}) GROUP BY ALL")
def rules_gate_shut(spark, d):
    return rules.gated(_sources(spark, d), F.expr(GATE), shut=True).groupBy("project_id").agg(F.count(F.lit(1)).alias("files"))


@query(LISTING_SQL + """
, s AS (SELECT extension, content FROM src QUALIFY row_number() OVER (PARTITION BY extension ORDER BY walk_ord, file_id) <= 30)
SELECT extension, count(*) AS sampled, count(*) FILTER (contains(content, 'return')) AS returning FROM s GROUP BY extension
""")
def rules_sample(spark, d):
    sample = rules.first_of_each(_sources(spark, d), ["extension"], ["walk_ord", "file_id"], 30)
    return sample.groupBy("extension").agg(F.count(F.lit(1)).alias("sampled"), F.count_if(F.contains(F.col("content"), F.lit("return"))).alias("returning"))


# --- lines of texts --------------------------------------------------------------------------------------------------

LINES_SQL = r"""
WITH split AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS rows FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(range(1, len(rows) + 1)) AS line, unnest(rows) AS row FROM split),
fences AS (
  SELECT *, fence::INT AS f, NOT fence AND (sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY line)) % 2 = 1 AS inside
  FROM (SELECT *, starts_with(trim(row, e' \t'), '```') AS fence FROM lines))
"""


def _lines(spark, d):
    return lines.lines(table(spark, d, "documents", spread=True), "doc_id")


@query(LINES_SQL + "SELECT doc_id, count(*) AS lines, count(*) FILTER (fence) AS fences, count(*) FILTER (inside) AS inside FROM fences GROUP BY doc_id")
def lines_fenced(spark, d):
    marked = lines.fenced(_lines(spark, d), "doc_id")
    return marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if("fence").alias("fences"), F.count_if("inside").alias("inside"))


@query(LINES_SQL + r"""
, marks AS (SELECT *, NOT inside AND NOT fence AND regexp_matches(row, '^#{1,6} +\S') AS head FROM fences),
parts AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY line) AS no FROM marks)
SELECT doc_id, length(regexp_extract(arg_min(row, line), '^(#+)', 1)) AS level, trim(regexp_replace(arg_min(row, line), '^#+ +', ''), ' ') AS title,
  min(line) AS first, max(line) AS last, count(*) FILTER (trim(row, e' \t') <> '') - 1 AS filled FROM parts WHERE no > 0 GROUP BY doc_id, no
""")
def lines_sections(spark, d):
    return lines.sections(_lines(spark, d), "doc_id")


@query(LINES_SQL + r"""
, b AS (SELECT doc_id, line, trim(regexp_extract(row, '^[ \t]*[-*+] +(.+)$', 1), ' ') AS item FROM fences WHERE NOT inside AND NOT fence)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS ord, item FROM b WHERE item <> '' AND strlen(item) < 200 QUALIFY ord <= 10
""")
def lines_bullets(spark, d):
    return lines.bullets(_lines(spark, d), "doc_id")


@query(LINES_SQL + r"""
, prose AS (SELECT doc_id, line, row, trim(row, e' \t') = '' AS blank, starts_with(ltrim(row, e' \t'), '#') AS head,
    min(CASE WHEN starts_with(ltrim(row, e' \t'), '# ') THEN line END) OVER (PARTITION BY doc_id) AS title
  FROM fences WHERE NOT inside AND NOT fence AND NOT regexp_matches(row, '^(    |\t)')),
after AS (SELECT *, max((NOT blank AND NOT head)::INT) OVER (PARTITION BY doc_id ORDER BY line) AS seen FROM prose WHERE line > title),
stops AS (SELECT *, sum((head OR (blank AND seen = 1))::INT) OVER (PARTITION BY doc_id ORDER BY line) AS stop FROM after),
joined AS (SELECT doc_id, string_agg(trim(row, e' \t'), ' ' ORDER BY line) AS t FROM stops WHERE stop = 0 AND NOT blank AND NOT head GROUP BY doc_id)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '`([^`]+)`', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g') AS description
FROM joined
""")
def lines_descriptions(spark, d):
    return lines.descriptions(_lines(spark, d), "doc_id")


CODE_SQL = LISTING_SQL + r"""
, split AS (SELECT file_id, string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) AS rows FROM src WHERE extension = '.go'),
lines AS (SELECT file_id, unnest(range(1, len(rows) + 1)) AS line, unnest(rows) AS row FROM split)
"""


def _code(spark, d):
    return lines.lines(_sources(spark, d).where("extension = '.go'"), "file_id", "content")


@query(CODE_SQL + r"""
, named AS (SELECT *, nullif(regexp_extract(row, '^func (?:\([^)]*\) )?(\w+)', 1), '') AS name, nullif(regexp_extract(row, '^\s*// (.+)$', 1), '') AS said FROM lines),
parts AS (SELECT *, count(name) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS part FROM named),
carried AS (SELECT *, last_value(said IGNORE NULLS) OVER (PARTITION BY file_id, part ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS comment FROM parts)
SELECT file_id, line, name, comment FROM carried WHERE name IS NOT NULL
""")
def lines_commented(spark, d):
    return lines.commented(_code(spark, d), "file_id", r"^func (?:\([^)]*\) )?(\w+)", r"^\s*// (.+)$")


@query(CODE_SQL + """
, depths AS (SELECT file_id, line, sum(length(row) - length(replace(row, '{', '')) - length(row) + length(replace(row, '}', ''))) OVER (PARTITION BY file_id ORDER BY line) AS depth FROM lines)
SELECT file_id, max(depth)::BIGINT AS deepest, arg_max(depth, line)::BIGINT AS at_end, count(*) FILTER (depth = 0) AS outside FROM depths GROUP BY file_id
""")
def lines_depths(spark, d):
    deep = lines.depths(_code(spark, d), "file_id")
    return deep.groupBy("file_id").agg(F.max("depth").alias("deepest"), F.max_by("depth", "line").alias("at_end"), F.count_if(F.col("depth") == 0).alias("outside"))


# --- graphs ----------------------------------------------------------------------------------------------------------

EDGES_SQL = LISTING_SQL + r"""
, given AS (SELECT project_id, regexp_extract(folder, '[^/]*$') AS name, min(folder) AS dst FROM (SELECT project_id, regexp_replace(relative, '/[^/]*$', '') AS folder FROM below WHERE contains(relative, '/')) GROUP BY 1, 2),
asked AS (SELECT project_id, regexp_replace(relative, '/[^/]*$', '') AS src, unnest(regexp_extract_all(content, 'from ''\./([A-Za-z_]+)''', 1)) AS name FROM src WHERE contains(relative, '/')),
edges AS (SELECT DISTINCT project_id, src, dst FROM asked JOIN given USING (project_id, name) WHERE src <> dst),
one AS (SELECT DISTINCT project_id || ':' || src AS src, project_id || ':' || dst AS dst FROM edges)
"""


def _edges(spark, d):
    return graphs.edges(_sources(spark, d), _listing(spark, d))


def _project_edges(spark, d):
    """Edges between folders of one project, named by both."""
    name = lambda c: F.concat(F.col("project_id").cast("string"), F.lit(":"), F.col(c)).alias(c)
    return _edges(spark, d).select(name("src"), name("dst"))


@query(EDGES_SQL + "SELECT * FROM edges")
def graph_edges(spark, d):
    return _edges(spark, d)


@query(EDGES_SQL + """
, ends AS (SELECT src AS node, 1 AS o, 0 AS i FROM one UNION ALL SELECT dst, 0, 1 FROM one)
SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM ends GROUP BY node
""")
def graph_degrees(spark, d):
    return graphs.degrees(_project_edges(spark, d))


@query(EDGES_SQL.replace("WITH scan", "WITH RECURSIVE scan") + """
, reach AS (SELECT src AS s, dst AS t, 1 AS hops FROM one UNION SELECT s, dst, hops + 1 FROM reach JOIN one ON t = src WHERE hops < (SELECT count(DISTINCT src) FROM one)),
far AS (SELECT s, t, min(hops) AS d FROM reach GROUP BY s, t),
via AS (SELECT f.s, f.t, min(e.dst) AS nxt FROM far f JOIN one e ON e.src = f.s LEFT JOIN far g ON g.s = e.dst AND g.t = f.t WHERE (f.d = 1 AND e.dst = f.t) OR (f.d > 1 AND e.dst <> f.t AND g.d = f.d - 1) GROUP BY ALL),
walks AS (SELECT e.src AS u, e.dst AS here, [e.dst] AS nodes FROM one e JOIN far f ON f.s = e.dst AND f.t = e.src
  UNION ALL SELECT u, nxt, list_append(nodes, nxt) FROM walks JOIN via ON via.s = here AND via.t = u WHERE here <> u),
closed AS (SELECT nodes, list_position(nodes, list_min(nodes)) AS p FROM walks WHERE here = u)
SELECT DISTINCT nodes[p:] || nodes[1:p - 1] AS nodes, len(nodes) AS length FROM closed
""")
def graph_cycles(spark, d):
    return graphs.cycles(_project_edges(spark, d))


@query(EDGES_SQL.replace("WITH scan", "WITH RECURSIVE scan") + """
, ways AS (SELECT src AS a, dst AS b FROM one UNION SELECT dst, src FROM one),
reach AS (SELECT a AS node, a AS other FROM ways UNION SELECT node, b FROM reach JOIN ways ON other = a)
SELECT node, min(other) AS component FROM reach GROUP BY node
""")
def graph_components(spark, d):
    return graphs.components(_project_edges(spark, d))


@query(EDGES_SQL + f"""
, v AS (SELECT * FROM {_values(dimensions.LAYERS.items(), "v(layer, level)")}),
placed AS (SELECT path, arg_min(layer, pos) AS layer, arg_min(level, pos) AS level FROM (
  SELECT path, unnest(string_split(path, '/')) AS seg, unnest(range(1, len(string_split(path, '/')) + 1)) AS pos FROM (SELECT src AS path FROM edges UNION SELECT dst FROM edges)) JOIN v ON seg = layer GROUP BY path)
SELECT DISTINCT src AS from_path, dst AS to_path, a.layer AS from_layer, b.layer AS to_layer FROM edges JOIN placed a ON src = a.path JOIN placed b ON dst = b.path WHERE a.level < b.level
""")
def graph_layer_violations(spark, d):
    """Imports of a higher layer by a lower one."""
    return graphs.violations(_edges(spark, d).select(F.col("src").alias("from_path"), F.col("dst").alias("to_path")).distinct())


# --- commands, conventions, kinds ------------------------------------------------------------------------------------

#: Names of source files read as commands: words of the name, in lower case.
COMMANDS_SQL = LISTING_SQL + r"""
, commands AS (SELECT DISTINCT project_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '\..*$', ''), '([a-z])([A-Z])', '\1 \2', 'g'), '[_-]+', ' ', 'g'), ' ')) AS command
  FROM listing WHERE NOT coalesce(is_dir, false)),
ranked AS (SELECT *, CASE %s ELSE 'other' END AS category FROM commands),
norm AS (SELECT *, list_position(%s, category) AS priority,
  replace(replace(replace(replace(regexp_replace(command, '(.) \(in .*$', '\1'), 'yarn ', 'npm '), 'pnpm ', 'npm '), 'bun ', 'npm '), 'npm run ', 'npm ') AS n FROM ranked),
kept AS (SELECT * FROM norm QUALIFY row_number() OVER (PARTITION BY project_id, n ORDER BY priority, command) = 1),
placed AS (SELECT project_id, command, category, priority, row_number() OVER (PARTITION BY project_id ORDER BY priority, command) AS rank FROM kept)
""" % (
    " ".join(f"WHEN regexp_matches(command, '{p}') THEN '{c}'" for p, c in dimensions.COMMAND_RULES),
    "[" + ", ".join(f"'{c}'" for c in dimensions.CATEGORIES) + "]",
)


def _commands(spark, d):
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\..*$", "")
    words = F.lower(F.trim(F.regexp_replace(F.regexp_replace(stem, "([a-z])([A-Z])", "$1 $2"), "[_-]+", " ")))
    files = _listing(spark, d).where(~F.coalesce("is_dir", F.lit(False)))
    return commands.prioritized(files.select("project_id", words.alias("command")).distinct(), ["project_id"])


@query(COMMANDS_SQL + "SELECT * FROM placed")
def commands_prioritized(spark, d):
    return _commands(spark, d)


@query(COMMANDS_SQL + """
, late AS (SELECT *, CASE WHEN category IN ('build', 'test', 'lint', 'format', 'run', 'install') AND row_number() OVER (PARTITION BY project_id, category ORDER BY rank) = 1 THEN 0 ELSE 1 END AS l FROM placed)
SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY l, rank) AS place, command, category FROM late QUALIFY place <= 10
""")
def commands_quick(spark, d):
    return commands.quick(_commands(spark, d), ["project_id"])


STYLE_SQL = LISTING_SQL + r"""
, stems AS (SELECT extension, split_part(regexp_extract(path, '[^/]*$'), '.', 1) AS n FROM listing WHERE NOT coalesce(is_dir, false)),
styles AS (SELECT extension, CASE WHEN length(n) < 2 THEN 'unknown' WHEN contains(n, '-') AND NOT contains(n, '_') THEN 'kebab'
    WHEN contains(n, '_') AND NOT contains(n, '-') AND n = lower(n) THEN 'snake' WHEN NOT contains(n, '-') AND NOT contains(n, '_') AND regexp_matches(n, '^[A-Z]') THEN 'pascal'
    WHEN NOT contains(n, '-') AND NOT contains(n, '_') AND regexp_matches(n, '^[a-z].*[A-Z]') THEN 'camel' ELSE 'unknown' END AS style FROM stems),
counts AS (SELECT extension, style, count(*) AS files FROM styles GROUP BY ALL)
"""


@query(STYLE_SQL + "SELECT * FROM counts")
def conventions_naming(spark, d):
    return conventions.naming(_listing(spark, d))


@query(STYLE_SQL + "SELECT * FROM counts WHERE style <> 'unknown' QUALIFY row_number() OVER (PARTITION BY extension ORDER BY files DESC, style) = 1")
def conventions_dominant(spark, d):
    return conventions.dominant(conventions.naming(_listing(spark, d)), "extension", "style")


@query(LISTING_SQL + r"""
, t AS (SELECT extension, regexp_matches(regexp_extract(path, '[^/]*$'), '(?:_test|\.test|\.spec)\.[a-z]+$|^test_') AS s, regexp_matches(path, '/(?:tests?|__tests__|spec)/') AS f FROM listing WHERE NOT coalesce(is_dir, false))
SELECT extension, count(*) FILTER (s) AS suffixed, count(*) FILTER (f) AS in_folder, count(*) FILTER (s AND f) AS both, count(*) AS files FROM t GROUP BY extension
""")
def conventions_tests(spark, d):
    return conventions.tests(_listing(spark, d))


@query(LISTING_SQL + r"""
, i AS (SELECT extension, unnest(CASE WHEN extension IN ('.js', '.ts') THEN regexp_extract_all(content, 'from ''([^'']+)''', 1)
    WHEN extension = '.py' THEN regexp_extract_all(content, '(?m)^(?:import|from) ([\w.]+)', 1) WHEN extension = '.java' THEN regexp_extract_all(content, '(?m)^import ([\w.]+);', 1)
    WHEN extension = '.rs' THEN regexp_extract_all(content, '(?m)^use ([\w:]+);', 1) WHEN extension = '.c' THEN regexp_extract_all(content, '#include [<"]([^>"]+)[>"]', 1)
    WHEN extension = '.go' THEN regexp_extract_all(content, '(?m)^import "([^"]+)"', 1) END) AS name FROM src)
SELECT extension, count(*) AS imports, count(*) FILTER (starts_with(name, '.')) AS relative, count(*) FILTER (regexp_matches(name, '^[@~]/')) AS aliased, count(DISTINCT name) AS names FROM i GROUP BY extension
""")
def conventions_imports(spark, d):
    return conventions.imports(_sources(spark, d))


@query(LISTING_SQL + f"""
, e AS (SELECT * FROM {_values([(i, *r) for i, r in enumerate(dimensions.PROJECT_EVIDENCE)], "v(i, kind, weight, least, ext)")}),
n AS (SELECT project_id, extension, count(*) AS n FROM listing WHERE NOT coalesce(is_dir, false) GROUP BY ALL),
met AS (SELECT project_id, i, any_value(kind) AS kind, any_value(weight)::DOUBLE AS weight FROM n, e GROUP BY project_id, i HAVING sum(CASE WHEN list_contains(ext, extension) THEN n ELSE 0 END) / sum(n) > any_value(least)),
s AS (SELECT project_id, kind, sum(weight) AS score FROM met GROUP BY ALL),
r AS (SELECT project_id, list(kind ORDER BY score DESC, kind) AS kinds, max(score) AS score, sum(score) AS total FROM s GROUP BY project_id)
SELECT project_id, coalesce(kinds[1], 'unknown') AS kind, coalesce(kinds[2], '') AS second, coalesce(score, 0.0)::DOUBLE AS score, round(coalesce(score / total, 0.0), 6)::DOUBLE AS confidence
FROM (SELECT DISTINCT project_id FROM n) LEFT JOIN r USING (project_id)
""")
def project_kinds(spark, d):
    return scoring.project_kinds(_listing(spark, d))


# --- routes, changes, reports ----------------------------------------------------------------------------------------


@query(LISTING_SQL + r"""
, r AS (SELECT '/' || relative AS path, string_split(trim(relative, '/'), '/') AS p FROM below WHERE relative IS NOT NULL),
g AS (SELECT path, regexp_matches(lower(p[1]), '^(?:api$|v[0-9])') AS pre, p FROM r),
k AS (SELECT path, list_filter([CASE WHEN pre THEN p[1] END, CASE WHEN NOT regexp_matches(p[CASE WHEN pre THEN 2 ELSE 1 END], '^[:{\[]|^\*$') THEN p[CASE WHEN pre THEN 2 ELSE 1 END] END], lambda x: x IS NOT NULL) AS kept FROM g),
res AS (SELECT CASE WHEN len(kept) = 0 THEN '/' ELSE '/' || array_to_string(kept, '/') END AS resource, path FROM k)
SELECT resource, count(*) AS paths, min(path) AS first FROM res GROUP BY resource ORDER BY paths DESC, resource LIMIT 100
""")
def routes_resources(spark, d):
    """The hundred largest resources of a report, with paths below the projects taken as routes."""
    paths = _listing(spark, d).where("relative is not null").select(F.concat(F.lit("/"), "relative").alias("path"))
    groups = paths.groupBy(text.resource_prefix(F.col("path")).alias("resource")).agg(F.count(F.lit(1)).alias("paths"), F.min("path").alias("first"))
    return groups.orderBy(F.desc("paths"), "resource").limit(100)


@query(LISTING_SQL + f"""
, t AS (SELECT relative, CASE {" ".join(f"WHEN regexp_matches(relative, '{p}') THEN {list(i)}" for p, i in dimensions.IMPACTS)} ELSE [] END AS i FROM below WHERE relative IS NOT NULL)
SELECT impact, count(*) AS files, min(relative) AS first FROM (SELECT relative, unnest(i) AS impact FROM t) GROUP BY impact
""")
def changes_impacts(spark, d):
    paths = _listing(spark, d).where("relative is not null").select(F.col("relative").alias("path"))
    return changes.touched(paths).groupBy("impact").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first"))


@query("""
WITH gaps AS (SELECT file_name, entry_type, received_at, CASE WHEN received_at - lag(received_at) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh
  FROM session_entries WHERE received_at IS NOT NULL WINDOW w AS (PARTITION BY file_name ORDER BY received_at)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY file_name ORDER BY received_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no FROM gaps)
SELECT file_name, count(*) AS events, epoch_us(min(received_at)) AS first_us, epoch_us(max(received_at)) AS last_us, list_sort(list(DISTINCT entry_type)) AS entry_types FROM islands GROUP BY file_name, no
""")
def changes_bursts(spark, d):
    events = table(spark, d, "session_entries").select("file_name", "entry_type", F.col("received_at").alias("at"))
    found = changes.bursts(events, "file_name", 600, members="entry_type")
    return found.select("file_name", "events", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), F.col("entry_type").alias("entry_types"))


@query(USAGE_SQL + r"""
, c AS (SELECT tool, count(*) AS n FROM calls GROUP BY tool), r AS (SELECT row_number() OVER (ORDER BY n DESC, tool) AS rank, tool, n, max(n) OVER () AS most FROM c)
SELECT rank, substr(rpad(tool, 24, ' '), 1, 24) || ' ' || lpad(CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000.0) WHEN n >= 1000 THEN printf('%.1fK', n / 1000.0) ELSE n::VARCHAR END, 8, ' ') || ' ' || repeat('#', (n * 25 // most)::BIGINT) AS line FROM r
""")
def report_bars(spark, d):
    counts = usage.tool_calls(_once(spark, d)).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))
    return reports.bars(counts, "tool", "n")


@query(r"""
SELECT doc_id, CASE WHEN regexp_matches(path, '[:#\[\]{},&*!|>''"%@`\n]|^\s|\s$|^$') THEN '"' || path || '"' ELSE path END AS yaml,
  trim(replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), ' ') AS html
FROM documents
""")
def report_texts(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", reports.yaml_text(F.col("path")).alias("yaml"), text.clean_html(F.col("text")).alias("html"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def extra_grouping_sets(spark, d):
    df = table(spark, d, "lineitem")
    return df.groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity")
    )


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS hour_us, event_type, count(*) AS events FROM events GROUP BY ALL")
def extra_hourly_events(spark, d):
    df = table(spark, d, "events")
    return df.groupBy(F.unix_micros(F.window("ts", "1 hour").start.cast("timestamp")).alias("hour_us"), "event_type").agg(F.count(F.lit(1)).alias("events"))


# --- readmes, architecture, syntax -----------------------------------------------------------------------------------

#: Titles of sections with lists in the documents.
TITLES = ("notes", "limits", "usage", "setup", "next steps", "hinweise", "grenzen", "einrichtung")


@query(LINES_SQL + rf"""
, heads AS (SELECT *, CASE WHEN NOT inside AND NOT fence THEN nullif(regexp_extract(row, '^#{{1,6}} +(.+?)\s*$', 1), '') END AS head FROM fences),
titled AS (SELECT *, lower(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS title FROM heads),
items AS (SELECT doc_id, regexp_extract(row, '^[ \t]*[-*+] +(.*\S)', 1) AS item, min(line) AS line FROM titled WHERE title IN {TITLES} AND NOT inside AND NOT fence GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS ord, item FROM items WHERE item <> ''
""")
def readme_section_bullets(spark, d):
    return readmes.section_bullets(_lines(spark, d), "doc_id", TITLES)


@query(LINES_SQL + f"""
, cmd AS (SELECT doc_id, line, trim(row, e' \\t') AS r FROM fences WHERE inside),
likely AS (SELECT doc_id, regexp_replace(regexp_replace(r, '^\\$ ', ''), '^> ', '') AS command, min(line) AS line FROM cmd
  WHERE NOT starts_with(r, '#') AND len(list_filter({list(readmes.COMMANDS)}, lambda c: starts_with(lower(r), c))) > 0 GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS ord, command FROM likely WHERE command <> '' AND strlen(command) < 200 QUALIFY ord <= 15
""")
def readme_commands(spark, d):
    return readmes.shell_commands(_lines(spark, d), "doc_id")


def _met(words) -> str:
    return " + ".join(f"contains(lower(text), '{w}')::INT" for w in words)


@query(f"""
WITH scored AS (SELECT text IS NULL AS none, list_max([{", ".join(f"{{'n': {_met(words)}, 'i': {-i}, 'kind': '{name}'}}" for i, (name, words) in enumerate(readmes.KINDS.items()))}]) AS best FROM documents)
SELECT CASE WHEN none THEN NULL WHEN best.n >= 2 THEN best.kind ELSE 'other' END AS kind, count(*) AS documents FROM scored GROUP BY 1
""")
def readme_kinds(spark, d):
    docs = table(spark, d, "documents", spread=True)
    return docs.groupBy(readmes.kind(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("documents"))


@query(LISTING_SQL + f"""
, tops AS (SELECT project_id, list(DISTINCT CASE WHEN contains(relative, '/') THEN split_part(relative, '/', 1) END) AS t FROM below GROUP BY project_id)
SELECT project_id, CASE {" ".join("WHEN " + " AND ".join(f"list_has_any(t, {list(s)})" for s in sets) + f" THEN '{name}'" for name, sets in architecture.STYLES)} ELSE 'Flat Layout' END AS style FROM tops
""")
def architecture_styles(spark, d):
    return architecture.styles(_listing(spark, d))


@query(LISTING_SQL + f"""
, p AS (SELECT DISTINCT project_id, string_split(relative, '/')[1] AS layer, string_split(relative, '/')[2] AS package FROM below WHERE len(string_split(relative, '/')) >= 3)
SELECT project_id, place, layer, purpose, list(package ORDER BY package) AS packages FROM p JOIN {_values([(i, n, q) for i, (n, q) in enumerate(architecture.LAYERS, 1)], "v(place, layer, purpose)")} USING (layer) GROUP BY ALL
""")
def architecture_layers(spark, d):
    return architecture.layers(_listing(spark, d))


@query()
def syntax_python(spark, d):
    """Facts of Python sources by their syntax trees; SQL can't parse them, the operator is tested on a fixture."""
    return syntax.counted(syntax.python_facts(_sources(spark, d).where("extension = '.py'")))


@query(LISTING_SQL + """
, w AS (SELECT DISTINCT project_id, array_to_string(string_split(relative, '/')[1:n], '/') AS path FROM below, (VALUES (1), (2), (3)) v(n) WHERE relative IS NOT NULL AND n <= len(string_split(relative, '/')))
SELECT project_id, path, repeat('  ', len(string_split(path, '/')) - 1) || '- ' || regexp_extract(path, '[^/]*$') AS line FROM w
""")
def report_trees(spark, d):
    return reports.tree_lines(_listing(spark, d))


# --- imports, facts, short forms, dispatch ---------------------------------------------------------------------------

_PATTERN = {ext: p.replace("'", "''") for exts, p in imports.PATTERNS.items() for ext in exts}
IMPORTS_SQL = LISTING_SQL + f"""
, named AS (SELECT project_id, file_id, path, relative, walk_ord, unnest(list_distinct(CASE {" ".join(f"WHEN extension = '{e}' THEN regexp_extract_all(content, '{p}', 1)" for e, p in _PATTERN.items())} END)) AS name FROM src)
"""


def _imports(spark, d):
    return imports.every_import(_sources(spark, d))


@query(IMPORTS_SQL + f"""
, met AS (SELECT name, arg_max({{'f': framework, 'c': category}}, length(p)) AS t FROM (SELECT DISTINCT name FROM named) JOIN {_values([(k, *v) for k, v in imports.AREAS.items()], "v(p, framework, category)")}
  ON starts_with(name, p) AND substr(name, length(p) + 1, 1) IN ('', '.', '/', ':') GROUP BY name),
hits AS (SELECT DISTINCT file_id, path, walk_ord, t.f AS framework, t.c AS category FROM named JOIN met USING (name))
SELECT framework, category, count(*) AS files, list(path ORDER BY walk_ord, file_id)[1:3] AS examples FROM hits GROUP BY ALL
""")
def imports_told(spark, d):
    return imports.told(_imports(spark, d))


@query(IMPORTS_SQL + """
, own AS (SELECT project_id, regexp_replace(relative, '/?[^/]*$', '') AS package, count(*) AS files, count(*) FILTER (regexp_matches(regexp_extract(relative, '[^/]*$'), '(?:_test|\\.test|\\.spec)\\.[a-z]+$|^test_')) AS tests,
  bool_or(regexp_matches(regexp_extract(relative, '[^/]*$'), '^(?:main|index|__main__)\\.[a-z]+$')) AS main FROM src WHERE relative IS NOT NULL GROUP BY 1, 2),
used AS (SELECT project_id, regexp_replace(relative, '/?[^/]*$', '') AS package, list_sort(list(DISTINCT name)) AS names FROM named WHERE relative IS NOT NULL GROUP BY 1, 2)
SELECT project_id, package, files, tests, main, coalesce(names, []) AS names FROM own LEFT JOIN used USING (project_id, package)
""")
def imports_packages(spark, d):
    return imports.packages(_sources(spark, d), _imports(spark, d))


@query(EDGES_SQL + """
, tops AS (SELECT DISTINCT project_id, split_part(src, '/', 1) AS layer, split_part(dst, '/', 1) AS need FROM edges)
SELECT project_id, layer, list_sort(list(need)) AS needs FROM tops WHERE layer <> need GROUP BY ALL
""")
def imports_layer_needs(spark, d):
    return imports.layer_needs(_edges(spark, d))


@query(LISTING_SQL + f"""
SELECT project_id, relative, CASE {" ".join(f"WHEN regexp_matches(relative, '{p}') THEN '{k}'" for p, k, _ in facts.SETTINGS)} END AS kind, CASE {" ".join(f"WHEN regexp_matches(relative, '{p}') THEN '{w}'" for p, _, w in facts.SETTINGS)} END AS purpose
FROM below WHERE NOT coalesce(is_dir, false) AND kind IS NOT NULL
""")
def facts_settings(spark, d):
    return facts.settings(_listing(spark, d))


@query(STYLE_SQL + """
SELECT extension, style, files, row_number() OVER (PARTITION BY extension ORDER BY files DESC, style) AS place, greatest(count(*) OVER (PARTITION BY extension) - 2, 0) AS left_out FROM counts QUALIFY place <= 2
""")
def report_styles_capped(spark, d):
    return selections.capped(conventions.naming(_listing(spark, d)), ["extension"], [F.desc("files"), F.col("style")], 2)


@query(LISTING_SQL + """
, g AS (SELECT split_part(relative, '/', 1) AS top, count(*) AS n FROM below WHERE contains(relative, '/') GROUP BY 1),
c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY top ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT top, greatest(least(n, 100 - before), 0)::BIGINT AS shown, (n - greatest(least(n, 100 - before), 0))::BIGINT AS left_out FROM c
""")
def report_folders_across(spark, d):
    """A hundred files over all top folders in order, and how many each leaves out."""
    rows = _listing(spark, d).where(F.contains("relative", F.lit("/"))).select(F.substring_index("relative", "/", 1).alias("top"))
    return selections.across(rows, "top", [F.col("top")], 100)


@query(LISTING_SQL + r"""
SELECT project_id, relative, row_number() OVER (PARTITION BY project_id ORDER BY regexp_matches(relative, '^[^/]+$') DESC, relative) AS place FROM below WHERE relative IS NOT NULL AND NOT coalesce(is_dir, false) QUALIFY place <= 5
""")
def report_files_filled(spark, d):
    """Five files of each project, those at its root first."""
    files = _listing(spark, d).where(F.col("relative").isNotNull() & ~F.coalesce("is_dir", F.lit(False))).select("project_id", "relative")
    return selections.filled(files, ["project_id"], F.col("relative").rlike("^[^/]+$"), [F.col("relative")], 5)


#: Results that follow changes, and what they follow.
RESULTS = {"stack": ("tech_stack",), "commands": ("commands", "development"), "routes": ("endpoints",), "settings": ("config",), "readme": ("readme",)}


@query(LISTING_SQL + f"""
, gaps AS (SELECT project_id, relative, scanned_at, CASE WHEN scanned_at - lag(scanned_at) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM below
  WHERE relative IS NOT NULL AND scanned_at IS NOT NULL AND NOT regexp_matches(relative, '{changes.QUIET}') WINDOW w AS (PARTITION BY project_id ORDER BY scanned_at)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY project_id ORDER BY scanned_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no FROM gaps),
b AS (SELECT project_id, no, count(*) AS events, epoch_us(min(scanned_at)) AS first_us, list_sort(list(DISTINCT relative)) AS paths,
  list(DISTINCT CASE {" ".join(f"WHEN regexp_matches(relative, '{p}') THEN {list(i)}" for p, i in dimensions.IMPACTS)} ELSE []::VARCHAR[] END) AS i FROM islands GROUP BY ALL),
t AS (SELECT *, flatten(i) AS touched, len(list_filter(i, lambda x: len(x) = 0)) > 0 AS "full" FROM b)
SELECT project_id, events, first_us, "full", CASE WHEN "full" THEN {sorted(RESULTS)} ELSE list_filter([{", ".join(f"CASE WHEN list_has_any(touched, {list(n)}) THEN '{k}' END" for k, n in sorted(RESULTS.items()))}], lambda x: x IS NOT NULL) END AS rerun,
  CASE WHEN len(paths) > 3 THEN array_to_string(paths[1:3], ', ') || ' and ' || (len(paths) - 3)::VARCHAR || ' more' ELSE array_to_string(paths, ', ') END AS said FROM t
""")
def changes_dispatched(spark, d):
    """Bursts of scanned files per project, and what each makes to compute anew."""
    seen = changes.relevant(_listing(spark, d).select("project_id", F.col("relative").alias("path"), F.col("scanned_at").alias("at")))
    found = changes.dispatched(changes.bursts(seen, "project_id", 3600, members="path"), RESULTS)
    return found.select("project_id", "events", F.unix_micros("first").alias("first_us"), "full", "rerun", changes.described(F.col("path")).alias("said"))
