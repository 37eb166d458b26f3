"""Drift, nested records, rejected lines and features: brute force on small tables, and hard cases."""

import json

from pyspark.sql import functions as F

from tests.compare import DATA, of_sql, rows
from tidemark.operators import drift, features, nested, rejects
from tidemark.queries import QUERIES, SQL

LOG = "record_id long, producer string, file_name string, file_seq int, raw string, extra string, type string"


def log(spark, files, producer="p"):
    rows, n = [], 0
    for seq, records in files.items():
        for r in records:
            n += 1
            rows.append((n, producer, f"{producer}-{seq}", seq, r if r is None or isinstance(r, str) else json.dumps(r), "x", "clash"))
    return spark.createDataFrame(rows, LOG)


def changed(df):
    return {(r.file_name, r.field, r.change) for r in drift.changes(df).collect()}


def test_drift_tells_added_removed_renamed_and_retyped(spark):
    df = log(spark, {
        1: [{"type": "a", "durationMs": 1, "data": {"q": "x"}, "tags": ["a"]}] * 2,
        2: [{"type": "a", "tookMs": "1", "data": {"query": "x"}, "priority": 1}] * 2,
        5: [{"type": "a", "tookMs": 1.5, "data": {"query": None}, "priority": None, "message": {"z": 1}}] * 2,
    })
    assert changed(df) == {
        ("p-2", "durationMs", "renamed"), ("p-2", "durationMs", "retyped"), ("p-2", "data.q", "renamed"), ("p-2", "tags", "removed"),
        ("p-2", "priority", "added"), ("p-5", "tookMs", "retyped"),
    }


def test_drift_of_files_that_dont_parse_null_raws_and_empty_tables(spark):
    df = log(spark, {1: [{"a": 1}], 2: ["{cut", None, "[1]"], 3: [{"a": 1}]})
    assert changed(df) == {("p-2", "a", "removed"), ("p-3", "a", "added")}
    assert changed(df.limit(0)) == set()
    nulls = df.withColumns({c: F.lit(None).cast(t) for c, t in df.dtypes})
    assert changed(nulls) == set()
    assert changed(df.unionByName(df)) == changed(df)


def test_drift_names_that_differ_in_case_and_unknown_aliases(spark):
    assert changed(log(spark, {1: [{"subtype": "a"}], 2: [{"subType": "a"}]})) == {("p-2", "subtype", "renamed")}
    assert changed(log(spark, {1: [{"userName": "a"}], 2: [{"user_name": "a"}]})) == {("p-2", "userName", "renamed")}


def test_unified_casts_every_record(spark):
    df = log(spark, {1: [{"durationMs": 3, "subtype": "a", "type": "user"}], 2: [{"tookMs": "4", "sub_type": ["b", "c"], "kind": "system"}, "{cut"]})
    got = [(r.parsed, r.duration_ms, r.subtype, r.record_type) for r in drift.unified(df).orderBy("record_id").collect()]
    assert got == [(True, 3.0, ["a"], "user"), (True, 4.0, ["b", "c"], "system"), (False, None, None, None)]


def test_unified_loses_nothing(spark):
    df = log(spark, {1: [
        {"type": "a", "message": {"role": "user"}, "extra": {"x": 1}, "priority": 2, "n.o": "dotted", "gone": None},
        {"data": {"cached": 0.25, "total": ["115"], "new": [1], "q": "x", "query": "y"}, "isSidechain": [True], "retryCount": 12345678901234567},
        {"data": "text", "isSidechain": [True, False], "tags": "[a", "sessionId": "s", "session": "t", "data.cached": "z"},
        '{"type": "cut', None, '{"odd": 1, "odd": 1}',
    ]})
    got = drift.unified(df).orderBy("record_id").collect()
    assert [r.rest for r in got[:5]] == [
        {"extra": '{"x":1}', '"n.o"': "dotted"}, {"data.cached": "0.25", "data.new": "[1]", "data.q": "x", "retryCount": "12345678901234567"},
        {"data": "text", "isSidechain": "[true,false]", "tags": "[a", "session": "t", '"data.cached"': "z"}, {"": '{"type": "cut'}, None,
    ]
    assert got[5].rest == {"odd": "1"} and not got[3].parsed
    assert [r.message for r in got[:2]] == ['{"role":"user"}', None]
    assert (got[1].data_cached, got[1].data_total, got[1].data_query, got[1].is_sidechain) == (None, 115.0, "y", True)


ENTRY = "entry_id long, entry_uuid string, file_name string, line_no int, session_id string, entry_type string, logged_at string, message_json string, data_json string, received_at timestamp, name string"


def entry(i, message=None, data=None, uuid="", session="s", kind="assistant", at="2026-01-01T00:00:00Z", file="s.jsonl", received=0):
    text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x)
    from datetime import datetime, timedelta

    return (i, uuid or f"u{i}", file, i, session, kind, at, text(message), text(data), datetime(2026, 1, 1) + timedelta(seconds=received or i), "clash")


def entries(spark, rows):
    return spark.createDataFrame(rows, ENTRY)


def test_nested_paths_at_any_depth(spark):
    deep = {"type": "text"}
    for _ in range(200):
        deep = {"type": "group", "content": ["s", deep]}
    df = entries(spark, [
        entry(1, {"content": [None, "x", {"type": "a", "content": {"type": "b"}}, {"content": "text"}]}, {"results": [{"hits": [1, {}]}, None, {"hits": {}}]}),
        entry(2, {"content": {"type": "lone"}}, {"results": {}}), entry(3, "{cut", "[]"), entry(4), entry(5, {"content": deep}), entry(6, {"content": "plain"}, {"results": "x"}),
    ])
    got = {(r.entry_id, r.block_path) for r in nested.found(df).collect()}
    assert {p for i, p in got if i == 1} == {"2", "2.0", "3", "results.0", "results.0.hits.1", "results.2", "results.2.hits.0"}
    assert {p for i, p in got if i == 2} == {"0", "results.0"}
    assert len([p for i, p in got if i == 5]) == 201
    assert not [i for i, _ in got if i in (3, 4, 6)]
    assert nested.found(df.limit(0)).count() == 0


def test_equal_subtrees_have_one_identity_and_all_occurrences(spark):
    block = {"type": "tool_use", "name": "R", "content": [{"x": 1, "y": [1.5, None, "é\ud800"]}]}
    swapped = {"content": [{"y": [1.5, None, "é\ud800"], "x": 1}], "name": "R", "type": "tool_use"}
    df = entries(spark, [entry(1, {"content": [block, block]}), entry(2, {"content": [swapped]}), entry(2, {"content": [swapped]})])
    bridge = nested.occurrences(df, roots=True)
    blocks = bridge.where("kind = 'block' and type = 'tool_use'")
    assert blocks.select("object_id").distinct().count() == 1 and blocks.count() == 4
    assert {r.type: r.occurrences for r in nested.objects(bridge).where("kind = 'block'").collect()} == {"tool_use": 4, None: 4}
    parents = {(r.entry_id, r.block_path): r.object_id for r in bridge.collect()}
    assert all(parents[r.entry_id, r.parent_path] == r.parent_id for r in bridge.where("depth > 0").collect())


def test_all_objects_at_any_depth_have_exact_identities(spark):
    deep = '{"content":[' * 20_000 + "{}" + "]}" * 20_000
    lists = '{"a":' + "[" * 20_000 + '{"x":1}' + "]" * 20_000 + "}"
    df = entries(spark, [
        entry(1, {"usage": {"tokens": 1, "more": {"x": [[{"y": 1}], {"z": 2}]}}, "content": [[{"in": 1}], {"input": {"0": {"q": 1}, "a.b": {}}, "content": [{"input": {"q": 1}}]}]}), entry(2, deep), entry(3, lists), entry(4, lists[:-1]), entry(5, deep[:-1] + "]"),
    ])
    bridge = nested.occurrences(df, roots=True)
    got = {(r.entry_id, r.block_path): r for r in bridge.where("entry_id in (1, 3)").collect()}
    assert {p: got[1, p].kind for i, p in got if i == 1} == {
        "": "record", "usage": "object", "usage.more": "object", "usage.more.x.0.0": "object", "usage.more.x.1": "object", "content.0.0": "object", "1": "block",
        "1.input": "object", '1.input."0"': "object", '1.input."a.b"': "object", "1.0": "block", "1.0.input": "object",
    }
    assert got[1, '1.input."0"'].object_id == got[1, "1.0.input"].object_id and got[1, "1.0.input"].parent_path == "1.0" and got[1, "1.0.input"].member == "input"
    assert {p for i, p in got if i == 3} == {"", "a." + ".".join(["0"] * 20_000)}
    assert bridge.where("entry_id = 2").count() == 20_001 and bridge.where("entry_id in (4, 5)").count() == 0
    assert {(r.entry_id, r.block_path) for r in nested.found(df).where("entry_id = 1").collect()} == {(1, "1"), (1, "1.0")}
    numbers = ["1e400", "2e400", "0.1", "1e-1", "0.10000000000000000001", "12345678901234567890.5", "12345678901234567890.50", "12345678901234567891.5", "9" * 5000, "9" * 5001, '"\\ud800"', '"\\ud801"', "1", "1.5"]
    rows_ = nested.occurrences(entries(spark, [entry(i, '{"x":{"n":%s}}' % n) for i, n in enumerate(numbers)])).where("block_path = 'x'").collect()
    ids = {r.entry_id: r.object_id for r in rows_}
    assert len(ids) == len(numbers) and ids[2] == ids[3] and ids[5] == ids[6] and len(set(ids.values())) == len(numbers) - 2
    assert len({r.payload for r in rows_}) == len(numbers) - 2


def test_texts_read_with_a_stack_are_those_of_the_parser():
    import random

    random.seed(1)
    make = lambda d: random.choice([None, True, 1, -2.5, "a\n\u00e9", "", *([[make(d - 1) for _ in range(random.randint(0, 3))], {random.choice("abc"): make(d - 1) for _ in range(random.randint(0, 3))}] * 3 if d else [])])
    for _ in range(300):
        text = json.dumps(make(4), indent=random.choice([None, 1]))
        assert nested._deep(text) == json.loads(text)
        at = random.randrange(len(text))
        for broken in (text[:at] + text[at + 1 :], text[:at] + random.choice('{}[],:"0') + text[at:]):
            try:
                want = (json.loads(broken, parse_constant=nested._constant),)
            except ValueError:
                want = ()
            try:
                found = (nested._deep(broken),)
            except ValueError:
                found = ()
            assert found == want, broken


def test_every_parent_of_the_bridge_is_an_object_and_every_data_record_a_row(spark):
    objects = {r.object_id: r for r in QUERIES["p3_objects"](spark, str(DATA)).collect()}
    bridge = QUERIES["p3_bridge"](spark, str(DATA)).collect()
    assert {r.parent_id for r in bridge} - {None} <= set(objects) and {r.object_id for r in bridge} == set(objects)
    data = QUERIES["p3_data"](spark, str(DATA))
    told = "SELECT entry_id, session_id, entry_type, j->>'$.type' AS type, j->>'$.query' AS query FROM (SELECT *, CASE WHEN json_valid(data_json) THEN data_json::JSON END AS j FROM session_entries) WHERE json_type(j) = 'OBJECT'"
    assert rows(data.drop("object_id").toPandas()) == of_sql(told)
    assert {(r.entry_id, r.object_id) for r in data.collect()} == {(r.entry_id, r.object_id) for r in bridge if r.source == "data" and r.depth == 0}
    hard = entries(spark, [entry(1, data={"query": {"a": [1]}, "type": None}), entry(2, data={}), entry(3, data="{cut"), entry(4, data='{"query": "q", "results": [{}]}'), entry(5, data="[]"), entry(6)])
    assert {(r.entry_id, r.type, r.query) for r in nested.data(hard).collect()} == {(1, None, '{"a":[1]}'), (2, None, None), (4, None, "q")}


LINE = "line_id long, file_name string, file_format string, line_no int, raw string, arrived_at timestamp, reason string"


def lines(spark, raws, form="csv", header="session_id,logged_at,entry_type,role,output_tokens,text"):
    rows = ([(0, "f", form, 1, header, None, "clash")] if header else []) + [(i, "f", form, i + 1, raw, None, "clash") for i, raw in enumerate(raws, 1)]
    return spark.createDataFrame(rows, LINE)


T = "2026-01-31T23:59:59.123456789+05:30"


CSV = [
    (f"s,{T},user,user,,hello", None, None), (f'"s","{T}","user",,"12","a ""b"", \n c"', None, None), (f's,{T},user,,,a"b', "syntax", "text"), ('s","x,user,,,a', "syntax", "session_id"), (f's,{T},user,"a"b,,a,b,c,"d', "syntax", "role"), (f's,{T},user,,,a,"b', "syntax", None),
    (f's,{T},user,,,"a"b', "syntax", "text"), (f's,{T},user,,,"a', "syntax", "text"), (f"s,{T},user,,,a\nb", "syntax", "text"), (f"s,{T},user,,", "columns", "text"), (f"s,{T},user,,,a,", "columns", None),
    ("", "columns", "logged_at"), (None, "syntax", None), ("s,2026-02-30T00:00:00Z,user,,,a", "value", "logged_at"), ("s,2026-01-01T24:00:00Z,user,,,a", "value", "logged_at"),
    ("s,2024-02-29T00:00:00Z,user,,,a", None, None), ("s,2023-02-29T00:00:00Z,user,,,a", "value", "logged_at"), ("s,2026-01-01T00:00:00,user,,,a", "value", "logged_at"),
    (f"s,{T},User,,,a", "value", "entry_type"), (f"s,{T},user,,-1,a", "value", "output_tokens"), (f"s,{T},user,,1.0,a", "value", "output_tokens"), (f's,{T},user,,"",' + "x" * 300_000, None, None),
    (f's,{T},user,,"","' + '""' * 200_000 + '"', None, None),
]


def test_csv_lines(spark):
    got = {r.line_id: (r.reason, r.field) for r in rejects.parse(lines(spark, [raw for raw, *_ in CSV])).collect()}
    assert [got[i] for i in range(1, len(CSV) + 1)] == [(reason, field) for _, reason, field in CSV]


def test_csv_values_and_other_orders(spark):
    row = rejects.loaded(lines(spark, [f',{T},"a ""b""\tc",user,7,assistant'], header="role,logged_at,text,entry_type,output_tokens,session_id")).first()
    assert (row.session_id, row.entry_type, row.role, row.output_tokens, row.text) == ("assistant", "user", None, 7, 'a "b"\tc')
    tsv = lines(spark, [f's\t{T}\tuser\t\t\ta,"b'], "tsv", "session_id\tlogged_at\tentry_type\trole\toutput_tokens\ttext")
    assert rejects.parse(tsv).first().reason == "syntax"
    assert [r.reason for r in rejects.parse(lines(spark, ["a,b"], header=None).withColumn("line_no", F.lit(2))).collect()] == ["columns"]
    assert rejects.parse(lines(spark, []).limit(0)).count() == 0


def message(**more):
    return {"session_id": "s", "logged_at": T, "entry_type": "user", "output_tokens": None, "message": {"role": None, "content": [{"type": "text", "text": "x"}]}} | more


JSON = [
    (json.dumps(message()), None), (json.dumps(message(session_id=None)), None), (json.dumps(message(output_tokens="")), None), (json.dumps(message(output_tokens="07")), None),
    (json.dumps(message(output_tokens=1.5)), "value"), (json.dumps(message(output_tokens=True)), "value"), (json.dumps(message(entry_type=0)), "value"), (json.dumps(message(logged_at=None)), "value"),
    (json.dumps(message(message={"role": "a", "content": []})), "columns"), (json.dumps(message(message={"content": [{"text": ""}]})), "columns"), (json.dumps(message(message=None)), "columns"),
    (json.dumps({"a": 1}), "columns"), (json.dumps(message()) + ",", "syntax"), (json.dumps(message()) * 2, "syntax"), ("[]", "syntax"), ("", "syntax"), (None, "syntax"), ("{'a': 1}", "syntax"),
    ('{"a": NaN}', "syntax"), ('{"a": 01}', "syntax"), ('{"a": 1,}', "syntax"), ('{"a": "\t"}', "syntax"), ('{"a": "\\x"}', "syntax"),
    (json.dumps(message(extra={"a": [[[[[{"b": [1]}]]]]]})), None), (json.dumps(message(extra="\\\"" * 50_000)), None),
]


def test_json_lines(spark):
    got = {r.line_id: r.reason for r in rejects.parse(lines(spark, [raw for raw, _ in JSON], "jsonl", header=None)).collect()}
    assert [got[i] for i in range(1, len(JSON) + 1)] == [reason for _, reason in JSON]


def test_json_fields_values_escapes_and_depth(spark):
    one = json.dumps(message(output_tokens=12, session_id="é\"\\"))
    deep = json.dumps(message())[:-1] + ', "deep": ' + "[" * 20_000 + "]" * 20_000 + "}"
    raws = [
        one, one.replace('"role"', '"\\u0072ole"'), one.replace('"user"', '"us\\u0065r"'), json.dumps(message(session_id={"a": [1]}))[:-1] + ', "session_id": 5}', deep, deep[:-1],
        json.dumps(message(message={"role": 1, "content": [{"text": [2]}, {}]})), json.dumps({k: v for k, v in message().items() if k != "output_tokens"}), "{}", json.dumps(message(message={"role": 1, "content": [[{"text": 1}]]})),
        json.dumps(message(message={"role": 1, "content": {"text": 1}})), json.dumps(message(output_tokens=-0.0)), one.replace('"output_tokens": 12', '"output_tokens": ' + "1" * 5000), json.dumps(message(logged_at=1)), json.dumps(message(output_tokens=[])),
    ]
    got = sorted(rejects.parse(lines(spark, raws, "jsonl", header=None)).collect(), key=lambda r: r.line_id)
    assert [(r.reason, r.field) for r in got] == [
        (None, None), (None, None), (None, None), (None, None), (None, None), ("syntax", None), (None, None), (None, None), ("columns", "session_id"), ("columns", "message.content[0].text"),
        ("columns", "message.content[0].text"), ("value", "output_tokens"), (None, None), ("value", "logged_at"), ("value", "output_tokens"),
    ]
    assert [(r.session_id, r.entry_type, r.role, r.output_tokens, r.text) for r in got[:4]] == [('é"\\', "user", None, 12, "x")] * 3 + [('{"a": [1]}', "user", None, None, "x")]
    assert (got[6].role, got[6].text) == ("1", "[2]")


def test_headers_of_any_order_and_quoting(spark):
    row = rejects.loaded(lines(spark, [f"a,user,{T},b"], header='"text","entry_type", logged_at ,"text"\r')).first()
    assert (row.text, row.entry_type, row.session_id) == ("a", "user", None)
    got = rejects.parse(lines(spark, [f"a,User,{T},b", f"a,User,{T}"], header="x,entry_type,logged_at,text")).orderBy("line_id").collect()
    assert [(r.reason, r.field) for r in got] == [("value", "entry_type"), ("columns", "text")]


def calls(*tools, tokens=None, **more):
    return {"role": "assistant", "usage": {"output_tokens": tokens}, "content": [{"type": "tool_use", "name": t} for t in tools]} | more


def table_of(df):
    return {(r.entity, r.feature): (r.n, r.total, r.latest.isoformat() if r.latest else None) for r in df.collect()}


def test_features_count_each_entry_once_by_its_latest_delivery(spark):
    df = entries(spark, [
        entry(1, calls("A", "A", "B", tokens=5), at="2026-01-01T01:00:00Z"), entry(2, calls("A", tokens="7"), at="2026-01-01T02:00:00+01:00"),
        entry(3, calls("A", tokens=100), uuid="x", at="2026-01-01T09:00:00Z", received=3), entry(4, calls("B", tokens=-3), uuid="x", at="2026-01-01T00:30:00Z", received=9),
        entry(5, calls("", None), session=None, file="dir/t.jsonl"), entry(6, calls("A", tokens="x"), session="", file="dir/t.jsonl", at="bad"), entry(7), entry(8, "{cut"),
    ])
    events = features.tool_calls(df)
    got = table_of(features.session_tools(events))
    assert got == {
        ("s", "A"): (3, 12, "2026-01-01T01:00:00"), ("s", "B"): (2, 5, "2026-01-01T01:00:00"), ("t", "A"): (1, 0, "2026-01-01T00:00:06"),
    }
    wide = {r.session_id: r for r in features.session_features(df).collect()}
    assert wide["s"].tools == ["A", "B"] and wide["s"].calls == [3, 2] and wide["s"].seconds_since_last == [0, 0]
    assert features.session_features(df.limit(0)).count() == 0


def test_features_of_sessions_without_tools_and_of_later_deliveries_without_tools(spark):
    df = entries(spark, [
        entry(1, calls("A", tokens=5)), entry(2, calls("A", tokens=7), uuid="x", received=2), entry(3, {"role": "assistant", "content": "done"}, uuid="x", received=9),
        entry(4, calls("B"), uuid="y", session="cut", received=4), entry(5, "{cut", uuid="y", session="cut", received=9), entry(6, {"role": "user", "content": "hi"}, session=None, file="d/t.jsonl"),
        entry(7, "{cut", uuid="z", received=7), entry(8, calls("C"), uuid="z", received=8), entry(9, session="none"),
    ])
    assert table_of(features.session_tools(features.tool_calls(df))) == {("s", "A"): (1, 5, "2026-01-01T00:00:00"), ("s", "C"): (1, 0, "2026-01-01T00:00:00")}
    wide = {r.session_id: (r.tools, r.calls, r.seconds_since_last, r.output_tokens) for r in features.session_features(df).collect()}
    empty = ([], [], [], [])
    assert wide == {"s": (["A", "C"], [1, 1], [0, 0], [5, 0]), "cut": empty, "t": empty, "none": empty}


def test_batches_applied_to_a_state_equal_a_full_build(spark):
    rows_ = [
        entry(1, calls("A", tokens=5)), entry(2, calls("A", "B", tokens=7), uuid="x", at="2026-01-01T05:00:00Z"), entry(3, calls("C"), uuid="y"), entry(4, calls("B", tokens=2), session="t"),
        entry(5, calls("A", tokens=9), uuid="x", at="2026-01-01T01:00:00Z"), entry(6, "{cut", uuid="y"), entry(7, calls("D", tokens=1), session="t"), entry(8, calls("B"), uuid="x", at="2026-01-01T02:00:00Z"), entry(9, calls("C"), uuid="y"),
    ]
    state, held = None, None
    for batch in (rows_[:4], rows_[4:7], rows_[7:]):
        df = entries(spark, batch)
        if state is None:
            made = features.tool_calls(df)
            state, held = features.session_tools(made), made.where("last")
        else:
            state, held = features.applied(state, held, df)
    whole = features.tool_calls(entries(spark, rows_))
    assert table_of(state) == table_of(features.session_tools(whole)) and len(table_of(state)) == 5
    assert held.count() == whole.where("last").count()
    state, held = features.applied(state, held, entries(spark, []))
    assert table_of(state) == table_of(features.session_tools(whole))


def test_deltas_equal_a_full_build(spark):
    import random

    random.seed(5)
    schema = "id int, entity string, feature string, at timestamp, amount long"
    from datetime import datetime, timedelta

    make = lambda i: (i, random.choice("abc"), random.choice("xy"), datetime(2026, 1, 1) + timedelta(hours=random.randint(0, 9)), random.choice([None, 1, 5]))
    old, new = [make(i) for i in range(60)], [make(i) for i in range(60, 90)]
    gone = random.sample(old, 25)
    frame = lambda rows: spark.createDataFrame(rows, schema)
    state = features.aggregate(frame(old).withColumn("sign", F.lit(1))).drop("retracted")
    deltas = frame(new).withColumn("sign", F.lit(1)).unionByName(frame(gone).withColumn("sign", F.lit(-1)))
    history = frame([r for r in old if r not in gone] + new)
    whole = features.aggregate(history.withColumn("sign", F.lit(1)))
    assert table_of(features.maintain(state, deltas, history)) == table_of(whole)
