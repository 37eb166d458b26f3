"""Handwritten sources, conversations, tokens, packing and reading levels: brute force on small tables, and hard cases."""

import base64
import json
import math
import random
import re
import unicodedata
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.compare import DATA, of_sql, rows
from tidemark.llm import conversations, handwritten, packing, reading, tokens
from tidemark.llm.queries import QUERIES, SQL

RANKS = f"{tokens.TOKENIZERS}/{tokens.BYTE_BPE}.tiktoken"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_and_equals_its_sql(spark, name):
    df = QUERIES[name](spark, str(DATA))
    if name in SQL:
        assert rows(df.toPandas()) == of_sql(SQL[name])
    else:
        assert df.columns and df.count() >= 0


# --- handwritten sources

FILES = "file_id long, project_id int, path string, is_dir boolean, kind string, extension string"
HAND = "def total(rows):\n    # adds what was {0}\n    out = {1}\n    for row in rows:\n        out += row.{0}\n    return out\n\n\nclass {0}Store:\n    def keep(self, {0}):\n        self.seen[{0}] = True\n        return len(self.seen) > {1}\n"


def kinds(spark, sources):
    files = [(i, p, path, False, "clash", "clash") for i, (p, path, _) in enumerate(sources)]
    contents = [(i, c, path) for i, (_, path, c) in enumerate(sources)]
    df = handwritten.classify(spark.createDataFrame(files, FILES), spark.createDataFrame(contents, "file_id long, content string, path string"))
    return {r.file_id: r.kind for r in df.collect()}


def test_kinds_of_source_files(spark):
    counted = "".join(f"export const item{i} = {{ id: {i}, op: 'get{i}' }};\n" for i in range(40))
    lib = HAND.format("shared", 3)
    sources = [
        (1, "/p/src/a.py", HAND.format("alpha", 7)), (1, "/p/src/gen.ts", counted), (1, "/p/src/g.go", "// Code generated by toolx. DO NOT EDIT.\npackage a\n\nfunc A() int { return 1 }\n"),
        (1, "/p/x.js", "var a=b?c(d):e;" * 300), (1, "/p/wrapped.js", ("function f(a){return a?b(a):3}" * 20 + "\n") * 6), (1, "/p/data.py", "X = [\n" + "  12, 250, 7, 99, 3, 18, 4, 201,\n" * 20 + "]\n"),
        (1, "/p/blob.go", 'package a\n\nconst b = "' + base64.b64encode(bytes(range(256)) * 4).decode() + '"\n'), (1, "/p/vendor/kit/m.py", HAND.format("beta", 2)),
        (1, "/p/util/l.py", lib), (2, "/q/helpers/m.py", "# Copied from kit v2, upstream commit 1\n" + lib.replace("\n", "\r\n")), (1, "/p/vendors/m.py", HAND.format("gamma", 4)),
        (1, "/p/codegen/w.py", 'BANNER = "Code generated by x. DO NOT EDIT."\n' + HAND.format("delta", 5)), (1, "/p/rows.sql", "".join(f"INSERT INTO t VALUES ({i}, 'a', 0.{i}17);\n" for i in range(30))),
        (1, "/p/empty.py", ""), (1, "/p/null.py", None), (1, "/p/twice/a.py", HAND.format("alpha", 7)), (1, "\\p\\src\\win.py", HAND.format("eps", 6)), (1, "/p/readme.md", "text"),
        (1, "/p/long.py", HAND.format("zeta", 8) + "# " + "many words in one line " * 100 + "\n"), (1, "/p/huge.py", "".join(HAND.format(w, i % 9 + 11) for i, w in enumerate(["red", "blue", "green", "grey"])) + "# é\n" * 200_000),
    ]
    got = kinds(spark, sources)
    want = ["handwritten", "generated", "generated", "minified", "minified", "data", "data", "vendored", "vendored", "vendored", "handwritten", "handwritten", "data", "handwritten", "handwritten", "handwritten", "handwritten", None, "handwritten", "handwritten"]
    assert {i: k for i, k in enumerate(want) if k} == got


def test_kinds_of_empty_tables_and_nulls(spark):
    files, contents = spark.createDataFrame([], FILES), spark.createDataFrame([], "file_id long, content string")
    assert handwritten.found(files, contents).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None, None), (3, None, "/x/a.py", None, None, None)], FILES)
    assert {(r.file_id, r.kind) for r in handwritten.classify(nulls, contents).collect()} == {(3, "handwritten")}


def test_layout_equals_a_plain_reading():
    random.seed(3)
    texts = ["".join(random.choice("ab1_ 0x\t\n#/.é,") for _ in range(random.randint(0, 300))).encode() + b"\n" for _ in range(200)]
    got = handwritten._measure(texts)
    for i, t in enumerate(texts):
        s = t.decode()[:-1]
        parts = [x.encode() for x in s.split("\n")]
        assert got["size"][i] == len(t) - 1 and got["max_line"][i] == max(map(len, parts))
        assert got["lines"][i] == sum(bool(x.strip(b" \t")) for x in parts)
        assert round(got["space"][i] * max(1, len(t) - 1)) == sum(c in b" \t\n" for c in t[:-1])
        assert got["encoded_run"][i] == max([len(m.group()) for m in re.finditer(rb"[A-Za-z0-9+/=_-]+", t[:-1])] or [0])
        code = [x for x in parts if x.strip(b" \t") and not re.match(rb"[ \t]*(?:#|//|/\*|\*|--|\"\"|'')", x)]
        code = [x for x in parts if x.strip(b" \t") and not (re.match(rb"[ \t]*#(?![idep!\[])", x) or re.match(rb"[ \t]*(?://|/\*|\*|--|\"\"|'')", x))]
        assert got["code_lines"][i] == len(code)
        shape = lambda x: re.sub(rb"(\d)\d*", b"0", re.sub(rb"[A-Za-z_\x80-\xff]+", b"a", re.sub(rb"[ \t]", b"", x)))
        assert round(got["shapes"][i] * max(1, len(code))) == len({shape(x) for x in code})


def test_profiles_are_equal_where_lines_hold_the_same():
    random.seed(4)
    texts = ["\n".join(random.choice(["a1", "b 2", "a_b", "", "  ", "12", "é(", "xx"]) for _ in range(random.randint(1, 3))).encode() + b"\n" for _ in range(300)]
    heads = [random.choice([0, t.index(b"\n") + 1]) for t in texts]
    got = handwritten._measure(texts, heads)["profile"]
    letter = set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_") | set(range(128, 256))

    def plain(t, h):
        parts = [bytes(c for c in x if c not in b" \t") for x in t[h:].split(b"\n")]
        return tuple((len(x), sum(c in b"0123456789" for c in x), sum(c in letter for c in x)) for x in parts if x)

    pairs = {(plain(t, h), p) for t, h, p in zip(texts, heads, got.tolist())}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


# --- conversations

ENTRY = "entry_id long, entry_uuid string, file_name string, line_no int, session_id string, entry_type string, logged_at string, message_json string, received_at timestamp, role string, text string"
START = datetime(2026, 1, 1)


def turn(i, kind, content, session="s", role=None, at=None, uuid=None, line=None, message=None, file="s.jsonl"):
    body = message if message is not None else json.dumps({"role": role or kind, "content": content})
    when = at if at is not None else (START + timedelta(seconds=i)).isoformat() + "Z"
    return (i, uuid or f"{session}-{i}", file, i if line is None else line, session, kind, when, body, START + timedelta(seconds=i), "clash", "clash")


def dropped(spark, turns):
    return {r.session_id for r in conversations.found(spark.createDataFrame(turns, ENTRY)).collect()}


def test_reasons_to_drop(spark):
    use, result = [{"type": "tool_use", "id": "t", "name": "R"}], [{"type": "tool_result", "tool_use_id": "t"}]
    talk = lambda s, *parts: [turn(100 * n + i, k, c, session=s) for n, (k, c) in enumerate(parts) for i in [hash(s) % 7]]
    ok = [("user", "hi"), ("assistant", "yes")]
    turns = (
        talk("fine", *ok) + talk("tool", ("user", "q"), ("assistant", use), ("user", result), ("user", result)) + talk("empty", ("user", "​ ﻿"), ("assistant", [{"type": "text", "text": " "}]))
        + talk("open", *ok, ("user", "more")) + talk("two", ("user", "a"), ("user", [{"type": "text", "text": "b"}]), ("assistant", "c")) + talk("late", ("assistant", "a"), ("user", "b"), ("assistant", "c"))
        + talk("system", ("system", None)) + talk("blank reply", ("user", "a"), ("assistant", [{"type": "thinking"}])) + talk("lone", ("user", {"type": "text", "text": "x"}), ("assistant", {"type": "tool_use"}))
        + talk("role", *ok)[:1] + [turn(901, "assistant", "x", session="role", role="user")] + talk("cut", *ok) + [turn(902, "user", None, session="cut", message="{cut")]
        + talk("time", *ok) + [turn(903, "assistant", "x", session="time", at="yesterday")] + talk("null", *ok) + [turn(904, "user", None, session="null")[:7] + (None, START, "", "")]
        + talk("progress", *ok, ("progress", None))
    )
    assert dropped(spark, turns) == {"empty", "open", "two", "late", "system", "blank reply", "role", "cut", "time", "null"}


def test_order_offsets_deliveries_and_file_names(spark):
    turns = [
        turn(1, "assistant", "answer", at="2026-01-01T00:00:05.000000002Z"), turn(2, "user", "question", at="2026-01-01T05:30:05.000000001+05:30"),
        turn(3, "user", "q", session=None, file="d/named.jsonl"), turn(4, "assistant", "a", session="", file="named.jsonl"),
        turn(5, "user", "again", session="twice", uuid="x"), turn(6, "user", "again", session="twice", uuid="x", at="2026-01-01T00:00:05Z"), turn(7, "assistant", "a", session="twice"),
        turn(8, "user", "tie", session="ties", at="2026-01-01T00:00:00Z", line=1), turn(9, "assistant", "tie", session="ties", at="2026-01-01T00:00:00Z", line=2),
    ]
    assert dropped(spark, turns) == set()
    assert dropped(spark, [turn(1, "user", "q")])  == {"s"}
    assert conversations.found(spark.createDataFrame([], ENTRY)).count() == 0
    assert conversations.conversations(spark.createDataFrame([], ENTRY)).count() == 0


def test_links_follow_mentions_and_questions_start_trees(spark):
    turns = [
        turn(1, "user", "alpha question"), turn(2, "assistant", [{"type": "tool_use", "id": "one"}]), turn(3, "assistant", [{"type": "tool_use", "id": "two"}]),
        turn(4, "user", [{"type": "tool_result", "tool_use_id": "one"}]), turn(5, "user", [{"type": "tool_result", "tool_use_id": "two"}]), turn(6, "assistant", "done"), turn(7, "user", "other"), turn(8, "assistant", "fine"),
    ]
    got = {r.position: (r.parent, r.root, r.role) for r in conversations.conversations(spark.createDataFrame(turns, ENTRY)).collect()}
    assert got[3][0] == 1 and got[4][0] == 2 and got[6] == (None, 6, "user") and got[7] == (6, 6, "assistant") and {got[i][1] for i in range(6)} == {0}


def test_links_find_calls_at_any_distance_and_compare_all_words(spark, monkeypatch):
    turns = [turn(0, "user", "start"), turn(1, "assistant", [{"type": "tool_use", "id": "far"}])]
    turns += [turn(i, "assistant", "between") for i in range(2, 30)] + [turn(30, "user", [{"type": "tool_result", "tool_use_id": "far"}])]
    df = spark.createDataFrame(turns, ENTRY)
    placed = conversations.positions(conversations.entries_once(df))
    monkeypatch.setattr(conversations, "CHUNK", 8)
    for rows_ in (placed, placed.repartitionByRange(6, "position").sortWithinPartitions("position")):
        got = {r.position: r.parent for r in conversations.links(rows_).collect()}
        assert len(got) == 31 and got[30] == 1
    assert len(conversations._words(" ".join(map(str, range(100))))) == 100


def scores(messages):
    """Best parent of each message of one session among all earlier ones, by brute force; messages as rows of entries_once in order."""
    w, out = conversations.WEIGHTS, {}
    kind = lambda m: 1 if m.entry_type == "user" and m.has_text else 2 if m.entry_type == "assistant" and (m.has_text or m.tool_use) else None
    for p, m in enumerate(messages):
        asked = max([i for i in range(p) if kind(messages[i]) == 1], default=-1)
        replied = max([i for i in range(p) if kind(messages[i]) == 2], default=-1)
        calls = {i: max(c for c in range(p) if i in messages[c].calls) for i in m.answers or [] if any(i in messages[c].calls for c in range(p))}
        best = None
        for i in range(p):
            c = messages[i]
            passed = 0 if m.at is None else conversations.UNKNOWN if c.at is None else max(0, (m.at - c.at).total_seconds())
            common = len(set(m.words or []) & set(c.words or [])) / max(1, min(len(m.words or []), len(c.words or [])))
            mention = i in calls.values()
            told = w["turn"] if kind(m) == 2 and i == asked > replied else w["mention"] if mention else w["words"] * common
            best = max(best or (-math.inf, -1), (told + w["time"] * math.log1p(passed + conversations.STEP * (p - i)) + w["speaker"] * (m.entry_type != c.entry_type), i))
        out[p] = best[1] if best and (kind(m) != 1 or best[0] > conversations.TIED) else None
    return out


def test_links_are_the_best_of_all_earlier_messages(spark, monkeypatch):
    random.seed(9)
    turns, when, n = [], 0, 0
    for s in ("a", "b"):
        for _ in range(160):
            n += 1
            when += random.choice([0, 1, 5, 40, 3000, 200_000])
            body = random.choice([" ".join(random.choices("red blue green grey black white".split(), k=random.randint(1, 6))), [{"type": "tool_use", "id": f"t{n}"}], [{"type": "tool_result", "tool_use_id": f"t{random.randint(1, n)}"}], " "])
            at = None if random.random() < 0.9 else "never"
            turns.append(turn(n, random.choice(["user", "assistant"]), body, session=s, at=at or (START + timedelta(seconds=when)).isoformat() + "Z"))
    once = conversations.entries_once(spark.createDataFrame(turns, ENTRY))
    placed = conversations.positions(once)
    rows_ = sorted(placed.collect(), key=lambda r: (r.session_id, r.position))
    want = {(s, p): parent for s in ("a", "b") for p, parent in scores([r for r in rows_ if r.session_id == s]).items()}
    assert {(r.session_id, r.position): r.parent for r in conversations.links(placed).collect()} == want
    # cut into pieces of a few rows each, with small windows and chunks: most searches go on in the rows of other tasks
    monkeypatch.setattr(conversations, "CHUNK", 16)
    monkeypatch.setattr(conversations, "WINDOW", 4)
    monkeypatch.setattr(conversations, "GROWTH", 2)
    cut = placed.repartitionByRange(40, "session_id", "position").sortWithinPartitions("session_id", "position")
    assert {(r.session_id, r.position): r.parent for r in conversations.links(cut).collect()} == want
    assert any(p - parent > 64 for (_, p), parent in want.items() if parent is not None)


def test_reply_links_decide_which_conversations_are_dropped(spark):
    turns = [turn(1, "user", "q"), turn(2, "assistant", "a"), turn(3, "user", "r"), turn(4, "assistant", "b"), turn(5, "user", "x", session="t"), turn(6, "user", "y", session="t"), turn(7, "assistant", "z", session="t")]
    once = conversations.entries_once(spark.createDataFrame(turns, ENTRY))
    linked = conversations.links(conversations.positions(once))
    drop = lambda of: {r.session_id for r in conversations.reasons(conversations.session_facts(once), of).where("no_reply").collect()}
    assert drop(linked) == {"t"}
    assert drop(linked.withColumn("parent", F.lit(None).cast("bigint"))) == {"s", "t"}
    assert drop(linked.withColumn("parent", F.lit(0).cast("bigint"))) == {"s", "t"}  # the second question has lost its reply


def test_the_cut_into_tasks_doesnt_change_conversations(spark, monkeypatch):
    random.seed(8)
    turns, n = [], 0
    for s in range(30):
        for _ in range(random.randint(1, 40)):
            n += 1
            kind = random.choice(["user", "assistant"])
            turns.append(turn(n, kind, random.choice(["text of " + random.choice("abc"), [{"type": "tool_use", "id": f"t{n}"}], [{"type": "tool_result", "tool_use_id": f"t{n - 1}"}], "  "]), session=f"s{s}"))
    df = spark.createDataFrame(turns, ENTRY)
    placed = conversations.positions(conversations.entries_once(df))
    told = lambda of: sorted((r.session_id, r.position, r.parent if r.parent is not None else -1) for r in conversations.links(of).collect())
    whole = told(placed)
    monkeypatch.setattr(conversations, "CHUNK", 8)
    monkeypatch.setattr(conversations, "WINDOW", 2)
    for n in (7, 150):
        assert told(placed.repartitionByRange(n, "session_id", "position").sortWithinPartitions("session_id", "position")) == whole


# --- tokens


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TRICKY = st.text(st.one_of(st.sampled_from(list("a's tremdvl'  \n\t\r0.,!<|>endofx")), st.characters(codec="utf-8")), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(TRICKY, max_size=5))
def test_ids_of_any_text(texts):
    ids, counts = tokens.encoder(RANKS).encode(texts)
    import public_tokenizers

    ref = test_ids_of_any_text.__dict__.setdefault("ref", tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={}))
    at = 0
    for t, n in zip(texts, counts, strict=True):
        if all(unicodedata.category(c) != "Cn" for c in t):  # code points that another version of Unicode may have assigned
            assert ids[at : at + n].tolist() == ref.encode_ordinary(t)
        at += n


def test_ids_round_trip_nulls_and_long_texts(spark, reference):
    texts = [None, "", " ", "a" * 50_000, "it's <|endoftext|> 😀\r\n\r\n x", "x y " * 200_000, "it's", "it's"]
    df = spark.createDataFrame([(i, t, [9]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r for r in tokens.decode(tokens.encode(df)).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == reference.encode_ordinary(t or "") and got[i].decoded == (t or "")
    assert tokens.encode(df.limit(0)).count() == 0


def test_scan_is_that_of_one_step_after_the_other(monkeypatch):
    after, begins = tokens._automaton()
    random.seed(5)
    for block in (1, 3, 64):
        monkeypatch.setattr(tokens, "BLOCK", block)
        for n in (1, 2, 63, 64, 65, 500):
            symbols = np.array([random.randrange(9) for _ in range(n)], np.uint8)
            state, want = 0, []
            for x in symbols.tolist():
                want.append(bool(begins[x * 8 + state]))
                state = int(after[x * 8 + state])
            assert tokens._scan(symbols).tolist() == want


def test_offsets_tell_where_each_piece_stands(spark, monkeypatch):
    texts = [None, "", "it's a  test\n\n of 12 é😀 things", "x y " * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in tokens.decode(tokens.encode(df, offsets=True)).collect():
        t = texts[r.doc_id] or ""
        cut = [t[a:b] for a, b in zip(r.starts, [*r.starts[1:], len(t)])]
        assert r.decoded == t and "".join(cut) == t and sum(r.sizes) == len(r.ids)
        assert r.doc_id != 2 or cut == ["it", "'s", " a", " ", " test", "\n\n", " of", " 12", " é", "😀", " things"]
    with pytest.raises(ValueError):
        tokens._placed([b"a", b"b"], [0, 2], [1, 1])
    monkeypatch.setattr(tokens, "LONG", 16)
    whole, parts = tokens.encoder(RANKS)._encode(texts[2:]), tokens.encoder(RANKS).encode_pieces(texts[2:])
    assert all(a.tolist() == b.tolist() for a, b in zip(whole, parts))


def test_a_full_cache_starts_anew(monkeypatch, reference):
    monkeypatch.setattr(tokens, "CACHE", 2000)
    enc = tokens.Encoder(RANKS)
    for i in range(30):
        text = " ".join(f"word{j}" for j in range(i * 10, i * 10 + 15))
        assert enc.encode([text])[0].tolist() == reference.encode_ordinary(text) and enc.held < 12_000


# --- packing


def packed(spark, texts, capacity=64):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    return packing.containers(df, capacity).withColumn("container", F.col("container").cast("string")).toPandas()


def test_containers_hold_every_token_once(spark, reference):
    random.seed(2)
    word = lambda: random.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"])
    texts = [" ".join(word() for _ in range(random.choice([1, 3, 10, 30, 60, 64, 200]))) for _ in range(300)] + [None, "", texts_ := "same text here", texts_, texts_]
    out = packed(spark, texts)
    sizes = pd.Series([len(reference.encode_ordinary(t or "")) for t in texts])
    assert out.groupby("doc_id").n_tokens.sum().equals(sizes.rename("n_tokens").rename_axis("doc_id").astype(out.groupby("doc_id").n_tokens.sum().dtype))
    full = out[out.container.notna()]
    used = full.groupby("container").n_tokens.sum()
    assert used.max() <= 64 and ((used + full.groupby("container").room.max()) == 64).all()
    assert not full.duplicated(["container", "position"]).any() and not full.duplicated(["doc_id", "part"]).any()
    # a text is split only where it is larger than a container, and then into full parts and a rest
    assert (out.groupby("doc_id").part.nunique() == (sizes.clip(lower=1) + 63) // 64).all()
    assert len(used) <= -(-sizes.sum() // 64) * 1.05 + 1
    assert packed(spark, ["x"]).room.tolist() == [63] and len(packed(spark, [None, ""])) == 2


def test_neighbours_share_a_container(spark):
    texts = [f"{w} {w} {w} {w}" for w in ("mountain", "harbour", "orchard", "library") for _ in range(8)]
    out = packed(spark, texts, 33)
    kind = out.doc_id // 8
    assert kind.groupby(out.container).nunique().mean() < 1.6


def test_scores_are_bm25_of_all_words():
    random.seed(7)
    texts = [[random.randrange(40) for _ in range(random.randint(0, 30))] for _ in range(60)]
    idf = np.random.default_rng(1).random(40).astype(np.float32)
    pairs = [sorted({(t, x.count(t)) for t in x}) for x in texts]
    terms, freqs = (np.array([p[k] for x in pairs for p in x]) for k in (0, 1))
    lengths = np.array([max(1, len(x)) for x in texts], float)
    index = packing._Index(terms, freqs, np.concatenate(([0], np.cumsum([len(x) for x in pairs]))), lengths, idf)
    for seed in range(60):
        words = {t for t, _ in pairs[seed]}
        for i, score in enumerate(index.scores(seed)):
            norm = packing.K1 * (1 - packing.B + packing.B * lengths[i] / lengths.mean())
            assert score == pytest.approx(sum(idf[t] * f * (packing.K1 + 1) / (f + norm) for t, f in pairs[i] if t in words), rel=1e-4)


def test_words_of_other_scripts_have_neighbours_and_full_parts_have_numbers_of_their_own(spark):
    texts = [w * 3 for w in ("книга берег ", "山川草木 ", "βιβλίο θάλασσα ") for _ in range(6)]
    sized = packing.measured(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.terms for r in sized)
    out = packed(spark, ["a b c d e f g h " * 40] * 50)
    full = out[out.n_tokens == 64]
    assert len(full) > 100 and full.container.nunique() == len(full)


def test_packing_an_empty_table(spark):
    assert packing.containers(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- reading levels

STYLES = {
    1: ["take the cup and fill it", "we may see the dog now", "the box is red and the hat is blue"],
    2: ["the program reads the folder and reports each change", "every project keeps its settings in one file"],
    3: ["because conventions differ considerably, the analysis determines the remaining dependencies", "although the configuration is usually preferred, validation restricts execution"],
    4: ["the epistemic instantiation presupposes an irreducible commensurability of intensional entailments", "insofar as no countervailing obligation obtains, the mereological supervenience is attenuated"],
}


def corpus(spark, n=240):
    random.seed(4)
    docs, labels = [], []
    for i in range(n):
        level = i % 4 + 1
        near = max(1, level - 1)
        text = ". ".join(random.choice(STYLES[level if random.random() < 0.85 else near]) for _ in range(random.randint(4, 30)))
        docs.append((i, text + "\n```\nepistemic mereological\n```", level))
        if i < 100:
            labels.append((i, level if random.random() < 0.95 else 5 - level, "a"))
    return docs, labels


DOCS, LABELS = "doc_id long, text string, level int", "doc_id long, band int, text string"


def test_levels_of_documents_without_labels(spark):
    docs, labels = corpus(spark)
    got = {r.doc_id: r.level for r in reading.levels(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    held = [(i, level) for i, _, level in docs if i >= 100]
    assert sum(got[i] == level for i, level in held) / len(held) > 0.95


def test_estimation_ends_and_words_of_higher_levels_are_more_difficult(spark):
    docs, labels = corpus(spark)
    words = reading._words_of(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), tokens.BYTE_BPE, tokens.TOKENIZERS)
    model, told = reading.fitted(words)
    assert [n for n, *_ in told] == list(range(1, len(told) + 1)) and len(told) > 1
    likelihood = [ll for _, ll, _ in told]
    assert told[-1][2] < reading.TOLERANCE or likelihood[-1] < likelihood[-2]
    assert likelihood[:-1] == sorted(likelihood[:-1]) and 100 * math.log(1 / 4) < max(likelihood) < 0  # better than a guess of each label

    def difficulty(text):
        ids, _ = tokens.encoder(RANKS).encode([text])
        return model.difficulty[reading._buckets(ids, np.zeros(len(ids), int), reading._prose_ids(RANKS))[1]].mean()

    of = [difficulty(". ".join(STYLES[k])) for k in (1, 2, 3, 4)]
    assert of == sorted(of) and model.link[0] > 0
    assert reading.fitted(words.where("anchor is null")) == (None, [])


def test_an_unclosed_fence_ends_with_its_line(spark):
    docs, labels = corpus(spark)
    ends = [(900, "```\n" + ". ".join(STYLES[4] * 20), 0), (901, ". ".join(STYLES[4] * 20) + "\n```py\n", 0)]
    got = {r.doc_id: (r.level, r.words) for r in reading.levels(spark.createDataFrame(docs + ends, DOCS), spark.createDataFrame(labels, LABELS)).where("doc_id >= 900").collect()}
    assert got[900] == got[901] and got[900][0] == 4


def test_levels_of_hard_cases(spark):
    docs, labels = corpus(spark, 120)
    more = [(900, None, 0), (901, "", 0), (902, " \n​", 0), (903, "```\ncode only\n```", 0), (904, ". ".join(STYLES[4] * 5000), 0), (905, docs[3][1], 0), (905, docs[3][1], 0), (None, "the box", 0)]
    table = spark.createDataFrame(docs + more, DOCS)
    odd = spark.createDataFrame(labels + [(3, None, ""), (7, 9, ""), (None, 4, ""), (12345, 2, ""), (0, 1, "")], LABELS)
    got = {r.doc_id: r.level for r in reading.levels(table, odd).collect()}
    assert [got[i] for i in (900, 901, 902, 903)] == [None] * 4 and got[904] == 4 and got[905] == got[3]
    assert reading.levels(table, odd.limit(0)).where("level is not null").count() == 0
    assert reading.levels(table.limit(0), odd).count() == 0 and reading.found(table, odd).where("doc_id in (900, 901)").count() == 0


def test_very_long_texts_are_encoded_in_stretches(monkeypatch, reference):
    random.seed(6)
    monkeypatch.setattr(tokens, "LONG", 20)
    texts = ["".join(random.choice("a's re'll  \n\t　0é中!'") for _ in range(random.randint(0, 120))) for _ in range(300)]
    ids, counts = tokens.encoder(RANKS).encode(texts)
    bounds = [0, *counts.cumsum().tolist()]
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [reference.encode_ordinary(t) for t in texts]
    assert all("".join(tokens.stretches(t, 20)) == t for t in texts)
