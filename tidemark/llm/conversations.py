"""Conversations put together from message rows, as ordered turns and as trees of replies.

Every message looks back at the messages before it in its session and scores each as the one it replies to: by the
time between them, by mentions (a tool result names the call it answers), by turns (the first reply after a question is
drawn to it), by shared words and by the change of speaker. The likeliest is its parent; a question that nothing ties to
an earlier message starts a tree. A question is answered if a reply before the next question has it as its parent.

All earlier messages are candidates, but few need a look: time only lowers the score of older ones, so a message looks
back until no older one could be better than the best so far. Messages lie sorted by session and time over all tasks, and
each task looks back as far as its own rows go. A session may hold any share of all rows: where one begins in an earlier
task, the messages whose search isn't over at the first row of a task go on by joins, in windows that grow.
"""

from __future__ import annotations

import math
import unicodedata
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.instants import instant
from tidemark.functions.schemas import flat
from tidemark.operators.nested import parsed, utf8
from tidemark.session import stored

#: Messages of the first window in which a search goes on before a task's rows, and how windows grow.
WINDOW, GROWTH = 256, 16
#: Positions of a session in one chunk, where calls are looked up by their ids.
CHUNK = 8192
#: Weights of the score: per factor e of time, for a mention, for the open question that a reply follows, for the share of
#: common words, for the other speaker.
WEIGHTS = {"time": -1.0, "mention": 40.0, "turn": 60.0, "words": 1.5, "speaker": 0.5}
#: Seconds that a message in between adds to the time; seconds to a message without a time.
STEP, UNKNOWN = 15.0, 1e12
#: A question replies to an earlier message only above this score.
TIED = -2.0
#: Characters that show nothing though Unicode doesn't class them as blank or format.
HIDDEN = "\u034f\u115f\u1160\u17b4\u17b5\u2800\u3164\uffa0" + "".join(map(chr, range(0xFE00, 0xFE10)))
FACTS = flat(
    "parses boolean, role string, has_text boolean, tool_use boolean, tool_result boolean, calls array<string>,"
    " answers array<string>, words array<int>"
)


@lru_cache(maxsize=1 << 16)
def _shows(char: str) -> bool:
    return not char.isspace() and unicodedata.category(char) not in ("Cc", "Cf", "Zs", "Zl", "Zp") and char not in HIDDEN


def visible(text) -> bool:
    """Whether a text has a character that can be seen; zero-width characters can't."""
    return isinstance(text, str) and any(map(_shows, text))


def _words(text: str) -> list[int]:
    return sorted({xxhash.xxh32_intdigest(w.encode(errors="replace")) - (1 << 31) for w in set(text.lower().split())})


def _blocks(content) -> list[dict]:
    """Top-level blocks of a message; a lone object counts as one."""
    return [content] if isinstance(content, dict) else [b for b in content if isinstance(b, dict)] if isinstance(content, list) else []


def _texts(content) -> list[str]:
    return [content] if isinstance(content, str) else [b["text"] for b in _blocks(content) if b.get("type") == "text" and isinstance(b.get("text"), str)]


def _facts(text: str | None) -> tuple:
    record = parsed(text)
    if not isinstance(record, dict):
        return (False, None, False, False, False, [], [], [])
    content, role = record.get("content"), record.get("role")
    blocks, texts = _blocks(content), _texts(content)
    kind = lambda k: [b for b in blocks if b.get("type") == k]
    ids = lambda k, key: [utf8(b[key]) for b in kind(k) if isinstance(b.get(key), str)]
    return (
        True, utf8(role) if isinstance(role, str) else None, any(map(visible, texts)), bool(kind("tool_use")), bool(kind("tool_result")),
        ids("tool_use", "id"), ids("tool_result", "tool_use_id"), _words("\n".join(texts)),
    )


def entries_once(entries: DataFrame) -> DataFrame:
    """One row per log entry: session, time, type and the facts of its message; the latest delivery counts.

    The session is told by the file name where session_id is missing or empty. Rows of equal entry_uuid are one
    entry, rows without one are entries of their own. Messages are user and assistant entries; others keep null facts.
    """
    message = F.col("entry_type").isin("user", "assistant")
    df = entries.select(
        "entry_id", "line_no", "received_at", "entry_type", F.when(message, F.col("message_json")).alias("message_json"), instant(F.col("logged_at")).alias("at"),
        # digits after the sixth, which a timestamp doesn't hold
        F.coalesce(F.rpad(F.regexp_extract("logged_at", r"\.\d{6}(\d{1,3})", 1), 3, "0").try_cast("int"), F.lit(0)).alias("nanos"),
        F.coalesce("entry_uuid", F.concat(F.lit("#"), F.col("entry_id").cast("string"))).alias("entry"),
        F.coalesce(F.nullif("session_id", F.lit("")), F.regexp_replace(F.regexp_extract("file_name", r"([^/\\\\]+)$", 1), r"\.jsonl$", "")).alias("session_id"),
    )
    others = [f for f in df.schema if f.name != "message_json"]
    message_types = ("user", "assistant")

    def facts(batches):
        for batch in batches:
            kinds = batch.column("entry_type").to_pylist()
            rows = [_facts(m) if k in message_types else (None,) * len(FACTS) for k, m in zip(kinds, batch.column("message_json").to_pylist())]
            columns = list(zip(*rows)) or [()] * len(FACTS)
            types = [pa.bool_(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in others] + [pa.array(c, t) for c, t in zip(columns, types)], names=[f.name for f in others] + FACTS.names
            )

    df = df.mapInArrow(facts, T.StructType(others + list(FACTS)))
    latest = Window.partitionBy("entry").orderBy(F.desc("received_at"), F.desc("entry_id"))
    return df.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "received_at")


def texts(entries: DataFrame) -> DataFrame:
    """entry_id and text of each message: its string, or the texts of its top-level text blocks in lines; null where it doesn't parse."""

    def read(batches):
        for batch in batches:
            records = map(parsed, batch.column("message_json").to_pylist())
            found = [utf8("\n".join(_texts(r.get("content")))) if isinstance(r, dict) else None for r in records]
            yield pa.RecordBatch.from_arrays([batch.column("entry_id"), pa.array(found, pa.string())], names=["entry_id", "text"])

    schema = T.StructType([entries.schema["entry_id"], T.StructField("text", T.StringType())])
    return entries.where(F.col("entry_type").isin("user", "assistant")).select("entry_id", "message_json").mapInArrow(read, schema)


def positions(once: DataFrame, instead: DataFrame | None = None) -> DataFrame:
    """Messages with their position in the session, by instant, then line_no, then entry; ``instead``: see ``stored``.

    All rows are sorted together by ranges, so a session with a third of them lies in many partitions; positions come
    from the counts of a session in each partition, which are few. A time that can't be read comes first.
    """
    order = ["session_id", "at", "nanos", "line_no", "entry"]
    messages = once.where(F.col("entry_type").isin("user", "assistant"))
    placed = messages.repartitionByRange(*order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()
    placed = stored(placed.withColumns({"_part": F.shiftright(row, 33), "_row": row.bitwiseAND(F.lit((1 << 33) - 1))}), "messages", instead)
    starts = placed.groupBy("session_id", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("session_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    starts = starts.select(F.col("session_id").alias("_s"), F.col("_part").alias("_p"), "_before")
    return (
        placed.join(starts, F.expr("session_id <=> _s and _part = _p"))
        .withColumn("position", F.col("_row") + F.col("_before"))
        .drop("_s", "_p", "_part", "_row", "_before")
    )


def _kind() -> Column:
    """1 for a question (a user's message with text), 2 for a reply (an assistant's with text or a call), else null."""
    question = (F.col("entry_type") == "user") & F.col("has_text")
    reply = (F.col("entry_type") == "assistant") & (F.col("has_text") | F.col("tool_use"))
    return F.when(question, 1).when(reply, 2)


def _seconds(c: Column) -> Column:
    """Seconds since a candidate. They grow with its distance: messages without a time come first in a session."""
    passed = F.greatest((F.unix_micros(F.col("at")) - F.unix_micros(c["at"])) / 1e6, F.lit(0.0))
    return F.when(F.col("at").isNull(), F.lit(0.0)).when(c["at"].isNull(), F.lit(UNKNOWN)).otherwise(passed)


def _time(seconds: Column, distance: Column) -> Column:
    return WEIGHTS["time"] * F.log1p(seconds + STEP * distance)


def _speaker(c: Column) -> Column:
    return WEIGHTS["speaker"] * (F.col("entry_type") != c["entry_type"]).cast("int")


def _far_calls(placed: DataFrame, asking: DataFrame) -> DataFrame:
    """session, position and the best (score and parent) of the calls of ``placed`` that the messages of ``asking`` answer.

    An id is that of the latest earlier call. The calls of an id are cut by position, so that no task holds all of them.
    """
    chunk = F.floor(F.col("position") / F.lit(CHUNK))
    one = lambda df, ids: df.select("session_id", "position", "at", "entry_type", F.explode(F.array_distinct(ids)).alias("id")).withColumn("_chunk", chunk)
    answers = one(asking, "answers")
    # only ids that are asked for: the others are dropped before they move, where Spark finds these few
    calls = one(placed, "calls").join(answers.select(F.col("session_id").alias("_as"), F.col("id").alias("_ai")).distinct(), F.expr("session_id <=> _as and id = _ai"), "left_semi")
    call = F.struct("position", "at", "entry_type")
    ids = ["session_id", "id"]
    both = calls.withColumn("call", call).unionByName(answers, allowMissingColumns=True)
    # of rows of one position the call comes last, so that no message answers itself
    before = Window.partitionBy(*ids, "_chunk").orderBy("position", F.col("call").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    inside = both.withColumn("_in", F.last("call", ignorenulls=True).over(before)).where("call is null")
    ends = calls.groupBy(*ids, "_chunk").agg(F.max(call).alias("_last"))
    carried = ends.select(*[F.col(k).alias(f"_{k}") for k in ids], F.col("_chunk").alias("_c"), "_last").withColumn(
        "_next", F.lead("_c").over(Window.partitionBy("_session_id", "_id").orderBy("_c"))
    )
    # an answer in a chunk without an earlier call of its id takes the last call of the chunks before
    lone = inside.where("_in is null and _chunk > 0").drop("_in")
    later = lone.join(carried, F.expr("session_id <=> _session_id and id = _id and _c < _chunk and (_next is null or _next >= _chunk)")).withColumn("call", F.col("_last"))
    found = inside.where("_in is not null").withColumn("call", F.col("_in")).select("session_id", "position", "at", "entry_type", "call").unionByName(later.select("session_id", "position", "at", "entry_type", "call"))
    c = F.col("call")
    score = F.struct((WEIGHTS["mention"] + _time(_seconds(c), F.col("position") - c["position"]) + _speaker(c)).alias("score"), c["position"].alias("parent"))
    return found.groupBy("session_id", "position").agg(F.max(score).alias("_far"))


#: Columns of a message that links keep, and those that a search hands on.
KEPT = flat("session_id string, position bigint, entry_id bigint, entry_type string, role string, at timestamp, tool_use boolean, tool_result boolean")
SEARCH = flat("kind int, question bigint, replied bigint, begin bigint, score double, parent bigint, seconds double, open boolean, words array<int>, answers array<string>")


class _Piece:
    """Messages of one session in a row, as one task holds them, and how each looks back at those before it."""

    def __init__(self, begin: int):
        self.begin = begin
        self.at, self.type, self.raw, self.sets = [], [], [], []
        self.calls: dict[str, int] = {}
        self.asked = self.replied = None

    def words(self, i: int) -> frozenset:
        if self.sets[i] is None:
            self.sets[i] = frozenset(self.raw[i])
        return self.sets[i]

    def add(self, at: int | None, type_: str, kind: int | None, calls: list, answers: list, words: list) -> tuple:
        """The columns of SEARCH for the next message."""
        here, w = len(self.at), WEIGHTS
        self.at.append(at)
        self.type.append(type_)
        self.raw.append(words)
        self.sets.append(None)

        def plain(i: int) -> tuple[float, float]:
            """Score of a candidate without words, and seconds since."""
            passed = 0.0 if at is None else UNKNOWN if self.at[i] is None else max(0.0, (at - self.at[i]) / 1e6)
            return w["time"] * math.log1p(passed + STEP * (here - i)) + w["speaker"] * (self.type[i] != type_), passed

        best = (-math.inf, -1)
        if kind == 2 and self.asked is not None and (self.replied is None or self.replied < self.asked):
            best = (w["turn"] + plain(self.asked)[0], self.asked)
        missing = []
        for id_ in answers:
            if (i := self.calls.get(id_)) is None:
                missing.append(id_)
            else:
                best = max(best, (w["mention"] + plain(i)[0], i))
        mentioned = {self.calls[id_] for id_ in answers if id_ in self.calls}
        most, seconds, i = w["words"] + w["speaker"], 0.0, here - 1
        while i >= 0:
            base, seconds = plain(i)
            if base + w["words"] > best[0] and i not in mentioned:
                mine, other = self.words(here), self.words(i)
                common = len(mine & other) / max(1, min(len(mine), len(other)))
                best = max(best, (base + w["words"] * common, i))
            if w["time"] * math.log1p(seconds + STEP * (here - i + 1)) + most <= best[0]:
                break
            i -= 1
        history = self.begin > 0  # messages before the first row are with another task
        # a search is open where it has come to the first row, where the call isn't among the rows, and where the question isn't
        open_ = history and (i < 0 or bool(missing) or (kind == 2 and self.asked is None and self.replied is None))
        out = (
            kind, None if self.asked is None else self.begin + self.asked, None if self.replied is None else self.begin + self.replied, self.begin, best[0], self.begin + best[1] if best[1] >= 0 else None,
            seconds, open_, words if open_ else None, missing if open_ else None,
        )
        if kind == 1:
            self.asked = here
        elif kind == 2:
            self.replied = here
        for id_ in calls:
            self.calls[id_] = here
        return out


def _searched(placed: DataFrame) -> DataFrame:
    """KEPT and SEARCH: the best parent among the rows of the same task. placed: sorted by session and position within each file."""
    kept = [f for f in placed.schema if f.name in KEPT.names]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.string())]

    def look(batches):
        piece, session, last = None, None, None
        for batch in batches:
            out = []
            at = batch.column("at").cast(pa.int64()).to_pylist()
            columns = (batch.column(c).to_pylist() for c in ("session_id", "position", "entry_type", "_kind", "calls", "answers", "words"))
            for t, s, p, type_, kind, calls, answers, words in zip(at, *columns):
                if piece is None or s != session or p != last + 1:
                    piece = _Piece(p)
                session, last = s, p
                out.append(piece.add(t, type_, kind, calls or (), answers or (), words or ()))
            columns = list(zip(*out)) or [()] * len(SEARCH)
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept] + [pa.array(c, t) for c, t in zip(columns, types)], names=[f.name for f in kept] + SEARCH.names
            )

    return placed.withColumn("_kind", _kind()).mapInArrow(look, T.StructType(kept + list(SEARCH)))


def _open(reach: int) -> Column:
    """Whether a message further back than ``reach`` before the task's first row could have a better score than the best so far."""
    most = _time(F.col("seconds"), F.col("position") - F.col("begin") + reach + 1) + WEIGHTS["words"] + WEIGHTS["speaker"]
    return (F.col("begin") > reach) & (most > F.col("best.score"))


def links(placed: DataFrame) -> DataFrame:
    """KEPT, ``kind``, ``question`` (position of the last question before a reply), ``parent`` (position of the message replied to,
    null for the start of a tree) and ``score``: the best of all earlier messages.

    placed: those of ``positions``.
    """
    best = F.struct("score", "parent")
    now = stored(_searched(placed), "searched").withColumn("best", best)
    kept = [*KEPT.names, "kind", "question", "best"]
    done, open_ = now.where("not open").select(*kept), now.where("open")
    if not open_.isEmpty():
        # a task's rows go on with one session of another at most: these are as many as there are tasks
        hot = F.broadcast(open_.select(F.col("session_id").alias("_h")).distinct())
        mine = lambda df: df.join(hot, F.expr("session_id <=> _h"), "left_semi")
        rest = stored(mine(placed), "rest")
        # what earlier tasks hold of these sessions: their last question and last reply
        asked = F.struct("position", "at", "entry_type")
        ends = mine(now).groupBy("session_id", "begin").agg(F.max(F.when(F.col("kind") == 1, asked)).alias("_q"), F.max(F.when(F.col("kind") == 2, F.col("position"))).alias("_r"))
        earlier = Window.partitionBy("session_id").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(F.col("session_id").alias("_s"), F.col("begin").alias("_b"), F.last("_q", True).over(earlier).alias("_q"), F.last("_r", True).over(earlier).alias("_r"))
        open_ = open_.join(carried, F.expr("session_id <=> _s and begin = _b"), "left")
        asking = now.where("open and size(answers) > 0")
        if asking.isEmpty():
            open_ = open_.withColumn("_far", F.lit(None).cast("struct<score:double,parent:bigint>"))
        else:
            far = _far_calls(rest, asking).withColumnsRenamed({"session_id": "_fs", "position": "_fp"})
            open_ = open_.join(far, F.expr("session_id <=> _fs and position = _fp"), "left")
        q = F.col("_q")
        turn = (F.col("kind") == 2) & F.col("question").isNull() & F.col("replied").isNull() & q.isNotNull() & (F.coalesce(F.col("_r"), F.lit(-1)) < q["position"])
        drawn = F.when(turn, F.struct((WEIGHTS["turn"] + _time(_seconds(q), F.col("position") - q["position"]) + _speaker(q)).alias("score"), q["position"].alias("parent")))
        # a call among the task's own rows has been counted
        called = F.when(F.size("answers") > 0, F.col("_far"))
        open_ = open_.withColumns({"best": F.greatest("best", drawn, called), "question": F.coalesce("question", q["position"])}).select(*kept, "begin", "seconds", "words")
        reach, furthest = 0, WINDOW
        open_ = stored(open_.withColumn("open", _open(0)), "open")
        done, open_ = done.unionByName(open_.where("not open").select(*kept)), open_.where("open")
        while not open_.isEmpty():
            block = lambda p, size=furthest: F.floor(p / F.lit(size))
            ask = open_.select("session_id", "position", "at", "entry_type", "words", "begin", F.explode(F.sequence(block(F.greatest(F.col("begin") - furthest, F.lit(0))), block(F.col("begin") - reach - 1))).alias("_block"))
            c = rest.select(F.col("session_id").alias("_s"), block(F.col("position")).alias("_b"), F.struct("position", "at", "entry_type", "words").alias("c"))
            pairs = ask.join(c, F.expr(f"session_id <=> _s and _block = _b and c.position >= begin - {furthest} and c.position < begin - {reach}"))
            common = F.size(F.array_intersect("words", "c.words")) / F.greatest(F.least(F.size("words"), F.size("c.words")), F.lit(1))
            c = F.col("c")
            score = F.struct((WEIGHTS["words"] * common + _time(_seconds(c), F.col("position") - c["position"]) + _speaker(c)).alias("score"), c["position"].alias("parent"))
            more = pairs.select(F.col("session_id").alias("_s"), F.col("position").alias("_p"), score.alias("_more"), _seconds(c).alias("_gap")).groupBy("_s", "_p").agg(F.max("_more").alias("_more"), F.max("_gap").alias("_gap"))
            joined = open_.join(more, F.expr("session_id <=> _s and position = _p"), "left").withColumns({"best": F.greatest("best", "_more"), "seconds": F.coalesce("_gap", "seconds")})
            reach, furthest = furthest, furthest * GROWTH
            now = stored(joined.select(*kept, "begin", "seconds", "words").withColumn("open", _open(reach)), "open")
            done, open_ = done.unionByName(now.where("not open").select(*kept)), now.where("open")
    tied = F.coalesce(F.col("kind") != 1, F.lit(True)) | (F.col("best.score") > TIED)
    return done.select(*KEPT.names, "kind", "question", F.when(tied, F.col("best.parent")).alias("parent"), F.when(tied & F.col("best.parent").isNotNull(), F.col("best.score")).alias("score"))


def trees(linked: DataFrame) -> DataFrame:
    """session_id, position, root, depth of every message, by doubling the links until every message has its root.

    Messages that have reached a root leave; each round joins only the others, on the message they point to.
    """
    rows = linked.select("session_id", "position", F.coalesce("parent", "position").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"))
    now = stored(rows.withColumn("ended", F.col("depth") == 0), "links")
    done, open_ = now.where("ended"), now.where("not ended")
    while not open_.isEmpty():
        up = done.unionByName(open_).select(F.col("session_id").alias("_s"), F.col("position").alias("_p"), F.col("root").alias("_r"), F.col("depth").alias("_d"), F.col("ended").alias("_e"))
        moved = open_.join(up, F.expr("session_id <=> _s and root = _p"))
        step = stored(moved.select("session_id", "position", F.col("_r").alias("root"), (F.col("depth") + F.col("_d")).alias("depth"), F.col("_e").alias("ended")), "links")
        done, open_ = done.unionByName(step.where("ended")), step.where("not ended")
    return done.drop("ended")


def _unanswered(linked: DataFrame) -> DataFrame:
    """session_id of sessions with a question to which no reply is linked before the next question."""
    asked = linked.where("kind = 1").select("session_id", "position")
    answered = linked.where("kind = 2 and parent = question").select(F.col("session_id").alias("_s"), F.col("parent").alias("_p"))
    return asked.join(answered, F.expr("session_id <=> _s and position = _p"), "left_anti").select("session_id").distinct()


def session_facts(once: DataFrame) -> DataFrame:
    """One row per session with ``empty`` and ``bad``: whether one of its messages breaks it; see ``reasons``."""
    message = F.col("entry_type").isin("user", "assistant")
    good = F.col("parses") & F.coalesce(F.col("role") == F.col("entry_type"), F.lit(False)) & F.col("at").isNotNull()
    return once.groupBy("session_id").agg(
        (~F.coalesce(F.bool_or(message & (F.col("has_text") | F.col("tool_use") | F.col("tool_result"))), F.lit(False))).alias("empty"),
        F.coalesce(F.bool_or(message & ~good), F.lit(False)).alias("bad"),
    )


def reasons(sessions: DataFrame, linked: DataFrame) -> DataFrame:
    """One row per session with ``empty``, ``broken`` and ``no_reply``; a kept conversation has none of them.

    sessions: those of ``session_facts``. empty: no message has visible text, a tool_use or a tool_result block. broken:
    a message that is missing, doesn't parse or isn't an object, a role that isn't the entry type (or isn't there), a time
    that can't be read, or a first message that isn't a user's. no_reply: see ``_unanswered``. Sessions without messages
    are empty.
    """
    starts = linked.where("position = 0 and entry_type <> 'user'").select(F.col("session_id").alias("_s1"))
    waits = _unanswered(linked).select(F.col("session_id").alias("_s2"))
    return (
        sessions.join(starts, F.expr("session_id <=> _s1"), "left")
        .join(waits, F.expr("session_id <=> _s2"), "left")
        .select("session_id", "empty", (F.col("bad") | F.col("_s1").isNotNull()).alias("broken"), F.col("_s2").isNotNull().alias("no_reply"))
    )


def _linked(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Session facts and links of the entries, both stored."""
    once = stored(entries_once(entries), "entries")
    sessions = stored(session_facts(once), "sessions")
    return sessions, stored(links(positions(once, instead=once)), "linked")


def found(entries: DataFrame) -> DataFrame:
    """session_id of every conversation to drop."""
    return reasons(*_linked(entries)).where("empty or broken or no_reply").select("session_id")


def conversations(entries: DataFrame) -> DataFrame:
    """The kept conversations: one row per message with position, speaker, text, the message it replies to and its tree."""
    sessions, linked = _linked(entries)
    kept = reasons(sessions, linked).where("not (empty or broken or no_reply)").select(F.col("session_id").alias("_k"))
    roots = trees(linked).select(F.col("session_id").alias("_s"), F.col("position").alias("_p"), "root", "depth")
    # texts travel once, for the messages that are kept; a row that is repeated has equal texts
    text = texts(entries).withColumnRenamed("entry_id", "_id")
    text = text.withColumn("_n", F.row_number().over(Window.partitionBy("_id").orderBy("_id"))).where("_n = 1").drop("_n")
    return (
        linked.join(kept, F.expr("session_id <=> _k"), "left_semi")
        .join(roots, F.expr("session_id <=> _s and position = _p"))
        .join(text, F.col("entry_id") == F.col("_id"), "left")
        .select("session_id", "position", "role", "entry_id", "at", "text", "tool_use", "tool_result", "parent", "root", "depth")
    )
