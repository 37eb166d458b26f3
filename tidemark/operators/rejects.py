"""Lines that fail to parse, set apart with a reason, beside the typed rows of all others.

Each schema gives an anchored regular expression for a whole row: for separated files the typed pattern of each column
of the header, joined by the separator; for JSON lines the grammar of one strict object with the members that must be
there and what they may hold. A row that matches is loaded. A row that doesn't runs through the prefixes of its
pattern, one field longer each, and the first that fails tells the reason and the broken field: prefixes of any fields
tell where a row can't be split and whether there are as many fields as columns, prefixes of typed fields which value is
wrong. Patterns are compiled once per schema and worker, however many files share it. Their loops are possessive, so long
texts need no backtracking.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.instants import instant
from tidemark.functions.schemas import flat
from tidemark.operators.nested import utf8

#: A day that exists, with leap years, and RFC 3339 time and offset.
_LEAP = r"(?:[0-9][0-9](?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
_DAY = r"(?:[0-9]{4}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))|" + _LEAP + "-02-29)"
TIME = _DAY + r"[Tt](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]++)?(?:[Zz]|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])"
#: What a column may hold, by its name; other columns may hold anything.
TYPES = "(?:user|assistant|system|progress)"
VALUES = {"logged_at": TIME, "entry_type": TYPES, "output_tokens": r"[0-9]*+"}
SEPARATORS = {"csv": ",", "tsv": "\t"}
COLUMNS = ("session_id", "logged_at", "entry_type", "role", "output_tokens", "text")
_VERDICT = flat("reason string, field string, " + ", ".join(f"{c} string" for c in COLUMNS))

_NOTHING = dict.fromkeys(COLUMNS)


class Separated:
    """The patterns of one header."""

    def __init__(self, sep: str, header: str | None):
        sign = re.escape(sep)
        cell = rf'(?:"[^"]*+(?:""[^"]*+)*+"|[^"{sign}\r\n]*+)'
        self.cell = re.compile(f"({cell})(?:{sign}|\\Z)")
        self.leading = re.compile(f"(?:{cell}{sign})*+")
        self.shape = re.compile(f"{cell}(?:{sign}{cell})*+")
        self.sep, self.names = sep, None
        if header is not None:
            header = header.rstrip("\r")
            cells = self.split(header) if self.shape.fullmatch(header) else header.split(sep)
            self.names = [_unquoted(c).strip(' "') for c in cells]
        typed = lambda n, i: f'(?P<q{i}>"?){VALUES[n]}(?P=q{i})' if n in VALUES else cell
        names = self.names or []
        self.row = re.compile(sign.join(f"(?P<c{i}>{typed(n, i)})" for i, n in enumerate(names))) if names else None
        self.groups = [f"c{i}" for i in range(len(names))]
        # a prefix is the one before it and a pattern of one more field, which all schemas share
        self.steps = [_step(typed(n, 0), sign) for n in names]
        self.places = {c: self.names.index(c) for c in COLUMNS if c in (self.names or [])}

    def split(self, raw: str) -> list[str]:
        """Cells of a row that has the shape of one."""
        cells, at = [], 0
        while True:
            m = self.cell.match(raw, at)
            cells.append(m.group(1))
            at = m.end()
            if m.end(1) == len(raw):
                return cells

    def verdict(self, raw: str | None) -> tuple[str | None, str | None, dict]:
        m = self.row.fullmatch(raw) if raw is not None and self.row else None
        if m:
            cells = [m.group(g) for g in self.groups]
            return None, None, {c: _unquoted(cells[i]) for c, i in self.places.items()}
        return *self.broken(raw), _NOTHING

    def broken(self, raw: str | None) -> tuple[str, str | None]:
        """Reason and first broken field of a row that doesn't match."""
        names = self.names or []
        if raw is None:
            return "syntax", None
        if not self.shape.fullmatch(raw):
            whole = len(self.split_leading(raw))
            return "syntax", names[whole] if whole < len(names) else None
        width = len(self.split(raw))
        if width != len(names):
            return "columns", names[width] if width < len(names) else None
        at = 0
        for name, step in zip(names, self.steps):
            m = step.match(raw, at)
            if not m:
                return "value", name
            at = m.end()
        raise AssertionError("a row of which every prefix matches is one that matches")

    def split_leading(self, raw: str) -> list[str]:
        """Cells before the one at which a row can't be split."""
        head = self.leading.match(raw).group()
        return self.split(head[: -len(self.sep)]) if head else []


@lru_cache(maxsize=64)
def _step(field: str, sign: str) -> re.Pattern:
    return re.compile(f"{field}(?:{sign}|\\Z)")


def _unquoted(cell: str) -> str:
    return cell[1:-1].replace('""', '"') if cell[:1] == '"' else cell


_BLANK = r"[ \t\n\r]*+"
_STRING = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})[^"\\\x00-\x1f]*+)*+"'
_NUMBER = r"-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+"


def _value(depth: int) -> str:
    """Any value down to a depth."""
    scalar = f"{_STRING}|{_NUMBER}|true|false|null"
    if not depth:
        return f"(?:{scalar})"
    return rf"(?:{scalar}|{_members([], depth)}|\[{_BLANK}(?:{_value(depth - 1)}{_BLANK}(?:,{_BLANK}(?!\])|(?=\])))*+\])"


def _members(known: list[tuple[str, str, str]], depth: int) -> str:
    """An object whose known members (name, group, pattern of the value) stand in any order among others."""
    named = "".join(f'"{name}"{_BLANK}:{_BLANK}(?P<{group}>{value})|' for name, group, value in known)
    others = f'(?!"(?:{"|".join(name for name, *_ in known)})"{_BLANK}:)' if known else ""
    return rf"\{{{_BLANK}(?:(?:{named}{others}{_STRING}{_BLANK}:{_BLANK}{_value(depth - 1)}){_BLANK}(?:,{_BLANK}(?!\}})|(?=\}})))*+\}}"


_TEXT = _members([("text", "text", _value(1))], 2)
_MESSAGE = _members([("role", "role", _value(1)), ("content", "content", rf"\[{_BLANK}{_TEXT}(?:{_BLANK},{_BLANK}{_value(1)})*+{_BLANK}\]")], 2)
#: A whole JSON line as nearly all are written, in one pass: its members, with values that are right, not too deep below.
_LINE = _BLANK + _members([
    ("session_id", "session_id", _value(1)), ("logged_at", "logged_at", f'"{TIME}"'), ("entry_type", "entry_type", f'"{TYPES}"'),
    ("output_tokens", "output_tokens", r'(?:null|"[0-9]*+"|[0-9]++(?![.eE]))'), ("message", "message", _MESSAGE),
], 2) + _BLANK
#: Names of members that count; a line in which one stands twice goes through the prefixes, of which the first counts.
_NAMED = re.compile(rf'"(session_id|logged_at|entry_type|output_tokens|message|role|content|text)"{_BLANK}:')
#: The grammar of strict JSON at any depth: s text, n number, v any value, o object, a array, w blanks.
_GRAMMAR = (
    rf"(?(DEFINE)(?<w>{_BLANK})(?<s>{_STRING})(?<n>{_NUMBER})"
    r"(?<v>(?&s)|(?&n)|true|false|null|(?&o)|(?&a))(?<o>\{(?&w)(?:(?&s)(?&w):(?&w)(?&v)(?&w)(?:,(?&w)(?!\})|(?=\})))*+\})(?<a>\[(?&w)(?:(?&v)(?&w)(?:,(?&w)(?!\])|(?=\])))*+\]))"
)


def _member(key: str, value: str) -> str:
    """An object up to the first member of a key, with its value."""
    name = f'"{key}"(?&w):(?&w)'
    return rf"\{{(?&w)(?:(?!{name})(?&s)(?&w):(?&w)(?&v)(?&w),(?&w))*+{name}{value}"


_ESCAPED = regex.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"')
#: Where each column stands in a JSON line; the first element of content counts.
_PLACES = {
    "session_id": lambda v: _member("session_id", v), "logged_at": lambda v: _member("logged_at", v), "entry_type": lambda v: _member("entry_type", v),
    "output_tokens": lambda v: _member("output_tokens", v), "role": lambda v: _member("message", _member("role", v)),
    "text": lambda v: _member("message", _member("content", r"\[(?&w)" + _member("text", v))),
}
#: Members that must be there, by the names under which they are reported, and members of which the value counts.
REQUIRED = {"session_id": "session_id", "logged_at": "logged_at", "entry_type": "entry_type", "role": "message.role", "text": "message.content[0].text"}
_TYPED = {"logged_at": f'"{TIME}"', "entry_type": f'"{TYPES}"', "output_tokens": r'(?:null|"[0-9]*+"|[0-9]++)(?&w)[,}]'}


class Json:
    """The patterns of JSON lines. Members may stand in any order, so a prefix asks for one more of them, wherever it stands."""

    def __init__(self):
        start = _GRAMMAR + r"(?&w)"
        there = {c: f"(?={_PLACES[c]('(?&v)')})" for c in REQUIRED}
        tokens = f"(?!{_PLACES['output_tokens']('')})"
        good = {c: f"(?={_PLACES[c](v)})" if c != "output_tokens" else f"(?:{tokens}|(?={_PLACES[c](v)}))" for c, v in _TYPED.items()}
        self.line = re.compile(_LINE)
        self.object = regex.compile(start + r"(?&o)(?&w)")
        self.there = {c: regex.compile(start + p) for c, p in there.items()}
        self.good = {c: regex.compile(start + p) for c, p in good.items()}
        self.values = {c: regex.compile(start + p("(?<found>(?&v))")) for c, p in _PLACES.items()}

    def verdict(self, raw: str | None) -> tuple[str | None, str | None, dict]:
        if raw is None:
            return "syntax", None, _NOTHING
        m = self.line.fullmatch(raw)
        if m and all(m.group(c) is not None for c in REQUIRED) and len(told := _NAMED.findall(raw)) == len(set(told)):
            return None, None, {c: _json_text(found) if (found := m.group(c)) else None for c in COLUMNS}
        reason, field = self.broken(raw)
        if reason and reason != "syntax" and "\\" in raw:
            # names and values may be written with escapes: such a row is written without them and tested again
            raw = _ESCAPED.sub(lambda m: json.dumps(json.loads(m.group()), ensure_ascii=False), raw)
            reason, field = self.broken(raw)
        if reason:
            return reason, field, _NOTHING
        # right, but deeper or with repeated members
        return None, None, {c: _json_text(m.group("found")) if (m := p.match(raw)) else None for c, p in self.values.items()}

    def broken(self, raw: str) -> tuple[str | None, str | None]:
        """Reason and first broken field; none where every prefix matches."""
        if not self.object.fullmatch(raw):
            return "syntax", None
        for c, p in self.there.items():
            if not p.match(raw):
                return "columns", REQUIRED[c]
        for c, p in self.good.items():
            if not p.match(raw):
                return "value", c
        return None, None


def _json_text(value: str) -> str | None:
    """The text of a JSON text, other values as they are written, None for null."""
    if value[:1] == '"':
        return utf8(json.loads(value)) if "\\" in value else value[1:-1]
    return None if value == "null" else value


@lru_cache(maxsize=4096)
def _schema(form: str | None, header: str | None) -> Separated | Json | None:
    if form in SEPARATORS:
        return Separated(SEPARATORS[form], header)
    return Json() if form == "jsonl" else None


def parse(lines: DataFrame) -> DataFrame:
    """One row per line that isn't a header, with ``reason`` (null, syntax, columns or value), ``field`` and typed values.

    lines: line_id, file_name, file_format (csv, tsv, jsonl), line_no, raw; other columns are ignored. A null raw or an
    unknown format is a fault of syntax, an empty line one of columns (csv, tsv) or syntax (jsonl), a line of a file
    without header one of columns. ``field`` is the first broken field: where a row can't be split, the column that it
    breaks off in; of a row that is too short, the first column that isn't there; null where no column is to blame.
    Values are null in faulty rows. Of a column or member that stands twice the first counts. Repeated lines give
    repeated rows.
    """
    df = lines.select("line_id", "file_name", F.lower("file_format").alias("file_format"), "line_no", "raw")
    header = F.coalesce(F.col("file_format").isin(*SEPARATORS), F.lit(False)) & F.coalesce(F.col("line_no") == 1, F.lit(False))
    headers = df.where(header).groupBy(F.col("file_name").alias("_file")).agg(F.min_by("raw", "line_id").alias("header"))
    # one header per file: Spark broadcasts them while they are small and splits large files if it shuffles
    body = df.where(~header).join(headers, F.col("file_name") == F.col("_file"), "left").drop("_file")
    kept = [body.schema[c] for c in ("line_id", "file_name", "line_no")]

    def judge(batches):
        for batch in batches:
            out = []
            for form, head, raw in zip(*(batch.column(c).to_pylist() for c in ("file_format", "header", "raw"))):
                schema = _schema(form, head if form in SEPARATORS else None)
                reason, field, values = schema.verdict(raw) if schema else ("syntax", None, _NOTHING)
                out.append((reason, field, *(values.get(c) for c in COLUMNS)))
            columns = list(zip(*out)) or [()] * len(_VERDICT)
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept] + [pa.array(c, pa.string()) for c in columns], names=[f.name for f in kept] + _VERDICT.names
            )

    judged = body.mapInArrow(judge, T.StructType(kept + list(_VERDICT)))
    return judged.select(
        "line_id", "file_name", "line_no", "reason", "field", "session_id", instant(F.col("logged_at")).alias("logged_at"), "entry_type",
        F.nullif("role", F.lit("")).alias("role"), F.col("output_tokens").try_cast("bigint").alias("output_tokens"), "text",
    )


def found(lines: DataFrame) -> DataFrame:
    """line_id and reason of every faulty line."""
    return fields(lines).select("line_id", "reason")


def fields(lines: DataFrame) -> DataFrame:
    """line_id, reason and first broken field of every faulty line."""
    return parse(lines).where("reason is not null").select("line_id", "reason", "field")


def loaded(lines: DataFrame) -> DataFrame:
    """The typed rows of all other lines."""
    return parse(lines).where("reason is null").drop("reason", "field")
