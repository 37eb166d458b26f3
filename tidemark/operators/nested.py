"""Deeply nested JSON records as related flat tables that keep the links between parent and child.

Objects get Merkle identities: an object is written canonically (keys sorted, child objects replaced by their
identities) and hashed, children first. Equal subtrees therefore have one identity and are stored once; every place
where one occurs is kept as a bridge row with its parent, its path and its ordinal. That holds for every object, at any
depth and under any member; nothing here recurses, and numbers are kept as exactly as they are written.
"""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal, InvalidOperation

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.schemas import flat

#: Members whose objects have a kind of their own: (source, kind of the parent) gives member, kind and whether the path names the member.
NAMED = {
    ("message", "record"): ("content", "block", False), ("message", "block"): ("content", "block", False),
    ("data", "record"): ("results", "result", True), ("data", "result"): ("hits", "hit", True),
}
CASES = ("block", "result", "hit")

BRIDGE = flat(
    "source string, block_path string, parent_path string, member string, ordinal int, depth int, kind string, type string, name string,"
    " object_id string, parent_id string, payload string"
)


class Exact:
    """A number that Python's own would round, or wouldn't read: its text, canonical as far as it can be."""

    __slots__ = ("text", "whole")

    def __init__(self, text: str, whole: bool):
        self.text, self.whole = text, whole


def _integer(text: str):
    return int(text) if len(text) <= 4000 else Exact(text, True)


def _fraction(text: str):
    value = float(text)
    short = repr(value)
    if short == text:
        return value
    try:
        exact = Decimal(text)
        if math.isfinite(value) and Decimal(short) == exact:
            return value
        # without the context's rounding, so that no digit is lost
        sign, digits, power = exact.as_tuple()
        plain = "".join(map(str, digits)).lstrip("0")
        kept = plain.rstrip("0") or "0"
        return Exact(f"{'-' * sign}{kept}e{power + len(plain) - len(kept)}", False)
    except (InvalidOperation, OverflowError):
        return Exact(text, False)


def _constant(text: str):
    raise ValueError(text)


_READ = {"parse_constant": _constant, "parse_int": _integer, "parse_float": _fraction}
_DECODER = json.JSONDecoder(**_READ)
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|([^ \t\n\r{}\[\],:"]+))[ \t\n\r]*')


def parsed(text: str | None):
    """The value of a strict JSON text of any depth, None where it doesn't parse."""
    try:
        return _DECODER.decode(text) if text else None
    except RecursionError:
        try:
            return _deep(text)
        except ValueError:
            return None
    except ValueError:
        return None


def _deep(text: str):
    """The value of a strict JSON text, read token by token with a stack of its own; an error where it isn't one."""
    top: list = []
    stack, at, key, state = [top], 0, None, "value"
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(at)
        at = m.end()
        sign, string, scalar = m.groups()
        within = stack[-1]
        if sign in ("}", "]"):
            if len(stack) == 1 or isinstance(within, dict) != (sign == "}") or state not in ("next", "first"):
                raise ValueError(at)
            stack.pop()
            state = "next"
        elif sign == ",":
            if state != "next" or len(stack) == 1:
                raise ValueError(at)
            state = "key" if isinstance(within, dict) else "value"
        elif sign == ":":
            if state != "colon":
                raise ValueError(at)
            state = "value"
        elif isinstance(within, dict) and state in ("key", "first"):
            if not string:
                raise ValueError(at)
            key, state = json.loads(string), "colon"
        elif state == "value" or (state == "first" and isinstance(within, list)):
            value = {} if sign == "{" else [] if sign == "[" else json.loads(string or scalar, **_READ)
            if isinstance(within, dict):
                within[key] = value
            else:
                within.append(value)
            state = "next"
            if sign:
                stack.append(value)
                state = "first"
        else:
            raise ValueError(at)
    if len(stack) != 1 or state != "next" or len(top) != 1:
        raise ValueError(at)
    return top[0]


def _label(member: str) -> str:
    """A member's name in a path; quoted where it could be taken for a position or several names."""
    return member if member.isidentifier() else json.dumps(member, ensure_ascii=False)


def _objects(value) -> list[tuple[tuple[int, ...], dict]]:
    """Objects in the value of a member with their positions, none for a lone object; arrays in arrays give several positions."""
    if isinstance(value, dict):
        return [((), value)]
    if not isinstance(value, list):
        return []
    out, todo = [], [((), value)]
    while todo:
        place, array = todo.pop()
        for i, x in enumerate(array):
            if isinstance(x, dict):
                out.append(((*place, i), x))
            elif isinstance(x, list):
                todo.append(((*place, i), x))
    return out


class _Node:
    __slots__ = ("value", "kind", "path", "parent", "member", "ordinal", "depth")

    def __init__(self, value, kind, path, parent, member, ordinal, depth):
        self.value, self.kind, self.path, self.parent, self.member, self.ordinal, self.depth = value, kind, path, parent, member, ordinal, depth


def _nodes(record: dict, source: str, every: bool) -> list[_Node]:
    """All objects of a record, parents before their children; without ``every`` only those of a kind of their own."""
    nodes = [_Node(record, "record", "", -1, None, 0, 0)]
    for at, node in enumerate(nodes):  # grows while it runs
        member, kind, shown = NAMED.get((source, node.kind), (None, None, None))
        prefix = f"{node.path}." if node.path else ""
        for name in node.value if every else (member,) if member in node.value else ():
            value = node.value[name]
            if type(value) is not dict and type(value) is not list:
                continue
            for place, child in _objects(value):
                ordinal = place[-1] if place else 0
                if name == member and len(place) < 2:
                    nodes.append(_Node(child, kind, f"{prefix}{member}.{ordinal}" if shown else f"{prefix}{ordinal}", at, name, ordinal, node.depth + 1))
                elif every:
                    nodes.append(_Node(child, "object", prefix + ".".join((_label(name), *map(str, place))), at, name, ordinal, node.depth + 1))
    return nodes


def _number(value: Exact) -> dict:
    return {"$number": value.text}


_ENCODER = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=_number)


def _canonical(value: dict, ids: dict[int, str]) -> str:
    """Canonical text of an object whose child objects have identities."""
    own = {}
    for k, v in value.items():
        if type(v) is dict:
            v = {"$id": ids[id(v)]}
        elif type(v) is list and any(type(x) is dict or type(x) is list for x in v):
            v = [{"$id": ids[id(x)]} if type(x) is dict else x for x in v]
            if any(type(x) is list for x in v):
                # an array in an array stands as its text, so that arrays of any depth need no recursion
                v = [{"$array": _array(x, ids)} if type(x) is list else x for x in v]
        own[k] = v
    return _ENCODER.encode(own).encode("utf-8", "backslashreplace").decode()


def _array(value: list, ids: dict[int, str]) -> str:
    """Text of an array, inner arrays first."""
    order, texts = [value], {}
    for array in order:  # grows while it runs
        order.extend(x for x in array if type(x) is list)
    for array in reversed(order):
        texts[id(array)] = "[" + ",".join(texts.pop(id(x)) if type(x) is list else f'{{"$id":"{ids[id(x)]}"}}' if type(x) is dict else _ENCODER.encode(x) for x in array) + "]"
    return texts[id(value)]


def _identities(nodes: list[_Node]) -> tuple[list[str], list[str]]:
    """Identity and canonical text of each object. Children stand behind their parents, so the list is read backwards."""
    ids, texts, known = [""] * len(nodes), [""] * len(nodes), {}
    for at in range(len(nodes) - 1, -1, -1):
        texts[at] = _canonical(nodes[at].value, known)
        ids[at] = known[id(nodes[at].value)] = xxhash.xxh3_128_hexdigest(texts[at].encode())
    return ids, texts


def occurrences(
    entries: DataFrame, sources: dict[str, str] | None = None, keep: tuple[str, ...] = ("entry_id",), payload: bool = True, roots: bool = False, every: bool = True
) -> DataFrame:
    """One bridge row per object nested in the JSON columns of ``entries``, with the columns ``keep`` of its record.

    sources: column by source, by default message_json and data_json. Null and unparsable texts, texts that hold no
    object and empty tables give no rows; repeated records give their rows again. ``roots`` adds the record itself
    with an empty path. ``payload`` holds the canonical text, else null. ``every`` False leaves out objects of kind
    ``object``, and with them the identities, which are those of whole subtrees. Member names that clash with bridge
    columns don't matter, since members stay inside the payload; columns to keep must not be named like bridge columns.

    block_path: positions of blocks in ``content``, ``results.i`` and ``results.i.hits.j``; other objects are told by
    the names of their members, and by positions in arrays. A lone object in place of an array has position 0.
    """
    sources = sources or {"message": "message_json", "data": "data_json"}
    columns = list(dict.fromkeys([*keep, *sources.values()]))
    df = entries.select(*columns)
    kept = [df.schema[k] for k in keep]
    types = [pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string() for f in BRIDGE]

    def walk(batches):
        for batch in batches:
            texts = {s: batch.column(c).to_pylist() for s, c in sources.items()}
            row, out = [], []
            for i in range(batch.num_rows):
                for source, values in texts.items():
                    record = parsed(values[i])
                    if not isinstance(record, dict):
                        continue
                    nodes = _nodes(record, source, every)
                    if len(nodes) == 1 and not roots:
                        continue
                    ids, canonical = _identities(nodes) if every else ([None] * len(nodes),) * 2
                    for at in range(0 if roots else 1, len(nodes)):
                        n = nodes[at]
                        label, name = n.value.get("type"), n.value.get("name")
                        row.append(i)
                        out.append((
                            source, utf8(n.path), utf8(nodes[n.parent].path) if n.parent >= 0 else None, utf8(n.member), n.ordinal, n.depth, n.kind,
                            utf8(label) if isinstance(label, str) else None, utf8(name) if isinstance(name, str) else None,
                            ids[at], ids[n.parent] if n.parent >= 0 else None, canonical[at] if payload else None,
                        ))
            index = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name).take(index) for f in kept] + [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(types), types)],
                names=[f.name for f in kept] + BRIDGE.names,
            )

    return df.mapInArrow(walk, T.StructType(kept + list(BRIDGE)))


def utf8(text: str | None) -> str | None:
    """Text with lone surrogates, which Arrow can't hold, as escapes."""
    return text if text is None or text.isascii() else text.encode("utf-8", "backslashreplace").decode()


_COUNTED = flat("object_id string, kind string, type string, name string, payload string, n bigint")


def objects(bridge: DataFrame) -> DataFrame:
    """Each distinct object once, with the number of places where it stands.

    Equal identities have equal payloads, so any one of them is kept: the rows of a batch are counted per identity
    before payloads are sorted or moved, which also spreads the most frequent object.
    """

    def count(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("object_id").dictionary_encode().indices.to_numpy()
            kinds = np.array(batch.column("kind").to_pylist(), dtype="U8")
            # the first row of an identity has its smallest kind
            order = np.lexsort((kinds, codes))
            _, first, n = np.unique(codes[order], return_index=True, return_counts=True)
            taken = batch.take(pa.array(order[first]))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(n.astype(np.int64))], names=_COUNTED.names)

    counted = bridge.select(*_COUNTED.names[:-1]).mapInArrow(count, _COUNTED)
    return counted.groupBy("object_id").agg(
        F.min("kind").alias("kind"), F.min("type").alias("type"), F.min("name").alias("name"),
        F.min("payload").alias("payload"), F.sum("n").alias("occurrences"),
    )


def messages(entries: DataFrame) -> DataFrame:
    """The flat part of each message: role, model and token counts, null where a part is missing or isn't a whole number from 0."""
    usage = "input_tokens string, output_tokens string, cache_creation_input_tokens string, cache_read_input_tokens string"
    df = entries.select("entry_id", "session_id", "entry_type", F.from_json("message_json", f"role string, model string, usage struct<{usage}>").alias("m"))
    count = lambda c: F.when(F.col(f"m.usage.{c}").rlike(r"^\d+$"), F.col(f"m.usage.{c}").try_cast("bigint")).alias(c)
    return df.select("entry_id", "session_id", "entry_type", "m.role", "m.model", *[count(c.split()[0]) for c in usage.split(", ")])


def data(entries: DataFrame) -> DataFrame:
    """The flat part of each data object: type and query as JSON strings give them, other values as their JSON text.

    One row for every entry whose data_json is a strict JSON object, also without results; null where a member is
    missing or null. object_id is the record's identity, which its results name as parent_id.
    """
    records = occurrences(entries, {"data": "data_json"}, ("entry_id", "session_id", "entry_type", "data_json"), payload=False, roots=True).where("depth = 0")
    return records.select("entry_id", "session_id", "entry_type", "object_id", *[F.get_json_object("data_json", f"$.{c}").alias(c) for c in ("type", "query")])


def found(entries: DataFrame) -> DataFrame:
    """entry_id and block_path of every nested object that is a block, a result or a hit."""
    return occurrences(entries, payload=False).where(F.col("kind").isin(*CASES)).select("entry_id", "block_path")
