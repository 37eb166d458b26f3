"""Ids of whole texts under public byte-level BPE tokenizers, without regular expressions.

Text is cut into pieces by an automaton over classes of code points, all texts of a batch at once. A code point's class
tells its transition function, from the kind of piece that is open before it to the kind that is open after it. Such
functions compose associatively, so the states before all code points come from a scan: the functions of each block are
composed side by side, the blocks' functions in a tree, and then each block runs from the state that it is entered in. The
functions that can come up are few, so each has a number and composing two is a look into a table. A
piece begins where a transition says so. The pieces are merged by rank, each distinct piece once per worker while the
cache holds it, and their offsets can be kept: ``decode`` puts every piece back where it stood.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the tokenizer files lie; a parameter of every function that needs one.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k"
#: Bytes of pieces and ids that a worker keeps; the cache starts anew when it is full.
CACHE = 64 << 20
#: Code points of a block of the scan.
BLOCK = 64
_CHUNK = 2 << 20
#: Longer texts are encoded in stretches of about so many code points, cut where pieces can't reach across.
LONG = 4 << 20
_LETTER, _NUMBER, _BLANK, _OTHER, _EDGE = range(5)
#: The code points of Unicode's property White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point; the one past the last is the edge between texts."""
    out = np.full(0x110001, _OTHER, np.uint8)
    category = unicodedata.category
    kinds = {"L": _LETTER, "N": _NUMBER}
    for c in range(0x110000):
        if (k := kinds.get(category(chr(c))[0])) is not None:
            out[c] = k
    out[WHITE] = _BLANK
    out[0x110000] = _EDGE
    return out


#: Symbols of the automaton: letter, number, other sign, apostrophe before one or two letters of a contraction, blank before
#: another blank or the end, last blank of a run (a space joins what follows, another blank stands alone), edge of a text.
_L, _N, _O, _ONE, _TWO, _B, _JOIN, _ALONE, _END = range(9)
#: States: no piece open, a run of letters, numbers, signs or blanks, a space that joins, a contraction with one or two letters to come.
_CLOSED, _LETTERS, _NUMBERS, _SIGNS, _BLANKS, _SPACE, _LAST, _BOTH = range(8)
_STATES = 8


@lru_cache(maxsize=1)
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """The state after each symbol and state, and whether a piece begins at the symbol."""
    after = np.zeros((9, _STATES), np.uint8)
    begins = np.ones((9, _STATES), bool)
    for symbol, run in ((_L, _LETTERS), (_N, _NUMBERS), (_O, _SIGNS), (_ONE, _SIGNS), (_TWO, _SIGNS)):
        after[symbol] = run
        begins[symbol, [run, _SPACE]] = False
    # an apostrophe that begins a piece takes the letters of its contraction
    fresh = [_CLOSED, _LETTERS, _NUMBERS, _BLANKS]
    after[_ONE, fresh], after[_TWO, fresh] = _LAST, _BOTH
    after[_L, _LAST], after[_L, _BOTH] = _CLOSED, _LAST
    begins[_L, [_LAST, _BOTH]] = False
    after[_B], after[_JOIN], after[_ALONE], after[_END] = _BLANKS, _SPACE, _CLOSED, _CLOSED
    begins[_B, _BLANKS] = False
    return after.ravel(), begins.ravel()


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transition functions that symbols generate: number of each symbol's, number of two composed (first, then second), state after each from each."""
    after, _ = _automaton()
    symbols = [tuple(after[s * _STATES : (s + 1) * _STATES].tolist()) for s in range(9)]
    found = {f: i for i, f in enumerate(dict.fromkeys(symbols))}
    every = list(found)
    for f in every:  # grows while it runs
        for g in symbols:
            both = tuple(g[x] for x in f)
            if both not in found:
                found[both] = len(every)
                every.append(both)
    composed = np.array([[found[tuple(g[x] for x in f)] for g in every] for f in every], np.uint8)
    return np.array([found[f] for f in symbols], np.uint8), composed, np.array(every, np.uint8)


def _symbols(code: np.ndarray) -> np.ndarray:
    """Symbols of code points with an edge behind every text."""
    kind = _classes()[code]
    next_kind = np.append(kind[1:], _EDGE).astype(np.uint8)
    out = np.array([_L, _N, _B, _O, _END], np.uint8)[kind]
    last = np.flatnonzero((kind == _BLANK) & (next_kind != _BLANK) & (next_kind != _EDGE))
    out[last] = np.where(code[last] == 32, _JOIN, _ALONE)
    mark = np.flatnonzero((code == 39) & (next_kind == _LETTER))
    if len(mark):
        first, second = code[mark + 1], code[np.minimum(mark + 2, len(code) - 1)]
        one = np.isin(first, [115, 116, 109, 100])
        two = ((first == 114) & (second == 101)) | ((first == 118) & (second == 101)) | ((first == 108) & (second == 108))
        out[mark[one]], out[mark[two]] = _ONE, _TWO
    return out


def _scan(symbols: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each symbol."""
    after, begins = _automaton()
    of_symbol, composed, states = _functions()
    step_table, size = np.ascontiguousarray(composed[:, of_symbol]).ravel(), len(composed)
    n = len(symbols)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, _END, np.uint8)
    grid[:n] = symbols
    # blocks stand side by side, so that one step takes a symbol of each
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    f = of_symbol[grid[0]]
    for step in grid[1:]:
        f = step_table.take(f.astype(np.uint16) * np.uint16(9) + step)
    table, reach = composed.ravel(), 1
    while reach < rows:  # a tree: each block's function takes in those of twice as many blocks before it
        joined = f.copy()
        joined[reach:] = table.take(f[:-reach].astype(np.uint32) * np.uint32(size) + f[reach:])
        f, reach = joined, reach * 2
    state = np.concatenate(([_CLOSED], states[f[:-1], _CLOSED])).astype(np.uint8)
    out = np.empty((BLOCK, rows), bool)
    for i, step in enumerate(grid):
        at = step * np.uint8(_STATES) + state
        out[i], state = begins.take(at), after.take(at)
    return out.T.ravel()[:n]


def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (code points, counted over all texts together) of all pieces, and the number of pieces of each text."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    edges = np.cumsum(lengths + 1) - 1  # an edge behind each text
    n = int(edges[-1]) + 1
    code = np.full(n, 0x110000, np.uint32)
    inside = np.ones(n, bool)
    inside[edges] = False
    code[inside] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = _scan(_symbols(code))
    begin = np.flatnonzero(start & inside)
    # a piece lasts to the next start or edge
    stop = np.flatnonzero(start | ~inside)
    end = stop[np.searchsorted(stop, begin, side="right")]
    owner = np.searchsorted(edges, begin)
    counts = np.bincount(owner, minlength=len(texts))
    return begin - owner, end - owner, counts


_WHITE = frozenset(map(chr, WHITE))


def stretches(text: str, size: int | None = None) -> list[str]:
    """A text in stretches: each but the first begins with a space after something visible, where a piece always begins."""
    size = size or LONG
    out, low = [], 0
    while len(text) - low > size:
        cut = text.find(" ", low + size)
        while cut > 0 and text[cut - 1] in _WHITE:
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        out.append(text[low:cut])
        low = cut
    return [*out, text[low:]]


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one piece: neighbours are merged, the pair of lowest rank and then leftmost first."""
    whole = rank.get(piece)
    if whole is not None:
        return [whole]
    part = [piece[i : i + 1] for i in range(len(piece))]
    after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
    heap = [(r, i, 2) for i in range(len(part) - 1) if (r := rank.get(part[i] + part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if part[i] else len(part)
        if j >= len(part) or len(part[i]) + len(part[j]) != size or part[i] + part[j] not in rank or rank[part[i] + part[j]] != _:
            continue  # one of the two has been merged since
        part[i], part[j] = part[i] + part[j], b""
        after[i] = after[j]
        if after[j] < len(part):
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < len(part) and (r := rank.get(part[left] + part[right])) is not None:
                heapq.heappush(heap, (r, left, len(part[left]) + len(part[right])))
    return [rank[p] for p in part if p]


class Encoder:
    """Ids of batches of texts under one rank file, with a cache of pieces."""

    def __init__(self, path: str):
        self.rank = ranks(path)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.n_ids = np.empty(1 << 16, np.int32), 0
        self.first, self.size = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.held = 0

    def _learn(self, piece: str) -> int:
        raw = piece.encode("utf-8", "surrogatepass")
        found = merged(raw, self.rank)
        at, low, high = len(self.known), self.n_ids, self.n_ids + len(found)
        if high > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty(max(len(self.ids), len(found)), np.int32)))
        if at == len(self.first):
            self.first, self.size = (np.concatenate((x, np.empty_like(x))) for x in (self.first, self.size))
        self.ids[low:high], self.first[at], self.size[at] = found, low, len(found)
        self.known[piece], self.n_ids = at, high
        self.held += len(raw) + 4 * len(found) + 100
        return at

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        return self.encode_pieces(texts)[:2]

    def encode_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and their number per text, as ``encode`` gives them; the offset in its text and the number of ids of each piece, and the pieces per text."""
        if not any(len(t) > LONG for t in texts):
            return self._encode(texts)
        none = np.zeros(0, np.int64)
        ids, starts, sizes, counts, n = [none.astype(np.int32)], [none], [none], [], []
        for t in texts:
            at, total, held = 0, 0, 0
            for x in stretches(t):
                found, _, begin, size, _ = self._encode([x])
                ids.append(found)
                starts.append(begin + at)
                sizes.append(size)
                at, total, held = at + len(x), total + len(found), held + len(begin)
            counts.append(total)
            n.append(held)
        return np.concatenate(ids), np.array(counts, np.int64), np.concatenate(starts), np.concatenate(sizes), np.array(n, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        begin, end, counts = pieces(texts)
        if self.held > CACHE:
            self.clear()
        whole, get, learn = "".join(texts), self.known.get, self._learn
        cut = [whole[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        at = np.array([k if (k := get(p)) is not None else learn(p) for p in cut], np.int64)
        n = self.size[at]
        total = np.concatenate(([0], np.cumsum(n)))
        place = np.repeat(self.first[at] - total[:-1], n) + np.arange(int(total[-1]))
        bounds = np.concatenate(([0], np.cumsum(counts)))
        before = np.cumsum([0, *map(len, texts)])[:-1]
        return self.ids[place], total[bounds[1:]] - total[bounds[:-1]], begin - np.repeat(before, counts), n, counts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)


def parts(texts: list, size: int = _CHUNK):
    """Slices of a list of texts that hold about ``size`` code points; a longer text is a slice of its own."""
    low = 0
    while low < len(texts):
        high, total = low, 0
        while high < len(texts) and (high == low or total + len(texts[high]) <= size):
            total += len(texts[high])
            high += 1
        yield low, high
        low = high


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(
    documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), offsets: bool = False, tokenizer: str = BYTE_BPE, folder: str = TOKENIZERS
) -> DataFrame:
    """``keep`` and ``ids``: the ids of the whole text, without special tokens.

    ``offsets`` adds ``starts``, the code point at which each piece of the text begins, and ``sizes``, its number of ids.
    Null and empty texts have the ids []. Strings that look like special tokens are ordinary text. No text is cut or
    dropped, however long; equal texts have equal ids in every row. Other columns don't matter.
    """
    df = documents.select(*dict.fromkeys([*keep, text]))
    kept = [df.schema[k] for k in keep]
    path = f"{folder}/{tokenizer}.tiktoken"
    made = ("ids", "starts", "sizes") if offsets else ("ids",)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(text).to_pylist()]
            for low, high in parts(texts):
                ids, counts, starts, sizes, n = enc.encode_pieces(texts[low:high])
                more = [_lists(starts, n), _lists(sizes, n)] if offsets else []
                yield pa.RecordBatch.from_arrays(
                    [batch.column(f.name).slice(low, high - low) for f in kept] + [_lists(ids, counts), *more], names=[f.name for f in kept] + list(made)
                )

    return df.mapInArrow(run, T.StructType(kept + [T.StructField(m, T.ArrayType(T.IntegerType())) for m in made]))


def _placed(raw: list[bytes], starts: list[int], sizes: list[int]) -> str:
    """A text from the bytes of its ids, each piece put where it stood; an error where a piece doesn't end at the next one's start."""
    out, at, length = [], 0, 0
    for start, size in zip(starts, sizes, strict=True):
        if start != length:
            raise ValueError(f"a piece of {length} code points can't be followed by one at {start}")
        out.append(b"".join(raw[at : at + size]).decode("utf-8", "replace"))
        at, length = at + size, length + len(out[-1])
    if at != len(raw):
        raise ValueError(f"{len(raw) - at} ids belong to no piece")
    return "".join(out)


def decode(encoded: DataFrame, ids: str = "ids", tokenizer: str = BYTE_BPE, folder: str = TOKENIZERS) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``; a null list has a null text. Ids that the tokenizer doesn't have are an error.

    Where ``encoded`` has the columns ``starts`` and ``sizes`` that ``encode`` gives, texts are put together by them,
    piece by piece; offsets that don't fit the ids are an error.
    """
    path = f"{folder}/{tokenizer}.tiktoken"
    by_offsets = {"starts", "sizes"} <= set(encoded.columns)

    def run(batches):
        piece = {i: b for b, i in ranks(path).items()}
        for batch in batches:
            raws = [None if x is None else [piece[i] for i in x] for x in batch.column(ids).to_pylist()]
            if by_offsets:
                texts = [None if r is None else _placed(r, s, n) for r, s, n in zip(raws, batch.column("starts").to_pylist(), batch.column("sizes").to_pylist())]
            else:
                texts = [None if r is None else b"".join(r).decode("utf-8", "replace") for r in raws]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    return encoded.mapInArrow(run, T.StructType([*encoded.schema, T.StructField("decoded", T.StringType())]))
