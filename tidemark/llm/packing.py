"""Texts packed into containers of one capacity, lexical neighbours together.

Documents are measured in tokens and sorted by their rarest words over the whole cluster, so that like texts lie in
one run, however many there are. Runs are cut into shards of bounded size. Within a shard an inverted index with BM25
returns the unused neighbours of each seed, the largest text left, by all of its words, and they fill its window greedily;
what room is left goes to the largest text that fits. Texts of containers with much room left meet again in a second
round, in as many tasks as their number asks for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.schemas import flat
from tidemark.llm.tokens import BYTE_BPE, TOKENIZERS, encoder, parts, ranks
from tidemark.session import stored

CAPACITY = 4096
#: Texts in a shard: the bound of what a task holds at once.
SHARD = 2048
#: Shards of the second round in a task: the more a task holds, the more its texts have to choose from.
AGAIN = 8
#: A container that is filled to less than this share is packed anew in the second round.
FULL = 0.985
#: The usual parameters of BM25.
K1, B = 1.2, 0.75
ITEMS = flat("doc_id bigint, part int, n_tokens int, terms array<int>, freqs array<int>")
PACKED = flat("container bigint, position int, doc_id bigint, part int, n_tokens int, room int, terms array<int>, freqs array<int>")


def _word_ids(path: str) -> np.ndarray:
    """Which ids are words or parts of words, in any script: three letters or more after a blank, or letters beyond ASCII."""
    rank = ranks(path)
    out = np.zeros(max(rank.values()) + 1, bool)
    for piece, i in rank.items():
        word = piece.lstrip(b" ")
        # bytes beyond ASCII belong to letters of other scripts, often only a part of one
        out[i] = (word.isalpha() and len(word) >= 3 and piece[:1] == b" ") or (any(x > 0xC3 for x in word) and not word.isascii())
    return out


def measured(documents: DataFrame, tokenizer: str = BYTE_BPE, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, n_tokens, terms and freqs (ids that are words, and how often) of each whole text; null and empty texts have 0."""
    path = f"{folder}/{tokenizer}.tiktoken"

    def run(batches):
        enc, word = encoder(path), _word_ids(path)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for low, high in parts(texts):
                ids, counts = enc.encode(texts[low:high])
                owner = np.repeat(np.arange(high - low), counts)
                keep = word[ids]
                pair, freq = np.unique(owner[keep] * (1 << 20) + ids[keep], return_counts=True)
                offsets = np.searchsorted(pair, np.arange(high - low + 1) * (1 << 20)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low).cast(pa.int64()), pa.array(counts.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array((pair & ((1 << 20) - 1)).astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(freq.astype(np.int32))),
                    ],
                    names=["doc_id", "n_tokens", "terms", "freqs"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, flat("doc_id bigint, n_tokens int, terms array<int>, freqs array<int>"))


def _rarity(sized: DataFrame, n_ids: int) -> np.ndarray:
    """Inverse document frequency of every id over all documents; as many numbers as the tokenizer has ids."""

    def count(batches):
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=n_ids)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["term", "n"])

    counts = sized.select("terms").mapInArrow(count, flat("term int, n bigint")).groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    n_docs = sized.count()
    idf = np.full(n_ids, np.log1p(n_docs / 0.5), np.float32)
    idf[counts.term.to_numpy()] = np.log1p((n_docs - counts.n.to_numpy() + 0.5) / (counts.n.to_numpy() + 0.5))
    return idf


class _Index:
    """BM25 over the texts of one shard."""

    def __init__(self, terms: np.ndarray, freqs: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, idf: np.ndarray):
        owner = np.repeat(np.arange(len(lengths)), np.diff(offsets))
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean()))
        weight = (idf[terms] * freqs * (K1 + 1) / (freqs + norm[owner])).astype(np.float32)
        order = np.argsort(terms, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        known, first = np.unique(terms[order], return_index=True)
        bounds = np.append(first, len(order))
        # where the posting list of each word of each text begins, and how long it is
        at = np.searchsorted(known, terms)
        self.low, self.long, self.offsets, self.n = bounds[at], np.diff(bounds)[at], offsets, len(lengths)

    def scores(self, seed: int) -> np.ndarray:
        """Scores of all texts for all words of the seed: its posting lists, one behind the other, summed by text."""
        mine = slice(self.offsets[seed], self.offsets[seed + 1])
        low, long = self.low[mine], self.long[mine]
        ends = np.cumsum(long)
        if not len(ends):
            return np.zeros(self.n)
        place = np.repeat(low - (ends - long), long) + np.arange(int(ends[-1]))
        return np.bincount(self.owner[place], self.weight[place], self.n)


def _fill(sizes: np.ndarray, index: _Index, capacity: int) -> list[list[int]]:
    """Containers of one shard as lists of places; every size is at most the capacity."""
    # unused texts by size, for the last room of a window
    by_size = np.argsort(-sizes, kind="stable")
    free = np.ones(len(sizes), bool)
    ordered = sizes[by_size]
    out = []
    for seed in by_size:
        if not free[seed]:
            continue
        free[seed] = False
        window, room = [int(seed)], capacity - int(sizes[seed])
        if room:
            scores = index.scores(seed)
            near = np.flatnonzero(free & (scores > 0) & (sizes <= room))
            for k in near[np.argsort(-scores[near], kind="stable")].tolist():
                size = int(sizes[k])
                if size <= room:
                    window.append(k)
                    free[k] = False
                    room -= size
        while room:
            # the largest unused text that fits
            low = int(np.searchsorted(-ordered, -room))
            left = np.flatnonzero(free[by_size[low:]])
            if not len(left):
                break
            k = int(by_size[low + left[0]])
            window.append(k)
            free[k] = False
            room -= int(sizes[k])
        out.append(window)
    return out


def _pack(items: DataFrame, idf: np.ndarray, capacity: int, round_: int) -> DataFrame:
    """Packs the rows of each partition, in their order, shard by shard. A container's number holds round, partition and place."""

    def run(batches):
        made, base = 0, (round_ << 60) + (TaskContext.get().partitionId() << 34)
        for table in _shards(batches):
            sizes = table.column("n_tokens").to_numpy().astype(np.int64)
            terms, freqs = (table.column(c).combine_chunks() for c in ("terms", "freqs"))
            terms, freqs = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (terms, freqs))
            offsets = terms.offsets.to_numpy().astype(np.int64)
            index = _Index(terms.flatten().to_numpy(), freqs.flatten().to_numpy(), offsets - offsets[0], sizes.astype(float), idf)
            windows = _fill(sizes, index, capacity)
            place = np.array([k for w in windows for k in w], np.int64)
            lengths = np.array([len(w) for w in windows])
            room = capacity - np.array([sizes[w].sum() for w in windows])
            number = np.repeat(base + made + np.arange(len(windows)), lengths)
            position = np.arange(len(place)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            made += len(windows)
            taken = table.take(pa.array(place)).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(number), pa.array(position.astype(np.int32)), taken.column("doc_id"), taken.column("part"), taken.column("n_tokens"), pa.array(np.repeat(room, lengths).astype(np.int32)), taken.column("terms"), taken.column("freqs")],
                names=PACKED.names,
            )

    return items.select(*ITEMS.names).mapInArrow(run, PACKED)


def _shards(batches):
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(SHARD - n, batch.num_rows - at)
            held.append(batch.slice(at, take))
            n, at = n + take, at + take
            if n == SHARD:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _neighbours(items: DataFrame, idf: np.ndarray, partitions: int | None = None) -> DataFrame:
    """Items sorted by the words that say most about them, over all partitions; doc_id and part split a run of equal texts.

    Sorted by ranges into so many partitions, by default as many as Spark chooses.
    """
    n = len(idf)

    def key(batches):
        for batch in batches:
            terms, freqs = batch.column("terms"), batch.column("freqs")
            offsets = terms.offsets.to_numpy().astype(np.int64) - terms.offsets[0].as_py()
            t, f = terms.flatten().to_numpy(), freqs.flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            order = np.lexsort((-(idf[t] * np.log1p(f)), owner))
            rank = np.arange(len(t)) - offsets[owner[order]]
            keys = np.full((batch.num_rows, 3), n, np.int64)
            for r in range(3):
                at = order[rank == r]
                keys[owner[at], r] = t[at]
            # three words in order of their number, so that near texts agree in the first
            keys.sort(axis=1)
            yield batch.append_column("_key", pa.array((keys[:, 0] << 40) + (keys[:, 1] << 20) + keys[:, 2]))

    keyed = items.mapInArrow(key, T.StructType([*items.schema, T.StructField("_key", T.LongType())]))
    order = ["_key", "doc_id", "part"]
    ranged = keyed.repartitionByRange(partitions, *order) if partitions else keyed.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order).drop("_key")


def containers(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = BYTE_BPE, folder: str = TOKENIZERS) -> DataFrame:
    """One row per text or part of a text: container, position, doc_id, part, n_tokens and the container's room left.

    A text that fits is never split. A larger one is cut into parts of the capacity, each a container of its own, and
    a rest that is packed like a text. Null and empty texts take no place: their container is null. Equal texts under
    other doc_ids are packed each. No container holds more than its capacity.
    """
    path = f"{folder}/{tokenizer}.tiktoken"
    sized = stored(measured(documents, tokenizer, folder), "sizes")
    idf = _rarity(sized, max(ranks(path).values()) + 1)
    whole = F.floor(F.col("n_tokens") / F.lit(capacity)).cast("int")
    # parts that fill a container alone; numbered apart from all others by partition and place of stored rows
    full = sized.where(F.col("n_tokens") >= capacity).select(
        "doc_id", F.posexplode(F.sequence(F.lit(0), whole - 1)).alias("part", "_"),
    )
    full = full.select(
        (F.lit(3 << 60) + F.monotonically_increasing_id()).alias("container"),
        F.lit(0).alias("position"), "doc_id", "part", F.lit(capacity).alias("n_tokens"), F.lit(0).alias("room"),
    )
    rest = (F.col("n_tokens") % capacity).cast("int")
    items = sized.where(rest > 0).select("doc_id", whole.alias("part"), rest.alias("n_tokens"), "terms", "freqs")
    first = stored(_pack(_neighbours(items, idf), idf, capacity, 1), "packed")
    roomy = F.col("room") > int((1 - FULL) * capacity)
    again = first.where(roomy).select(*ITEMS.names)
    # as many tasks as the texts left over need, each with several shards: the work is split at any size
    tasks = -(-again.count() // (SHARD * AGAIN)) or 1
    second = _pack(_neighbours(again, idf, tasks), idf, capacity, 2)
    columns = ["container", "position", "doc_id", "part", "n_tokens", "room"]
    nothing = sized.where("n_tokens = 0").select(F.lit(None).cast("bigint").alias("container"), F.lit(None).cast("int").alias("position"), "doc_id", F.lit(0).alias("part"), F.lit(0).alias("n_tokens"), F.lit(None).cast("int").alias("room"))
    return first.where(~roomy).select(*columns).unionByName(second.select(*columns)).unionByName(full).unionByName(nothing)
