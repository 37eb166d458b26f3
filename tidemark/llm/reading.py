"""Reading level of each document, by a Rasch model of levels and word difficulties.

Every word has one difficulty and every document one ability, on one scale of log odds. An occurrence of a word is a
response with ordered steps, as in Rasch's model for rating scales: the odds that it stands in a text of level k rather
than k - 1 are exp(difficulty + a constant of that step), with the same constants for all words. A document's ability is
linear in the mean difficulty of its words, and the odds of its level k rather than k - 1 are exp(ability - threshold).
Labels that people gave to some documents fix the scale. Difficulties and abilities are estimated in turn, each by
maximum likelihood given the other: the difficulty of a word depends on the mean level of its occurrences, with
documents at the levels expected of them, and the ability of a labelled document is told without its own occurrences,
so that it is no more certain than that of any other. The rounds end when documents hardly change their level, or when
the labels get no likelier.

Words are pieces of a public tokenizer and pairs of neighbouring pieces, so unknown words count by their parts and plain
words by the company they keep. Sums are formed where the documents are read; what travels is one row per word and task,
and the parameters are as many as there are buckets of words, whatever the corpus.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.schemas import flat
from tidemark.llm.tokens import BYTE_BPE, TOKENIZERS, encoder, parts, ranks
from tidemark.session import stored

LEVELS = 4
#: Buckets of words and of pairs; the bound of the model's size.
BUCKETS = 1 << 16
#: Labelled documents that fix the scale: at most so many, those with the smallest hashes.
ANCHORS = 20_000
#: Weight of a document without a label beside one with a label, where difficulties are estimated.
WEIGHT = 0.5
#: Occurrences at the mean level that each word has beforehand.
PRIOR = 8.0
#: The rounds end when the expected levels of the documents change by less than this on average.
TOLERANCE = 1e-3
#: A closed fence, the line of a fence that is never closed, and code in quotes.
_CODE = re.compile(r"```.*?```|```[^\n]*|`[^`\n]*`", re.S)
#: Scores of the levels, and the steps that each level has taken.
_SCORES = np.arange(LEVELS) - (LEVELS - 1) / 2
_STEPS = (np.arange(LEVELS)[:, None] >= np.arange(1, LEVELS)[None, :]).astype(float)
_MEASURED = flat("doc_id bigint, anchor double, items array<int>, freqs array<int>")


def _prose_ids(path: str) -> np.ndarray:
    """Which ids are letters, with a blank before them or not."""
    rank = ranks(path)
    out = np.zeros(max(rank.values()) + 1, bool)
    for piece, i in rank.items():
        text = piece.decode("utf-8", "ignore").strip(" ")
        out[i] = text.isalpha() or (not text and piece.strip() != b"")  # halves of characters count as letters
    return out


def _buckets(ids: np.ndarray, owner: np.ndarray, prose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and bucket of every word and every pair of neighbours in one text."""
    keep = prose[ids]
    one = ids[keep].astype(np.uint64)
    two = np.flatnonzero(keep[:-1] & keep[1:] & (owner[:-1] == owner[1:]))
    pair = (ids[two].astype(np.uint64) << np.uint64(20)) | ids[two + 1].astype(np.uint64)
    mixed = np.concatenate(((one + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), (pair + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)))
    return np.concatenate((owner[keep], owner[two])), (mixed >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def measured(documents: DataFrame, anchors: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """doc_id, anchor (mean label, or null), items and freqs: buckets of the words of the whole prose, and how often."""
    path = f"{folder}/{tokenizer}.tiktoken"
    df = documents.select(F.col("doc_id").cast("bigint"), "text").join(F.broadcast(anchors), "doc_id", "left")

    def run(batches):
        enc, prose = encoder(path), _prose_ids(path)
        for batch in batches:
            texts = [_CODE.sub(" ", x) if x else "" for x in batch.column("text").to_pylist()]
            for low, high in parts(texts):
                ids, counts = enc.encode(texts[low:high])
                owner, bucket = _buckets(ids, np.repeat(np.arange(high - low), counts), prose)
                pair, freq = np.unique(owner * BUCKETS + bucket, return_counts=True)
                offsets = pa.array(np.searchsorted(pair, np.arange(high - low + 1) * BUCKETS).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low), batch.column("anchor").slice(low, high - low),
                        pa.ListArray.from_arrays(offsets, pa.array((pair % BUCKETS).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(freq.astype(np.int32))),
                    ],
                    names=_MEASURED.names,
                )

    return df.mapInArrow(run, _MEASURED)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, bucket and count of all words of a batch, and the words of each document."""
    items, freqs = batch.column("items"), batch.column("freqs")
    offsets = items.offsets.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
    count = freqs.flatten().to_numpy().astype(float)
    return owner, items.flatten().to_numpy(), count, np.bincount(owner, count, batch.num_rows)


def _anchored(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Which documents have a label, and its share of each level; a mean between two levels is split."""
    label = batch.column("anchor").to_numpy(zero_copy_only=False).astype(float)
    share = np.clip(1 - np.abs(np.nan_to_num(label)[:, None] - 1 - np.arange(LEVELS)), 0, 1)
    return ~np.isnan(label), share


@dataclass(frozen=True)
class Model:
    """difficulty: of every bucket. centre, scale: how mean difficulties become abilities. slope and thresholds: of the levels."""

    difficulty: np.ndarray
    centre: float
    scale: float
    link: np.ndarray

    def abilities(self, owner, item, count, words) -> np.ndarray:
        mean = np.bincount(owner, count * self.difficulty[item], len(words)) / np.maximum(words, 1)
        return self.link[0] * (mean - self.centre) / self.scale

    def odds(self, ability: np.ndarray) -> np.ndarray:
        """Log odds of each level, up to a constant of the document."""
        return ability[:, None] * np.arange(LEVELS) - _STEPS @ self.link[1:]


def _shares(odds: np.ndarray) -> np.ndarray:
    """Probabilities of log odds."""
    out = np.exp(odds - odds.max(1, keepdims=True)) if len(odds) else odds
    return out / out.sum(1, keepdims=True) if len(odds) else out


_SUMS = flat("item int, n double, score double")
#: Rows of the sums beside those of the buckets: occurrences at each level, then documents and how much they changed.
_LEVEL_ROW, _CHANGE_ROW = BUCKETS, BUCKETS + LEVELS


def _sums(docs: DataFrame, model: Model | None, before: Model | None) -> tuple[np.ndarray, float]:
    """Occurrences and sum of scores of each bucket (and occurrences of each level), and the mean change of the expected levels.

    Without a model only labelled documents take part.
    """

    def add(batches):
        total = np.zeros((_CHANGE_ROW + 1, 2))
        for batch in batches:
            owner, item, n, words = _arrays(batch)
            known, share = _anchored(batch)
            weight = known.astype(float)
            if model:
                now = _shares(model.odds(model.abilities(owner, item, n, words)))
                if before:
                    last = _shares(before.odds(before.abilities(owner, item, n, words)))
                    total[_CHANGE_ROW] += (words > 0).sum(), np.abs((now - last) @ _SCORES)[words > 0].sum()
                share = np.where(known[:, None], share, now)
                weight = np.where(known, 1.0, WEIGHT)
            total[:BUCKETS, 0] += np.bincount(item, n * weight[owner], BUCKETS)
            total[:BUCKETS, 1] += np.bincount(item, n * (weight * (share @ _SCORES))[owner], BUCKETS)
            total[_LEVEL_ROW:_CHANGE_ROW, 0] += (share * (weight * words)[:, None]).sum(0)
        used = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used, 0]), pa.array(total[used, 1])], names=_SUMS.names)

    got = docs.mapInArrow(add, _SUMS).groupBy("item").agg(F.sum("n").alias("n"), F.sum("score").alias("score")).toPandas()
    out = np.zeros((_CHANGE_ROW + 1, 2))
    out[got.item.to_numpy()] = got[["n", "score"]].to_numpy()
    documents, moved = out[_CHANGE_ROW]
    return out[:_CHANGE_ROW], float(moved / documents) if documents else np.inf


@dataclass(frozen=True)
class _Scale:
    """Difficulty as a function of the mean score of a word's occurrences: the likeliest, found on a grid."""

    grid: np.ndarray
    expected: np.ndarray
    mean: float

    @staticmethod
    def of(occurrences: np.ndarray) -> "_Scale":
        level = occurrences / occurrences.sum()
        grid = np.linspace(-12, 12, 6001)
        share = _shares(grid[:, None] * _SCORES + np.log(np.maximum(level, 1e-12)))
        return _Scale(grid, share @ _SCORES, float(level @ _SCORES))

    def difficulty(self, n: np.ndarray, score: np.ndarray) -> np.ndarray:
        return np.interp((score + PRIOR * self.mean) / (n + PRIOR), self.expected, self.grid)


def _without_own(anchored: DataFrame, sums: np.ndarray, scale: _Scale) -> tuple[np.ndarray, np.ndarray]:
    """Mean difficulty of the words of each labelled document, from all other documents, and its label's shares; at most ANCHORS rows."""

    def mean(batches):
        for batch in batches:
            owner, item, n, words = _arrays(batch)
            share = _anchored(batch)[1]
            difficulty = scale.difficulty(np.maximum(sums[item, 0] - n, 0), sums[item, 1] - n * (share @ _SCORES)[owner])
            x = np.bincount(owner, n * difficulty, len(words)) / np.maximum(words, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, mask=words == 0), batch.column("anchor")], names=["doc_id", "x", "anchor"])

    got = anchored.mapInArrow(mean, flat("doc_id bigint, x double, anchor double")).where("x is not null").toPandas()
    got = got.sort_values(["doc_id", "x"])
    return got.x.to_numpy(), np.clip(1 - np.abs(got.anchor.to_numpy()[:, None] - 1 - np.arange(LEVELS)), 0, 1)


def _linked(x: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Slope and thresholds of the levels by Newton steps, and the log likelihood of the labels."""
    link = np.array([1.0, *np.zeros(LEVELS - 1)])
    along = np.concatenate([(x[:, None] * np.arange(LEVELS))[:, :, None], np.broadcast_to(-_STEPS, (len(x), LEVELS, LEVELS - 1))], 2)
    ridge = 1e-3 * np.eye(LEVELS)
    for _ in range(100):
        now = _shares(along @ link)
        mean = (now[:, :, None] * along).sum(1)
        slope = ((share - now)[:, :, None] * along).sum((0, 1)) - ridge @ link
        step = np.linalg.solve(np.einsum("nk,nki,nkj->ij", now, along, along) - mean.T @ mean + ridge, slope)
        link = link + step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return link, float((share * np.log(_shares(along @ link) + 1e-300)).sum())


def fitted(docs: DataFrame) -> tuple[Model | None, list[tuple[int, float, float]]]:
    """The model, and of each round the log likelihood of the labels and the change of the levels; None without labels that can be used.

    The rounds end when levels hardly change, or with the first that makes the labels less likely, which doesn't count:
    with few labels, difficulties would follow whatever else tells the unlabelled documents apart.

    docs: those of ``measured``, stored.
    """
    anchored = stored(docs.where("anchor is not null"), "anchors")
    model, before, rounds = None, None, []
    while True:
        sums, change = _sums(docs if model else anchored, model, before)
        if rounds:
            rounds[-1] = (*rounds[-1][:2], change)
        if change < TOLERANCE or not sums.any():
            return model, rounds
        scale = _Scale.of(sums[_LEVEL_ROW:, 0])
        x, share = _without_own(anchored, sums, scale)
        centre, spread = float(x.mean()), float(x.std()) or 1.0
        link, likelihood = _linked((x - centre) / spread, share)
        rounds.append((len(rounds) + 1, likelihood, np.inf))
        if len(rounds) > 1 and likelihood < rounds[-2][1]:
            return model, rounds
        before, model = model, Model(scale.difficulty(sums[:BUCKETS, 0], sums[:BUCKETS, 1]), centre, spread, link)


def _words_of(documents: DataFrame, labels: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    valid = labels.where(F.col("band").between(1, LEVELS)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg("band").alias("anchor"))
    anchors = valid.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(ANCHORS)
    return stored(measured(documents, anchors, tokenizer, folder), "words")


def rounds(documents: DataFrame, labels: DataFrame, tokenizer: str = BYTE_BPE, folder: str = TOKENIZERS) -> DataFrame:
    """round, log_likelihood (of the labels) and change (mean change of the documents' levels, null in the first round) of each round of the estimation."""
    told = fitted(_words_of(documents, labels, tokenizer, folder))[1]
    rows = [(n, likelihood, change if np.isfinite(change) else None) for n, likelihood, change in told]
    return documents.sparkSession.createDataFrame(rows, "round int, log_likelihood double, change double")


def levels(documents: DataFrame, labels: DataFrame, tokenizer: str = BYTE_BPE, folder: str = TOKENIZERS) -> DataFrame:
    """One row per document: doc_id, level (1 to 4), level_mean (between them), ability, margin (log odds of level 4 against the likeliest other) and words.

    Labels that are null or out of range don't count; several labels of one document count as their mean. Code in closed
    fences and in quotes isn't read. Documents without words (null, empty, blank, code only) have null levels, as have
    all documents where there are no labels. Repeated doc_ids give one row each; equal texts have equal levels.
    """
    docs = _words_of(documents, labels, tokenizer, folder)
    model = fitted(docs)[0]

    def assign(batches):
        for batch in batches:
            owner, item, n, words = _arrays(batch)
            none = (words == 0) if model else np.ones(len(words), bool)
            ability = model.abilities(owner, item, n, words) if model else np.zeros(len(words))
            odds = model.odds(ability) if model else np.zeros((len(words), LEVELS))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(odds.argmax(1).astype(np.int32) + 1, mask=none), pa.array(_shares(odds) @ np.arange(1, LEVELS + 1.0), mask=none),
                    pa.array(ability, mask=none), pa.array(odds[:, -1] - odds[:, :-1].max(1), mask=none), pa.array(words.astype(np.int64)),
                ],
                names=["doc_id", "level", "level_mean", "ability", "margin", "words"],
            )

    return docs.mapInArrow(assign, flat("doc_id bigint, level int, level_mean double, ability double, margin double, words bigint"))


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id of the documents whose text as a whole stands in the highest level."""
    return levels(documents, labels).where(F.col("level") == LEVELS).select("doc_id")
