"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in the set of its lower-cased words and of their
beginnings, which inflected forms share, and the document's is the noisy-or of its sentences: 1 - prod(1 - p). Weights
are fitted to document labels alone, by full gradient steps on at most `sample` labelled documents of either class (those
of least id hash among those with a word), whole texts of any length. Features are counted and chosen by Spark; the
driver gets the chosen features' numbers, sentence by sentence, and no text. Scoring reads every whole text. Sentences
at or above 0.5 are returned as spans of the text.

Null and empty texts, and texts without a word, score 0. Labels that are null are left out; a document that has
several is toxic if one says so. Of rows of one id with different texts, the least text is learned from. Without a toxic
label every score is 0. Repeated rows are scored each for itself. An empty table gives an empty result. All columns of
the documents are kept; those named like a result are replaced, unless the results are given other names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import ddl, give_back, ranked_sample, released, written

SAMPLE = 3000  #: labelled documents of either class to learn from, at most
LEAST_DOCUMENTS = 3  #: documents of the sample that a feature with a weight occurs in
STEPS, RATE = 150, 0.3
SPARSITY = 0.5  #: documents' worth of evidence that a weight must outweigh (an L1 penalty)
NOISE = 0.04  #: share of labels taken to be wrong, so that one odd label does not make words toxic
THRESHOLD = 0.5
SENTENCE = re.compile(r"[^.!?\n]+")
TOKEN = re.compile(r"\w+")
BEGINNINGS = (3, 4, 5, 6, 7)  #: letters of a longer word that count as a feature
CACHED_WORDS = 200_000


def features(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in BEGINNINGS if n < len(word))]


def sentence_features(text: str) -> list[set[str]]:
    """Of the sentences with a word."""
    return [set().union(*map(features, words)) for s in SENTENCE.findall(text.lower()) if (words := set(TOKEN.findall(s)))]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        self.known: dict[str, tuple[str, ...]] = {}  # of words seen, their features with a weight

    def of(self, word: str) -> tuple[str, ...]:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        found = self.known[word] = tuple(x for x in features(word) if x in self.weights)
        return found

    def sentence_scores(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences with a word."""
        known, weights, out = self.known, self.weights, []
        text = text or ""
        low = text.lower()
        if len(low) != len(text):  # a few letters grow in lower case; spans must fit the text
            low = "".join(x if len(x) == 1 else c for c in text for x in [c.lower()])
        for m in SENTENCE.finditer(low):
            words = set(TOKEN.findall(m[0]))
            if words:
                found = {x for w in words for x in (known[w] if w in known else self.of(w))}
                z = self.bias + sum([weights[x] for x in sorted(found)])
                out.append((m.start(), m.end(), 1 / (1 + np.exp(-z)) if z > -30 else 0.0))
        return out


def noisy_or(scores: list[float]) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(scores, 1 - 1e-12)).sum())) + 0.0 if scores else 0.0


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], start: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the documents' log-likelihood, with an L1 penalty. Of each document: its sentences'
    features, one behind another, and where each sentence ends; start: the first weights."""
    word_used = np.concatenate([words for words, _ in bags]).astype(np.int64)
    sentences = [len(ends) for _, ends in bags]
    s_used = np.repeat(np.arange(sum(sentences)), np.concatenate([np.diff(ends, prepend=0) for _, ends in bags]))
    document_ends, toxic = np.cumsum(sentences), labels
    y = np.array(toxic, np.int64)
    d_start = np.array([0, *document_ends[:-1]])
    d_of = np.repeat(np.arange(len(y)), np.diff([0, *document_ends]))
    w, b = start, -6.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = b + np.bincount(s_used, w[word_used], minlength=len(d_of))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), d_start)  # log of no sentence being toxic
        told = NOISE + (1 - 2 * NOISE) * -np.expm1(clean)  # probability that the label says toxic
        pull = (1 - 2 * NOISE) * np.exp(clean) * np.where(y == 1, -1 / told, 1 / (1 - told))  # times p: the slope by z
        slope = p * pull[d_of]
        g = np.bincount(word_used, slope[s_used], minlength=len(w)) / len(y)
        l1 = SPARSITY / len(y)
        g = np.where(w == 0, np.sign(g) * np.maximum(np.abs(g) - l1, 0), g + l1 * np.sign(w))
        gb = slope.sum() / len(y)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        size, scale = RATE / (1 - 0.9**step), 1 - 0.99**step
        new = w - size * m / (np.sqrt(v / scale) + 1e-4)
        w = np.where(w * new < 0, 0.0, new)  # a weight that crosses zero stops there
        b -= size * mb / (np.sqrt(vb / scale) + 1e-4)
    return w, float(b)


def chosen_features(texts: DataFrame) -> DataFrame:
    """texts(text, label) -> feature, start: those whose share of documents differs between the classes by more than
    chance gives, twice over, and that difference of log odds, none below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[label].update({""}.union(*sentence_features(text)))  # "": the documents themselves
            names = sorted(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in counts)], names=["feature", "clean", "toxic"])

    counts = written(texts.select("text", "label").mapInArrow(lambda batches: released(run(batches)), "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "feature_counts")
    size = counts.where("feature = ''").first()
    if not size:
        return counts.select("feature", F.lit(0.0).alias("start")).where("false")
    odds = F.log((F.col("toxic") + 0.5) / (size.toxic + 1)) - F.log((F.col("clean") + 0.5) / (size.clean + 1))
    sure = F.abs(odds) - 2 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    enough = (F.col("feature") != "") & (F.col("toxic") + F.col("clean") >= LEAST_DOCUMENTS) & (sure > 0)
    return counts.where(enough).select("feature", F.when(odds > 0, sure).otherwise(0.0).alias("start"))


def bags_of(texts: DataFrame, seen: dict[str, int]) -> DataFrame:
    """texts(id, text, label) -> id, label, words array<int>, ends array<int>."""
    shared = texts.sparkSession.sparkContext.broadcast(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            words, ends = [], []
            for text in batch.column(2).to_pylist():
                found = [sorted(seen[x] for x in s if x in seen) for s in sentence_features(text)]
                words.append([i for s in found for i in s])
                ends.append(np.cumsum([len(s) for s in found], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["id", "label", "words", "ends"])

    return texts.select("id", "label", "text").mapInArrow(lambda batches: released(run(batches)), f"id {texts.schema['id'].dataType.simpleString()}, label int, words array<int>, ends array<int>")


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """allowed: of the labelled rows, those to learn from. sample: of these, in either class, as many at most."""
    marked = labels if allowed is None else labels.where(allowed)
    marked = marked.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    worded = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"[\p{L}\p{N}_]"))
    known = written(worded.select("id").join(marked, "id").distinct(), "labelled")
    chosen = ranked_sample(known.where("label = 1"), "id", sample).union(ranked_sample(known.where("label = 0"), "id", sample))
    texts = written(worded.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")), "labelled_texts")
    if not texts.where("label = 1").count():
        return Model({}, -1e9)
    found = dict(zip(*chosen_features(texts).toArrow().to_pydict().values()))
    if not found:
        return Model({}, -1e9)
    seen = {x: i for i, x in enumerate(sorted(found))}
    # 2 x sample rows at most, as numbers in arrays: as rows of Python's they would take ten times as much
    bags = bags_of(texts, seen).toArrow().combine_chunks().sort_by("id")
    bags = bags.filter(pc.greater(pc.list_value_length(bags["ends"]), 0))
    words, ends = ([x.values.to_numpy() for x in bags[c]] for c in ("words", "ends"))
    weights, bias = fit(list(zip(words, ends)), bags["label"].to_pylist(), np.array([found[x] for x in seen]))
    del bags, words, ends
    give_back()
    return Model({x: float(weights[i]) for x, i in seen.items() if abs(weights[i]) > 0.1}, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] = ("score", "predicted", "offending")) -> DataFrame:
    """Adds, under these names, the score double, predicted int, and offending array<struct<start, end, score>> (spans of
    the text)."""
    kept = docs.drop(*names)
    at = kept.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            scores, spans = [], []
            for x in batch.column(at):
                found = model.sentence_scores(x.as_py())
                scores.append(noisy_or([p for _, _, p in found]))
                spans.append([{"start": a, "end": b, "score": p} for a, b, p in found if p >= THRESHOLD])
            columns = [pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    kinds = ("double", "int", "array<struct<start: int, end: int, score: double>>")
    return kept.mapInArrow(lambda batches: released(run(batches)), ", ".join([ddl(kept), *(f"`{n}` {k}" for n, k in zip(names, kinds))]))
