"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and only the document has a label. Every
sentence gets a probability from the words in it and their beginnings; a noisy-or
combines them: a document is toxic unless all its sentences are harmless. The
weights are trained through that combination by follow-the-regularised-leader
steps with elastic-net penalties, so the label finds its way to the sentences that
explain it, and the sentences with a high probability are the offending ones.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursemill.llm.sampling import bounded, draw
from coursemill.llm.worker import kept

#: Documents of each label that the weights are fitted on, at most.
SAMPLE = 4000
FOLDS, HELD_OUT = 4, 2
#: Probability from which a document or a sentence counts as toxic.
TOXIC = 0.3
#: Lengths of the beginnings of words that count besides the words.
BEGINNINGS = (3, 4, 5)
#: Documents of the sample that must hold a feature.
LEAST = 2
EPOCHS = 6
#: Step, smoothing and penalties of the fit.
ALPHA, BETA, L1, L2 = 1.0, 0.1, 1.0, 0.001
#: Words whose weight a task remembers; it starts anew beyond that.
REMEMBERED = 1 << 20

SENTENCE = re.compile(r"[^.!?\n…。！？]+")
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> Iterator[str]:
    """The word, closed by a blank, and its beginnings."""
    yield word + " "
    for size in BEGINNINGS:
        if len(word) > size:
            yield word[:size]


def softplus(x: float) -> float:
    return x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))


@dataclass
class Bag:
    """Features of a document: number, sentence, and in how many different words of the sentence; and its sentences."""

    feature: np.ndarray
    sentence: np.ndarray
    times: np.ndarray
    size: int


def bag_of(text: str, numbers: dict[str, int], grow: bool) -> Bag:
    """The text as a bag; unknown features get a number if ``grow``, else they are left out."""
    at, of, times, size = [], [], [], 0
    for size, match in enumerate(SENTENCE.finditer(text), 1):
        counts: dict[int, int] = {}
        for word in set(WORD.findall(match[0].lower())):
            for f in features(word):
                i = numbers.setdefault(f, len(numbers)) if grow else numbers.get(f, -1)
                if i >= 0:
                    counts[i] = counts.get(i, 0) + 1
        at += counts
        of += [size - 1] * len(counts)
        times += counts.values()
    return Bag(np.array(at, np.int64), np.array(of, np.int64), np.array(times, float), size)


def gradient(bag: Bag, weight: np.ndarray, intercept: float, toxic: bool) -> tuple[np.ndarray, float, float]:
    """Of the log loss through the noisy-or: by weight of each entry of the bag, by intercept; and the loss."""
    z = intercept + np.bincount(bag.sentence, weight[bag.feature] * bag.times, bag.size)
    harm = np.logaddexp(0, z)  # -log(1 - p) of every sentence
    total = max(float(harm.sum()), 1e-300)
    share = -1 / np.expm1(min(total, 700.0)) if toxic else 1.0
    by_sentence = share * -np.expm1(-harm)
    loss = -math.log(-math.expm1(-total)) if toxic else total
    return by_sentence[bag.sentence] * bag.times, float(by_sentence.sum()), loss


def follow_leader(bags: list[Bag], toxic: list[bool], count: int) -> tuple[np.ndarray, float]:
    """Weights of ``count`` features and the intercept, which is not penalised.

    Every document of the sample is a step of its own, whatever its label's share of all documents.
    """
    some = [(b, t) for b, t in zip(bags, toxic, strict=True) if b.size]
    if not some:
        return np.zeros(count), -math.inf
    z, n, start = np.zeros(count + 1), np.zeros(count + 1), math.log(0.1 / np.mean([b.size for b, _ in some]))

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == count, 0.0, L1)
        w = np.where(np.abs(z[at]) <= l1, 0.0, (np.sign(z[at]) * l1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))
        return w + np.where(at == count, start, 0.0)

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(some)):
            bag, label = some[i]
            at, entry = np.unique(np.append(bag.feature, count), return_inverse=True)
            w = weights(at)
            by_entry, by_intercept, _ = gradient(Bag(entry[:-1], bag.sentence, bag.times, bag.size), w, w[-1], label)
            g = np.bincount(entry, np.append(by_entry, by_intercept))
            step = g * g
            z[at] += g - (np.sqrt(n[at] + step) - np.sqrt(n[at])) / ALPHA * (w - np.where(at == count, start, 0.0))
            n[at] += step
    w = weights(np.arange(count + 1))
    return w[:count], float(w[count])


@dataclass
class Model:
    """Weights of the features that have one, and the intercept of a sentence."""

    weights: dict[str, float]
    intercept: float

    def sentences(self, text: str | None, known: dict[str, float]) -> tuple[list[tuple[int, int, float]], float]:
        """``(start, end, probability)`` of the sentences with a word of weight, and the harm of all sentences together."""
        found, plain, total = [], 0, 0.0
        for match in SENTENCE.finditer(text or ""):
            z = 0.0
            for word in set(WORD.findall(match[0].lower())):
                w = known.get(word)
                if w is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    w = known[word] = sum(self.weights.get(f, 0.0) for f in features(word))
                z += w
            if z:
                harm = softplus(self.intercept + z)
                found.append((*match.span(), -math.expm1(-harm)))
                total += harm
            else:
                plain += 1
        return found, total + (plain * softplus(self.intercept) if plain and self.intercept > -math.inf else 0.0)

    def score(self, text: str | None, known: dict[str, float]) -> tuple[float, list[tuple[int, int, float]]]:
        """Probability that the text is toxic, and its offending sentences: those from ``TOXIC``, else the likeliest one."""
        found, harm = self.sentences(text, known)
        probability = -math.expm1(-harm)
        if probability < TOXIC or not found:
            return probability, []
        return probability, [s for s in found if s[2] >= TOXIC] or [max(found, key=lambda s: s[2])]


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents whose labels are not learned: the CRC-32 of the id as text leaves 2. A null id counts as empty text: learned."""
    crc = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return crc % FOLDS == HELD_OUT


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``(draw, text, toxic)`` of at most ``most`` documents of each label, none of them held out.

    A document that is labelled more than once is toxic if one label says so;
    null labels and labels without a document count for nothing.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.max("toxic") > 0).alias("toxic"))
    rows = docs.where("doc_id IS NOT NULL").where(~held_out()).select(F.col("doc_id").cast("long"), draw().alias("draw")).distinct()
    return bounded(docs.where(~held_out()), rows.join(known, "doc_id"), "toxic", most)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from ``text`` of the documents that are not held out and ``labels.toxic`` of them.

    One task trains, on at most ``SAMPLE`` documents of each label. What comes
    back is the model, whose size the sample bounds. Without a labelled document
    no sentence is toxic.
    """

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        numbers: dict[str, int] = {}
        bags = [bag_of(text, numbers, True) for _, text, _ in rows]
        held = np.zeros(len(numbers), np.int64)
        for bag in bags:
            held[np.unique(bag.feature)] += 1
        # features of a single document say nothing of others
        place = np.cumsum(held >= LEAST) - 1
        for bag in bags:
            some = held[bag.feature] >= LEAST
            bag.feature, bag.sentence, bag.times = place[bag.feature[some]], bag.sentence[some], bag.times[some]
        w, b = follow_leader(bags, [t for *_, t in rows], int((held >= LEAST).sum()))
        names = [f for f, i in numbers.items() if held[i] >= LEAST and w[place[i]]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *names], pa.string()), pa.array([b, *(float(w[place[numbers[f]]]) for f in names)], pa.float64())],
            ["feature", "weight"])

    fitted = training_rows(docs, labels).repartition(1).mapInArrow(train, "feature string, weight double").collect()
    weights = {r.feature: r.weight for r in fitted}
    return Model(weights, weights.pop(None, -math.inf))


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``offending(start, end, score)``; only ``text`` is looked at.

    Places are code points, the end excluded. A text without a sentence, null
    ones included, has score 0. Rows, repeated ones included, come back as often
    as given with all their columns, but for those the new ones replace.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))
    model_id = uuid.uuid4().hex

    @F.pandas_udf("struct<score:double,offending:array<struct<start:int,end:int,score:double>>>")
    def judge(texts):
        import pandas

        caches = kept("toxicity", dict)
        if model_id not in caches:  # words are remembered for one model at a time
            caches.clear()
            caches[model_id] = {}
        judging, known = Model(*shared.value), caches[model_id]
        rows = [judging.score(t, known) for t in texts]
        spans = [[{"start": s, "end": e, "score": p} for s, e, p in found] for _, found in rows]
        return pandas.DataFrame({"score": [p for p, _ in rows], "offending": spans})

    judge = judge.asNondeterministic()  # so that it runs once, though two columns use it
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), judge("text").alias("found"))
    new = {"score": F.col("found.score"), "predicted": (F.col("found.score") >= TOXIC).cast("int"), "offending": F.col("found.offending")}
    return rows.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in new), *(c.alias(n) for n, c in new.items()))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted, offending)`` of every row of ``docs(doc_id, text)``.

    Extra columns are not read; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return judged(rows, fit(docs, labels)).drop("text")
