"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Document frequencies are counted over all training documents. The weights are
fitted by follow-the-regularised-leader with elastic-net penalties on a bounded
sample, in one task, and one temperature calibrates the probabilities on a part
of the sample that the weights have not seen. Scoring is one table lookup per
n-gram, inside the tasks that read the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursemill.llm.worker import kept
from coursemill.sources.staging import stage

ORDERS = (1, 2, 3)
#: Hashed features; fixed size of the document-frequency table and of a row of weights.
FEATURES = 1 << 16
#: Labelled documents of each language that the weights are fitted on, about, and languages learned at most.
SAMPLE, LANGUAGES = 1500, 500
FOLDS = 5
EPOCHS = 3
#: Step, smoothing and penalties of the fit; scale brings term frequencies near one.
ALPHA, BETA, L1, L2, SCALE = 0.5, 1.0, 0.02, 0.001, 50.0
#: Share of a language's documents that hold an n-gram which is an ordinary one of it.
USUAL = 0.01
#: Known n-grams added to those of a text.
FEW = 3
UNDETERMINED = "und"
#: Characters worked on at once.
CHUNK = 1 << 20


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str, letter: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Feature numbers of all n-grams, and number of letters, chunk by chunk.

    Lower case; every run of other characters counts as one space, and so do the ends.
    """
    for start in range(0, max(len(text), 1), CHUNK):
        codes = np.frombuffer(f" {text[start : start + CHUNK]} ".lower().encode("utf-32-le", "replace"), "<u4")
        is_letter = letter[codes]
        codes = np.where(is_letter, codes, np.uint32(32))
        keep = is_letter.copy()
        keep[0] = True
        keep[1:] |= is_letter[:-1]
        codes = codes[keep]
        found = []
        for n in ORDERS:
            mixed = np.full(max(len(codes) - n + 1, 0), n * 0x85EBCA6B & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                mixed *= np.uint32(0x01000193)
                mixed += codes[k : k + len(mixed)]
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            found.append((mixed >> np.uint32(16)).astype(np.uint16))
        yield np.concatenate(found), int(is_letter.sum())


@dataclass
class Model:
    """Languages, weights with idf, scale and temperature folded in (features x languages), and intercepts."""

    languages: list[str]
    weights: np.ndarray
    intercepts: np.ndarray
    #: Whether each n-gram is an ordinary one of each language (features x languages).
    known: np.ndarray

    def _odds(self, text: str | None, letter: np.ndarray) -> np.ndarray | None:
        """Probabilities of the languages, not yet divided by their sum; None where there is nothing to judge."""
        total, n, seen = self.intercepts.astype(np.float64), 0, 0
        sums = np.zeros(len(self.languages))
        for found, count in grams(text or "", letter):
            seen += count
            n += len(found)
            sums += self.weights[found].sum(axis=0, dtype=np.float64)
        if not seen or not self.languages:
            return None
        logits = total + sums / n
        return np.exp(logits - logits.max())

    def score(self, text: str | None, letter: np.ndarray) -> tuple[str, float]:
        odds = self._odds(text, letter)
        if odds is None:
            return UNDETERMINED, 0.0
        best = int(odds.argmax())
        return self.languages[best], float(odds[best] / odds.sum())

    def evidence(self, text: str | None, letter: np.ndarray) -> tuple[float, float]:
        """Share of the longest n-grams known to the two best languages, and their odds against the third.

        Neither depends on the number of languages. A text in two languages is
        known to the two together. Without a third the odds are infinite. A text
        of a few n-grams tells little, so ``FEW`` known ones are added.
        """
        odds = self._odds(text, letter)
        if odds is None:
            return 0.0, 0.0
        order = odds.argsort()[::-1]
        known, inside, n = self.known[:, order[:2]].any(axis=1), 0, 0
        for found, _ in grams(text or "", letter):
            last = found[len(found) - max((len(found) + 3) // 3 - 2, 0) :]
            inside += int(known[last].sum())
            n += len(last)
        third = odds[order[2]] if len(order) > 2 else 0.0
        return (inside + FEW) / (n + FEW), float(odds[order[:2]].sum() / third) if third else float("inf")


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents kept from training: the CRC-32 of the id as text leaves 0. A null id counts as empty text: kept from it."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def document_frequencies(texts: DataFrame) -> DataFrame:
    """``(feature, df)`` over all rows of ``texts(text)``; every task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = kept("letters", letters)
        total, present = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, bool)
        for batch in batches:
            for text in batch.column(0):
                present[:] = False
                for found, _ in grams(text.as_py(), letter):
                    present[found] = True
                total += present
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["feature", "df"])

    counted = texts.select("text").mapInArrow(run, "feature int, df long")
    return counted.groupBy("feature").agg(F.sum("df").alias("df"))


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and intercepts by FTRL-proximal steps, each document in turn.

    ``rows``: feature numbers, values and class of each document. Feature number
    ``FEATURES`` is the intercept, which is not penalised.
    """
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(at) -> np.ndarray:
        za, l1 = z[at], np.where(np.arange(FEATURES + 1)[at] == FEATURES, 0.0, L1)[:, None]
        shrunk = np.sign(za) * l1 - za
        return np.where(np.abs(za) <= l1, 0.0, shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, values, label = rows[i]
            w = weights(at)
            logits = values @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            g = values[:, None] * p
            g2 = g * g
            z[at] += g - (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g2
    w = weights(slice(None))
    return w[:FEATURES], w[FEATURES]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Divisor of the logits with the least log loss, by golden-section search on a log scale."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        x = logits / np.exp(log_t)
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(labels)), labels]).mean())

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    while high - low > 1e-3:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame) -> Model:
    """Learn from ``text`` and ``lang`` of the documents that are not held out; rows where either is null are left out.

    About ``SAMPLE`` documents of each language, chosen by a digest of the row,
    give the weights; idf counts all. A fifth of them sets the temperature. What
    comes back to the driver is the model, whose size the number of languages
    bounds. Without a labelled document the model knows no language.
    """
    labelled = docs.where(~held_out()).where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros(0), np.zeros((FEATURES, 0), bool))
    total = sum(r["count"] for r in sizes)
    rate = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, SAMPLE / r["count"]))))
    draw = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 20)) / F.lit(1 << 20)
    idf_table = stage(document_frequencies(labelled), "frequencies")
    df = np.zeros(FEATURES)
    for feature, n in idf_table.collect():  # FEATURES rows at most
        df[feature] = n
    idf = np.log((1 + total) / (1 + df)) + 1
    idf[df < 2] = 0.0

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = kept("letters", letters)
        for batch in batches:
            out = []
            for doc_id, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, counts, n = np.zeros(0, np.int64), np.zeros(0), 0
                for found, _ in grams(text, letter):
                    sums = np.bincount(np.concatenate([at, found]), np.concatenate([counts, np.ones(len(found))]), FEATURES)
                    at, n = np.flatnonzero(sums), n + len(found)
                    counts = sums[at]
                values = counts / n * idf[at] * SCALE
                some = values > 0
                out.append((doc_id, lang, at[some].astype("<u2").tobytes(), values[some].astype("<f4").tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "lang", "at", "values"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        data, times, docs_of = [], np.zeros((FEATURES, len(languages)), np.int32), np.zeros(len(languages))
        for _, lang, at, values in rows:
            times[np.frombuffer(at, "<u2"), languages.index(lang)] += 1
            docs_of[languages.index(lang)] += 1
            data.append((np.append(np.frombuffer(at, "<u2").astype(np.int64), FEATURES),
                         np.append(np.frombuffer(values, "<f4"), 1.0), languages.index(lang)))
        seen = [d for i, d in enumerate(data) if i % FOLDS] or data
        unseen = [d for i, d in enumerate(data) if i % FOLDS == 0]
        w, b = follow_leader(seen, len(languages))
        logits = np.array([v[:-1] @ w[at[:-1]] + b for at, v, _ in unseen]).reshape(-1, len(languages))
        t = temperature(logits, np.array([label for *_, label in unseen]))
        w, b = w * idf[:, None] * SCALE / t, b / t
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], pa.binary()) for x in (
                w.astype("<f4").tobytes(), b.astype("<f8").tobytes(), np.packbits((times > 0) & (times >= USUAL * docs_of)).tobytes())],
            ["w", "b", "known"])

    sampled = labelled.where(draw < F.element_at(rate, F.col("lang"))).select(F.col("doc_id").cast("long"), "text", "lang")
    features = stage(sampled.mapInArrow(featurise, "doc_id long, lang string, at binary, values binary"), "features")
    w, b, known = features.repartition(1).mapInArrow(train, "w binary, b binary, known binary").first()
    shape = (FEATURES, len(languages))
    known = np.unpackbits(np.frombuffer(known, np.uint8), count=shape[0] * shape[1]).astype(bool).reshape(shape)
    return Model(languages, np.frombuffer(w, "<f4").reshape(shape), np.frombuffer(b, "<f8"), known)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only ``text`` is looked at.

    A text that is null or has no letter is ``und`` with score 0; so are all
    texts if the model knows no language. Rows, repeated ones included, come
    back as often as given with all their columns.
    """
    parts = (model.languages, model.weights, model.intercepts, model.known)  # FEATURES x languages numbers
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def judge(texts):
        import pandas

        known, letter = Model(*shared.value), kept("letters", letters)
        return pandas.DataFrame([known.score(t, letter) for t in texts], columns=["lang_pred", "score"])

    judge = judge.asNondeterministic()  # so that it runs once, though two columns use it
    return docs.withColumn("_judged", judge("text")).select(
        *(F.col(f"`{c}`") for c in docs.columns), F.col("_judged.lang_pred"), F.col("_judged.score"))


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row of ``docs(doc_id, text, lang)``.

    Extra columns are not read; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(rows, fit(docs)).drop("text")


#: Least share of n-grams that the two best languages know, and least odds of the two against the third best.
KNOWN, AHEAD = 0.5, 2.5


def known_language(docs: DataFrame) -> DataFrame:
    """The rows whose text the two best languages know and stand out for, all columns kept.

    Rows without a letter go, and all do if the model knows no language.
    """
    model = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.intercepts, model.known))

    @F.pandas_udf("boolean")
    def recognised(texts):
        import pandas

        judge, letter = Model(*shared.value), kept("letters", letters)
        found = (judge.evidence(t, letter) for t in texts)
        return pandas.Series([share >= KNOWN and odds >= AHEAD for share, odds in found], dtype=bool)

    return docs.where(recognised("text"))
