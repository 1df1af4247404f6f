"""Ranked lexical search with bag de-duplication.

Documents are restricted to the vocabulary of the items. Those with the same
term frequencies and the same length norm score alike for every item, so they
form one class: found by a hash, verified by comparing the vectors themselves,
scored once, and expanded by ascending id. A task keeps the best of each item
only, and the best of the tasks are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coursemill.sources.staging import stage

BEST = 10
#: Share of the length norm that follows the document's length, in hundredths, and the weight of the norm.
LENGTH, NORM = 75, 8
#: About so many bytes of different item texts are searched for at once; more of them take another pass over the documents.
BLOCK = 8 << 20
#: Scores held at once, and candidates a task gathers before it keeps the best of each item.
CELLS, GATHERED = 1 << 21, 1 << 19
#: Every byte that is no part of a term becomes a blank, A to Z become small; bytes beyond ASCII are parts of terms.
BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII, in order; of A to Z only the case is changed."""
    return (text or b"").translate(BYTES).split()


def _raw(column: str = "text"):
    return F.col(column).cast("binary")


def vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``(doc_id, n, at, tf)`` of every row: its number of terms, and the numbers and counts of those in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}
        for batch in batches:
            sizes, ats, tfs = [], [], []
            for text in batch.column(1):
                found = terms(text.as_py())
                at, tf = np.unique(np.array([i for i in map(number.get, found) if i is not None], "<u4"), return_counts=True)
                sizes.append(len(found))
                ats.append(at.tobytes())
                tfs.append(tf.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ats, pa.binary()), pa.array(tfs, pa.binary())],
                ["doc_id", "n", "at", "tf"])

    return docs.select(F.col("doc_id").cast("long"), _raw()).mapInArrow(run, "doc_id long, n long, at binary, tf binary")


def frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """Number of rows that hold each of the ``size`` terms; every task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    counted = rows.select("at").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(size, np.int64)
    for term, n in counted.collect():  # at most one row for each term of the vocabulary
        df[term] = n
    return df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2 N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def classes(rows: DataFrame, n_docs: int, n_terms: int, best: int) -> DataFrame:
    """``(m, at, tf, ids, nameless)``: one row for each different vector and norm, with its ``best`` smallest ids.

    ``nameless`` counts rows without an id, at most ``best``. The hash places and
    sorts the rows, the vectors themselves decide; of a large class every task
    hands on no more than ``best`` rows.
    """
    wide = "CAST({} AS DECIMAL(19, 0))".format
    m = f"{100 - LENGTH}L + ({LENGTH} * {wide('n')} * {wide(f'{n_docs}L')}) div {wide(f'{n_terms}L')}"
    keyed = rows.where("length(at) > 0").select("doc_id", F.expr(m).alias("m"), "at", "tf").withColumn("h", F.xxhash64("m", "at", "tf"))
    same = ["h", "m", "at", "tf"]
    order = Window.partitionBy(*same).orderBy(F.col("doc_id").asc_nulls_last())
    first = keyed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= best)
    return first.groupBy(*same).agg(
        F.array_sort(F.collect_list("doc_id")).alias("ids"), F.count_if(F.col("doc_id").isNull()).alias("nameless")).drop("h")


def best_of(item: np.ndarray, score: np.ndarray, nameless: np.ndarray, doc: np.ndarray, best: int) -> np.ndarray:
    """Places of the ``best`` candidates of each item: highest score, then smallest id, those without an id last."""
    order = np.lexsort((doc, nameless, -score, item))
    ranked = item[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(ranked)])
    return order[np.arange(len(ranked)) - np.repeat(starts, sizes) < best]


def scored(classed: DataFrame, weight: np.ndarray, postings: tuple[np.ndarray, np.ndarray, np.ndarray], items: int, best: int) -> DataFrame:
    """``(item, score, doc_id)``: the best of each item in every task.

    ``postings``: where the items of each term start, their numbers, and how
    often each holds the term.
    """
    shared = classed.sparkSession.sparkContext.broadcast((weight, *postings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, starts, holder, times = shared.value
        least = np.ones(items, np.int64)  # a score must be above 0, later as high as the last one kept
        held = [np.zeros(0, np.int64)] * 4

        def score(m: np.ndarray, ats: list[bytes], tfs: list[bytes]) -> np.ndarray:
            at, tf = np.frombuffer(b"".join(ats), "<u4").astype(np.int64), np.frombuffer(b"".join(tfs), "<i8")
            row = np.repeat(np.arange(len(ats)), [len(a) // 4 for a in ats])
            part = weight[at] * ((1_000_000_000 * tf) // (1000 * tf + NORM * m[row]))
            size = starts[at + 1] - starts[at]
            place = np.arange(size.sum()) + np.repeat(starts[at] - np.cumsum(size) + size, size)
            total = np.zeros(len(ats) * items, np.int64)
            np.add.at(total, np.repeat(row, size) * items + holder[place], np.repeat(part, size) * times[place])
            return total.reshape(len(ats), items)

        for batch in batches:
            m, ats, tfs, ids, nameless = (c.to_pylist() for c in batch.columns)
            for start in range(0, len(m), step := max(CELLS // max(items, 1), 1)):
                part = slice(start, start + step)
                total = score(np.array(m[part], np.int64), ats[part], tfs[part])
                row, item = np.nonzero(total >= least)
                value = total[row, item]
                members = [len(i) + n for i, n in zip(ids[part], nameless[part], strict=True)]
                docs = np.array([x for i, n in zip(ids[part], nameless[part], strict=True) for x in (*i, *[0] * n)], np.int64)
                without = np.array([x for i, n in zip(ids[part], nameless[part], strict=True) for x in (*[0] * len(i), *[1] * n)], np.int64)
                size, first = np.array(members)[row], (np.cumsum(members) - members)[row]
                place = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
                new = (np.repeat(item, size), np.repeat(value, size), without[place], docs[place])
                held = [np.concatenate([a, b]) for a, b in zip(held, new, strict=True)]
                if len(held[0]) > max(GATHERED, 2 * best * items):
                    top = best_of(*held, best)
                    held = [a[top] for a in held]
                    full = np.bincount(held[0], minlength=items) >= best
                    lowest = np.full(items, np.iinfo(np.int64).max)
                    np.minimum.at(lowest, held[0], held[1])
                    least = np.where(full, lowest, least)
        top = best_of(*held, best)
        item, value, without, docs = (a[top] for a in held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(value), pa.array(docs, mask=without > 0)], ["item", "score", "doc_id"])

    return classed.select("m", "at", "tf", "ids", "nameless").mapInArrow(run, "item long, score long, doc_id long")


def _block(docs: DataFrame, texts: list[tuple[str, bytes]], best: int) -> DataFrame:
    """``(version, rank, doc_id, score)`` of the best documents for each of the ``(version, text)`` items."""
    bags = [terms(t) for _, t in texts]
    vocabulary = sorted({t for bag in bags for t in bag})
    number = {t: i for i, t in enumerate(vocabulary)}
    rows = stage(vectors(docs, vocabulary), "vectors")
    n_docs, n_terms = rows.agg(F.count_if(F.expr("n > 0")), F.coalesce(F.sum("n"), F.lit(0))).first()
    pairs = [np.unique([number[t] for t in bag], return_counts=True) for bag in bags]
    term = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in pairs)]).astype(np.int64)
    holder = np.repeat(np.arange(len(bags)), [len(p[0]) for p in pairs])
    times = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in pairs)]).astype(np.int64)
    by_term = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[by_term], np.arange(len(vocabulary) + 1))
    df = frequencies(rows, len(vocabulary))
    found = scored(classes(rows, n_docs, max(n_terms, 1), best), weights(n_docs, df),
                   (starts, holder[by_term], times[by_term]), len(bags), best)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    names = docs.sparkSession.createDataFrame([(i, v) for i, (v, _) in enumerate(texts)], "item long, version string")
    return ranked.join(names, "item").select("version", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``best`` documents of ``docs(doc_id, text)`` for every row of ``items(item_id, text)``.

    Only scores above 0 count; equal ones go by ascending ``doc_id``, a null id
    last. Every row of ``docs`` is a document of its own, also where an id or a
    text is repeated; every row of ``items`` is searched for, and rows with equal
    texts are searched for once. Null texts have no terms. Extra columns are not
    read. An empty table on either side gives no rows.

    The items are searched in blocks of about ``BLOCK`` bytes of different texts,
    which bounds what is broadcast and takes one pass over the documents each.
    """
    spark = docs.sparkSession
    asked = items.select("item_id", F.sha2(_raw(), 256).alias("version"), _raw().alias("text")).where("text IS NOT NULL")
    texts = stage(asked.groupBy("version").agg(F.first("text").alias("text")), "items")
    size = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-size // BLOCK)
    found = spark.createDataFrame([], "version string, rank int, doc_id long, score long")
    for block in range(blocks):
        part = texts.where(F.pmod(F.xxhash64("version"), F.lit(blocks)) == block).collect()
        if part:
            found = found.unionByName(stage(_block(docs, [(r.version, bytes(r.text)) for r in part], best), "ranked"))
    return asked.select("item_id", "version").join(found, "version").select("item_id", "rank", "doc_id", "score")
