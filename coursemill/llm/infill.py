"""Fill-in-middle transformation by secondary-sort assembly.

Texts are cut into prefix, middle and suffix and emitted as pieces of bounded
length, keyed by document and output position. One repartition by document with
a sort inside the partitions brings the pieces of every output in order, so that
a task streams them, whatever their number, into an incremental digest. The
outputs are read again piece by piece, the sentinels found in them give every
piece its place in the text, and a second sort of the same partitions streams
the restored texts. No task holds a whole text after it is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Sentinels in output order, and where the part after each stands in the text.
ORDER = {"plain": "", "psm": PREFIX + SUFFIX + MIDDLE, "spm": SUFFIX + PREFIX + MIDDLE}
TEXT_ORDER = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
#: Texts in a hundred that stay plain, and transformed ones in a hundred with the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Code points of a piece.
UNITS = 1 << 15
#: Documents a task remembers to have cut; rows that repeat one of them add to its count only.
REMEMBERED = 200_000
#: Copies of a row that one result row stands for before it is repeated.
REPEATED = 10_000

KEY = ["doc_id", "version"]
HEAD = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "times": pa.int64()}
PIECES = {"doc_id": pa.int64(), "version": pa.binary(), "place": pa.int64(), "body": pa.string(), **HEAD}
PARTS = {**PIECES, "output_sha256": pa.string()}
DIGESTS = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(),
           "output_sha256": pa.string(), "restored_sha256": pa.string(), "times": pa.int64()}
TEXTS = {"doc_id": pa.int64(), "form": pa.string(), "output": pa.string(), "times": pa.int64()}


def plan(doc_id: int | None, text: str, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> tuple[str, int, int]:
    """Form, and the units before the middle and before the suffix.

    All is drawn from the digest of the id; a null id counts as empty.
    """
    digest = hashlib.sha256(b"1:" if doc_id is None else b"1:%d" % doc_id).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    first, last = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(s in text for s in TEXT_ORDER) or h3 % 100 >= 100 - plain:
        return "plain", first, last
    return "spm" if h4 % 100 < suffix_first else "psm", first, last


def output_pieces(text: str, form: str, first: int, last: int) -> Iterator[str]:
    """The output in order, cut into pieces of at most ``UNITS`` code points; sentinels are pieces of their own."""
    ends = {PREFIX: (0, first), MIDDLE: (first, last), SUFFIX: (last, len(text))}
    order = ORDER[form]
    for at in range(0, max(len(order), 1), 3):
        start, end = ends[order[at : at + 3]] if order else (0, len(text))
        if order:
            yield order[at : at + 3]
        for unit in range(start, end, UNITS):
            yield text[unit : min(unit + UNITS, end)]


class Reader:
    """Reads an output piece by piece: what is text, and in which of the parts of the original it stands."""

    def __init__(self, form: str):
        order = ORDER[form]
        self.ahead = [order[i : i + 3] for i in range(0, len(order), 3)]
        self.part, self.open = 0, ""

    def read(self, piece: str) -> Iterator[tuple[int, str]]:
        """``(part, text)`` of what is certain by now; a sentinel may be cut by the end of the piece."""
        self.open += piece
        while self.ahead and (at := self.open.find(self.ahead[0])) >= 0:
            yield self.part, self.open[:at]
            sentinel = self.ahead.pop(0)
            self.part, self.open = TEXT_ORDER[sentinel], self.open[at + len(sentinel) :]
        sure = max(len(self.open) - (len(PREFIX) - 1 if self.ahead else 0), 0)
        yield self.part, self.open[:sure]
        self.open = self.open[sure:]

    def rest(self) -> tuple[int, str]:
        return self.part, self.open


def _batch(rows: list[dict[str, Any]], schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in schema.items()], list(schema))


def _batches(rows: Iterator[dict[str, Any]], schema: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row.get("body") or row.get("output") or "")
        if size > 1 << 22:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _ddl(schema: dict[str, pa.DataType]) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{c} {names[t]}" for c, t in schema.items())


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[dict[str, Any]]]]:
    """Key and rows of each document of a sorted partition; a place that comes again, from another task, is left out."""
    rows = (dict(zip(b.schema.names, r, strict=True)) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))

    def once(group: Iterator[dict[str, Any]]) -> Iterator[dict[str, Any]]:
        last = None
        for row in group:
            if row["place"] < 0 or row["place"] != last:
                yield row
            last = row["place"]

    for key, group in groupby(rows, lambda r: (r["doc_id"], r["version"])):
        yield key, once(group)


def _head(rows: Iterator[dict[str, Any]]) -> tuple[dict[str, Any], Iterator[dict[str, Any]]]:
    """What the first rows say of a document, and the rows of its pieces."""
    head: dict[str, Any] = {}
    for row in rows:
        if row["place"] >= 0:
            def pieces(first=row):
                yield first
                yield from rows

            return head, pieces()
        times = head.get("times", 0) + row["times"]
        head = {**row, "times": times}
    return head, iter(())


def pieces(docs: DataFrame, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Pieces of all outputs in order: ``(doc_id, version, place, body, ...)``, documents whole within partitions.

    ``version`` is a 128-bit digest of the text, which tells rows of one id apart;
    a document's first row, at place -1, holds form, lengths and the number of
    equal rows. Rows that repeat id and text are cut once in a task.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict[str, Any]]:
            heads: dict[tuple, dict[str, Any]] = {}
            for batch in batches:
                for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    text = text or ""
                    key = (doc_id, xxhash.xxh3_128_digest(text))
                    if key in heads:
                        heads[key]["times"] += 1
                        continue
                    if len(heads) >= REMEMBERED:
                        yield from heads.values()
                        heads.clear()
                    form, first, last = plan(doc_id, text, plain, suffix_first)
                    same = {"doc_id": doc_id, "version": key[1]}
                    whole = form == "plain"
                    heads[key] = {**same, "place": -1, "n": len(text), "form": form, "times": 1,
                                  "prefix_chars": None if whole else first, "middle_chars": None if whole else last - first}
                    for place, body in enumerate(output_pieces(text, form, first, last)):
                        yield {**same, "place": place, "body": body}
            yield from heads.values()

        return _batches(rows(), PIECES)

    cuts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, _ddl(PIECES))
    return cuts.repartition(*KEY).sortWithinPartitions(*KEY, "place")


def _stream(sorted_pieces: DataFrame, make: Callable, schema: dict[str, pa.DataType]) -> DataFrame:
    """One call of ``make(key, head, pieces)`` for each document; it yields rows of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict[str, Any]]:
            for (doc_id, version), group in _documents(batches):
                head, body = _head(group)
                for row in make(head, body):
                    yield {"doc_id": doc_id, "version": version, **row}

        return _batches(rows(), schema)

    return sorted_pieces.mapInArrow(run, _ddl(schema))


def _often(rows: DataFrame) -> DataFrame:
    """Every row as often as ``times`` says; many copies are dealt out first, so none makes a long array."""
    shares = F.expr(f"transform(sequence(0L, (times - 1) div {REPEATED}), x -> least(times - x * {REPEATED}, {REPEATED}L))")
    return rows.withColumn("times", F.explode(shares)).withColumn("times", F.explode(F.expr("sequence(1L, times)"))).drop("times")


def outputs(docs: DataFrame, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``(doc_id, form, output)``: the transformed text of every row of ``docs(doc_id, text)``.

    A null text counts as empty, a null id as an empty one; both give a row.
    Repeated rows come back as often as given, rows of one id with different
    texts each on their own. Extra columns are not read. An empty table gives
    no rows.
    """

    def whole(head: dict[str, Any], body: Iterator[dict[str, Any]]) -> Iterator[dict[str, Any]]:
        yield {"form": head["form"], "times": head["times"], "output": "".join(p["body"] for p in body)}

    return _often(_stream(pieces(docs, plain, suffix_first), whole, TEXTS))


def restored_parts(sorted_pieces: DataFrame) -> DataFrame:
    """Pieces of all texts in order, with the digest of each output in the first row of its document.

    Places come from the outputs and their forms alone. The documents stay in
    their partitions, which are only sorted anew.
    """

    def take_apart(head: dict[str, Any], body: Iterator[dict[str, Any]]) -> Iterator[dict[str, Any]]:
        digest, reader, number = hashlib.sha256(), Reader(head["form"]), 0

        def placed(part: int, text: str) -> Iterator[dict[str, Any]]:
            nonlocal number
            if text:
                yield {"place": part << 56 | number, "body": text}
                number += 1

        for piece in body:
            digest.update(piece["body"].encode())
            for part, text in reader.read(piece["body"]):
                yield from placed(part, text)
        yield from placed(*reader.rest())
        yield {**{c: head[c] for c in HEAD}, "place": -1, "output_sha256": digest.hexdigest()}

    return _stream(sorted_pieces, take_apart, PARTS).sortWithinPartitions(*KEY, "place")


def digests(docs: DataFrame, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)`` of every row of ``docs``.

    Rows as in ``outputs``. The lengths are code points, null for plain texts;
    ``restored_sha256`` is that of the text rebuilt from the output and its form.
    """

    def rebuilt(head: dict[str, Any], body: Iterator[dict[str, Any]]) -> Iterator[dict[str, Any]]:
        digest = hashlib.sha256()
        for piece in body:
            digest.update(piece["body"].encode())
        yield {**head, "restored_sha256": digest.hexdigest()}

    return _often(_stream(restored_parts(pieces(docs, plain, suffix_first)), rebuilt, DIGESTS))
