"""Token sequences of a fixed length, packed by bounded-space online best-fit.

Documents are tokenised, ended by id 0, and cut only where longer than a
sequence. Pieces are dealt out evenly and each task packs its own with a fixed
number of open bins, kept in a bitset by free space, so the fullest bin that
still takes a piece is one shift and one lowest-bit away.
"""

from __future__ import annotations

import array
import os
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.llm.worker import kept
from coursemill.sources.staging import stage

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 2048
END_ID = 0
#: Open bins of a task.
OPEN_BINS = 8192
#: Pieces a task packs, about; its last open bins are the only ones not offered to others.
TASK_PIECES = 50_000
#: Words a worker remembers; then it starts anew.
WORDS = 400_000


#: A stop or comma between a letter and white space is a token of its own, so it can be parted from its word.
LONE_MARK = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿ])([.,])(?=[ \n]|$)")
#: Words whose lower case and composed form are the same in every library.
LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """How the vocabulary spells the letters of ``LATIN``: one printable character for each UTF-8 byte.

    Printable Latin-1 bytes stand for themselves, the others for U+0100 and up in order.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spelt = {b: chr(b) for b in plain}
    spelt |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in spelt)}
    return {c: "".join(spelt[b] for b in chr(c).encode()) for c in range(192, 256)}


class Words:
    """Ids of texts, each word encoded once while remembered.

    The vocabulary's tokens never span white space, so a text's ids are those of
    its parts between spaces, line ends and tabs in order. Words of Latin letters
    are lower-cased and go straight to the merges, the rest takes the whole way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.spelling = byte_letters()
        self.known: dict[str, bytes] = {"": b""}

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        apart = LONE_MARK.sub(r" \1", text)
        words = apart.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        if len(self.known) > WORDS:
            self.known = {"": b""}
        new = [w for w in set(words) if w not in self.known]
        other = []
        for word in new:
            if LATIN.fullmatch(word):
                spelt = word.lower() if word.isascii() else word.lower().translate(self.spelling)
                self.known[word] = array.array("I", [t.id for t in self.merge(spelt)]).tobytes()
            else:
                other.append(word)
        if other:
            for word, coded in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
                self.known[word] = array.array("I", coded.ids).tobytes()
        return b"".join(map(self.known.__getitem__, words))


def pieces(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids)``; ``ids`` are little-endian unsigned 32-bit.

    A null text counts as empty, whose only id is the end id. Repeated rows give
    their pieces again; a null ``doc_id`` stays null; extra columns are not read.
    """
    end, width = np.array([END_ID], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(f"words {path}", lambda: Words(path))
        for batch in batches:
            doc_ids, rows = batch.column(0).to_pylist(), []
            for doc_id, text in zip(doc_ids, batch.column(1), strict=True):
                ids = words.ids(text.as_py() or "") + end
                rows += [(doc_id, n, n * capacity, min(width, len(ids) - at) // 4, ids[at : at + width])
                         for n, at in enumerate(range(0, len(ids), width))]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids"])

    schema = "doc_id long, piece int, start long, length long, ids binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def best_fit(lengths: Iterable[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> Iterator[tuple[int, int]]:
    """``(bin, offset)`` of each piece in turn.

    A piece goes to the open bin with the least free space that takes it; where
    none does, a bin is opened, and of ``open_bins`` the fullest closes first.
    """
    free_sizes, bins_of = 0, defaultdict(list)  # bit f is set if a bin with f free is open
    opened = is_open = 0
    for length in lengths:
        fitting = free_sizes >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            here = bins_of[free].pop()
            if not bins_of[free]:
                free_sizes ^= 1 << free
            is_open -= 1
        else:
            here, free, opened = opened, capacity, opened + 1
            if is_open >= open_bins:
                fullest = (free_sizes & -free_sizes).bit_length() - 1
                bins_of[fullest].pop()
                if not bins_of[fullest]:
                    free_sizes ^= 1 << fullest
                is_open -= 1
        yield here, capacity - free
        left = free - length
        if left:
            bins_of[left].append(here)
            free_sizes |= 1 << left
            is_open += 1


def pack(parts: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``; ``length`` of at most ``capacity`` is its only column that is read.

    Pieces are dealt round-robin to tasks of about ``TASK_PIECES``, whatever
    their ids, so that no document, source or repeated row fills one task. A task
    takes them longest first, in an order that a repeated run gives again.
    """
    tasks = -(-max(parts.count(), 1) // TASK_PIECES)
    columns = parts.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 40
        waiting: list[int] = []

        def lengths() -> Iterator[int]:
            while True:
                yield from waiting.pop()

        places = best_fit(lengths(), capacity, open_bins)
        for batch in batches:
            waiting.append(batch["length"].tolist())
            found = [next(places) for _ in range(len(batch))]
            yield batch.assign(
                sequence_id=np.array([first + b for b, _ in found], np.int64),
                offset=np.array([o for _, o in found], np.int64))

    dealt = parts.repartition(tasks).sortWithinPartitions(F.desc("length"), F.xxhash64(*columns), *columns)
    kinds = ", ".join(f"`{c}` {k}" for c, k in parts.dtypes)
    return dealt.mapInPandas(run, f"{kinds}, sequence_id long, offset long")


def packed(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Where each piece goes: ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``.

    Every row of ``docs(doc_id, text)`` is packed whole; offsets of a sequence
    run from 0 without gaps. An empty table gives no rows.
    """
    cut = pieces(docs, path).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(stage(cut, "pieces"))


def sequences(parts: DataFrame, placed: DataFrame) -> DataFrame:
    """``(sequence_id, ids, doc_ids)``: the tokens of every sequence, from ``pieces`` and ``pack`` over unique ids."""
    row = F.struct("offset", "doc_id", "ids")
    joined = placed.select("doc_id", "piece", "sequence_id", "offset").join(parts, ["doc_id", "piece"])
    return joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(row)).alias("rows")).select(
        "sequence_id",
        F.aggregate("rows", F.lit(b""), lambda whole, r: F.concat(whole, r["ids"])).alias("ids"),
        F.col("rows.doc_id").alias("doc_ids"))
