"""SentencePiece encoding and decoding.

Encoding is the best segmentation of a text into vocabulary pieces by the sum of
their scores (unigram Viterbi, byte fallback for what no piece covers). Words
are encoded once while remembered, and all new words of one length advance
together: a table of substring hashes is looked up among the sorted hashes of
the pieces, and running maxima keep the backpointers.
"""

from __future__ import annotations

import array
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.llm.worker import kept

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Stands for a space; a text begins with one that is not its own.
SPACE = "▁"
#: Penalty of a character without a piece, below the least score of all pieces.
UNKNOWN = 10.0
#: Words a worker remembers; then it starts anew. Words advanced at once, in characters.
WORDS, CHARACTERS = 300_000, 1 << 18
#: Words that are worth advancing together.
TOGETHER = 32
#: Odd multiplier of the running hash.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a hash that say whether any piece has it.
FILTER = 20
#: A text's best segmentation is that of its parts between places that no piece spans. No piece holds a space after
#: another character; the other marks are parted from a letter only where the vocabulary has no piece across.
MARKS = ".,;:!?\n"
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"


class Pieces:
    """A vocabulary, and the words encoded with it."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}
        self.unknown_id = model.unk_id()
        self.widest = max(len(pieces[i]) for i in normal)
        self.powers = np.ones(self.widest + 1, np.uint64)
        for k in range(1, self.widest + 1):
            self.powers[k : k + 1] = self.powers[k - 1 : k] * BASE
        codes = np.zeros((len(normal), self.widest), np.uint32)
        for row, i in enumerate(normal):
            codes[row, : len(pieces[i])] = [ord(c) for c in pieces[i]]
        lengths = np.array([len(pieces[i]) for i in normal])
        hashes = np.zeros(len(normal), np.uint64)
        for k in range(self.widest):
            hashes = np.where(k < lengths, hashes * BASE + codes[:, k], hashes)
        hashes ^= lengths.astype(np.uint64) << np.uint64(58)
        order = np.argsort(hashes, kind="stable")
        # on equal hashes the codes below decide
        self.hashes, self.codes = hashes[order], codes[order]
        self.ids = np.array(normal, np.uint32)[order]
        self.maybe = np.zeros(1 << FILTER, bool)
        self.maybe[self.hashes >> np.uint64(64 - FILTER)] = True
        self.scores = np.array([model.get_score(i) for i in normal], np.float64)[order]
        self.worst = self.scores.min() - UNKNOWN
        self.singles = np.unique(codes[lengths == 1, 0])
        self.bytes_of: list[bytes] = [b""] * n
        for i in normal:
            self.bytes_of[i] = pieces[i].replace(SPACE, " ").encode()
        for value, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([value])
        self.bytes_of[self.unknown_id] = " ⁇ ".encode()
        self.word = self.parts([pieces[i] for i in normal])
        self.known: dict[str, bytes] = {}

    @staticmethod
    def parts(pieces: list[str]) -> re.Pattern:
        """Pattern of the parts of a text that no piece of several characters reaches out of."""
        joined = {a + b for p in pieces for a, b in zip(p, p[1:], strict=False)}
        letter = re.compile(f"[{LETTER}]")
        apart = [m for m in MARKS if not any(b == m and letter.match(a) for a, b in joined)]
        alone = [m for m in apart if not any(m in pair for pair in joined)]
        spaces = f"{SPACE}+" if not any(b == SPACE != a for a, b in joined) else ""
        if not spaces:
            return re.compile(r"(?s).+")
        single, mark = re.escape("".join(alone)), re.escape("".join(apart))
        words = f"{SPACE}*[{LETTER}]+(?=[{mark}])|" if apart else ""
        ends = f"[{single}]|" if alone else ""
        return re.compile(f"{words}{ends}{spaces}[^{SPACE}{single}]*|[^{SPACE}{single}]+")

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts = [self.word.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > WORDS:
            self.known = {}
        new = defaultdict(list)
        for word in set().union(*parts):
            if word not in self.known:
                new[len(word)].append(word)
        for length, words in new.items():
            at_once = max(1, CHARACTERS // length)
            for i in range(0, len(words), at_once):
                some = words[i : i + at_once]
                self.known.update(zip(some, self.viterbi(some, length), strict=True))
        return [b"".join(map(self.known.__getitem__, p)) for p in parts]

    def look_up(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(word, start, end, row)`` of all pieces in the words, and row -1 for characters without a piece."""
        length = codes.shape[1]
        hashes = np.zeros((len(codes), length + 1), np.uint64)
        for k in range(length):
            hashes[:, k + 1] = hashes[:, k] * BASE + codes[:, k]
        found = []
        for size in range(1, min(self.widest, length) + 1):
            wanted = (hashes[:, size:] - hashes[:, :-size] * self.powers[size]).ravel() ^ (np.uint64(size) << np.uint64(58))
            place = np.flatnonzero(self.maybe[wanted >> np.uint64(64 - FILTER)])
            wanted = wanted[place]
            row = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
            hit = self.hashes[row] == wanted
            row, (word, start) = row[hit], np.divmod(place[hit], length - size + 1)
            same = (self.codes[row, :size] == codes[word[:, None], start[:, None] + np.arange(size)]).all(axis=1)
            found.append((word[same], start[same], start[same] + size, row[same]))
        word, start = np.nonzero(~np.isin(codes, self.singles))
        found.append((word, start, start + 1, np.full(len(word), -1)))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def viterbi(self, words: list[str], length: int) -> list[bytes]:
        """Ids of words of one length."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, length)
        count = len(words)
        word, start, end, row = self.look_up(codes)
        # by end, then from the longest piece on; of equal sums the first, that is the longest last piece, stays
        order = np.lexsort((start, end))
        word, start, end, row = word[order], start[order], end[order], row[order]
        score = np.where(row >= 0, self.scores[row], self.worst)
        if count < TOGETHER:
            return self.one_by_one(words, length, word, start, end, row, score)
        best = np.full((length + 1, count), -np.inf)
        best[0] = 0
        came = np.zeros((length + 1, count), np.int32)
        piece = np.full((length + 1, count), -1, np.int32)
        edges = np.flatnonzero(np.diff(end * (length + 1) + start, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            s, e, w = start[a], end[a], word[a:b]
            sums = best[s, w] + score[a:b]
            better = sums > best[e, w]
            w = w[better]
            best[e, w], came[e, w], piece[e, w] = sums[better], s, row[a:b][better]
        return [self.backtrack(w, c, p) for w, c, p in zip(words, came.T.tolist(), piece.T.tolist(), strict=True)]

    def one_by_one(self, words, length, *hits) -> list[bytes]:
        """The same for few words, which may be very long."""
        best = [[0.0] + [-np.inf] * length for _ in words]
        came, piece = [[0] * (length + 1) for _ in words], [[-1] * (length + 1) for _ in words]
        for w, s, e, row, score in zip(*(h.tolist() for h in hits), strict=True):
            total = best[w][s] + score
            if total > best[w][e]:
                best[w][e], came[w][e], piece[w][e] = total, s, row
        return [self.backtrack(w, c, p) for w, c, p in zip(words, came, piece, strict=True)]

    def backtrack(self, word: str, came: list[int], piece: list[int]) -> bytes:
        out, end = [], len(word)
        while end:
            row = piece[end]
            if row >= 0:
                out.append(int(self.ids[row]))
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(word[end - 1].encode("utf-8", "surrogatepass"))]
            else:
                out.append(self.unknown_id)
            end = came[end]
        return array.array("I", reversed(out)).tobytes()

    def text_of(self, ids: bytes) -> str:
        """The text of the ids; bytes that form no character become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``(doc_id, ids)`` of every row of ``docs(doc_id, text)``; ids are little-endian unsigned 32-bit.

    A null or empty text has no ids. Repeated rows come back as often as given, a
    null id stays null, extra columns are not read, an empty table gives no rows.
    Of segmentations with equal sums the one with the longest last piece wins,
    word by word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept(f"pieces {path}", lambda: Pieces(path))
        for batch in batches:
            ids = pieces.ids_of([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``(doc_id, ids, text)`` of every row of ``encoded(doc_id, ids)``.

    The inverse of ``encode`` for texts without U+2581, which stands for a space
    in the vocabulary. Null ids count as none; their text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept(f"pieces {path}", lambda: Pieces(path))
        for batch in batches:
            texts = [pieces.text_of(i or b"") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, ids binary, text string")
