"""Line de-duplication by a segment-partition edit join.

A line within ``edits`` edits of another holds, unchanged, at least one of the
``edits + 1`` segments the other is split into, at a place that the two lengths
narrow down. Lines are indexed by their segments and probe with the substrings
that can match; a banded bit-parallel automaton verifies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursemill.operators.components import components
from coursemill.sources.staging import Scratch, stage

#: Edits between near copies, and characters from which lines are compared that way; shorter ones match exactly only.
EDITS, NEAR_FROM = 2, 20
#: Lines of an index key whose pairs wait to be verified with those of other keys; and lines of a block of a larger key.
PAIRED, BLOCK = 64, 1024
#: Pairs, and their characters, that wait in a task at most; lines whose group it remembers until it starts anew.
WAITING, WAITING_CHARACTERS, GROUPED = 8192, 1 << 23, 500_000
#: Lines a task remembers to have given keys for; it starts anew beyond that.
REMEMBERED = 500_000
#: Lines of a block that are compared with the others at once.
TOGETHER = 32
#: Characters of the lines that are verified at once, padding included.
CHARACTERS = 1 << 22


def segments(n: int, edits: int) -> list[tuple[int, int]]:
    """Start and length of ``edits + 1`` even segments of a line of ``n`` characters, longer ones last."""
    count = edits + 1
    size, longer = divmod(n, count)
    out, at = [], 0
    for i in range(count):
        length = size + (i >= count - longer)
        out.append((at, length))
        at += length
    return out


def probes(n: int, edits: int) -> list[tuple[int, int, int, bool]]:
    """``(seed, start, end, own)`` of the substrings to look up for a line of ``n`` characters.

    ``own`` marks the line's own segments, which are also what it is indexed by.
    The seed holds the indexed length and the segment number. Looked up are the
    places where a segment of a line as long or up to ``edits`` shorter can be
    found with the errors to its left and right not exceeding ``edits``.
    """
    out = []
    for length in range(max(n - edits, NEAR_FROM), n + 1):
        shift = n - length
        for i, (start, size) in enumerate(segments(length, edits)):
            left, right = i, edits - i
            first = max(start - left, start + shift - right, 0)
            last = min(start + left, start + shift + right, n - size)
            for at in range(first, last + 1):
                out.append((length << 8 | i, at, at + size, shift == 0 and at == start))
    return out


def within(ones: list[str], others: list[str], edits: int) -> np.ndarray:
    """Whether the edit distance of each pair is at most ``edits``.

    For each number of errors a bit set holds the diagonals that the automaton
    can be on; only ``2 * edits + 1`` diagonals matter. All pairs advance
    together, shorter texts leave first, and so do pairs without a live state.
    """
    result = np.zeros(len(ones), bool)
    sizes = np.array([[len(a), len(b)] for a, b in zip(ones, others, strict=True)]).reshape(-1, 2)
    near = np.flatnonzero(np.abs(sizes[:, 0] - sizes[:, 1]) <= edits)
    near = near[np.argsort(sizes[near, 0], kind="stable")]
    start = 0
    while start < len(near):
        end, wide = start + 1, int(sizes[near[start], 0]) + 2 * edits + 1
        while end < len(near) and (end + 1 - start) * (int(sizes[near[end], 0]) + 2 * edits + 1) <= CHARACTERS:
            wide = int(sizes[near[end], 0]) + 2 * edits + 1
            end += 1
        rows = near[start:end]
        result[rows] = _advance([ones[r] for r in rows], [others[r] for r in rows], sizes[rows], wide, edits)
        start = end
    return result


def _codes(strings: list[str], wide: int) -> np.ndarray:
    """Code points plus one, a row for each string, filled up with zeros; a string that comes often is read once."""
    place: dict[str, int] = {}
    rows = [place.setdefault(s, len(place)) for s in strings]
    codes = np.zeros((len(place), wide), np.uint32)
    for row, s in enumerate(place):
        s = s[:wide]
        codes[row, : len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4") + 1
    return codes[rows]


def _advance(texts: list[str], patterns: list[str], sizes: np.ndarray, wide: int, edits: int) -> np.ndarray:
    count, band = len(texts), 2 * edits + 1
    text = _codes(texts, wide)
    pattern = np.pad(_codes(patterns, wide + edits), ((0, 0), (edits, 0)))
    full = np.uint32((1 << band) - 1)
    states = [np.full(count, 1 << edits, np.uint32)]
    for _ in range(edits):
        states.append((states[-1] | states[-1] << np.uint32(1)) & full)
    rows, done = np.arange(count), np.zeros(count, bool)
    goal = np.uint32(1) << (sizes[:, 1] - sizes[:, 0] + edits).astype(np.uint32)
    at = 0
    while len(rows):
        over = int(np.searchsorted(sizes[rows, 0], at, "right"))
        if over:  # these texts are read to their end
            reached = states[0][:over]
            for s in states[1:]:
                reached = reached | s[:over]
            done[rows[:over]] = (reached & goal[rows[:over]]) != 0
            rows, states = rows[over:], [s[over:] for s in states]
            continue
        letter = text[rows, at]
        same = np.zeros(len(rows), np.uint32)
        for k in range(band):
            same |= (pattern[rows, at + k] == letter).astype(np.uint32) << np.uint32(k)
        new = [states[0] & same]
        for e in range(1, edits + 1):
            new.append((states[e] & same | states[e - 1] | states[e - 1] >> np.uint32(1) | new[-1] << np.uint32(1)) & full)
        states = new
        at += 1
        if at % 8 == 0:
            alive = states[0] != 0
            for s in states[1:]:
                alive |= s != 0
            if not alive.all():
                rows, states = rows[alive], [s[alive] for s in states]
    return done


def _version():
    """Digest of the text, which tells the texts of one id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _texts_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, version, text)``; null texts are empty."""
    return docs.select(F.col("doc_id").cast("long"), _version().alias("version"), F.coalesce("text", F.lit("")).alias("text"))


def occurrences(docs: DataFrame) -> DataFrame:
    """``(doc_id, version, pos, line, n)`` of every line that is not blank.

    ``version`` is a digest of the text, so rows of one id with different texts
    are told apart; ``line`` is a 16-byte digest of the line, ``n`` its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, version, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for pos, line in enumerate(text.split("\n")):
                    if line and not line.isspace():
                        for column, value in zip(out, (doc_id, version, pos, xxhash.xxh3_128_digest(line), len(line)), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "version", "pos", "line", "n"])

    schema = "doc_id long, version long, pos int, line binary, n int"
    return _texts_of(docs).mapInArrow(run, schema)


def keys(docs: DataFrame, edits: int) -> DataFrame:
    """``(key, h, own)``: index and probe keys of the lines long enough; ``h`` is the first half of the line's digest.

    A line that comes again in the same task gives its keys once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        plans: dict[int, list] = {}
        for batch in batches:
            key, owner, own = [], [], []
            for text in batch.column(0).to_pylist():
                for line in text.split("\n"):
                    n = len(line)
                    if n < NEAR_FROM or line.isspace():
                        continue
                    h = int.from_bytes(xxhash.xxh3_128_digest(line)[:8], "big", signed=True)
                    if h in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(h)
                    plan = plans.get(n)
                    if plan is None:
                        plan = plans[n] = probes(n, edits)
                    for seed, start, end, mine in plan:
                        key.append(xxhash.xxh64_intdigest(line[start:end], seed))
                        own.append(mine)
                    owner += [h] * len(plan)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(owner, pa.int64()), pa.array(own, pa.bool_())],
                ["key", "h", "own"])

    return _texts_of(docs).select("text").mapInArrow(run, "key long, h long, own boolean")


class Linker:
    """Links the lines of one key after the other; no link is given within lines that a task has connected already."""

    def __init__(self, edits: int):
        self.edits = edits
        self.parent: dict[bytes, bytes] = {}
        self.waiting: dict[tuple[bytes, bytes], tuple[str, str]] = {}
        self.characters = 0

    def root(self, line: bytes) -> bytes:
        while (up := self.parent.setdefault(line, line)) != line:
            self.parent[line] = line = self.parent[up]
        return line

    def join(self, one: bytes, other: bytes) -> bool:
        """Whether the two were in different groups."""
        one, other = self.root(one), self.root(other)
        self.parent[other] = one
        return one != other

    def verified(self) -> list[tuple[bytes, bytes]]:
        """Links among the pairs that wait."""
        pairs = [p for p in self.waiting if self.root(p[0]) != self.root(p[1])]
        bodies = [self.waiting[p] for p in pairs]
        good = within([a for a, _ in bodies], [b for _, b in bodies], self.edits)
        found = [p for p, g in zip(pairs, good.tolist(), strict=True) if g and self.join(*p)]
        self.waiting, self.characters = {}, 0
        if len(self.parent) > GROUPED:
            self.parent = {}
        return found

    def links(self, names: list[bytes], bodies: list[str], own: list[bool], block: list[int]) -> Iterator[list[tuple[bytes, bytes]]]:
        """Links of one key, as far as they are sure by now; one line of a pair must own the key.

        With two blocks only their lines meet each other, those of one block meet elsewhere.
        """
        count, edits, two = len(names), self.edits, len(set(block)) > 1
        if count <= PAIRED:
            for i in range(count):
                for j in range(i):
                    if ((own[i] or own[j]) and not (two and block[i] == block[j]) and abs(len(bodies[i]) - len(bodies[j])) <= edits
                            and (names[j], names[i]) not in self.waiting and self.root(names[i]) != self.root(names[j])):
                        self.waiting[names[j], names[i]] = bodies[j], bodies[i]
                        self.characters += len(bodies[i])
            if len(self.waiting) >= WAITING or self.characters >= WAITING_CHARACTERS:
                yield self.verified()
            return
        sizes, owner, place = np.array([len(b) for b in bodies]), np.array(own), np.array(block)
        numbers: dict[bytes, int] = {}
        group = np.array([numbers.setdefault(self.root(n), len(numbers)) for n in names])
        # several lines at once meet all later ones that are not yet of their group
        for start in range(0, count, TOGETHER):
            i, j = (x.ravel() for x in np.meshgrid(np.arange(start, min(start + TOGETHER, count)), np.arange(start, count), indexing="ij"))
            ask = (j > i) & (group[i] != group[j]) & (owner[i] | owner[j]) & (np.abs(sizes[i] - sizes[j]) <= edits)
            if two:
                ask &= place[i] != place[j]
            i, j = i[ask], j[ask]
            hit = within([bodies[x] for x in i], [bodies[x] for x in j], edits)
            found = []
            for x, y in zip(i[hit].tolist(), j[hit].tolist(), strict=True):
                if group[x] != group[y]:
                    found.append((names[x], names[y]))
                    self.join(names[x], names[y])
                    group[group == group[y]] = group[x]
            yield found


def near_links(docs: DataFrame, first: DataFrame, edits: int, tables: Scratch) -> DataFrame:
    """``(a, b)``: links between different lines at most ``edits`` edits apart, enough to connect all such lines.

    ``first(line, doc_id, version, pos)`` is where each different line stands.
    The lines of a key meet in one task, or, if they are many, block by block in
    several. Pairs exist inside tasks only; of a key with n lines less than n
    links come back from each of them.
    """
    # copies of a line from several tasks meet here; what only one line asks for goes no further
    by_key = Window.partitionBy("key")
    asked = keys(docs, edits).repartition("key").groupBy("key", "h").agg(F.max("own").alias("own"))
    shared = tables.stage(
        asked.withColumn("asking", F.count("*").over(by_key)).withColumn("indexed", F.count_if("own").over(by_key))
        .where("asking > 1 AND indexed > 0").drop("indexed"), "keys")
    texts = tables.stage(_texts(docs, first, shared.select("h").distinct()), "texts")
    blocks = f"CAST(ceil(asking / {BLOCK}) AS INT)"
    cells = shared.selectExpr("key", "h", "own", f"{blocks} AS blocks", f"CAST(pmod(h, {blocks}) AS INT) AS block").selectExpr(
        "key", "h", "own", "block",
        "inline(transform(sequence(0, blocks - 1), x -> struct(least(x, block) AS one, greatest(x, block) AS other)))")
    cell = ["key", "one", "other"]
    gathered = cells.join(texts, "h").repartition(*cell).sortWithinPartitions(*cell, "line").select(*cell, "line", "body", "own", "block")

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker = Linker(edits)

        def found() -> Iterator[list[tuple[bytes, bytes]]]:
            rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
            for _, group in groupby(rows, lambda r: r[:3]):
                lines = {r[3]: r[4:] for r in group}
                yield from linker.links(list(lines), *(list(c) for c in zip(*lines.values(), strict=True)))
            yield linker.verified()

        for links in found():
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["a", "b"])

    return gathered.mapInArrow(connect, "a binary, b binary")


def _texts(docs: DataFrame, first: DataFrame, needed: DataFrame) -> DataFrame:
    """``(h, line, body)`` of the needed lines, each read where it first stands."""
    places = first.withColumn("h", _half("line")).join(needed, "h").select("doc_id", "version", "pos", "line", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, version, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for pos, line in enumerate(text.split("\n")):
                    if len(line) >= NEAR_FROM and not line.isspace():
                        for column, value in zip(out, (doc_id, version, pos, line), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "version", "pos", "body"])

    bodies = _texts_of(docs).mapInArrow(run, "doc_id long, version long, pos int, body string")
    same = [bodies[c].eqNullSafe(places[c]) for c in ("doc_id", "version", "pos")]
    return bodies.join(places, same).select("h", "line", "body").dropDuplicates(["line"])


def _half(line: str):
    """First half of a 16-byte digest as a LONG."""
    return F.expr(f"CAST(conv(substr(hex({line}), 1, 16), 16, -10) AS LONG)")


def repeated_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``(doc_id, version, removed)``: numbers (from 0) of the lines of each text that repeat an earlier line.

    Lines are the parts of a text between line feeds. Two lines are copies if
    equal or, from ``NEAR_FROM`` characters on, at most ``edits`` edits apart;
    what copies of copies connect is one class, and its first line by ``doc_id``,
    digest of the text and line number stays. Blank lines are never removed.

    Texts from which nothing goes have no row. Null texts have no lines. Rows
    that repeat id and text are one document; a null id comes first in order.
    """
    place = F.struct("doc_id", "version", "pos")
    with Scratch(docs.sparkSession, "lines") as tables:
        every = tables.stage(occurrences(docs), "lines")
        classes = tables.stage(every.groupBy("line", "n").agg(F.min(place).alias("place"), F.count("*").alias("times")), "classes")
        first = classes.where(f"n >= {NEAR_FROM}").select("line", "place.*")
        roots = components(near_links(docs, first, edits, tables), tables)
        joined = classes.join(roots, classes.line == roots.node, "left").select(
            "line", "place", "times", F.coalesce("root", "line").alias("root"), F.col("root").isNotNull().alias("linked"))
        common = tables.stage(joined.where("times > 1 OR linked"), "common")
        leads = tables.stage(common.groupBy("root").agg(F.min("place").alias("lead")), "leads")
        led = tables.stage(common.join(leads, "root").select("line", "lead"), "led")
        gone = every.join(led, "line").where(~place.eqNullSafe(F.col("lead")))
        return stage(gone.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("pos")).alias("removed")), "removed")


def _with_removed(docs: DataFrame, edits: int, *carried: Column) -> DataFrame:
    """``(_row, _removed)``: of every row what is carried, with the numbers of its removed lines."""
    removed = repeated_lines(docs, edits).select(
        F.col("doc_id").alias("_id"), F.col("version").alias("_of"), F.col("removed").alias("_removed"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), _version().alias("_version"),
                       F.struct(*carried).alias("_row"))
    joined = rows.join(removed, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_version") == F.col("_of")), "left")
    return joined.select("_row", F.coalesce("_removed", F.array().cast("array<int>")).alias("_removed"))


def report(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``(doc_id, n_lines, n_removed, removed)`` of every row of ``docs(doc_id, text)``.

    ``removed``: comma-joined numbers of the removed lines, as in
    ``repeated_lines``. A null text counts as empty, which is one line. Extra
    columns are not read. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    breaks = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    narrow = _with_removed(docs, edits, F.col("doc_id"), (breaks.cast("long") + 1).alias("lines"))
    return narrow.select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_row.lines").alias("n_lines"),
        F.size("_removed").cast("long").alias("n_removed"), F.array_join("_removed", ",").alias("removed"))


def drop_repeated(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``docs`` with the lines of ``repeated_lines`` taken out of ``text``; ``n_chars`` is counted anew where it is a column.

    No row goes: a text of copies only becomes empty; a null text stays null.
    """
    rows = (F.col(f"`{c}`") for c in docs.columns)
    found = _with_removed(docs, edits, *rows).withColumn("_lines", F.split("_row.text", "\n"))
    kept = "array_join(transform(array_except(sequence(0, size(_lines) - 1), _removed), i -> _lines[i]), '\\n')"
    clean = found.withColumn("_text", F.expr(f"IF(_row.text IS NULL OR size(_removed) = 0, _row.text, {kept})"))
    columns = {c: F.col(f"_row.`{c}`") for c in docs.columns} | {"text": F.col("_text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.char_length("_text").cast(dict(docs.dtypes)["n_chars"])
    return clean.select(*(columns[c].alias(c) for c in docs.columns))
