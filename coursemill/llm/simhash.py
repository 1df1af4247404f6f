"""SimHash near-duplicates by a generalised pigeonhole search.

Two fingerprints that differ in at most ``distance`` bits differ, on at least
one of several disjoint bit partitions, in no more bits than that partition's
own threshold, whenever the thresholds plus one add up to ``distance + 1``.
Correlated bits share a partition, and the thresholds are dealt out by dynamic
programming over estimated candidate counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.operators.components import components
from coursemill.sources.staging import Scratch, stage

BITS = 64
SHINGLE = 3
SEED = 42
#: Shingles hashed at once: bounds the memory a very long text needs.
CHUNK = 1 << 16
#: A bucket with more members is linked through shared one-bit neighbours, which costs 65 rows a member, instead of
#: by pairs. Both ways are exact.
PAIRED = 65


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of ``size``-word shingles, repeats included; 0 for null and wordless texts."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles: Iterable[bytes] = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), CHUNK):
        part = hashes[start : start + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(part, axis=1, bitorder="little")
        for block in range(0, len(bits), 255):  # sums of 255 bits fit a byte, which adds many at once
            ones += bits[block : block + 255].sum(axis=0, dtype=np.uint8)
    major = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(major.view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``(doc_id, version, fp)`` of every row of ``docs(doc_id, text)``; ``version`` is a digest of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), size) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], ["doc_id", "version", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), _version().alias("version"), "text")
    return rows.mapInArrow(run, "doc_id long, version long, fp long")


def _version():
    """Digest of the text, which tells the texts of one id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel())], ["at", "n"])

    rows = fps.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BITS * BITS, np.int64)
    for at, n in rows:  # 4,096 rows, whatever the input
        counts[at] = n
    return fps.count(), counts.reshape(BITS, BITS)


def partitions(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits to ``parts`` groups of even size, correlated bits into the same one."""
    share = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    related = np.abs(together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    left, groups = set(range(BITS)), []
    for k in range(parts, 0, -1):
        size = len(left) // k
        group = [min(left, key=lambda b: (-sum(related[b, c] for c in left if c != b), b))]
        left.remove(group[0])
        while len(group) < size:
            nearest = min(left, key=lambda b: (-related[b, group].sum(), b))
            group.append(nearest)
            left.remove(nearest)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost; ``costs[i][t + 1]`` is that of threshold ``t`` (-1: not probed) on part ``i``.

    Dynamic programming over the parts; the thresholds plus one add up to ``distance + 1``.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        ahead: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for step, more in enumerate(row):
                total = used + step
                if total <= distance + 1 and cost + more < ahead.get(total, (np.inf,))[0]:
                    ahead[total] = (cost + more, [*chosen, step - 1])
        best = ahead
    return best.get(distance + 1, (np.inf, []))


def plan(fps: DataFrame, distance: int) -> tuple[list[list[int]], list[int]]:
    """Bit partitions and thresholds with the least estimated number of probes and candidates over all of ``fps``.

    Equal values on a part are counted exactly; the candidates of threshold 1
    follow from them and the odds that two fingerprints differ in each bit.
    """
    n, together = bit_counts(fps)
    share = np.diag(together) / max(n, 1)
    differ = np.clip(2 * share * (1 - share), 0, 0.5)
    choices = [partitions(n, together, m) for m in range(2, distance + 3)]
    flat = [group for groups in choices for group in groups]
    values = F.array(*(F.struct(F.lit(i).alias("part"), _value(g).alias("value")) for i, g in enumerate(flat)))
    pairs = {
        r["part"]: float(r["pairs"])
        for r in fps.select(F.explode(values).alias("x")).groupBy("x").count()
        .groupBy(F.col("x.part").alias("part")).agg(F.sum(F.expr("count * (count - 1.0) / 2")).alias("pairs")).collect()
    }
    costed, first = [], 0
    for groups in choices:
        costs = []
        for i, group in enumerate(groups, first):
            odds = float((differ[group] / (1 - differ[group])).sum())
            same = pairs.get(i, 0.0)
            costs.append([0.0, n + same, n * (2.0 + len(group)) + same * (1 + odds)])
        first += len(groups)
        costed.append((*allocate(costs, distance), groups))
    _, thresholds, groups = min(costed, key=lambda c: c[0])
    return groups, thresholds


def _value(bits: list[int]):
    """The fingerprint with all but these bits cleared."""
    mask = sum(1 << b for b in bits)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask))


def _flips(column: str, bits: Iterable[int]):
    """The value itself and each with one of the bits changed."""
    masks = ", ".join(f"shiftleft(1L, {b})" for b in bits)
    return F.expr(f"concat(array({column}), transform(array({masks}), m -> {column} ^ m))")


def links(fps: DataFrame, tables: Scratch, distance: int = 2) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints, enough to connect all that differ in ``distance`` bits or fewer.

    Small buckets are verified pair by pair. In a bucket with more than
    ``PAIRED`` members every pair would be too many; there each member names
    itself and its 64 one-bit neighbours, and fingerprints that name the same
    value differ in at most two bits, which is exact as well for distance 2.
    No bucket is dropped or cut.
    """
    if distance != 2:
        raise ValueError("the search is built for 2 differing bits")
    groups, thresholds = plan(fps, distance)
    index, probe = [], []
    for i, (group, threshold) in enumerate(zip(groups, thresholds, strict=True)):
        if threshold < 0:
            continue
        value = _value(group)
        index.append(F.struct(F.lit(i).alias("part"), value.alias("value")))
        near = fps.select("fp", value.alias("value")).select("fp", F.lit(i).alias("part"), F.explode(
            _flips("value", group) if threshold else F.array("value")).alias("value"))
        probe.append(near)
    indexed = tables.stage(fps.select("fp", F.explode(F.array(*index)).alias("x")).select("fp", "x.part", "x.value"), "index")
    probes = probe[0]
    for more in probe[1:]:
        probes = probes.unionByName(more)
    sizes = tables.stage(indexed.groupBy("part", "value").count().where("count > 1 OR part IN (%s)" % (
        ", ".join(str(i) for i, t in enumerate(thresholds) if t > 0) or "-1")), "sizes")
    small, large = sizes.where(f"count <= {PAIRED}").drop("count"), sizes.where(f"count > {PAIRED}").drop("count")
    keys = ["part", "value"]
    left = indexed.join(small, keys).select(*keys, F.col("fp").alias("a"))
    right = probes.join(small, keys).select(*keys, F.col("fp").alias("b"))
    pairs = left.join(right, keys).where(
        (F.col("a") < F.col("b") if not any(t > 0 for t in thresholds) else F.col("a") != F.col("b"))
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    ).select("a", "b")
    crowded = probes.join(large, keys, "left_semi").select("fp").distinct()
    named = crowded.select("fp", F.explode(_flips("fp", range(BITS))).alias("near"))
    hubs = named.groupBy("near").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = named.join(tables.stage(hubs, "hubs"), "near").where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(near)


def _members(docs: DataFrame, distance: int, size: int) -> DataFrame:
    """``(doc_id, version, fp, root, component_id)`` of every row; ``root`` is a fingerprint that stands for the class."""
    marked = stage(fingerprints(docs, size), "fingerprints")
    with Scratch(docs.sparkSession, "simhash") as tables:
        distinct = tables.stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
        roots = components(links(distinct.select("fp"), tables, distance), tables)
        rooted = tables.stage(distinct.join(roots, distinct.fp == roots.node, "left").select(
            "fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
        names = tables.stage(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "names")
        named = stage(rooted.join(names, "root").select("fp", "root", "component_id"), "named")
    return marked.join(named, "fp")


def simhash_groups(docs: DataFrame, distance: int = 2, size: int = SHINGLE) -> DataFrame:
    """Class of every row: ``(doc_id, fp, component_id)``.

    ``component_id`` is the smallest ``doc_id`` reached over fingerprints of
    ``size``-word shingles that differ in ``distance`` bits or fewer, the row
    itself included.

    Null and wordless texts have fingerprint 0 and link like any other; equal
    texts and repeated rows share a class and come back once each; a null
    ``doc_id`` stays null and does not name a class unless no other id is in it.
    Extra columns are not read. An empty table gives no rows.
    """
    return _members(docs, distance, size).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = 2, size: int = SHINGLE) -> DataFrame:
    """One row of each class of ``simhash_groups``, all columns kept, whatever their names.

    It is the one with the smallest ``doc_id``, and if several texts of the class
    have that id, the one with the least digest; a row without an id stays only
    if no other of its class has one. Of rows that repeat id and text any one
    stays. Null and wordless texts are one class. An empty table gives no rows.
    """
    counted = _members(docs, distance, size).groupBy("root", "doc_id", "version").agg(F.count("*").alias("times"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "version", "times")).alias("k")
    kept = stage(counted.groupBy("root").agg(least).select("k.doc_id", "k.version", "k.times"), "kept")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), _version().alias("of"),
                       F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("version"))
    once = rows.join(kept.where("times = 1"), same, "left_semi")
    often = rows.join(kept.where("times > 1"), same, "left_semi").dropDuplicates(["id", "of"])
    return once.unionByName(often).select(*(F.col(f"row.`{c}`") for c in docs.columns))
