"""Near-duplicate embeddings over a robust-pruned flat graph.

The vectors are dealt to overlapping clusters. Each cluster builds a pruned
graph of its members, the lists of a vector from all its clusters are united,
and every vector searches the graph of its clusters from the medoid: greedily
until the beam holds still, then on through all that is within the range.
Links are verified in double precision. The share of true links found is
measured on a bounded set of vectors against all others; too low a share makes
the clusters overlap more, and at last all vectors are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.operators.components import components
from coursemill.llm.topk import finite
from coursemill.sources.staging import stage

#: Least cosine of a link.
RANGE = 0.9
#: Vectors for each centroid, centroids at most, members of a block at most; larger clusters become a grid of blocks.
PER_CLUSTER, CLUSTERS, MEMBERS = 1024, 4096, 2048
#: Vectors that the centroids are fitted on, at most, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 8
#: Candidates and degree of the pruned graph, slack of the pruning rule, width of the search beam.
NEAREST, DEGREE, SLACK, BEAM = 48, 24, 1.2, 16
#: Vectors of the audit at first, least share of links found, most clusters of a vector.
AUDIT, RECALL, OVERLAP = 200, 0.9, 6
#: Vectors with a partner that the audit wants to meet, and vectors that it asks for that, about, at most.
MET, PROBES = 100, 6000


def unit_vectors(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, unit)``: usable vectors at length one, as the bytes of doubles.

    Vectors that are null, zero, or hold null or non-finite components are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = []
            for row in batch.column(1).to_pylist():
                v = np.array(row, np.float64)
                v = v / np.abs(v).max()  # no overflow in the square
                units.append((v / np.sqrt(v @ v) + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.binary())], ["vec_id", "unit"])

    usable = embeddings.where("vec_id IS NOT NULL").where(finite("embedding")).where("exists(embedding, x -> x <> 0)")
    doubles = usable.selectExpr("CAST(vec_id AS LONG) AS vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS embedding")
    return doubles.mapInArrow(run, "vec_id long, unit binary")


def centroids(units: DataFrame, count: int) -> np.ndarray:
    """Spherical k-means of a bounded sample; as many centroids as ``PER_CLUSTER`` asks for."""
    wanted = min(CLUSTERS, max(1, -(-count // PER_CLUSTER)))
    share = min(1.0, SAMPLE / max(count, 1))
    drawn = units.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select("node", "unit")
    rows = sorted((r["node"], r["unit"]) for r in drawn.limit(2 * SAMPLE).collect())
    by_size: dict[int, list] = {}
    for _, unit in rows:
        by_size.setdefault(len(unit), []).append(np.frombuffer(unit))
    # other dimensions than the most common one have no centroid and form clusters of their own
    points = np.array(max(by_size.values(), key=len))
    random = np.random.default_rng(0)
    centres = points[random.choice(len(points), min(wanted, len(points)), replace=False)]
    for _ in range(ROUNDS):
        nearest = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(points, 1 + len(points) // 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
    return centres


def assign(units: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    """``(node, unit, copies, clusters)``: each vector with its ``overlap`` nearest clusters, ascending."""
    shared = units.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            clusters = []
            for unit in batch.column(1).to_pylist():
                v = np.frombuffer(unit)
                if len(v) != c.shape[1]:
                    clusters.append([-len(v)])
                    continue
                near = np.argpartition(-(c @ v), min(overlap, len(c)) - 1)[:overlap]
                clusters.append(sorted(near.tolist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(clusters, pa.list_(pa.int32()))],
                                             ["node", "unit", "copies", "clusters"])

    return units.select("node", "unit", "copies").mapInArrow(run, "node long, unit binary, copies long, clusters array<int>")


def cells(assigned: DataFrame) -> DataFrame:
    """A row for each member of each cell: cluster, and for clusters above ``MEMBERS`` each pair of blocks."""
    each = assigned.select("*", F.explode("clusters").alias("cluster"))
    sizes = stage(assigned.select(F.explode("clusters").alias("cluster")).groupBy("cluster").agg(
        F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks")), "sizes")
    placed = each.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.expr("transform(sequence(0, blocks - 1), b -> struct(least(b, block) AS one, greatest(b, block) AS other))")
    return placed.select("cluster", "node", "unit", "copies", "clusters", "block", F.explode(pairs).alias("pair")).select(
        F.concat_ws("/", "cluster", "pair.one", "pair.other").alias("cell"), "node", "unit", "copies", "clusters", "cluster",
        "block", (F.col("pair.one") != F.col("pair.other")).alias("across"))


def prune(x: np.ndarray) -> np.ndarray:
    """Robust-pruned lists of all rows, ``DEGREE`` wide, -1 where there are fewer.

    Nearest first, a candidate is kept unless one kept before is nearer to it by
    the slack than the row itself is.
    """
    m = len(x)
    width = min(NEAREST, m - 1)
    lists = np.full((m, DEGREE), -1, np.int32)
    if width < 1:
        return lists
    for start in range(0, m, 512):
        rows = np.arange(start, min(start + 512, m))
        near = x[rows] @ x.T
        near[np.arange(len(rows)), rows] = -np.inf
        found = np.argpartition(-near, width - 1, axis=1)[:, :width]
        score = np.take_along_axis(near, found, 1)
        order = np.argsort(-score, axis=1, kind="stable")
        found, gap = np.take_along_axis(found, order, 1), 2 - 2 * np.take_along_axis(score, order, 1)
        between = 2 - 2 * np.einsum("rid,rjd->rij", x[found], x[found])
        open_, used = np.ones(found.shape, bool), np.zeros(len(rows), int)
        for i in range(width):
            take = open_[:, i] & (used < DEGREE)
            lists[rows[take], used[take]] = found[take, i]
            used[take] += 1
            # squared distances, so the slack is squared as well
            hidden = SLACK**2 * between[:, i, :] <= gap
            hidden[:, : i + 1] = False
            open_ &= ~(hidden & take[:, None])
    return lists


def range_search(x: np.ndarray, lists: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(row, other)`` with cosine ``least`` or more that the graph leads to, from the medoid for every row."""
    m, rows = len(x), np.arange(len(x))
    medoid = int((x @ x.mean(axis=0)).argmax())
    seen = np.zeros((m, m), bool)
    seen[:, medoid] = seen[rows, rows] = True
    ids = np.full((m, BEAM), medoid)
    score = np.full((m, BEAM), -np.inf)
    score[:, 0] = x @ x[medoid]
    opened = np.ones((m, BEAM), bool)
    opened[:, 0] = False
    hits: list[tuple[np.ndarray, np.ndarray]] = []

    def reach(who: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New neighbours, each once, with their cosines."""
        flat = np.unique(np.repeat(who, others.shape[1])[others.ravel() >= 0].astype(np.int64) * m + others.ravel()[others.ravel() >= 0])
        q, o = flat // m, flat % m
        fresh = ~seen[q, o]
        q, o = q[fresh], o[fresh]
        seen[q, o] = True
        s = np.empty(len(q))
        for i in range(0, len(q), 1 << 15):
            s[i : i + (1 << 15)] = np.einsum("ij,ij->i", x[q[i : i + (1 << 15)]], x[o[i : i + (1 << 15)]])
        inside = s >= least
        hits.append((q[inside], o[inside]))
        return q, o, s

    # the row's own list starts the range search beside the medoid
    reach(rows, lists)
    near = score[:, 0] >= least
    near[medoid] = False
    hits.append((rows[near], np.full(int(near.sum()), medoid)))
    active = rows
    while len(active):
        pick = np.where(opened[active], -np.inf, score[active]).argmax(axis=1)
        opened[active, pick] = True
        q, o, s = reach(active, lists[ids[active, pick]])
        starts = np.searchsorted(q, active)
        width = int((np.searchsorted(q, active, "right") - starts).max(initial=0))
        if width:
            more_ids, more = np.zeros((len(active), width), int), np.full((len(active), width), -np.inf)
            at = np.searchsorted(active, q)
            col = np.arange(len(q)) - starts[at]
            more_ids[at, col], more[at, col] = o, s
            all_ids, all_score = np.hstack([ids[active], more_ids]), np.hstack([score[active], more])
            all_open = np.hstack([opened[active], more == -np.inf])
            best = np.argpartition(-all_score, BEAM - 1, axis=1)[:, :BEAM]
            ids[active] = np.take_along_axis(all_ids, best, 1)
            score[active] = np.take_along_axis(all_score, best, 1)
            opened[active] = np.take_along_axis(all_open, best, 1)
        active = active[(~opened[active]).any(axis=1)]
    # all that is within the range is a place to go on from
    at = 0
    while at < len(hits):
        batch, at = hits[at:], len(hits)
        q, o = (np.concatenate(c) for c in zip(*batch, strict=True))
        for i in range(0, len(q), 1 << 14):
            reach(q[i : i + (1 << 14)], lists[o[i : i + (1 << 14)]])
        if at < len(hits) and not any(len(q) for q, _ in hits[at:]):
            break
    q, o = (np.concatenate(c) for c in zip(*hits, strict=True))
    return np.concatenate([q, o]), np.concatenate([o, q])


def _build(cell: pd.DataFrame) -> pd.DataFrame:
    nodes = cell["node"].to_numpy()
    lists = prune(np.array([np.frombuffer(u) for u in cell["unit"]]))
    return pd.DataFrame({"node": nodes, "near": [nodes[row[row >= 0]].tolist() for row in lists]})


def _search(cell: pd.DataFrame) -> pd.DataFrame:
    """Links in a cell along the graph."""
    cell = cell.sort_values("node", ignore_index=True)
    nodes, m = cell["node"].to_numpy(), len(cell)
    x = np.array([np.frombuffer(u) for u in cell["unit"]])
    wide = max(1, max(len(n) for n in cell["near"]))
    lists = np.full((m, wide), -1, np.int32)
    for i, near in enumerate(cell["near"]):
        at = np.searchsorted(nodes, near)
        here = at[(at < m) & (nodes[np.minimum(at, m - 1)] == near)]
        lists[i, : len(here)] = here
    q, o = range_search(x, lists, RANGE)
    key = np.unique(q.astype(np.int64) * m + o)
    return _counted(cell, key // m, key % m)


def _compare(cell: pd.DataFrame) -> pd.DataFrame:
    """Links in a cell by all its pairs."""
    cell = cell.sort_values("node", ignore_index=True)
    x = np.array([np.frombuffer(u) for u in cell["unit"]])
    found = []
    for start in range(0, len(x), 512):
        near = x[start : start + 512] @ x.T >= RANGE
        near[np.arange(len(near)), start + np.arange(len(near))] = False
        q, o = np.nonzero(near)
        found.append((q + start, o))
    return _counted(cell, *(np.concatenate(c) for c in zip(*found, strict=True)))


def _counted(cell: pd.DataFrame, q: np.ndarray, o: np.ndarray) -> pd.DataFrame:
    """Links, different partners and least node reached of each member; ``(q, o)`` both ways."""
    nodes, m = cell["node"].to_numpy(), len(cell)
    # a pair counts in the first cluster its two vectors share, and across blocks only between them
    mine, block = cell["cluster"][0], cell["block"].to_numpy()
    held = cell["clusters"].tolist()
    deep = max(len(c) for c in held)
    table = np.array([list(c) + [2**31 - 1] * (deep - len(c)) for c in held], np.int64)
    earlier = np.zeros(len(q), bool)
    for i in range(deep):
        ours = table[q, i]
        earlier |= (ours < mine) & (table[o] == ours[:, None]).any(axis=1)
    counted = ~earlier & ((block[q] != block[o]) | (not cell["across"][0]))
    links = np.bincount(q[counted], cell["copies"].to_numpy()[o[counted]], m).astype(np.int64)
    pairs = np.bincount(q[counted], minlength=m).astype(np.int64)
    root = np.arange(m)
    while True:
        low = root.copy()
        np.minimum.at(low, q, root[o])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return pd.DataFrame({"node": nodes, "links": links, "pairs": pairs, "root": nodes[root]})


def _links(units: DataFrame, centres: np.ndarray, overlap: int, exact: bool = False) -> DataFrame:
    members = stage(cells(assign(units, centres, overlap)), "members")
    found = "node long, links long, pairs long, root long"
    if exact:
        return stage(members.groupBy("cell").applyInPandas(_compare, found), "links")
    lists = members.select("cell", "node", "unit").groupBy("cell").applyInPandas(_build, "node long, near array<long>")
    graph = stage(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    joined = members.join(graph, "node")
    return stage(joined.groupBy("cell").applyInPandas(_search, found), "links")


def audit(units: DataFrame, counts: DataFrame) -> float:
    """Mean share of its true partners that a vector is linked with, against all vectors in double precision.

    Vectors are drawn by digest, whatever was found for them, until ``MET`` of
    them have a true partner, ``PROBES`` at most. Each counts once, however many
    partners and copies there are.
    """
    shares: list[float] = []
    after, asked, size = None, 0, AUDIT
    while len(shares) < MET and asked < PROBES:
        place = F.xxhash64("node")
        left = counts if after is None else counts.where(place > F.lit(after))
        drawn = left.select("node", "pairs", place.alias("place")).orderBy("place").limit(size)
        sample = units.join(drawn, "node").select("node", "unit", "pairs", "place").collect()
        if not sample:
            break
        truth = _partners(units, [(r["node"], r["unit"]) for r in sample])
        shares += [min(r["pairs"], truth[r["node"]]) / truth[r["node"]] for r in sample if truth[r["node"]]]
        after, asked, size = max(r["place"] for r in sample), asked + len(sample), 2 * size
    return sum(shares) / len(shares) if shares else 1.0


def _partners(units: DataFrame, probes: list[tuple[int, bytes]]) -> dict[int, int]:
    """Number of other different vectors within the range of each probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        true: dict[int, int] = dict.fromkeys((n for n, _ in probes), 0)
        for batch in batches:
            by_size: dict[int, list[int]] = {}
            nodes, unit = (c.to_pylist() for c in batch.columns)
            for i, u in enumerate(unit):
                by_size.setdefault(len(u), []).append(i)
            for size, rows in by_size.items():
                asked = [(n, np.frombuffer(u)) for n, u in probes if len(u) == size]
                if asked:
                    near = np.array([np.frombuffer(unit[i]) for i in rows]) @ np.array([u for _, u in asked]).T >= RANGE
                    near &= np.array([nodes[i] for i in rows])[:, None] != np.array([n for n, _ in asked])
                    for (n, _), more in zip(asked, near.sum(axis=0).tolist(), strict=True):
                        true[n] += more
        yield pa.RecordBatch.from_arrays([pa.array(list(true)), pa.array(list(true.values()))], ["node", "true"])

    true = units.select("node", "unit").mapInArrow(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    return {r["node"]: r["true"] for r in true.collect()}  # a row for each probe


def embedding_groups(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``embeddings(vec_id, embedding)``.

    ``n_links``: other rows linked directly, that is with a cosine of ``RANGE`` or
    more, equal vectors included; ``component_id``: smallest ``vec_id`` reached;
    ``kept``: whether that is the row itself.

    Vectors that are null, zero, or hold null or non-finite components link with
    nothing, as do rows with a null id. Repeated rows are linked with each other
    and come back as often as given. Extra columns, labels among them, are not
    read. An empty table gives no rows. Vectors of different length never link.
    """
    rows = stage(unit_vectors(embeddings), "units")
    # equal vectors are one node; its number comes from its content
    node = F.xxhash64("unit")
    units = stage(rows.groupBy(node.alias("node"), "unit").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("first")), "nodes")
    count = units.count()
    if count:
        centres, overlap = centroids(units, count), 2
        while True:
            exact = overlap > OVERLAP
            # one cluster of all vectors, as a grid of blocks, meets every pair once
            links = _links(units, centres[:1] if exact else centres, 1 if exact else min(overlap, len(centres)), exact)
            counts = stage(links.groupBy("node").agg(F.sum("links").alias("links"), F.sum("pairs").alias("pairs")), "counts")
            if exact or audit(units, counts) >= RECALL:
                break
            overlap = overlap + 2 if overlap < len(centres) else OVERLAP + 1  # no more clusters: nothing else to search
        roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
        rooted = stage(units.join(counts, "node").join(roots, "node", "left").select(
            "node", "unit", "copies", "first", "links", F.coalesce("root", "node").alias("root")), "rooted")
        names = stage(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "names")
        named = stage(rooted.join(names, "root").select(
            "unit", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"), "named")
        linked = rows.join(named, "unit").select("vec_id", "n_links", "component_id")
    else:
        linked = rows.selectExpr("vec_id", "0L AS n_links", "vec_id AS component_id")
    usable = F.expr("vec_id IS NOT NULL") & finite("embedding") & F.expr("exists(embedding, x -> x <> 0)")
    alone = embeddings.where(~F.coalesce(usable, F.lit(False))).selectExpr(
        "CAST(vec_id AS LONG) AS vec_id", "0L AS n_links", "CAST(vec_id AS LONG) AS component_id")
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
