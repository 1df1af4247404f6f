"""Operators on pairs of rows: SimHash groups, line copies, top-k, embedding groups, url rules, and the pipeline."""

import random

import numpy as np
import parity
import pytest
import xxhash
from conftest_rows import HARD

import __spark_entry__ as entry_points
import corpus_pipeline
from coursemill.llm import embeddings, lines, oracle, queries, simhash, topk, urls
from coursemill.sources.staging import stage


def union(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --- SimHash --------------------------------------------------------------------


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for i in range(64):
            votes[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * votes[i] > len(grams))


def similar_texts(count):
    draw = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [draw.choice(vocabulary) for _ in range(400)]
    for i in range(count):
        words = list(base) if i % 3 else [draw.choice(vocabulary) for _ in range(40)]
        if i % 3 == 2:
            words[draw.randrange(400)] = f"new{i}"
        yield 100 + i, " ".join(words)


@pytest.mark.parametrize("paired", [1, 65])
def test_simhash_groups(documents, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rows = HARD + list(similar_texts(120))
    found = simhash.simhash_groups(documents(rows)).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    smallest = {}
    for (doc_id, _), r in zip(rows, roots, strict=True):
        if doc_id is not None:
            smallest[r] = min(smallest.get(r, doc_id), doc_id)
    want = sorted((d or 0, f, smallest.get(r) or 0) for (d, _), f, r in zip(rows, prints, roots, strict=True))
    assert sorted((r.doc_id or 0, r.fp % (1 << 64), r.component_id or 0) for r in found) == want


def test_simhash_empty(documents):
    assert simhash.simhash_groups(documents([])).count() == 0


def test_one_of_each_group_stays(documents):
    docs = documents(HARD + [(10, "Same text TWICE"), (11, "another text altogether here")])
    kept = simhash.keep_one(docs)
    assert kept.dtypes == docs.dtypes
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 8, 9, 11]


def test_kept_rows_against_classes(documents):
    rows = HARD + list(similar_texts(60)) + [(5, "another text of this id"), (103, "same text twice"), (None, "SAME text twice"), (None, "alone")]
    rows += [(None, "alone"), (2, "alone two"), (300, "another text of this id")]
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(documents(rows)).collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    least = {}
    for (i, t), r in zip(rows, roots, strict=True):
        least[r] = min(least.get(r, (True, 0)), (i is None, i or 0))
    assert len(kept) == len(least) and set(kept) <= set(rows)
    assert sorted((i is None, i or 0) for i, _ in kept) == sorted(least.values())


def test_kept_rows_carry_any_column(spark):
    names = ["id", "of", "row", "version", "times", "k", "root", "nameless", "fp", "component_id", "_kept_id"]
    docs = spark.createDataFrame([(1, "a b c d", *names), (2, "A b c d", *names), (3, "e f", *names)],
                                 "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_thresholds_meet_the_pigeonhole():
    assert simhash.allocate([[0, 5, 50]] * 3, 2) == (15.0, [0, 0, 0])
    cost, chosen = simhash.allocate([[0, 1, 2], [0, 90, 95], [0, 3, 9]], 2)
    assert (cost, sum(t + 1 for t in chosen)) == (5.0, 3)
    groups = simhash.partitions(10, np.full((64, 64), 3), 3)
    assert sorted(b for g in groups for b in g) == list(range(64))


# --- lines ------------------------------------------------------------------------


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(draw, text, edits):
    out = list(text)
    for _ in range(edits):
        at = draw.randrange(len(out) + 1)
        kind = draw.randrange(3)
        if kind == 0 and at < len(out):
            out[at] = draw.choice("abcé")
        elif kind == 1 and at < len(out):
            del out[at]
        else:
            out.insert(at, draw.choice("abc\U0001f600"))
    return "".join(out)


def test_banded_distance():
    draw = random.Random(3)
    ones = ["".join(draw.choice("abé") for _ in range(draw.randrange(30))) for _ in range(800)]
    others = [edited(draw, a, draw.randrange(5)) for a in ones]
    for edits in (1, 2, 3):
        assert lines.within(ones, others, edits).tolist() == [edit_distance(a, b) <= edits for a, b in zip(ones, others, strict=True)]
    assert lines.within([], [], 2).tolist() == []


def plain_removed(rows, edits=2):
    texts = sorted({(i is not None, i or 0, t) for i, t in rows if t}, key=lambda x: x[:2])
    found = [(k, pos, line) for k, (*_, t) in enumerate(texts) for pos, line in enumerate(t.split("\n")) if line.strip()]
    different = sorted({line for *_, line in found})
    at = {line: i for i, line in enumerate(different)}
    near = [(i, j) for i, a in enumerate(different) for j, b in enumerate(different[:i])
            if min(len(a), len(b)) >= 20 and abs(len(a) - len(b)) <= edits and edit_distance(a, b) <= edits]
    roots, seen, removed = union(len(different), near), set(), {}
    for k, pos, line in found:
        r = roots[at[line]]
        if r in seen:
            removed.setdefault(texts[k], []).append(pos)
        seen.add(r)
    return removed


@pytest.mark.parametrize("paired", [1, 64])
def test_repeated_lines(documents, monkeypatch, paired):
    monkeypatch.setattr(lines, "PAIRED", paired)
    monkeypatch.setattr(lines, "BLOCK", 4)
    draw = random.Random(4)
    stock = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randrange(15, 50))) for _ in range(25)]
    rows = [(100 + i, "\n".join(edited(draw, draw.choice(stock), draw.randrange(4)) for _ in range(draw.randrange(1, 5))) + "\n\n" * (i % 2))
            for i in range(60)]
    rows += [(5, "same text twice"), (5, "same text twice"), (6, "same text twice"), (1, None), (2, ""), (3, " \n\n "),
             (None, "no id, but first\nshort"), (7, "short"), (8, "same id, first of two texts"), (9, "word " * 20000), (10, "word " * 20000)]
    docs = documents(rows)
    want = plain_removed(rows)
    found = lines.report(docs).collect()
    texts = {}
    for i, t in rows:
        texts[i] = t
    assert len(found) == len(rows)
    for r in found:
        gone = want.get((r.doc_id is not None, r.doc_id or 0, texts[r.doc_id]), [])
        assert r.removed == ",".join(map(str, gone)), (r, texts[r.doc_id])
        assert (r.n_lines, r.n_removed) == ((texts[r.doc_id] or "").count("\n") + 1, len(gone))
    clean = lines.drop_repeated(docs)
    assert clean.dtypes == docs.dtypes
    for r in clean.collect():
        t = texts[r.doc_id]
        gone = want.get((r.doc_id is not None, r.doc_id or 0, t), [])
        assert r.text == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
        assert r.n_chars == (None if t is None else len(r.text))
    assert lines.report(documents([])).count() == 0


# --- vectors ------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(
        [(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, unit string")


ODD = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] + [0.0] * 6), (904, [float("nan")] * 8),
       (905, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]


def test_top_k(spark):
    random_ = np.random.default_rng(5)
    rows = [(i, random_.normal(size=8).round(1).tolist()) for i in range(700)]
    rows += [(700 + i, rows[3][1]) for i in range(20)] + [(3, rows[3][1])]
    v = topk.quantised(vectors(spark, rows + ODD))
    found = topk.top_k(v, v.where("vec_id % 50 = 0"), 5).collect()
    ints = [(i, np.floor(256 * np.array(x, np.float32).astype(float)).astype(int)) for i, x in rows]
    want = set()
    for i, q in {i: q for i, q in ints if i % 50 == 0}.items():
        best = sorted((-int(q @ c), j) for j, c in ints if j != i)[:5]
        want |= {(i, n, j, -s) for n, (s, j) in enumerate(best, 1)}
    assert {tuple(r) for r in found} == want and len(found) == 5 * 15
    few = v.where("vec_id < 3")
    assert topk.top_k(few, few, 5).count() == 6
    assert topk.top_k(v.limit(0), v.limit(0), 5).count() == 0


def plain_groups(rows):
    usable = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v, np.float32).astype(float)
            usable[n] = u / np.linalg.norm(u)
    links = [(a, b) for a in usable for b in usable if a < b and len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] >= 0.9]
    roots, degree, name = union(len(rows), links), [0] * len(rows), {}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    for n, r in enumerate(roots):
        if rows[n][0] is not None:
            name[r] = min(name.get(r, rows[n][0]), rows[n][0])
    return [(rows[n][0], degree[n], name.get(roots[n])) for n in range(len(rows))]


def grouped(spark, rows):
    return [(r.vec_id, r.n_links, r.component_id) for r in embeddings.embedding_groups(vectors(spark, rows)).collect()]


@pytest.mark.parametrize("members", [40, 2048])
def test_embedding_groups(spark, monkeypatch, members):
    monkeypatch.setattr(embeddings, "MEMBERS", members)
    monkeypatch.setattr(embeddings, "PER_CLUSTER", 60)
    random_ = np.random.default_rng(6)
    centres = random_.normal(size=(60, 8))
    rows = [(i, (centres[i % 60] * (1 + i % 3) + 0.1 * random_.normal(size=8)).tolist()) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(30)] + [(7, rows[7][1]), (500, [1.0, 2.0]), (501, [1.0, 2.1])]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    found, want = sorted(grouped(spark, rows + ODD), key=key), sorted(plain_groups(rows + ODD), key=key)
    assert [r[0] for r in found] == [r[0] for r in want]
    # nothing is linked that should not be; a graph search may miss a few
    assert all(f[1] <= w[1] for f, w in zip(found, want, strict=True))
    assert sum(f[1] for f in found) >= 0.97 * sum(w[1] for w in want)
    assert sum(f[2] == w[2] for f, w in zip(found, want, strict=True)) >= 0.97 * len(want)


def paired_vectors(spark, pairs, alone):
    draw = np.random.default_rng(8)
    base = draw.normal(size=(pairs + alone, 32))
    all_ = np.concatenate([base, base[:pairs] + 0.01])
    units = all_ / np.linalg.norm(all_, axis=1, keepdims=True)
    return spark.createDataFrame([(i, u.tobytes(), 1) for i, u in enumerate(units)], "node long, unit binary, copies long")


def test_audit_sees_lost_links(spark):
    units = paired_vectors(spark, 150, 2700)
    # the first 105 of 150 pairs are found; nodes 0 to 149 pair with 2850 to 2999
    counts = units.selectExpr("node", "CAST(node % 2850 < 105 AS LONG) AS links").selectExpr("*", "links AS pairs")
    assert abs(embeddings.audit(units, counts) - 0.7) < 0.12


def test_all_vectors_are_compared_when_the_search_fails(spark, monkeypatch):
    none = np.zeros(0, int)
    monkeypatch.setattr(embeddings, "range_search", lambda x, lists, least: (none, none))
    monkeypatch.setattr(embeddings, "MEMBERS", 40)
    monkeypatch.setattr(embeddings, "PER_CLUSTER", 30)
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(40, 8))
    rows = [(i, (centres[i % 40] + 0.1 * draw.normal(size=8)).tolist()) for i in range(200)] + [(500, [1.0, 2.0]), (501, [1.0, 2.1])]
    rows += [(600 + i, rows[7][1]) for i in range(5)]
    assert sorted(grouped(spark, rows)) == sorted(plain_groups(rows))


def test_no_vectors(spark):
    assert grouped(spark, []) == []
    assert sorted(grouped(spark, [(1, None), (2, [0.0])])) == [(1, 0, 1), (2, 0, 2)]


def test_recall_on_the_given_vectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = sorted(map(tuple, table.select("vec_id", "embedding").collect()))
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.embedding_groups(table).collect())
    want = plain_groups(rows)
    assert sum(r[1] for r in found) >= 0.9 * sum(r[1] for r in want)
    assert all(f[1] <= w[1] for f, w in zip(found, want, strict=True))


# --- urls ---------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "HTTP://Sub.Example.ORG/es/x?q#f", "https://example.org", "https://example.org?x=/es/", "https://xexample.org/es/",
    "https://a.b.com/fr/1", "https://com/de/", "https://com.net/de/", "https://example.org/en/12", "https://example.org/en/1", "https://org/a",
    "x://y://example.org/es/", "http://EXAMPLE.com:80/de/", "http://a.example.org/es", "http://org./", "http://..org/es/",
]


def plain_verdict(url, rules):
    url = url or ""
    if "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_url_rules(spark):
    extra = [("example.org", "/", "block"), ("a.example.org", "/es/deep/er", "allow"), ("org", "/es/", "allow"), (None, "/", "block")]
    rules = queries.URL_RULES + extra
    more = [f"http://{h}.example.org/{p}" for h in ("a", "b.a", "c") for p in ("es/deep/er/x", "es/deep/x", "en/1", "", "z")]
    pages = spark.createDataFrame(
        [(i % 30, u, "h", "p") for i, u in enumerate((URLS + more) * 2)], "page_id long, url string, host string, path string")
    found = urls.filter_urls(pages, spark.createDataFrame(rules, urls.RULES)).collect()
    known = [r for r in rules if r[0]]
    want = sorted((i % 30, *map(str, plain_verdict(u, known))) for i, u in enumerate((URLS + more) * 2))
    assert sorted((r.page_id, r.host, r.path, str(r.rule), r.verdict) for r in found) == want
    none = spark.createDataFrame([], urls.RULES)
    assert {r.verdict for r in urls.filter_urls(pages, none, "block").collect()} == {"block"}
    assert urls.filter_urls(pages.limit(0), none).count() == 0


# --- queries and pipeline -------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_parity(spark, sf_dir, name):
    difference = parity.compare(spark, parity.connect(sf_dir), name, queries.REGISTRY[name], oracle.SQL[name], sf_dir)
    assert difference is None, difference


def test_every_operator_has_a_query():
    names = entry_points.queries()
    assert "pipeline" in names
    assert [n for n in range(1, 14) if sum(x.startswith(f"op{n}_") for x in names) != 1] == []


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    step, types = docs, docs.dtypes
    counts = []
    merged = None
    for name, function in corpus_pipeline.STAGES:
        step = stage(function(spark, step, sf_dir), name)
        counts.append(step.count())
        if name != "packing":
            assert step.dtypes == types
            texts = {r.doc_id: r.text for r in step.collect()}
        if name == "line_dedup":
            merged = texts
        if name == "near_dedup":  # the least id of each group by all pairs
            ids = sorted(merged)
            prints = np.array([plain_fingerprint(merged[i]) for i in ids], np.uint64)
            apart = np.bitwise_count(prints[:, None] ^ prints[None, :])
            roots = union(len(ids), [(i, j) for i, j in np.argwhere(apart <= 2).tolist() if j < i])
            assert set(texts) == {ids[r] for r in roots} and len(texts) < len(merged)
    kept = {r.doc_id for r in step.collect()}
    assert kept == set(texts) and counts[0] <= docs.count() and counts[1] == counts[0] and counts[3] == counts[2]
    assert not any("AKIA" in t and secrets_left(t) for t in texts.values())
    ran = corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").collect()
    assert sorted(map(tuple, ran)) == sorted(map(tuple, step.drop("sequence_id", "offset").collect()))


def secrets_left(text):
    import re

    return re.search("AKIA[A-Z0-9]{14,}", text) is not None


def test_stages_on_odd_rows(spark, sf_dir, documents):
    """Empty tables, null ids, repeated rows and a column that no stage knows."""
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = documents(HARD, lang=None).select(*given.columns)
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, given.limit(0), sf_dir).count() == 0, name
        found = function(spark, given.where("doc_id % 4 = 0").unionByName(odd), sf_dir)
        if name != "packing":
            assert found.dtypes == given.dtypes
            assert set(r.doc_id for r in found.where("doc_id < 10").collect()) <= set(range(10))
        if name == "line_dedup":
            assert found.count() == given.where("doc_id % 4 = 0").count() + len(HARD)
