"""Lexical search, toxicity and fill-in-middle, against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_rows import HARD

from coursemill.llm import infill, lexical, sampling, toxicity

# --- fill-in-middle ------------------------------------------------------------


def plain_infill(doc_id, text):
    """The whole transformation of one row, by slicing and by splitting."""
    text = text or ""
    digest = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if not text or re.search("<P>|<S>|<M>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


INFILL = HARD + [(30 + i, t) for i, t in enumerate([
    "has <P> in it", "<S>", "ends with <", "<P", "P>S>M>", "<<P<S<M>", "a<b<c" * 40, "\U0001f600\U0001f601 ß<" * 30, "<" * 100, "M>" * 50])]
INFILL += [(100 + i, "".join(random.Random(i).choice("<>PSMab ") for _ in range(i))) for i in range(120)]
INFILL += [(30, "another text of this id"), (None, "no id, second text"), (7000, "same text twice")]


@pytest.mark.parametrize(("units", "remembered"), [(1, 200_000), (3, 2), (1 << 15, 200_000)])
def test_infill_against_whole_texts(documents, monkeypatch, units, remembered):
    monkeypatch.setattr(infill, "UNITS", units)
    monkeypatch.setattr(infill, "REMEMBERED", remembered)
    monkeypatch.setattr(infill, "REPEATED", 2)
    rows = [r for r in INFILL if units > 100 or len(r[1] or "") < 20_000]
    found = infill.digests(documents(rows * 3)).collect()
    assert infill.digests(documents([])).count() == 0
    want = []
    for i, t in rows * 3:
        n, form, prefix, middle, output = plain_infill(i, t)
        want.append((i, n, form, prefix, middle, sha(output), sha(t or "")))
    assert Counter(map(tuple, found)) == Counter(want)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_infill_outputs(documents):
    rows = infill.outputs(documents(INFILL)).collect()
    assert Counter(map(tuple, rows)) == Counter((i, *plain_infill(i, t)[1::3]) for i, t in INFILL)
    assert {r.form for r in infill.outputs(documents(INFILL), plain=100).collect()} == {"plain"}
    assert "psm" not in {r.form for r in infill.outputs(documents(INFILL), suffix_first=100).collect()}


def test_infill_sorts_twice_and_shuffles_once(documents):
    plan = infill.digests(documents(INFILL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2


# --- lexical search --------------------------------------------------------------


def plain_terms(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", small)


def plain_search(docs, items, best):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    full = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(full), sum(n for *_, n in full)
    df = Counter(t for _, b, _ in full for t in b)
    out = []
    for item_id, text in items:
        asked, scores = Counter(plain_terms(text)), []
        for i, bag, n in full:
            m, score = 25 + 75 * n * n_docs // n_terms, 0
            for t, times in asked.items():
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item_id, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:best], 1)]
    return out


def wordy(draw, size):
    return " ".join(
        draw.choice(["the", "of", "It", "été", "日本", "a1", "x_y", "Über", "zebra", "quick", "fox-trot", "K2"]) for _ in range(size))


@pytest.mark.parametrize(("cells", "gathered", "block"), [(1 << 21, 1 << 19, 8 << 20), (7, 1, 60)])
def test_search_against_all_scores(spark, documents, monkeypatch, cells, gathered, block):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "GATHERED", gathered)
    monkeypatch.setattr(lexical, "BLOCK", block)
    draw = random.Random(7)
    docs = HARD + [(100 + i, wordy(draw, draw.randrange(12))) for i in range(150)]
    docs += [(300 - i, "Zebra quick the") for i in range(20)] + [(None, "zebra; QUICK the")] * 15 + [(290, "zebra quick the")] * 3
    items = [(1, "zebra"), (2, None), (3, ""), (4, "nothing here at all"), (5, "quick quick zebra, the of It"), (None, "日本 été"), (5, "fox K2"),
             (5, "fox K2"), (6, "same text twice"), (7, "word ß ﬁ Über X")]
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id long, score long")
    found = lexical.search(documents(docs), table, 10).collect()
    assert Counter(map(tuple, found)) == Counter(plain_search(docs, items, 10))
    assert len(found) > 50


def test_search_on_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(documents([(1, "a")]), none).count() == 0
    assert lexical.search(documents([]), some).count() == 0
    assert lexical.search(documents([(1, None), (2, " . ")]), some).count() == 0


def test_equal_documents_are_scored_once(documents):
    rows = lexical.vectors(documents([(i, "the fox") for i in range(500)] + [(900, "the the fox")]), [b"fox", b"the"])
    classes = lexical.classes(rows, 501, 1003, 10).collect()
    assert sorted(len(c.ids) for c in classes) == [1, 10]
    assert max(c.ids for c in classes) == [900] and min(c.ids for c in classes) == list(range(10))


# --- toxicity ------------------------------------------------------------------------


def plain_probability(bag, weight, intercept):
    alive = 1.0
    for s in range(bag.size):
        z = intercept + sum(weight[f] * n for f, of, n in zip(bag.feature, bag.sentence, bag.times, strict=True) if of == s)
        alive *= 1 - 1 / (1 + math.exp(-z))
    return 1 - alive


@pytest.mark.parametrize("toxic", [True, False])
def test_gradient_of_the_noisy_or(toxic):
    numbers = {}
    bag = toxicity.bag_of("Some words here. And more words! Here again?\n", numbers, True)
    draw = np.random.default_rng(4)
    weight, intercept = draw.normal(size=len(numbers)), -1.5
    by_entry, by_intercept, loss = toxicity.gradient(bag, weight, intercept, toxic)

    def plain_loss(w, b):
        p = plain_probability(bag, w, b)
        return -math.log(p if toxic else 1 - p)

    assert math.isclose(loss, plain_loss(weight, intercept), rel_tol=1e-9)
    by_weight = np.bincount(bag.feature, by_entry, len(weight))
    for f in range(len(weight)):
        step = np.zeros(len(weight))
        step[f] = 1e-6
        slope = (plain_loss(weight + step, intercept) - plain_loss(weight - step, intercept)) / 2e-6
        assert math.isclose(slope, by_weight[f], rel_tol=1e-4, abs_tol=1e-6)
    assert math.isclose((plain_loss(weight, intercept + 1e-6) - plain_loss(weight, intercept - 1e-6)) / 2e-6, by_intercept, rel_tol=1e-4)


def test_steps_against_a_plain_leader():
    """The vectorised steps equal those written out feature by feature."""
    texts = [("bad day. good day", True), ("good day. fine", False), ("so bad", True), ("day by day", False)]
    numbers = {}
    bags = [toxicity.bag_of(t, numbers, True) for t, _ in texts]
    labels = [y for _, y in texts]
    count = len(numbers)
    z, n, start = [0.0] * (count + 1), [0.0] * (count + 1), math.log(0.1 / np.mean([b.size for b in bags]))

    def weight(f):
        l1 = 0.0 if f == count else toxicity.L1
        if abs(z[f]) <= l1:
            return 0.0
        return -(z[f] - math.copysign(l1, z[f])) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    for epoch in range(toxicity.EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(bags)):
            w = [weight(f) for f in range(count + 1)]
            by_entry, by_intercept, _ = toxicity.gradient(bags[i], np.array(w[:count]), w[count] + start, labels[i])
            g = {count: by_intercept}
            for f, x in zip(bags[i].feature.tolist(), by_entry, strict=True):
                g[f] = g.get(f, 0.0) + x
            for f, x in g.items():
                z[f] += x - (math.sqrt(n[f] + x * x) - math.sqrt(n[f])) / toxicity.ALPHA * w[f]
                n[f] += x * x
    got, intercept = toxicity.follow_leader(bags, labels, count)
    assert np.allclose(got, [weight(f) for f in range(count)]) and math.isclose(intercept, weight(count) + start)


def test_score_against_every_sentence():
    model = toxicity.Model({"bad ": 4.0, "bad": 1.0, "nic": -2.0}, -3.0)
    for text in ["", "...", "fine", "bad. nicely bad, badly!\nfine fine", "bad bad bad", "nice. nice? bad", None]:
        alive, spans = 1.0, []
        for m in re.finditer(r"[^.!?\n]+", text or ""):
            words = set(re.findall(r"[a-z]+", m[0]))
            z = -3 + sum(4.0 * (w == "bad") + (w.startswith("bad") and w != "bad") - 2.0 * (w.startswith("nic")) for w in words)
            alive *= 1 - 1 / (1 + math.exp(-z))
            if 1 / (1 + math.exp(-z)) >= toxicity.TOXIC:
                spans.append(m.span())
        score, found = model.score(text, {})
        assert math.isclose(score, 1 - alive, abs_tol=1e-12)
        assert [s[:2] for s in found] == spans


def test_toxicity_of_the_given_documents(spark, documents):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rows = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= toxicity.TOXIC) for r in rows.values())
    held = [(rows[r.doc_id].predicted, r.toxic) for r in labels.collect() if rows[r.doc_id].held_out]
    caught, wrong = sum(p and t for p, t in held), sum(p and not t for p, t in held)
    assert caught >= 0.85 * sum(t for _, t in held) and wrong <= 0.02 * len(held)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(0 <= s.start < s.end <= len(texts[i]) for i, r in rows.items() for s in r.offending)


def test_offending_sentences_and_odd_rows(spark, documents):
    draw = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        sentences = [" ".join(f"w{draw.randrange(60)}x" for _ in range(6)) for _ in range(4)]
        if i % 4 == 0:
            sentences[i % 3] += " awful"
        rows.append((i, ". ".join(sentences)))
        labels.append((i, 1, int(i % 4 == 0)))
    labels += [(0, 1, 0), (1, 0, None), (None, 0, 1), (9999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents(rows + [(-i if i else i, t) for i, t in HARD if i is not None] + [(None, "no id, but awful. fine")])
    found = toxicity.toxicity(docs, table).collect()
    assert len(found) == len(rows) + len(HARD)
    texts = dict(rows)
    for r in found:
        if r.doc_id in texts:
            assert r.predicted == (r.doc_id % 4 == 0)
            assert all("awful" in texts[r.doc_id][s.start : s.end] for s in r.offending) and bool(r.offending) == bool(r.predicted)
    assert [r.predicted for r in found if r.doc_id is None] == [1]
    none = table.limit(0)
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), table).count() == 0
    clash = docs.withColumns({"score": docs.doc_id, "found": docs.text, "row": docs.text, "predicted": docs.text})
    got = toxicity.judged(clash, toxicity.Model({"awful ": 9.0}, -5.0))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp", "spans", "root", "line", "found", "row", "score", "predicted",
                           "offending"] and got.count() == len(found)


def test_samples_are_bounded_whatever_is_repeated(spark, documents):
    rows = [(7, "one id, one text")] * 300 + [(7, f"one id, text {i}") for i in range(300)] + [(i, "x") for i in range(100, 400)]
    docs = documents(rows)
    labelled = docs.selectExpr("doc_id").select(docs.doc_id).distinct().selectExpr("doc_id", "doc_id = 7 AS toxic")
    draws = docs.select("doc_id", sampling.draw().alias("draw")).join(labelled, "doc_id")
    picked = sampling.bounded(docs, draws, "toxic", 40).collect()
    assert Counter(r.toxic for r in picked) == {True: 40, False: 40}
    assert len({r.draw for r in picked}) == 80
