"""Streaming forms: increments, restarts and repeated batches."""

import pytest
from pyspark.sql import functions as F

from coursemill.operators import content
from coursemill.plans.fixtures import table
from coursemill.sources.staging import Scratch, Versions
from coursemill.streaming import ingest, scores
from coursemill.streaming.ledger import Ledger


def test_ingest_takes_every_page_once(spark, sf_dir, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    pages = table(spark, sf_dir, "pages")

    def run():
        units = ingest.new_units(ingest.read_page_stream(spark, source))
        ingest.start_ingest(units, out, checkpoint).awaitTermination()
        return spark.read.parquet(out)

    pages.where("page_id < 20").coalesce(1).write.mode("append").parquet(source)
    assert run().count() == 20
    assert run().count() == 20  # nothing new
    # the second arrival repeats known pages, holds copies and brings a failed page
    later = pages.withColumn("html", F.expr("IF(page_id = 49, NULL, html)")).where("page_id >= 10")
    later.unionByName(later).coalesce(1).write.mode("append").parquet(source)
    published = run()
    assert published.count() == published.select("url").distinct().count() == 49
    expected = content.unit_content(pages.where("page_id <> 49")).select("page_id", "content")
    assert published.select("page_id", "content").exceptAll(expected).count() == 0


def test_ingest_skips_units_of_an_earlier_run(spark, sf_dir, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    pages = table(spark, sf_dir, "pages")
    pages.coalesce(1).write.parquet(source)
    earlier = pages.where("page_id < 30").select("url")
    units = ingest.new_units(ingest.read_page_stream(spark, source), published=earlier)
    ingest.start_ingest(units, out, checkpoint).awaitTermination()
    assert {r.page_id for r in spark.read.parquet(out).collect()} == set(range(30, 50))


def test_scores_accumulate_over_batches(spark, sf_dir, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    answers, questions = table(spark, sf_dir, "answer_events"), table(spark, sf_dir, "question_bank")

    def run():
        live = scores.live_scores(scores.read_answer_stream(spark, source), questions)
        scores.start_scores(live, out, checkpoint).awaitTermination()
        return scores.latest_scores(spark, out)

    answers.where("event_id % 2 = 0").write.mode("append").parquet(source)
    run()
    answers.where("event_id % 2 = 1").write.mode("append").parquet(source)
    batch = scores.live_scores(answers, questions)
    final = run()
    assert final.exceptAll(batch).count() == 0 and batch.exceptAll(final).count() == 0


def test_conflicting_pages_of_a_batch_give_one_stated_unit(spark, tmp_path, monkeypatch):
    parsed = []
    plain = content.unit_content
    monkeypatch.setattr(content, "unit_content", lambda p, *more: parsed.append(p.count()) or plain(p, *more))
    rows = [(i, f"https://x.org/{u}", f"<main><p>text {t}</p></main>") for i, (u, t) in enumerate(
        (u, t) for u in range(6) for t in range(5) for _ in range(2))] + [(99, "https://x.org/9", None), (98, None, "<p>a</p>")]
    pages = spark.createDataFrame(rows, ingest.PAGES)
    results = []
    for parts in (1, 7):
        source, out, checkpoint = (str(tmp_path / f"{n}{parts}") for n in ("in", "out", "check"))
        pages.repartition(parts).write.parquet(source)

        def run():
            ingest.start_ingest(ingest.new_units(ingest.read_page_stream(spark, source)), out, checkpoint, expected=1000).awaitTermination()
            return sorted((r.url, r.page_id, r.content) for r in spark.read.parquet(out).collect())

        results.append(run())
        pages.where("page_id < 90").withColumn("html", F.lit("<p>later</p>")).write.mode("append").parquet(source)
        assert run() == results[-1]
    assert results[0] == results[1] and len(results[0]) == 6
    assert sum(parsed) == 2 * 6  # one page of each URL, none again
    best = min(range(5), key=lambda t: __import__("hashlib").md5(f"<main><p>text {t}</p></main>".encode()).hexdigest())
    assert {c for _, _, c in results[0]} == {f"text {best}"}


def test_a_replayed_file_changes_no_score(spark, sf_dir, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    answers, questions = table(spark, sf_dir, "answer_events"), table(spark, sf_dir, "question_bank")
    for part in (answers.where("event_id < 600"), answers.where("event_id < 600"), answers, answers.unionByName(answers)):
        part.write.mode("append").parquet(source)
        live = scores.live_scores(scores.read_answer_stream(spark, source), questions)
        scores.start_scores(live, out, checkpoint, expected=1000).awaitTermination()
    final, batch = scores.latest_scores(spark, out), scores.live_scores(answers, questions)
    assert final.exceptAll(batch).isEmpty() and batch.exceptAll(final).isEmpty()


@pytest.mark.parametrize("expected", [1, 100_000])
def test_ledger_is_exact_whatever_its_filter(spark, tmp_path, expected):
    ledger = Ledger(spark, str(tmp_path / f"l{expected}"), "BIGINT", expected)

    def unseen(keys, work):
        with Scratch(spark, "t") as tables:
            return sorted((r.key for r in ledger.unseen(keys, work, tables).collect()), key=str)

    keys = spark.range(0, 20_000).selectExpr("id AS key")
    some = keys.where("key < 15000")
    assert len(unseen(some, "a-0")) == 15_000
    ledger.record(some, "a-0")
    assert len(unseen(some, "a-0")) == 15_000  # the same work again
    ledger.record(some, "a-0")
    assert unseen(keys, "a-1") == sorted(range(15_000, 20_000), key=str)
    assert unseen(spark.sql("SELECT CAST(NULL AS BIGINT) AS key UNION ALL SELECT 3L"), "b-0") == [None]
    again = Ledger(spark, str(tmp_path / f"l{expected}"), "BIGINT", 5000)  # its filter is made from the keys
    with Scratch(spark, "t") as tables:
        assert again.unseen(keys, "a-1", tables).count() == 5000


def test_work_done_again_starts_from_the_same_version(spark, tmp_path):
    kept = Versions(spark, str(tmp_path / "v"), "x BIGINT")
    assert kept.read().isEmpty()
    for tag, found, n in (("a", 0, 1), ("b", 1, 2), ("b", 1, 3), ("c", 1, 4), ("c", 1, 5)):
        base = kept.read(tag)
        assert base.count() == found
        kept.replace(spark.range(n).selectExpr("id AS x").limit(1), tag)
    assert len(list((tmp_path / "v").iterdir())) == 2
    (tmp_path / "v" / "000000000009.d").mkdir()  # an unfinished version does not count
    assert kept.read().count() == 1
