"""Relational operators: hand-made cases, invariants and brute force."""

import itertools
import json
import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from coursemill.operators import bank, hierarchy, ordinals, permutation, publish, quiz, resume
from coursemill.operators.components import components
from coursemill.operators.hierarchy import Limits
from coursemill.plans.fixtures import BASE, table
from coursemill.sources import files, staging
from coursemill.sources.progress import FIELDS, ProgressStore


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return hierarchy.course_hierarchy(table(spark, sf_dir, "page_store"), table(spark, sf_dir, "seeds"), BASE).cache()


# --- bucketed running sums -----------------------------------------------


def test_running_sum_with_a_hot_group_equals_a_window(spark):
    df = spark.range(0, 30_000).selectExpr(
        "id * 37 % 1000003 AS k", "IF(id % 3 = 0, NULL, IF(id % 3 = 1, 'hot', concat('g', id % 50))) AS g",
        "id % 7 AS v",
    )
    ours = ordinals.running_sums(df, ["g"], ["k"], F.floor(F.col("k") / 5000), {"s": F.col("v")})
    plain = df.withColumn(
        "s", F.sum("v").over(Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    )
    assert ours.exceptAll(plain).count() == 0
    assert plain.exceptAll(ours).count() == 0


def test_no_task_gets_the_whole_hot_group(spark):
    df = spark.range(0, 200_000).selectExpr("'hot' AS g", "id AS k")
    plan = ordinals.row_number(df, ["g"], ["k"], ordinals.id_bucket("k"), "n")
    assert plan.agg(F.max("n")).first()[0] == 200_000
    biggest = df.groupBy(F.floor(F.col("k") / ordinals.WIDTH)).count().agg(F.max("count")).first()[0]
    assert biggest <= ordinals.WIDTH


def test_sampled_splitters_cut_a_group_with_one_day_stamp(spark, monkeypatch):
    monkeypatch.setattr(ordinals, "WIDTH", 500)
    df = spark.range(0, 30_000).selectExpr(
        "IF(id % 3 = 0, NULL, IF(id % 3 = 1, 1, 10 + id % 50)) AS attempt_id", "id * 7919 % 1000003 AS event_id",
        "IF(id % 3 = 1 OR id % 2 = 0, TIMESTAMP '2024-01-01', IF(id % 11 = 0, NULL, timestamp_seconds(id % 90))) AS ts",
        "id % 7 AS v", "'mine' AS extra",
    )
    order = ["ts", "event_id"]
    cut = ordinals.split_by_order(df, ["attempt_id"], order, "part").cache()
    sizes = {r["attempt_id"]: r for r in cut.groupBy("attempt_id", "part").count().groupBy("attempt_id").agg(
        F.count("*").alias("parts"), F.max("count").alias("most")).collect()}
    assert sizes[1].parts == sizes[None].parts == 20 and max(r.most for r in sizes.values()) < 1500
    assert all(r.parts == 1 for a, r in sizes.items() if a not in (1, None))
    back = Window.partitionBy("attempt_id").orderBy(*order)
    assert cut.withColumn("before", F.lag("part").over(back)).where("before > part").isEmpty()
    ours = ordinals.running_sums(df, ["attempt_id"], order, None, {"s": F.col("v"), "n": F.lit(1)})
    window = back.rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumns({"s": F.sum("v").over(window), "n": F.count("*").over(window)})
    assert ours.columns == plain.columns
    assert ours.exceptAll(plain).isEmpty() and plain.exceptAll(ours).isEmpty()


def test_splitters_of_a_huge_group_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ordinals, "WIDTH", 10)
    monkeypatch.setattr(ordinals, "SPLITTERS", 16)
    df = spark.range(0, 20_000).selectExpr("1 AS g", "id")
    cut = ordinals.split_by_order(df, ["g"], ["id"], "part").groupBy("part").count().collect()
    assert len(cut) == 16 and max(r["count"] for r in cut) < 3000
    empty = ordinals.running_sums(df.limit(0), ["g"], ["id"], None, {"n": F.lit(1)})
    assert empty.columns == ["g", "id", "n"] and empty.isEmpty()


# --- components ----------------------------------------------------------


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


def test_components(spark):
    draw = random.Random(1)
    pairs = [(draw.randrange(400), draw.randrange(400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    rows = components(spark.createDataFrame([*pairs, (None, 3), (5, 5)], "a long, b long")).collect()
    roots = union(1100, pairs)
    assert {r.node: r.root for r in rows} == {n: roots[n] for p in pairs for n in p if p[0] != p[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_root", lambda spark: str(tmp_path))
    components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")).count()
    assert len(os.listdir(tmp_path)) == 1  # the result
    with pytest.raises(ZeroDivisionError), staging.Scratch(spark, "broken") as tables:
        tables.stage(spark.range(5), "some")
        raise ZeroDivisionError
    assert len(os.listdir(tmp_path)) == 1


# --- hierarchy -----------------------------------------------------------


def test_limits_keep_children_unexpanded(spark, sf_dir, rows):
    limited = hierarchy.course_hierarchy(
        table(spark, sf_dir, "page_store"), table(spark, sf_dir, "seeds"), BASE, Limits(paths=1, modules=1, units=2)
    )
    assert limited.where("content IS NOT NULL").groupBy("module_url").count().agg(F.max("count")).first()[0] == 2
    full, cut = (
        df.groupBy("course_url").agg(F.count_distinct("path_ord").alias("n")).orderBy("course_url").collect()
        for df in (rows, limited)
    )
    assert full == cut
    assert limited.where("path_status = 'not_selected' AND module_ord IS NOT NULL").count() == 0


def test_progress_is_replaced_and_deleted_by_key(spark, tmp_path):
    store = ProgressStore(spark, str(tmp_path / "progress"), buckets=4)
    assert store.load().isEmpty()

    def progress(index, *attempts):
        return spark.createDataFrame([(a, 1, index, 0, 9, "t", "more") for a in attempts], f"{FIELDS}, bucket STRING")

    def stored():
        return {r.attempt_id: r.current_index for r in store.load().collect()}

    store.save(progress(1, *range(20), None))
    files = {f.name for f in (tmp_path / "progress").rglob("part-*.parquet")}
    store.save(progress(2, 3, None))
    assert stored() == {**{a: 1 for a in range(20)}, 3: 2, None: 2}
    assert files & {f.name for f in (tmp_path / "progress").rglob("part-*.parquet")}  # other buckets were left alone
    gone = spark.createDataFrame([(3,), (3,), (7,), (99,), (None,)], "attempt_id BIGINT")
    store.clear(gone)
    assert stored() == {a: 1 for a in range(20) if a not in (3, 7)}
    store.save(progress(1, 3))
    store.save(progress(1).limit(0))
    assert stored() == {a: 1 for a in range(20) if a != 7}
    store.clear(gone.limit(0))
    assert ProgressStore(spark, str(tmp_path / "progress"), buckets=4).load().count() == 19


@pytest.mark.parametrize("n", [0, None])
def test_zero_and_unset_limits_mean_all(n):
    assert Limits.selects("ord", n) == "ord IS NOT NULL"


def test_negative_limits_drop_from_the_end(spark, sf_dir, rows):
    limited = hierarchy.course_hierarchy(
        table(spark, sf_dir, "page_store"), table(spark, sf_dir, "seeds"), BASE, Limits(paths=-1, units=-6))
    paths = limited.where("path_url IS NOT NULL").groupBy("course_url").agg(
        F.count_distinct("path_ord").alias("n"),
        F.count_distinct(F.expr("IF(path_status = 'not_selected', path_ord, NULL)")).alias("cut")).collect()
    assert all(r.cut == 1 for r in paths) and sum(r.n for r in paths) > len(paths)
    units = limited.where("unit_url IS NOT NULL").groupBy("module_url").agg(
        F.count("*").alias("n"), F.count_if(F.expr("unit_status <> 'not_selected'")).alias("kept")).collect()
    assert units and all(r.kept == max(r.n - 6, 0) for r in units)


def test_repeated_pages_count_once_and_empty_ones_are_failed(spark, sf_dir, rows):
    pages = table(spark, sf_dir, "page_store")
    empty = pages.selectExpr("url", "'' AS html")
    got = hierarchy.course_hierarchy(
        pages.unionByName(pages).unionByName(empty), table(spark, sf_dir, "seeds"), BASE).drop("html_bytes")
    want = rows.drop("html_bytes").select(*got.columns)
    names = [c for c, t in got.dtypes if "<" not in t]
    assert got.count() == want.count()
    assert got.select(names).exceptAll(want.select(names)).count() == 0
    failed = hierarchy.course_hierarchy(empty, table(spark, sf_dir, "seeds"), BASE)
    assert {(r.course_title, r.course_status) for r in failed.collect()} == {("", "failed")}


def test_missing_and_failed_pages(spark):
    def link(href):
        return f"<a href='{href}'>T</a>"

    pages = spark.createDataFrame([
        ("https://h.org/c/1", "<h1>C</h1><article data-learn-uid='learn.p1'></article>"
                              "<article data-learn-uid='learn.p2'></article>"),
        ("https://h.org/c/2", None),
        ("https://h.org/en-us/training/paths/p1/", link("/modules/ok") + link("/modules/gone") + link("/modules/null")),
        ("https://h.org/en-us/training/modules/ok/", link("1-a") + link("2-b")),
        ("https://h.org/en-us/training/modules/null/", None),
        ("https://h.org/en-us/training/modules/ok/1-a", "<main>text</main>"),
    ], "url STRING, html STRING")
    seeds = spark.createDataFrame([("https://h.org/c/1",), ("https://h.org/c/2",), ("https://h.org/c/3",)],
                                  "course_url STRING")
    got = hierarchy.course_hierarchy(pages, seeds, "https://h.org").select(
        "course_url", "course_title", "path_title", "path_status", "module_status", "unit_status", "content"
    )
    assert sorted(map(str, (tuple(r)[0:] for r in got.collect()))) == sorted(map(str, [
        ("https://h.org/c/1", "C", "", "ok", "ok", "ok", "text"),
        ("https://h.org/c/1", "C", "", "ok", "ok", "failed", None),
        ("https://h.org/c/1", "C", "", "ok", "failed", None, None),
        ("https://h.org/c/1", "C", "", "ok", "failed", None, None),
        ("https://h.org/c/1", "C", "P2", "failed", None, None, None),
        ("https://h.org/c/2", "", None, None, None, None, None),
        ("https://h.org/c/3", "", None, None, None, None, None),
    ]))


def parsed_pages(monkeypatch):
    """What is parsed from now on: URLs by level."""
    seen = {"course": set(), "path": set(), "module": set(), "unit": set(), "looked up": set()}
    levels, units = hierarchy.level_facts, hierarchy.unit_facts

    def level_facts(pages, level, site):
        seen[level] |= {r.url for r in pages.select("url").collect()}
        return levels(pages, level, site)

    def unit_facts(pages, fields, site):
        seen["unit" if fields else "looked up"] |= {r.url for r in pages.select("url").collect()}
        return units(pages, fields, site)

    monkeypatch.setattr(hierarchy, "level_facts", level_facts)
    monkeypatch.setattr(hierarchy, "unit_facts", unit_facts)
    return seen


def urls_of(rows, level, condition="true"):
    return {r[0] for r in rows.where(f"{level}_url IS NOT NULL AND {condition}").select(f"{level}_url").distinct().collect()}


def test_only_the_frontier_is_parsed(spark, sf_dir, rows, monkeypatch):
    pages, seeds = table(spark, sf_dir, "page_store"), table(spark, sf_dir, "seeds")
    stored = {r.url for r in pages.select("url").collect()}
    seen = parsed_pages(monkeypatch)
    limits = Limits(paths=2, modules=2, units=3)
    limited = hierarchy.course_hierarchy(pages, seeds, BASE, limits)
    assert seen["course"] == urls_of(limited, "course")
    assert seen["path"] == stored & urls_of(limited, "path", "path_status <> 'not_selected'")
    assert seen["module"] == stored & urls_of(limited, "module", "module_status <> 'not_selected'")
    assert seen["unit"] == stored & urls_of(limited, "unit", "unit_status <> 'not_selected'") < urls_of(rows, "unit")
    seen = parsed_pages(monkeypatch)
    hierarchy.course_hierarchy(pages, seeds, BASE, extract_content=False, look_up_units=False)
    assert not seen["unit"] | seen["looked up"] and seen["module"]
    hierarchy.course_hierarchy(pages, seeds, BASE, extract_content=False)
    assert not seen["unit"] and seen["looked up"] == stored & urls_of(rows, "unit")


def test_filter_of_a_frontier_loses_no_page(spark, monkeypatch):
    pages = spark.range(5000).selectExpr("concat('u', id) AS url", "'x' AS html", "'y' AS bits", "1 AS bucket", "2 AS place").union(
        spark.sql("SELECT NULL, NULL, NULL, NULL, NULL"))
    frontier = spark.range(0, 9000, 7).selectExpr("concat('u', id) AS url")
    wanted = {f"u{i}" for i in range(0, 5000, 7)}
    assert {r.url for r in hierarchy.frontier_pages(pages, frontier).collect()} == wanted
    monkeypatch.setattr(hierarchy, "FILTER_BITS", 1 << 12)  # nearly a third of the bits are set
    assert wanted < {r.url for r in hierarchy.frontier_pages(pages, frontier).collect()} < {f"u{i}" for i in range(5000)} | {None}
    assert hierarchy.frontier_pages(pages, frontier.limit(0)).count() == 0
    plan = hierarchy.frontier_pages(pages, frontier)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


# --- resume --------------------------------------------------------------


def test_a_resumed_run_looks_up_what_is_not_stored(spark, sf_dir, rows, monkeypatch):
    pages, seeds = table(spark, sf_dir, "page_store"), table(spark, sf_dir, "seeds")
    units = rows.where("unit_ord IS NOT NULL")
    fields = ["content", "headings", "code_blocks", "images", "links"]
    first = units.where("content <> '' AND unit_ord % 2 = 0").selectExpr("unit_ord AS ord", *resume.KEY, *fields)
    snapshot = first.withColumn("content", F.concat(F.lit("stored: "), "content")).cache()
    seen = parsed_pages(monkeypatch)
    limits = Limits(units=5)
    again = hierarchy.course_hierarchy(pages, seeds, BASE, limits, snapshot=snapshot).cache()
    expected = resume.resume_merge(units, snapshot, fields).where("unit_ord < 5")
    got = again.where("unit_ord < 5").select(*expected.drop("html_bytes", "unit_status").columns)
    names = [c for c, kind in got.dtypes if "<" not in kind]
    assert got.select(names).exceptAll(expected.select(names)).count() == 0 and got.count() == expected.count()
    assert {str(r) for r in got.select("unit_url", *fields).collect()} == {str(r) for r in expected.select("unit_url", *fields).collect()}
    resumed = urls_of(again, "unit", "resumed")
    assert resumed and not resumed & seen["unit"]
    assert {r[0] for r in again.where("resumed").select("unit_status").distinct().collect()} == {"resumed"}
    assert again.where("unit_status = 'not_selected' AND (resumed OR content IS NOT NULL)").count() == 0
    # a run without extraction takes stored content and nothing else
    seen["unit"].clear()
    stored = hierarchy.course_hierarchy(pages, seeds, BASE, limits, False, False, snapshot)
    assert stored.where("content IS NOT NULL").count() == again.where("resumed").count() and not seen["unit"]


def test_todo_and_done_cover_all_units(spark, sf_dir, rows):
    units = rows.where("unit_url IS NOT NULL")
    snapshot = table(spark, sf_dir, "unit_snapshot").withColumnRenamed("page_id", "ord")
    done, todo = resume.units_done(units, snapshot), resume.units_todo(units, snapshot)
    assert done.count() + todo.count() == units.count()
    assert done.count() == resume.snapshot_match(units, snapshot).count() > 0


def test_first_stored_copy_wins_and_empty_content_is_not_done(spark):
    snapshot = spark.createDataFrame(
        [(3, "c", "p", "m", "u", "late"), (2, "c", "p", "m", "u", "early"), (1, "c", "p", "m", "u", ""),
         (4, "c", "p", "m", "v", ""), (0, "d", "p", "m", "v", "of another course")],
        "ord INT, course_url STRING, path_title STRING, module_title STRING, unit_title STRING, content STRING")
    units = spark.createDataFrame(
        [("c", "p", "m", "u", "new"), ("c", "p", "m", "v", "new")],
        "course_url STRING, path_title STRING, module_title STRING, unit_title STRING, content STRING")
    merged = {r.unit_title: (r.content, r.resumed) for r in resume.resume_merge(units, snapshot, ["content"]).collect()}
    assert merged == {"u": ("early", True), "v": ("new", False)}
    assert [r.unit_title for r in resume.units_todo(units, snapshot).collect()] == ["v"]


# --- publishing ----------------------------------------------------------


def read_parts(folder):
    text = []
    for name in sorted(os.listdir(folder)):
        if name.startswith("part-"):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                text.append(f.read())
    return "".join(text)


def test_complete_document_is_one_json_object(spark, rows, tmp_path):
    lines = publish.complete_lines(rows.withColumn("course_title", F.lit("one title for all")))
    files.write_complete(lines, str(tmp_path / "complete"))
    folders = [f for f in os.listdir(tmp_path / "complete") if f.startswith("course_key=")]
    assert len(folders) == rows.select("course_url").distinct().count()
    for folder in folders:
        course = json.loads(read_parts(tmp_path / "complete" / folder))
        flat = rows.where(F.col("course_url") == course["url"])
        units = [u for p in course["learning_paths"] for m in p["modules"] for u in m["units"]]
        assert len(units) == flat.where("unit_ord IS NOT NULL").count()
        expected = [r.unit_url for r in flat.where("unit_ord IS NOT NULL").orderBy(
            "path_ord", "module_ord", "unit_ord").collect()]
        assert [u["url"] for u in units] == expected
    pretty = tmp_path / "c_complete.json"
    pretty.write_text(json.dumps(course, indent=2, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "bad_complete.json").write_text('{"url": "x", "learning', encoding="utf-8")
    stored = files.snapshot_units(files.read_snapshot(spark, str(tmp_path / "*_complete.json")))
    assert stored.count() == len(units)
    assert files.read_snapshot(spark, str(tmp_path / "none_complete.json")).count() == 0


def test_training_record_has_the_ten_fields(rows):
    assert publish.training_records(rows, "2025-01-01T00:00:00").columns == publish.TRAINING_FIELDS
    assert publish.training_records(rows).where("content = ''").count() == 0


def test_summary_of_a_structure_only_run_has_no_training_file(spark, rows, tmp_path):
    summary = publish.course_summary(rows, Limits(paths=2), content_extracted=False, scraped_at="t")
    files.write_summary_files(summary, str(tmp_path / "s"))
    read = files.read_summaries(spark, str(tmp_path / "s")).first()
    assert read.files_created[1] is None and not read.content_extracted
    assert (read.limits_applied.max_paths, read.limits_applied.max_units_per_module) == (2, None)


def test_question_files(spark, sf_dir, tmp_path):
    questions = bank.with_options(table(spark, sf_dir, "question_bank"))
    n = questions.count()
    path = str(tmp_path / "q")
    files.write_questions(questions, path, "overwrite")
    files.write_questions(questions, path, "append")
    assert files.read_questions(spark, path).count() == 2 * n
    files.write_questions(questions, path, "overwrite")
    assert files.read_questions(spark, path).count() == n
    with pytest.raises(ValueError):
        files.write_questions(questions, path, "merge")
    (tmp_path / "bad.jsonl").write_text('{"question": "a"}\n\n{"question": \n')
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_questions(spark, str(tmp_path / "bad.jsonl")).collect()

    files.write_json_array(questions, "question_id", str(tmp_path / "array"))
    parsed = json.loads(read_parts(tmp_path / "array"))
    assert [p["options"]["A"] for p in parsed] == [f"first {i}" for i in range(n)]
    files.write_json_array(questions.unionByName(questions), "question_id", str(tmp_path / "twice"))
    assert len(json.loads(read_parts(tmp_path / "twice"))) == 2 * n
    files.write_xml(questions, str(tmp_path / "xml"))
    assert spark.read.format("xml").option("rowTag", "question").load(str(tmp_path / "xml")).count() == n
    files.write_csv(questions, str(tmp_path / "csv"))
    back = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.count() == n


def test_line_numbers_across_splits(spark, tmp_path):
    path = tmp_path / "lines.jsonl"
    path.write_text("".join(f'{{"n": {i}}}\n' if i % 10 else "{broken\n" for i in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = files.numbered_lines(spark, str(path))
        bad = [r.line_no for r in bank.malformed_lines(lines, "line_no").orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert bad == list(range(10, 5001, 10))


# --- bank ----------------------------------------------------------------


def question(spark, **changes):
    fields = {
        "question_id": 1, "question": "q. q. q", "options": {c: c for c in "ABCD"}, "correct_answer": "A",
        "explanation": "e", "learning_path": "p", "module": "m", "additional_notes": "",
    } | changes
    schema = "question_id INT, " + files.QUESTION
    names = [c.split()[0] for c in schema.replace("MAP<STRING,STRING>", "MAP").split(", ")]
    return spark.createDataFrame([tuple(fields[n] for n in names)], schema)


@pytest.mark.parametrize("changes, missing", [
    ({}, []), ({"additional_notes": None}, ["additional_notes"]), ({"module": ""}, ["module"]),
    ({"options": {}}, ["options"]), ({"question": None, "explanation": ""}, ["question", "explanation"]),
])
def test_required_fields(spark, changes, missing):
    assert [r.field for r in bank.missing_fields(question(spark, **changes)).collect()] == missing


@pytest.mark.parametrize("changes, flags", [
    ({}, (True, True, True)), ({"correct_answer": "E"}, (True, True, False)),
    ({"options": {"A": "x", "B": " ", "C": "y"}}, (False, False, True)),
])
def test_option_shape(spark, changes, flags):
    row = bank.option_problems(question(spark, **changes)).first()
    assert (row.keys_ok, row.texts_ok, row.answer_ok) == flags


def test_largest_remainder(spark):
    request = spark.createDataFrame([("p", 10, "even"), ("q", 7, "proportional")],
                                    "learning_path STRING, requested BIGINT, distribution STRING")
    inventory = spark.createDataFrame(
        [("p", "a", 9), ("p", "b", 1), ("p", "c", 1), ("q", "a", 3), ("q", "b", 1)],
        "learning_path STRING, module STRING, units BIGINT")
    got = {(r.learning_path, r.module): r.quota for r in bank.quota_alloc(request, inventory).collect()}
    assert got == {("p", "a"): 4, ("p", "b"): 3, ("p", "c"): 3, ("q", "a"): 5, ("q", "b"): 2}


def test_quotas_add_up(spark, sf_dir):
    inventory = bank.module_inventory(table(spark, sf_dir, "question_bank"), "question")
    request = table(spark, sf_dir, "request")
    for quotas, keys in [(bank.quota_alloc(request, inventory), ["learning_path"]),
                         (bank.quota_mix(request), ["learning_path", "kind"])]:
        sums = quotas.groupBy(*keys, "requested").agg(F.sum("quota").alias("q"))
        assert sums.where("q <> requested").count() == 0


def brute_pairs(texts, threshold):
    import re

    sets = {}
    for i, text in texts.items():
        words = re.findall(r"\w+", text.lower())
        if words:
            sets[i] = frozenset(tuple(words[k:k + 3]) for k in range(max(len(words) - 2, 1)))
    owner = {}
    for i in sorted(sets):
        owner.setdefault(sets[i], i)
    pairs = {(owner[s], i) for i, s in sets.items() if owner[s] != i}
    for a, b in itertools.combinations(sorted(owner.values()), 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
            pairs.add((a, b))
    return pairs


def test_exemplar_differences(spark, tmp_path):
    exemplar = tmp_path / "exemplar.jsonl"
    exemplar.write_text('{"q": "x", "n": 1, "o": {"A": "a", "it\'s": {"deep": true}}, "tags": ["t"]}\n{"q": "y", "o": {"B": "b"}}\n')
    schema = files.read_exemplar(spark, str(exemplar))
    whole = '"n": 2.5, "tags": []'
    lines = {
        1: '{"q": "z", %s, "o": {"A": "a", "B": null, "it\'s": {"deep": false}}}' % whole,
        2: '{"q": 7, %s, "o": {"A": "a", "B": "b", "C": "c", "it\'s": {"deep": "no", "more": 1}}}' % whole,
        3: '{"q": "z", %s, "o": "text"}' % whole,
        4: '{"q": null, "tags": {}, "extra": 1}',
        5: '{"q": "cut', 6: None, 7: "[1]", 8: "",
    }
    df = spark.createDataFrame(list(lines.items()), "line_no INT, line STRING").withColumn("field", F.lit("clash"))
    got = {(r.line_no, r.field, r.problem) for r in bank.exemplar_differences(df, schema, "line_no").collect()}
    assert got == {
        (2, "q", "type"), (2, "o.C", "unexpected"), (2, "o.it's.deep", "type"), (2, "o.it's.more", "unexpected"), (3, "o", "type"),
        (4, "n", "missing"), (4, "o", "missing"), (4, "tags", "type"), (4, "extra", "unexpected"),
    }
    assert bank.exemplar_differences(df.limit(0), schema, "line_no").isEmpty()


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_near_duplicates_equal_brute_force(spark, threshold, monkeypatch):
    monkeypatch.setattr(bank, "_BLOCK", 8)  # force several blocks per hot shingle
    rng = random.Random(3)
    base = [[rng.choice("abcdefghij") * 2 + str(rng.randint(0, 30)) for _ in range(40)] for _ in range(6)]
    texts = {}
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 50)}"
        texts[i] = " ".join(words)
    texts |= {200: "", 201: "one", 202: "One!", 203: "two words", 204: texts[0]}
    df = spark.createDataFrame(list(texts.items()), "question_id BIGINT, question STRING")
    got = {(r.question_id, r.similar_id) for r in bank.near_duplicates(df, threshold).collect()}
    assert got == brute_pairs(texts, threshold)


def test_near_duplicate_groups(spark):
    chain = [" ".join(f"w{k}" for k in range(i, i + 60)) for i in range(4)]  # neighbours share 57 of 59 shingles
    far = " ".join(f"w{k}" for k in range(12, 72))  # similar to the last of the chain only through what lies between: to none
    texts = {10: chain[3], 2: chain[0], 7: chain[1], 9: chain[2], 5: chain[0], 20: far, 21: far, 30: "", 31: "", 32: "...", 33: None, 34: None,
             40: "one", 41: "ONE!"}
    df = spark.createDataFrame(list(texts.items()), "question_id BIGINT, question STRING").withColumn("owner_id", F.lit("clash"))
    got = {r.question_id: (r.owner_id, r.group_id) for r in bank.near_duplicate_groups(df, 0.9).collect()}
    assert got == {2: (2, 2), 5: (2, 2), 7: (7, 2), 9: (9, 2), 10: (10, 2), 20: (20, 20), 21: (20, 20), 30: (30, 30), 31: (30, 30),
                   32: (32, 32), 33: (33, 33), 34: (34, 34), 40: (40, 40), 41: (40, 40)}
    pairs = {(r.question_id, r.similar_id) for r in bank.near_duplicates(df, 0.9).collect()}
    assert {(2, 5), (20, 21), (30, 31), (40, 41)} <= pairs and all(got[a][1] == got[b][1] for a, b in pairs)
    assert bank.near_duplicate_groups(df.limit(0)).isEmpty()


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_near_duplicate_groups_equal_brute_force(spark, threshold, monkeypatch):
    monkeypatch.setattr(bank, "_BLOCK", 4)  # several blocks per hot shingle, also of one part
    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") * 2 + str(rng.randint(0, 30)) for _ in range(40)] for _ in range(8)]
    texts = {}
    for i in rng.sample(range(1000), 150):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 50)}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "question_id BIGINT, question STRING")
    group = {i: i for i in texts}
    pairs, changed = brute_pairs(texts, threshold), True
    while changed:
        changed = False
        for a, b in pairs:
            least = min(group[a], group[b])
            changed |= group[a] != group[b]
            group[a] = group[b] = least
    assert {r.question_id: r.group_id for r in bank.near_duplicate_groups(df, threshold).collect()} == group
    assert len(set(group.values())) > 8


def test_groups_do_not_compare_all_pairs_of_a_family(spark, monkeypatch):
    """200 texts that differ by a word are 19,900 similar pairs; their group needs about one comparison each."""
    words = [f"w{k}" for k in range(200)]
    texts = [(i, " ".join([*words[:i], f"new{i}", *words[i + 1:]])) for i in range(200)]
    df = spark.createDataFrame(texts, "question_id BIGINT, question STRING")
    written, keep = [], staging.Scratch.stage

    def count(self, table, label):
        kept = keep(self, table, label)
        if {"a", "b"} <= set(kept.columns):
            written.append(kept.count())
        return kept

    def count_similar(table, label):
        kept = keep_stage(table, label)
        written.append(kept.count() if label == "similar" else 0)
        return kept

    keep_stage = bank.stage
    monkeypatch.setattr(staging.Scratch, "stage", count)
    monkeypatch.setattr(bank, "stage", count_similar)
    assert {r.group_id for r in bank.near_duplicate_groups(df).collect()} == {0}
    assert sum(written) < 2000


@pytest.mark.parametrize("entries, every, often", [(8, 1, 1), (1 << 12, 2, 2)])
def test_only_first_places_are_counted(spark, monkeypatch, entries, every, often):
    """A fifth of the shingles of a set is counted; the table that orders them does not change the result."""
    for name, value in {"_ENTRIES": entries, "_EVERY": every, "_OFTEN": often, "_AT_ONCE": 64}.items():
        monkeypatch.setattr(bank, name, value)
    rng = random.Random(11)
    base = [[rng.choice("abcdef") + str(rng.randint(0, 9)) for _ in range(rng.randint(30, 60))] for _ in range(8)]
    texts = {i: " ".join(w if rng.random() > 0.03 else f"new{rng.randint(0, 50)}" for w in rng.choice(base)) for i in range(100)}
    df = spark.createDataFrame(list(texts.items()), "question_id BIGINT, question STRING").repartition(2)
    counted, keep = [], staging.Scratch.stage

    def count(self, table, label):
        kept = keep(self, table, label)
        if label == "firsts":
            counted.append(kept.selectExpr("sum(size(firsts)) / sum(n)").first()[0])
        return kept

    monkeypatch.setattr(staging.Scratch, "stage", count)
    pairs = brute_pairs(texts, 0.8)
    assert {(r.question_id, r.similar_id) for r in bank.near_duplicates(df).collect()} == pairs and len(pairs) > 50
    assert len(counted) == 1 and counted[0] < 0.25


def test_late_places_do_not_meet_each_other(spark, monkeypatch):
    """Sets that share only a shingle late in their prefixes make no pairs, an early one still finds the similar pair."""
    n = 40
    rows = [(i, n, 7, 60, 8) for i in range(60)] + [(i, n, 9, 2, place) for i, place in ((0, 1), (1, 2))]
    places = spark.createDataFrame(rows, "question_id BIGINT, n INT, shingle BIGINT, df BIGINT, place INT").withColumn("part", F.col("question_id"))
    heads = spark.createDataFrame([(i, [7, 9] if i < 2 else [7]) for i in range(60)], "question_id BIGINT, head ARRAY<BIGINT>")
    met, keep = [], bank._passing

    def count(pairs, *more):
        met.append(pairs.count())
        return keep(pairs, *more)

    monkeypatch.setattr(bank, "_passing", count)
    bank._candidates(places, heads, 0.8).collect()
    assert met == [1]  # 1,770 pairs share shingle 7


def test_merge_keeps_the_first_of_equal_texts(spark):
    df = spark.createDataFrame(
        [(1, 5, "A  b"), (1, 9, "a B "), (2, 1, "a b"), (2, 2, "other")],
        "batch INT, question_id INT, question STRING")
    assert sorted((r.batch, r.question_id) for r in bank.merge_dedup(df).collect()) == [(1, 5), (2, 2)]


# --- quiz ----------------------------------------------------------------


def test_sample_ignores_partitioning_and_extends(spark):
    questions = spark.range(0, 5000).withColumnRenamed("id", "question_id")
    one = quiz.sample(questions.repartition(3), 7, 25).orderBy("position").collect()
    two = quiz.sample(questions.repartition(11), 7, 25).orderBy("position").collect()
    everything = quiz.sample(questions, 7).orderBy("position").collect()
    assert one == two == everything[:25]
    assert [r.position for r in everything] == list(range(1, 5001))
    assert quiz.sample(questions, 8, 25).orderBy("position").collect() != one


@pytest.mark.parametrize("selection, everything, paths", [
    ("1,99", False, ["a"]), ("1,x", True, []), ("99", False, [None]), (" 2 , 1", False, ["a", "b"]), ("", True, []),
])
def test_path_selection(spark, selection, everything, paths):
    catalog = spark.createDataFrame([(1, "a"), (2, "b")], "path_no BIGINT, learning_path STRING")
    request = spark.createDataFrame([(1, selection)], "attempt_id INT, selection STRING")
    got = quiz.path_selection(request, catalog).collect()
    assert any(r.all_paths for r in got) == everything
    assert sorted(r.learning_path for r in got if not r.all_paths) == paths


def test_quiz_flow(spark):
    questions = spark.createDataFrame(
        [(1, "A", "p", "m1"), (2, "B", "p", "m2"), (3, "C", "q", "m3"), (4, "D", "p", "m4"), (5, "A", "p", "m5")],
        "question_id BIGINT, correct_answer STRING, learning_path STRING, module STRING")
    answers = spark.sql("""SELECT CAST(id AS BIGINT) AS event_id, CAST(a AS BIGINT) AS attempt_id,
        timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id, 0) AS ts,
        CAST(q AS BIGINT) AS question_id, u AS user_answer
        FROM VALUES (1, 1, 1, ' a'), (2, 1, 2, 'z'), (3, 1, 2, 'c'), (4, 1, 3, 'C '), (5, 1, 4, 'A'), (6, 1, 5, 'b'),
          (7, 1, 2, 'D'), (8, 2, 1, 'a') AS t(id, a, q, u)""")
    scored = quiz.score_answers(answers, questions)
    assert [(r.position, r.score) for r in quiz.running_score(scored).where("attempt_id = 1").orderBy("position").collect()
            ] == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 2)]
    result = quiz.rounded(quiz.results(scored)).where("attempt_id = 1").first()
    assert (result.score, result.total, result.percentage_1, result.percentage_0) == (2, 6, 33.3, 33.0)
    wrong = {(r.attempt_id, r.learning_path, r.n_wrong, r.perfect) for r in quiz.wrong_by_path(scored).collect()}
    assert wrong == {(1, "p", 4, False), (2, None, 0, True)}
    modules = quiz.weak_modules(scored).orderBy("rank").collect()
    assert [(r.rank, r.module, r.n_more) for r in modules] == [(1, "m2", 1), (2, "m4", 1), (3, "m5", 1)]


def test_percentages_round_half_to_even(spark):
    results = spark.createDataFrame([(1, 1, 8, 12.5)], "attempt_id INT, score INT, total INT, percentage DOUBLE")
    row = quiz.rounded(results).first()
    assert (row.percentage_1, row.percentage_0) == (12.5, 12.0)


def test_sets_are_written_once(spark, monkeypatch):
    """Only the sets of possible copies are written a second time."""
    df = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i}" if i > 1 else "same words in both") for i in range(200)], "question_id BIGINT, question STRING")
    written, keep = [], staging.Scratch.stage

    def count(self, table, label):
        kept = keep(self, table, label)
        written.append(kept.count() if "shingles" in kept.columns else 0)
        return kept

    monkeypatch.setattr(staging.Scratch, "stage", count)
    assert [tuple(r) for r in bank.near_duplicates(df).collect()] == [(0, 1, 1.0)]
    assert 200 <= sum(written) < 250


# --- quizzes of their own ------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4099])
def test_permutation_and_its_inverse(spark, n):
    keyed = spark.range(n).selectExpr("id", f"{n}L AS n", f"{permutation.keys('concat(7, n)')} AS k", f"{permutation.keys('concat(8, n)')} AS other")
    there = keyed.selectExpr("*", f"{permutation.permuted('id', 'n', 'k')} AS p", f"{permutation.permuted('id', 'n', 'other')} AS o")
    rows = there.selectExpr("id", "p", "o", f"{permutation.permuted('p', 'n', 'k', inverse=True)} AS back").collect()
    assert sorted(r.p for r in rows) == list(range(n)) == sorted(r.o for r in rows)
    assert all(r.back == r.id for r in rows)
    if n > 50:
        assert sum(r.p == r.id for r in rows) < 8 and [r.p for r in rows] != [r.o for r in rows]


def test_permutations_are_spread(spark):
    """Over many keys every place goes about equally often to every other."""
    drawn = spark.range(30_000).selectExpr("9L AS n", f"{permutation.keys('id')} AS k").selectExpr(
        f"{permutation.permuted('0L', 'n', 'k')} AS first", f"{permutation.permuted('8L', 'n', 'k')} AS last")
    for column in ("first", "last"):
        counts = [r["count"] for r in drawn.groupBy(column).count().collect()]
        assert len(counts) == 9 and max(abs(c - 30_000 / 9) for c in counts) < 350


def own_quizzes(spark):
    questions = spark.createDataFrame(
        [(i, None if i % 10 == 9 else f"p{i % 4}") for i in range(100, 400)], "question_id BIGINT, learning_path STRING")
    requests = spark.createDataFrame(
        [(1, "1,3", "20"), (2, "", ""), (3, "2", "1000"), (4, "77", ""), (5, "3,2,3", ""), (6, "x", "130"), (7, "4", "1"), (8, "1,3", "20")],
        "attempt_id BIGINT, selection STRING, requested STRING")
    catalog = bank.path_catalog(questions)
    quizzes = quiz.attempt_quizzes(requests, quiz.path_selection(requests, catalog), catalog, 42)
    return questions, quizzes, quiz.numbered_questions(questions, catalog)


def test_every_attempt_has_a_quiz_of_its_own(spark):
    questions, quizzes, numbered = own_quizzes(spark)
    rows = [tuple(r) for r in quiz.quiz_questions(quizzes, numbered).collect()]
    path_of = {r.question_id: r.learning_path for r in questions.collect()}
    names = sorted(set(path_of.values()), key=lambda p: (p is not None, p or ""))
    chosen = {1: {0, 2}, 2: set(range(5)), 5: {1, 2}, 6: set(range(5)), 7: {3}, 8: {0, 2}}
    by = {i: sorted(r[1:] for r in rows if r[0] == i) if i in chosen else [r[1:] for r in rows if r[0] == i] for i in range(1, 9)}
    assert by[3] == by[4] == [(None, None)]  # too many asked for, and no such path
    for i, paths in chosen.items():
        allowed = {q for q, p in path_of.items() if p in {names[k] for k in paths}}
        n = {1: 20, 6: 130, 7: 1, 8: 20}.get(i, len(allowed))
        assert [p for p, _ in by[i]] == list(range(1, n + 1)) and len({q for _, q in by[i]}) == n
        assert {q for _, q in by[i]} <= allowed
    assert by[1] != by[8] and [q for _, q in by[2]] != sorted(q for _, q in by[2])
    again = quiz.quiz_questions(quizzes.repartition(7, "total"), numbered.repartition(5))
    assert sorted(map(str, (tuple(r) for r in again.collect()))) == sorted(map(str, rows))


def test_remainder_of_own_quizzes(spark):
    questions, quizzes, numbered = own_quizzes(spark)
    listed = {(r.attempt_id, r.question_id): r.position for r in quiz.quiz_questions(quizzes, numbered).collect()}
    draw = random.Random(2)
    answers = [(i, q) for (i, q) in listed if q is not None and (i in (7, 8) or draw.random() < 0.5)]
    strange = [(1, q) for q in range(100, 400) if (1, q) not in listed] + [(3, 100), (99, 100), (2, 5000)]
    answered = spark.createDataFrame(answers + answers[:50] + strange, "attempt_id BIGINT, question_id BIGINT")
    found = {(r.attempt_id, r.question_id): r.position for r in quiz.quiz_remainder(quizzes, numbered, answered).collect()}
    assert found == {k: p for k, p in listed.items() if k[1] is not None and k not in set(answers)}
    assert not {i for i, _ in found} & {7, 8}
    everything = quiz.quiz_remainder(quizzes, numbered, answered.limit(0))
    assert everything.count() == sum(q is not None for _, q in listed)


def test_only_open_words_are_listed(spark):
    sizes = spark.createDataFrame([(1, 200), (2, 64), (3, 65), (4, 130), (5, None)], "attempt_id BIGINT, total BIGINT")
    done = [(1, p) for p in range(1, 201)] + [(2, p) for p in range(1, 65)] + [(3, p) for p in range(1, 65)] + [(4, 64), (4, 64), (4, 128)]
    left = quiz.open_positions(sizes, spark.createDataFrame(done, "attempt_id BIGINT, position BIGINT"))
    assert sorted(map(tuple, left.collect())) == [(3, 65)] + [(4, p) for p in range(1, 131) if p not in (64, 128)]


@pytest.mark.parametrize("n", [1, 2, 3, 65, 4099])
def test_compiled_permutation_is_the_same(spark, n):
    keyed = spark.range(n).selectExpr("id", f"{n}L AS n", f"{permutation.keys('concat(7, n)')} AS k")
    flat = keyed.selectExpr("*", *permutation.flat_keys("k", "n"))
    for inverse in (False, True):
        both = permutation.with_permuted(flat.withColumn("p", F.expr(permutation.permuted("id", "n", "k", inverse))), "id", "n", "q", inverse)
        assert both.columns == ["id", "n", "k", "p", "q"] and both.where("p = q").count() == n


def test_quizzes_by_question_equal_quizzes_by_position(spark, monkeypatch):
    _, quizzes, numbered = own_quizzes(spark)
    quizzes, numbered = staging.stage(quizzes, "quizzes"), staging.stage(numbered, "numbered")
    made = quiz.quiz_questions(quizzes, numbered).collect()  # by position: these quizzes are small
    known, rows = sorted(map(str, made)), [r for r in made if r.question_id is not None]
    answered = spark.createDataFrame([(r.attempt_id, r.question_id) for r in rows if r.question_id % 3 or r.attempt_id == 6] + [(1, 101), (99, 100)],
                                     "attempt_id BIGINT, question_id BIGINT")
    left = sorted(str(r) for r in rows if not (r.question_id % 3 or r.attempt_id == 6))
    monkeypatch.setattr(quiz, "BLOCK", 64)
    monkeypatch.setattr(quiz, "WIDE", "total >= 60")
    monkeypatch.setattr(quiz, "TASK_ROWS", 200)
    assert sorted(map(str, quiz.quiz_questions(quizzes, numbered).collect())) == known
    assert sorted(map(str, quiz.quiz_remainder(quizzes, numbered, answered).collect())) == left


def shuffled_rows(plan):
    """Rows written by the exchanges of an executed plan."""
    kind, rows = plan.getClass().getSimpleName(), 0
    if kind == "AdaptiveSparkPlanExec":
        return shuffled_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled_rows(plan.plan())
    if kind == "ShuffleExchangeExec":
        rows = plan.metrics().apply("shuffleRecordsWritten").value()
    return rows + sum(shuffled_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_whole_quizzes_are_not_shuffled(spark):
    """30 attempts at all of 5,000 questions: far fewer rows are shuffled than made."""
    questions = spark.range(5000).selectExpr("id AS question_id", "concat('p', id % 3) AS learning_path")
    requests = spark.range(30).selectExpr("id AS attempt_id", "IF(id % 2 = 0, '', '1,2,3') AS selection", "'' AS requested")
    catalog = bank.path_catalog(questions)
    quizzes = staging.stage(quiz.attempt_quizzes(requests, quiz.path_selection(requests, catalog), catalog, 42), "quizzes")
    numbered = staging.stage(quiz.numbered_questions(questions, catalog), "numbered")
    answered = spark.range(900).selectExpr("id % 30 AS attempt_id", "id AS question_id")
    for df, n in [(quiz.quiz_questions(quizzes, numbered), 150_000), (quiz.quiz_remainder(quizzes, numbered, answered), 149_100)]:
        assert len(df.collect()) == n
        assert shuffled_rows(df._jdf.queryExecution().executedPlan()) < 60_000


def test_rows_of_large_quizzes_are_not_shuffled(spark, monkeypatch):
    """60 attempts at 1,100 of 30,000 questions and at all of them: what is shuffled goes by the inputs, not by the rows."""
    monkeypatch.setattr(quiz, "TASK_ROWS", 1 << 17)
    questions = spark.range(30_000).selectExpr("id AS question_id", "concat('p', id % 3) AS learning_path")
    requests = spark.range(63).selectExpr("id AS attempt_id", "'' AS selection", "IF(id < 60, '1100', '') AS requested")
    catalog = bank.path_catalog(questions)
    quizzes = staging.stage(quiz.attempt_quizzes(requests, quiz.path_selection(requests, catalog), catalog, 42), "quizzes")
    numbered = staging.stage(quiz.numbered_questions(questions, catalog), "numbered")
    df = quiz.quiz_questions(quizzes, numbered)
    rows = df.groupBy("attempt_id").agg(F.count("*").alias("n"), F.countDistinct("question_id").alias("q"), F.max("position").alias("last"))
    assert {tuple(r) for r in rows.collect()} == {(i, *[1100 if i < 60 else 30_000] * 3) for i in range(63)}
    df.collect()
    assert shuffled_rows(df._jdf.queryExecution().executedPlan()) < 10_000
