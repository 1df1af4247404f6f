"""Plan shape: what must and must not appear in physical plans."""

import re

import pytest

from coursemill.operators import content, markup, quiz, structure
from coursemill.plans.catalog import REGISTRY

NO_STREAM = [n for n in REGISTRY if not n.startswith("stream_")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["course_hierarchy", "q_near_dup", "running_score", "weak_modules", "sample_size",
                                  "resume_questions", "quota_mix", "unit_record", "q_merge_dedup", "mix_vs_target"])
def test_no_python_and_no_cartesian(spark, sf_dir, name):
    plan = plan_of(REGISTRY[name](spark, sf_dir))
    assert not re.search(r"PythonUDF|ArrowEvalPython|MapInPandas|FlatMapGroups", plan)
    assert not re.search(r"CartesianProduct|NestedLoopJoin", plan)


@pytest.mark.parametrize("build", [
    lambda p: content.unit_content(p), lambda p: markup.html_tokens(p), lambda p: structure.modules(p),
    lambda p: structure.units(p), lambda p: content.items(p, "images", ["c.src"]), lambda p: structure.page_titles(p),
])
def test_page_work_never_shuffles_and_parses_once(spark, sf_dir, build):
    plan = plan_of(build(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    assert "Exchange" not in plan
    assert plan.count("regexp_extract_all(html") == 1


def test_title_reads_two_columns(spark, sf_dir):
    plan = plan_of(structure.page_titles(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan


def test_top_k_of_each_path_is_cut_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan_of(REGISTRY["weak_modules"](spark, sf_dir))


def test_every_sample_size_has_one_plan(spark):
    questions = spark.range(10).withColumnRenamed("id", "question_id")
    small, large = (plan_of(quiz.sample(questions, 1, n)) for n in (5, 10_000_000))
    assert re.sub(r"\d+", "", small) == re.sub(r"\d+", "", large)


@pytest.mark.parametrize("partitions", ["2", "37"])
def test_results_do_not_depend_on_partitions(spark, sf_dir, partitions):
    names = ["running_score", "batch_plan", "quota_alloc", "unit_order"]
    expected = {n: sorted(map(str, REGISTRY[n](spark, sf_dir).collect())) for n in names}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {n: sorted(map(str, REGISTRY[n](spark, sf_dir).collect())) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == expected
