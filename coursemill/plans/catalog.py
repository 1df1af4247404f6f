"""Registered queries: every operator over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.functions import markup, rules, urls
from coursemill.operators import bank, content, hierarchy, publish, quiz, resume, structure
from coursemill.operators import markup as markup_ops
from coursemill.operators.hierarchy import Limits
from coursemill.plans.fixtures import BASE, table
from coursemill.session import tune
from coursemill.sources import files
from coursemill.sources.progress import ProgressStore
from coursemill.sources.staging import new_path, stage
from coursemill.streaming import ingest, scores

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

STAMP = "2025-01-01T00:00:00.000000"
SEED = 42
SAMPLE = 20


def register(name: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(tune(spark), sf_dir)

        REGISTRY[name] = run
        return query

    return add


def _bank(spark: SparkSession, sf: str) -> DataFrame:
    return bank.with_options(table(spark, sf, "question_bank"))


def _hierarchy(spark: SparkSession, sf: str, limits: Limits = Limits(), **mode) -> DataFrame:
    return hierarchy.course_hierarchy(table(spark, sf, "page_store"), table(spark, sf, "seeds"), BASE, limits, **mode)


STRUCTURE_ONLY = {"extract_content": False, "look_up_units": False}
NO_CONTENT = {"extract_content": False}
TEXT_ONLY = {"fields": ["content"]}
TRAINING = {"fields": ["content", "headings", "code_blocks", "images"]}


def _graded(spark: SparkSession, sf: str) -> DataFrame:
    return quiz.graded_answers(table(spark, sf, "answer_events"), table(spark, sf, "question_bank"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return quiz.score_answers(table(spark, sf, "answer_events"), table(spark, sf, "question_bank"))


# --- sources -------------------------------------------------------------


@register("page_lookup")
def page_lookup(spark, sf):
    frontier = structure.units(table(spark, sf, "module_pages")).selectExpr("unit_url AS url").unionByName(
        table(spark, sf, "unit_pages").select("url")
    )
    found = hierarchy.page_lookup(frontier, table(spark, sf, "page_store"))
    return found.selectExpr("url", "html IS NOT NULL AS fetched", "md5(html) AS html_md5")


@register("question_scan")
def question_scan(spark, sf):
    path = new_path(spark, "questions")
    questions = _bank(spark, sf).drop("question_id", "difficulty")
    files.write_questions(questions, path, "overwrite")
    scanned = files.read_questions(spark, path)
    return files.flat_questions(scanned)


@register("question_write")
def question_write(spark, sf):
    path = new_path(spark, "questions")
    questions = _bank(spark, sf)
    files.write_questions(questions, path, "overwrite")
    files.write_questions(questions.where("difficulty = 'hard'"), path, "append")
    written = files.read_questions(spark, path, ", question_id BIGINT")
    return written.groupBy("question_id").agg(F.count("*").alias("copies"))


@register("training_discover")
def training_discover(spark, sf):
    root = new_path(spark, "discover")
    records = publish.training_records(_hierarchy(spark, sf, **TRAINING), STAMP)
    slugged = records.withColumn("course_slug", F.expr(urls.output_slug("course_title")))
    files.write_training(slugged, f"{root}/all_data/all_training.jsonl")
    return files.read_training(spark, root).groupBy("course_slug").agg(
        F.count("*").alias("records"), F.sum(F.length("content")).alias("chars")
    )


@register("training_roundtrip")
def training_roundtrip(spark, sf):
    root = new_path(spark, "training")
    records = publish.training_records(_hierarchy(spark, sf, **TRAINING), STAMP)
    slugged = records.withColumn("course_slug", F.expr(urls.output_slug("course_title")))
    files.write_training(slugged, f"{root}/all_data/all_training.jsonl")
    return _training_columns(files.read_training(spark, root))


def _training_columns(records: DataFrame) -> DataFrame:
    return records.selectExpr(
        "course_title", "learning_path", "module_title", "unit_title", "unit_url", "content",
        "CAST(size(headings) AS BIGINT) AS n_headings", "CAST(size(code_blocks) AS BIGINT) AS n_code_blocks",
        "CAST(size(images) AS BIGINT) AS n_images", "scraped_at",
    )


def _summary_columns(summaries: DataFrame) -> DataFrame:
    return summaries.selectExpr(
        "course_title", "course_url", "scraped_at", "learning_paths_count", "total_modules", "total_units",
        "content_extracted", "limits_applied.max_paths AS max_paths",
        "limits_applied.max_modules_per_path AS max_modules", "limits_applied.max_units_per_module AS max_units",
        "get(files_created, 0) AS complete_file", "get(files_created, 1) AS training_file",
    )


@register("course_summary")
def course_summary(spark, sf):
    return _summary_columns(publish.course_summary(_hierarchy(spark, sf, **STRUCTURE_ONLY), scraped_at=STAMP))


@register("summary_roundtrip")
def summary_roundtrip(spark, sf):
    path = new_path(spark, "summary")
    limits = Limits(paths=2, modules=3, units=4)
    rows = _hierarchy(spark, sf, limits, **STRUCTURE_ONLY)
    files.write_summaries(publish.course_summary(rows, limits, scraped_at=STAMP), path)
    return _summary_columns(files.read_summaries(spark, path, multi_line=False))


@register("summary_scan")
def summary_scan(spark, sf):
    path = new_path(spark, "summary")
    rows = _hierarchy(spark, sf, **STRUCTURE_ONLY)
    files.write_summary_files(publish.course_summary(rows, content_extracted=False, scraped_at=STAMP), path)
    return _summary_columns(files.read_summaries(spark, path))


@register("snapshot_load")
def snapshot_load(spark, sf):
    """Stored course documents, with an unreadable one per course among them."""
    path = new_path(spark, "snapshot")
    files.write_slices(publish.complete_slices(_hierarchy(spark, sf)), path)
    broken = table(spark, sf, "seeds").selectExpr("concat('{\"url\":\"', course_url, '\",\"learn') AS value")
    broken.write.mode("append").text(path)
    stored = files.snapshot_units(files.read_snapshot(spark, path, multi_line=False))
    return stored.selectExpr(
        "ord.course_url AS course_url", "path_title", "module_title", "unit_title", "unit_url",
        "md5(content) AS content_md5", "CAST(size(images) AS BIGINT) AS n_images",
    )


@register("course_complete")
def course_complete(spark, sf):
    lines = publish.complete_lines(_hierarchy(spark, sf))
    return lines.select(*publish.LINE_KEY, "line")


# --- html ----------------------------------------------------------------


@register("html_tokens")
def html_tokens(spark, sf):
    return markup_ops.html_tokens(table(spark, sf, "pages"))


@register("html_entities")
def html_entities(spark, sf):
    return markup_ops.text_nodes(table(spark, sf, "pages")).select("page_id", "text")


@register("element_text")
def element_text(spark, sf):
    return markup_ops.elements(table(spark, sf, "unit_pages")).select("page_id", "pos", "tag", "text")


@register("element_spans")
def element_spans(spark, sf):
    return markup_ops.elements(table(spark, sf, "pages")).select("page_id", "pos", "tag", "stop")


@register("tag_attributes")
def tag_attributes(spark, sf):
    return markup_ops.tag_attributes(table(spark, sf, "unit_pages"), ["href", "src", "alt", "class", "lang"])


# --- structure -----------------------------------------------------------


@register("page_title")
def page_title(spark, sf):
    return structure.page_titles(table(spark, sf, "pages"))


@register("output_slug")
def output_slug(spark, sf):
    return structure.page_titles(table(spark, sf, "pages")).selectExpr(
        "page_id", f"{urls.output_slug('title')} AS slug"
    )


@register("path_discovery")
def path_discovery(spark, sf):
    return structure.paths(table(spark, sf, "course_pages"), BASE).select("url", "ord", "learn_uid")


@register("path_from_uid")
def path_from_uid(spark, sf):
    return structure.paths(table(spark, sf, "course_pages"), BASE).select("learn_uid", "title", "path_url")


@register("module_links")
def module_links(spark, sf):
    return structure.module_refs(table(spark, sf, "path_pages"), BASE).select("url", "href", "title")


@register("module_url")
def module_url(spark, sf):
    return structure.module_refs(table(spark, sf, "path_pages"), BASE).select("url", "href", "module_url")


@register("module_dedup")
def module_dedup(spark, sf):
    return structure.modules(table(spark, sf, "path_pages"), BASE)


@register("unit_links")
def unit_links(spark, sf):
    return structure.unit_refs(table(spark, sf, "module_pages")).select("url", "ord", "href", "title")


@register("url_join")
def url_join(spark, sf):
    refs = ["../x", "./y", "?z=1", "#f", "/abs/..//z", "//host/p", "http://other/a", "", "a/b/../../../c",
            "mailto:x", "..", ".", "x?y#z", "../../../../q", "a/./b/.."]
    listed = ", ".join(f"concat('{r}', '')" for r in refs)
    return table(spark, sf, "pages").selectExpr("page_id", "url", f"explode(array({listed})) AS href").selectExpr(
        "page_id", "href", f"{urls.url_join('url', 'href')} AS joined"
    )


@register("unit_number")
def unit_number(spark, sf):
    return table(spark, sf, "number_cases").selectExpr(
        "page_id", f"{urls.unit_number('unit_url', 'title')} AS number"
    )


@register("unit_order")
def unit_order(spark, sf):
    return structure.units(table(spark, sf, "module_pages"))


# --- hierarchy -----------------------------------------------------------

STRUCTURE_COLUMNS = [
    "course_url", "course_title", "course_status", "path_ord", "path_url", "path_title", "path_status", "module_ord",
    "module_url", "module_title", "module_status", "unit_ord", "unit_number", "unit_title", "unit_url",
]


@register("course_hierarchy")
def course_hierarchy(spark, sf):
    return _hierarchy(spark, sf).selectExpr(*STRUCTURE_COLUMNS, "unit_status", "md5(content) AS content_md5")


@register("merge_titles")
def merge_titles(spark, sf):
    rows = _hierarchy(spark, sf, **STRUCTURE_ONLY)
    return rows.select("path_url", "path_title", "module_url", "module_title").distinct()


@register("fetch_failures")
def fetch_failures(spark, sf):
    rows = _hierarchy(spark, sf, **NO_CONTENT)
    return rows.groupBy("course_url", "path_status", "module_status", "unit_status").agg(
        F.count("*").alias("n")
    )


@register("limited_expand")
def limited_expand(spark, sf):
    rows = _hierarchy(spark, sf, Limits(paths=2, modules=3, units=4), **NO_CONTENT)
    return rows.select(*STRUCTURE_COLUMNS, "unit_status")


@register("structure_only")
def structure_only(spark, sf):
    return _hierarchy(spark, sf, **STRUCTURE_ONLY).select(*STRUCTURE_COLUMNS)


def _snapshot(spark, sf):
    return table(spark, sf, "unit_snapshot").withColumnRenamed("page_id", "ord")


def _resume_inputs(spark, sf):
    rows = _hierarchy(spark, sf, **STRUCTURE_ONLY).where("unit_url IS NOT NULL")
    return rows.select("unit_ord", "unit_url", *resume.KEY), _snapshot(spark, sf)


@register("snapshot_match")
def snapshot_match(spark, sf):
    return resume.snapshot_match(*_resume_inputs(spark, sf))


@register("units_done")
def units_done(spark, sf):
    return resume.units_done(*_resume_inputs(spark, sf))


@register("units_todo")
def units_todo(spark, sf):
    return resume.units_todo(*_resume_inputs(spark, sf))


@register("resume_merge")
def resume_merge(spark, sf):
    """A run that goes on from a snapshot: stored units keep their content, the others are looked up."""
    rows = _hierarchy(spark, sf, snapshot=_snapshot(spark, sf), **TEXT_ONLY).where("unit_url IS NOT NULL")
    return rows.select("unit_ord", "unit_url", *resume.KEY, F.md5("content").alias("content"), "resumed")


@register("training_records")
def training_records(spark, sf):
    return _training_columns(publish.training_records(_hierarchy(spark, sf, **TRAINING), STAMP))


@register("compaction")
def compaction(spark, sf):
    return publish.compaction(_hierarchy(spark, sf, **TEXT_ONLY))


# --- content -------------------------------------------------------------


@register("content_root")
def content_root(spark, sf):
    return content.root_spans(table(spark, sf, "unit_pages"))


@register("strip_boilerplate")
def strip_boilerplate(spark, sf):
    return content.kept_text(table(spark, sf, "unit_pages"))


@register("unit_text")
def unit_text(spark, sf):
    return content.unit_content(table(spark, sf, "unit_pages"), BASE, ["content"]).select("page_id", "content")


@register("unit_headings")
def unit_headings(spark, sf):
    return content.items(
        table(spark, sf, "unit_pages"), "headings", ["CAST(c.level AS BIGINT) AS level", "c.text AS text"]
    )


@register("unit_code")
def unit_code(spark, sf):
    return content.items(table(spark, sf, "unit_pages"), "code_blocks", ["c AS code"])


def _images(spark, sf, *columns):
    return content.items(table(spark, sf, "unit_pages"), "images", list(columns), BASE)


@register("unit_images")
def unit_images(spark, sf):
    return _images(spark, sf, "c.src AS src", "c.alt_text AS alt_text", "c.title AS title")


@register("image_url")
def image_url(spark, sf):
    return _images(spark, sf, "c.src AS src", "c.absolute_url AS absolute_url")


@register("image_filename")
def image_filename(spark, sf):
    return _images(spark, sf, "c.filename AS filename")


@register("image_type")
def image_type(spark, sf):
    return _images(spark, sf, "c.image_type AS image_type")


@register("image_heading")
def image_heading(spark, sf):
    return _images(spark, sf, "c.context.preceding_heading AS preceding_heading")


@register("image_caption")
def image_caption(spark, sf):
    return _images(spark, sf, "c.context.figure_caption AS figure_caption")


@register("image_following")
def image_following(spark, sf):
    return _images(spark, sf, "c.context.following_text AS following_text")


@register("unit_links_out")
def unit_links_out(spark, sf):
    return content.items(table(spark, sf, "unit_pages"), "links", ["c.url AS url", "c.text AS text"])


@register("unit_record")
def unit_record(spark, sf):
    return content.unit_content(table(spark, sf, "unit_pages"), BASE).selectExpr(
        "page_id", "url", "md5(content) AS content_md5", "CAST(size(headings) AS BIGINT) AS n_headings",
        "CAST(size(code_blocks) AS BIGINT) AS n_code_blocks", "CAST(size(images) AS BIGINT) AS n_images",
        "CAST(size(links) AS BIGINT) AS n_links",
        "array_join(transform(headings, h -> concat(h.level, ':', h.text)), '|') AS heading_list",
    )


# --- bank ----------------------------------------------------------------


@register("question_flat")
def question_flat(spark, sf):
    """Bank as CSV: written, then read back as columns."""
    path = new_path(spark, "csv")
    texts = ["question", "correct_answer", "explanation", "learning_path", "module", "additional_notes"]
    files.write_csv(_bank(spark, sf).select("question_id", *texts, "options"), path)
    columns = [*texts, *(f"option_{c}" for c in "abcd")]
    return files.read_csv(spark, path, "question_id BIGINT, " + ", ".join(f"{c} STRING" for c in columns))


@register("q_required")
def q_required(spark, sf):
    return bank.missing_fields(_bank(spark, sf))


@register("q_options")
def q_options(spark, sf):
    return bank.option_problems(_bank(spark, sf))


@register("q_sentences")
def q_sentences(spark, sf):
    return bank.sentence_counts(table(spark, sf, "question_bank"))


@register("q_malformed")
def q_malformed(spark, sf):
    return bank.malformed_lines(table(spark, sf, "question_lines"), "question_id")


@register("q_compat")
def q_compat(spark, sf):
    return bank.structure_differences(
        table(spark, sf, "question_lines"), bank.REQUIRED + bank.REQUIRED_KEY_ONLY, "question_id"
    )


@register("q_compat_exemplar")
def q_compat_exemplar(spark, sf):
    """Lines against an exemplar file: the first question that has all fields, written on its own."""
    lines, path = table(spark, sf, "question_lines"), new_path(spark, "exemplar")
    whole = lines.where("try_parse_json(line) IS NOT NULL AND get_json_object(line, '$.correct_answer') IS NOT NULL")
    whole.agg(F.min_by("line", "question_id").alias("line")).where("line IS NOT NULL").write.text(path)
    return bank.exemplar_differences(lines, files.read_exemplar(spark, path), "question_id")


@register("q_type")
def q_type(spark, sf):
    return bank.question_types(table(spark, sf, "question_bank"))


@register("q_merge_dedup")
def q_merge_dedup(spark, sf):
    return bank.merge_dedup(table(spark, sf, "batches")).select("batch", "question_id")


@register("q_near_dup")
def q_near_dup(spark, sf):
    return bank.near_duplicates(table(spark, sf, "question_bank"))


@register("q_near_groups")
def q_near_groups(spark, sf):
    return bank.near_duplicate_groups(table(spark, sf, "question_bank"))


@register("path_catalog")
def path_catalog(spark, sf):
    return bank.path_catalog(table(spark, sf, "question_bank"))


@register("question_stats")
def question_stats(spark, sf):
    return bank.question_stats(table(spark, sf, "question_bank"))


@register("module_inventory")
def module_inventory(spark, sf):
    units = _hierarchy(spark, sf, **TEXT_ONLY).where("content <> ''")
    return bank.module_inventory(units.withColumnsRenamed({"path_title": "learning_path", "module_title": "module"}), "content")


@register("mix_vs_target")
def mix_vs_target(spark, sf):
    return bank.mix_vs_target(table(spark, sf, "question_bank"))


@register("coverage_gaps")
def coverage_gaps(spark, sf):
    return bank.coverage_gaps(table(spark, sf, "module_catalog"), table(spark, sf, "question_bank"))


@register("request_delta")
def request_delta(spark, sf):
    return bank.request_delta(table(spark, sf, "request"), table(spark, sf, "question_bank"))


@register("quota_alloc")
def quota_alloc(spark, sf):
    inventory = bank.module_inventory(table(spark, sf, "question_bank"), "question")
    return bank.quota_alloc(table(spark, sf, "request"), inventory)


@register("quota_mix")
def quota_mix(spark, sf):
    return bank.quota_mix(table(spark, sf, "request"))


@register("batch_plan")
def batch_plan(spark, sf):
    return bank.batch_plan(table(spark, sf, "question_bank"))


# --- quiz ----------------------------------------------------------------


@register("path_select")
def path_select(spark, sf):
    catalog = bank.path_catalog(table(spark, sf, "question_bank"))
    return quiz.path_selection(table(spark, sf, "selections"), catalog)


@register("sample_size")
def sample_size(spark, sf):
    return _sizes(spark, sf)


def _sizes(spark, sf):
    catalog = bank.path_catalog(table(spark, sf, "question_bank"))
    requests = table(spark, sf, "selections")
    available = quiz.available_questions(quiz.path_selection(requests, catalog), catalog)
    return quiz.sample_sizes(requests.join(available, "attempt_id"))


@register("quiz_sample")
def quiz_sample(spark, sf):
    return quiz.sample(table(spark, sf, "question_bank"), SEED, SAMPLE)


@register("quiz_shuffle")
def quiz_shuffle(spark, sf):
    return quiz.sample(table(spark, sf, "question_bank"), SEED)


@register("answer_clean")
def answer_clean(spark, sf):
    return quiz.clean_answers(table(spark, sf, "answer_events")).select(
        "event_id", "attempt_id", "answer", "accepted", "position"
    )


@register("score_answers")
def score_answers(spark, sf):
    return _scored(spark, sf).select(
        "attempt_id", "position", "question_id", "user_answer", "correct_answer", "correct"
    )


@register("running_score")
def running_score(spark, sf):
    return quiz.running_score(_scored(spark, sf)).select("attempt_id", "position", "score")


@register("quiz_result")
def quiz_result(spark, sf):
    return quiz.rounded(quiz.results(_graded(spark, sf)))


@register("quiz_grade")
def quiz_grade(spark, sf):
    return quiz.grades(quiz.results(_graded(spark, sf))).select("attempt_id", "grade")


@register("attempt_status")
def attempt_status(spark, sf):
    return quiz.attempt_status(_graded(spark, sf), _sizes(spark, sf))


@register("progress_load")
def progress_load(spark, sf):
    return quiz.latest_progress(quiz.saved_states(_scored(spark, sf), _sizes(spark, sf), SEED))


@register("progress_state")
def progress_state(spark, sf):
    """State saved after every answer, without attempts that started over: saved, deleted and loaded by key."""
    saved = stage(quiz.saved_states(_scored(spark, sf), _sizes(spark, sf), SEED), "progress")
    store = ProgressStore(spark, new_path(spark, "progress-store"))
    store.save(quiz.latest_progress(saved))
    store.clear(saved.where("current_index = 1 AND NOT correct"))
    return store.load()


def _quizzes(spark, sf):
    """Every attempt's quiz and the numbered questions, both written once."""
    questions, requests = table(spark, sf, "question_bank"), table(spark, sf, "selections")
    catalog = stage(bank.path_catalog(questions), "path-catalog")
    quizzes = quiz.attempt_quizzes(requests, quiz.path_selection(requests, catalog), catalog, SEED)
    return stage(quizzes, "quizzes"), stage(quiz.numbered_questions(questions, catalog), "numbered")


@register("quiz_questions")
def quiz_questions(spark, sf):
    """Each attempt's own paths, own number of questions and own order."""
    return quiz.quiz_questions(*_quizzes(spark, sf))


@register("quiz_remainder")
def quiz_remainder(spark, sf):
    return quiz.quiz_remainder(*_quizzes(spark, sf), quiz.accepted_answers(table(spark, sf, "answer_events")))


@register("resume_questions")
def resume_questions(spark, sf):
    sampled = quiz.sample(table(spark, sf, "question_bank"), SEED, SAMPLE)
    answers = table(spark, sf, "answer_events")
    attempts = answers.select("attempt_id").distinct()
    return quiz.remaining_questions(sampled, attempts, quiz.accepted_answers(answers), SAMPLE)


@register("option_rows")
def option_rows(spark, sf):
    return quiz.option_rows(_bank(spark, sf))


@register("feedback_rows")
def feedback_rows(spark, sf):
    return quiz.feedback(_scored(spark, sf), table(spark, sf, "question_bank"))


@register("mistake_review")
def mistake_review(spark, sf):
    return quiz.mistakes(_scored(spark, sf), _bank(spark, sf))


@register("wrong_by_path")
def wrong_by_path(spark, sf):
    return quiz.wrong_by_path(_graded(spark, sf)).select("attempt_id", "learning_path", "n_wrong", "perfect")


@register("weak_paths")
def weak_paths(spark, sf):
    return quiz.weak_paths(quiz.wrong_by_path(_graded(spark, sf)))


@register("weak_modules")
def weak_modules(spark, sf):
    return quiz.weak_modules(_graded(spark, sf))


# --- streaming -----------------------------------------------------------


@register("stream_ingest")
def stream_ingest(spark, sf):
    """Pages arrive as files; offered a second time, or changed, they add nothing."""
    source, out, checkpoint = (new_path(spark, n) for n in ("arriving", "published", "ingest-checkpoint"))
    pages = table(spark, sf, "pages")
    for arriving in (pages, pages, pages.withColumn("html", F.expr("concat(html, '<p>later</p>')"))):
        arriving.write.mode("append").parquet(source)
        units = ingest.new_units(ingest.read_page_stream(spark, source), BASE)
        ingest.start_ingest(units, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).selectExpr("page_id", "url", "md5(content) AS content_md5")


@register("stream_score")
def stream_score(spark, sf):
    """Answers arrive as files; offered a second time they change nothing."""
    source, out, checkpoint = (new_path(spark, n) for n in ("answers", "scores", "score-checkpoint"))
    for _ in range(2):
        table(spark, sf, "answer_events").write.mode("append").parquet(source)
        stream = scores.read_answer_stream(spark, source)
        live = scores.live_scores(stream, table(spark, sf, "question_bank"))
        scores.start_scores(live, out, checkpoint).awaitTermination()
    return scores.latest_scores(spark, out)
