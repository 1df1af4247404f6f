"""Quiz: path selection, sampling, answers, scores, review, progress.

Answers have ``(event_id, attempt_id, ts, question_id, user_answer)``. One
attempt may hold a large share of all answers: positions and running scores
come from bucketed running sums, everything else combines map-side and skips
the positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coursemill.functions import rules
from coursemill.functions.columns import quote, quoted, strip
from coursemill.operators import ordinals, permutation
from coursemill.operators.bank import LETTERS
from coursemill.sources.staging import stage

SHOWN_MODULES = 3
QUOTED_BAR = quote("|")
# positions or question numbers that are expanded together, a multiple of 64; rows a task makes
BLOCK, TASK_ROWS = 1024, 1 << 20
# quizzes that go by their questions, which costs a permutation a question; the rows of the others are shuffled to be looked up
WIDE = f"total >= {BLOCK} AND total * 32 >= available"


# --- Q1, L3, L4 ----------------------------------------------------------


def path_selection(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Learning paths each request picks ``(attempt_id, all_paths, learning_path)``.

    A selection is a comma list of 1-based path numbers; numbers out of range
    are ignored, and anything that is not a number means all paths. A request
    that picks no existing path has one row without a path: zero questions.
    """
    numbers = f"transform(split(selection, ','), x -> try_cast({strip('x')} AS BIGINT))"
    parsed = requests.selectExpr("attempt_id", f"{strip('selection')} AS selection").selectExpr(
        "attempt_id", f"IF(selection = '', array(CAST(NULL AS BIGINT)), {numbers}) AS numbers"
    )
    flagged = parsed.withColumn("all_paths", F.expr("exists(numbers, n -> n IS NULL)"))
    everything = flagged.where("all_paths").selectExpr(
        "attempt_id", "all_paths", "CAST(NULL AS STRING) AS learning_path"
    )
    found = (
        flagged.where("NOT all_paths")
        .selectExpr("attempt_id", "all_paths", "explode(array_distinct(numbers)) AS path_no")
        .join(catalog.select("path_no", "learning_path"), "path_no", "left")
    )
    # numbers of a request are few; those without a path collapse to one row, which goes if there is a path
    numbered = Window.partitionBy("attempt_id")
    chosen = (
        found.groupBy("attempt_id", "all_paths", "learning_path").agg(F.count("*").alias("n"))
        .withColumn("some", F.max("learning_path").over(numbered))
        .where("learning_path IS NOT NULL OR some IS NULL")
        .select("attempt_id", "all_paths", "learning_path")
    )
    return everything.unionByName(chosen)


def sample(questions: DataFrame, seed: int, n: int | None = None) -> DataFrame:
    """Seeded shuffle ``(position, question_id)``, first ``n`` or all.

    The order is a digest of seed and id, so it does not depend on how the
    questions are partitioned. Positions come from bucketed counting, so no task
    sorts everything.
    """
    keyed = questions.selectExpr("question_id", f"md5(concat('{seed}|', question_id)) AS shuffle_key")
    numbered = ordinals.row_number(
        keyed, [], ["shuffle_key", "question_id"], ordinals.hash_bucket("shuffle_key"), "position"
    )
    taken = numbered if n is None else numbered.where(F.col("position") <= n)
    return taken.select("position", "question_id")


def sample_sizes(requests: DataFrame) -> DataFrame:
    """Accept or reject a requested sample size ``(requested, available)``."""
    number = f"try_cast({strip('requested')} AS BIGINT)"
    return requests.selectExpr(
        "attempt_id", "available",
        f"""CASE WHEN {strip('requested')} = '' THEN available
            WHEN {number} BETWEEN 1 AND available THEN {number} END AS total""",
        f"""CASE WHEN {strip('requested')} = '' THEN 'all' WHEN {number} IS NULL THEN 'not_a_number'
            WHEN {number} BETWEEN 1 AND available THEN 'accepted' ELSE 'out_of_range' END AS status""",
    )


def available_questions(selection: DataFrame, catalog: DataFrame) -> DataFrame:
    """Questions each selection leaves to choose from."""
    totals = catalog.selectExpr("learning_path", "question_count")
    some = (
        selection.where("NOT all_paths")
        .join(totals, "learning_path", "left")
        .groupBy("attempt_id")
        .agg(F.coalesce(F.sum("question_count"), F.lit(0)).alias("available"))
    )
    everything = selection.sparkSession.sql(
        "SELECT attempt_id, (SELECT sum(question_count) FROM {totals}) AS available FROM {selection} WHERE all_paths",
        totals=totals, selection=selection,
    )
    return some.unionByName(everything)


def numbered_questions(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(global_no, learning_path, question_id)``: 0-based number of each question by path and id.

    Questions of a path are numbered by bucketed counting; where a path starts
    follows from the catalogue.
    """
    within = ordinals.row_number(
        questions.select("learning_path", "question_id"), ["learning_path"], ["question_id"], ordinals.id_bucket("question_id"), "nth")
    starts = _path_starts(catalog)
    return within.join(starts, within.learning_path.eqNullSafe(starts.path)).selectExpr(
        "start + nth - 1 AS global_no", "learning_path", "question_id")


def _path_starts(catalog: DataFrame) -> DataFrame:
    """``(path, start, n)``; the window runs over one row per learning path."""
    before = Window.orderBy("path_no").rowsBetween(Window.unboundedPreceding, -1)
    return catalog.select(
        F.col("learning_path").alias("path"), F.coalesce(F.sum("question_count").over(before), F.lit(0)).alias("start"),
        F.col("question_count").alias("n"))


def attempt_quizzes(requests: DataFrame, selection: DataFrame, catalog: DataFrame, seed: int) -> DataFrame:
    """``(attempt_id, total, available, ranges, keys)``: each attempt's quiz without its questions.

    ``ranges`` are the parts of the question numbering that its paths cover, with
    their place in the selection, none if it takes all paths; ``keys`` are drawn
    from the seed and the attempt. ``total`` is null if the size was not accepted.
    """
    sizes = sample_sizes(requests.join(available_questions(selection, catalog), "attempt_id"))
    starts = _path_starts(catalog)
    chosen = selection.where("NOT all_paths AND learning_path IS NOT NULL").join(starts, F.col("learning_path") == F.col("path"))
    # few paths for each attempt; their places in the selection are running sums over the array
    listed = chosen.groupBy("attempt_id").agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("l"))
    places = "transform(l, (p, i) -> named_struct('from', aggregate(slice(l, 1, i), 0L, (a, x) -> a + x.n), 'n', p.n, 'start', p.start))"
    ranged = listed.selectExpr("attempt_id", f"{places} AS ranges")
    return sizes.join(ranged, "attempt_id", "left").selectExpr(
        "attempt_id", "total", "available", "ranges", f"{permutation.keys(f'concat({seed}, {QUOTED_BAR}, attempt_id)')} AS keys")


def quiz_questions(quizzes: DataFrame, numbered: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """``(attempt_id, position, question_id)``: the questions of every attempt's own quiz, in its own order.

    A keyed permutation takes each position to a question number and back. A quiz
    of much of its selection meets the numbered questions block by block, and its
    rows are made where the block lies: they are never shuffled. A quiz of few
    looks its questions up by number. ``positions`` limits the result to some of
    them. An attempt without a quiz has one row with nulls, unless positions are
    given.
    """
    if positions is not None:
        return _looked_up(quizzes.join(positions, "attempt_id").selectExpr(
            "attempt_id", "position", "available", "ranges", *permutation.flat_keys("keys", "available")), numbered)
    without = quizzes.where("coalesce(total, 0) <= 0").selectExpr(
        "attempt_id", "CAST(NULL AS BIGINT) AS position", "CAST(NULL AS BIGINT) AS question_id")
    return without.unionByName(_by_position(quizzes, numbered)).unionByName(_by_question(quizzes, numbered))


def _by_position(quizzes: DataFrame, numbered: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Quizzes of few of their questions: positions that are not ``done``, each taken to its question."""
    few = quizzes.where(f"total > 0 AND NOT ({WIDE})")
    blocks = few.selectExpr(
        "attempt_id", "total", "available", "ranges", *permutation.flat_keys("keys", "available"),
        f"explode(sequence(0L, (total - 1) DIV {BLOCK})) AS block")
    known = blocks if done is None else blocks.join(_bits(done), ["attempt_id", "block"], "left")
    spread = known.repartition(_tasks(few, "total")[0], "attempt_id", "block")
    rows = spread.selectExpr("*", f"explode(sequence(block * {BLOCK}, least(total, (block + 1) * {BLOCK}) - 1)) AS nth").where(
        _open("nth", done)).withColumn("position", F.expr("nth + 1"))
    return _looked_up(rows.drop("total", "block", "nth", "done"), numbered)


def _looked_up(rows: DataFrame, numbered: DataFrame) -> DataFrame:
    """Rows ``(attempt_id, position, available, ranges)`` and flat keys with the question at the position."""
    # a position without a quiz gets a number of its own, which no question has
    placed = permutation.with_permuted(rows, "(position - 1)", "available", "rank").selectExpr(
        "attempt_id", "position", "CASE WHEN rank IS NULL THEN -1 - pmod(xxhash64(attempt_id), 1000003L) WHEN ranges IS NULL THEN rank ELSE "
        "aggregate(ranges, -1L, (no, r) -> IF(rank >= r.from AND rank < r.from + r.n, r.start + rank - r.from, no)) END AS global_no")
    return placed.join(numbered.select("global_no", "question_id"), "global_no", "left").select("attempt_id", "position", "question_id")


def _by_question(quizzes: DataFrame, numbered: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Quizzes of much of their selection: its questions that are not ``done``, block by block, each with the position it goes to.

    The result may be far larger than both inputs, so nothing of its size is
    written or shuffled before it: parts of the attempts meet parts of the
    questions, each written once, and a task makes the rows of two parts.
    """
    many = quizzes.where(f"total > 0 AND {WIDE}")
    tasks, attempts = _tasks(many, "available")
    blocks = 1 + (numbered.agg(F.max("global_no")).first()[0] or 0) // BLOCK
    # few questions a task: their ids are then a short dictionary of the file it writes
    across = min(blocks, tasks)
    parts = max(1, min(attempts, -(-tasks // across)))
    whole = "array(named_struct('from', 0L, 'n', available, 'start', 0L))"
    ranged = many.selectExpr(
        "attempt_id", "total", "available", *permutation.flat_keys("keys", "available"), f"inline(coalesce(ranges, {whole}))").where("n > 0")
    if done is not None:
        # few words for an attempt, at most a bit a question
        ranged = ranged.join(_bits(done).groupBy("attempt_id").agg(
            F.map_from_entries(F.collect_list(F.struct("block", "done"))).alias("blocks_done")), "attempt_id", "left")
    questions = numbered.groupBy(F.expr(f"global_no DIV {BLOCK}").alias("block")).agg(
        F.collect_list(F.struct("global_no", "question_id")).alias("questions"))
    met = questions.repartition(across).join(
        ranged.repartition(parts).hint("shuffle_replicate_nl"),
        F.expr(f"block >= start DIV {BLOCK} AND block <= (start + n - 1) DIV {BLOCK}"))
    if done is not None:
        met = met.withColumn("done", F.expr("blocks_done[block]")).drop("blocks_done")
    met = met.drop("block").selectExpr("* EXCEPT (questions)", "inline(questions)").where(
        "global_no >= start AND global_no < start + n").where(_open("global_no", done))
    placed = permutation.with_permuted(
        met.withColumn("rank", F.expr("from + global_no - start")).drop("from", "start", "n", "global_no", "done"),
        "rank", "available", "place", inverse=True)
    # generated rather than filtered: Spark would put a filter, with the whole permutation written out, into the join
    return placed.selectExpr("attempt_id", "question_id", "explode_outer(IF(place < total, array(place + 1), NULL)) AS position").where(
        "position IS NOT NULL").select("attempt_id", "position", "question_id")


def _tasks(quizzes: DataFrame, size: str) -> tuple[int, int]:
    """Tasks for the rows that quizzes make, which Spark cannot foresee, and the number of quizzes."""
    made, attempts = quizzes.agg(F.sum(size), F.count("*")).first()
    return 1 + (made or 0) // TASK_ROWS, attempts


def _bits(done: DataFrame) -> DataFrame:
    """``(attempt_id, block, done)``: the bits of what is done in each block, from ``done(attempt_id, nth)``."""
    bit = "shiftleft(1L, CAST(nth % 64 AS INT))"
    words = done.selectExpr("attempt_id", f"nth DIV {BLOCK} AS block", f"CAST(nth % {BLOCK} DIV 64 AS INT) AS word", f"{bit} AS bit").groupBy(
        "attempt_id", "block", "word").agg(F.bit_or("bit").alias("bits"))
    return words.groupBy("attempt_id", "block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m")).selectExpr(
        "attempt_id", "block", f"transform(sequence(0, {BLOCK // 64 - 1}), w -> coalesce(m[w], 0L)) AS done")


def _open(nth: str, done: DataFrame | None) -> str:
    return "true" if done is None else f"done IS NULL OR getbit(done[CAST({nth} % {BLOCK} DIV 64 AS INT)], CAST({nth} % 64 AS INT)) = 0"


def _asked(quizzes: DataFrame, numbered: DataFrame, answered: DataFrame) -> DataFrame:
    """``(attempt_id, global_no, rank, total, available, keys)`` of the answers to questions of the attempt's selection."""
    asked = answered.select("attempt_id", "question_id").join(numbered, "question_id").join(quizzes, "attempt_id")
    rank = """IF(ranges IS NULL, global_no, aggregate(ranges, -1L, (no, r) ->
        IF(global_no >= r.start AND global_no < r.start + r.n, r.from + global_no - r.start, no)))"""
    return asked.selectExpr("attempt_id", "global_no", "total", "available", "keys", f"{rank} AS rank").where("rank >= 0 AND total > 0")


def answered_positions(quizzes: DataFrame, numbered: DataFrame, answered: DataFrame) -> DataFrame:
    """``(attempt_id, position)`` of the answers to questions of the attempt's quiz: the permutation taken back."""
    place = permutation.permuted("rank", "available", "keys", inverse=True)
    return _asked(quizzes, numbered, answered).selectExpr("attempt_id", "total", f"{place} + 1 AS position").where(
        "position <= total").select("attempt_id", "position")


def open_positions(sizes: DataFrame, done: DataFrame) -> DataFrame:
    """``(attempt_id, position)`` of ``sizes(attempt_id, total)`` that are not in ``done(attempt_id, position)``.

    Done positions are bits, 64 to a word, joined by a combining aggregate.
    Finished attempts are left out by the number of their bits; of the others the
    words are listed, and only unset bits become rows.
    """
    words = done.selectExpr("attempt_id", "(position - 1) DIV 64 AS word", "shiftleft(1L, CAST((position - 1) % 64 AS INT)) AS bit").groupBy(
        "attempt_id", "word").agg(F.bit_or("bit").alias("bits"))
    counted = words.groupBy("attempt_id").agg(F.sum(F.bit_count("bits")).alias("n_done"))
    unfinished = sizes.join(counted, "attempt_id", "left").where("total > coalesce(n_done, 0)").selectExpr(
        "attempt_id", "total", "explode(sequence(0L, (total - 1) DIV 64)) AS word")
    unset = "filter(sequence(0, 63), b -> word * 64 + b < total AND (bits IS NULL OR getbit(bits, b) = 0))"
    return unfinished.join(words, ["attempt_id", "word"], "left").selectExpr(
        "attempt_id", "word", f"explode({unset}) AS b").selectExpr("attempt_id", "word * 64 + b + 1 AS position")


def quiz_remainder(quizzes: DataFrame, numbered: DataFrame, answered: DataFrame) -> DataFrame:
    """``(attempt_id, position, question_id)``: what each attempt has still to answer of its own quiz.

    Answered questions are bits of the blocks that ``quiz_questions`` goes by, so
    they are left out where rows are made.
    """
    few, many = quizzes.where(f"NOT ({WIDE})"), quizzes.where(WIDE)
    # written, as the plan that makes the rows is large enough without them
    places = stage(answered_positions(few, numbered, answered).selectExpr("attempt_id", "position - 1 AS nth"), "places")
    numbers = stage(_asked(many, numbered, answered).selectExpr("attempt_id", "global_no AS nth"), "numbers")
    return _by_position(quizzes, numbered, places).unionByName(_by_question(quizzes, numbered, numbers))


# --- Q2, J8, W4 ----------------------------------------------------------


def _cleaned(answers: DataFrame) -> DataFrame:
    return answers.withColumn("answer", F.expr(rules.clean_answer("user_answer"))).withColumn(
        "accepted", F.expr(f"answer IN ({quoted(LETTERS)})")
    )


def clean_answers(answers: DataFrame) -> DataFrame:
    """Normalised letter, accepted flag, and position among accepted answers."""
    numbered = ordinals.running_sums(
        _cleaned(answers), ["attempt_id"], ["ts", "event_id"], None,
        {"running": F.col("accepted").cast("int")},
    )
    return numbered.withColumn("position", F.expr("IF(accepted, running, NULL)")).drop("running")


def graded_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Accepted answers against the key; enough for totals, which need no position."""
    key = questions.select("question_id", "correct_answer", "learning_path", "module")
    accepted = _cleaned(answers).where("accepted").drop("user_answer", "accepted")
    return (
        accepted.withColumnRenamed("answer", "user_answer")
        .join(key, "question_id")
        .withColumn("correct", F.expr("user_answer = correct_answer"))
    )


def score_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Graded answers with position in the attempt and score after each of them.

    Both running columns come from the same pass.
    """
    return ordinals.running_sums(
        graded_answers(answers, questions), ["attempt_id"], ["ts", "event_id"], None,
        {"position": F.lit(1), "score": F.col("correct").cast("int")},
    )


def running_score(scored: DataFrame) -> DataFrame:
    """State after every answer."""
    return scored.select("attempt_id", "position", "correct", "score", "ts")


# --- A5, A6, Q6, K5, S6, Q7 ----------------------------------------------


def results(scored: DataFrame) -> DataFrame:
    """Score, total and percentage per attempt."""
    return (
        scored.groupBy("attempt_id")
        .agg(F.count_if("correct").alias("score"), F.count("*").alias("total"))
        .withColumn("percentage", F.expr("try_divide(score, total) * 100"))
    )


def rounded(results: DataFrame) -> DataFrame:
    return results.selectExpr(
        "attempt_id", "score", "total", "bround(percentage, 1) AS percentage_1", "bround(percentage, 0) AS percentage_0"
    )


def grades(results: DataFrame) -> DataFrame:
    return results.selectExpr("attempt_id", "percentage", f"{rules.grade('percentage')} AS grade")


def attempt_status(scored: DataFrame, sizes: DataFrame) -> DataFrame:
    """Last session, questions done, size of the quiz and score so far per attempt.

    ``sizes(attempt_id, total)`` as from ``sample_sizes``; an attempt whose size
    was not accepted has none.
    """
    done = scored.groupBy("attempt_id").agg(
        F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("last_session"),
        F.count("*").alias("current_index"),
        F.count_if("correct").alias("score"),
    )
    return done.join(sizes.select("attempt_id", "total"), "attempt_id", "left")


def saved_states(scored: DataFrame, sizes: DataFrame, seed: int) -> DataFrame:
    """What is saved after every answer.

    ``(attempt_id, seed, current_index, score, total, question_id, user_answer, correct, saved_at)``
    """
    states = scored.selectExpr(
        "attempt_id", f"{seed}L AS seed", "position AS current_index", "score", "question_id", "user_answer", "correct",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") AS saved_at",
    )
    return states.join(sizes.select("attempt_id", "total"), "attempt_id", "left")


def latest_progress(states: DataFrame) -> DataFrame:
    """Latest saved state per attempt."""
    fields = ["seed", "current_index", "score", "total", "saved_at"]
    newest = states.groupBy("attempt_id").agg(F.max_by(F.struct(*fields), F.col("current_index")).alias("s"))
    return newest.select("attempt_id", "s.*")


def cleared(states: DataFrame, attempts: DataFrame) -> DataFrame:
    """Progress without the attempts that started over."""
    return states.join(attempts.select("attempt_id"), "attempt_id", "left_anti")


def accepted_answers(answers: DataFrame) -> DataFrame:
    """Answers that name an option; others are asked for again."""
    return _cleaned(answers).where("accepted").select(*answers.columns)


def remaining_questions(sampled: DataFrame, attempts: DataFrame, answered: DataFrame, total: int) -> DataFrame:
    """Questions of the common sample that an attempt has no accepted answer to, in sample order."""
    done = answered.select("attempt_id", "question_id").join(sampled, "question_id").select("attempt_id", "position")
    sizes = attempts.select("attempt_id", F.lit(total).cast("long").alias("total"))
    return open_positions(sizes, done).join(sampled, "position").select("attempt_id", "question_id", "position")


# --- Q3, Q4, Q5, A7, L5, L6 ----------------------------------------------


def option_rows(questions: DataFrame) -> DataFrame:
    """One row per option in letter order."""
    return questions.selectExpr(
        "question_id", "inline(array_sort(map_entries(options)))"
    ).selectExpr("question_id", "key AS letter", "value AS option_text")


def feedback(scored: DataFrame, questions: DataFrame) -> DataFrame:
    """Verdict row shown after each answer."""
    told = questions.select("question_id", "explanation")
    return scored.join(told, "question_id").selectExpr(
        "attempt_id", "position", "question_id", "correct", "correct_answer", "explanation", "learning_path", "module"
    )


def mistakes(scored: DataFrame, questions: DataFrame) -> DataFrame:
    """Review rows of the wrong answers."""
    texts = questions.selectExpr(
        "question_id",
        "concat(substr(question, 1, 80), '...') AS question_text",
        "try_element_at(options, correct_answer) AS correct_text",
        "concat(substr(explanation, 1, 150), '...') AS explanation_text",
    )
    return scored.where("NOT correct").join(texts, "question_id").selectExpr(
        "attempt_id", "position", "question_id", "question_text", "user_answer", "correct_answer",
        "correct_text", "explanation_text",
    )


def wrong_by_path(graded: DataFrame) -> DataFrame:
    """Wrong answers per path; an attempt without any has one perfect row.

    The window runs over counts, at most one row per learning path.
    """
    counts = graded.groupBy("attempt_id", "learning_path").agg(
        F.count_if(~F.col("correct")).alias("n_wrong"),
        F.min(F.expr("IF(correct, NULL, struct(ts, event_id))")).alias("first_wrong"),
    )
    attempt = Window.partitionBy("attempt_id")
    return (
        counts.withColumn("perfect", F.sum("n_wrong").over(attempt) == 0)
        .withColumn("nth", F.row_number().over(attempt.orderBy("learning_path")))
        .where("n_wrong > 0 OR (perfect AND nth = 1)")
        .withColumn("learning_path", F.expr("IF(perfect, NULL, learning_path)"))
        .drop("nth")
    )


def weak_paths(by_path: DataFrame) -> DataFrame:
    """Paths of an attempt by number of errors, ties by first error."""
    order = Window.partitionBy("attempt_id").orderBy(F.col("n_wrong").desc(), F.col("first_wrong"))
    return by_path.where("NOT perfect").select(
        "attempt_id", F.row_number().over(order).cast("bigint").alias("rank"), "learning_path", "n_wrong"
    )


def weak_modules(graded: DataFrame, shown: int = SHOWN_MODULES) -> DataFrame:
    """First modules to review per attempt and path, and how many more there are.

    Filtering the rank lets Spark keep only the top rows of each task before
    the shuffle; the count is its own combining aggregate.
    """
    wrong = graded.where("NOT correct").select("attempt_id", "learning_path", "ts", "event_id", "module")
    keys = ["attempt_id", "learning_path"]
    order = Window.partitionBy(*keys).orderBy("ts", "event_id")
    first = wrong.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown)
    totals = wrong.groupBy(*keys).agg(F.count("*").alias("n_wrong"))
    return first.join(totals, keys).selectExpr(
        *keys, "CAST(rank AS BIGINT) AS rank", "module", f"greatest(n_wrong - {shown}, 0L) AS n_more"
    )
