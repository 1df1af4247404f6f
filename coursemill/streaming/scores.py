"""Live score per attempt.

An answer counts once, however often it arrives: its id is looked up in a ledger
before it is added. The score table is one small table, replaced as a whole by
every batch; a batch done again after a failure starts from the table it found
the first time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.functions import rules
from coursemill.functions.columns import quoted
from coursemill.operators.bank import LETTERS
from coursemill.sources.staging import Scratch, Versions
from coursemill.streaming.ledger import Ledger, query_id

ANSWERS = "event_id BIGINT, attempt_id BIGINT, ts TIMESTAMP_NTZ, question_id BIGINT, user_answer STRING"
SCORES = "attempt_id BIGINT, answered BIGINT, score BIGINT"


def read_answer_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(ANSWERS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def live_scores(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """``(attempt_id, answered, score)`` of accepted answers, each ``event_id`` once.

    Of a stream: the graded answers that ``start_scores`` adds up. Of several
    answers with one id the first batch's counts, in a batch the earliest, then
    that of the least attempt, then a wrong one. Answers without an id cannot be
    told from repeats and are left out.
    """
    key = questions.select("question_id", "correct_answer")
    cleaned = answers.withColumn("answer", F.expr(rules.clean_answer("user_answer")))
    accepted = cleaned.where(f"event_id IS NOT NULL AND answer IN ({quoted(LETTERS)})").join(key, "question_id")
    graded = accepted.selectExpr("event_id", "ts", "attempt_id", "answer <=> correct_answer AS correct")
    return graded if answers.isStreaming else _totals(_once(graded))


def _once(graded: DataFrame) -> DataFrame:
    return graded.groupBy("event_id").agg(F.min(F.struct("ts", "attempt_id", "correct")).alias("e")).select("event_id", "e.attempt_id", "e.correct")


def _totals(answers: DataFrame) -> DataFrame:
    return answers.groupBy("attempt_id").agg(F.count("*").alias("answered"), F.count_if("correct").alias("score"))


def start_scores(scores: DataFrame, out: str, checkpoint: str, ledger: str | None = None, expected: int = 10_000_000):
    """Add everything available to the score table ``out``; returns the query.

    ``ledger`` is the folder of counted answers, beside the table if not given;
    ``expected`` is the number of answers its filter is laid out for.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        work = f"{query_id(spark, checkpoint)}-{batch_id}"
        counted = Ledger(spark, ledger or f"{out.rstrip('/')}-ledger", "BIGINT", expected)
        current = Versions(spark, out, SCORES)
        with Scratch(spark, "scores") as tables:
            arrived = tables.stage(_once(batch), "answers")
            fresh = tables.stage(counted.unseen(arrived.selectExpr("event_id AS key"), work, tables), "fresh")
            added = _totals(arrived.join(fresh, F.col("event_id") == F.col("key"), "left_semi"))
            both = current.read(work).unionByName(added).groupBy("attempt_id").agg(
                F.sum("answered").alias("answered"), F.sum("score").alias("score"))
            current.replace(both, work)
            counted.record(fresh, work)

    return (
        scores.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(add)
        .start()
    )


def latest_scores(spark: SparkSession, out: str) -> DataFrame:
    """Newest state of every attempt: one table."""
    return Versions(spark, out, SCORES).read()
