"""Registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.llm import (
    embeddings, infill, langid, lexical, lines, packing, pii, secrets, sentencepieces, simhash, topk, toxicity, urls,
)
from coursemill.session import tune

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

#: Rows handed to Python at once; texts can be long, so few.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings these operators rely on."""
    tune(spark)
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    return spark


def register(name: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        REGISTRY[name] = lambda spark, sf_dir: query(prepare(spark), sf_dir)
        return query

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@register("op1_sentencepiece")
def op1(spark, sf):
    decoded = sentencepieces.decode(sentencepieces.encode(table(spark, sf, "documents")))
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        F.sha2("text", 256).alias("text_sha256"))


@register("op2_topk")
def op2(spark, sf):
    vectors = topk.quantised(table(spark, sf, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


@register("op3_pii")
def op3(spark, sf):
    return pii.report(pii.personal_data(table(spark, sf, "documents")))


@register("op4_packing")
def op4(spark, sf):
    return packing.packed(table(spark, sf, "documents"))


@register("op5_langid")
def op5(spark, sf):
    return langid.identify(table(spark, sf, "documents"))


@register("op6_lines")
def op6(spark, sf):
    return lines.report(table(spark, sf, "documents"))


@register("op7_secrets")
def op7(spark, sf):
    return secrets.report(secrets.secrets(table(spark, sf, "documents")))


@register("op8_simhash")
def op8(spark, sf):
    groups = simhash.simhash_groups(table(spark, sf, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register("op9_embeddings")
def op9(spark, sf):
    return embeddings.embedding_groups(table(spark, sf, "embeddings"))


URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@register("op10_urls")
def op10(spark, sf):
    rules = spark.createDataFrame(URL_RULES, urls.RULES)
    return urls.filter_urls(table(spark, sf, "pages"), rules)


@register("op11_lexical")
def op11(spark, sf):
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register("op12_toxicity")
def op12(spark, sf):
    found = toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
    spans = "array_join(transform(offending, s -> concat(s.start, ':', s.end)), ',')"
    return found.withColumn("sentences", F.expr(spans)).drop("offending")


@register("op13_infill")
def op13(spark, sf):
    return infill.digests(table(spark, sf, "documents"))
