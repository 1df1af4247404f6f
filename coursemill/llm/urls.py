"""Url allow and block lists by a sort-merge range join.

A rule ``(host, path)`` holds for its host and all subdomains where the url's
path starts with the rule's. Written with the host's labels reversed, a rule is
a prefix, and all keys with a prefix are one interval of the sorted keys.
Intervals of prefixes nest. A sorted sweep therefore needs a stack of open
rules only, and the innermost open rule of a key is the longest that fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursemill.sources.staging import stage

#: Ends the host in a key; sorts before all that can stand in a host or path.
END = "\x01"
RULES = "host string, path string, verdict string"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower())


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _key(labels: Column, path: Column) -> Column:
    """Reversed labels, each ended by a dot, then ``END`` and the path."""
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit(END), path)


def _chains(rules: DataFrame) -> DataFrame:
    """Each rule's key with the stack of rules open at it, outermost first, itself last.

    A rule's ancestors are found by joining its own prefixes with the rules:
    every host has one key here, so prefixes run over the path only.
    """
    rules = (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .withColumn("key", _key(F.split("host", r"\."), F.col("path")))
        .groupBy("key")
        # the same rule given twice: block wins over allow
        .agg(F.max_by(F.struct("host", "path", "verdict"), F.col("verdict")).alias("rule"))
    )
    heads = rules.select(
        "key",
        F.explode(F.expr("transform(sequence(0, char_length(rule.path)), n -> "
                         "substr(key, 1, char_length(key) - n))")).alias("head"),
    )
    opened = rules.select(F.col("key").alias("head"), F.struct(
        F.col("key").alias("key"), "rule.host", "rule.path", "rule.verdict").alias("entry"))
    return heads.join(opened, "head").groupBy("key").agg(F.sort_array(F.collect_list("entry")).alias("stack"))


def match(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, path, rule_host, rule_path, verdict)`` of each distinct place with a fitting rule; the longest rule wins.

    Each place asks once for every suffix of its host. Questions and rule keys
    are range-partitioned and sorted together; within a partition the last rule
    opened before a question has all open rules on its stack. What is open at
    the start of a partition comes from a table of one row per partition.

    The ranges are split by key and a digest of the place, so neither a host nor
    a common directory lands in one task. Ties in length go to the longer host.
    """
    labels = F.split("host", r"\.")
    asked = places.select("host", "path", F.posexplode(labels).alias("at", "label")).select(
        "host", "path",
        _key(F.slice(labels, F.col("at") + 1, F.size(labels) - F.col("at")), F.col("path")).alias("key"),
        F.lit(1).alias("turn"), F.lit(None).cast(_STACK).alias("stack"))
    given = _chains(rules).select(
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "key",
        F.lit(0).alias("turn"), F.col("stack").cast(_STACK).alias("stack"))
    events = asked.unionByName(given)
    order = ["key", "turn", "host", "path"]
    swept = stage(
        events.withColumn("tie", F.xxhash64("host", "path")).repartitionByRange("key", "turn", "tie")
        .withColumn("part", F.spark_partition_id()), "events")
    # one row for each partition
    opening = swept.groupBy("part").agg(F.expr("max_by(stack, CASE WHEN turn = 0 THEN key END)").alias("opens")).select(
        "part",
        F.last("opens", ignorenulls=True).over(
            Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("open"))
    ahead = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    answered = (
        swept.withColumn("last", F.last("stack", ignorenulls=True).over(ahead)).where("turn = 1")
        .join(stage(opening, "opening"), "part", "left")
        .withColumn("fits", F.expr("filter(coalesce(last, open), r -> startswith(key, r.key))"))
        .where("size(fits) > 0")
        .withColumn("inner", F.expr("element_at(fits, -1)"))
    )
    length = F.char_length("inner.host") + F.char_length("inner.path")
    return answered.groupBy("host", "path").agg(
        F.max(F.struct(length.alias("length"), F.char_length("inner.host").alias("host_length"), "inner")).alias("best")
    ).select("host", "path", F.col("best.inner.host").alias("rule_host"), F.col("best.inner.path").alias("rule_path"),
             F.col("best.inner.verdict").alias("verdict"))


_STACK = "array<struct<key:string,host:string,path:string,verdict:string>>"


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Every page's ``(page_id, host, path, rule, verdict)``.

    ``rules(host, path, verdict)``: lower-case hosts. ``rule`` is the winning
    rule as ``host`` and ``path`` in one, null where none fits; the verdict is
    then ``default``.

    Null urls and urls without ``://`` have empty host and path and fit no rule
    with a host. Repeated pages come back as often as given, repeated places are
    judged once. Rules with a null part are ignored, of equal rules block wins.
    Extra columns are not read; empty tables give no rows or no rules.
    """
    url = F.coalesce("url", F.lit(""))
    placed = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"))
    judged = stage(match(placed.select("host", "path").distinct(), rules), "judged")
    return placed.join(judged, ["host", "path"], "left").select(
        "page_id", "host", "path", F.concat("rule_host", "rule_path").alias("rule"),
        F.coalesce("verdict", F.lit(default)).alias("verdict"))
