"""Question bank: validation, statistics, duplicates, coverage.

Questions have ``question_id, question, options MAP<STRING,STRING>,
correct_answer, explanation, learning_path, module, additional_notes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coursemill.functions import rules
from coursemill.functions.columns import fresh, let, quote, quoted, strip
from coursemill.operators import ordinals
from coursemill.operators.components import components
from coursemill.operators.sieve import marked, sieve
from coursemill.sources.staging import Scratch, stage

# Fields every question has; notes may be empty, the others not.
REQUIRED = ["question", "options", "correct_answer", "explanation", "learning_path", "module"]
REQUIRED_KEY_ONLY = ["additional_notes"]
LETTERS = ["A", "B", "C", "D"]
MIN_SENTENCES, MAX_SENTENCES = 2, 4
BATCH_SIZE = 20


# --- V1-V6 ---------------------------------------------------------------


def with_options(flat: DataFrame) -> DataFrame:
    """Fold ``option_a..option_d`` columns into the options map."""
    names = {letter: f"option_{letter.lower()}" for letter in LETTERS}
    pairs = ", ".join(f"named_struct('k', '{k}', 'v', {v})" for k, v in names.items())
    present = f"filter(array({pairs}), o -> o.v IS NOT NULL)"
    return flat.withColumn(
        "options", F.expr(f"map_from_arrays(({present}).k, ({present}).v)")
    ).drop(*names.values())


def missing_fields(questions: DataFrame) -> DataFrame:
    """One row per missing required field ``(question_id, field)``."""
    checks = [
        f"IF({f} IS NULL OR {'size(options) = 0' if f == 'options' else f + chr(32) + '= ' + quote('')}, '{f}', NULL)"
        for f in REQUIRED
    ] + [f"IF({f} IS NULL, '{f}', NULL)" for f in REQUIRED_KEY_ONLY]
    return questions.selectExpr("question_id", f"explode(array_compact(array({', '.join(checks)}))) AS field")


def option_problems(questions: DataFrame) -> DataFrame:
    """Option shape per question: keys exactly A-D, no blanks, answer is a key."""
    return questions.selectExpr(
        "question_id",
        f"array_sort(map_keys(options)) = array({quoted(LETTERS)}) AS keys_ok",
        f"NOT exists(map_values(options), v -> v IS NULL OR {strip('v')} = '') AS texts_ok",
        "coalesce(map_contains_key(options, correct_answer), false) AS answer_ok",
    )


def sentence_counts(questions: DataFrame) -> DataFrame:
    """Sentences of question and explanation; outside 2-4 is a warning."""

    def within(column: str) -> str:
        return f"{column} BETWEEN {MIN_SENTENCES} AND {MAX_SENTENCES}"

    return questions.selectExpr(
        "question_id",
        f"CAST({rules.sentence_count('question')} AS BIGINT) AS question_sentences",
        f"CAST({rules.sentence_count('explanation')} AS BIGINT) AS explanation_sentences",
    ).selectExpr("*", f"NOT ({within('question_sentences')} AND {within('explanation_sentences')}) AS warning")


def malformed_lines(lines: DataFrame, *keys: str) -> DataFrame:
    """Lines that are not valid JSON, identified by ``keys``."""
    return lines.where("try_parse_json(line) IS NULL").select(*keys)


def structure_differences(lines: DataFrame, fields: list[str], *keys: str) -> DataFrame:
    """Top-level keys a JSON line lacks or has in excess of ``fields``."""
    expected = f"array({quoted(fields)})"
    return (
        lines.selectExpr(*keys, "json_object_keys(line) AS found")
        .where("found IS NOT NULL")
        .selectExpr(
            *keys,
            f"""inline(concat(
                transform(array_except({expected}, found), f -> named_struct('field', f, 'problem', 'missing')),
                transform(array_except(found, {expected}), f -> named_struct('field', f, 'problem', 'unexpected'))))""",
        )
    )


def exemplar_differences(lines: DataFrame, exemplar: StructType, *keys: str) -> DataFrame:
    """``(keys, field, problem)``: where JSON lines differ in structure from an exemplar's schema, nested objects included.

    ``field`` is the path of a key, ``problem`` is ``missing``, ``unexpected`` or ``type``.
    Below a key that is missing or no object nothing more is reported, nor inside
    arrays. A null has every type, and numbers are one type. Null lines and lines
    that are not valid JSON objects give no rows; ``malformed_lines`` tells of
    those. Only ``line`` and ``keys`` are read.
    """
    checks = ", ".join(_object_checks(exemplar, "$", ""))
    return (
        lines.selectExpr(*keys, "try_parse_json(line) AS _value")
        .where(f"{_kind('_value', '$')} = 'object'")
        .selectExpr(*keys, f"inline(concat({checks}))")
    )


def _object_checks(schema: StructType, at: str, prefix: str) -> list[str]:
    """SQL arrays of the problems found in the object at a path, then in those below it."""
    names = f"CAST(array({quoted(schema.names)}) AS array<string>)"
    found = f"json_object_keys(to_json(try_variant_get(_value, {quote(at)}, 'variant')))"
    found = f"IF({_kind('_value', at)} = 'object', {found}, {names})"

    def problems(of: str, problem: str) -> str:
        return f"transform({of}, f -> named_struct('field', concat({quote(prefix)}, f), 'problem', '{problem}'))"

    checks = [problems(f"array_except({names}, {found})", "missing"), problems(f"array_except({found}, {names})", "unexpected")]
    for field in schema.fields:
        mark = '"' if "'" in field.name else "'"
        below = f"{at}[{mark}{field.name}{mark}]"
        wanted = {"struct": "object", "array": "array", "boolean": "boolean", "string": "string"}.get(field.dataType.typeName(), "number")
        kind = _kind("_value", below)
        checks.append(problems(f"IF({kind} <> '{wanted}', array({quote(field.name)}), CAST(array() AS array<string>))", "type"))
        if isinstance(field.dataType, StructType):
            checks += _object_checks(field.dataType, below, f"{prefix}{field.name}.")
    return checks


def _kind(value: str, at: str) -> str:
    """Kind of the JSON value at a path of a variant; null where there is none or it is null."""
    head = f"regexp_extract(schema_of_variant(try_variant_get({value}, {quote(at)}, 'variant')), '^[A-Z]+', 0)"
    return (f"CASE {head} WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' "
            f"WHEN 'STRING' THEN 'string' WHEN 'VOID' THEN NULL ELSE IF({head} IS NULL, NULL, 'number') END")


def question_types(questions: DataFrame) -> DataFrame:
    return questions.selectExpr("question_id", f"{rules.question_type('question')} AS question_type")


# --- A3, A4, A8, A10 -----------------------------------------------------


def path_catalog(questions: DataFrame) -> DataFrame:
    """Learning paths in order with their question count and number.

    The unpartitioned window numbers the aggregated paths, the menu a person
    picks from; questions never reach it.
    """
    counts = questions.groupBy("learning_path").agg(F.count("*").alias("question_count"))
    return counts.withColumn("path_no", F.row_number().over(Window.orderBy("learning_path")).cast("bigint"))


def question_stats(questions: DataFrame) -> DataFrame:
    """Totals, totals per path and per module in one rollup."""
    return questions.rollup("learning_path", "module").agg(
        F.count("*").alias("question_count"), F.grouping_id().cast("bigint").alias("level")
    )


def module_inventory(units: DataFrame, content: str) -> DataFrame:
    """Units and content size per module, the allocation weights."""
    return units.groupBy("learning_path", "module").agg(
        F.count("*").alias("units"), F.sum(F.length(content)).cast("bigint").alias("chars")
    )


def mix_vs_target(questions: DataFrame) -> DataFrame:
    """Share of each question type and difficulty against its target."""
    targets = ", ".join(
        f"('{kind}', '{label}', {share}D / 100)"
        for kind, shares in [("type", rules.TYPE_SHARES), ("difficulty", rules.DIFFICULTY_SHARES)]
        for label, share in shares.items()
    )
    target = questions.sparkSession.sql(f"SELECT * FROM VALUES {targets} AS t(kind, label, target)")
    counts = (
        questions.selectExpr(f"""inline(array(
            named_struct('kind', 'type', 'label', {rules.question_type('question')}),
            named_struct('kind', 'difficulty', 'label', difficulty)))""")
        .groupBy("kind", "label")
        .agg(F.count("*").alias("n"))
        .withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("kind")))
    )
    return target.join(counts, ["kind", "label"], "left").selectExpr(
        "kind", "label", "coalesce(n, 0L) AS n", "coalesce(share, 0D) AS share", "target",
        "coalesce(share, 0D) - target AS delta",
    )


# --- J9, J10 -------------------------------------------------------------


def coverage_gaps(modules: DataFrame, questions: DataFrame) -> DataFrame:
    """Modules without any question."""
    keys = ["learning_path", "module"]
    return modules.select(*keys).distinct().join(questions.select(*keys).distinct(), keys, "left_anti")


def request_delta(request: DataFrame, questions: DataFrame) -> DataFrame:
    """Requested against delivered questions per learning path."""
    delivered = questions.groupBy("learning_path").agg(F.count("*").alias("delivered"))
    return request.join(delivered, "learning_path", "full_outer").selectExpr(
        "learning_path", "coalesce(requested, 0L) AS requested", "coalesce(delivered, 0L) AS delivered",
        "coalesce(delivered, 0L) - coalesce(requested, 0L) AS delta",
    )


# --- W1-W3 ---------------------------------------------------------------


def largest_remainder(shares: DataFrame, group: list[str], tie: str) -> DataFrame:
    """Split ``requested`` over rows by ``weight``; whole numbers that add up."""
    per_group = Window.partitionBy(*group)
    base = shares.withColumn("total_weight", F.sum("weight").over(per_group)).selectExpr(
        "*", "requested * weight DIV total_weight AS base", "requested * weight % total_weight AS remainder"
    )
    ranked = base.withColumn(
        "rank", F.row_number().over(per_group.orderBy(F.col("remainder").desc(), F.col(tie)))
    ).withColumn("left_over", F.col("requested") - F.sum("base").over(per_group))
    return ranked.withColumn("quota", F.expr("base + IF(rank <= left_over, 1L, 0L)")).drop(
        "total_weight", "base", "remainder", "rank", "left_over"
    )


def quota_alloc(request: DataFrame, inventory: DataFrame) -> DataFrame:
    """Questions per module of each requested path, even or proportional."""
    shares = request.join(inventory, "learning_path").selectExpr(
        "learning_path", "module", "requested", "IF(distribution = 'even', 1L, units) AS weight"
    )
    return largest_remainder(shares, ["learning_path"], "module").drop("weight")


def quota_mix(request: DataFrame) -> DataFrame:
    """Questions per type and per difficulty of each requested path."""
    weights = ", ".join(
        f"named_struct('kind', '{kind}', 'label', '{label}', 'weight', {share}L)"
        for kind, shares in [("type", rules.TYPE_SHARES), ("difficulty", rules.DIFFICULTY_SHARES)]
        for label, share in shares.items()
    )
    shares = request.selectExpr("learning_path", "requested", f"inline(array({weights}))")
    return largest_remainder(shares, ["learning_path", "kind"], "label").drop("weight")


def batch_plan(questions: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Batches of at most ``size`` questions per path, in id order."""
    numbered = ordinals.row_number(
        questions.select("learning_path", "question_id"),
        ["learning_path"], ["question_id"], ordinals.id_bucket("question_id"), "item_no",
    )
    return numbered.withColumn("batch_no", F.ceil(F.col("item_no") / size).cast("bigint"))


# --- V7, V8 --------------------------------------------------------------


def normalised(text: str) -> str:
    """Text compared by exact de-duplication: case and spacing ignored."""
    spaced = strip(f"regexp_replace({text}, {quote(chr(92) + 's+')}, ' ')")
    return f"lower({spaced})"


def merge_dedup(batches: DataFrame) -> DataFrame:
    """First question per normalised text, by batch then id.

    Only a digest and the two order columns are shuffled, and the minimum
    combines map-side, so a text copied a billion times costs a row per task.
    """
    keyed = batches.withColumn("text_key", F.expr(f"sha2({normalised('question')}, 256)"))
    first = keyed.groupBy("text_key").agg(F.min(F.struct("batch", "question_id")).alias("kept"))
    kept = first.select("kept.*")
    return batches.join(kept, ["batch", "question_id"], "left_semi")


SHINGLE = 3
_BLOCK = 4096
# bitmaps of ids and shingles that are broadcast: 8 MB at most
_FILTER_BITS = 1 << 26
# table of frequencies that orders shingles: its entries of a byte; made from one set in _EVERY, of shingles in _OFTEN of those
_ENTRIES = 1 << 22
_EVERY = 16
_OFTEN = 3
_AT_ONCE = 1 << 20


def shingle_sets(questions: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``(question_id, shingles ARRAY<BIGINT> sorted distinct, n, set_key)`` of whole texts.

    Equal sets have equal keys: two hashes with different seeds and the size.
    Without words the text itself is hashed, so only equal texts are equal. A
    null question has no set.
    """
    words = f"regexp_extract_all(lower(question), {quote('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+')}, 0)"

    def shingles(w: str) -> str:
        i = fresh("i")
        gram = ", ".join(f"get({w}, {i} + {k})" for k in range(size))
        hashed = f"transform(sequence(0, greatest(size({w}) - {size}, 0)), {i} -> xxhash64({gram}))"
        return f"IF(size({w}) = 0, CAST(array() AS array<bigint>), sort_array(array_distinct({hashed})))"

    return questions.selectExpr("question_id", "question", f"IF(question IS NULL, NULL, {let(words, shingles)}) AS shingles").selectExpr(
        "question_id", "shingles", "CAST(size(shingles) AS BIGINT) AS n",
        "IF(size(shingles) = 0, struct(0L AS n, xxhash64(question) AS h1, xxhash64(0L, question) AS h2), "
        "struct(CAST(size(shingles) AS BIGINT) AS n, xxhash64(shingles) AS h1, xxhash64(CAST(size(shingles) AS BIGINT), shingles) AS h2)) AS set_key",
    )


def near_duplicates(questions: DataFrame, threshold: float = 0.8, size: int = SHINGLE) -> DataFrame:
    """Exact similar pairs ``(question_id, similar_id, jaccard)``.

    Questions with equal shingle sets are represented by their smallest id, and
    each copy is reported once, against that representative; pairs are formed
    among representatives only. Questions without words are copies where their
    texts are equal and similar to nothing else; null questions are no one's copy.
    """
    with Scratch(questions.sparkSession, "shingles") as work:
        members, unique = _classes(questions, size, work)
        pairs = stage(_similar_sets(unique, threshold, work), "similar")
    copies = members.where("question_id <> owner_id").selectExpr("owner_id AS question_id", "question_id AS similar_id", "1.0D AS jaccard")
    return pairs.unionByName(copies)


def near_duplicate_groups(questions: DataFrame, threshold: float = 0.8, size: int = SHINGLE) -> DataFrame:
    """``(question_id, owner_id, group_id)``: every question with its copies' smallest id and its group's.

    A group is what similar pairs connect, directly or through others. Together
    with the pairs of ``near_duplicates`` between owners this gives every similar
    pair, also among copies, without listing those. A null question is a group of
    its own, and so is each row with a null id.
    """
    with Scratch(questions.sparkSession, "shingles") as work:
        members, unique = _classes(questions, size, work)
        roots = components(_similar_links(unique, threshold, work))
    return members.join(roots, F.col("owner_id") == F.col("node"), "left").selectExpr(
        "question_id", "owner_id", "coalesce(root, owner_id) AS group_id")


def _classes(questions: DataFrame, size: int, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(question_id, owner_id)`` of all questions, and the shingles of owners."""
    sets = work.stage(shingle_sets(questions, size), "sets")
    owners = work.stage(
        sets.where("shingles IS NOT NULL").groupBy("set_key").agg(F.min("question_id").alias("owner_id")), "owners")
    owned = sets.where("shingles IS NOT NULL").select("question_id", "set_key").join(owners, "set_key").select("question_id", "owner_id")
    members = stage(owned.unionByName(sets.where("shingles IS NULL").selectExpr("question_id", "question_id AS owner_id")), "members")
    # arrays of questions that may be copies are shuffled to be told from owners, the others stay where they are
    known = marked(sets.where("n > 0").drop("set_key"), members.where("question_id <> owner_id"), "question_id", _FILTER_BITS, "maybe_copy")
    owner_ids = owners.where("set_key.n > 0").selectExpr("owner_id AS question_id")
    # most copies are no owner's id by its bitmap either, and are not shuffled
    maybe_owners = sieve(known.where("maybe_copy"), owner_ids, "question_id", _FILTER_BITS)
    told = work.stage(maybe_owners.join(owner_ids, "question_id", "left_semi"), "told")
    # the others are read where they were written first
    unique = known.where("NOT maybe_copy").unionByName(told).drop("maybe_copy")
    work.drop(owners)
    return members, unique


def _similar_sets(unique: DataFrame, threshold: float, work: Scratch) -> DataFrame:
    """Pairs of different sets with Jaccard >= t."""
    places = _places(unique, threshold, work)
    heads = _heads(places, work)
    candidates = work.stage(_candidates(places.withColumn("part", F.col("question_id")), heads, threshold), "candidates")
    work.drop(places, heads)
    return _verified(candidates.selectExpr("least(a, b) AS a", "greatest(a, b) AS b"), unique, threshold)


def _similar_links(unique: DataFrame, threshold: float, work: Scratch) -> DataFrame:
    """Links ``(a, b)`` of different sets with Jaccard >= t that connect what all such pairs connect.

    The sets that share a shingle are compared with the least of them first. What
    that connects is a part, and after it only sets of different parts are
    compared, so many copies of one text with small changes cost a row each
    and not all their pairs.
    """
    places = _places(unique, threshold, work)
    heads = _heads(places, work)
    least = places.groupBy("shingle").agg(F.min(F.struct("question_id", "n", "place")).alias("least"))
    star = places.join(least, "shingle").selectExpr(
        "least.question_id AS a", "least.n AS n_a", "least.place AS place_a", "question_id AS b", "n AS n_b", "place AS place_b")
    # the first shared place of a pair need not be seen here; what that loses is met again below
    near = work.stage(_passing(star.where("a < b"), heads, threshold), "near")
    first = work.stage(_verified(near, unique, threshold).selectExpr("question_id AS a", "similar_id AS b"), "first")
    roots = components(first, work)
    parted = places.join(roots, F.col("question_id") == F.col("node"), "left").withColumn("part", F.expr("coalesce(root, question_id)"))
    parted = work.stage(parted.drop("node", "root"), "parted")
    work.drop(places)
    mixed = parted.groupBy("shingle").agg(
        F.min("part").alias("low"), F.max("part").alias("high"), F.bool_or(F.expr(_early("n", "place", threshold))).alias("early")).where(
        "low < high AND early").select("shingle")
    candidates = work.stage(_candidates(parted.join(mixed, "shingle", "left_semi"), heads, threshold), "candidates")
    second = _verified(candidates, unique, threshold).selectExpr("question_id AS a", "similar_id AS b")
    return first.unionByName(work.stage(second, "second"))


def _places(unique: DataFrame, threshold: float, work: Scratch) -> DataFrame:
    """``(question_id, n, shingle, df, place)`` of the shingles that tell which sets can be similar.

    Sets with Jaccard >= t share a shingle within their first ``n - ceil(t*n) + 1``
    shingles in any common order. Here that is by the entry of a table of
    frequencies, then by the shingle, which needs no count of all shingles; only
    the first places are exploded and counted. Shingles of a single set are kept
    from the shuffle by a bitmap of the others.
    """
    firsts = work.stage(
        _first_places(unique.selectExpr(
            "question_id", "CAST(n AS INT) AS n", f"CAST(n - ceil({threshold}D * n - 1e-9D) + 1 AS INT) AS places", "shingles")),
        "firsts")
    tokens = firsts.selectExpr("question_id", "n", "posexplode(firsts) AS (place, shingle)").withColumn("place", F.expr("place + 1"))
    # shingles of a single question can never meet
    common = work.stage(tokens.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "common")
    places = work.stage(sieve(tokens, common, "shingle", _FILTER_BITS).join(common, "shingle"), "places")
    work.drop(firsts, common)
    return places


def _commonness(sets: DataFrame) -> bytes:
    """Table of ``_ENTRIES`` bytes: in how many of the counted sets a shingle with that remainder is, 0 if under ``_OFTEN``.

    It only orders the shingles. That one set in ``_EVERY`` is counted for it, and
    that shingles share an entry, changes which sets meet but never what is found.
    """
    counted = sets.where(f"pmod(xxhash64(question_id, 'commonness'), {_EVERY}) = 0").selectExpr("explode(shingles) AS shingle")
    often = counted.groupBy("shingle").agg(F.count("*").alias("df")).where(f"df >= {_OFTEN}")
    entries = often.groupBy(F.expr(f"pmod(shingle, {_ENTRIES}L)").alias("id")).agg(F.expr("CAST(least(max(df), 127) AS TINYINT)").alias("df"))
    found = entries.select(F.col("id").cast("int"), "df").toArrow()
    table = np.zeros(_ENTRIES, np.int8)
    table[found["id"].to_numpy()] = found["df"].to_numpy()
    return table.tobytes()


def _first_places(sets: DataFrame) -> DataFrame:
    """``(question_id, n, firsts)``: the first ``places`` shingles of each set, in the order of ``_places``."""
    table, entries, at_once = sets.sparkSession.sparkContext.broadcast(_commonness(sets)), _ENTRIES, _AT_ONCE

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        commonness = np.frombuffer(table.value, np.int8)
        for whole in batches:
            ends = np.cumsum(whole["n"].to_numpy(), dtype=np.int64)
            # so many shingles are ordered at once, one set at least
            for part in np.split(np.arange(len(ends)), np.flatnonzero(np.diff(ends // at_once)) + 1):
                if len(part):
                    batch = whole.slice(part[0], len(part))
                    n, places, shingles = batch["n"].to_numpy(), batch["places"].to_numpy(), batch["shingles"].flatten().to_numpy()
                    row = np.repeat(np.arange(len(n)), n)
                    # stable: shingles are sorted already
                    order = np.argsort(row * 128 + commonness[shingles % entries], kind="stable")
                    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    firsts = shingles[order[place < np.repeat(places, n)]]
                    offsets = np.concatenate([[0], np.cumsum(places)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(firsts))
                    yield pa.RecordBatch.from_arrays([batch["question_id"], batch["n"], lists], ["question_id", "n", "firsts"])

    return sets.mapInArrow(cut, sets.selectExpr("question_id", "n", "shingles AS firsts").schema)


def _heads(places: DataFrame, work: Scratch) -> DataFrame:
    """``(question_id, head)``: the shingles of ``places`` of each set."""
    return work.stage(places.groupBy("question_id").agg(F.collect_list("shingle").alias("head")), "heads")


def _early(n: str, place: str, threshold: float) -> str:
    """The smaller of two similar sets, of ``n`` shingles, can have its first shared shingle at this place.

    What follows must suffice for the threshold: about the first half of the
    places. The others, where frequent shingles are, need not meet each other.
    """
    return f"{place} <= 1 + (1 - {threshold}D) / (1 + {threshold}D) * {n} + 1e-6D"


def _candidates(places: DataFrame, heads: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b)`` of sets of different ``part`` that ``_passing`` lets through.

    Only early places, for the smaller set, meet the sets that share the shingle;
    of these, those of one part are one row. A shingle in more than ``_BLOCK`` sets is split
    into a grid of blocks, so no task receives a whole hot group, and every pair
    of parts is still compared.
    """
    blocks = places.withColumn("blocks", F.expr(f"CAST(ceil(df / {_BLOCK}) AS INT)")).withColumn(
        "block", F.expr("CAST(pmod(xxhash64(question_id), blocks) AS INT)"))
    first = blocks.where(_early("n", "place", threshold)).withColumnsRenamed({"part": "part_a", "question_id": "a", "n": "n_a", "place": "place_a"}).drop("df")
    lists = blocks.groupBy("shingle", "blocks", "block", F.col("part").alias("part_b")).agg(
        F.collect_list(F.struct("question_id", "n", "place")).alias("sets"), F.min("n").alias("low"), F.max("n").alias("high"))
    rest, split = (lambda t: t.where("blocks = 1").drop("blocks", "block")), (lambda t: t.where("blocks > 1"))
    fits = f"part_a <> part_b AND n_a <= high AND n_a >= {threshold}D * low - 1e-9D"
    met = rest(first).join(rest(lists).hint("merge"), "shingle").where(fits).unionByName(
        split(first).selectExpr("* EXCEPT (blocks, block)", "block AS row_block", "explode(sequence(0, blocks - 1)) AS col_block").join(
            split(lists).selectExpr("* EXCEPT (blocks, block)", "explode(sequence(0, blocks - 1)) AS row_block", "block AS col_block").hint("merge"),
            ["shingle", "row_block", "col_block"]).where(fits).drop("row_block", "col_block"))
    pairs = met.selectExpr("a", "n_a", "place_a", "inline(sets) AS (b, n_b, place_b)")
    return _passing(pairs.where("n_a < n_b OR (n_a = n_b AND a < b)"), heads, threshold)


def _passing(pairs: DataFrame, heads: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b)`` that pass the filters on size, position and count of shared places.

    ``pairs`` has rows for shared places; that of the first one is enough, and only
    rows that can be it are kept. The shared places are counted by the heads.
    """
    overlap = f"{threshold}D / (1 + {threshold}D) * (n_a + n_b) - 1e-9D"
    met = (
        pairs.where(f"least(n_a, n_b) >= {threshold}D * greatest(n_a, n_b) - 1e-9D")
        # what follows the first shared place must still suffice for the threshold
        .where(f"1 + least(n_a - place_a, n_b - place_b) >= {overlap}")
        .select("a", "n_a", "b", "n_b").distinct()
    )
    return (
        met.join(heads.selectExpr("question_id AS a", "head AS head_a"), "a")
        .join(heads.selectExpr("question_id AS b", "head AS head_b"), "b")
        # a shared shingle not counted here lies beyond the prefix that ends first in the order
        .where(f"size(array_intersect(head_a, head_b)) + ceil({threshold}D * greatest(n_a, n_b) - 1e-9D) - 1 >= {overlap}")
        .select("a", "b")
    )


def _verified(candidates: DataFrame, unique: DataFrame, threshold: float) -> DataFrame:
    """``(question_id, similar_id, jaccard)`` of the candidates that reach the threshold, by their whole sets."""
    ids = candidates.selectExpr("explode(array(a, b)) AS question_id")
    arrays = sieve(unique.select("question_id", "shingles", "n"), ids, "question_id", _FILTER_BITS)
    return (
        candidates.join(arrays.selectExpr("question_id AS a", "shingles AS s_a", "n AS n_a"), "a")
        .join(arrays.selectExpr("question_id AS b", "shingles AS s_b", "n AS n_b"), "b")
        .selectExpr("a", "b", "n_a", "n_b", "size(array_intersect(s_a, s_b)) AS common")
        .selectExpr("a AS question_id", "b AS similar_id", "common / (n_a + n_b - common) AS jaccard")
        .where(f"jaccard >= {threshold}D")
    )
