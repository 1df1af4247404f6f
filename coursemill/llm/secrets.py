"""Secrets by patterns and a battery of randomness tests, as Spark SQL expressions.

Named patterns give the base spans. Any other long token is read in the
encoding its characters suggest and tested for being uniformly random:
chi-squared over the alphabet, runs about the median, and serial correlation.
The tokens whose randomness is rejected, with the false-discovery rate held per
length class over the whole corpus, are ordinary text; the rest are secrets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coursemill.functions.columns import fresh, let, quote
from coursemill.llm.spans import count, find, listed
from coursemill.sources.staging import stage

BASE = ("assign", "access", "hex")

# Patterns of the base kinds. Lengths of ``access`` and ``hex`` are part of the pattern, as a run that is
# too short holds no longer one; group 2 of ``assign`` is checked afterwards, since a failing match uses up its text.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGNED = r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
_RUN, _END = "A-Za-z0-9+/_-", r"(?:=++(?![A-Za-z0-9+/_-]))?+"
#: A value of 20 characters or more that may be encoded; letters and digits are asked for afterwards. ``=`` is padding at
#: the end and else ends a value. A run that mixes ``+/`` with ``-_`` is no encoding: it is cut at ``/``, and what still
#: mixes ``+`` with ``-_`` at those.
TOKEN = "(?:" + "|".join((
    rf"(?<![{_RUN}])(?=[={_RUN}]{{20}})(?:[A-Za-z0-9+/]++|[A-Za-z0-9_-]++)=++(?![{_RUN}])",
    rf"(?<![{_RUN}])(?:[A-Za-z0-9+/]{{20,}}+(?![_-])|[A-Za-z0-9_-]{{20,}}+(?![+/])){_END}",
    rf"(?<![A-Za-z0-9+_-])[A-Za-z0-9_-]{{20,}}+(?![+]){_END}",
    rf"(?<![A-Za-z0-9+])[A-Za-z0-9+]{{20,}}+{_END}",
)) + ")"

_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings by first fit: pattern of the whole token, and its alphabet.
ENCODINGS = (
    ("^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+=*$", _LOWER.upper() + "234567"),
    ("^[0-9a-z]+$", _DIGITS + _LOWER),
    ("^[0-9A-Z]+$", _DIGITS + _LOWER.upper()),
    ("^[A-Za-z0-9+/]+=*$", _LOWER.upper() + _LOWER + _DIGITS + "+/"),
    ("^[A-Za-z0-9_-]+=*$", _LOWER.upper() + _LOWER + _DIGITS + "-_"),
)
#: Lower bounds of the length classes, share of false rejections allowed in each, steps of the p-value scale.
LENGTHS, RATE, STEPS = (20, 28, 36, 48, 64, 128), 0.05, 2000


def _upper_tail(z: str) -> str:
    """Share of a normal distribution above ``z``; rational approximation good to 1e-7."""

    def tail(v: str) -> str:
        t = f"(1 / (1 + 0.2316419 * abs({v})))"
        poly = f"{t} * (0.31938153 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
        area = f"exp(-{v} * {v} / 2) * 0.3989422804 * {poly}"
        return f"IF({v} >= 0, {area}, 1 - {area})"

    return let(f"CAST({z} AS DOUBLE)", tail)


def _p_value(token: str) -> str:
    """Smallest of three p-values for uniform randomness, times three; null without an encoding."""
    c, v, s, i, j, k = (fresh(n) for n in "cvsijk")
    alphabet = "CASE " + " ".join(
        f"WHEN {token} RLIKE {quote(p)} THEN {quote(a)}" for p, a in ENCODINGS) + " END"

    def tests(x: str) -> str:
        n, m = f"size({x}.v)", f"char_length({x}.a)"
        # chi-squared over the symbols, made normal by the cube-root transform
        square = (
            f"aggregate(array_distinct({x}.v), 0D, ({s}, {v}) -> {s} + "
            f"power(size(filter({x}.v, {k} -> {k} = {v})), 2)) * {m} / {n} - {n}"
        )
        chi = let(f"{m} - 1", lambda f: (
            f"(power(greatest({square}, 0) / {f}, 1 / 3D) - (1 - 2 / (9D * {f}))) / sqrt(2 / (9D * {f}))"))
        # runs above and below the middle of the alphabet
        high = f"transform({x}.v, {v} -> 2 * {v} >= {m})"

        def runs(h: str) -> str:
            up = f"CAST(size(filter({h}, {k} -> {k})) AS DOUBLE)"
            seen = f"(1 + size(filter(sequence(1, {n} - 1), {i} -> {h}[{i}] <> {h}[{i} - 1])))"

            def z(u: str) -> str:
                both = f"2 * {u} * ({n} - {u})"
                return (
                    f"IF({u} = 0 OR {u} = {n}, 9D, abs({seen} - 1 - {both} / {n}) / "
                    f"sqrt(greatest({both} * ({both} - {n}) / ({n} * {n} * ({n} - 1D)), 1e-9)))"
                )

            return let(up, z)

        # correlation of neighbours
        def serial(mean: str) -> str:
            top = f"aggregate(sequence(1, {n} - 1), 0D, ({s}, {i}) -> {s} + ({x}.v[{i}] - {mean}) * ({x}.v[{i} - 1] - {mean}))"
            low = f"aggregate({x}.v, 0D, ({s}, {j}) -> {s} + power({j} - {mean}, 2))"
            return f"abs({top} / greatest({low}, 1e-9) * sqrt({n}))"

        return (
            f"least(1D, 3 * least({_upper_tail(chi)}, 2 * {_upper_tail(let(high, runs))}, "
            f"2 * {_upper_tail(let(f'aggregate({x}.v, 0D, ({s}, {j}) -> {s} + {j}) / {n}', serial))}))"
        )

    def coded(a: str) -> str:
        values = (
            f"transform(filter(split({token}, ''), {c} -> {c} <> '' AND instr({a}, {c}) > 0), {c} -> instr({a}, {c}) - 1)"
        )
        return f"IF({a} IS NULL, NULL, {let(f'struct({a} AS a, {values} AS v)', tests)})"

    return let(alphabet, coded)


def _length_class(size: str) -> str:
    return "CASE " + " ".join(
        f"WHEN {size} >= {low} THEN {i}" for i, low in reversed(list(enumerate(LENGTHS)))) + " END"


def scan(docs: DataFrame, *carried: str) -> DataFrame:
    """Base spans and tested tokens of every row: ``(doc_id, *carried, base, tested)``."""
    w, x, y = fresh("w"), fresh("x"), fresh("y")
    plain = f"{w} -> struct({w}.kind AS kind, {w}.start AS start, {w}.end AS end)"
    assign = f"filter({find('body', 'assign', ASSIGN, 'true', ASSIGNED)}, {x} -> char_length({x}.key) >= 12)"
    access = find("body", "access", ACCESS, "contains(body, 'AKIA')")
    hexes = find("body", "hex", HEX, "body RLIKE '[0-9a-f]{16}'")
    tokens = find("body", "random", TOKEN, "body RLIKE '[A-Za-z0-9+/_=-]{20}'")
    mixed = f"filter({tokens}, {x} -> {x}.hit RLIKE '[0-9]' AND {x}.hit RLIKE '[A-Za-z]')"
    order = f"CASE {y}.kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END"
    base = (
        f"transform(array_sort(transform(concat({assign}, {access}, {hexes}), "
        f"{y} -> struct({y}.start AS start, {order} AS ord, {y}.end AS end, {y}.kind AS kind))), {plain})"
    )
    tested = (
        f"transform({mixed}, {w} -> struct({w}.start AS start, {w}.end AS end, "
        f"{_length_class(f'char_length({w}.hit)')} AS class, {_p_value(f'{w}.hit')} AS p))"
    )
    return docs.selectExpr("doc_id", *carried, "coalesce(text, '') AS body").selectExpr(
        "doc_id", *carried, f"{base} AS base", f"{tested} AS tested")


def cutoffs(scanned: DataFrame) -> list[float]:
    """For each length class the p-value below which randomness is rejected (Benjamini-Hochberg over all tokens).

    Tokens are counted on a scale of ``STEPS`` steps, so the ranked table has a
    fixed number of rows whatever the corpus.
    """
    counted = (
        scanned.selectExpr("explode(tested) AS t").where("t.p IS NOT NULL")
        .selectExpr("t.class AS class", f"CAST(ceil(t.p * {STEPS}) AS INT) AS step")
        .groupBy("class", "step").agg(F.count("*").alias("n"))
    )
    upto = Window.partitionBy("class").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    passed = (
        counted.withColumn("rank", F.sum("n").over(upto))
        .withColumn("total", F.sum("n").over(Window.partitionBy("class")))
        .where(F.col("step") / F.lit(STEPS) <= F.lit(RATE) * F.col("rank") / F.col("total"))
        .groupBy("class").agg(F.max("step").alias("step"))
    )
    found = {r["class"]: r["step"] / STEPS for r in passed.collect()}  # a row per length class
    return [found.get(i, 0.0) for i in range(len(LENGTHS))]


def _decided(scanned: DataFrame, *carried: str) -> DataFrame:
    limits = "array(" + ", ".join(f"{c}D" for c in cutoffs(scanned)) + ")"
    x, y, b = fresh("x"), fresh("y"), fresh("b")
    free = f"NOT exists(base, {b} -> {b}.start < {x}.end AND {x}.start < {b}.end)"
    secret = f"{x}.p IS NOT NULL AND {x}.p > {limits}[{x}.class] AND {free}"
    added = f"transform(filter(tested, {x} -> {secret}), {y} -> struct('random' AS kind, {y}.start AS start, {y}.end AS end))"
    w = fresh("w")
    order = f"CASE {w}.kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 ELSE 3 END"
    both = (
        f"transform(array_sort(transform(concat(base, {added}), {w} -> struct({w}.start AS start, {order} AS ord, "
        f"{w}.end AS end, {w}.kind AS kind))), {w} -> struct({w}.kind AS kind, {w}.start AS start, {w}.end AS end))"
    )
    return scanned.selectExpr("doc_id", *carried, "base", f"{both} AS spans")


def secrets(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, spans)`` of every row of ``docs(doc_id, text)``.

    Both are arrays of ``(kind, start, end)`` by start, then kind (assign,
    access, hex, random); places in code points, end exclusive. ``spans`` adds
    to ``base`` the random tokens that overlap none of it.

    A null text counts as empty and has empty arrays. Repeated rows come back as
    often as given, null ids stay null, extra columns are not read, an empty
    table gives no rows. Whole texts are read, in time linear in their length.
    """
    return _decided(stage(scan(docs), "scanned"))


def report(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and list of all spans, from ``secrets``."""
    return found.selectExpr(
        "doc_id",
        *(f"{count('base', kind)} AS n_{kind}" for kind in BASE),
        f"sha2({listed('base')}, 256) AS base_sha256",
        f"{listed('spans')} AS spans",
    )


#: What stands for a secret in a masked text.
MASK = "[SECRET]"


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``MASK``; ``n_chars`` is counted anew where it is a column.

    Overlapping spans are masked as one. Rows and other columns stay as they
    are; a null text stays null.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = docs.select(
        F.col("doc_id"), "text", F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in rest)).alias("_rest"))
    found = _decided(stage(scan(held, "text", "_rest"), "scanned"), "text", "_rest")
    s, x = fresh("s"), fresh("x")
    # pieces between the spans; ``at`` is the end of the last one, spans come by start
    masked = (
        f"aggregate(spans, struct(0 AS at, '' AS out), ({s}, {x}) -> struct(greatest({s}.at, {x}.end) AS at, "
        f"IF({x}.start < {s}.at AND {s}.at > 0, {s}.out, "
        f"concat({s}.out, substr(text, {s}.at + 1, {x}.start - {s}.at), {quote(MASK)})) AS out), "
        f"{s} -> concat({s}.out, substr(text, {s}.at + 1)))"
    )
    clean = found.selectExpr(
        f"struct(doc_id, IF(size(spans) = 0, text, {masked}) AS text) AS _new", "_rest").selectExpr(
        "_new.doc_id", "_new.text", *(f"_rest.`{c}`" for c in rest))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        clean = clean.withColumn("n_chars", F.char_length("text").cast(kind))
    return clean.select(*(F.col(f"`{c}`") for c in docs.columns))
