"""Personal data by patterns, checksums and context, as Spark SQL expressions.

Patterns propose spans; value rules and checksums (Luhn for cards, mod 97 for
bank accounts) confirm them; words nearby raise the score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from coursemill.functions.columns import contains_any, fresh, let, quote
from coursemill.llm.spans import count, find, listed, of_lists

BASE = ("email", "ip", "card", "phone")

# Patterns of the base kinds, written so that a long run is read once.
# A match can start only where a run of its first characters starts or where the last match ended (\G).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Kinds the method adds.
# Only the start of an account number is used up, so that each start is tried, with all ends that its country allows.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}"
IBAN_REST = r"(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: Length of an account number by country (IBAN registry); of other countries, every end of a word is tried.
IBAN_SIZE = {
    size: countries.split() for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST",
        26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
        31: "MT SC", 32: "LC",
    }.items()
}

#: Words that raise the score of a span they stand near.
CONTEXT = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "address", "server", "host"),
    "card": ("card", "visa", "mastercard", "payment", "credit"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social security", "tax id"),
}
#: Score without context, and what context adds. Base kinds are reported at any score, others from ``ACCEPT`` on.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
BONUS, ACCEPT = 0.2, 0.5


def _digits(hit: str) -> str:
    return f"regexp_replace({hit}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """True when the Luhn sum of a digit string is a multiple of ten."""

    def total(d: str) -> str:
        i, s, x = fresh("i"), fresh("s"), fresh("x")
        digit = f"CAST(substr({d}, char_length({d}) - {i}, 1) AS INT)"
        value = f"IF({i} % 2 = 0, {digit}, 2 * {digit} - IF({digit} > 4, 9, 0))"
        return f"aggregate(transform(sequence(0, char_length({d}) - 1), {i} -> {value}), 0, ({s}, {x}) -> {s} + {x}) % 10 = 0"

    return let(digits, total)


def mod97(account: str) -> str:
    """True when the account number, its first four characters moved to the end, leaves 1."""
    c, s = fresh("c"), fresh("s")
    step = f"IF({c} BETWEEN '0' AND '9', {s} * 10 + ascii({c}) - 48, {s} * 100 + ascii({c}) - 55) % 97"
    plain = f"replace({account}, ' ', '')"
    moved = f"concat(substr({plain}, 5), left({plain}, 4))"
    return f"aggregate(filter(split({moved}, ''), {c} -> {c} <> ''), 0, ({s}, {c}) -> {step}) = 1"


def _octets(hit: str) -> str:
    p = fresh("p")
    number = f"regexp_replace({p}, '^0+(?=[0-9])', '')"
    return f"forall(split({hit}, '[.]'), {p} -> char_length({number}) <= 3 AND CAST({number} AS INT) <= 255)"


def _valid(kind: str, hit: str) -> str:
    size = f"char_length({_digits(hit)})"
    return {
        "email": "true",
        "ip": _octets(hit),
        "card": f"CASE WHEN {size} BETWEEN 16 AND 19 THEN {luhn(_digits(hit))} ELSE false END",
        "phone": f"{size} BETWEEN 8 AND 15",
        "iban": "true",
        "ssn": "true",
    }[kind]


def accounts(found: str) -> str:
    """Account numbers that start at the matches ``found``: the longest end that the country allows and mod 97 confirms."""
    x, y, n, h = fresh("x"), fresh("y"), fresh("n"), fresh("h")
    size = "CASE " + " ".join(
        f"WHEN left({x}.hit, 2) IN ({', '.join(map(quote, names))}) THEN {n} = {size - 4}" for size, names in IBAN_SIZE.items())
    rest = f"regexp_extract({x}.key, concat('^(?:[ ]?[A-Z0-9]){{', {n}, '}}(?![A-Za-z0-9])'), 0)"
    ends = f"transform(filter(sequence(30, 11, -1), {n} -> {size} ELSE true END), {n} -> {rest})"
    valid = f"filter({ends}, {h} -> {h} <> '' AND {mod97(f'concat({x}.hit, {h})')})"
    whole = f"transform({found}, {x} -> struct({x} AS x, get({valid}, 0) AS rest))"
    return (
        f"transform(filter({whole}, {y} -> {y}.rest IS NOT NULL), {y} -> struct({y}.x.kind AS kind, {y}.x.start AS start, "
        f"{y}.x.end + char_length({y}.rest) AS end, concat({y}.x.hit, {y}.rest) AS hit, {y}.x.near AS near, {y}.x.key AS key))"
    )


def _kind(kind: str, pattern: str, needs: str) -> str:
    x, y = fresh("x"), fresh("y")
    score = f"{PRIOR[kind]} + IF({contains_any(f'{y}.near', CONTEXT[kind])}, {BONUS}, 0.0)"
    if kind == "iban":
        found = accounts(find("body", kind, pattern, needs, ahead=IBAN_REST))
    else:
        found = find("body", kind, pattern, needs)
    kept = f"filter({of_lists('body', found) if kind == 'ssn' else found}, {x} -> {_valid(kind, f'{x}.hit')})"
    scored = (
        f"transform({kept}, {y} -> struct({y}.kind AS kind, {y}.start AS start, {y}.end AS end, {y}.hit AS hit, "
        f"CAST({score} AS DOUBLE) AS score))"
    )
    if kind in BASE:
        return scored
    return f"filter({scored}, {x} -> {x}.score >= {ACCEPT})"


def personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)`` of every row of ``docs(doc_id, text)``.

    ``spans``: array of ``(kind, start, end, hit, score)`` by kind (email, ip,
    card, phone, iban, ssn), then start; places in code points, end exclusive.

    A null text counts as empty and has an empty array, as has a text without
    personal data. Repeated rows come back as often as given, null ids stay
    null, extra columns are not read, an empty table gives no rows. Whole texts
    are read, in time linear in their length.
    """
    kinds = [
        _kind("email", EMAIL, "contains(body, '@')"),
        _kind("ip", IP, r"body RLIKE '[0-9][.][0-9]'"),
        _kind("card", CARD, r"body RLIKE '[0-9](?:[ -]?[0-9]){15}'"),
        _kind("phone", PHONE, "contains(body, '+')"),
        _kind("iban", IBAN, r"body RLIKE '[A-Z]{2}[0-9]{2}'"),
        _kind("ssn", SSN, r"body RLIKE '[0-9]-[0-9]{2}-[0-9]'"),
    ]
    bodies = docs.selectExpr("doc_id", "coalesce(text, '') AS body")
    return bodies.selectExpr("doc_id", f"concat({', '.join(kinds)}) AS spans")


def report(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and list of all spans, from ``personal_data``."""
    x = fresh("x")
    base = f"filter(spans, {x} -> {x}.kind IN ({', '.join(map(quote, BASE))}))"
    return found.selectExpr(
        "doc_id",
        *(f"{count('spans', kind)} AS n_{kind}" for kind in BASE),
        f"sha2({listed(base)}, 256) AS base_sha256",
        f"{listed('spans')} AS spans",
    )
