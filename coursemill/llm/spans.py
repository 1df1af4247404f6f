"""Positions of all pattern matches as Spark SQL expressions.

Spark returns matches, not places. Here each match is taken together with the
text between it and the one before, so a running sum of lengths gives the
places, in code points. ``\\G`` ties every attempt to the end of the last match:
the text is read once, and the search never starts over inside a gap.
"""

from __future__ import annotations

from coursemill.functions.columns import fresh, let, quote

#: Elements a fold appends to before it starts another piece; keeps array copying linear.
PIECE = 256
#: Characters of context on either side of a match.
NEAR = 40


def running_ends(lengths: str) -> str:
    """Running sums of an array of INT, as an array."""
    state, n = fresh("s"), fresh("n")
    return (
        f"aggregate({lengths}, struct(0 AS at, CAST(array() AS ARRAY<ARRAY<INT>>) AS done, CAST(array() AS ARRAY<INT>) AS open), "
        f"({state}, {n}) -> struct({state}.at + {n} AS at, "
        f"IF(size({state}.open) >= {PIECE}, concat({state}.done, array({state}.open)), {state}.done) AS done, "
        f"IF(size({state}.open) >= {PIECE}, array({state}.at + {n}), concat({state}.open, array({state}.at + {n}))) AS open), "
        f"{state} -> concat(flatten({state}.done), {state}.open))"
    )


MATCH = "STRUCT<kind: STRING, start: INT, end: INT, hit: STRING, near: STRING, key: STRING>"


def find(text: str, kind: str, pattern: str, needs: str = "true", part: str = "", ahead: str = "") -> str:
    """Array of ``MATCH``, in order: all leftmost non-overlapping matches of ``pattern``.

    ``pattern`` holds no capturing groups, but for ``part``, a second pattern that
    follows it and whose text becomes ``key``; with ``ahead`` it must follow but is
    not used up. ``needs`` is a cheap condition without which the pattern cannot
    match. ``near`` is the text around the match, up to the neighbouring matches.
    """
    after_it = f"({part})" if part else f"(?=({ahead}))" if ahead else ""
    whole = f"\\G(?s)(.*?)({pattern}{after_it})"

    def search(group: int) -> str:
        return f"regexp_extract_all({text}, {quote(whole)}, {group})"

    def rows(found: str) -> str:
        i, x = fresh("i"), fresh("x")
        ends = f"{found}.ends[{i}]"
        size = f"char_length({x})"
        before = f"right(left({found}.whole[{i}], char_length({found}.whole[{i}]) - {size}), {NEAR})"
        after = f"left(coalesce(get({found}.whole, {i} + 1), substr({text}, {ends} + 1, {NEAR})), {NEAR})"
        near = f"lower(concat({before}, ' ', {after}))"
        key = f"{found}.key[{i}]" if part or ahead else "''"
        return (
            f"transform({found}.hits, ({x}, {i}) -> struct({quote(kind)} AS kind, {ends} - {size} AS start, {ends} AS end, "
            f"{x} AS hit, {near} AS near, {key} AS key))"
        )

    keys = search(3) if part or ahead else "CAST(array() AS ARRAY<STRING>)"
    w = fresh("w")
    parts = let(
        search(0),
        lambda g: f"struct({g} AS whole, {running_ends(f'transform({g}, {w} -> char_length({w}))')} AS ends, "
                  f"{search(2)} AS hits, {keys} AS key)",
    )
    return f"CASE WHEN {needs} THEN {let(parts, rows)} ELSE CAST(array() AS ARRAY<{MATCH}>) END"


def of_lists(text: str, found: str) -> str:
    """The matches ``found`` in ``text``, with the surroundings of its list added to ``near`` of each.

    Matches with no letter and at most ``NEAR`` characters between them are a
    list; each has also the text around the first and the last of them.
    """

    def grouped(f: str) -> str:
        i, x = fresh("i"), fresh("x")
        gap = f"substr({text}, {f}[{i} - 1].end + 1, {f}[{i}].start - {f}[{i} - 1].end)"
        apart = f"{f}[{i}].start - {f}[{i} - 1].end > {NEAR} OR {gap} RLIKE '\\\\p{{L}}'"
        opens = f"transform({f}, ({x}, {i}) -> IF(CASE WHEN {i} = 0 THEN true ELSE {apart} END, 1, 0))"
        return let(opens, lambda o: let(f"struct({running_ends(o)} AS list, {heads(o)} AS first)", lambda g: added(f, g)))

    def heads(o: str) -> str:
        i = fresh("i")
        return f"filter(sequence(0, size({o}) - 1), {i} -> {o}[{i}] = 1)"

    def added(f: str, g: str) -> str:
        i, x = fresh("i"), fresh("x")
        first = f"{f}[{g}.first[{g}.list[{i}] - 1]].near"
        last = f"{f}[coalesce(get({g}.first, {g}.list[{i}]), size({f})) - 1].near"
        return (
            f"transform({f}, ({x}, {i}) -> struct({x}.kind AS kind, {x}.start AS start, {x}.end AS end, {x}.hit AS hit, "
            f"concat({x}.near, ' ', {first}, ' ', {last}) AS near, {x}.key AS key))"
        )

    return let(found, lambda f: f"CASE WHEN size({f}) < 2 THEN {f} ELSE {grouped(f)} END")


def listed(spans: str) -> str:
    """``kind:start:end`` of each span, comma-joined."""
    x = fresh("x")
    return f"array_join(transform({spans}, {x} -> concat({x}.kind, ':', {x}.start, ':', {x}.end)), ',')"


def count(spans: str, kind: str) -> str:
    x = fresh("x")
    return f"CAST(size(filter({spans}, {x} -> {x}.kind = {quote(kind)})) AS BIGINT)"
