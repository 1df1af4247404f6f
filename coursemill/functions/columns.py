"""Building blocks for SQL expressions.

The function modules return Spark SQL expression text, which callers hand to
``selectExpr``/``F.expr``. Text composes freely inside lambdas, and the JVM
parses a large expression in milliseconds where building it node by node from
Python takes seconds.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

_names = itertools.count()

# Fixed value: the characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def quote(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(words: Iterable[str]) -> str:
    """Comma list of SQL string literals."""
    return ", ".join(quote(w) for w in words)


def fresh(prefix: str = "v") -> str:
    """A lambda variable name used nowhere else."""
    return f"{prefix}_{next(_names)}"


def let(value: str, body: Callable[[str], str]) -> str:
    """Bind ``value`` once and use it many times in ``body``.

    Catalyst inlines a projected alias that is referenced once, even when the
    reference sits inside a lambda, where it would be re-evaluated for every
    element. A one-element ``transform`` pins the value to a lambda variable.
    """
    name = fresh()
    return f"get(transform(array({value}), {name} -> {body(name)}), 0)"


def strip(text: str) -> str:
    """Unicode-aware strip; ``trim`` alone only removes spaces."""
    return f"btrim({text}, {quote(WHITESPACE)})"


def first_int(text: str, pattern: str) -> str:
    """First capture group of ``pattern`` as BIGINT, null when absent."""
    return f"try_cast(regexp_extract({text}, {quote(pattern)}, 1) AS BIGINT)"


def contains_any(text: str, words: Iterable[str]) -> str:
    """True when ``text`` holds any of ``words``; plain byte search, no regex."""
    return "(" + " OR ".join(f"contains({text}, {quote(w)})" for w in words) + ")"
