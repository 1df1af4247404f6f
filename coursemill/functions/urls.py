"""URL, slug and ordering rules of the course site, as SQL expressions."""

from __future__ import annotations

from coursemill.functions.columns import WHITESPACE, contains_any, first_int, fresh, let, quote

# Default site and folders that relative links are resolved against.
SITE = "https://learn.microsoft.com"
LOCALE = "/en-us/"
TRAINING = "/en-us/training"

_SPACE_CLASS = "".join(f"\\x{{{ord(c):X}}}" for c in WHITESPACE)


def _part(text: str, pattern: str) -> str:
    return f"regexp_extract({text}, {quote(pattern)}, 1)"


def _scheme(url: str) -> str:
    return f"lower({_part(url, r'^([a-zA-Z][a-zA-Z0-9+.-]*):')})"


def _path(url: str) -> str:
    return _part(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)")


def _suffix(text: str, mark: str, value: str) -> str:
    return f"IF({value} = '', '', concat('{mark}', {value}))"


def resolve_dots(segments: str) -> str:
    """Apply '.' and '..' to a path segment array and join it."""
    acc, seg = fresh("acc"), fresh("seg")
    folded = f"""aggregate({segments}, CAST(array() AS array<string>), ({acc}, {seg}) -> CASE
        WHEN {seg} = '..' THEN slice({acc}, 1, greatest(size({acc}) - 1, 0))
        WHEN {seg} = '.' THEN {acc}
        ELSE concat({acc}, array({seg})) END)"""
    tail = f"IF(element_at({segments}, -1) IN ('.', '..'), array(''), CAST(array() AS array<string>))"
    joined = f"array_join(concat({folded}, {tail}), '/')"
    return let(joined, lambda p: f"IF(startswith({p}, '/'), {p}, concat('/', {p}))")


def url_join(base: str, href: str) -> str:
    """RFC 3986 reference resolution."""

    def with_parts(ref: str) -> str:
        query, fragment = _part(ref, r"\?([^#]*)"), _part(ref, r"(?s)#(.*)$")
        origin = f"concat({_scheme(base)}, '://', {_part(base, r'^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)')})"
        x, i = fresh("x"), fresh("i")
        segments = let(
            f"""IF(startswith({ref}, '/'), split({_path(ref)}, '/'), concat(
                let_parts, split({_path(ref)}, '/')))""".replace(
                "let_parts",
                let(
                    f"split({_path(base)}, '/')",
                    lambda b: f"IF(element_at({b}, -1) = '', {b}, slice({b}, 1, size({b}) - 1))",
                ),
            ),
            lambda s: f"IF(startswith({ref}, '/'), {s}, "
            f"filter({s}, ({x}, {i}) -> {x} <> '' OR {i} = 0 OR {i} = size({s}) - 1))",
        )
        path = let(segments, resolve_dots)
        kept_query = f"IF({query} = '', {_part(base, r'\?([^#]*)')}, {query})"
        hash_part = _suffix(ref, "#", fragment)
        return f"""CASE
            WHEN startswith({ref}, '//') THEN concat({_scheme(base)}, ':', {ref})
            WHEN {_path(ref)} = '' THEN concat({origin}, {_path(base)}, {_suffix(ref, "?", kept_query)}, {hash_part})
            ELSE concat({origin}, {path}, {_suffix(ref, "?", query)}, {hash_part}) END"""

    relative = f"IF({_scheme(href)} = {_scheme(base)}, substr({href}, length({_scheme(href)}) + 2), {href})"
    return f"""CASE
        WHEN {base} = '' THEN {href}
        WHEN {href} = '' THEN {base}
        WHEN {_scheme(href)} NOT IN ('', {_scheme(base)}) THEN {href}
        ELSE {let(relative, with_parts)} END"""


# --- P3 ------------------------------------------------------------------


def title_case(text: str) -> str:
    """Capital after any non-letter, lower case elsewhere."""
    w = fresh("w")
    words = f"regexp_extract_all({text}, '(\\\\p{{L}}+|\\\\P{{L}}+)', 1)"
    return f"array_join(transform({words}, {w} -> concat(upper(substr({w}, 1, 1)), lower(substr({w}, 2)))), '')"


def uid_slug(uid: str) -> str:
    return f"element_at(split({uid}, '[.]'), -1)"


def path_url(slug: str, site: str) -> str:
    return f"concat({quote(site + TRAINING + '/paths/')}, {slug}, '/')"


def path_title(slug: str) -> str:
    return title_case(f"replace({slug}, '-', ' ')")


# --- P5 ------------------------------------------------------------------


def module_url(page_url: str, href: str, site: str) -> str:
    """Absolute module URL with a trailing slash."""
    absolute = f"""CASE
        WHEN startswith({href}, '../../modules/')
            THEN replace({href}, '../../modules/', {quote(site + TRAINING + '/modules/')})
        WHEN startswith({href}, '/modules/') THEN concat({quote(site + TRAINING)}, {href})
        WHEN startswith({href}, '/training/modules/') THEN concat({quote(site)}, {href})
        ELSE {url_join(page_url, href)} END"""
    return let(absolute, lambda u: f"IF(endswith({u}, '/'), {u}, concat({u}, '/'))")


# --- P7, P9 --------------------------------------------------------------

# Words that mark a unit link, and default unit positions in the
# order they are tried.
UNIT_WORDS = ["introduction", "summary", "assessment", "exercise"]
UNIT_DEFAULTS = [
    ("introduction", 1), ("summary", 999), ("assessment", 998), ("knowledge-check", 998), ("exercise", 900),
]
UNIT_FALLBACK = 500


def is_unit_link(href: str, title: str) -> str:
    """A titled keyword link, or any link numbered 1-19."""
    return f"""(({title} <> '' AND {contains_any(href, UNIT_WORDS)})
        OR {href} RLIKE '^(1[0-9]|[1-9])-')"""


def unit_number(url: str, title: str) -> str:
    """Position of a unit: from the URL, else the title, else by its kind."""
    by_word = " ".join(f"WHEN contains(lower({title}), '{w}') THEN {n}L" for w, n in UNIT_DEFAULTS)
    return f"""coalesce({first_int(url, r'/([0-9]+)-')}, {first_int(title, r'^([0-9]+)[.\s]')},
        CASE {by_word} ELSE {UNIT_FALLBACK}L END)"""


# --- C7, C8, K6 ----------------------------------------------------------


def image_url(page_url: str, src: str, site: str) -> str:
    return f"""CASE
        WHEN startswith({src}, '../../') THEN concat({quote(site + LOCALE)}, substr({src}, 7))
        WHEN startswith({src}, '/') THEN concat({quote(site)}, {src})
        WHEN NOT startswith({src}, 'http') THEN {url_join(page_url, src)}
        ELSE {src} END"""


def image_filename(url: str) -> str:
    """Text after the last slash, then cut at the query mark."""
    return f"split_part(element_at(split({url}, '/'), -1), '?', 1)"


def output_slug(title: str) -> str:
    """File-name slug of a course title."""
    kept = f"regexp_replace({title}, {quote(f'[^{chr(92)}p{{L}}{chr(92)}p{{N}}_{_SPACE_CLASS}-]')}, '')"
    trimmed = f"btrim({kept}, {quote(WHITESPACE)})"
    return f"lower(regexp_replace({trimmed}, {quote(f'[-{_SPACE_CLASS}]+')}, '-'))"
