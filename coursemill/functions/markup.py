"""HTML as Spark SQL expressions: tokens, entities, attributes, element spans.

Everything here is SQL over JVM built-ins. A page is one row and stays one row:
its tokens live in an array, and one left-to-right fold pairs open and close
tags with a stack. No token is shuffled, and cost is linear in the page.
"""

from __future__ import annotations

import html.entities
from collections.abc import Callable

from coursemill.functions.columns import fresh, let, quote, quoted, strip

# Comments, opaque script/style blocks and tags are one token each. The text
# alternative swallows stray '<' so that one text node is one token. Possessive
# loops match without recursion, so a tag or text of any size is safe.
TOKEN_PATTERN = (
    r"(?is)<!--.*?-->"
    r"|<script\b.*?(?:</script\s*>|\z)"
    r"|<style\b.*?(?:</style\s*>|\z)"
    r"""|</?[a-z][^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>"""
    r"|<[!?][^>]*>"
    r"|(?:[^<]++|<(?![a-z/!?]))++"
    r"|<"
)

# Elements without a closing tag.
VOID_TAGS = [
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed",
    "frame", "hr", "image", "img", "input", "isindex", "keygen", "link",
    "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr",
]
# Subtrees removed from the content area (script and style are
# opaque tokens and never become text).
BOILERPLATE_TAGS = ["nav", "footer", "header"]
# Elements whose own strings are not part of page text.
MUTED_TAGS = ["template", "rt", "rp"]
HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
CODE_TAGS = ["code", "pre"]
TRACKED_TAGS = HEADING_TAGS + CODE_TAGS + ["p", "a", "figure", "figcaption", "article", "main"]

_CHUNK = 32


# --- T1 tokens -----------------------------------------------------------


def tokens(page: str) -> str:
    """ARRAY<STRING> of the page's tokens in document order."""
    return f"regexp_extract_all({page}, {quote(TOKEN_PATTERN)}, 0)"


def tag_name(raw: str) -> str:
    """Lower-case tag of an open, close or void token; '' otherwise."""
    pattern = quote(r"^</?([a-zA-Z][^\s/>]*)")
    return f"CASE WHEN startswith({raw}, '<') THEN lower(regexp_extract({raw}, {pattern}, 1)) ELSE '' END"


def token_kind(raw: str, tag: str) -> str:
    """text, open, close, void, comment, script, style or decl."""
    return f"""CASE
        WHEN NOT startswith({raw}, '<') THEN 'text'
        WHEN startswith({raw}, '<!--') THEN 'comment'
        WHEN startswith({raw}, '<!') OR startswith({raw}, '<?') THEN 'decl'
        WHEN {tag} = '' THEN 'text'
        WHEN startswith({raw}, '</') THEN 'close'
        WHEN {tag} IN ('script', 'style') THEN {tag}
        WHEN endswith({raw}, '/>') OR {tag} IN ({quoted(VOID_TAGS)}) THEN 'void'
        ELSE 'open' END"""


# --- T2 entities ---------------------------------------------------------


def _named_entities() -> str:
    """MAP name -> character, generated from the standard HTML5 table.

    One string literal keeps the plan small; the optimizer folds it to a map.
    """
    names = {name.rstrip(";"): char for name, char in html.entities.html5.items()}
    pairs = "\x1e".join(f"{name}\x1f{char}" for name, char in sorted(names.items()))
    return f"str_to_map({quote(pairs)}, {quote(chr(0x1e))}, {quote(chr(0x1f))})"


def _windows_1252() -> str:
    """Characters that numeric references 128-159 stand for."""
    chars = {
        code: bytes([code]).decode("windows-1252")
        for code in range(128, 160)
        if code not in (129, 141, 143, 144, 157)
    }
    return "map(" + ", ".join(f"{code}L, {quote(char)}" for code, char in chars.items()) + ")"


def code_point(code: str) -> str:
    """Character of a BIGINT code point; U+FFFD when there is none."""
    wide = f"decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32')"
    return f"""CASE
        WHEN {code} BETWEEN 128 AND 159 THEN coalesce(try_element_at({_windows_1252()}, {code}), {wide})
        WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN {wide}
        ELSE '\ufffd' END"""


def decode_entities(text: str) -> str:
    """Replace character references; unknown names keep ``&name``."""
    pieces = r"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[a-zA-Z][a-zA-Z0-9]*;?|[^&]+|&"
    p = fresh("piece")

    def number(value: str) -> str:
        return let(value, code_point)

    hexadecimal = f"CAST(conv(regexp_extract({p}, '^&#[xX]0*([0-9a-fA-F]{{1,7}});?$', 1), 16, 10) AS BIGINT)"
    decimal = f"try_cast(regexp_extract({p}, '^&#0*([0-9]{{1,9}});?$', 1) AS BIGINT)"
    name = f"rtrim(';', substr({p}, 2))"
    decoded = f"""CASE
        WHEN NOT startswith({p}, '&') OR {p} = '&' THEN {p}
        WHEN {p} IN ('&amp;', '&amp') THEN '&'
        WHEN {p} IN ('&lt;', '&lt') THEN '<'
        WHEN {p} IN ('&gt;', '&gt') THEN '>'
        WHEN {p} IN ('&quot;', '&quot') THEN '"'
        WHEN {p} IN ('&nbsp;', '&nbsp') THEN '\u00a0'
        WHEN startswith(lower({p}), '&#x') THEN {number(hexadecimal)}
        WHEN startswith({p}, '&#') THEN {number(decimal)}
        ELSE coalesce(try_element_at({_named_entities()}, {name}), concat('&', {name})) END"""
    return f"""CASE WHEN contains({text}, '&') THEN array_join(
        transform(regexp_extract_all({text}, {quote(pieces)}, 0), {p} -> {decoded}), '') ELSE {text} END"""


# --- T5 attributes -------------------------------------------------------


def attribute(raw: str, name: str) -> str:
    """Decoded attribute value of a tag token; '' when absent or empty.

    Reads whole attributes, so a name inside another attribute's value or at
    the end of a longer name (``data-src``) never matches. The last of several
    attributes with one name counts.
    """
    value = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"']*+)"""
    one = quote(rf"[\s/]++[^\s=/>]++(?:\s*+=\s*+{value})?+")
    named = quote(rf"(?is)^[\s/]++{name}\s*+=\s*+({value})$")
    a = fresh("a")
    attributes = f"regexp_extract_all(regexp_replace({raw}, '^<[^\\\\s/>]+', ''), {one}, 0)"
    last = f"coalesce(try_element_at(filter({attributes}, {a} -> {a} RLIKE {named}), -1), '')"

    def unquote(v: str) -> str:
        return f"CASE WHEN {v} RLIKE '^[\"\\']' THEN substr({v}, 2, length({v}) - 2) ELSE {v} END"

    found = let(f"regexp_extract({last}, {named}, 1)", unquote)
    return f"CASE WHEN contains(lower({raw}), {quote(name)}) THEN {let(found, decode_entities)} ELSE '' END"


# --- T3/T4 element spans -------------------------------------------------

_ENTRY = {
    "pos": "int", "tag": "string", "raw": "string", "t0": "int", "a0": "int", "kept": "boolean",
    "captions": "int", "figure": "int", "dropped": "int", "muted": "int", "inroot": "boolean",
}
_ELEMENT = {
    "pos": "int", "tag": "string", "raw": "string", "t0": "int", "t1": "int", "a0": "int", "a1": "int",
    "stop": "int", "kept": "boolean", "captions": "int",
}
_IMAGE = {"pos": "int", "raw": "string", "headings": "int", "paragraphs": "int", "figure": "int"}


def _array_of(fields: dict[str, str]) -> str:
    return "array<struct<" + ",".join(f"{f}:{t}" for f, t in fields.items()) + ">>"


# n_text counts the texts that are kept, n_all also those in dropped subtrees; left is the number of
# elements open below the stack, captions that of the captions before an element
_OUTPUT = {
    "texts": "array<string>", "all_texts": "array<string>",
    "elements": _array_of(_ELEMENT), "images": _array_of(_IMAGE),
}
_STATE = {
    "stack": _array_of(_ENTRY), "left": "int", "dropped": "int", "muted": "int", "inroot": "boolean", "n_text": "int",
    "n_all": "int", "headings": "int", "paragraphs": "int", "figures": "int", "captions": "int", **_OUTPUT,
}


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{f}', {e}" for f, e in fields.items()) + ")"


def _with(state: str, **changes: str) -> str:
    return _struct({f: changes.get(f, f"{state}.{f}") for f in _STATE})


def _empty(array_type: str) -> str:
    return f"CAST(array() AS {array_type})"


def _element(entry: str, stop: str, state: str) -> str:
    same = {f: f"{entry}.{f}" for f in ("pos", "tag", "raw", "t0", "a0", "kept", "captions")}
    ends = {"t1": f"{state}.n_text", "a1": f"{state}.n_all", "stop": stop}
    return _struct({f: (same | ends)[f] for f in _ELEMENT})


def _close_entries(entries: str, stop: str, state: str) -> str:
    e = fresh("e")
    tracked = f"filter({entries}, {e} -> {e}.tag IN ({quoted(TRACKED_TAGS)}))"
    return f"transform({tracked}, {e} -> {_element(e, stop, state)})"


def _step(s: str, i: str, root: str, below: str, names: str) -> str:
    """SQL for one token ``i`` of the fold over state ``s``.

    ``below`` are the elements open beneath the stack, of which the first
    ``left`` still are, and ``names`` their different tags.
    """
    visible = f"{s}.dropped = 0"

    def bumped(counter: str, tags: list[str]) -> str:
        return f"{s}.{counter} + IF({visible} AND {i}.tag IN ({quoted(tags)}), 1, 0)"

    counters = {
        "headings": bumped("headings", HEADING_TAGS),
        "paragraphs": bumped("paragraphs", ["p"]),
        "figures": bumped("figures", ["figure"]),
        "captions": bumped("captions", ["figcaption"]),
    }
    enclosing_figure = f"coalesce(get({s}.stack, size({s}.stack) - 1).figure, get({below}, {s}.left - 1).figure, 0)"
    inroot = f"({s}.inroot OR {i}.pos = {root})"
    here = {
        "pos": f"{i}.pos", "tag": f"{i}.tag", "raw": f"{i}.raw",
        "t0": f"{s}.n_text", "a0": f"{s}.n_all", "kept": visible, "captions": f"{s}.captions",
    }
    entry = _struct({
        **here,
        "figure": f"IF({visible} AND {i}.tag = 'figure', {s}.figures + 1, {enclosing_figure})",
        "dropped": f"{s}.dropped", "muted": f"{s}.muted", "inroot": f"{s}.inroot",
    })
    text = _with(
        s,
        n_text=f"{s}.n_text + IF({visible}, 1, 0)",
        n_all=f"{s}.n_all + 1",
        texts=f"IF({visible}, concat({s}.texts, array({i}.raw)), {s}.texts)",
        all_texts=f"concat({s}.all_texts, array({i}.raw))",
    )
    opened = _with(
        s,
        stack=f"concat({s}.stack, array({entry}))",
        dropped=f"{s}.dropped + IF({inroot} AND {i}.tag IN ({quoted(BOILERPLATE_TAGS)}), 1, 0)",
        muted=f"{s}.muted + IF({i}.tag IN ({quoted(MUTED_TAGS)}), 1, 0)",
        inroot=inroot,
        **counters,
    )
    image = _with(s, images=f"concat({s}.images, array(" + _struct({
        "pos": f"{i}.pos", "raw": f"{i}.raw", "headings": f"{s}.headings",
        "paragraphs": f"{s}.paragraphs", "figure": enclosing_figure,
    }) + "))")
    ends = {"t1": here["t0"], "a1": here["a0"], "stop": f"{i}.pos"}
    bare = _struct({f: (here | ends)[f] for f in _ELEMENT})
    empty = _with(s, elements=f"concat({s}.elements, array({bare}))", **counters)

    # a close tag pops the nearest open element of its name and all above it
    def pop(bottom: str, popped: str, **rest: str) -> str:
        return _with(
            s,
            dropped=f"{bottom}.dropped",
            muted=f"{bottom}.muted",
            inroot=f"{bottom}.inroot",
            elements=f"concat({s}.elements, {_close_entries(popped, f'{i}.pos', s)})",
            **rest,
        )

    def from_stack(depth: str) -> str:
        here = pop(f"get({s}.stack, size({s}.stack) - {depth})", f"slice({s}.stack, -{depth}, {depth})",
                   stack=f"slice({s}.stack, 1, size({s}.stack) - {depth})")
        return f"IF({depth} > 0, {here}, IF(array_contains({names}, {i}.tag), {deeper}, {s}))"

    def from_below(depth: str) -> str:
        there = pop(f"get({below}, {s}.left - {depth})",
                    f"concat(slice({below}, {s}.left - {depth} + 1, {depth}), {s}.stack)",
                    stack=_empty(_STATE["stack"]), left=f"{s}.left - {depth}")
        return f"IF({depth} > 0, {there}, {s})"

    def depth_in(tags: str) -> str:
        return f"CAST(array_position(reverse({tags}), {i}.tag) AS INT)"

    deeper = let(depth_in(f"slice({below}.tag, 1, {s}.left)"), from_below)
    closed = let(depth_in(f"{s}.stack.tag"), from_stack)
    return f"""CASE
        WHEN {i}.kind = 'text' THEN IF({s}.muted = 0, {text}, {s})
        WHEN {i}.kind = 'open' THEN {opened}
        WHEN {i}.kind = 'close' THEN {closed}
        WHEN {i}.kind = 'void' AND {i}.tag = 'img' THEN IF({visible}, {image}, {s})
        WHEN {i}.kind = 'void' THEN {empty}
        ELSE {s} END"""


def _items(raws: str) -> str:
    """Classified tokens that matter to the fold; text is decoded and stripped here, once."""
    raw, pos = fresh("raw"), fresh("pos")

    def item(tag: str) -> str:
        return let(token_kind(raw, tag), lambda kind: _struct({
            "pos": pos, "kind": kind, "tag": tag,
            "raw": f"IF({kind} = 'text', {strip(let(raw, decode_entities))}, {raw})",
        }))

    classified = f"transform({raws}, ({raw}, {pos}) -> {let(tag_name(raw), item)})"
    # what the fold would only step over: blank text, comments, scripts, plain void tags
    i = fresh("i")
    matters = f"""CASE {i}.kind WHEN 'open' THEN true WHEN 'close' THEN true WHEN 'text' THEN {i}.raw <> ''
        WHEN 'void' THEN {i}.tag IN ({quoted(['img', *TRACKED_TAGS])}) ELSE false END"""
    return f"filter({classified}, {i} -> {matters})"


def _root_position(items: str) -> str:
    """Open position of the first ``main``, else first ``article``, else -1."""

    def first(name: str) -> str:
        i = fresh("i")
        return f"get(filter({items}, {i} -> {i}.kind IN ('open', 'void') AND {i}.tag = '{name}'), 0).pos"

    return f"coalesce({first('main')}, {first('article')}, -1)"


def _view(done: str, root: str, n: str, clean: bool) -> str:
    """Document of a finished fold, with or without the dropped subtrees."""
    e = fresh("e")
    first, last = ("t0", "t1") if clean else ("a0", "a1")
    spans = f"filter({done}.elements, {e} -> {e}.kept)" if clean else f"{done}.elements"
    return _struct({
        "root": root,
        "n": n,
        "texts": f"{done}.texts" if clean else f"{done}.all_texts",
        "elements": f"""transform({spans}, {e} -> named_struct('pos', {e}.pos, 'tag', {e}.tag, 'raw', {e}.raw,
            't0', {e}.{first}, 't1', {e}.{last}, 'stop', {e}.stop, 'captions', {e}.captions))""",
        "images": f"{done}.images",
    })


def _fold(items: str, root: str, n: str, finish: Callable[[str], str]) -> str:
    """Fold the token list and shape the outcome with ``finish``.

    Every step copies its state, so that is kept small. The list is folded in
    chunks: a chunk starts with empty outputs and the last few open elements,
    which is as many as its tokens can close one by one; the others stay outside
    and are only read, for a close tag that none of the last ones answers. Chunks
    grow with the root of the page, which keeps both folds alike.
    """
    return let(f"CAST(greatest({_CHUNK}, ceil(sqrt(size({items})))) AS INT)", lambda width: _fold_by(items, root, n, width, finish))


def _fold_by(items: str, root: str, n: str, width: str, finish: Callable[[str], str]) -> str:
    acc, k, s, i, f = fresh("acc"), fresh("k"), fresh("s"), fresh("i"), fresh("f")
    start = {field: {"array": _empty(t), "int": "0"}.get(t.split("<")[0], f"{root} = -1")
             for field, t in _STATE.items()}
    outer = _struct({"state": _struct(start), "deep": _empty(_STATE["stack"]), **{o: _empty(f"array<{t}>") for o, t in _OUTPUT.items()}})
    chunk = f"slice({items}, {k} * {width} + 1, {width})"
    opened = f"concat({acc}.deep, {acc}.state.stack)"

    def fold(below: str) -> str:
        begin = _with(f"{acc}.state", stack=f"slice({opened}, size({below}) + 1, {width})", left=f"size({below})",
                      **{o: _empty(t) for o, t in _OUTPUT.items()})
        return let(f"array_distinct({below}.tag)", lambda names: (
            f"aggregate({chunk}, {begin}, ({s}, {i}) -> {_step(s, i, root, below, names)})"))

    folded = let(f"slice({opened}, 1, greatest(size({opened}) - {width}, 0))", fold)
    merged = let(folded, lambda done: _struct({
        "state": done, "deep": f"slice({opened}, 1, {done}.left)", **{o: f"concat({acc}.{o}, array({done}.{o}))" for o in _OUTPUT},
    }))
    left_open = _close_entries(f"concat({f}.deep, {f}.state.stack)", n, f"{f}.state")
    flat = _struct({
        **{o: f"flatten({f}.{o})" for o in ("texts", "all_texts", "images")},
        "elements": f"sort_array(concat(flatten({f}.elements), {left_open}))",
    })
    chunks = f"sequence(0, CAST(floor((greatest(size({items}), 1) - 1) / {width}) AS INT))"
    return f"aggregate({chunks}, {outer}, ({acc}, {k}) -> {merged}, {f} -> {let(flat, finish)})"


def _parse(page: str, root: Callable[[str], str], finish: Callable[[str, str, str], str]) -> str:
    """Tokenise and fold a page once; ``finish`` shapes (outcome, root, n)."""

    def with_tokens(raws: str) -> str:
        n = f"size({raws})"
        return let(_items(raws), lambda items: let(
            root(items), lambda r: _fold(items, r, n, lambda done: finish(done, r, n))))

    return f"CASE WHEN {page} IS NOT NULL THEN {let(tokens(page), with_tokens)} END"


def document(page: str, clean: bool) -> str:
    """Parse a page into STRUCT<root, n, texts, elements, images>.

    ``elements`` are the tracked elements in document order; ``t0``/``t1`` are
    offsets into ``texts`` (the stripped text nodes), so the text of an element
    is a slice. With ``clean`` the boilerplate subtrees inside the content area
    are gone, as content extraction wants; without it the page is left whole,
    as link and title extraction want.
    """
    root = _root_position if clean else (lambda items: "-2")
    return _parse(page, root, lambda done, r, n: _view(done, r, n, clean))


def documents(page: str) -> str:
    """Both views of a page, STRUCT<whole, clean>, from one fold."""
    return _parse(page, _root_position, lambda done, r, n: _struct({
        "whole": _view(done, r, n, False), "clean": _view(done, r, n, True),
    }))


def elements_of(doc: str, tags: list[str]) -> str:
    """Tracked elements with one of ``tags``, in document order."""
    e = fresh("e")
    return f"filter({doc}.elements, {e} -> {e}.tag IN ({quoted(tags)}))"


def element_text(doc: str, element: str) -> str:
    """Text nodes of an element, stripped and joined with nothing."""
    return f"array_join(slice({doc}.texts, {element}.t0 + 1, {element}.t1 - {element}.t0), '')"
