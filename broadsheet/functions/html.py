"""Body text of an HTML page, with native string expressions only.

Tags are read in order with a stack of open elements: an end tag closes the
nearest open element of its name and all that were opened within, and means
nothing if none is open. So a container also ends where an element around it
ends. Elements that cannot hold anything and tags that end in ``/>`` open nothing.
Quoted ``>`` in attributes, comments, scripts, named and numeric entities are
followed.
"""

from __future__ import annotations

from functools import reduce
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.dims import BODY_DIV_CLASSES, MIN_CHARS
from broadsheet.functions.text import let, strip

# Marks put into the markup while it is read: a gap between two text pieces, a
# cut before a tag (also around names on the stack), the end of a tag, and decoded
# characters that must not be taken for markup.
_GAP, _CUT, _END = "\x01", "\x02", "\x07"
_MARKUP_CHARS, _STAND_INS = "<>\"'", "\x03\x04\x05\x06"

# A tag's attributes: a quoted value may hold ``>``. Possessive quantifiers keep
# the match linear and free of recursion on broken markup.
_ATTRS = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+"""
# An element that holds text alone leaves the stack as it was; it is read as text
# (group 2). Any other tag is group 3.
_LEAF = rf"<(?!(?:article|body|div)[\s/>])([a-z][^\s/>]*+){_ATTRS}(?<!/)>([^<]*+)</\1\s*+>"
_LEAF_OR_TAG = rf"(?i){_LEAF}|(</?[a-z]{_ATTRS}>)"
_ALL = 1 << 30  # as a length: up to the end
_DECLARATION = "<[!?][^>]*+>"
# Elements without content.
_EMPTY = " area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr "
# A slash before the ``>`` that belongs to an unquoted value.
_VALUE_SLASH = r"""=\s*[^\s"'>]*/>$"""
# Value of a tag's class attribute; quoted values before it are skipped whole.
_CLASS = r"""(?is)^<div(?=\s)(?:[^>"']*+(?:"[^"]*+"|'[^']*+'))*?[^>"']*?\sclass\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
# Not text: comments and these elements, which run to the end if never closed.
# Nor are ruby annotations, which end where the next one or the ruby itself does.
_UNSEEN = (
    r"(?is)<!--.*?-->|<(script|style|noscript|template)(?:[\s/][^>]*+)?>.*?(?:</\1\s*+>|\z)"
    r"|<r[tp](?:[\s/][^>]*+)?>.*?(?=</?(?:rt|rp|ruby)[\s/>]|\z)"
)

# Characters by entity name; numbers 128-159 are read as Windows-1252, as
# browsers do. Looking up a map takes time by its size, so the names that pages
# mostly use come first and all others of HTML 5 only when those fail.
_COMMON = {name: chr(code) for name, code in name2codepoint.items()} | {
    f"#{n}": bytes([n]).decode("cp1252", "replace") for n in range(128, 160)
} | {"apos": "'"}
_OTHERS = {name.rstrip(";"): chars for name, chars in html5.items() if name.rstrip(";") not in _COMMON}


def _named_char(name: Column) -> Column:
    def found(table: dict[str, str]) -> Column:
        rows = "\x07".join(f"{known}\x08{chars}" for known, chars in table.items())
        return F.try_element_at(F.str_to_map(F.lit(rows), F.lit("\x07"), F.lit("\x08")), name)

    return F.coalesce(found(_COMMON), found(_OTHERS))


def _numbered_char(name: Column) -> Column:
    """Character for ``#233`` or ``#xe9``; null if ``name`` is not of that form."""
    number = F.when(
        name.rlike("^#[xX][0-9a-fA-F]{1,6}$"), F.conv(F.substr(name, F.lit(3)), 16, 10)
    ).when(name.rlike("^#[0-9]+$"), F.substr(name, F.lit(2)))

    def char(code: Column) -> Column:
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        utf32 = F.unhex(F.lpad(F.hex(code), 8, "0"))
        return (
            F.when(code.between(128, 159), _named_char(F.concat(F.lit("#"), code)))
            .when(valid, F.decode(utf32, "UTF-32"))
            .otherwise(F.lit("\ufffd"))
        )

    return F.when(F.startswith(name, F.lit("#")), let(number.try_cast("bigint"), char))


def _decode_piece(piece: Column) -> Column:
    """Text that followed an ampersand, with its leading entity replaced."""
    def decoded(name: Column) -> Column:
        known = F.coalesce(_named_char(name), _numbered_char(name))
        char = F.translate(known, _MARKUP_CHARS, _STAND_INS)
        rest = F.substr(piece, F.length(name) + 1)
        return F.when(name == "", F.concat(F.lit("&"), piece)).otherwise(
            F.concat(
                F.coalesce(char, F.concat(F.lit("&"), name)),
                F.regexp_replace(rest, "^;", ""),
            )
        )

    form = r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][-.a-zA-Z0-9]*)(?![a-zA-Z0-9])"
    return let(F.regexp_extract(piece, form, 1), decoded)


def _decode_entities(markup: Column) -> Column:
    """Replace entities; an unknown one loses only its semicolon.

    Decoded angle brackets and quotes come out as stand-ins, so that the markup
    can still be read afterwards.
    """

    def decoded(pieces: Column) -> Column:
        tail = F.transform(F.slice(pieces, 2, F.size(pieces)), _decode_piece)
        return F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))

    return let(F.split(markup, "&"), decoded)


def _pieces(markup: Column) -> Column:
    """Stripped text pieces joined by gap marks; null stays null."""
    pieces = F.split(F.regexp_replace(markup, _DECLARATION, _GAP), _GAP)
    return F.array_join(F.array_remove(F.transform(pieces, strip), ""), _GAP)


#: Containers of an article, best first: (element, class or "").
_CONTAINERS = [("article", ""), *(("div", c) for c in BODY_DIV_CLASSES), ("body", "")]


def _opened(tag: Column, name: Column) -> Column:
    """The containers that a start tag opens, one bit each."""

    def by_class(value: Column) -> Column:
        listed = F.split(F.trim(F.translate(value, "\"'\t\r\n\f", " " * 6)), " +")
        bits = [F.when(F.array_contains(listed, c), 1 << i).otherwise(0)
                for i, (_, c) in enumerate(_CONTAINERS) if c]
        return reduce(Column.__add__, bits)

    bits = F.when(name == "div", let(F.regexp_extract(tag, _CLASS, 1), by_class))
    for i, (element, css_class) in enumerate(_CONTAINERS):
        if not css_class:
            bits = bits.when(name == element, 1 << i)
    return F.when(F.startswith(tag, F.lit("</")), 0).otherwise(bits.otherwise(0))


def _tags(markup: Column) -> Column:
    """Tags in order, but for leaves: name, move (1 opens, -1 closes), containers opened, text that follows."""

    def read(part: Column) -> Column:
        def named(tag: Column) -> Column:
            def row(name: Column) -> Column:
                closed = F.endswith(tag, F.lit("/>")) & ~tag.rlike(_VALUE_SLASH)
                empty = F.contains(F.lit(_EMPTY), F.concat(F.lit(" "), name, F.lit(" ")))
                move = F.when(F.startswith(tag, F.lit("</")), -1).when(empty | closed, 0).otherwise(1)
                return F.struct(
                    F.concat(F.lit(_CUT), name, F.lit(_CUT)).alias("name"),
                    move.alias("move"),
                    _opened(tag, name).alias("opened"),
                    F.substring_index(part, _END, -1).alias("text"),
                )

            return let(F.lower(F.regexp_extract(tag, r"^</?([^\s/>]+)", 1)), row)

        return let(F.substring_index(part, _END, 1), named)

    marked = F.regexp_replace(markup, _LEAF_OR_TAG, f"{_CUT}$3{_END}$2{_GAP}")
    parts = F.split(F.replace(marked, F.lit(_CUT + _END), F.lit(_GAP)), _CUT)  # used once: it would be computed again
    return F.transform(F.slice(parts, 2, _ALL), read)


def _after(stack: Column, tag: Column) -> Column:
    """Open elements after a tag; the stack is a text of marked names, the innermost last."""
    name = tag["name"]
    inner = F.call_function("substring_index", stack, name, F.lit(-1))
    outer = F.left(stack, F.length(stack) - F.length(inner) - F.length(name))
    return (
        F.when(tag["move"] == 1, F.concat(stack, name))
        .when((tag["move"] == -1) & F.contains(stack, name), outer)
        .otherwise(stack)
    )


def _content(tags: Column, container: Column) -> Column:
    """Text pieces in the first container of a kind; null if there is none."""

    def enclosed(at: Column) -> Column:
        def inside(around: Column) -> Column:
            def walk(state: Column, tag: Column) -> Column:
                def step(stack: Column) -> Column:
                    still = F.length(stack) > F.length(around)
                    return F.struct(
                        F.when(still, stack).otherwise("").alias("stack"),
                        (state["kept"] + still.cast("int")).alias("kept"),
                    )

                return F.when(state["stack"] == "", state).otherwise(let(_after(state["stack"], tag), step))

            start = F.get(tags, at - 1)
            begin = F.struct(_after(around, start).alias("stack"), F.lit(1).alias("kept"))
            kept = F.aggregate(F.slice(tags, at + 1, _ALL), begin, walk)["kept"]
            texts = F.transform(F.slice(tags, at, kept), lambda tag: tag["text"])
            return F.when(start["move"] == 1, F.array_join(texts, _GAP)).otherwise("")

        return F.when(at > 0, let(F.aggregate(F.slice(tags, 1, at - 1), F.lit(""), _after), inside))

    opens = F.transform(tags, lambda tag: tag["opened"].bitwiseAND(container) != 0)
    return let(F.array_position(opens, True).cast("int"), enclosed)


def html_text(html: Column, limit: int = MIN_CHARS) -> Column:
    """Text of the first container, in order of preference, that holds enough.

    Enough means more than ``limit`` characters, counted without the line
    breaks between pieces. ``''`` if no container does. A container is looked
    into only when all before it have failed.
    """

    def accept(pieces: Column) -> Column:
        long_enough = F.length(F.replace(pieces, F.lit(_GAP), F.lit(""))) > limit
        return F.when(long_enough, F.replace(pieces, F.lit(_GAP), F.lit("\n"))).otherwise("")

    def choose(tags: Column) -> Column:
        def try_next(text: Column, container: Column) -> Column:
            content = _content(tags, container)
            return F.when(text == "", F.coalesce(let(_pieces(content), accept), F.lit(""))).otherwise(text)

        containers = F.array(*(F.lit(1 << i) for i in range(len(_CONTAINERS))))
        return F.aggregate(containers, F.lit(""), try_next)

    seen = F.regexp_replace(F.coalesce(html, F.lit("")), _UNSEEN, _GAP)
    return F.translate(let(_tags(_decode_entities(seen)), choose), _STAND_INS, _MARKUP_CHARS)
