"""Text expressions: stripping, keyword hits, date detection."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.dims import MIN_CHARS, sql_literal

# All characters that count as white space at the ends of a text (Unicode rule;
# the plain ``trim`` function would only take U+0020).
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# What counts as a date. ``\b``, ``\d`` and ``\w`` are spelled out
# because their Unicode meaning differs between regex engines.
_WORD = r"\p{L}\p{N}_"
DATE_PATTERNS = (
    rf"(?:^|[^{_WORD}])\p{{Nd}}{{4}}[-/]\p{{Nd}}{{1,2}}[-/]\p{{Nd}}{{1,2}}(?:$|[^{_WORD}])",
    rf"[{_WORD}] \p{{Nd}}{{1,2}},? \p{{Nd}}{{4}}(?:$|[^{_WORD}])",
    rf"(?:^|[^{_WORD}])\p{{Nd}}{{1,2}} [{_WORD}]+ \p{{Nd}}{{4}}(?:$|[^{_WORD}])",
)


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.trim(text, F.lit(WHITESPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Catalyst inlines a projected expression into every filter above it; binding
    it as a lambda variable keeps costly inputs (a lowered article, cleaned
    HTML) from being computed once per use.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters will not compute a second time.

    A filter on a projected column is pushed below the projection together
    with a copy of its expression. Filters are not pushed through a generator,
    so a one-element ``inline`` pins the costly expression in place.
    """
    row = F.struct(*(c.alias(name) for name, c in columns.items()))
    return df.select("*", F.inline(F.array(row)))


def stacked(rows: list[str], names: list[str]) -> Column:
    """A generator of one row per SQL row expression."""
    return F.expr(f"stack({len(rows)}, {', '.join(rows)})").alias(*names)


def dictionary(terms: Iterable[str]) -> list[str]:
    """Distinct lower-case terms in sorted order."""
    return sorted({t.lower() for t in terms})


def _guarded(terms: Iterable[str]) -> dict[str, dict[str, list[str]]]:
    """Terms by a mark they need (``_``, ``-`` or none) and by their first letters.

    Half of the terms need an underscore and most others a hyphen, and many
    share their first letters. Searching for those first is exact and leaves
    few terms to be searched for in an ordinary text.
    """
    tree: dict[str, dict[str, list[str]]] = {}
    for term in dictionary(terms):
        mark = next((m for m in "_-" if m in term), "")
        tree.setdefault(mark, {}).setdefault(term[:3], []).append(term)
    return tree


def _has(column: str, part: str) -> str:
    return f"contains({column}, {sql_literal(part)})"


def any_in_lowered(column: str, terms: Iterable[str]) -> Column:
    """`has_keyword` for a named column that is already lower case."""
    branches = ["false"]
    for mark, by_prefix in _guarded(terms).items():
        tests = []
        for prefix, group in by_prefix.items():
            found = " OR ".join(_has(column, t) for t in group)
            tests.append(f"({_has(column, prefix)} AND ({found}))" if len(group) > 1 else found)
        found = " OR ".join(tests)
        branches.append(f"({_has(column, mark)} AND ({found}))" if mark else found)
    return F.expr(" OR ".join(branches))


def hits_in_lowered(column: str, terms: Iterable[str]) -> Column:
    """`keyword_hits` for a named column that is already lower case.

    A plain chain of ``contains`` tests stays inside generated code, which a
    higher-order ``filter`` over the dictionary does not. It is given as SQL
    text because hundreds of terms would be thousands of calls to the JVM.
    """

    def when(part: str, then: str) -> str:
        return f"CASE WHEN {_has(column, part)} THEN {then} END" if part else then

    def joined(parts: list[str]) -> str:
        return f"concat_ws('', {', '.join(parts)})"

    branches = ["''"]
    for mark, by_prefix in _guarded(terms).items():
        parts = []
        for prefix, group in by_prefix.items():
            found = [when(t, sql_literal(t + "\n")) for t in group]
            parts += found if len(group) == 1 else [when(prefix, joined(found))]
        branches.append(when(mark, joined(parts)))
    return F.expr(f"sort_array(array_remove(split({joined(branches)}, '\n'), ''))")


def _lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def with_lowered(df: DataFrame, text: str, lowered: str = "_lowered") -> DataFrame:
    """Add the lower-case text, computed once however many terms look at it."""
    return compute_once(df, **{lowered: _lowered(F.col(text))})


def _term_array(terms: Iterable[str]) -> Column:
    return F.split(F.lit("\n".join(dictionary(terms))), "\n")


def keyword_hits(text: Column, terms: Iterable[str]) -> Column:
    """Every distinct term that occurs in the text, ignoring case, sorted.

    Terms may overlap: ``sexual-assault`` in a text also yields ``assault``.
    For whole corpora use `with_lowered` and `hits_in_lowered`, which are faster.
    """
    known = _term_array(terms)
    return let(_lowered(text), lambda low: F.filter(known, lambda t: F.contains(low, t)))


def has_keyword(text: Column, terms: Iterable[str]) -> Column:
    """True if any term occurs; stops at the first one found."""
    known = _term_array(terms)
    return let(_lowered(text), lambda low: F.exists(known, lambda t: F.contains(low, t)))


def has_date(text: Column) -> Column:
    """True if one of the date forms occurs anywhere; the calendar is not checked.

    All forms end in, or start with, four digits, so a plain search for those
    comes first and spares most texts the three slower patterns.
    """
    found = text.rlike(DATE_PATTERNS[0])
    for pattern in DATE_PATTERNS[1:]:
        found = found | text.rlike(pattern)
    return F.coalesce(text.rlike(r"\p{Nd}{4}") & found, F.lit(False))


def min_chars(text: Column, limit: int = MIN_CHARS) -> Column:
    """True if the stripped text is longer than ``limit`` characters."""
    return F.length(strip(text)) > limit
