"""Votes of two or three raters, as plain (code-generated) expressions.

A vote is used several times in each expression. Pass plain columns: a long
expression as a vote would be repeated.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.labels import folded, norm_race_counts, race_class_oe


def _shared(votes: tuple[Column, ...]) -> Column:
    """The vote that two raters share; among three there can be only one."""
    if not 2 <= len(votes) <= 3:
        raise ValueError("votes are taken between two or three raters")
    return F.coalesce(*(F.when(a == b, a) for a, b in combinations(votes, 2)))


def majority_strict(*votes: Column) -> Column:
    """Most frequent vote, but only if at least two raters cast it."""
    return _shared(votes)


def majority_unique(*votes: Column) -> Column:
    """Most frequent vote if no other ties with it; one lone vote wins."""
    cast = sum((vote.isNotNull().cast("int") for vote in votes), F.lit(0))
    return F.coalesce(_shared(votes), F.when(cast == 1, F.coalesce(*votes)))


def race_vote_raw(value: Column) -> Column:
    """A raw race answer as it enters `vote_then_norm`."""
    low = folded(value)
    return F.when(~low.isin("", "not_provided"), low)


def vote_then_norm(*answers: Column) -> Column:
    """Vote on the raw answers, then reduce the winner to three races.

    ``unknown`` can win the vote and then counts as no answer.
    """
    return race_class_oe(majority_unique(*map(race_vote_raw, answers)))


def norm_then_vote(*answers: Column) -> Column:
    """Reduce each answer to three races, then vote."""
    return majority_unique(*map(norm_race_counts, answers))


def all_agree(*votes: Column) -> Column:
    """True if the raters who answered gave one and the same answer."""
    first = F.coalesce(*votes)
    return reduce(and_, [F.coalesce(vote == first, F.lit(True)) for vote in votes])
