"""Predicates that accept or reject a match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Least score and share of a good match; seconds below which a clip is short and the hits it needs;
#: hits a second and least hits of others; seconds that a query may be longer than its reference.
MIN_SCORE, MIN_SHARE, SHORT, SHORT_HITS, HITS_A_SECOND, LEAST_HITS, SLACK = 20, 0.5, 15, 8, 0.15, 20, 5.0


def quality(score: Column, share: Column, min_score: float = MIN_SCORE, min_share: float = MIN_SHARE) -> Column:
    return (score >= min_score) & (share >= min_share)


def hits_needed(duration: Column) -> Column:
    """8 below 15 seconds, else 0.15 a second, 20 at least."""
    return F.when(duration < SHORT, SHORT_HITS).otherwise(F.greatest(F.floor(duration * HITS_A_SECOND).cast("int"), F.lit(LEAST_HITS)))


def density(score: Column, duration: Column) -> Column:
    return score >= hits_needed(duration)


def duration(query: Column, reference: Column, slack: float = SLACK) -> Column:
    """A query isn't longer than its reference; an unknown reference passes."""
    return reference.isNull() | (reference <= 0) | (query <= reference + slack)


def effective_gap(gap: float, duration: Column) -> Column:
    """At most half the reference's duration, where that is known."""
    return F.when(duration > 0, F.least(F.lit(gap), duration / 2)).otherwise(F.lit(gap))
