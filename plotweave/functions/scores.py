"""Score expressions: logistic, percent texts, distance to similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotweave import settings as S


def quantise(score: Column) -> Column:
    return F.round(score.cast("double"), S.SCORE_PLACES)


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def percent_text(fraction: Column) -> Column:
    """``0.97249`` as ``97.2%``; halves go to the even digit, in binary floating point."""
    return F.concat((F.rint(fraction * 100 * 10) / 10).cast("string"), F.lit("%"))


def percent_value(text: Column) -> Column:
    """``97.2%`` as ``0.972``; empty or missing text is 0."""
    number = F.regexp_replace(text, "^%+|%+$", "").try_cast("double")
    return F.coalesce(number / 100, F.lit(0.0))


def similarity_from_distance(distance: Column) -> Column:
    """Cosine distance clipped to [0, 2], turned round. Below 0 past a distance of 1."""
    return F.lit(1.0) - F.least(F.greatest(distance, F.lit(0.0)), F.lit(2.0))
