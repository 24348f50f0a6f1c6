"""Scoring columns of the curation stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.binding import let
from paperloom.functions.lexicon import TOPIC_KEYWORDS
from paperloom.functions.text import string_array
from paperloom.settings import DEFAULTS

_S = DEFAULTS.score
MISSING_DATE_MONTHS = 12.0


def age_months(published: Column, reference: Column) -> Column:
    return F.datediff(reference, published) / F.lit(30.0)


def citation_score(citations: Column, months: Column) -> Column:
    """Log-damped citations per month; an age that is not positive counts as one month."""
    return F.log1p(citations / F.when(months <= 0, F.lit(1.0)).otherwise(months))


def recency(published: Column, reference: Column) -> Column:
    """Exponential decay with age; 0.5 where the date is missing."""
    return F.coalesce(F.exp(-age_months(published, reference) / F.lit(_S.recency_tau_months)), F.lit(0.5))


def semantic(similarity: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(similarity, F.lit(0.5))))


def topic(text: Column) -> Column:
    """Topic with most keyword hits; ties go to the topic listed first, no hit is ``other``."""
    names = list(TOPIC_KEYWORDS)

    def hits(lowered: Column) -> Column:
        return F.array(*[F.size(F.filter(string_array(TOPIC_KEYWORDS[n]), lambda k: F.contains(lowered, k))) for n in names])

    def winner(votes: Column) -> Column:
        first = F.get(string_array(names), (F.array_position(votes, F.array_max(votes)) - 1).cast("int"))
        return F.when(F.array_max(votes) > 0, first).otherwise(F.lit("other"))

    return let(let(F.lower(text), hits), winner)


def under_represented_bonus(share: Column, target: Column) -> Column:
    """1 for well represented groups, more the further a group lies below its target share."""
    return F.when(share < target, F.lit(1.0) + (target - share) * 2).otherwise(F.lit(1.0))


def final_score(citation: Column, fresh: Column, meaning: Column, bonus: Column) -> Column:
    """Weighted sum; only the part of the bonus above 1 counts, at half weight."""
    capped = F.least(F.lit(1.0), citation / F.lit(5.0))
    return (
        _S.citation_weight * capped
        + _S.recency_weight * fresh
        + _S.semantic_weight * meaning
        + _S.stratified_weight * (bonus - 1.0) * 0.5
    )
