"""Scores of the reputation domain as column expressions.

Times are arguments (`as_of`), never the clock. Rounding is half_up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import clamped, days_between, half_up

# Weights and steps that results must share with the domain's definition.
BASELINE = 100.0
MAX_DELTA = 50.0
CATEGORY_WEIGHTS = {
    "RESEARCH_QUALITY": 0.3,
    "METHODOLOGY_RIGOR": 0.25,
    "COLLABORATION_ETHICS": 0.15,
    "CITATION_INTEGRITY": 0.15,
    "PEER_RECOGNITION": 0.1,
    "COMMUNITY_FEEDBACK": 0.05,
}
LEVEL_EXP = (0, 100, 300, 600, 1000)
LEVEL_NAMES = ("Observer", "Supervisor", "Guardian", "Arbiter", "Transparency Envoy")
STREAK_BONUS = ((30, 200), (7, 50), (3, 20))
LEVEL_BONUS = {"国际级": 3, "国家级": 2, "省部级": 1}
TASK_EXP = 10
DECAY = ((6, 1.0), (12, 0.85), (24, 0.7), (36, 0.5))
LOOKBACK_DAYS = 30


def steps(x: Column, pairs: tuple, otherwise) -> Column:
    """Value of the first pair whose bound is at least x."""
    out = F
    for bound, value in pairs:
        out = out.when(x <= bound, value)
    return out.otherwise(otherwise)


def category_weight(category: Column) -> Column:
    out = F
    for name, weight in CATEGORY_WEIGHTS.items():
        out = out.when(category == name, weight)
    return out.otherwise(0.0)


def clamp_delta(delta: Column) -> Column:
    return clamped(delta, -MAX_DELTA, MAX_DELTA)


def time_decay(months: Column) -> Column:
    return steps(months, DECAY, 0.3)


def recency(happened: Column, as_of: Column, lookback: int = LOOKBACK_DAYS) -> Column:
    """1 now, 0 from `lookback` days ago; unknown times count as that long ago."""
    days = F.coalesce(F.greatest(F.lit(0.0), days_between(happened, as_of)), F.lit(float(lookback)))
    return F.greatest(F.lit(0.0), 1 - days / lookback)


def stain_heat(reports: Column, severity: Column, created: Column, as_of: Column, approved: Column) -> Column:
    """Reports of the person (up to 4), severity (up to 3; unknown and 0 count 1), recency (up to 2), approval (1)."""
    known = F.when(F.coalesce(severity, F.lit(0)) == 0, 1).otherwise(severity)
    return half_up(F.least(F.lit(1.0), reports / 10) * 4 + known / 5 * 3 + recency(created, as_of) * 2 + approved.cast("int"), 2)


def score_bonus(score: Column) -> Column:
    return clamped((score - 90) / 20, 0.0, 3.0)


def level_bonus(level: Column) -> Column:
    out = F
    for name, bonus in LEVEL_BONUS.items():
        out = out.when(level == name, bonus)
    return out.otherwise(0)


def update_heat(kind: Column, published: Column, as_of: Column, score: Column, level: Column) -> Column:
    """Heat of a competition, evaluation or research update."""
    extra = F.when(kind == "competition", level_bonus(level) * 1.0).when(kind == "evaluation", 1.0).otherwise(0.5)
    return half_up(recency(published, as_of) * 5 + score_bonus(score) + extra, 2)


def stain_score(reports: Column, severity: Column, days_ago: Column, drop: Column) -> Column:
    """Combined stain score in 0..1 of report count (log scale to 10), severity, recency and score drop."""
    count = F.least(F.lit(1.0), F.log2(reports + 1.0) / F.log2(F.lit(11.0)))
    fresh = F.greatest(F.lit(0.0), 1 - days_ago / LOOKBACK_DAYS)
    return 0.35 * count + 0.25 * severity / 5 + 0.20 * fresh + 0.20 * F.least(F.lit(1.0), F.abs(drop) / 50)


def recency_weight(days: Column) -> Column:
    return steps(days, ((1, 1.0), (3, 0.8), (7, 0.6), (14, 0.4), (30, 0.2)), 0.1)


def level_of(exp: Column) -> Column:
    out = F
    for level in range(len(LEVEL_EXP), 0, -1):
        out = out.when(exp >= LEVEL_EXP[level - 1], level)
    return out.otherwise(1)


def exp_of_level(level: Column) -> Column:
    """Experience that a level asks for; levels outside 1..5 count as the nearest."""
    bounded = clamped(level, 1, len(LEVEL_EXP))
    return F.element_at(F.array(*[F.lit(e) for e in LEVEL_EXP]), bounded.cast("int"))


def level_progress(exp: Column) -> Column:
    """Percent of the way to the next level; 100 at the last."""
    level = level_of(exp)
    low, high = exp_of_level(level), exp_of_level(level + 1)
    return F.when(level == len(LEVEL_EXP), 100).otherwise(F.least(F.lit(100), half_up(F.try_divide((exp - low) * 100.0, high - low)).cast("int")))


def exp_to_next(level: Column, exp: Column) -> Column:
    here, ahead = exp_of_level(level), exp_of_level(level + 1)
    return F.when(ahead <= here, 0).otherwise(F.greatest(F.lit(0), ahead - exp))


def accuracy(approved: Column, rejected: Column) -> Column:
    return F.coalesce(half_up(F.try_divide(approved * 1.0, approved + rejected), 2), F.lit(0.0))


def task_exp(kind: Column) -> Column:
    return F.when(kind == "REVIEW", 2 * TASK_EXP).when(kind == "VERIFY", 3 * TASK_EXP).otherwise(TASK_EXP)


def streak_bonus(days: Column) -> Column:
    out = F
    for least, bonus in STREAK_BONUS:
        out = out.when(days >= least, bonus)
    return out.otherwise(0)


def score_grade(score: Column) -> Column:
    return F.when(score > 110, "excellent").when(score >= 100, "good").when(score >= 85, "fair").when(score >= 70, "poor").otherwise("critical")


def relevance(doi: Column, journal: Column, n_authors: Column, linked: Column, published: Column, as_of: Column, n_categories: Column, comment: Column) -> Column:
    """Relevance of a paper in 0..100."""
    told = lambda c: F.coalesce(c, F.lit("")) != ""
    days = F.floor(days_between(published, as_of))
    points = (
        F.lit(50)
        + F.when(told(doi), 10).otherwise(0)
        + F.when(told(journal), 10).otherwise(0)
        + F.when(n_authors >= 3, 5).otherwise(0)
        + F.when(n_authors >= 10, 5).otherwise(0)
        + F.when(linked, 15).otherwise(0)
        + F.when(days <= 7, 10).when(days <= 30, 5).otherwise(0)
        + F.when(n_categories >= 2, 3).otherwise(0)
        + F.when(F.contains(F.lower(F.coalesce(comment, F.lit(""))), F.lit("accepted")), 7).otherwise(0)
    )
    return F.least(points, F.lit(100))


#: What a known attribute adds to a merged record's confidence.
COMPLETENESS_BONUS = {"publications": 0.08, "email": 0.05, "h_index": 0.04, "citation_count": 0.03, "bio": 0.03, "institution": 0.03, "department": 0.02, "orcid_id": 0.02}


def confidence(n_sources: Column, known: dict[str, Column]) -> Column:
    """Confidence of a record merged from several sources; one source alone is taken as it is (1)."""
    base = F.when(n_sources >= 3, 0.7).when(n_sources >= 2, 0.6).otherwise(0.4)
    bonus = sum((F.when(known[k], b).otherwise(0.0) for k, b in COMPLETENESS_BONUS.items() if k in known), F.lit(0.0))
    return F.when(n_sources == 1, 1.0).otherwise(half_up(F.least(F.lit(1.0), base + bonus), 2))


def backoff_days(failures: Column, first: int = 14) -> Column:
    return first * F.pow(F.lit(2.0), failures - 1)


def completeness(h_index: Column, email: Column, bio: Column, department: Column, n_pubs: Column, n_updates: Column, n_fields: Column) -> Column:
    """How much of a record is filled; decides which of several duplicates stays."""
    flag = lambda c, points: F.when(F.coalesce(c, F.lit(False)), points).otherwise(0)
    told = lambda c: F.coalesce(c, F.lit("")) != ""
    return flag(F.coalesce(h_index, F.lit(0)) != 0, 3) + flag(told(email), 2) + flag(told(bio), 2) + flag(told(department), 1) + flag(n_pubs > 0, 2) + flag(n_updates > 0, 1) + flag(n_fields > 0, 1)
