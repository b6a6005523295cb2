"""Checks of requests: which fields of a row break the rules of its kind. Lengths are in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .reports import CATEGORY_LABELS, edu_domain, valid_email

Check = Callable[[Column], Column]


def written(least: int = 0, most: int | None = None, *patterns: str) -> Check:
    """Text of a length in which every pattern is found."""

    def ok(c: Column) -> Column:
        good = F.length(c) >= least
        for p in patterns:
            good = good & F.regexp_like(c, F.lit(p))
        return good if most is None else good & (F.length(c) <= most)

    return ok


def number(least: float | None = None, most: float | None = None, whole: bool = False) -> Check:
    """A number, or text that is one (empty text is 0), in a range."""

    def ok(c: Column) -> Column:
        n = F.when(F.trim(c.cast("string")) == "", 0.0).otherwise(c.try_cast("double"))
        good = n.isNotNull()
        for bound, holds in ((least, lambda b: n >= b), (most, lambda b: n <= b)):
            good = good if bound is None else good & holds(bound)
        return good & (n == F.floor(n)) if whole else good

    return ok


def one_of(*values: str) -> Check:
    return lambda c: c.isin(*values)


def several(least: int, most: int | None = None) -> Check:
    """An array of so many elements."""
    return lambda c: F.size(c) >= least if most is None else F.size(c).between(least, most)


def within(least: float, most: float) -> Check:
    """A map of which every value lies in the range."""
    return lambda c: F.forall(F.map_values(c), lambda v: v.between(least, most))


def url(c: Column) -> Column:
    """A scheme and something behind it."""
    return F.regexp_like(c, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:\S+\z"))


def edu_address(c: Column) -> Column:
    return valid_email(c) & edu_domain(c)


PAGE = {"page": (False, number(1, None, True)), "limit": (False, number(1, 100, True))}
_PERSON = {
    "name_zh": (True, written(1, 100)), "name_en": (False, written(0, 200)), "title": (False, written(0, 200)), "institution": (False, written(0, 300)),
    "department": (False, written(0, 300)), "email": (False, valid_email), "website": (False, url), "field_ids": (True, several(1)),
}
# The rules of each kind of request, as (required, check) by field. Other fields are free.
RULES: dict[str, dict[str, tuple[bool, Check]]] = {
    "register": {"name": (True, written(1, 100)), "email": (True, valid_email), "password": (True, written(8, None, "[A-Za-z]", "[0-9]"))},
    "sign_in": {"email": (True, valid_email), "password": (True, written(1))},
    "edu_email": {"edu_email": (True, edu_address)},
    "edu_token": {"token": (True, written(1))},
    "create_person": _PERSON,
    "update_person": {name: (False, ok) for name, (_, ok) in _PERSON.items()},
    "person_query": {"min_score": (False, number()), "max_score": (False, number()), "sort": (False, one_of("score_desc", "score_asc", "name_asc", "name_desc", "hIndex_desc")), **PAGE},
    "create_report": {
        "person_id": (True, written(1)), "category": (True, one_of(*CATEGORY_LABELS)), "title": (True, written(5, 200)), "description": (True, written(50, 10_000)),
        "severity": (False, number(1, 5, True)), "evidence_ids": (True, several(1, 5)),
    },
    "report_query": {"status": (False, one_of("PENDING", "UNDER_REVIEW", "APPROVED", "REJECTED", "APPEALED")), "category": (False, one_of(*CATEGORY_LABELS)), **PAGE},
    "review_report": {"action": (True, one_of("APPROVE", "REJECT", "NEED_MORE_INFO")), "notes": (False, written(0, 2000)), "score_delta": (False, within(-50, 50))},
    "create_field": {"slug": (True, written(1, 100, r"^[a-z0-9-]+\z")), "name_zh": (True, written(1, 100)), "name_en": (True, written(1, 200)), "sort_order": (False, number(None, None, True))},
    "search": {"q": (True, written(1, 200)), "min_score": (False, number()), "max_score": (False, number()), "type": (False, one_of("person", "publication")), **PAGE},
    "update_user": {"role": (False, one_of("ADMIN", "COMMUNITY", "USER"))},
}


def problems(kind: str, given: dict[str, Column]) -> Column:
    """The fields, in the order of the rules, that break them; empty if none does.

    given: the columns of the fields there are. A field without a column, or null, only breaks the rules if it is required.
    """
    broken = []
    for name, (required, ok) in RULES[kind].items():
        if name in given:
            missing = F.lit(not required) & given[name].isNull()
            broken.append(F.when(~(missing | F.coalesce(ok(given[name]), F.lit(False))), F.lit(name)))
        elif required:
            broken.append(F.lit(name))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
