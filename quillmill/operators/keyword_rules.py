"""Many keyword rules at once: one automaton over all of them reads a text once, however many rules there are.

A rule's pattern is a list of alternatives of letters, classes, optional letters and single wild cards. Each alternative is
written out as the finite number of strings it stands for; the longest stretch without a wild card goes into one
Aho-Corasick automaton, and a hit is checked in place for case, wild cards and whole words. A regular expression per rule
would read every text once a rule, trying every alternative at every character; so this is an Arrow-batched Pandas UDF that
returns the numbers of the rules, and ranks are expressions on them. The rules travel with the function: their size is
checked.
"""

from __future__ import annotations

import functools
import importlib.resources
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BYTES = 1 << 22
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
_LINE_ENDS = frozenset("\n\r\u2028\u2029")


class Rule(NamedTuple):
    pattern: str
    ignore_case: bool
    field: str
    confidence: float


@functools.cache
def research_rules() -> tuple[Rule, ...]:
    """The rules of research topics and titles, in order."""
    lines = importlib.resources.files("quillmill.data").joinpath("research_rules.tsv").read_text("utf-8").splitlines()
    rows = [line.split("\t") for line in lines if line and not line.startswith("# ")]
    return tuple(Rule(p, flag == "i", field, float(confidence)) for p, flag, field, confidence in rows)


def written_out(pattern: str) -> tuple[list[tuple[str | None, ...]], bool]:
    """The strings a pattern stands for, as tuples of characters (None: any but a line end), and whether they must be whole words."""
    whole = pattern.startswith(r"\b(?:") and pattern.endswith(r")\b")
    if whole:
        pattern = pattern[5:-3]
    strings: list[tuple[str | None, ...]] = []
    now: list[tuple[str | None, ...]] = [()]
    at = 0
    while at <= len(pattern):
        c = pattern[at] if at < len(pattern) else "|"
        if c == "|":
            strings += [s for s in now if s]
            now, at = [()], at + 1
            continue
        if c == "\\":
            choice, at = [pattern[at + 1]], at + 2
            if choice[0].isalnum():
                raise ValueError(f"not a keyword pattern: {pattern}")
        elif c == "[":
            end = pattern.index("]", at)
            choice, at = list(pattern[at + 1 : end]), end + 1
            if "^" in choice or "-" in choice:
                raise ValueError(f"not a keyword pattern: {pattern}")
        elif c in "(){}*+^$?":
            raise ValueError(f"not a keyword pattern: {pattern}")
        else:
            choice, at = [None if c == "." else c], at + 1
        optional = at < len(pattern) and pattern[at] == "?"
        at += optional
        now = [s + (x,) for s in now for x in choice] + (now if optional else [])
    return strings, whole


class Matcher:
    """Finds the rules whose pattern occurs in a text."""

    def __init__(self, rules: tuple[Rule, ...]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for number, rule in enumerate(rules):
            strings, whole = written_out(rule.pattern)
            for s in set(strings):
                s = tuple(c if c is None or not rule.ignore_case else c.translate(_LOWER) for c in s)
                start, stretch = max(self._stretches(s), key=lambda x: len(x[1]))
                free = [i for i, c in enumerate(s) if c is None]
                exact = None if rule.ignore_case and not free else s
                entries.setdefault(stretch.translate(_LOWER), []).append((number, start, len(s), len(stretch), whole, rule.ignore_case, exact))
        for stretch, told in entries.items():
            self.automaton.add_word(stretch, told)
        self.automaton.make_automaton()

    @staticmethod
    def _stretches(s: tuple[str | None, ...]) -> list[tuple[int, str]]:
        found, held = [], ""
        for i, c in enumerate(s + (None,)):
            if c is None:
                if held:
                    found.append((i - len(held), held))
                held = ""
            else:
                held += c
        return found

    def hits(self, text: str | None) -> list[int]:
        """Numbers of the rules found, ascending; texts under three characters have none."""
        if not text or len(text) < 3:
            return []
        lower, found = text.translate(_LOWER), set()
        for end, told in self.automaton.iter(lower):
            for number, start, length, stretch, whole, ignore_case, exact in told:
                if number in found:
                    continue
                a = end - stretch + 1 - start
                b = a + length
                if a < 0 or b > len(text):
                    continue
                if whole and ((a and text[a - 1] in _WORD) or (b < len(text) and text[b] in _WORD)):
                    continue
                if exact is None or all(x not in _LINE_ENDS if c is None else x == c for x, c in zip((lower if ignore_case else text)[a:b], exact)):
                    found.add(number)
        return sorted(found)


@functools.lru_cache(maxsize=8)
def _matcher(rules: tuple[Rule, ...]) -> Matcher:
    return Matcher(rules)


def rule_hits(subject: Column, rules: tuple[Rule, ...] | None = None) -> Column:
    """The numbers of the rules found in a text, ascending; none for null."""
    rules = tuple(rules or research_rules())
    if sum(len(r.pattern.encode()) for r in rules) > MOST_BYTES:
        raise ValueError("the rules are too large to travel with every task")

    @F.pandas_udf("array<int>")
    def find(texts: pd.Series) -> pd.Series:
        hits = _matcher(rules).hits
        return pd.Series([hits(t) for t in texts], dtype=object)

    return find(subject)


def best_fields(hits: Column, rules: tuple[Rule, ...] | None = None, most: int = 3) -> Column:
    """The `most` best fields of the rules found: a field counts by its highest confidence; equal ones go in the order of their first rule."""
    rules = tuple(rules or research_rules())
    names, less = F.array(*[F.lit(r.field) for r in rules]), F.array(*[F.lit(-r.confidence) for r in rules])
    told = F.transform(hits, lambda h: F.struct(F.get(names, h).alias("field"), F.get(less, h).alias("less"), h.alias("rule")))

    def of_field(field: Column) -> Column:
        mine = F.filter(told, lambda t: t["field"] == field)
        return F.struct(F.array_min(F.transform(mine, lambda t: t["less"])).alias("less"), F.array_min(F.transform(mine, lambda t: t["rule"])).alias("rule"), field.alias("field"))

    ranked = F.array_sort(F.transform(F.array_distinct(F.transform(told, lambda t: t["field"])), of_field))
    return F.slice(F.transform(ranked, lambda r: r["field"]), 1, most)


# What a page's host and path say of the field, in order.
URL_RULES: list[tuple[str, str]] = [
    (r"(?:^|[./])cs\b|computer|计算机|计科|cse\b|csee\b|css?e\b", "computer-science"),
    (r"(?:^|[./])ee\b|electronic|电子|电信|信息与通信|无线电", "electronic-engineering"),
    (r"(?:^|[./])math\b|mathematics|数学|数理|统计", "mathematics"),
    (r"(?:^|[./])physics?\b|物理|phys\b", "physics"),
    (r"(?:^|[./])chem\b|化学|化工", "chemistry"),
    (r"(?:^|[./])bio\b|生物|生命|life\b", "biology"),
    (r"(?:^|[./])med\b|医学|临床|药学|hospital", "medicine"),
    (r"(?:^|[./])econom|经济|sem\b|经管|管理", "economics"),
    (r"(?:^|[./])ai\b|人工智能", "artificial-intelligence"),
    (r"(?:^|[./])soft\b|软件|ss\b", "computer-science"),
    (r"(?:^|[./])stat\b|统计", "probability"),
    (r"(?:^|[./])security\b|安全|cyber|网安", "cybersecurity"),
    (r"(?:^|[./])automation|自动化|auto\b", "computer-science"),
    (r"material|材料|mse\b", "chemistry"),
    (r"informatics|信息(?!与通信|安全)|info\b", "computer-science"),
]


def from_url(url: Column, most: int = 2) -> Column:
    """Fields that an address tells of, distinct, in rule order; none for null and empty ones."""
    lower = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(lower, r"https?://([^/]+)", 1)
    place = F.concat(host, F.lit("/"), F.regexp_replace(lower, r"https?://[^/]+", ""))
    # Java's word ends go by Unicode letters, these by ASCII.
    found = [F.when(F.regexp_like(place, F.lit(p.replace(r"\b", "(?![A-Za-z0-9_])"))), F.lit(f)) for p, f in URL_RULES]
    return F.when(lower != "", F.slice(F.array_distinct(F.array_compact(F.array(*found))), 1, most)).otherwise(F.array().cast("array<string>"))
