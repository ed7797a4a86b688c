"""Search queries: model, parsing, validation, building and their compilation to Column expressions."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

META = set("()[]{}+*?|^\\")
COLOURS = ("blue", "green", "orange", "red", "purple")
MAX_TERM, MAX_QUERY_BYTES, LONG_VALUE = 100, 1000, 500


class QueryError(ValueError):
    """A query, term or filter that can't be run."""


@dataclass(frozen=True)
class SearchTerm:
    value: str
    id: str = "term_0"
    operator: str = "OR"
    source: str = "user"
    preset_group_id: str | None = None
    is_regex: bool = False
    priority: int = 1
    enabled: bool = True
    case_sensitive: bool = False


@dataclass(frozen=True)
class SearchQuery:
    terms: tuple[SearchTerm, ...]
    global_operator: str = "OR"
    id: str = ""
    filters: dict | None = None
    metadata: dict = field(default_factory=dict)


def split_by_pipe(query: str) -> list[str]:
    """Terms at top-level pipes: brackets protect, ``\\|`` is a pipe in a term, blanks are trimmed, empties dropped."""
    pieces, now, depth, i = [], [], 0, 0
    while i < len(query):
        c = query[i]
        if c == "\\" and i + 1 < len(query):
            now.append("|" if query[i + 1] == "|" else query[i : i + 2])
            i += 2
            continue
        depth += (c in "([{") - (c in ")]}" and depth > 0)
        if c == "|" and not depth:
            pieces.append("".join(now))
            now = []
        else:
            now.append(c)
        i += 1
    pieces.append("".join(now))
    return [p for p in map(str.strip, pieces) if p]


def looks_regex(text: str) -> bool:
    return any(c in META for c in text.strip())


def has_backreference(pattern: str) -> bool:
    return re.search(r"(?<!\\)(?:\\\\)*\\(?:[1-9]|k[<'])", pattern) is not None or "(?P=" in pattern


def backtracks(pattern: str) -> str | None:
    """Why a pattern may take exponential time in a backtracking engine, or None.

    Java's engine backtracks, so this guards every expression here, not only those with look-around.
    """
    opens: list[int] = []
    for i, c in enumerate(pattern):
        if i and pattern[i - 1] == "\\":
            continue
        if c == "(":
            opens.append(i)
        elif c == ")" and opens:
            start = opens.pop()
            if pattern[i + 1 : i + 2] in ("+", "*", "{") and re.search(r"[+*]", pattern[start + 1 : i]):
                return "nested quantifiers"
    if re.search(r"\([^()]*\|[^()]*\)[+*]", pattern):
        return "alternation under a quantifier"
    return None


def validate_term(term: SearchTerm) -> None:
    if not term.value:
        raise QueryError(f"Term {term.id} has empty value")
    if len(term.value) > MAX_TERM:
        raise QueryError(f"Term {term.id} value is too long")
    if term.is_regex:
        if has_backreference(term.value):
            raise QueryError(f"Term {term.id}: backreferences are not supported")
        if why := backtracks(term.value):
            raise QueryError(f"Term {term.id}: {why}")
        try:
            re.compile(term.value)
        except re.error as e:
            raise QueryError(f"Term {term.id} has invalid regex: {e}") from e


def validate(query: SearchQuery) -> None:
    if not query.terms:
        raise QueryError("Query is empty")
    live = [t for t in query.terms if t.enabled]
    if not live:
        raise QueryError("No enabled terms")
    for t in live:
        validate_term(t)


def validate_text(query: str) -> None:
    if not query.strip():
        raise QueryError("Query is empty")
    if len(query.encode()) > MAX_QUERY_BYTES:
        raise QueryError("Query is too long")


def structured(query: str, case_sensitive: bool = False, regex_enabled: bool = True) -> SearchQuery:
    """A text query as terms joined by OR, all of priority 1."""
    terms = split_by_pipe(query)
    return SearchQuery(tuple(SearchTerm(v, f"term_{i}", is_regex=regex_enabled and looks_regex(v), case_sensitive=case_sensitive) for i, v in enumerate(terms)), id=str(uuid.uuid4()))


def resolve(query: str | None, given: SearchQuery | None = None, **options: bool) -> SearchQuery:
    """The structured query if there is one, else the text's."""
    if given is not None:
        return replace(given, id=given.id or str(uuid.uuid4()))
    validate_text(query or "")
    out = structured(query or "", **options)
    if not out.terms:
        raise QueryError("Query is empty")
    return out


def from_text(query: str, groups: list[dict] | None = None, case_sensitive: bool = False, regex_enabled: bool = True) -> SearchQuery:
    """As a client parses it: earlier terms have higher priority, values of a keyword group are its presets."""
    owner = {p["regex"]: g["id"] for g in reversed(groups or []) for p in g.get("patterns", [])}
    values = split_by_pipe(query)
    return SearchQuery(tuple(
        SearchTerm(v, f"term_{i}", source="preset" if v in owner else "user", preset_group_id=owner.get(v), is_regex=regex_enabled and looks_regex(v), priority=len(values) - i, case_sensitive=case_sensitive)
        for i, v in enumerate(values)
    ))


def issues(query: SearchQuery) -> list[dict]:
    """What is wrong with a query, as ``severity, code, term_id``; only errors make it invalid."""
    if not query.terms:
        return [{"severity": "error", "code": "EMPTY_QUERY", "term_id": None}]
    out = [] if any(t.enabled for t in query.terms) else [{"severity": "error", "code": "NO_ENABLED_TERMS", "term_id": None}]
    for t in query.terms:
        bad = [("error", "EMPTY_VALUE")] if not t.value.strip() else []
        bad += [("warning", "VALUE_TOO_LONG")] if len(t.value) > LONG_VALUE else []
        if t.is_regex:
            try:
                re.compile(t.value)
            except re.error:
                bad.append(("error", "INVALID_REGEX"))
        out += [{"severity": s, "code": c, "term_id": t.id} for s, c in bad]
    seen: set[tuple[str, str]] = set()
    for t in query.terms:
        k = (t.value.lower(), t.source)
        if k in seen:
            out.append({"severity": "warning", "code": "DUPLICATE_TERM", "term_id": t.id})
        seen.add(k)
    return out


def keyword_group_issues(group: dict) -> list[str]:
    patterns = [p["regex"].strip() for p in group.get("patterns", []) if p.get("regex", "").strip()]
    out = [] if 2 <= len(group.get("name", "")) <= 50 else ["name"]
    out += [] if group.get("color") in COLOURS else ["color"]
    out += [] if patterns else ["patterns"]
    out += ["duplicates"] if len(set(patterns)) < len(patterns) else []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            out.append("regex")
            break
    return out


class QueryBuilder:
    """Builds a query step by step; every step returns the builder."""

    def __init__(self, query: SearchQuery | None = None) -> None:
        self.query = query or SearchQuery(())

    @classmethod
    def from_string(cls, text: str, **options) -> QueryBuilder:
        return cls(from_text(text, **options))

    @classmethod
    def import_json(cls, text: str) -> QueryBuilder:
        d = json.loads(text)
        if not isinstance(d, dict) or not isinstance(d.get("terms"), list):
            raise QueryError("not a stored query")
        return cls(SearchQuery(tuple(SearchTerm(**t) for t in d["terms"]), d.get("global_operator", "OR"), d.get("id", ""), d.get("filters"), d.get("metadata") or {}))

    def _set(self, terms) -> QueryBuilder:
        self.query = replace(self.query, terms=tuple(terms))
        return self

    def add(self, value: str, **options) -> QueryBuilder:
        t = SearchTerm(value, f"term_{len(self.query.terms)}", **({"is_regex": looks_regex(value)} | options))
        return self._set((*self.query.terms, t))

    def remove(self, term_id: str) -> QueryBuilder:
        return self._set(t for t in self.query.terms if t.id != term_id)

    def remove_value(self, value: str) -> QueryBuilder:
        return self._set(t for t in self.query.terms if t.value.lower() != value.lower())

    def toggle(self, term_id: str) -> QueryBuilder:
        return self._set(replace(t, enabled=not t.enabled) if t.id == term_id else t for t in self.query.terms)

    def toggle_rule(self, value: str, group_id: str) -> QueryBuilder:
        """Take a preset's value out if it is there, else add it."""
        if any(t.value.lower() == value.lower() for t in self.query.terms):
            return self.remove_value(value)
        return self.add(value, source="preset", preset_group_id=group_id)

    def update(self, term_id: str, **changes) -> QueryBuilder:
        return self._set(replace(t, **changes) if t.id == term_id else t for t in self.query.terms)

    def clear(self) -> QueryBuilder:
        return self._set(())

    def set_global_operator(self, operator: str) -> QueryBuilder:
        self.query = replace(self.query, global_operator=operator)
        return self

    def to_text(self) -> str:
        return "|".join(t.value for t in self.query.terms if t.enabled)

    def optimized(self) -> dict:
        by: dict[str, list[SearchTerm]] = {}
        for t in self.query.terms:
            if t.enabled:
                by.setdefault(t.operator, []).append(t)
        return {"by_operator": by, "duplicates": len(self.query.terms) - len({t.value.lower() for t in self.query.terms}), "disabled": sum(not t.enabled for t in self.query.terms)}

    def export_json(self) -> str:
        return json.dumps(asdict(self.query))


def quote(literal: str) -> str:
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def term_pattern(term: SearchTerm) -> str:
    """The expression of a term in Java's dialect: ASCII classes and folding, unless the term goes beyond ASCII."""
    if not term.is_regex:
        return quote(term.value) if term.case_sensitive else f"(?i){quote(term.value)}"
    body = term.value if term.case_sensitive or "(?i" in term.value else f"(?i:{term.value})"
    return body if term.value.isascii() else f"(?U){body}"


def term_matches(term: SearchTerm, content: Column) -> Column:
    if not term.is_regex and term.case_sensitive:
        return content.contains(F.lit(term.value))
    return content.rlike(term_pattern(term))


def cost_rank(term: SearchTerm) -> int:
    if not term.is_regex:
        return 0 if term.case_sensitive else 1
    return 3 if re.search(r"\(\?<?[=!]", term.value) else 2


def execution_order(query: SearchQuery) -> list[SearchTerm]:
    """Priority first, then the cheaper engine, the longer value, the id."""
    return sorted((t for t in query.terms if t.enabled), key=lambda t: (-t.priority, cost_rank(t), -len(t.value), t.id))


def fused_or(terms: list[SearchTerm]) -> str | None:
    """One alternation for two or more plain terms of one case flag."""
    if len(terms) < 2 or any(t.is_regex for t in terms) or len({t.case_sensitive for t in terms}) > 1:
        return None
    body = "|".join(quote(t.value) for t in sorted(terms, key=lambda t: len(t.value)))
    return body if terms[0].case_sensitive else f"(?i)(?:{body})"


def compile_query(query: SearchQuery, content: Column) -> Column:
    """Predicate of a query: the global operator over its enabled terms; NOT holds where none matches."""
    validate(query)
    terms = execution_order(query)
    if query.global_operator == "AND":
        return reduce(lambda a, b: a & b, [term_matches(t, content) for t in terms])
    one = fused_or(terms)
    any_term = content.rlike(one) if one else reduce(lambda a, b: a | b, [term_matches(t, content) for t in terms])
    return ~any_term if query.global_operator == "NOT" else any_term


def spans(pattern: str, content: Column) -> Column:
    """Array of ``start, end`` (code points) of the non-empty matches of a pattern, without leaving the JVM."""
    found = F.filter(F.regexp_extract_all(content, F.lit(f"({pattern})"), F.lit(1)), lambda m: F.length(m) > 0)
    gaps = F.slice(F.split(content, pattern, -1), F.lit(1), F.size(found))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("m"))), zero, step, lambda acc: acc["out"])


def _detail(head: list[Column]):
    return lambda p: F.struct(*head, p.alias("match_position"))


def match_details(query: SearchQuery, content: Column) -> Column:
    """All matches of all terms, by priority: array of ``term_id, term_value, priority, match_position``; null if none."""
    parts = []
    for t in execution_order(query):
        head = [F.lit(t.id).alias("term_id"), F.lit(t.value).alias("term_value"), F.lit(t.priority).alias("priority")]
        parts.append(F.transform(spans(term_pattern(t), content), _detail(head)))
    all_of = F.concat(*parts)
    return F.when(F.size(all_of) > 0, all_of)


def matched_keywords(details: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(details, lambda d: d["term_value"])))
