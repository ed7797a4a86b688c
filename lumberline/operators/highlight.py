"""Highlight ranges and snippets of found keywords, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumberline.plans.search_query import SearchTerm, quote, spans, term_pattern

LONG, CONTEXT, GAP = 1000, 50, 10
_SPANS = "array<struct<start:int,end:int>>"


def overlapping(literal: str, content: Column, case_sensitive: bool = False) -> Column:
    """All occurrences of a literal, overlapping ones too: an empty match ahead of each."""
    flag = "" if case_sensitive else "(?i)"
    before = F.split(content, f"(?={flag}{quote(literal)})" if case_sensitive else f"(?i)(?={quote(literal)})", -1)
    # A piece that begins with the literal starts where the pieces ahead of it end.
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))
    hit = (lambda p: F.startswith(p, F.lit(literal))) if case_sensitive else (lambda p: p.rlike(f"(?i)^{quote(literal)}"))
    n = len(literal)

    def step(acc, p):
        is_hit = hit(F.concat(p, F.substring(content, acc["at"] + F.length(p) + 1, F.lit(n))))
        one = F.array(F.struct(acc["at"].alias("start"), (acc["at"] + n).alias("end")))
        return F.struct((acc["at"] + F.length(p)).alias("at"), F.when(is_hit, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(before, zero, step, lambda a: a["out"])


def highlight_ranges(terms: list[SearchTerm], content: Column, most: int | None = None) -> Column:
    """Ranges to mark: by start, the longer first, none that overlaps one taken before; the first ``most`` if asked."""
    every = F.concat(*[spans(term_pattern(t), content) for t in terms])
    ordered = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"))))
    zero = F.struct(F.lit(-1).alias("end"), F.array().cast(_SPANS).alias("out"))

    def step(acc, s):
        end = -s["back"]
        taken = F.struct(end.alias("end"), F.concat(acc["out"], F.array(F.struct(s["start"].alias("start"), end.alias("end")))).alias("out"))
        return F.when(s["start"] < acc["end"], acc).otherwise(taken)

    out = F.aggregate(ordered, zero, step, lambda a: a["out"])
    return out if most is None else F.slice(out, 1, most)


def snippets(ranges: Column, content: Column, context: int = CONTEXT) -> Column:
    """Texts around the ranges; parts less than ``GAP`` apart are one; a short text is its own snippet."""
    zero = F.array().cast(_SPANS)

    def step(acc, r):
        a, b = F.greatest(F.lit(0), r["start"] - context), F.least(F.length(content), r["end"] + context)
        last = F.try_element_at(acc, F.lit(-1))
        merged = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], b).alias("end"))))
        return F.when((F.size(acc) > 0) & (a <= last["end"] + GAP), merged).otherwise(F.concat(acc, F.array(F.struct(a.alias("start"), b.alias("end")))))

    cut = F.transform(F.aggregate(ranges, zero, step), lambda s: content.substr(s["start"] + 1, s["end"] - s["start"]))
    return F.when(F.length(content) > LONG, cut).otherwise(F.array(content))
