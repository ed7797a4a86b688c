"""Token search: tokenizing, multi-keyword search, selectivity, cost, BM25 ranking and snippets."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumberline.functions.logfields import html_escape

MAX_TOKEN, K1, B = 40, 1.2, 0.75


def tokenize(text: Column) -> Column:
    """Words of letters and digits in lower case, without those of more than 40 characters."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda t: (t != "") & (F.length(t) <= MAX_TOKEN))


def stem(word: Column) -> Column:
    """A light English stem: plural and -ing, -ed endings."""
    w = F.regexp_replace(word, "(?<=[a-z]{3})(ies)$", "y")
    return F.regexp_replace(w, "(?<=[a-z]{3})(ing|ed|es|s)$", "")


def keywords(query: str) -> list[str]:
    """Blank-separated keywords; a quoted phrase is one of them."""
    return [k for k in (a.strip() or b for a, b in re.findall(r'"([^"]*)"?|([^\s"]+)', query)) if k]


def parse_boolean(query: str) -> list[tuple[str, str]]:
    """``(occur, word)`` of a query with ``+must``, ``-not``, AND, OR and NOT; bare words should occur."""
    out, occur = [], "should"
    for k in re.findall(r'[+-]?"[^"]*"|\S+', query):
        if k in ("AND", "OR", "NOT"):
            if k == "AND" and out:
                out[-1] = ("must" if out[-1][0] == "should" else out[-1][0], out[-1][1])
            occur = {"AND": "must", "OR": "should", "NOT": "must_not"}[k]
            continue
        sign, word = (k[0], k[1:]) if k[0] in "+-" and len(k) > 1 else ("", k)
        out.append(({"+": "must", "-": "must_not"}.get(sign, occur), word.strip('"').lower()))
        occur = "should"
    return out


def boolean_predicate(query: str, tokens: Column) -> Column:
    """All musts, no must-not, and a should if there is no must."""
    parts = parse_boolean(query)
    has = lambda w: reduce(lambda a, b: a & b, [F.array_contains(tokens, x) for x in w.split() or [""]])
    must, should, never = ([has(w) for o, w in parts if o == k] for k in ("must", "should", "must_not"))
    out = reduce(lambda a, b: a & b, must) if must else reduce(lambda a, b: a | b, should) if should else F.lit(True)
    return reduce(lambda a, b: a & ~b, never, out)


def multi_keyword(tokens: Column, words: list[str], require_all: bool) -> Column:
    each = [F.array_contains(tokens, w.lower()) for w in words]
    return reduce((lambda a, b: a & b) if require_all else (lambda a, b: a | b), each)


def selectivity(lines: DataFrame, words: list[str]) -> DataFrame:
    """``term, selectivity``: the share of lines with each word, all in one pass."""
    t = tokenize(F.col("content"))
    d = lines.select(F.explode(F.array(*[F.struct(F.lit(w).alias("term"), F.array_contains(t, w.lower()).alias("hit")) for w in words])).alias("x"))
    return d.groupBy("x.term").agg(F.avg(F.col("x.hit").cast("int")).alias("selectivity"))


def query_cost(terms: list[tuple[str, float]]) -> float:
    """Estimated cost of ``(occur, selectivity)`` terms; ``occur`` is must, should or must_not."""
    weight = {"must": 1.5, "should": 1.0, "must_not": 0.5}
    total = sum(100.0 + weight[o] / min(max(s, 0.001), 1.0) for o, s in terms)
    n_must, n_should = (sum(o == k for o, _ in terms) for k in ("must", "should"))
    return total * (1 + 0.3 * max(0, n_must - 1)) * (1 + 0.1 * max(0, n_should - 5))


def _frequency(tokens: Column, word: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == word))


def bm25(docs: DataFrame, key: str, words: list[str]) -> DataFrame:
    """``key, score`` of the documents with any of the words.

    One pass gives the corpus figures (a row), one the scores; nothing but that row is broadcast.
    """
    t = tokenize(F.col("content"))
    d = docs.select(key, F.size(t).alias("n"), *[_frequency(t, w.lower()).alias(f"tf{i}") for i, w in enumerate(words)])
    stats = d.agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg"), *[F.sum((F.col(f"tf{i}") > 0).cast("bigint")).alias(f"df{i}") for i in range(len(words))])
    d = d.where(reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in range(len(words))])).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.col("avg")))
    return d.select(key, F.round(score, 6).alias("score"))


def top_k(scored: DataFrame, key: str, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), key).limit(k)


def snippet(content: Column, word: str, size: int = 500, context: int = 100) -> Column:
    """The part of a text around the first occurrence of a word, escaped, with the word marked."""
    at = F.instr(F.lower(content), word.lower())
    part = F.when(F.length(content) <= size, content).otherwise(content.substr(F.greatest(F.lit(1), at - context), F.lit(size)))
    return F.when(at > 0, F.regexp_replace(html_escape(part), f"(?i)({re.escape(word)})", "<b>$1</b>"))
