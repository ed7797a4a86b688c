"""A token index: postings in a table, and the searches that look up their words' postings alone.

``postings`` has a row for each token of each document (token, document, frequency, length of the document), in
``BUCKETS`` folders by a hash of the token and sorted by token within a file: a search reads the folders of its words,
and of their files the row groups that may hold them.  Frequent tokens are spread over files by an adaptive REBALANCE.
``docs`` has each document's length; ``stats`` is one row.

Defined cases: a null key is no document; a null or empty text has no tokens and length 0; repeated rows of a key count
once; searching for no word gives nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.operators.text_index import B, K1, parse_boolean, stem, tokenize

BUCKETS = 64


def stemmed(text: Column) -> Column:
    """The tokens of a text, stemmed."""
    return F.transform(tokenize(F.coalesce(text, F.lit(""))), stem)


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


class TokenIndex:
    """An index under ``path``, a folder every executor sees."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id") -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._words: dict[tuple[str, ...], list[str]] = {}

    def add(self, docs: DataFrame, text: str = "content") -> TokenIndex:
        """Write the documents that aren't in the index yet; the stems of their tokens are counted within each row."""
        d = docs.where(F.col(self.key).isNotNull()).select(self.key, F.col(text).alias("_t")).dropDuplicates([self.key])
        mode = "append"
        try:
            d = d.join(self.docs.select(self.key), self.key, "left_anti")
        except Exception:  # there is no index yet
            mode = "overwrite"
        d = d.select(self.key, stemmed(F.col("_t")).alias("_k")).withColumn("n", F.size("_k").cast("bigint"))
        p = d.select(self.key, "n", F.explode("_k").alias("token")).groupBy(self.key, "token").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
        p = p.withColumn("bucket", _bucket(F.col("token"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "token")
        p.write.mode(mode).partitionBy("bucket").parquet(f"{self.path}/postings")
        d.select(self.key, "n").write.mode(mode).parquet(f"{self.path}/docs")
        self.docs.agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg")).write.mode("overwrite").parquet(f"{self.path}/stats")
        return self

    @property
    def docs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/docs")

    @property
    def stats(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/stats")

    def stems(self, words: list[str]) -> list[str]:
        """What the words are in the index; none of those that are no token."""
        if tuple(words) not in self._words:
            row = self.spark.range(1).select(F.flatten(F.array(*[stemmed(F.lit(w)) for w in words])).alias("k")).first() if words else None
            self._words[tuple(words)] = row.k if row else []
        return self._words[tuple(words)]

    def postings(self, stems: list[str]) -> DataFrame:
        """The postings of the tokens, out of their folders alone."""
        d = self.spark.read.parquet(f"{self.path}/postings")
        if not stems:
            return d.limit(0)
        buckets = self.spark.range(1).select(F.array(*[_bucket(F.lit(s)) for s in stems]).alias("b")).first().b
        return d.where(F.col("bucket").isin(sorted(set(buckets))) & F.col("token").isin(sorted(set(stems)))).drop("bucket")

    def search(self, query: str) -> DataFrame:
        """Keys of the documents that a boolean query holds for: all musts, no must-not, and a should if there is no must."""
        parts = [(occur, self.stems([word])) for occur, word in parse_boolean(query)]
        parts = [(o, s) for o, s in parts if s]
        every = [x for _, s in parts for x in s]
        has = lambda s: reduce(lambda a, b: a & b, [F.coalesce(F.array_contains("have", x), F.lit(False)) for x in s])
        must, should, never = ([has(s) for o, s in parts if o == k] for k in ("must", "should", "must_not"))
        keep = reduce(lambda a, b: a & b, must) if must else reduce(lambda a, b: a | b, should) if should else F.lit(bool(never))
        keep = reduce(lambda a, b: a & ~b, never, keep)
        found = self.postings(every).groupBy(self.key).agg(F.collect_set("token").alias("have"))
        if not must and not should and never:
            found = self.docs.select(self.key).join(found, self.key, "left")
        return found.where(keep).select(self.key)

    def multi_keyword(self, words: list[str], require_all: bool) -> DataFrame:
        """Keys of the documents with all the words, or any."""
        stems = sorted(set(self.stems(words)))
        found = self.postings(stems).groupBy(self.key).agg(F.count_distinct("token").alias("k"))
        return found.where(F.col("k") == len(stems) if require_all else F.col("k") > 0).select(self.key)

    def score(self, words: list[str]) -> DataFrame:
        """``key, score`` (BM25) of the documents with any of the words: from their postings and one row of statistics."""
        p = self.postings(sorted(set(self.stems(words))))
        df = p.groupBy("token").agg(F.count("*").alias("df"))
        d = p.join(F.broadcast(df), "token").crossJoin(F.broadcast(self.stats))
        tf, n_df = F.col("tf"), F.col("df")
        s = F.log(1 + (F.col("n_docs") - n_df + 0.5) / (n_df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.col("avg")))
        return d.groupBy(self.key).agg(F.round(F.sum(s), 6).alias("score"))

    def selectivity(self, words: list[str]) -> DataFrame:
        """``term, selectivity``: the share of documents with each word."""
        named = self.spark.createDataFrame([(w, (self.stems([w]) or [None])[0]) for w in words], "term string, token string")
        df = self.postings(self.stems(words)).groupBy("token").agg(F.count("*").alias("df"))
        d = F.broadcast(named).join(df, "token", "left").crossJoin(F.broadcast(self.stats))
        return d.select("term", (F.coalesce("df", F.lit(0)) / F.col("n_docs")).alias("selectivity"))

    def count(self, word: str) -> int:
        """How many documents have the word."""
        return self.postings(self.stems([word])).count()
