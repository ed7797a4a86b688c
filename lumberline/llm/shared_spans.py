"""Long exact spans shared between documents, by recompression.

Rounds of recompression name runs of equal symbols and then pairs of neighbouring symbols.  A name is a 64-bit hash of
what it stands for, so every task gives equal strings equal names without exchanging anything, and the split of the
symbols into those that may begin a pair and those that may end one is a bit of the name.  Along with each symbol goes
the part of the text that decided it (``lo``, ``hi``): equal text there gives the same symbol in any document.

1. ``GRAM`` neighbouring symbols together get a name, and of each stretch of ``WIDTH`` such names the smallest stands
   for all windows (of ``span`` code points) that hold everything that decided the stretch.  A window that holds no
   whole stretch stands for itself.
2. In Spark, the names are counted by document: one that no other document has rules its windows out.
3. In the texts that are left, each run of windows under a shared name gets a signature of all its windows and a BLAKE2
   digest of its very text.  If another document has both, too, the whole run is shared.  Rows are merged by signature
   before any exchange; where rows and not groups are joined, the most frequent keys are joined apart, by a broadcast
   of ``HOT_KEYS`` rows at most, so a passage in a third of all documents is as cheap as one in two of them.
4. What is left are the ends of shared passages: for one document of each signature that stands alone under a name with
   several signatures, the windows themselves are compared by their hashes.

Every window is decided by equality of 128 bits over the text of its run, or of 96 bits over its own code points (two
hashes of different bases); nothing depends on the names but the work.

Defined cases: null and short texts share nothing; repeated rows of a document count once (equal ids are one
document); a span that occurs twice in one document only isn't shared; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.session import cut, drop_cut

SPAN = 200
ROUNDS = 5
#: Symbols that get a name together, and such names in a stretch.
GRAM, WIDTH = 15, 16
#: Bits of the filters that keep most rows that can't match out of an exchange; they bound what is broadcast (2 MB).
FILTER_BITS = 1 << 24
#: A key of more rows is joined apart, at most so many of them: no other key has over a thousandth of the rows.
HOT_ROWS, HOT_KEYS = 100_000, 1000
#: Code points that a worker handles at once (a longer text is handled by itself).
CHUNK = 1 << 19

_M1, _M2, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)
_BASES = (_B, np.uint64(0xC2B2AE3D27D4EB4F))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def powers(n: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base of the window hash, and of its inverse, up to n."""
    if base not in _powers or len(_powers[base][0]) < n:
        m = max(n, CHUNK * 2)
        up, down = np.full(m, _BASES[base], np.uint64), np.full(m, np.uint64(pow(int(_BASES[base]), -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        _powers[base] = np.cumprod(up), np.cumprod(down)
    return _powers[base]


def window_hashes(points: np.ndarray, span: int, base: int = 0) -> np.ndarray:
    """Hash of each window of ``span`` code points."""
    up, down = powers(len(points) + 1, base)
    c = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_mix(points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=c[1:])
    return _mix((c[span:] - c[:-span]) * down[: len(points) - span + 1])


def recompress(points: np.ndarray, ends: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of texts laid end to end, each with the part ``[lo, hi)`` of the whole that decided it.

    ``ends`` are the ends of the texts.  A text's own end is a symbol no other has, so nothing crosses it.
    """
    n = len(points)
    names = _mix(points.astype(np.uint64) + np.uint64(0x51ED270))
    lo = np.arange(n, dtype=np.int32)
    hi = lo + np.int32(1)
    before, after = np.array([-1], np.int32), np.array([n + 1], np.int32)
    wall = np.zeros(n, bool)  # the last symbol of each text
    wall[ends - 1] = True
    for r in range(rounds):
        if r % 2 == 0:  # runs
            head = np.ones(len(names), bool)
            np.logical_or(names[1:] != names[:-1], wall[:-1], out=head[1:])
            head = np.flatnonzero(head)
            size = np.diff(np.append(head, len(names)))
            many = np.flatnonzero(size > 1)
            tail = head + size - 1
            names, wall = names[head], wall[tail]
            names[many] = _mix(names[many] + size[many].astype(np.uint64) * _B)
            lo, hi = np.concatenate([before, lo])[head], np.concatenate([hi, after])[tail + 1]
        right = (names * (_M1 + np.uint64(2 * r)) >> np.uint64(63)).astype(bool)  # pairs of a left and a right symbol
        pair = np.zeros(len(names) + 1, bool)
        pair[:-2] = right[1:] & ~right[:-1] & ~wall[:-1]
        first = np.flatnonzero(pair)
        names[first] = _mix(names[first] * _B + names[first + 1])
        keep = np.ones(len(names), bool)
        keep[first + 1] = False
        keep = np.flatnonzero(keep)
        end = keep + pair[keep]
        names, wall = names[keep], wall[end]
        lo, hi = np.concatenate([before, lo])[keep], np.concatenate([hi, after])[end + 1]
    return names, lo, hi


def stretch_names(names: np.ndarray) -> np.ndarray:
    """The smallest of each ``WIDTH`` neighbouring names of ``GRAM`` symbols."""
    up, down = powers(len(names) + 1)
    c = np.zeros(len(names) + 1, np.uint64)
    np.cumsum(names * up[: len(names)], out=c[1:])
    out, have = _mix((c[GRAM:] - c[:-GRAM]) * down[: len(names) - GRAM + 1]), 1
    while have < WIDTH:
        step = min(have, WIDTH - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Batch:
    """Texts of at least a span each, and the names their windows stand under.

    Windows that begin in ``[i0[k], i1[k]]`` stand under ``name[k]``, in text ``doc[k]``; those at ``own`` under their
    own hash.  A window takes the first stretch whose grounds begin within it, if they end within it, too.
    """

    def __init__(self, texts: list[str], span: int) -> None:
        self.span = span
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(self.points)
        names, lo, hi = recompress(self.points, self.ends)
        if len(names) >= GRAM + WIDTH - 1:
            name = stretch_names(names)
            a, b = lo[: len(name)].astype(np.int64), hi[GRAM + WIDTH - 2 :].astype(np.int64)
            doc = np.minimum(np.searchsorted(self.ends, a, side="right"), len(texts) - 1)
            i0 = np.maximum(np.maximum(np.concatenate([[-1], a[:-1]]) + 1, b - span), self.begins[doc])
            i1 = np.minimum(a, self.ends[doc] - span)
            use = np.flatnonzero((i0 <= i1) & (b <= self.ends[doc]))
            self.name, self.doc, self.i0, self.i1 = name[use], doc[use], i0[use], i1[use]
        else:
            self.name, self.doc, self.i0, self.i1 = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
        level = np.zeros(n + 2, np.int8)
        np.add.at(level, self.begins, 1)
        np.add.at(level, self.ends - span + 1, -1)
        level -= (np.bincount(self.i0, minlength=n + 2) - np.bincount(self.i1 + 1, minlength=n + 2)).astype(np.int8)
        self.own = np.flatnonzero(np.cumsum(level, dtype=np.int8)[:n])
        self.own_doc = np.searchsorted(self.ends, self.own, side="right")
        self.own_name = np.zeros(len(self.own), np.uint64)
        for k in np.unique(self.own_doc).tolist():
            mine = slice(*np.searchsorted(self.own_doc, [k, k + 1]))
            x, y = int(self.begins[k]), int(self.ends[k])
            self.own_name[mine] = window_hashes(self.points[x:y], span)[self.own[mine] - x]

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """The names in each text: the text's number (ascending), the name; hardly any name of a text twice."""
        change = np.ones(len(self.name), bool)
        change[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])
        doc, name = self.doc[change], self.name[change]
        if len(self.own):
            change = np.ones(len(self.own), bool)
            change[1:] = (self.own_name[1:] != self.own_name[:-1]) | (self.own_doc[1:] != self.own_doc[:-1])
            doc, name = np.concatenate([doc, self.own_doc[change]]), np.concatenate([name, self.own_name[change]])
            order = np.argsort(doc, kind="stable")
            doc, name = doc[order], name[order]
        return doc, name

    def by_window(self) -> np.ndarray:
        """The name of each position that a window begins at."""
        out = np.zeros(len(self.points), np.uint64)
        size = self.i1 - self.i0 + 1
        at = np.repeat(self.i0 - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        out[at] = np.repeat(self.name, size)
        out[self.own] = self.own_name
        return out


def _chunks(texts: list[str | None], span: int) -> Iterator[np.ndarray]:
    """Indices of the texts of at least a span, in groups of about ``CHUNK`` code points."""
    got, size = [], 0
    for i, t in enumerate(texts):
        if t is None or len(t) < span:
            continue
        got.append(i)
        size += len(t)
        if size >= CHUNK:
            yield np.array(got)
            got, size = [], 0
    if got:
        yield np.array(got)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def document_names(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """``doc_id, names``: the distinct names of each text that is long enough."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for group in _chunks(texts, span):
                x = Batch([texts[i] for i in group], span)
                doc, name = x.names()
                sizes = np.bincount(doc, minlength=len(group))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), _signed(name))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(group)), lists], names=["doc_id", "names"])

    d = documents.select("doc_id", "text")
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, names array<bigint>")


def _member(values: np.ndarray, of: pa.Scalar) -> np.ndarray:
    """Which of the names are in a list of names."""
    some = np.sort(np.asarray(of.values, dtype=np.int64).view(np.uint64))
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _runs_of(texts: pa.Array, wanted: pa.Array, span: int, second: bool = False) -> Iterator[tuple[int, int, int, int, int, np.ndarray, np.ndarray | None]]:
    """Of each text the runs of windows under a wanted name: text, name, start, signature, digest, the windows' hashes
    (and 32 bits of a second one)."""
    py = texts.to_pylist()
    for group in _chunks(py, span):
        x = Batch([py[i] for i in group], span)
        under = x.by_window()
        for k, i in enumerate(group.tolist()):
            lo, hi = int(x.begins[k]), int(x.ends[k])
            names = under[lo : hi - span + 1]
            heads = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            tails = np.append(heads[1:], len(names))
            hit = np.flatnonzero(_member(names[heads], wanted[i]))
            if not len(hit):
                continue
            hashes = window_hashes(x.points[lo:hi], span)
            up, down = powers(len(hashes) + 1)
            c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])])
            h, t = heads[hit], tails[hit]
            sig = _mix((c[t] - c[h]) * down[h] + (t - h).astype(np.uint64)).view(np.int64)
            raw = memoryview(x.points[lo:hi].tobytes())
            more = (window_hashes(x.points[lo:hi], span, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32) if second else None
            for name, start, end, g in zip(names[h].view(np.int64).tolist(), h.tolist(), t.tolist(), sig.tolist(), strict=True):
                digest = hashlib.blake2b(raw[4 * start : 4 * (end + span - 1)], digest_size=8).digest()
                yield i, name, start, g, int.from_bytes(digest, "little", signed=True), hashes[start:end], None if more is None else more[start:end]


def window_runs(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """``doc_id, name, sig, digest, start, n``: the runs of ``n`` windows under a name that is in the list ``wanted``."""

    def run(batches):
        for b in batches:
            rows = [(i, name, g, x, start, len(w)) for i, name, start, g, x, w, _ in _runs_of(b.column(1), b.column(2), span)]
            if rows:
                i, *rest = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), *(pa.array(v, k) for v, k in zip(rest, kinds, strict=True))], names=["doc_id", "name", "sig", "digest", "start", "n"])

    d = documents.select("doc_id", "text", "wanted")
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, name bigint, sig bigint, digest bigint, start int, n int")


def run_windows(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """``name, sig, digest, hashes, more``: the windows' hashes of the runs under a wanted name, a signature of a text
    once."""
    names = ["name", "sig", "digest", "hashes", "more"]

    def run(batches):
        for b in batches:
            rows = {(i, name, g, x): (w, v) for i, name, _, g, x, w, v in _runs_of(b.column(1), b.column(2), span, second=True)}
            if rows:
                sizes = np.fromiter((len(w) for w, _ in rows.values()), np.int64, len(rows))
                at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                first, second = (np.concatenate([r[k] for r in rows.values()]) for k in (0, 1))
                keys = [pa.array([k[i] for k in rows], pa.int64()) for i in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(at, _signed(first)), pa.ListArray.from_arrays(at, pa.array(second, pa.int32()))], names=names)

    return documents.select("doc_id", "text", "wanted").mapInArrow(run, "name bigint, sig bigint, digest bigint, hashes array<bigint>, more array<int>")


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of ``right``, whose keys are unique and whose ``n`` says how many rows of ``left`` have
    them.  The ``HOT_KEYS`` largest of over ``HOT_ROWS`` rows go by a broadcast, the rest by an exchange."""
    hot = right.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), *keys).limit(HOT_KEYS)
    if hot.isEmpty():
        return left.join(right.drop("n"), keys)
    hot = cut(left.sparkSession, hot, "spans-hot").drop("n")
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.drop("n"), keys)
    return left.join(F.broadcast(hot), keys).unionByName(rest)


def _bit(h):
    return F.pmod(F.xxhash64(h), F.lit(FILTER_BITS))


def filter_bits(values: DataFrame, column: str) -> np.ndarray:
    """A filter of ``FILTER_BITS`` bits that holds every value of the column, and others by chance.

    Its size is fixed: with more values than bits it lets everything pass, which costs time but no result.
    """
    bit = values.select(_bit(F.col(column)).alias("b"))
    words = bit.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["w"].to_numpy()] = words["v"].to_numpy()
    return out


def passing(df: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    """The rows whose value may be in the filter."""
    held = df.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def hit(b: pd.Series) -> pd.Series:
        x = b.to_numpy(np.int64)
        return pd.Series((held.value[x >> 6] >> (x & 63)) & 1 == 1)

    return df.where(hit(_bit(F.col(column))))


def shared_windows(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """``doc_id, start, length`` of stretches of starts of windows that another document has, too."""
    spark = documents.sparkSession
    docs = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    listed = cut(spark, document_names(docs, span), "spans-names")
    names = listed.select("doc_id", F.explode("names").alias("name"))
    common = names.groupBy("name").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where(F.col("a") != F.col("b")).select("name", "n")
    common = cut(spark, common, "spans-common")
    mine = keyed_join(passing(names, "name", filter_bits(common, "name")), common, ["name"])
    mine = cut(spark, mine.groupBy("doc_id").agg(F.collect_set("name").alias("wanted")), "spans-wanted")
    some = cut(spark, passing(docs, "doc_id", filter_bits(mine, "doc_id")).join(mine, "doc_id"), "spans-texts")
    drop_cut(listed, common, mine)
    runs, key = cut(spark, window_runs(some, span), "spans-runs"), ["name", "sig", "digest"]
    kinds = cut(spark, runs.groupBy(*key).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")), "spans-kinds")
    whole = kinds.where(F.col("a") != F.col("b")).select(*key, "n")
    out = keyed_join(runs, whole, key).select("doc_id", "start", F.col("n").alias("length"))
    # The ends: signatures of one document under a name that has others.
    mixed = kinds.groupBy("name").agg(F.count("*").alias("n"), F.bool_or(F.col("a") == F.col("b")).alias("lone")).where((F.col("n") > 1) & F.col("lone")).select("name", "n")
    ends = keyed_join(kinds.drop("n"), mixed, ["name"])
    asked = ends.groupBy(F.col("a").alias("doc_id")).agg(F.collect_set("name").alias("wanted"))
    windows = run_windows(some.drop("wanted").join(asked, "doc_id"), span)
    windows = windows.join(ends, key).groupBy(*key, "a", "b").agg(F.any_value(F.struct("hashes", "more")).alias("w"))
    windows = cut(spark, windows, "spans-windows").select(*key, "a", "b", F.posexplode(F.arrays_zip("w.hashes", "w.more")).alias("pos", "h")).select(*key, "a", "b", "pos", F.col("h.hashes").alias("h"), F.col("h.more").alias("h2"))
    drop_cut(some)
    found = windows.groupBy("h", "h2").agg(F.min("a").alias("a"), F.max("b").alias("b")).where(F.col("a") != F.col("b")).select("h", "h2")
    at = windows.where(F.col("a") == F.col("b")).join(found, ["h", "h2"], "left_semi")
    at = at.groupBy(*key).agg(F.collect_list("pos").alias("at"))
    part = runs.join(at, key).select("doc_id", "start", F.explode("at").alias("pos"))
    return out.unionByName(part.select("doc_id", (F.col("start") + F.col("pos")).alias("start"), F.lit(1).alias("length")))


def covered(intervals: DataFrame, span: int = SPAN) -> DataFrame:
    """``doc_id, shared_chars``: code points within the windows that begin in the intervals."""
    d = intervals.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("bigint").alias("a"), (F.col("start") + F.col("length") - 1 + span).cast("bigint").alias("b")))).alias("v"))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))

    def step(acc, x):
        return F.struct((acc["n"] + F.greatest(F.lit(0).cast("bigint"), x["b"] - F.greatest(acc["end"], x["a"]))).alias("n"), F.greatest(acc["end"], x["b"]).alias("end"))

    return d.select("doc_id", F.aggregate("v", zero, step, lambda acc: acc["n"]).alias("shared_chars"))


def shared_spans(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """``doc_id, shared_chars`` of each document that shares a span of at least ``span`` code points."""
    return covered(shared_windows(documents, span), span)
