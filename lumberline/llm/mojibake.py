"""Text that was decoded with the wrong character encoding: found, and restored where it still can be.

1. Adjacent characters of all texts are counted in pairs; a pair that touches no character beyond ASCII says nothing
   and isn't counted.  Counts go to tables of fixed size (two slots for each pair, the smaller count holds), which is
   all that is ever broadcast.
2. A pair's part in the corpus's mutual information is its count times log2 of p(ab) / (p(a) p(b)), by both characters'
   own counts.  What brings less than ``2 ** -COMMON_BITS`` bits for each pair counted, or none, is improbable by as many
   bits as it falls short.  All maximal-scoring segments of these scores are isolated.
3. Only inside them the inverse of each known mistake is tried: encode as it was wrongly read, decode as it should have
   been.  A result stands if the corpus finds it likelier, as a chain of its pairs, than what is there.  A restored text
   is tried again until nothing is likelier, as some text went wrong more than once.

Characters that only a failed decoding leaves (U+FFFD, C1 controls) mark a text that can't be restored.

Defined cases: null, empty and pure ASCII texts are never garbled; a null id is no record; repeated rows of a record
count once; very long texts are handled whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.session import cut

#: Sizes of the tables of pair and character counts (2 views of 2 x 8 MB and 2 MB): bounds of what is broadcast.
PAIR_BITS, CHAR_BITS = 20, 18
#: A pair that brings 2 ** -COMMON_BITS bits of mutual information for each pair counted, or more, isn't improbable.
COMMON_BITS = 5.0
#: Score of a pair that touches no character beyond ASCII, and the bounds of the others' scores.
PLAIN, LEAST, MOST = -2.0, -6.0, 12.0
#: Nats by which a restored text must be likelier than the text as it is, and what a valid decoding as UTF-8 counts.
MARGIN, VALID_UTF8 = 4.0, 3.0
#: Words and pairs that a worker remembers before it starts anew: a bound of memory only.
REMEMBERED = 200_000

# What text was wrongly read as, and what it was.
READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "koi8-r", "cp866", "cp1250", "cp1254", "iso8859-15", "gbk", "shift_jis", "big5")
MEANT = ("utf-8", "gbk", "shift_jis", "cp1251", "cp1252", "koi8-r", "euc_jp", "big5", "cp437", "cp850", "cp866", "mac_roman", "euc_kr")
_MULTIBYTE = ("gbk", "shift_jis", "big5")
_MISTAKES = [(w, r) for w in READ_AS for r in MEANT if w != r and not (w in ("gbk", "shift_jis", "big5") and r != "utf-8" and r[:2] != "cp" and r != "euc_jp")]
# Positions that cp1252 leaves open are read as the control of the same number.
_OPEN_1252 = {0x81: b"\x81", 0x8D: b"\x8d", 0x8F: b"\x8f", 0x90: b"\x90", 0x9D: b"\x9d"}
_LOST = re.compile("[�\x80-\x84\x86-\x9f]")
_UNIT = re.compile("[^\\x00-\\x7f][^ ]*")


_KIND = np.arange(128, dtype=np.uint32)
_KIND[ord("0") : ord("9") + 1] = ord("0")
_COARSE = _KIND.copy()
_COARSE[ord("a") : ord("z") + 1] = _COARSE[ord("A") : ord("Z") + 1] = ord("a")
_VIEWS = (_KIND, _COARSE)
_C1, _C2, _C3, _ALL = 0x9E3779B97F4A7C15, (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), (0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD), (1 << 64) - 1


def _view(points: np.ndarray, k: int) -> np.ndarray:
    """The code points with ASCII digits as one (0), and with ASCII letters as one, too (1)."""
    return np.where(points < 128, _VIEWS[k][np.minimum(points, 127)], points)


def _pair_slot(a, b, row: int):
    """Slot of a pair in one of the two rows of a table, of arrays or of two numbers."""
    if isinstance(a, int):
        x = (a * _C1 + b * _C2[row]) & _ALL
        x ^= x >> 31
        return ((x * _C3[row]) & _ALL) >> (64 - PAIR_BITS)
    x = a.astype(np.uint64) * np.uint64(_C1) + b.astype(np.uint64) * np.uint64(_C2[row])
    x ^= x >> np.uint64(31)
    return ((x * np.uint64(_C3[row])) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _char_slot(a):
    if isinstance(a, int):
        return ((a * _C1) & _ALL) >> (64 - CHAR_BITS)
    return ((a.astype(np.uint64) * np.uint64(_C1)) >> np.uint64(64 - CHAR_BITS)).astype(np.int64)


def _points(texts: list[str]) -> np.ndarray:
    """Code points of the texts, each with a blank of its own on either side."""
    return np.frombuffer(f" {'  '.join(texts)} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def empty_counts() -> tuple[np.ndarray, np.ndarray]:
    """Tables of counts: pairs by view, row and slot; characters by view and slot."""
    return np.zeros((2, 2, 1 << PAIR_BITS), np.int64), np.zeros((2, 1 << CHAR_BITS), np.int64)


def tally(texts: list[str], pairs: np.ndarray, chars: np.ndarray) -> None:
    """Add the pairs that touch a character beyond ASCII, and the first characters of all pairs."""
    p = _points(texts)
    wide = p > 127
    pair = wide[1:] | wide[:-1]
    for k in (0, 1):
        v = _view(p, k)
        a, b = v[:-1][pair], v[1:][pair]
        for row in (0, 1):
            pairs[k, row] += np.bincount(_pair_slot(a, b, row), minlength=1 << PAIR_BITS)
        chars[k] += np.bincount(_char_slot(v[:-1]), minlength=1 << CHAR_BITS)


class Model:
    """Information of pairs of characters, from the counts of the corpus."""

    def __init__(self, pairs: np.ndarray, chars: np.ndarray) -> None:
        self.pairs, self.chars = pairs, chars
        self.n_pairs, self.n_chars = max(1, int(pairs[0, 0].sum())), max(1, int(chars[0].sum()))
        self.known: dict[str, float] = {}
        self.words: dict[str, dict[tuple[str, str], str]] = {}
        self.better: dict[tuple[str, str, str], dict[tuple[str, str], tuple[str, float]]] = {}

    def _pair(self, two: str) -> float:
        got = self.known.get(two)
        if got is None:
            x, y = ord(two[0]), ord(two[1])
            got = 0.0
            if x > 127 or y > 127:
                for k, table in enumerate(_VIEWS):
                    a, b = int(table[x]) if x < 128 else x, int(table[y]) if y < 128 else y
                    n = min(int(self.pairs[k, row, _pair_slot(a, b, row)]) for row in (0, 1))
                    got += math.log(n + 0.02) - math.log(int(self.chars[k, _char_slot(a)]) + 20.0)
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[two] = got
        return got

    def likelihood(self, text: str) -> float:
        """Log likelihood of ``text`` as a chain of its pairs, in the exact and the coarse view together."""
        return sum(map(self._pair, map(str.__add__, text, text[1:])))

    def inverses(self, unit: str) -> dict[tuple[str, str], str]:
        """What each inverse mapping that is possible makes of a unit."""
        got = self.words.get(unit)
        if got is None:
            raws = {w: _encoded(unit, w) for w in READ_AS}
            got = {}
            for w, r in _MISTAKES:
                if (raw := raws[w]) is not None:
                    try:
                        new = raw.decode(r)
                    except UnicodeDecodeError:
                        continue
                    if new != unit:
                        got[w, r] = new
            if len(self.words) > REMEMBERED:
                self.words.clear()
            self.words[unit] = got
        return got

    def gains(self, before: str, unit: str, after: str) -> dict[tuple[str, str], tuple[str, float]]:
        """The inverse mappings that make a unit likelier between its neighbours: what it becomes, and by how much."""
        key = before, unit, after
        got = self.better.get(key)
        if got is None:
            has, got = self.likelihood(before + unit + after), {}
            for mistake, new in self.inverses(unit).items():
                gain = self.likelihood(before + new + after) - has + (VALID_UTF8 if mistake[1] == "utf-8" else 0.0)
                if gain > 0:
                    got[mistake] = new, gain
            if len(self.better) > REMEMBERED:
                self.better.clear()
            self.better[key] = got
        return got

    def scores(self, points: np.ndarray) -> np.ndarray:
        """Bits by which each pair falls short of a common pair's part in the mutual information."""
        wide = points > 127
        pair = np.flatnonzero(wide[1:] | wide[:-1])
        v = _view(points, 0)
        a, b = v[:-1][pair], v[1:][pair]
        n = np.minimum(self.pairs[0, 0, _pair_slot(a, b, 0)], self.pairs[0, 1, _pair_slot(a, b, 1)]) + 0.5
        chars = self.chars[0]
        mutual = np.log2(n * self.n_chars / ((chars[_char_slot(a)] + 0.5) * (chars[_char_slot(b)] + 0.5)))
        out = np.full(len(points) - 1, PLAIN)
        out[pair] = np.clip(-np.log2(np.maximum(n * mutual / self.n_pairs, 1e-12)) - COMMON_BITS, LEAST, MOST)
        return out

    def segments(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """All maximal-scoring segments of each text, as ranges of its characters."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        score = self.scores(_points(texts))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(sizes + 2) - (sizes + 2)  # of each text's blank, among the points
        total = np.concatenate([[0.0], np.cumsum(score)])
        up = score > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], up, [False]]).astype(np.int8)))
        starts, stops = edge[::2], edge[1::2]
        owner = np.searchsorted(begin, starts, side="right") - 1
        found: list[tuple[int, int, float, float]] = []
        last = -1
        for k, i, j in zip(owner.tolist(), starts.tolist(), stops.tolist(), strict=True):
            if k != last:
                _take(out, last, found, begin)
                found, last = [], k
            left, right = float(total[i]), float(total[j])
            while True:
                at = next((x for x in range(len(found) - 1, -1, -1) if found[x][2] < left), -1)
                if at < 0 or found[at][3] >= right:
                    break
                i, left = found[at][0], found[at][2]
                del found[at:]
            found.append((i, j, left, right))
        _take(out, last, found, begin)
        return [[(max(0, a), min(n, b)) for a, b in x] for x, n in zip(out, sizes.tolist(), strict=True)]


def _take(out: list[list[tuple[int, int]]], k: int, found: list[tuple[int, int, float, float]], begin: np.ndarray) -> None:
    """Segments of pairs of a text as ranges of its characters: pair i joins the points i and i + 1."""
    if k >= 0:
        b = int(begin[k])
        out[k] = [(i - b - 1, j - b) for i, j, _, _ in found]


def _encoded(text: str, charset: str) -> bytes | None:
    try:
        return text.encode(charset)
    except UnicodeEncodeError:
        if charset != "cp1252":
            return None
    try:
        return b"".join(_OPEN_1252.get(ord(c)) or c.encode(charset) for c in text)
    except UnicodeEncodeError:
        return None


_WIDE_RUN = re.compile("[^\\x00-\\x7f]+")


def _units(text: str, ranges: list[tuple[int, int]], whole_runs: bool) -> list[tuple[int, int]]:
    """What an inverse mapping is tried on, inside the segments: runs beyond ASCII, or from there to the next blank."""
    pattern = _WIDE_RUN if whole_runs else _UNIT
    return [m.span() for a, b in ranges for m in pattern.finditer(text, a, b)]


def restore(text: str, model: Model, ranges: list[tuple[int, int]]) -> tuple[bool, str | None]:
    """Whether the text, with its segments, is garbled, and the original if it can be restored."""
    now, seen = text, {text}
    while ranges:
        total: dict[tuple[str, str], float] = {}
        made: dict[tuple[str, str], list[tuple[int, int, str]]] = {}
        for bytewise in (True, False):
            for a, b in _units(now, ranges, bytewise):
                before, after = now[a - 1] if a else " ", now[b : b + 1] or " "
                for mistake, (new, gain) in model.gains(before, now[a:b], after).items():
                    if (mistake[1] == "utf-8" and mistake[0] not in _MULTIBYTE) == bytewise:
                        total[mistake] = total.get(mistake, 0.0) + gain
                        made.setdefault(mistake, []).append((a, b, new))
        best = max(total, key=total.get, default=None)
        if best is None or total[best] < MARGIN:
            break
        was = now
        for a, b, new in reversed(made[best]):
            now = now[:a] + new + now[b:]
        if now in seen:
            now = was
            break
        seen.add(now)
        ranges = model.segments([now])[0]
    lost = bool(_LOST.search(now))
    return len(seen) > 1 or lost, now if len(seen) > 1 and not lost else None


def _records(log: DataFrame, files: DataFrame) -> DataFrame:
    """``record_kind, record_id, text`` of the texts beyond ASCII, each record once, over as many even tasks as the
    scan has splits, in fours, or twice the cores."""
    def of(df: DataFrame, kind: str, text: str) -> DataFrame:
        d = df.select(F.lit(kind).alias("record_kind"), F.col("id").alias("record_id"), F.col(text).alias("text"))
        return d.where(F.col("record_id").isNotNull() & (F.length("text") != F.octet_length("text")))

    both = of(log, "log", "content").unionByName(of(files, "file", "original_name"))
    n = max(2 * log.sparkSession.sparkContext.defaultParallelism, both.rdd.getNumPartitions() // 4)
    return both.repartition(n, "record_kind", "record_id").dropDuplicates(["record_kind", "record_id"])


def _batches(texts: list[str], limit: int = 1 << 20) -> Iterator[list[str]]:
    got, size = [], 0
    for t in texts:
        got.append(t)
        size += len(t)
        if size > limit:
            yield got
            got, size = [], 0
    if got:
        yield got


def corpus_model(records: DataFrame) -> Model:
    """The counts of all records, added up in Spark and brought to the driver as tables of fixed size."""

    def run(batches):
        pairs, chars = empty_counts()
        for b in batches:
            for texts in _batches(b.column(0).to_pylist()):
                tally(texts, pairs, chars)
        for kind, table in ((0, pairs.ravel()), (1, chars.ravel())):
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind), pa.int32()), pa.array(at, pa.int64()), pa.array(table[at])], names=["kind", "slot", "n"])

    got = records.select("text").mapInArrow(run, "kind int, slot bigint, n bigint").groupBy("kind", "slot").agg(F.sum("n").alias("n")).toPandas()
    pairs, chars = empty_counts()
    for kind, table in ((0, pairs), (1, chars)):
        part = got[got["kind"] == kind]
        table.reshape(-1)[part["slot"].to_numpy()] = part["n"].to_numpy()
    return Model(pairs, chars)


def garbled(log: DataFrame, files: DataFrame) -> DataFrame:
    """``record_kind, record_id, text, restored`` of the garbled records; ``restored`` is null where it can't be."""
    spark = log.sparkSession
    records = cut(spark, _records(log, files), "garbled-records")
    model = corpus_model(records)
    held = spark.sparkContext.broadcast((model.pairs, model.chars))

    def run(frames):
        m = Model(*held.value)
        for f in frames:
            out = [restore(t, m, r) for texts in _batches(f["text"].tolist()) for t, r in zip(texts, m.segments(texts), strict=True)]
            f = f.assign(restored=pd.Series([r for _, r in out], index=f.index, dtype=object))
            yield f[np.fromiter((g for g, _ in out), bool, len(out))]

    return records.mapInPandas(run, f"record_kind string, record_id {dict(records.dtypes)['record_id']}, text string, restored string")
