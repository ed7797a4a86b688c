"""Encoding of whole texts with a public byte-level tokenizer, vectorised over batches.

Boundaries of the pre-tokens come from an array of code-point classes (letter, number, other, white space) instead of
an expression.  Seen as transition functions over these classes, every character's function is constant but for one
look to either side, so their scan reduces to comparing neighbours: a token starts where the class changes, the last
white space ahead of a word starts a token and, if it is a blank, is joined to it, and a contraction cuts the letters
after its apostrophe.  The slices are looked up in a cache of merged pieces; only pieces not seen before are merged.
The slices' offsets can be kept (``offsets``): with them any part of a text is decoded from the ids it lies in.

Defined cases: the ids of an empty and of a null text are the empty list; a text of any length is encoded whole;
special tokens' strings are ordinary text; further columns are ignored; a row with a null ``doc_id`` is no document;
repeated rows of a ``doc_id`` count once (where their texts differ, any of them).
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points handled at once by a worker, and pieces its cache may hold before it is emptied: bounds of memory only.
CHUNK = 1 << 20
CACHE_PIECES = 1 << 20

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3


def default_vocabulary() -> str:
    """Path of the vocabulary ``byte_bpe_50k`` on this machine; it is a parameter and never part of the repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_classes: np.ndarray | None = None


def class_table() -> np.ndarray:
    """Class of every code point by the Unicode general categories L and N and the white-space property."""
    global _classes
    if _classes is None:
        import regex

        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(m.group()[0]), ord(m.group()[-1])
                table[a : b + 1] = cls
        table[0xD800:0xE000] = OTHER
        _classes = table
    return _classes


def boundaries(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Start positions of the pre-tokens of texts laid end to end; ``doc_starts`` are starts of the non-empty texts."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    cls = class_table()[points]
    first = np.zeros(n + 3, bool)
    first[doc_starts] = True
    start = first.copy()
    start[1:n] |= cls[1:] != cls[:-1]
    white = cls == SPACE
    # The last white space ahead of something else in the same text.
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:n])
    start[last] = True
    blank = last[points[last] == 0x20]
    start[blank + 1] = False
    # Contractions: an apostrophe that starts a token, and the letters after it in the same text.
    at = np.flatnonzero(points == 0x27)
    at = at[start[at] & (at + 1 < n)]
    at = at[~first[at + 1]]
    if len(at):
        p = np.concatenate([points, np.zeros(3, points.dtype)])
        a, b = p[at + 1], p[at + 2]
        one = (a == 0x73) | (a == 0x74) | (a == 0x6D) | (a == 0x64)  # s t m d
        two = ((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)  # re ve ll
        two &= (at + 2 < n) & ~first[at + 2]
        for which, k in ((one, 2), (two, 3)):
            start[at[which] + 1] = False
            if k == 3:
                start[at[which] + 2] = False
            start[at[which] + k] = True
    return np.flatnonzero(start[:n])


class Pieces(dict):
    """Cache from a piece of text to its number; ``ids`` of piece k are ``flat[at[k]:at[k] + size[k]]``."""

    def __init__(self, vocabulary: str) -> None:
        super().__init__()
        with open(vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self._merge = merger(self.ranks)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.lists: list[list[int]] = []
        self._flat = np.zeros(0, np.int32)
        self._at = self._size = np.zeros(0, np.int64)

    def __missing__(self, piece: str) -> int:
        raw = piece.encode("utf-8", "surrogatepass")
        one = self.ranks.get(raw)
        self.lists.append([one] if one is not None else self._merge(raw))
        self[piece] = k = len(self.lists) - 1
        return k

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        done = len(self._size)
        if done < len(self.lists):
            new = self.lists[done:]
            size = np.fromiter(map(len, new), np.int64, len(new))
            flat = np.fromiter((i for x in new for i in x), np.int32, int(size.sum()))
            self._flat, self._size = np.concatenate([self._flat, flat]), np.concatenate([self._size, size])
            self._at = np.concatenate([[0], np.cumsum(self._size)[:-1]])
        return self._flat, self._at, self._size


def merge_pairs(ranks: dict[bytes, int], raw: bytes) -> list[int]:
    """Plain pair merging: the pair of lowest rank first, the leftmost of equal ones; n log n steps for n bytes."""
    n = len(raw)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = [False] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if not gone[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two has been merged since
        end[i], after[i], gone[j] = end[j], after[j], True
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(raw[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(raw[before[i] : end[i]])) is not None:
            heapq.heappush(heap, (r, before[i], end[i]))
    return [ranks[raw[i : end[i]]] for i in range(n) if not gone[i]]


def merger(ranks: dict[bytes, int]):
    """Merges one piece, by the installed library if there is one: a pattern that takes a text whole makes it a piece."""
    try:
        import tiktoken
    except ImportError:
        return lambda raw: merge_pairs(ranks, raw)
    whole = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})

    def merge(raw: bytes) -> list[int]:
        try:
            return whole.encode_ordinary(raw.decode("utf-8"))
        except UnicodeDecodeError:
            return merge_pairs(ranks, raw)

    return merge


_pieces: dict[str, Pieces] = {}


def pieces_of(vocabulary: str) -> Pieces:
    if vocabulary not in _pieces:
        _pieces[vocabulary] = Pieces(vocabulary)
    return _pieces[vocabulary]


def encode_batch(texts: list[str], cache: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece numbers of all the texts in order, how many each text has, and where each begins in its text."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    starts = boundaries(points, begins[sizes > 0])
    cuts = np.append(starts, len(points)).tolist()
    codes = np.fromiter(map(cache.__getitem__, map(joined.__getitem__, map(slice, cuts, cuts[1:]))), np.int64, len(starts))
    counts = np.searchsorted(starts, ends) - np.searchsorted(starts, begins)
    return codes, counts, starts - np.repeat(begins, counts)


def chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` code points together."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def one_row_each(df: DataFrame, key: str) -> DataFrame:
    """``df`` with a row for each key that isn't null.  The keys alone are looked at first: texts are exchanged only if
    a key occurs twice."""
    d = df.where(F.col(key).isNotNull())
    return d if d.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1).isEmpty() else d.dropDuplicates([key])


def encode(documents: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """``key`` and ``ids`` (list of int) of each document.  Each row is encoded where it is read.

    With ``offsets`` also ``at`` and ``first``: for each slice of the text its first code point and the place of its
    first id.
    """
    path = vocabulary or default_vocabulary()
    names = [key, "ids", *(["at", "first"] if offsets else [])]

    def run(batches):
        cache = pieces_of(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in chunks(texts):
                if len(cache) > CACHE_PIECES:
                    cache.reset()
                codes, counts, begin = encode_batch([t or "" for t in texts[i:j]], cache)
                flat, at, size = cache.arrays()
                n = size[codes]
                ends = np.cumsum(n)
                where = np.repeat(at[codes] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
                slices = np.concatenate([[0], np.cumsum(counts)])
                per = np.concatenate([[0], ends])[slices]
                out = [pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.array(flat[where], pa.int32()))]
                if offsets:
                    first = ends - n - np.repeat(per[:-1], counts)
                    out += [pa.ListArray.from_arrays(pa.array(slices, pa.int32()), pa.array(x, pa.int32())) for x in (begin, first)]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], *out], names=names)

    d = one_row_each(documents.select(key, text), key)
    return d.mapInArrow(run, f"{key} {dict(d.dtypes)[key]}, {', '.join(f'{c} array<int>' for c in names[1:])}")


def count_tokens(documents: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``n_tokens`` of each document, by the same encoding without its ids."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        cache = pieces_of(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in chunks(texts):
                if len(cache) > CACHE_PIECES:
                    cache.reset()
                codes, counts, _ = encode_batch([t or "" for t in texts[i:j]], cache)
                total = np.concatenate([[0], np.cumsum(cache.arrays()[2][codes])])
                upto = total[np.concatenate([[0], np.cumsum(counts)])]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(np.diff(upto), pa.int64())], names=[key, "n_tokens"])

    d = one_row_each(documents.select(key, text), key)
    return d.mapInArrow(run, f"{key} {dict(d.dtypes)[key]}, n_tokens bigint")


def decode(encoded: DataFrame, vocabulary: str | None = None, key: str = "doc_id") -> DataFrame:
    """``key`` and ``text`` of lists of ids: the exact way back."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        back = {i: raw for raw, i in pieces_of(path).ranks.items()}
        for b in batches:
            texts = [None if ids is None else b"".join(map(back.__getitem__, ids)).decode("utf-8", "surrogatepass") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    d = encoded.select(key, "ids")
    return d.mapInArrow(run, f"{key} {dict(d.dtypes)[key]}, text string")


def decode_part(encoded: DataFrame, vocabulary: str | None = None, key: str = "doc_id") -> DataFrame:
    """``key`` and ``text``: of ``key, ids, at, first, begin, stop`` the code points from ``begin`` up to ``stop``, out of
    the ids of the slices they lie in alone."""
    path = vocabulary or default_vocabulary()

    def part(back: dict[int, bytes], ids, at, first, begin, stop) -> str:
        if not len(at) or stop <= begin:
            return ""
        i, j = int(np.searchsorted(at, begin, "right")) - 1, int(np.searchsorted(at, stop, "left"))
        raw = b"".join(map(back.__getitem__, ids[first[i] : first[j] if j < len(first) else len(ids)]))
        return raw.decode("utf-8", "surrogatepass")[begin - at[i] : stop - at[i]]

    def run(batches):
        back = {i: raw for raw, i in pieces_of(path).ranks.items()}
        for b in batches:
            texts = [part(back, *row) for row in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    d = encoded.select(key, "ids", "at", "first", "begin", "stop")
    return d.mapInArrow(run, f"{key} {dict(d.dtypes)[key]}, text string")
