"""Encoding against the library and back; packing's promises."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lumberline.llm import packing, tokens

ALPHABET = "'stremvld aA1 \n\t\r é中'’.!\U0001f600́٣  Ⅷ²"


def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.pieces_of(tokens.default_vocabulary()).ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    t = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    return [None, "", " ", "'", "'s", "don't we'll", "x" * 30000, "<|endoftext|>", *t]


def test_ids_and_back(spark, texts):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    enc, lib = tokens.encode(df).cache(), library()
    got = {r.doc_id: r.ids for r in enc.collect()}
    assert got == {i: lib.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in tokens.decode(enc).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    n = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()}
    assert n == {i: len(v) for i, v in got.items()}


def test_merging_by_hand_is_the_same():
    p = tokens.pieces_of(tokens.default_vocabulary())
    rnd = random.Random(2)
    for _ in range(300):
        raw = "".join(rnd.choice("abcdeé中 the") for _ in range(rnd.randint(1, 12))).encode()
        assert tokens.merge_pairs(p.ranks, raw) == list(p._merge(raw))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert tokens.encode(df).count() == 0


def test_shards_fit_and_fill():
    rnd = random.Random(3)
    sizes = np.array(sorted((rnd.randint(0, 900) for _ in range(5000)), reverse=True))
    box, start = packing.pack_shard(sizes, 1024)
    used = np.bincount(box, weights=sizes)
    assert used.max() <= 1024 and used.sum() / (1024 * len(used)) > 0.97
    for b in range(20):
        mine = np.flatnonzero(box == b)
        assert np.array_equal(start[mine], np.concatenate([[0], np.cumsum(sizes[mine])[:-1]]))


def test_pack_keeps_documents_whole(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([0, 0, 5, 10, 10, 25, 7, None])], "doc_id bigint, n_tokens bigint")
    targets = spark.createDataFrame([("t", "x", 10), ("u", None, 100), ("v", None, None)], "target_id string, name string, capacity_tokens bigint")
    rows = packing.pack(counts, targets).collect()
    assert {r.target_id for r in rows} == {"t", "u"}
    by = {}
    for r in rows:
        by.setdefault((r.target_id, r.container), []).append(r)
    for (t, _), mine in by.items():
        assert sum(r.n_tokens for r in mine) <= {"t": 10, "u": 100}[t]
        mine.sort(key=lambda r: (r.start, r.n_tokens))
        assert all(a.start + a.n_tokens <= b.start for a, b in zip(mine, mine[1:], strict=False))
    pieces = {(r.target_id, r.doc_id, r.piece): r.n_tokens for r in rows}
    assert len(pieces) == len(rows) and sum(n for (t, d, _), n in pieces.items() if t == "t" and d == 5) == 25
    assert [p for (t, d, p) in sorted(pieces) if t == "t" and d == 5] == [0, 1, 2]
    assert all(r.n_pieces == 1 for r in rows if r.target_id == "u")


def test_pack_nothing(spark):
    counts = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    targets = spark.createDataFrame([("t", 10)], "target_id string, capacity_tokens bigint")
    assert packing.pack(counts, targets).count() == 0
    assert packing.pack(counts, targets.limit(0)).count() == 0


def test_parts_by_offsets(spark, texts):
    """Any part of a text from the ids of its slices; repeated rows and rows without an id."""
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in enumerate(texts)] + [(8, texts[8]), (9, texts[9]), (None, "x")]
    enc = tokens.encode(spark.createDataFrame(rows, "doc_id bigint, text string"), offsets=True)
    got = {r.doc_id: r for r in enc.collect()}
    assert len(got) == len(texts) and enc.count() == len(texts)
    n = spark.createDataFrame([(i, len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, n int")
    d = enc.join(n, "doc_id").withColumn("begin", F.expr("n div 4")).withColumn("stop", F.expr("n - n div 3"))
    back = {r.doc_id: r.text for r in tokens.decode_part(d).collect()}
    assert back == {i: (t or "")[len(t or "") // 4 : len(t or "") - len(t or "") // 3] for i, t in enumerate(texts)}


def test_merging_a_long_piece_by_hand():
    p = tokens.pieces_of(tokens.default_vocabulary())
    raw = ("ab" * 20_000 + "é中" * 500).encode()
    assert tokens.merge_pairs(p.ranks, raw) == list(p._merge(raw))


def test_fewest_containers_then_even_cost():
    rnd = random.Random(9)
    for cap in (300, 1024, 20_000):
        sizes = np.array(sorted((int(rnd.paretovariate(1.2) * 20) % cap for _ in range(4000)), reverse=True))
        box, _ = packing.pack_shard(sizes, cap)
        tried = [packing._pack_by(sizes, cap, share)[0] for share in packing.OPEN_SHARES]
        assert box.max() == min(b.max() for b in tried)
        assert packing.costs(sizes, box, cap).std() == min(packing.costs(sizes, b, cap).std() for b in tried if b.max() == box.max())


def test_report_and_repeated_rows(spark):
    counts = spark.createDataFrame([(i % 50, 7 + i % 50) for i in range(100)] + [(99, 250), (None, 5)], "doc_id bigint, n_tokens bigint")
    targets = spark.createDataFrame([(1, 100)], "target_id bigint, capacity_tokens bigint")
    packed = packing.pack(counts, targets)
    r = packing.packing_report(packed, targets).first()
    assert (r.n_documents, r.most, r.whole) == (51, True, True) and packed.count() == 53
    assert not packing.packing_report(packed.where("piece = 0"), targets).first().whole
