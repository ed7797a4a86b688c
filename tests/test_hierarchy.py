"""Hierarchies against a plain walk, and consolidation."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lumberline.operators import compaction, hierarchy
from lumberline.session import scratch_path

ARCHIVES = "id bigint, parent_archive_id bigint, depth_level int, original_name string, name string"
FILES = "id bigint, parent_archive_id bigint, depth_level int, original_name string, size bigint, sha256_hash string, virtual_path string"


def walk(parents):
    """State, depth and root of each node by following its parents."""
    out = {}
    for v in parents:
        chain = [v]
        while (p := parents.get(chain[-1])) is not None and p in parents and p not in chain:
            chain.append(p)
        if p is None:
            out[v] = ("tree", len(chain) - 1, chain[-1])
        elif p not in parents:
            out[v] = ("orphan", len(chain) - 1, p)
        else:
            ring = chain[chain.index(p) :]
            out[v] = ("cycle" if v in ring else "under_cycle", None, min(ring))
    return out


def make(spark, parents, file_parents):
    a = spark.createDataFrame([(i, p, 0, f"a{i}", "clash") for i, p in parents.items()] * 2 + [(None, 1, 0, None, None)], ARCHIVES)
    f = spark.createDataFrame([(i, p, None, None, 1, None, None) for i, p in file_parents.items()], FILES)
    return a, f


def test_random_forests(spark):
    rnd = random.Random(4)
    parents = {i: rnd.choice([None, None, 99, *range(1, 41)]) for i in range(1, 41)}
    parents[7] = 7
    files = {i: rnd.choice([None, 98, *range(1, 41)]) for i in range(1, 60)}
    nodes = hierarchy.hierarchy(*make(spark, parents, files)).cache()
    got = {(r.node_kind, r.node_id): r for r in nodes.collect()}
    want = walk(parents)
    for v, (state, depth, root) in want.items():
        r = got["archive", v]
        assert (r.state, r.root_id) == (state, root)
        assert depth is None or r.depth == depth
    below = {v: {v} for v in parents}
    for v in parents:
        x = v
        while want[v][0] in ("tree", "orphan") and parents[x] in parents:
            x = parents[x]
            below[x].add(v)
    pairs = {(r.ancestor_id, r.node_kind, r.node_id) for r in hierarchy.descendants(nodes).collect()}
    plain = {(a, "archive", b) for a in parents for b in below[a] - {a}} | {(a, "file", f) for a in parents for f, p in files.items() if p in below[a] and want[p][0] in ("tree", "orphan")}
    assert pairs == plain
    assert got["file", 1].depth_level is None and {k for k, _ in got} == {"archive", "file"}


def test_long_chain_and_big_family(spark):
    parents = {i: i - 1 if 1 < i <= 12 else (None if i == 1 else 3) for i in range(1, 300)}
    got = {r.node_id: r for r in hierarchy.hierarchy(*make(spark, parents, {1: 12})).where("node_kind = 'archive'").collect()}
    assert got[12].depth == 11 and got[3].n_descendants == 297 and got[12].path.startswith("/a1/a2/a3/")
    spans = sorted((r.lft, r.rgt) for r in got.values())
    assert all(a[1] >= b[1] or a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_empty(spark):
    a, f = make(spark, {1: None}, {1: None})
    assert hierarchy.hierarchy(a.limit(0), f.limit(0)).count() == 0


def test_digests_and_contents(spark):
    h = "ab" * 32
    rows = [(5, None, None, None, 10, h, "p1"), (3, None, None, None, None, f"SHA256:{h.upper()}", "p2"), (4, None, None, None, -1, f" {h}\n", "p3"), (6, None, None, None, 70000, "cd" * 32, "p4"), (7, None, None, None, 9, None, "p5"), (8, None, None, None, 0, "ef" * 32, "p6"), (5, None, None, None, 10, h, "p1")]
    files = spark.createDataFrame(rows, FILES)
    c = compaction.consolidate(files)
    assert [(r.file_id, r.size, r.n_files) for r in c.collect()] == [(3, 10, 3)]
    assert {(r.file_id, r.content_id) for r in compaction.trace(files, c).collect()} == {(3, 3), (4, 3), (5, 3)}
    assert compaction.consolidate(files.limit(0)).count() == 0


def test_many_files_become_few(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.range(1000).withColumn("x", F.when(F.col("id") % 3 == 0, None).otherwise("v")).repartition(40).write.parquet(src)
    out = scratch_path(spark, "few").removeprefix("file:")
    df = spark.read.parquet(src)
    assert compaction.compact(df.unionByName(df), out)["n"] == 2000
    assert len(spark.read.parquet(out).inputFiles()) <= 2
    assert spark.read.parquet(out).groupBy("id").count().where("count <> 2").count() == 0


def test_a_wrong_copy_is_refused(spark, monkeypatch):
    out = scratch_path(spark, "refused").removeprefix("file:")
    real = compaction.checksums
    calls = []

    def broken(df):
        calls.append(1)
        return real(df) if len(calls) == 1 else [F.lit(1).cast("bigint").alias("n"), *real(df)[1:]]

    monkeypatch.setattr(compaction, "checksums", broken)
    with pytest.raises(ValueError):
        compaction.compact(spark.range(5), out)


def below_by_walk(parents, file_parents):
    """``ancestor, kind, node, distance`` by following parents until a node comes again."""
    out = set()
    for kind, links in (("archive", parents), ("file", file_parents)):
        for v, p in links.items():
            seen, steps = ({v} if kind == "archive" else set()), 1
            while p in parents and p not in seen:
                out.add((p, kind, v, steps))
                seen.add(p)
                p, steps = parents[p], steps + 1
    return out


def test_descendants_on_and_below_cycles(spark):
    rnd = random.Random(11)
    parents = {i: rnd.choice([None, 99, *range(1, 41)]) for i in range(1, 41)}
    parents |= {7: 7, 50: 53, 51: 50, 52: 51, 53: 52, 54: 52, 55: 54, 56: 54, 57: 7, 60: 61, 61: 60}
    files = {i: rnd.choice([None, 98, *parents]) for i in range(1, 120)} | {200: 55, 201: 52}
    nodes = hierarchy.hierarchy(*make(spark, parents, files)).cache()
    rows = [tuple(r) for r in hierarchy.all_descendants(nodes).collect()]
    want = below_by_walk(parents, files)
    assert len(rows) == len(set(rows)) and set(rows) == want
    archives = {r.node_id: r for r in nodes.where("node_kind = 'archive'").collect()}
    for i, r in archives.items():
        assert r.n_descendants == sum(1 for a, *_ in want if a == i)
    for r in nodes.where("state = 'under_cycle'").collect():
        top = archives[r.top_id]
        assert top.state == "cycle" and top.lft < r.lft < r.rgt <= top.rgt


def test_chain_of_ten_thousand_and_sparse_ids(spark):
    """Rounds are logarithmic in the depth; siblings of ids far apart still come in their order."""
    step = 7_000_003 * 65_537
    parents = {i * step: (i - 1) * step if i > 1 else None for i in range(1, 10_001)}
    parents |= {-i * step: step for i in range(1, 3001)}
    got = {r.node_id: r for r in hierarchy.hierarchy(*make(spark, parents, {1: step, 2: None}), paths=False).where("node_kind = 'archive'").collect()}
    assert got[10_000 * step].depth == 9999 and got[step].n_descendants == 13_000 and got[step].top_rgt == got[step].rgt == 13_002
    kids = [got[-i * step] for i in range(3000, 0, -1)] + [got[2 * step]]
    assert [r.lft for r in kids] == list(range(3, 3 + len(kids)))


def test_long_way_into_a_cycle(spark):
    """Chains into cycles that are longer than any chain in a tree."""
    parents = {1: 2, 2: 3, 3: 1} | {i: i - 1 for i in range(4, 200)} | {300: None}
    got = {r.node_id: r for r in hierarchy.hierarchy(*make(spark, parents, {1: 199})).where("node_kind = 'archive'").collect()}
    assert got[199].depth == 196 and got[199].state == "under_cycle" and got[199].root_id == 1 and got[199].top_id == 3
    assert got[3].n_descendants == got[1].n_descendants == 199 and got[4].n_descendants == 196
    assert [got[i].rgt - got[i].lft for i in (1, 2, 3)] == [1, 1, 198]


def test_files_reach_the_target(spark, tmp_path):
    """28 MB in 40 files over 8 cores become one file of the default target, and few of a smaller one."""
    src = str(tmp_path / "src")
    spark.range(440_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).repartition(40).write.parquet(src)
    df = spark.read.parquet(src)
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    assert compaction.compact(df, str(tmp_path / "one"))["n"] == 440_000
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.parallelismFirst") == kept
    assert len(spark.read.parquet(str(tmp_path / "one")).inputFiles()) == 1
    compaction.compact(df, str(tmp_path / "some"), target_bytes=8 << 20)
    sizes = [p.stat().st_size for p in (tmp_path / "some").glob("*.parquet")]
    assert 2 <= len(sizes) <= 6 and max(sizes) < 16 << 20


def test_a_failed_commit_leaves_the_old_data(spark, tmp_path, monkeypatch):
    out = tmp_path / "out"
    compaction.compact(spark.range(3), str(out))
    compaction.compact(spark.range(4), str(out))
    assert spark.read.parquet(str(out)).count() == 4

    def lost(s, stage, path):
        return compaction_replace(s, stage + "-lost", path)

    compaction_replace = compaction.replace_path
    monkeypatch.setattr(compaction, "replace_path", lost)
    with pytest.raises(Exception):
        compaction.compact(spark.range(9), str(out))
    assert spark.read.parquet(str(out)).count() == 4 and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_contents_laid_in_containers(spark):
    items = spark.createDataFrame([(i * 10**12, 1 + i % 7) for i in range(500)], "file_id bigint, size bigint")
    got = {r.file_id: (r.container, r.begin) for r in compaction.in_containers(items, 100).collect()}
    at = 0
    for i in range(500):
        assert got[i * 10**12] == (at // 100, at % 100)
        at += 1 + i % 7
