"""Parent-child links to full hierarchies: path, depth, root, nested-set ranges, and the links that lead nowhere.

Upward, every node's subtree size is summed up over doubling distances: after k rounds a node knows the sum over all
that lies below it by less than 2 ** k links, and hands it to its ancestor 2 ** k links up.  A node whose chain of
parents has ended is done; the round in which none ends leaves the nodes on and below cycles, all of them and only
they.  Downward, a node's range begins after its parent, the parent's own leaves and the sizes of the siblings ahead of
it: prefix sums along the chain, again over doubling distances.  There are as many rounds as the depth has binary
digits, so a chain of a million links takes twenty, and a round rewrites only what is still open.

Prefix sums over siblings run in range partitions of (parent, id), so neither a parent with a third of all children nor
an archive with a third of all files ends up in one task, however sparse the ids are.  A join on a parent or an ancestor
has one row for each node on its other side, so adaptive execution can split a parent that many rows point to.

``lft`` and ``rgt`` hold in the tree of ``top_id``: b lies below a if both have one ``top_id`` and
``a.lft < b.lft < a.rgt``.  A ring of parent links is a tree for each member, which holds what hangs off that member;
below a member of a ring are the other members and all that hangs off any of them (``root_id`` is the same for all of
it), but not itself.

Defined cases: rows with a null id are no nodes; repeated rows of an id count once (where they differ, the largest
value counts); a null name appears as ``#id``; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumberline.session import cut, cut_counting

_LONG = "bigint"


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _ahead(d: DataFrame, parent: str, weight) -> DataFrame:
    """The rows with a parent, and ``ahead``: the sum of ``weight`` over the siblings with a smaller id.

    ``_b`` of a row is its range partition of (parent, id): what one window holds.
    """
    d = d.where(F.col(parent).isNotNull()).withColumn("_w", weight)
    sums = d.groupBy(parent, "_b").agg(F.sum("_w").alias("_s"))
    sums = sums.withColumn("_a", F.sum("_s").over(Window.partitionBy(parent).orderBy("_b")) - F.col("_s")).drop("_s")
    inner = F.sum("_w").over(Window.partitionBy(parent, "_b").orderBy("id")) - F.col("_w")
    return d.withColumn("_in", inner).join(sums, [parent, "_b"]).withColumn("ahead", F.col("_in") + F.col("_a")).drop("_w", "_b", "_in", "_a")


def _sums_below(links: DataFrame, n_links: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Of links ``id, up, s``: ``id, below``, the sum of ``s`` over all below each node that a link leads to, for nodes
    on no cycle; and ``id, parent`` of those that are on one, or None if there are none."""
    spark, at, n, rounds, ring = links.sparkSession, links, n_links, [], None
    while n:
        rounds.append(at.groupBy(F.col("up").alias("id")).agg(F.sum("s").alias("below")))
        ahead = at.select(F.col("id").alias("up"), F.col("up").alias("_up"))
        nxt = at.join(ahead, "up").join(rounds[-1], "id", "left").select("id", F.col("_up").alias("up"), (F.col("s") + F.coalesce("below", F.lit(0))).alias("s"))
        nxt, left = cut_counting(spark, nxt, "tree-up", F.lit(True))
        if left == n and (ring := _cycles(nxt, links)) is not None:
            break
        at, n = nxt, left
    return _union(rounds).groupBy("id").agg(F.sum("below").cast(_LONG).alias("below")) if rounds else None, ring


def _cycles(far: DataFrame, links: DataFrame) -> DataFrame | None:
    """``id, parent`` of the nodes on cycles, of ``id, up`` some way up the chains that never end.

    Where links of that length lead are the cycles' own nodes if the parents of these are as many, else None: a chain
    into a cycle is longer than the way.
    """
    on = far.select(F.col("up").alias("id")).distinct().join(links.select("id", F.col("up").alias("parent")), "id")
    on, n = cut_counting(far.sparkSession, on, "tree-rings", F.lit(True))
    return on if on.select("parent").distinct().count() == n else None


def _cycle_roots(cyclic: DataFrame) -> DataFrame:
    """``id, ring, ring_at`` of ``id, parent`` on cycles: the smallest id on each, by minima over 1, 2, 4, ... steps
    until none changes, and how many steps up it is."""
    spark = cyclic.sparkSession
    at = cyclic.select("id", F.col("parent").alias("nxt"), F.col("id").alias("m"), F.lit(0).cast(_LONG).alias("o"))
    steps = 1
    while True:
        ahead = at.select(F.col("id").alias("nxt"), F.col("nxt").alias("_n"), F.col("m").alias("_m"), F.col("o").alias("_o"))
        less = F.col("_m") < F.col("m")
        new = at.join(ahead, "nxt").select("id", F.col("_n").alias("nxt"), F.least("m", "_m").alias("m"), F.when(less, F.col("_o") + steps).otherwise(F.col("o")).alias("o"), less.alias("changed"))
        new, n_changed = cut_counting(spark, new, "tree-cycles", F.col("changed"))
        at, steps = new.drop("changed"), steps * 2
        if not n_changed:
            return at.select("id", F.col("m").alias("ring"), F.col("o").alias("ring_at"))


def _placed(nodes: DataFrame, n_open: int) -> DataFrame:
    """``nodes`` (``id, up, off, depth, path, top_id, top_rgt, root_id, state``) with everything summed up along the
    chain: those with ``up`` take over what the ancestor there has."""
    spark, tables = nodes.sparkSession, [nodes]
    while n_open:
        act = tables[-1].where(F.col("up").isNotNull())
        done = _union([t.where(F.col("up").isNull()) for t in tables])
        ahead = done.unionByName(act).select(*[F.col(c).alias(f"_{c}") for c in nodes.columns])
        j = act.join(ahead, F.col("up") == F.col("_id"))
        add = lambda c: (F.col(c) + F.col(f"_{c}")).alias(c)
        path = [F.concat("_path", "path").alias("path")] if "path" in nodes.columns else []
        nxt = j.select("id", F.col("_up").alias("up"), add("off"), add("depth"), *path, *[F.col(f"_{c}").alias(c) for c in ("top_id", "top_rgt", "root_id", "state")])
        nxt, n_open = cut_counting(spark, nxt, "tree-down", F.col("up").isNotNull())
        tables.append(nxt)
    return _union([t.where(F.col("up").isNull()) for t in tables]).drop("up")


def archive_tree(archives: DataFrame, files: DataFrame, paths: bool = True) -> DataFrame:
    """A row for each archive: ``id, depth_level, state, [path,] depth, root_id, top_id, top_rgt, lft, size, leaves,
    n_descendants, ring_at``.

    ``ring_at``: steps up from a member of a cycle to the smallest id on it.  ``top_rgt``: ``rgt`` of the node ``top_id``.
    ``state``: ``tree``, ``orphan`` (the chain ends at the id ``root_id``, which doesn't exist), ``cycle`` or
    ``under_cycle``.  Depth and ranges of an orphan count from the top that is there, those below a cycle from it.
    """
    spark = archives.sparkSession
    a = archives.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("parent_archive_id").alias("want"), F.max("depth_level").alias("depth_level"), *([F.max("original_name").alias("name")] if paths else []))
    leaves = files.where(F.col("id").isNotNull() & F.col("parent_archive_id").isNotNull()).groupBy("id").agg(F.max("parent_archive_id").alias("_p"))
    leaves = leaves.groupBy(F.col("_p").alias("id")).agg(F.count("*").alias("leaves"))
    there = archives.where(F.col("id").isNotNull()).select(F.col("id").alias("want"), F.lit(True).alias("_ok")).distinct()
    a = a.join(there, "want", "left").withColumn("parent", F.when(F.col("_ok"), F.col("want"))).drop("_ok")
    a = a.join(leaves, "id", "left").withColumn("leaves", F.coalesce("leaves", F.lit(0).cast(_LONG)))
    a, n_links = cut_counting(spark, a, "tree-nodes", F.col("parent").isNotNull())
    links = a.where(F.col("parent").isNotNull()).select("id", F.col("parent").alias("up"), (F.lit(1) + F.col("leaves")).alias("s"))
    below, on = _sums_below(links, n_links)
    with ThreadPoolExecutor(1) as other:  # which cycle a node is on is asked for at the end only
        ring = None if on is None else other.submit(_cycle_roots, on)
        known = a.withColumn("below", F.lit(0).cast(_LONG)) if below is None else a.join(below, "id", "left")
        own = F.lit(1).cast(_LONG) + F.col("leaves")
        if on is None:
            known = known.withColumn("up", F.col("parent")).withColumn("cyclic", F.lit(False)).withColumn("size", own + F.coalesce("below", F.lit(0)))
        else:
            known = known.join(on.select("id", F.lit(True).alias("cyclic")), "id", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
            # The links between members of a cycle are cut; a member's own tree is what its other children have.
            hang = known.where(~F.col("cyclic") & F.col("parent").isNotNull()).select(F.col("parent").alias("id"), (own + F.coalesce("below", F.lit(0))).alias("_s"))
            hang = hang.join(on.select("id"), "id", "left_semi").groupBy("id").agg(F.sum("_s").alias("hang"))
            known = known.join(hang, "id", "left").withColumn("size", own + F.coalesce(F.when(F.col("cyclic"), F.col("hang")).otherwise(F.col("below")), F.lit(0))).drop("hang")
            known = known.withColumn("up", F.when(~F.col("cyclic"), F.col("parent")))
        known = cut(spark, known.drop("below", "parent").repartitionByRange("up", "id").withColumn("_b", F.spark_partition_id()), "tree-sizes")
        over = known.select(F.col("id").alias("up"), F.col("leaves").alias("_l"))
        d = _ahead(known, "up", F.col("size")).join(over, "up", "left")
        state = F.when(F.col("cyclic"), "cycle").when(F.col("want").isNotNull(), "orphan").otherwise("tree")
        top = F.col("up").isNull()
        path = [F.concat(F.lit("/"), F.coalesce("name", F.concat(F.lit("#"), F.col("id").cast("string")))).alias("path")] if paths else []
        d = d.unionByName(known.where(top).withColumns({"ahead": F.lit(None).cast(_LONG), "_l": F.lit(None).cast(_LONG)}).drop("_b")).select(
            "id", "up", F.when(top, 1).otherwise(F.lit(1) + F.col("_l") + F.col("ahead")).cast(_LONG).alias("off"), F.when(top, 0).otherwise(1).cast(_LONG).alias("depth"), *path, F.when(top, F.col("id")).alias("top_id"),
            F.when(top, F.col("size") + 1).alias("top_rgt"), F.when(top, F.coalesce(F.when(~F.col("cyclic"), F.col("want")), "id")).alias("root_id"), F.when(top, state).alias("state"),
        )
        d, n_open = cut_counting(spark, d, "tree-layer", ~top)
        placed = _placed(d, n_open).withColumnRenamed("off", "lft")
        out = placed.join(known.select("id", "depth_level", "size", "leaves", "cyclic"), "id")
        more = {c: F.lit(None).cast(_LONG) for c in ("ring", "ring_at", "ring_size")}
        if ring is not None:
            r = ring.result().join(known.select("id", "size"), "id")
            r = r.join(r.groupBy("ring").agg(F.sum("size").alias("ring_size")), "ring").select(F.col("id").alias("top_id"), "ring", "ring_at", "ring_size")
            out = out.join(r, "top_id", "left").withColumn("ring_at", F.when(F.col("cyclic"), F.col("ring_at"))).withColumn("ring_size", F.when(F.col("cyclic"), F.col("ring_size")))
        else:
            out = out.withColumns(more)
    state = F.when((F.col("state") == "cycle") & ~F.col("cyclic"), "under_cycle").otherwise(F.col("state"))
    # The range of a member of a cycle covers what hangs off it; its descendants are the whole ring's.
    return out.select("id", "depth_level", state.alias("state"), *(["path"] if paths else []), "depth", F.coalesce("ring", "root_id").alias("root_id"), "top_id", "top_rgt", "lft", "size", "leaves", (F.coalesce("ring_size", "size") - 1).alias("n_descendants"), "ring_at")


def hierarchy(archives: DataFrame, files: DataFrame, paths: bool = True) -> DataFrame:
    """A row for each archive and file: ``node_kind, node_id, path, depth_level, state, depth, root_id, top_id, top_rgt,
    lft, rgt, n_descendants, ring_at``.

    Files without an archive have their own path, depth 0 and no root.  Without ``paths`` there is no ``path``, and
    files have no range.
    """
    tree = archive_tree(archives, files, paths)
    named = ["path"] if paths else []
    top = tree.select(F.lit("archive").alias("node_kind"), F.col("id").alias("node_id"), *named, "depth_level", "state", "depth", "root_id", "top_id", "top_rgt", "lft", (F.col("lft") + F.col("size")).alias("rgt"), "n_descendants", "ring_at")
    f = files.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("parent_archive_id").alias("parent"), F.max("depth_level").alias("depth_level"), *([F.max("original_name").alias("name")] if paths else []))
    if paths:
        f = f.withColumn("name", F.coalesce("name", F.concat(F.lit("#"), F.col("id").cast("string"))))
        f = cut(archives.sparkSession, f.repartitionByRange("parent", "id").withColumn("_b", F.spark_partition_id()), "tree-files")
        f = _ahead(f, "parent", F.lit(1)).unionByName(f.where(F.col("parent").isNull()).drop("_b").withColumn("ahead", F.lit(0).cast(_LONG)))
    else:
        f = f.withColumn("ahead", F.lit(None).cast(_LONG))
    up = tree.select(F.col("id").alias("parent"), F.col("state").alias("s"), *[F.col("path").alias("p")] * paths, F.col("depth").alias("d"), "root_id", "top_id", "top_rgt", F.col("lft").alias("l"))
    d = f.join(up, "parent", "left")
    alone, lost = F.col("parent").isNull(), F.col("s").isNull()
    state = F.when(alone, "tree").when(lost, "orphan").when(F.col("s") == "cycle", "under_cycle").otherwise(F.col("s"))
    lft = F.when(alone | lost, F.lit(1)).otherwise(F.col("l") + 1 + F.col("ahead")).cast(_LONG)
    path = [F.when(alone | lost, F.concat(F.lit("/"), F.col("name"))).otherwise(F.concat_ws("/", "p", "name")).alias("path")] if paths else []
    leaf = d.select(
        F.lit("file").alias("node_kind"), F.col("id").alias("node_id"), *path, "depth_level", state.alias("state"),
        F.when(alone | lost, F.lit(0)).otherwise(F.col("d") + 1).cast(_LONG).alias("depth"), F.when(alone, None).when(lost, F.col("parent")).otherwise(F.col("root_id")).alias("root_id"),
        "top_id", "top_rgt", lft.alias("lft"), (lft + 1).alias("rgt"), F.lit(0).cast(_LONG).alias("n_descendants"), F.lit(None).cast(_LONG).alias("ring_at"),
    )
    return top.unionByName(leaf)


def findings(nodes: DataFrame) -> DataFrame:
    """``node_kind, node_id, finding, root_id`` of the nodes whose chain or depth is wrong."""
    finding = F.when(F.col("state") != "tree", F.col("state")).when(F.col("depth_level").isNotNull() & (F.col("depth_level") != F.col("depth")), "depth")
    return nodes.select("node_kind", "node_id", finding.alias("finding"), "root_id").where(F.col("finding").isNotNull())


def descendants(nodes: DataFrame) -> DataFrame:
    """``ancestor_id, node_kind, node_id, distance`` of all nodes below each archive that is in a tree or below an orphan."""
    return _within(nodes.where(F.col("state").isin("tree", "orphan")))


def all_descendants(nodes: DataFrame) -> DataFrame:
    """``descendants`` of every archive, those on and below a cycle included.

    Below a member of a cycle are the other members and what hangs off any of them; it isn't below itself.  A distance
    is the number of parent links from the node up to the archive, once around a cycle at most.
    """
    return _within(nodes, F.col("state") != "cycle").unionByName(_around(nodes.where(F.col("state").isin("cycle", "under_cycle"))))


def _around(nodes: DataFrame) -> DataFrame:
    """The pairs of the members of each cycle, out of the nodes on and below one: an equi-join on the cycle."""
    ring = nodes.where(F.col("state") == "cycle")
    long = ring.groupBy("root_id").agg(F.count("*").alias("_long"))
    above = ring.join(long, "root_id").select("root_id", F.col("node_id").alias("ancestor_id"), F.col("ring_at").alias("_a"), "_long")
    off = ring.select(F.col("node_id").alias("top_id"), F.col("ring_at").alias("_n"))
    j = nodes.join(off, "top_id").join(above, "root_id").where((F.col("node_kind") != "archive") | (F.col("node_id") != F.col("ancestor_id")))
    return j.select("ancestor_id", "node_kind", "node_id", (F.col("depth") + F.pmod(F.col("_n") - F.col("_a"), F.col("_long"))).alias("distance"))


def _within(nodes: DataFrame, above=None) -> DataFrame:
    """The pairs by ranges, of all archives or those ``above`` holds for.

    A join on nested-set ranges as an equi-join: a range is cut into blocks of powers of two, at most two of each
    size, and a node looks up the one block of each size, up to that of its tree, that holds it.  What comes out is
    every pair that is asked for, its size the sum of the depths.
    """
    inner = nodes.where(F.col("top_id").isNotNull())
    a = inner.where((F.lit(True) if above is None else above) & (F.col("node_kind") == "archive") & (F.col("n_descendants") > 0)).select(F.col("node_id").alias("ancestor_id"), "top_id", "top_rgt", F.col("depth").alias("_d"), (F.col("lft") + 1).alias("a"), F.col("rgt").alias("b"))
    levels = F.sequence(F.lit(0), F.length(F.bin("top_rgt")))

    def blocks(k):
        size = F.pow(F.lit(2), k).cast("bigint")
        lo, hi = F.ceil(F.col("a") / size).cast("bigint"), F.floor(F.col("b") / size).cast("bigint")
        left = F.when((lo < hi) & (lo % 2 == 1), lo)
        right = F.when((hi % 2 == 1) & (hi - 1 >= F.when(lo % 2 == 1, lo + 1).otherwise(lo)), hi - 1)
        return F.struct(k.alias("k"), F.array_compact(F.array(left, right)).alias("at"))

    cover = a.select("ancestor_id", "top_id", "_d", F.explode(F.transform(levels, blocks)).alias("x")).select("ancestor_id", "top_id", "_d", F.col("x.k").alias("k"), F.explode("x.at").alias("at"))
    n = inner.select("node_kind", "node_id", "top_id", "depth", "lft", F.explode(levels).alias("k"))
    n = n.withColumn("at", F.floor(F.col("lft") / F.pow(F.lit(2), F.col("k"))).cast("bigint")).drop("lft")
    j = n.join(cover, ["top_id", "k", "at"])
    return j.select("ancestor_id", "node_kind", "node_id", (F.col("depth") - F.col("_d")).alias("distance"))
