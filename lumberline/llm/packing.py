"""Documents into containers of fixed capacity, with balanced cost and little unused space.

The cost of a document of n tokens in a container of capacity c is ``n + n * n / c``: a linear part and the quadratic
part of attention.  Documents, longest first, go to the container of lowest cost that still has room, out of those a
pass has opened; what fits in none of them goes to the next pass.  How many a pass opens is a trade of balance against
fill, so each share of ``OPEN_SHARES`` is tried: the fewest containers win, then the most even cost.  A document longer
than the capacity is the only kind that is cut: into full containers of its own and a rest that is packed like any
other document.

Packing is local to shards.  A shard is a pseudo-random set of documents that fills about ``SHARD_CONTAINERS``
containers, whatever the size of the corpus, so a task's group has a bound and the space lost at a shard's end is a
fraction of one container in that many.

Defined cases: null and empty texts have no tokens and go, with a length of 0, to any container with the others; with
no other document they share one; repeated rows of a document count once; an empty table gives no rows; ties go by id.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.llm.tokens import one_row_each

#: Containers, and documents, that a shard has about.
SHARD_CONTAINERS = 2048
SHARD_DOCUMENTS = 100_000
#: Shares of the containers that what is left needs which a pass may open.
OPEN_SHARES = (1.0, 0.3, 0.1)


def costs(tokens: np.ndarray, box: np.ndarray, capacity: int) -> np.ndarray:
    """Cost of each container."""
    return np.bincount(box, weights=tokens + tokens * (tokens / capacity))


def pack_shard(tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container and start of each item (all of at most ``capacity`` tokens); items must be in descending order."""
    tried = [_pack_by(tokens, capacity, share) for share in OPEN_SHARES]
    return min(tried, key=lambda t: (int(t[0].max()) if len(tokens) else 0, float(costs(tokens, t[0], capacity).std()) if len(tokens) else 0.0))


def _pack_by(tokens: np.ndarray, capacity: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """``pack_shard`` in passes over what is left, each of which opens ``share`` of the containers it needs.

    An item that fits in none of them waits for the next pass, so the small items of a pass fill what its large ones
    left.  Containers too full for the item at hand are parked by their room and come back for the first item that
    fits: each step costs a logarithm.
    """
    n = len(tokens)
    box, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
    sizes, todo, opened = tokens.tolist(), list(range(n)), 0
    while todo:
        total = sum(sizes[i] for i in todo)
        k = max(1, math.ceil(total / capacity * share))
        used, cost = [0] * k, [0.0] * k
        heap: list[tuple[float, int]] = [(0.0, b) for b in range(k)]
        parked: list[tuple[int, int]] = []
        left = []
        for i in todo:
            t = sizes[i]
            while parked and -parked[0][0] >= t:
                b = heapq.heappop(parked)[1]
                heapq.heappush(heap, (cost[b], b))
            while heap and used[heap[0][1]] + t > capacity:
                b = heapq.heappop(heap)[1]
                heapq.heappush(parked, (used[b] - capacity, b))
            if not heap:
                left.append(i)
                continue
            b = heap[0][1]
            box[i], start[i] = opened + b, used[b]
            used[b] += t
            cost[b] += t + t * t / capacity
            heapq.heapreplace(heap, (cost[b], b))
        opened += k
        todo = left
    return box, start


def pack(counts: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """``target_id, container, doc_id, piece, n_pieces, start, n_tokens``: where each piece of each document lies.

    ``counts`` has ``key`` and ``n_tokens``; ``targets`` ``target_id`` and ``capacity_tokens``, a small table of
    container kinds that is read to the driver (a null or non-positive capacity is no kind).  ``container`` is text:
    the shard and a number in it, or the document's own number for the full containers of a long one.
    """
    spark = counts.sparkSession
    counts = one_row_each(counts.select(key, "n_tokens"), key)
    kinds = targets.where(F.col("target_id").isNotNull() & (F.col("capacity_tokens") > 0)).select("target_id", "capacity_tokens").dropDuplicates(["target_id"])
    n_docs, n_tokens = counts.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    shards = [(t, c, max(1, -(-n_tokens // (c * SHARD_CONTAINERS)), -(-n_docs // SHARD_DOCUMENTS))) for t, c in kinds.collect()]
    kind_type = dict(kinds.dtypes)
    d = counts.select(F.col(key), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n"))
    # One row of each document for each kind: an array in the row, not a join.
    if not shards:
        return spark.createDataFrame([], f"target_id {kind_type['target_id']}, container string, {key} {dict(counts.dtypes)[key]}, piece bigint, n_pieces bigint, start bigint, n_tokens bigint")
    lit = F.array(*[F.struct(F.lit(t).cast(kind_type["target_id"]).alias("target_id"), F.lit(c).cast("bigint").alias("capacity"), F.lit(n).cast("bigint").alias("shards")) for t, c, n in shards])
    d = d.select("*", F.explode(lit).alias("k")).select(key, "n", "k.*")
    d = d.withColumn("full", F.expr("n div capacity")).withColumn("rest", F.col("n") - F.col("full") * F.col("capacity"))
    d = d.withColumn("n_pieces", F.greatest(F.lit(1).cast("bigint"), F.col("full") + (F.col("rest") > 0).cast("bigint")))
    whole = d.where(F.col("full") > 0).select("target_id", key, "n_pieces", "capacity", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece"))
    whole = whole.select("target_id", F.concat(F.lit("d"), F.col(key).cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container"), key, "piece", "n_pieces", F.lit(0).cast("bigint").alias("start"), F.col("capacity").alias("n_tokens"))
    rest = d.where((F.col("rest") > 0) | (F.col("full") == 0))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64(key, F.lit(7)), F.col("shards")))
    kt = dict(counts.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rest", key], ascending=[False, True], kind="stable")
        box, start = pack_shard(pdf["rest"].to_numpy(np.int64), int(pdf["capacity"].iloc[0]))
        shard = int(pdf["shard"].iloc[0])
        return pd.DataFrame({"target_id": pdf["target_id"], "container": [f"s{shard}-{b}" for b in box], key: pdf[key], "piece": pdf["full"], "n_pieces": pdf["n_pieces"], "start": start, "n_tokens": pdf["rest"]})

    packed = rest.select("target_id", "capacity", "shard", key, "full", "rest", "n_pieces").groupBy("target_id", "shard").applyInPandas(run, f"target_id {kind_type['target_id']}, container string, {key} {kt}, piece bigint, n_pieces bigint, start bigint, n_tokens bigint")
    return packed.unionByName(whole)


def packing_report(packed: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """``target_id, n_documents, n_containers, fill, mean_cost, sd_cost, most, whole``: how well each kind is packed.

    ``most``: no container holds more than its capacity; ``whole``: no document is in two containers, unless it is
    longer than the capacity.  Costs are those of the packed pieces, as ``pack_shard`` has them.
    """
    d = packed.join(F.broadcast(targets.select("target_id", F.col("capacity_tokens").alias("c")).dropDuplicates(["target_id"])), "target_id")
    n = F.col("n_tokens")
    boxes = d.groupBy("target_id", "container", "c").agg(F.sum("n_tokens").alias("used"), F.sum(n + n * n / F.col("c")).alias("cost"))
    by_box = boxes.groupBy("target_id").agg(F.count("*").alias("n_containers"), (F.sum("used") / F.sum("c")).alias("fill"), F.avg("cost").alias("mean_cost"), F.stddev_pop("cost").alias("sd_cost"), F.bool_and(F.col("used") <= F.col("c")).alias("most"))
    docs = d.groupBy("target_id", key, "c").agg(F.count("*").alias("pieces"), F.max("n_pieces").alias("k"), F.sum("n_tokens").alias("n"))
    fit = (F.col("pieces") == F.col("k")) & (F.col("k") == F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("c"))))
    by_doc = docs.groupBy("target_id").agg(F.count("*").alias("n_documents"), F.bool_and(fit).alias("whole"))
    return by_doc.join(by_box, "target_id")
