"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries search it greedily.

Equal vectors are one node. A first graph comes from blocks of vectors that are
next to each other in the order of random-projection signs. Each round of
NN-descent gathers, for every node, its neighbours and those that it is a
neighbour of, compares them with each other, and keeps the nearest of each;
rounds go on until few edges change. A query walks the graph from seeds: it looks at the neighbours of its nearest
nodes that it has not looked at, until its best ones are all looked at. All
vectors are indexed; recall is measured in the tests.

Precision: vectors travel as they are and are compared in double precision. Each
block of them is moved to its own mean first, so that neither a common offset
nor far-off vectors cost digits, and divided by the largest magnitude, so that
squares neither overflow nor vanish. Signs for the first blocks are taken around
the medians of a bounded sample (``SAMPLE`` vectors). Rounds end after ``ROUNDS``
at the latest.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, as queries or candidates; those of another length than
most (of equally frequent lengths the smallest) neither. Ties go to the smaller id. Rows that share an id and a
vector count once. Fewer candidates than asked: all that are found. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import materialize, release, skew_join, table

#: Neighbours of a node; those that a node is a neighbour of, for the local join.
DEGREE, REVERSE = 32, 32
#: Rounds go on until less than this share of the graph's edges is new, and no longer than ROUNDS.
SETTLED, ROUNDS = 0.02, 16
#: Vectors whose projections tell where the signs of the first blocks change.
SAMPLE = 1_000
#: Orders that the first graph comes from, and how many vectors in a row are compared.
ORDERS, BLOCK = 4, 256
#: Nodes that a query keeps, looks at in one round, and starts from besides its own.
BEAM, STEP, SEEDS = 256, 48, 16


def valid(v: Column) -> Column:
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(whole, F.lit(False)) & F.exists(v, lambda x: x != 0)


def distance(a: Column, b: Column) -> Column:
    """Euclidean, in double precision."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _nearest(ids: np.ndarray, x: np.ndarray, k: int, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst, squared distance by ``scale``) of the k nearest to each of the rows among the others."""
    x = x / scale
    x = x - x.mean(0)
    square = (x * x).sum(1)
    d = np.maximum(square[:, None] + square[None, :] - 2 * (x @ x.T), 0)
    np.fill_diagonal(d, np.inf)
    k = min(k, len(ids) - 1)
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    src, dst = np.repeat(np.arange(len(ids)), k), near.ravel()
    # What is far nearer than the block is wide has lost digits above: these few are told by their differences.
    d = d[src, dst]
    close = np.flatnonzero(d < 1e-6 * (square[src] + square[dst]))
    for at in range(0, len(close), 4096):
        some = close[at : at + 4096]
        d[some] = ((x[src[some]] - x[dst[some]]) ** 2).sum(1)
    return ids[src], ids[dst], d


#: Neighbours of a node travel as one binary of these.
NEAR = np.dtype([("dst", "<i8"), ("d", "<f8")])
PACKED = "src long, near binary"


def _batch(src: np.ndarray, dst: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    """Edges, those of one ``src`` next to each other, packed in one row for each run of a ``src``."""
    near = np.empty(len(src), NEAR)
    near["dst"], near["d"] = dst, d
    first = np.flatnonzero(np.diff(src, prepend=src[0] - 1)) if len(src) else np.zeros(0, np.int64)
    offsets = np.append(first, len(src)).astype(np.int32) * NEAR.itemsize
    packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(near.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(src[first].astype(np.int64)), packed], names=["src", "near"])


def _in_blocks(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """Compares the vectors of consecutive rows, BLOCK at a time."""
    ids, rows = np.zeros(0, np.int64), None
    for batch in batches:
        ids = np.concatenate((ids, batch.column(0).to_numpy()))
        x = _matrix(batch.column(1))
        rows = x if rows is None or not len(rows) else np.concatenate((rows, x))
        while len(ids) >= 2 * BLOCK:
            yield _batch(*_nearest(ids[:BLOCK], rows[:BLOCK], DEGREE, scale))
            ids, rows = ids[BLOCK:], rows[BLOCK:]
    if len(ids) > 1:
        yield _batch(*_nearest(ids, rows, DEGREE, scale))


def _local_join(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """Rows (mid, id, vector, worst) come sorted by mid; the vectors of a mid are compared with each other.

    Only what can enter the DEGREE nearest of a node goes on: its nearest here, no further than its ``worst`` one yet.
    """
    mids, ids, worst, rows = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), None

    def joined(upto: int) -> Iterator[pa.RecordBatch]:
        cuts = [0, *(np.flatnonzero(np.diff(mids[:upto])) + 1).tolist(), upto]
        found = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                src, dst, d = _nearest(ids[a:b], rows[a:b], DEGREE, scale)
                keep = d <= np.repeat(worst[a:b], len(d) // (b - a))
                found.append((src[keep], dst[keep], d[keep]))
        if found:
            yield _batch(*(np.concatenate([f[i] for f in found]) for i in range(3)))

    for batch in batches:
        mids = np.concatenate((mids, batch.column(0).to_numpy()))
        ids = np.concatenate((ids, batch.column(1).to_numpy()))
        x = _matrix(batch.column(2))
        rows = x if rows is None or not len(rows) else np.concatenate((rows, x))
        worst = np.concatenate((worst, batch.column(3).to_numpy()))
        if len(mids):
            whole = int(np.searchsorted(mids, mids[-1]))  # the last mid may go on
            yield from joined(whole)
            mids, ids, worst, rows = mids[whole:], ids[whole:], worst[whole:], rows[whole:]
    if len(mids):
        yield from joined(len(mids))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows come sorted by src; of each src the DEGREE nearest stay, as (src, dst, d)."""
    held_src, held = np.zeros(0, np.int64), np.zeros(0, NEAR)

    def least(src: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((near["d"], near["dst"], src))
        src, near = src[order], near[order]
        once = np.ones(len(src), bool)
        once[1:] = (src[1:] != src[:-1]) | (near["dst"][1:] != near["dst"][:-1])
        src, near = src[once], near[once]
        order = np.lexsort((near["dst"], near["d"], src))
        src, near = src[order], near[order]
        first = np.flatnonzero(np.diff(src, prepend=src[0] - 1))
        keep = np.arange(len(src)) - np.repeat(first, np.diff(np.append(first, len(src)))) < DEGREE
        return pa.RecordBatch.from_pydict({"src": src[keep], "dst": near["dst"][keep].astype(np.int64), "d": near["d"][keep]})

    for batch in batches:
        data = batch.column(1).to_pylist()
        held_src = np.concatenate((held_src, np.repeat(batch.column(0).to_numpy(), [len(x) // NEAR.itemsize for x in data])))
        held = np.concatenate((held, np.frombuffer(b"".join(data), NEAR)))
        if len(held):
            whole = int(np.searchsorted(held_src, held_src[-1]))  # the last src may go on
            if whole:
                yield least(held_src[:whole], held[:whole])
            held_src, held = held_src[whole:], held[whole:]
    if len(held):
        yield least(held_src, held)


def _merged(packed: DataFrame) -> DataFrame:
    return packed.repartition(F.col("src")).sortWithinPartitions("src").mapInArrow(_merge, "src long, dst long, d double")


def _top(edges: DataFrame, by: str, k: int) -> DataFrame:
    """The k edges of least length of each ``by``."""
    other = "dst" if by == "src" else "src"
    place = F.row_number().over(Window.partitionBy(by).orderBy("d", other))
    return edges.withColumn("place", place).where(F.col("place") <= k).drop("place")


def neighbour_graph(nodes: DataFrame, dim: int) -> DataFrame:
    """(src, dst, d): about the DEGREE nearest nodes of each of ``nodes`` (id, v)."""
    parts = max(2, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    top = nodes.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("top")).head()["top"]
    scale = float(top or 1.0)
    some = nodes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()  # SAMPLE rows
    sample = np.array([r["v"] for r in some], np.float64).reshape(-1, dim) / scale

    def signed(seed: int):  # noqa: ANN202
        planes = np.random.default_rng(seed).standard_normal((dim, 24))
        middle = np.median(sample @ planes, axis=0) if len(sample) else np.zeros(24)

        @F.pandas_udf("long")
        def code(v):  # noqa: ANN001
            import pandas as pd

            bits = (np.stack(v.to_list()).astype(np.float64) / scale @ planes > middle) if len(v) else np.zeros((0, 24), bool)
            return pd.Series(bits @ (1 << np.arange(23, -1, -1)).astype(np.int64))

        return code

    edges = None
    for seed in range(ORDERS):
        coded = nodes.withColumn("code", signed(seed)("v"))
        blocks = coded.repartitionByRange(parts, "code", "id").sortWithinPartitions("code", "id").select("id", "v").mapInArrow(lambda b: _in_blocks(b, scale), PACKED)
        edges = blocks if edges is None else edges.unionByName(blocks)
    edges = materialize(_merged(edges), "graph")
    for _ in range(ROUNDS):
        back = _top(edges, "dst", REVERSE).select(F.col("dst").alias("mid"), F.col("src").alias("id"))
        # A node is compared with its own neighbours too, which brings its edges along.
        around = edges.select(F.col("src").alias("mid"), F.col("dst").alias("id")).unionByName(back).unionByName(nodes.select(F.col("id").alias("mid"), "id")).distinct()
        # Distances of the same pair differ in the last digits from block to block.
        worst = edges.groupBy(F.col("src").alias("id")).agg(F.when(F.count("*") >= DEGREE, F.max("d") * 1.0001).alias("worst"))
        held = nodes.join(worst, "id", "left").select("id", "v", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
        met = around.join(held, "id").select("mid", "id", "v", "worst").repartition(F.col("mid")).sortWithinPartitions("mid", "id")
        grown = materialize(_merged(met.mapInArrow(lambda b: _local_join(b, scale), PACKED)), "graph")
        new = grown.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").count()
        edges = grown
        release(nodes.sparkSession)
        if new <= SETTLED * edges.count():
            break
    return edges


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, keep: int = BEAM) -> DataFrame:
    """(q, id, d): nodes near the ``queries`` (q, node, qv), by greedy search from ``node`` and from common seeds."""
    # A graph holds a link in both directions for the search.
    links = edges.select("src", "dst").unionByName(_top(edges, "dst", REVERSE).select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seeds = nodes.orderBy(F.xxhash64("id"), "id").limit(SEEDS if keep >= SEEDS else keep).select("id")
    near = lambda pairs: pairs.join(nodes, "id").join(queries.select("q", "qv"), "q").where(F.size("v") == F.size("qv")).select("q", "id", distance(F.col("v"), F.col("qv")).alias("d"))
    start = queries.select("q", F.col("node").alias("id")).unionByName(queries.select("q").join(F.broadcast(seeds)))  # SEEDS rows
    state = materialize(near(start.distinct()).withColumn("seen", F.lit(False)), "search")
    by_query = Window.partitionBy("q").orderBy("d", "id")
    while True:
        ranked = state.withColumn("place", F.row_number().over(by_query)).where(F.col("place") <= keep)
        fresh = F.sum((~F.col("seen")).cast("int")).over(by_query.rowsBetween(Window.unboundedPreceding, 0))
        ranked = materialize(ranked.withColumn("look", ~F.col("seen") & (fresh <= STEP)), "search")
        looked = ranked.where("look")
        if not looked.head(1):
            break
        found = looked.select("q", F.col("id").alias("src")).join(links, "src").select("q", F.col("dst").alias("id")).distinct().join(ranked.select("q", "id"), ["q", "id"], "left_anti")
        state = ranked.select("q", "id", "d", (F.col("seen") | F.col("look")).alias("seen")).unionByName(near(found).withColumn("seen", F.lit(False)))
    return state.select("q", "id", "d")


def nearest(vectors: DataFrame, ident: str, vector: str, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query among all other rows."""
    rows = vectors.where(F.col(ident).isNotNull() & valid(F.col(vector))).select(F.col(ident).alias("vec_id"), F.col(vector).alias("v"), is_query.alias("is_query"))
    classes = rows.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    nodes = materialize(classes, "nodes")
    size = nodes.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").head()
    if size is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    nodes = nodes.where(F.size("v") == size["dim"])
    # A vector that very many rows have is met where these are.
    members = materialize(skew_join(rows, nodes.select("v", "id", "n"), "v", "n").select("id", "vec_id", "is_query").distinct(), "members")
    nodes = nodes.drop("n")
    edges = neighbour_graph(nodes, size["dim"])
    asked = members.where("is_query").select("id").distinct()
    queries = asked.join(nodes, "id").select(F.col("id").alias("q"), F.col("id").alias("node"), F.col("v").alias("qv"))
    found = search(materialize(queries, "queries"), nodes, edges, max(BEAM, k + 1))
    # Of equal vectors the k + 1 smallest ids are enough; a large class is thinned in shares first.
    share = Window.partitionBy("id", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    least = members.select("id", "vec_id").withColumn("p", F.row_number().over(share)).where(F.col("p") <= k + 1)
    least = least.withColumn("p", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).where(F.col("p") <= k + 1).select("id", "vec_id")
    found = found.withColumn("p", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).where(F.col("p") <= k + 1)
    reached = found.join(least, "id").select("q", "vec_id", "d")
    reached = reached.withColumn("p", F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))).where(F.col("p") <= k + 1).select("q", "vec_id", "d")
    by_query = Window.partitionBy("query_id").orderBy("d", "vec_id")
    out = members.where("is_query").select(F.col("id").alias("q"), F.col("vec_id").alias("query_id")).join(reached, "q").where("vec_id <> query_id")
    return out.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("d").alias("score"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.pmod(F.col("vec_id"), F.lit(100)) == 0)


QUERIES = {"op7_nearest_neighbours": op7_nearest_neighbours}
ORACLES: dict[str, str] = {}
