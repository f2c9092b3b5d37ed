"""N-gram Jaccard self-join by vertical partitioning.

All n-grams get one global order: those that are seen often go last, the rest
by hash. The order is cut into fragments; a set's part in a fragment is its
segment. For a pair of sets the overlap is counted in each fragment on its own
and summed per pair. Pairs that may link are found by a prefix filter: of the
first p n-grams of each set (p is a quarter of the set more than the least that
works), linked sets share so many as the overlap that they need leaves over for
the shorter prefix.

To link groups of near copies without making all their pairs, it runs twice:
first each set is compared with one pivot. An n-gram's pivot is the set of which
the largest part is shared with others (a copy without own changes); a set takes
the pivot of most of its n-grams. Then, for n-grams whose sets
are still in different components, all pairs across components are compared.
Pairs within a component need no comparison, so no link between components is
lost and the components are exact.

Equal sets are one class from the start. A class is known by 64 bits of a
128-bit hash of its set; where sets that differ share these, by the other 64.
Keys that many rows have (a class of copies, the root of a large component) are
joined by broadcast, see ``skew_join``.

Defined results: null, empty and blank texts have no shingle, are linked with
nothing and are components of their own. Repeated rows link with each other.
Rows with a null id have the smallest other id of their component, or null.
Texts of any length count whole. No rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import delete_table, release, skew_join, table, write_table
from paperloom.llm.components import components
from paperloom.llm.shingles import shingle_sets

SIZE = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
FRAGMENTS = 4
#: The part of a set by which its prefix is longer than the least that works, as 1 / LONGER. A longer prefix tells pairs
#: apart that share much and yet too little; 4 is the largest part for which _least_shared_between holds.
LONGER = 4
#: Sets counted together, and how many of them must hold an n-gram for it to be counted as frequent.
BLOCK, LEAST = 2_000, 4
#: So many frequent n-grams are told to all tasks at most (8 bytes each).
MOST_FREQUENT = 1_000_000


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


#: Hashes that sets which differ share, and that a broadcast may hold; so few that more of them are an error.
MOST_SHARED = 10_000


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    return struct.unpack("<2q", hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())


def _class(tokens: np.ndarray, shared: frozenset[int]) -> int:
    first, second = _signature(tokens)
    return second if first in shared else first


def _prefix_size(n: Column) -> Column:
    return F.least(n, n - F.ceil(n * PERCENT / 100) + 1 + F.floor(n / LONGER))


def _least_shared(n_a: Column, n_b: Column) -> Column:
    """How many n-grams the prefixes of two sets that link share at least.

    They overlap in o or more. Of these, n - p at most lie beyond a prefix of p; the prefix that ends first in the
    order has the rest, and the other prefix has them too.
    """
    o = F.ceil((n_a + n_b) * PERCENT / (100 + PERCENT))
    return F.greatest(F.lit(1), F.least(o - n_a + _prefix_size(n_a), o - n_b + _prefix_size(n_b)))


def _least_shared_between(n: Column, low: Column, high: Column) -> Column:
    """No more than _least_shared of n and of any size from low to high that may link with it.

    Of the two terms there, the first never falls with the other size. The second falls by a constant slope, with a
    ceil and a floor that move it by less than 3 in all, so no size has one less by more than 2 than the greatest size.
    """
    o = lambda m: F.ceil((n + m) * PERCENT / (100 + PERCENT))
    return F.greatest(F.lit(1), F.least(o(low) - n + _prefix_size(n), o(high) - high + _prefix_size(high) - 2))


class GlobalOrder:
    """n-grams by (frequent or not, how frequent, hash). ``frequent``: sorted hashes; ``rank``: their places; ``shared``: see _class."""

    def __init__(self, frequent: np.ndarray, count: np.ndarray, shared: frozenset[int] = frozenset()):
        self.shared = shared
        by = np.argsort(frequent)
        self.frequent = frequent[by]
        self.rank = np.empty(len(by), np.int32)
        self.rank[np.lexsort((self.frequent, count[by]))] = np.arange(1, len(by) + 1)

    def ranks(self, tokens: np.ndarray) -> np.ndarray:
        """0 for n-grams that are not frequent; tokens are sorted."""
        if not len(self.frequent):
            return np.zeros(len(tokens), np.int32)
        at = np.minimum(np.searchsorted(self.frequent, tokens), len(self.frequent) - 1)
        return np.where(self.frequent[at] == tokens, self.rank[at], 0)

    def prefix(self, tokens: np.ndarray) -> np.ndarray:
        """The first n - ceil(t n) + l tokens of a sorted set in the order."""
        n = len(tokens)
        size = min(n, n - (PERCENT * n + 99) // 100 + 1 + n // LONGER)
        ranks = self.ranks(tokens)
        rare = tokens[ranks == 0]
        if len(rare) >= size:
            return rare[:size]
        often = ranks > 0
        return np.concatenate((rare, tokens[often][np.argsort(ranks[often], kind="stable")][: size - len(rare)]))

    def fragments(self, tokens: np.ndarray) -> list[np.ndarray]:
        """Segments: frequent n-grams are the last fragment, the others are cut by ranges of the hash."""
        often = self.ranks(tokens) > 0
        cuts = [np.uint64((1 << 64) * k // (FRAGMENTS - 1)) for k in range(1, FRAGMENTS - 1)]
        rare = tokens[~often]
        return [*np.split(rare, np.searchsorted(rare, np.array(cuts, np.uint64))), tokens[often]]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: id, size and hash (both halves) of a row; kind 1: an n-gram and in how many classes of a block it is."""
    held: dict[int, np.ndarray] = {}

    def frequent() -> pa.RecordBatch:
        k, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held.values()]), return_counts=True)
        k, n = k[n >= LEAST], n[n >= LEAST]
        held.clear()
        return pa.RecordBatch.from_pydict({"kind": pa.array(np.ones(len(k)), pa.int32()), "row": _signed(k), "a": _signed(k), "b": n.astype(np.int64), "c": n.astype(np.int64), "d": n.astype(np.int64)})

    for batch in batches:
        sizes, first, second = [], [], []
        for tokens in shingle_sets(batch.column(1), SIZE):
            sizes.append(len(tokens))
            for half, value in zip((first, second), _signature(tokens)):
                half.append(value)
            if len(tokens):
                held[first[-1]] = tokens
            if len(held) >= BLOCK:
                yield frequent()
        yield pa.RecordBatch.from_pydict({"kind": pa.array([0] * len(sizes), pa.int32()), "row": batch.column(2), "a": batch.column(0), "b": pa.array(sizes, pa.int64()), "c": pa.array(first, pa.int64()), "d": pa.array(second, pa.int64())})
    yield frequent()


def _global_order(counted: DataFrame, shared: frozenset[int]) -> GlobalOrder:
    """The most frequent n-grams, MOST_FREQUENT at most: a histogram of the counts gives the least count to keep."""
    levels = counted.groupBy(F.floor(F.log2("n") * 4).alias("level")).count().orderBy(F.desc("level")).collect()
    kept, level = 0, None
    for r in levels:
        if kept + r["count"] > MOST_FREQUENT:
            break
        kept, level = kept + r["count"], r["level"]
    if level is None:
        return GlobalOrder(np.zeros(0, np.uint64), np.zeros(0, np.int64), shared)
    pdf = counted.where(F.floor(F.log2("n") * 4) >= level).toPandas()
    return GlobalOrder(pdf["a"].to_numpy(np.int64).view(np.uint64), pdf["n"].to_numpy(np.int64), shared)


#: A pivot that is compared with more sets than this is copied, so that the sets spread over tasks.
SETS_PER_PIVOT = 500


def _verified(pairs: DataFrame, rows: DataFrame, least_id: DataFrame, order: Broadcast) -> DataFrame:
    """The pairs (a, b) that link. Overlaps are counted by fragment, then summed per pair.

    Segments of b go to where the segments of a are, in one shuffle of (a, fragment, salt).
    """
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / SETS_PER_PIVOT).cast("int").alias("copies"))
    of_b = pairs.join(copies, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("salt")).join(least_id.withColumnRenamed("class", "b"), "b")
    of_a = copies.select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt")).join(least_id.withColumnRenamed("class", "a"), "a")
    asked = rows.select("id", "text").join(of_a.select("id", "a", "b", "salt").unionByName(of_b.select("id", "a", "b", "salt")), "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("a", "b", "salt", "fragment", "n", "tokens")}
            for tokens, a, b, salt in zip(shingle_sets(batch.column(0), SIZE), *(batch.column(i).to_pylist() for i in (1, 2, 3))):
                # Rows may share an id: only the one of the asked class counts.
                if len(tokens) and _class(tokens, order.value.shared) == (a if b is None else b):
                    for k, x in enumerate(order.value.fragments(tokens)):
                        if len(x):
                            for key, value in zip(out, (a, b, salt, k, len(tokens), x.tobytes())):
                                out[key].append(value)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    segments = asked.select("text", "a", "b", "salt").mapInArrow(cut, "a long, b long, salt int, fragment int, n int, tokens binary")

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivot, size = None, np.zeros(0, np.uint64), 0
        for batch in batches:
            out = []
            for a, b, salt, fragment, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = np.frombuffer(data, np.uint64)
                if b is None:
                    at, pivot, size = (a, fragment, salt), tokens, n
                elif at == (a, fragment, salt):
                    out.append((a, b, fragment, size, n, len(np.intersect1d(pivot, tokens, True))))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 6, names=["a", "b", "fragment", "n_a", "n_b", "part"])

    met = segments.repartition("a", "fragment", "salt").sortWithinPartitions("a", "fragment", "salt", F.col("b").asc_nulls_first())
    partial = met.mapInArrow(overlaps, "a long, b long, fragment long, n_a long, n_b long, part long")
    # A repeated row of an id comes twice.
    partial = partial.groupBy("a", "b", "fragment").agg(F.max("part").alias("part"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    overlap = partial.groupBy("a", "b").agg(F.sum("part").alias("overlap"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    return overlap.where(100 * F.col("overlap") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b")


class _Tables:
    """Tables of one run in the shared folder; those that later steps don't read are deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        schema, before = df.schema, self.path.get(name)
        self.path[name] = write_table(df, name)
        if before:
            delete_table(self.spark, before)
        release(self.spark)
        return self.spark.read.schema(schema).parquet(self.path[name])

    def delete(self, *names: str) -> None:
        for name in names:
            delete_table(self.spark, self.path.pop(name))


def _shared_hashes(told: DataFrame) -> frozenset[int]:
    """The first halves that sets of different hashes share: about n * n / 2**65 of n sets."""
    twice = told.where("kind = 0 and b > 0").groupBy("c").agg(F.min("d").alias("low"), F.max("d").alias("high")).where("low < high")
    found = twice.select("c").limit(MOST_SHARED + 1).collect()
    if len(found) > MOST_SHARED:
        raise RuntimeError("hashes of sets collide")
    return frozenset(r.c for r in found)


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; ids are integers."""
    context, tables = docs.sparkSession.sparkContext, _Tables(docs.sparkSession)
    # Texts are fetched by id; a row without one is known by a hash of its text.
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(ident).cast("long"), F.xxhash64(F.col(text))).alias("id"))
    told = tables.write(rows.mapInArrow(_describe, "kind int, row long, a long, b long, c long, d long"), "shingles")
    shared = _shared_hashes(told)
    one = F.when(F.col("c").isin(list(shared)), F.col("d")).otherwise(F.col("c")) if shared else F.col("c")
    described = told.where("kind = 0").select("row", F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), one.alias("class"))
    order = context.broadcast(_global_order(told.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")), shared))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, some, classes, sizes = set(), [], [], []
            for tokens in shingle_sets(batch.column(0), SIZE):
                if len(tokens) and (c := _class(tokens, order.value.shared)) not in done:
                    done.add(c)
                    some.append(order.value.prefix(tokens))
                    classes.append(c)
                    sizes.append(len(tokens))
            lengths = [len(x) for x in some]
            yield pa.RecordBatch.from_pydict({"token": _signed(np.concatenate([np.zeros(0, np.uint64), *some])), "class": np.repeat(np.array(classes, np.int64), lengths), "n": np.repeat(np.array(sizes, np.int32), lengths)})

    # A set has many prefix n-grams, each once, so no n-gram holds a large part of these rows.
    by_token = Window.partitionBy("token")
    postings = rows.select("text").mapInArrow(prefixes, "token long, class long, n int")
    postings = postings.withColumn("low", F.min("class").over(by_token)).withColumn("high", F.max("class").over(by_token)).where("low < high")
    postings = tables.write(postings.select("token", "class", "n"), "postings")
    classes = tables.write(described.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("id"), F.min("row").alias("row"), F.count("*").alias("copies")), "classes")
    least_id = classes.select("class", F.col("row").alias("id"))

    held = postings.groupBy("class").agg(F.count("*").alias("c"), F.max("n").alias("n")).where(F.col("c") >= _least_shared_between(F.col("n"), F.ceil(F.col("n") * PERCENT / 100), F.floor(F.col("n") * 100 / PERCENT))).select("class", "c")
    postings = postings.join(held, "class").withColumn("k", F.count("*").over(by_token)).where("k > 1")
    postings = postings.withColumn("pivot", F.max(F.struct((F.col("c") / F.col("n")).alias("part"), "class", "n")).over(by_token))
    postings = postings.withColumn("n_low", F.min("n").over(by_token)).withColumn("n_high", F.max("n").over(by_token))
    postings = tables.write(postings.select("token", "class", "n", "c", "n_low", "n_high", F.col("pivot.class").alias("a"), F.col("pivot.n").alias("n_a")), "postings")

    ranked = postings.where("class <> a").groupBy(F.col("class").alias("b"), "a").agg(F.count("*").alias("shared"), F.max("n").alias("n_b"), F.max("n_a").alias("n_a"))
    best = ranked.where(F.col("shared") >= _least_shared(F.col("n_a"), F.col("n_b"))).groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
    first = tables.write(best.select("a", "b"), "pairs")
    linked = tables.write(_verified(first, rows, least_id, order), "links")
    found = components(linked)

    labelled = postings.join(found.withColumnRenamed("node", "class"), "class", "left").select("token", "class", "n", "c", "n_low", "n_high", F.coalesce("component", "class").alias("component"))
    # Sets that share too little with any size of set that is there can't link.
    low, high = F.greatest("n_low", F.ceil(F.col("n") * PERCENT / 100)), F.least("n_high", F.floor(F.col("n") * 100 / PERCENT))
    labelled = labelled.withColumn("needed", _least_shared_between(F.col("n"), low, high)).where("c >= needed")
    mixed = labelled.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("k")).where("x < y").select("token", "k")
    labelled = tables.write(labelled.join(mixed, "token").select("token", "k", "class", "n", "needed", "component").distinct(), "mixed")
    tables.delete("postings")
    # A set's shared prefix n-grams; fewer than its prefix holds.
    shares = labelled.groupBy("class").agg(F.collect_set("token").alias("tokens"), F.max("n").alias("n"))
    # Linked sets share `needed` of these, so they meet in the first ones, rarest first.
    by_class = Window.partitionBy("class")
    labelled = labelled.withColumn("left", F.count("*").over(by_class) - F.min("needed").over(by_class) + 1)
    labelled = labelled.withColumn("place", F.row_number().over(by_class.orderBy("k", "token"))).withColumn("rest", F.count("*").over(by_class) - F.col("place") + 1)
    labelled = labelled.where("place <= left").select("token", "class", "n", "component", "rest")
    labelled = tables.write(labelled, "first-shared")
    counts = labelled.groupBy("token", "component").agg(F.count("*").alias("k"))
    main = counts.groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("components")).where("components > 1")
    minor = labelled.join(main, "token").where("component <> main").select("token", F.col("class").alias("a"), F.col("component").alias("c_a"), F.col("n").alias("n_a"), F.col("rest").alias("rest_a"))
    other = labelled.select("token", F.col("class").alias("b"), F.col("component").alias("c_b"), F.col("n").alias("n_b"), F.col("rest").alias("rest_b"))
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT
    # All n-grams come in one order, so a pair shares no more than what is left from its first shared one on.
    near &= F.least("rest_a", "rest_b") >= _least_shared(F.col("n_a"), F.col("n_b"))
    crossing = minor.join(other, "token").where((F.col("c_a") != F.col("c_b")) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crossing = crossing.join(tested, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        crossing = crossing.join(shares.select(F.col("class").alias(side), F.col("tokens").alias(f"t_{side}"), F.col("n").alias(f"n_{side}")), side)
    enough = F.size(F.array_intersect("t_a", "t_b")) >= _least_shared(F.col("n_a"), F.col("n_b"))
    crossing = tables.write(crossing.where(enough).select("a", "b"), "crossing")
    tables.delete("mixed", "first-shared")
    linked = linked.unionByName(_verified(crossing, rows, least_id, order))

    # From here on keys are classes, then rows; a component may have most classes, a class most rows.
    found = components(linked).withColumnRenamed("node", "class")
    rooted = tables.write(classes.join(found, "class", "left").select("class", "id", "copies", F.coalesce("component", "class").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("size"))
    least = tables.write(least, "least")
    named = tables.write(skew_join(rooted, least, "root", "size").select("class", "copies", "component_id"), "named")
    whole = skew_join(described.where("n_shingles > 0"), named, "class", "copies").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return whole.unionByName(described.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op6_jaccard_join": op6_jaccard_join}
ORACLES: dict[str, str] = {}
