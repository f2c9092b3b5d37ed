"""Document fingerprints as invertible Bloom lookup sketches, in SQL only.

A text's paragraphs (lines, long ones in pieces) become digests; each digest is
added to one cell of each of three sub-tables: a count, the xor of digests, the
xor of their check hashes. Sketches of two versions are subtracted cell by
cell, which leaves what differs; peeling takes digests out of cells that hold a
single one until none is left. If some can't be told, the sketches are built
anew, larger and with other hashes, over and over. The number of digests that
differ, d, gives the likeness (|A| + |B| - d) / (|A| + |B| + d).

A pair of texts of many paragraphs is cut into blocks by the digests' hash, so
that a block has about BLOCK of them: sketches are of bounded size, and work
grows in proportion to the paragraphs, however many a text has.

Defined results: null text counts as empty; its sketch has empty cells, and two
empty texts have likeness 1. Repeated paragraphs count once. Texts of any length
are taken whole. Rows that share an id, or have none (they come last), are
ordered by a hash of their text; a single row is its own next one. No rows give
no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import cuts_below, materialize, table

#: A paragraph: a line, in pieces of so many characters at most.
PARAGRAPH = r"[^\n]{1,320}\n?"
TABLES = 3
#: Cells of a sub-table in a fingerprint, and of those that are built when that fails, for a pair of so many digests at most.
CELLS = 6
LARGER, MOST_PAIR = 32, 128
#: Digests of a block of a larger pair, about; times that its sketches grow.
BLOCK, RETRIES = 24, 8
#: Rounds of peeling; each takes out all digests that are alone in a cell. More than this are not seen at these sizes.
ROUNDS = 24
#: Rows of a window task, about. Ids are cut at MOST_BUCKETS quantiles at most; beyond, tasks sort and spill more.
ROWS_PER_BUCKET, MOST_BUCKETS = 1_000, 4_096


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digests(text: Column) -> Column:
    """The distinct paragraph digests of a text, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(F.rtrim(p)))))


def _check(k: Column) -> Column:
    return F.pmod(F.xxhash64(k, F.lit(-77)), F.lit(1 << 32))


def _column(x: Column | int) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def _place(k: Column, seed: Column | int, width: Column | int) -> Column:
    return F.pmod(F.xxhash64(k, _column(seed)), _column(width)).cast("int")


def _changed(cells: Column, k: Column, sign: Column, seed: Column | int, width: Column | int) -> Column:
    """A sub-table with a digest added (or taken out, sign -1)."""

    def put(at: Column) -> Column:
        new = lambda c: F.struct((c["n"] + sign).alias("n"), c["k"].bitwiseXOR(k).alias("k"), c["c"].bitwiseXOR(_check(k)).alias("c"))
        return F.transform(cells, lambda c, i: F.when(i == at, new(c)).otherwise(c))

    return _let(_place(k, seed, width), put)


def _each(make: Callable[[int], Column]) -> Column:
    return F.struct(*[make(t).alias(f"t{t}") for t in range(TABLES)])


def sketch(keys: Column, width: Column | int, seed: Column | int = 0) -> Column:
    """The sub-tables of a sketch with ``width`` cells each."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))
    return _each(lambda t: F.aggregate(keys, F.array_repeat(zero, _column(width)), lambda cells, k: _changed(cells, k, F.lit(1), seed + t, width)))


def subtract(a: Column, b: Column) -> Column:
    less = lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c"))
    return _let(a, lambda x: _let(b, lambda y: _each(lambda t: F.zip_with(x[f"t{t}"], y[f"t{t}"], less))))


def peel(cells: Column, width: Column | int, seed: Column | int = 0) -> Column:
    """The digests that differ, or null if some can't be told."""
    start = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("out"), F.lit(False).alias("over"))

    def alone(s: Column) -> Column:
        """(digest, sign) of the cells that hold a single one."""
        pure = lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _check(c["k"]))
        some = lambda t: F.transform(F.filter(s["cells"][f"t{t}"], pure), lambda c: F.struct(c["k"].alias("k"), c["n"].alias("n")))
        return F.array_distinct(F.concat(*[some(t) for t in range(TABLES)]))

    def without(s: Column, found: Column) -> Column:
        one = lambda t: F.aggregate(found, s["cells"][f"t{t}"], lambda cells, f: _changed(cells, f["k"], -f["n"], seed + t, width))
        out = F.concat(s["out"], F.transform(found, lambda f: f["k"]))
        return F.when(F.size(found) == 0, F.struct(s["cells"].alias("cells"), s["out"].alias("out"), F.lit(True).alias("over"))).otherwise(F.struct(_each(one).alias("cells"), out.alias("out"), F.lit(False).alias("over")))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: F.when(s["over"], s).otherwise(_let(alone(s), lambda found: without(s, found))))
    # Each digest is in a cell of every sub-table, so the first one tells.
    empty = lambda s: F.forall(s["cells"]["t0"], lambda c: (c["n"] == 0) & (c["k"] == 0))
    return _let(done, lambda s: F.when(empty(s), s["out"]))


def _count(found: Column) -> Column:
    """Null stays null."""
    return F.when(found.isNotNull(), F.size(found))


def difference(a: Column, b: Column, a_cells: Column, b_cells: Column) -> Column:
    """How many digests differ between two versions: from their fingerprints, else from larger sketches; null if those fail too, or the pair is large."""
    # So many differ at least; more than the cells hold can't be peeled.
    may = lambda width: F.abs(F.size(a) - F.size(b)) <= TABLES * width
    small = F.when(may(CELLS), _let(peel(subtract(a_cells, b_cells), CELLS), _count))
    large = F.when(may(LARGER) & (F.size(a) + F.size(b) <= MOST_PAIR), _let(peel(subtract(sketch(a, LARGER, TABLES), sketch(b, LARGER, TABLES)), LARGER, TABLES), _count))
    return F.coalesce(small, large)


def block_differences(pairs: DataFrame, retries: int = RETRIES) -> DataFrame:
    """(id, d) of ``pairs`` (id, a, b), with arrays of digests of any length, block by block.

    What a block's sketches can't tell is tried again, twice as large with other hashes; the odds of a failure
    fall at each retry, and one of all of them stops the job rather than give a wrong count.
    """
    blocks = F.greatest(F.lit(1), F.ceil((F.size("a") + F.size("b")) / BLOCK))
    side = lambda keys, own: F.transform(keys, lambda k: F.struct(k.alias("k"), F.lit(own).alias("own")))
    sides = F.explode(F.concat(side("a", True), side("b", False)))
    rows = pairs.where(F.size("a") + F.size("b") > 0).select("id", blocks.alias("blocks"), sides.alias("x"))
    rows = rows.select("id", "x.k", "x.own", F.pmod(F.xxhash64("x.k", F.lit(-5)), "blocks").alias("block"))
    own = lambda is_own: F.collect_list(F.when(F.col("own") == is_own, F.col("k")))
    held = rows.groupBy("id", "block").agg(own(True).alias("a"), own(False).alias("b"))

    def again(i: Column) -> Column:
        width, seed = (F.lit(LARGER) * F.pow(F.lit(2), i)).cast("int"), (i + 2) * TABLES
        return _let(peel(subtract(sketch(F.col("a"), width, seed), sketch(F.col("b"), width, seed)), width, seed), _count)

    tried = F.aggregate(F.sequence(F.lit(0), F.lit(retries - 1)), F.lit(None).cast("int"), lambda found, i: F.when(found.isNotNull(), found).otherwise(again(i)))
    failed = F.raise_error("a block's digests can't be told apart").cast("int")
    return held.select("id", F.coalesce(tried, failed).alias("d")).groupBy("id").agg(F.sum("d").alias("d"))


def likeness(n_a: Column, n_b: Column, d: Column) -> Column:
    return F.when(n_a + n_b == 0, F.lit(1.0)).otherwise((n_a + n_b - d) / (n_a + n_b + d)).cast("double")


def serialise(n: Column, cells: Column) -> Column:
    """Cells are parted by ``:``; an empty one is empty, another is count.xor.check in hexadecimal."""
    return F.concat_ws(":", F.hex(n), F.array_join(F.transform(F.flatten(F.array(*[cells[f"t{t}"] for t in range(TABLES)])), lambda c: F.when((c["n"] == 0) & (c["k"] == 0), F.lit("")).otherwise(F.concat_ws(".", F.hex(c["n"]), F.hex(c["k"]), F.hex(c["c"])))), ":"))


def with_next(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, digests, next_text, next_digests): each row with the next one by descending id; after the last comes the first.

    Ids are cut at quantiles into buckets, which are sorted on their own; the first row of a bucket is also sent,
    as a guest, to where the last row of the bucket before it is.
    """
    rows = docs.select(F.col(ident).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    told = rows.agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).head()
    k = max(1, min(MOST_BUCKETS, told["n"] // ROWS_PER_BUCKET))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 50_000)).head()[0] if k > 1 and told["top"] is not None else []
    cuts = sorted({c for c in cuts if c < told["top"]})
    bucket = cuts_below(cuts, F.col("doc_id")) if cuts else F.lit(0)
    bucket = F.coalesce(F.when(F.col("doc_id").isNull(), 0).otherwise(bucket), F.lit(0))
    places = [F.struct(bucket.alias("bucket"), F.lit(0).alias("guest"))]
    if cuts:
        places.append(F.when(F.col("doc_id").isin(cuts), F.struct((bucket + 1).alias("bucket"), F.lit(1).alias("guest"))))
    places.append(F.when(F.col("doc_id") == told["top"], F.struct(F.lit(0).alias("bucket"), F.lit(2).alias("guest"))))
    dealt = rows.withColumn("place", F.explode(F.filter(F.array(*places), lambda p: p.isNotNull()))).select("place.*", "doc_id", "text")
    if told["top"] is None:  # no id at all: the first by its text follows the last
        first = rows.orderBy(F.xxhash64("text"), "text").limit(1)
        dealt = dealt.unionByName(first.select(F.lit(0).alias("bucket"), F.lit(2).alias("guest"), "doc_id", "text"))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    seen = dealt.repartition(F.col("bucket")).withColumn("digests", digests(F.col("text")))
    seen = seen.withColumn("next_text", F.lead("text").over(order)).withColumn("next_digests", F.lead("digests").over(order)).where("guest = 0")
    return seen.select("doc_id", "text", "digests", F.coalesce("next_text", "text").alias("next_text"), F.coalesce("next_digests", "digests").alias("next_digests"))


def fingerprint_pairs(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's and its edited text's fingerprints, and their likeness to each other and to the next text's."""
    rows = with_next(docs, ident, text)
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "digests", digests(F.col("edited")).alias("edited_digests"), "next_digests")
    rows = rows.withColumns({f"{c}_cells": sketch(F.col(c), CELLS) for c in ("digests", "edited_digests", "next_digests")})
    others = F.array(*[F.struct(F.col(c).alias("keys"), F.col(f"{c}_cells").alias("cells")) for c in ("edited_digests", "next_digests")])
    rows = rows.withColumn("apart", F.transform(others, lambda o: difference(F.col("digests"), o["keys"], F.col("digests_cells"), o["cells"])))
    rows = rows.withColumn("d_edited", F.get("apart", 0)).withColumn("d_next", F.get("apart", 1))
    left = F.col("d_edited").isNull() | F.col("d_next").isNull()
    told = rows.select(
        F.monotonically_increasing_id().alias("id"), "doc_id", "n_chars", "edited_sha256",
        serialise(F.size("digests"), F.col("digests_cells")).alias("fingerprint"), serialise(F.size("edited_digests"), F.col("edited_digests_cells")).alias("edited_fingerprint"),
        F.size("digests").alias("n"), F.size("edited_digests").alias("n_edited"), F.size("next_digests").alias("n_next"), "d_edited", "d_next",
        F.when(left, F.col("digests")).alias("a"), F.when(F.col("d_edited").isNull(), F.col("edited_digests")).alias("e"), F.when(F.col("d_next").isNull(), F.col("next_digests")).alias("x"),
    )
    told = materialize(told, "fingerprints")
    large = told.where("a is not null")
    other = lambda n, keys: F.when(F.col(keys).isNotNull(), F.struct(F.lit(n).alias("n"), F.col(keys).alias("b")))
    pairs = large.select("id", "a", F.explode(F.array_compact(F.array(other(0, "e"), other(1, "x")))).alias("other"))
    found = block_differences(pairs.select(F.struct("id", F.col("other.n").alias("n")).alias("id"), "a", "other.b")).groupBy("id.id").agg(*[F.max(F.when(F.col("id.n") == n, F.col("d"))).alias(f"f{n}") for n in (0, 1)])
    large = large.join(found, "id", "left").withColumns({d: F.coalesce(d, F.col(f"f{n}").cast("int")) for n, d in enumerate(("d_edited", "d_next"))}).drop("f0", "f1")
    told = told.where("a is null").unionByName(large)
    return told.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("n"), F.col("n_edited"), F.col("d_edited")).alias("near_edited"), likeness(F.col("n"), F.col("n_next"), F.col("d_next")).alias("near_next"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(table(spark, sf_dir, "documents"))


QUERIES = {"op5_fingerprints": op5_fingerprints}
ORACLES: dict[str, str] = {}
