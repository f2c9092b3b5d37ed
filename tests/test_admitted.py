"""Admission of many entries takes time in proportion to them."""

import time

from pyspark.sql import functions as F

from paperloom.operators import relational


def test_many_entries(spark):
    few = spark.range(1).select(relational.admitted(F.array(*[F.lit(n).cast("long") for n in (60, 60, 30, 10, 250)]), 100).alias("n")).head().n
    assert few == 3
    sizes = F.transform(F.sequence(F.lit(0), F.lit(299_999)), lambda i: (i % 3).cast("long"))
    start = time.time()
    assert spark.range(1).select(relational.admitted(sizes, 300_000).alias("n")).head().n == 300_000
    assert time.time() - start < 20
