"""The folder data source, bounded fetches, calls in flight, landing limits, the cache table, running progress."""

import hashlib
import json
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paperloom.operators import analysis
from paperloom.options import Options, PaperloomError
from paperloom.sources import cache, folder_source, listing
from paperloom.streaming.folder import CACHE_SCHEMA, stream_folder, stream_progress


def _pages(root):
    for folder, page, entries in (("a", 0, [("1", "x.pdf", "10"), ("2", "y.txt", None)]), ("a", 1, [("3", "z.pdf", "30")]), ("a", 10, [("4", "w.pdf", "40")]), ("b", 0, [("5", "v.txt", "50")])):
        at = Path(root) / f"folder={folder}" / f"page={page}"
        at.mkdir(parents=True)
        (at / "part-0.txt").write_text("\n".join(json.dumps({"id": i, "name": n, "mimeType": "t/" + n[-3:], "size": s, "md5Checksum": "m"}) for i, n, s in entries))
    (Path(root) / "folder=b" / "page=1").mkdir()
    (Path(root) / "folder=b" / "page=1" / "part-0.txt").write_text("{broken")


def test_a_folder_is_a_data_source(spark, tmp_path):
    _pages(tmp_path)
    folder_source.register(spark)
    found = spark.read.format("paperloom_folder").option("root", str(tmp_path)).option("pages_a_partition", "2").load()
    rows = {(r.folder, r.page, r.ordinal): r for r in found.collect()}
    assert {k: r.id for k, r in rows.items()} == {("a", 0, 0): "1", ("a", 0, 1): "2", ("a", 1, 0): "3", ("a", 2, 0): "4", ("b", 0, 0): "5", ("b", 1, 0): None}
    assert "JSONDecodeError" in rows["b", 1, 0].error and rows["a", 0, 1].size is None and rows["a", 0, 0].mime == "t/pdf"
    large = found.where("size >= 30 and name like '%.pdf'")
    assert sorted(r.id for r in large.collect()) == ["3", "4"]
    plan = large._jdf.queryExecution().executedPlan().toString()
    unpushed = found.where("page > 0")._jdf.queryExecution().executedPlan().toString()
    assert "(size#" not in plan and "(page#" in unpushed, (plan, unpushed)  # Spark keeps no filter that the source applies
    one = spark.read.format("paperloom_folder").option("root", str(tmp_path)).option("folders", "a, gone").load()
    assert sorted((r.folder, r.error is not None) for r in one.collect()) == [("a", False)] * 4 + [("gone", True)]


def chunked(log, total, chunk, fail_at=()):
    """A client that gives an entry in chunks and fails once at some offsets."""
    log, failed = str(log), set()

    class Lost(Exception):
        status = 503

    class Chunked:
        def chunks(self, entry, start):
            while start < total:
                if start in fail_at and start not in failed:
                    failed.add(start)
                    raise Lost()
                with open(log, "a") as f:
                    f.write(f"{start}\n")
                yield b"x" * min(chunk, total - start)
                start += chunk

    return Chunked()


def test_a_fetch_stops_at_the_limit_and_goes_on_after_a_failure(spark, tmp_path):
    digest = hashlib.md5(b"x" * 1_000).hexdigest()
    entries = spark.createDataFrame([("ok", digest), ("bad", "0" * 32), ("none", None)], "name string, md5 string").select(
        F.lit("f").alias("folder"), F.lit(0).cast("long").alias("ordinal"), F.col("name").alias("id"), "name", F.lit("t").alias("mime"), F.lit(None).cast("string").alias("modified"), F.lit(None).cast("long").alias("size"),
        "md5", F.lit(None).cast("string").alias("link"), F.lit(None).cast("string").alias("error"), F.lit("file").alias("kind"), F.col("name").alias("read_name")).coalesce(1)
    got = {r.name: r for r in listing.fetch_entries(entries, chunked(tmp_path / "a", 1_000, 100, {300, 700}), Options(first_wait=0.0)).collect()}
    assert got["ok"].content == b"x" * 1_000 == got["none"].content and got["bad"].content is None and got["bad"].error.startswith("CHECKSUM_MISMATCH")
    log = [int(x) for x in (tmp_path / "a").read_text().split()]
    assert sorted(log) == sorted([*range(0, 1_000, 100)] * 3)  # nothing is fetched twice
    huge = listing.fetch_entries(entries.where("name = 'ok'"), chunked(tmp_path / "b", 1 << 30, 1 << 10), Options(most_bytes=5_000)).head()
    assert huge.error.startswith("FILE_TOO_LARGE") and len((tmp_path / "b").read_text().split()) == 5


def test_calls_in_flight_are_bounded_and_in_order():
    lock, now, most = threading.Lock(), 0, 0

    def call(row):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.05 if row[0] % 3 else 0.1)
        with lock:
            now -= 1
        return row

    began = time.monotonic()
    assert list(analysis.in_flight(call, ((i,) for i in range(12)), 3)) == [(i,) for i in range(12)]
    assert most == 3 and time.monotonic() - began < 0.6 * (8 * 0.05 + 4 * 0.1)
    with pytest.raises(PaperloomError):
        list(analysis.in_flight(lambda row: (_ for _ in ()).throw(PaperloomError("X", "x")), [(1,)], 3))


def test_cache_upserts(spark, tmp_path):
    root = str(tmp_path / "cache")
    rows = lambda *r: spark.createDataFrame(list(r), CACHE_SCHEMA)
    held = lambda: {r.key: r.text for r in cache.current(spark, root, CACHE_SCHEMA).collect()}
    assert held() == {}
    for _ in range(2):  # a run that is tried again
        cache.upsert(rows(("k1", "text", "one", 1, None), ("k2", "text", "two", 1, None), (None, "text", "lost", 1, None)), root, "1")
    assert cache.current(spark, root, CACHE_SCHEMA).count() == 2 and held() == {"k1": "one", "k2": "two"}
    cache.upsert(rows(("k2", "text", "newer", 1, None)), root, "2")
    cache.upsert(rows(("k2", "text", "newest", 1, None)), root, "10")
    assert held() == {"k1": "one", "k2": "newest"}
    cache.compact(spark, root, CACHE_SCHEMA)
    cache.clean(spark, root)
    assert held() == {"k1": "one", "k2": "newest"} and not any((tmp_path / "cache" / "runs").iterdir())
    cache.upsert(rows(("k3", "text", "three", 1, None)), root, "11")
    broken = next((tmp_path / "cache" / "runs" / "run=11").rglob("*.parquet"))
    asked = spark.createDataFrame([("k1",), ("k3",), (None,), ("k9",)], "key string")
    assert {r.key for r in cache.lookup(asked, root, CACHE_SCHEMA).collect()} == {"k1", "k3"}
    broken.write_bytes(b"no parquet")
    (broken.parent / f".{broken.name}.crc").unlink(missing_ok=True)
    assert {r.key for r in cache.lookup(asked, root, CACHE_SCHEMA).collect()} == {"k1"}  # a miss


def test_landing_limits(spark, tmp_path):
    landing = tmp_path / "in" / "request"
    landing.mkdir(parents=True)
    for i in range(21):
        (landing / f"{i:02}.txt").write_text(f"text {i % 20}")
    (landing / "10-large.txt").write_text("x" * 500)
    run = lambda: stream_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cache"), str(tmp_path / "state"), Options(most_bytes=100)).awaitTermination(300)
    run()
    lines = [json.loads(x) for p in (tmp_path / "out").rglob("part-*") for x in p.read_text().split("\n") if x]
    errors = {Path(x["path"]).name: x["error"] for x in lines if x.get("error")}
    assert len(lines) == 22 and errors == {"20.txt": "TOO_MANY_FILES", "10-large.txt": "FILE_TOO_LARGE"}
    assert cache.current(spark, str(tmp_path / "cache"), CACHE_SCHEMA).count() == 20
    again = tmp_path / "in" / "second"
    again.mkdir()
    (again / "new.txt").write_text("text 3")
    run()
    lines = [json.loads(x) for p in (tmp_path / "out").rglob("part-*") for x in p.read_text().split("\n") if x]
    assert len(lines) == 23 and [x["cached"] for x in lines if x["path"].endswith("new.txt")] == [True]


def test_progress_goes_on_after_a_restart(spark, tmp_path):
    def land(name, *rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("".join(json.dumps({"run": r, "total": t, "path": p, "cached": c, "error": e}) + "\n" for r, t, p, c, e in rows))

    def told():
        stream_progress(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(300)
        return [json.loads(x) for p in (tmp_path / "out").rglob("part-*") for x in p.read_text().split("\n") if x]

    land("1.json", ("r", 3, "a", False, None), ("s", 1, "x", True, None))
    first = told()
    assert {(x["run"], x["type"]) for x in first} == {("r", "file"), ("s", "file"), ("s", "done")}
    land("2.json", ("r", 3, "b", True, None), ("r", 3, "c", False, "EXTRACTION_FAILED"))
    rows = [x for x in told() if x["run"] == "r"]
    last = next(x for x in rows if x["type"] == "done")
    assert (last["done"], last["failed"], last["hits"], last["misses"], last["total"]) == (2, 1, 1, 2, 3) and sorted(x["done"] + x["failed"] for x in rows if x["type"] == "file") == [1, 2, 3]
