"""Listing, fetching, cache, model stage, comparison report and command line."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from paperloom.__main__ import main
from paperloom.operators import analysis, comparison, relational
from paperloom.options import Options, PaperloomError
from paperloom.sources import listing, sinks

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


class Folder:
    """A remote folder of two pages."""

    def pages(self, folder):
        if folder == "gone":
            raise PaperloomError("DRIVE_REQUEST_FAILED", "https://host/?key=secret&x=1 said 404")
        yield [{"id": "1", "name": "a.pdf", "mimeType": "application/pdf", "size": "3", "md5Checksum": "m"}, {"id": "2", "name": "Notes", "mimeType": "application/vnd.google-apps.document"}]
        yield [{"id": "3", "name": "sub", "mimeType": "application/vnd.google-apps.folder"}, {"id": "4", "name": "b.exe", "mimeType": "x/y", "size": 1}, {"id": "5", "name": "big.txt", "mimeType": "text/plain", "size": 10**9}, {"id": "6", "name": "liar.txt", "mimeType": "text/plain", "size": 1}]

    def fetch(self, entry):
        return b"x" * 300 if entry["id"] == "6" else entry["name"].encode()


def test_manifest_and_contents(spark):
    folders = spark.createDataFrame([("abc",), ("gone",), ("",), ("no id!",)], "folder string")
    manifest = listing.folder_manifest(folders, Folder())
    rows = {(r.folder, r.ordinal): r for r in manifest.collect()}
    assert [rows["abc", i].kind for i in range(6)] == ["file", "export", "folder", "unsupported", "file", "file"] and rows["abc", 1].read_name == "Notes.docx" and rows["abc", 0].size == 3
    assert "404" in rows["gone", 0].error and "secret" not in rows["gone", 0].error and rows["", 0].error.startswith("MISSING_DRIVE_FOLDER") and rows["no id!", 0].error.startswith("INVALID_DRIVE_FOLDER")
    assert {r.name for r in listing.skipped(manifest).collect()} == {"sub", "b.exe"}
    got = {r.id: r for r in listing.fetch_entries(manifest.where("folder = 'abc'"), Folder(), Options(most_bytes=200)).collect()}
    assert bytes(got["1"].content) == b"a.pdf" and bytes(got["2"].content) == b"Notes" and got["3"].content is None and got["3"].error is None
    assert got["5"].error == "FILE_TOO_LARGE" and got["6"].error.startswith("FILE_TOO_LARGE") and got["6"].content is None


def test_files_of_folders(spark, tmp_path):
    (tmp_path / "in/.hidden").mkdir(parents=True)
    for name, text in (("a.txt", "one"), ("b.exe", "x"), (".c.txt", "x"), (".hidden/d.txt", "x"), ("e.json", "x" * 50)):
        (tmp_path / "in" / name).write_text(text)
    paths = [str(tmp_path / "in")]
    assert {r.path.rsplit("/", 1)[1] for r in listing.list_files(spark, paths).collect()} == {"a.txt", "e.json"}
    got = {r.path.rsplit("/", 1)[1]: r for r in listing.read_files(spark, paths, Options(most_bytes=10)).collect()}
    assert bytes(got["a.txt"].content) == b"one" and got["e.json"].error == "FILE_TOO_LARGE" and got["e.json"].content is None
    plan = listing.read_files(spark, paths, Options(most_bytes=10)).where("error is null")._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,10)" in plan
    for path, code in ((str(tmp_path / "none"), "FILE_NOT_FOUND"), (str(tmp_path / "in/b.exe"), "NO_INPUT_FILES")):
        with pytest.raises(PaperloomError) as e:
            listing.list_files(spark, [path])
        assert e.value.code == code


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("two words")
    (tmp_path / "in/b.docx").write_text("no package")
    assert main(["read", str(tmp_path / "in"), "--out", str(tmp_path / "out")], spark) == 1
    documents = {p.parent.name: json.loads(p.read_text()) for p in (tmp_path / "out").rglob("part-*.txt")}
    assert list(documents) == ["name=a.txt"] and documents["name=a.txt"]["stats"]["words"] == 2
    assert main(["list", str(tmp_path / "in")], spark) == 0 and capsys.readouterr().out.count("\n") == 2
    assert main(["read", str(tmp_path / "gone"), "--out", str(tmp_path / "out")], spark) == 2


def test_options():
    assert Options.from_environment({"PAPERLOOM_MOST_BYTES": "7", "PAPERLOOM_FAIL_FAST": "yes"}) == Options(most_bytes=7, fail_fast=True)


def test_cache_is_read_through(spark):
    entries = spark.createDataFrame([("new name", "k1"), ("b", "k2"), ("c", None), ("d", "k3"), ("e", "k3")], "name string, key string")
    cache = spark.createDataFrame([("k1", 10, None), ("k1", 10, None), (None, 99, None)], "key string, result int, error string")
    results, fresh = listing.read_through(entries, cache, lambda rows: rows.withColumn("result", F.length("name")).withColumn("error", F.when(F.col("name") == "b", "BAD")))
    assert {(r.name, r.result, r.cached, r.error) for r in results.collect()} == {("new name", 10, True, None), ("b", 1, False, "BAD"), ("c", 1, False, None), ("d", 1, False, None), ("e", 1, False, None)}
    assert [r.key for r in fresh.collect()] == ["k3"]
    assert tuple(listing.progress(results).head()) == (5, 4, 1, 1, 4)


class Model:
    """Says JSON, prose, fails for a while or for good, by the picture."""

    def analyze(self, prompt, base64, mime):
        if base64 == "broken":
            raise ValueError("no picture")
        return {"a": '```json\n{"summary": "s", "extracted_text": "alpha beta", "visual_elements": [1, 2], "tables": [], "confidence": "high"}\n```', "b": "just prose"}[base64], "m-1", 5, None


def test_model_stage(spark):
    rows = [("f.pdf", 1, "p1", "image/png", "a", "?"), ("f.pdf", 2, "p2", "image/png", "b", "?"), ("f.pdf", 3, "p3", "image/png", "broken", "?")]
    visuals = spark.createDataFrame(rows, "file string, visual_no int, label string, mime string, base64 string, prompt string")
    got = {r.visual_no: r for r in analysis.analyze_visuals(visuals, Model(), "north").collect()}
    assert (got[1].parsed, got[1].summary, got[1].elements, got[1].tables, got[1].confidence, got[1].tokens_in) == (True, "s", 2, 0, "high", 5)
    assert (got[2].parsed, got[2].confidence, got[2].extracted_text, got[2].raw) == (False, "low", "", "just prose") and got[3].error == "ValueError: no picture" and not got[3].parsed
    with pytest.raises(Exception, match="no picture"):
        analysis.analyze_visuals(visuals, Model(), "north", Options(fail_fast=True)).collect()


def test_retries():
    waits, left = [], [OSError(), OSError()]
    left[0].status, left[1].code = 503, "ECONNRESET"

    def call():
        if left:
            raise left.pop(0)
        return "done"

    assert analysis.with_retry(call, Options(first_wait=1.0), waits.append) == "done" and waits == [1.0, 2.0]
    with pytest.raises(ValueError):
        analysis.with_retry(lambda: (_ for _ in ()).throw(ValueError()), Options(), waits.append)
    assert len(waits) == 2


def test_report(spark, tmp_path):
    columns = "file string, visual_no int, provider string, label string, parsed boolean, confidence string, latency long, tokens_in long, tokens_out long, elements int, tables int, summary string, extracted_text string, notes string, error string"
    rows = [
        ("d/f.pdf", 1, "north", "p1", True, "high", 100, 1, 1, 3, 0, "red fox", "alpha beta gamma", "", None), ("d/f.pdf", 1, "south", "p1", False, "low", 301, None, 1, None, 1, "", "alpha beta", "dim", None),
        ("g.png", 1, "north", "p", True, "low", None, 1, 1, 0, 0, None, None, None, "boom"),
    ]
    told = spark.createDataFrame(rows, columns)
    truth = spark.createDataFrame([("f.pdf", ["FOX", "gamma", "zebra"])], "name string, keywords array<string>")
    visuals = comparison.with_recall(comparison.compare_visuals(told, "north", "south"), truth)
    got = {r.file: r for r in visuals.collect()}
    assert (got["d/f.pdf"].agreement, got["d/f.pdf"].first_recall, got["d/f.pdf"].second_recall) == (0.667, 0.667, 0.0) and got["g.png"].second is None and got["g.png"].agreement == 1.0
    totals = comparison.comparison_totals(visuals, "north", "south")
    north, south = totals.collect()
    assert (north.provider, north.analyses, north.parse_rate, north.latency, north.elements, north.recall, north.n_low, north.files) == ("north", 2, 1.0, 100.0, 1.5, 0.667, 1, 2)
    assert (south.analyses, south.parse_rate, south.latency, south.recall, south.agreement) == (1, 0.0, 301.0, 0.0, 0.834)
    reasons = {(r.file, r.provider): (r.reason, r.notes) for r in comparison.failure_cases(told).collect()}
    assert reasons == {("d/f.pdf", "south"): ("response was not valid JSON", "dim"), ("g.png", "north"): ("request error: boom", None)}
    advice = comparison.recommendation(totals, "north", "south")
    assert advice.head().accuracy == "north recalled more of the expected facts (north 0.667, south 0.0)" and "north was more reliable" in advice.head().reliability
    none = comparison.recommendation(totals.withColumn("recall", F.lit(None).cast("double")), "north", "south").head()
    assert none.accuracy.startswith("no ground truth")
    metrics = relational.provider_metrics(told, ["file", "provider"]).selectExpr("file", "provider", "parse_rate", "avg_latency as latency", "avg_elements as elements", "avg_tables as tables", "0 as failures")
    sinks.write_report(comparison.report_lines(totals, advice, metrics, "north", "south"), str(tmp_path / "report"))
    lines = next((tmp_path / "report").glob("part-*")).read_text().splitlines()
    assert lines[0] == "# north and south" and lines[1] == "Files: 2 | Pictures: 2" and "| Keyword recall | 0.667 | 0.0 |" in lines and lines[-1].startswith("| g.png | north | 1.0 | 0 |")
