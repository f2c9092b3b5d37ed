"""Commands over remote folders and analyses, and averages of what is a number."""

import json

from pyspark.sql import functions as F

from paperloom.__main__ import main
from paperloom.functions.text import safe_average
from paperloom.operators import comparison


def test_compare(spark, tmp_path):
    rows = [
        {"file": "d/deck.pptx", "visual_no": 1, "label": "one", "provider": "north", "parsed": True, "confidence": "high", "latency": 100, "elements": 2, "tables": 1, "summary": "alpha", "extracted_text": "alpha beta"},
        {"file": "d/deck.pptx", "visual_no": 1, "label": "one", "provider": "south", "parsed": True, "confidence": "low", "latency": 300, "elements": 1, "tables": 0, "summary": "beta", "extracted_text": "beta"},
    ]
    (tmp_path / "analyses.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "truth.json").write_text(json.dumps({"deck.pptx": {"expectedKeywords": ["alpha", "beta"]}, "other": {}}, indent=1))
    assert [tuple(r) for r in comparison.read_truth(spark, str(tmp_path / "truth.json")).collect()] == [("deck.pptx", ["alpha", "beta"])]
    assert main(["compare", str(tmp_path / "analyses.json"), "--providers", "north", "south", "--truth", str(tmp_path / "truth.json"), "--out", str(tmp_path / "report")], spark) == 0
    lines = next((tmp_path / "report").glob("part-*")).read_text().split("\n")
    assert lines[0] == "# north and south" and "| Keyword recall | 1 | 0.5 |" in [x.replace("1.0", "1") for x in lines] and lines[-2].startswith("| deck.pptx | south")


def test_folder(spark, tmp_path, monkeypatch):
    # A module of the driver's; its client goes to the tasks by value.
    (tmp_path / "remote_client.py").write_text(
        "def make():\n"
        "    class Client:\n"
        "        def pages(self, folder):\n"
        "            yield [{'id': '1', 'name': 'a.txt', 'mimeType': 'text/plain', 'size': '3', 'md5Checksum': None}, {'id': '2', 'name': 'b.exe', 'mimeType': 'x/y'}]\n"
        "        def fetch(self, entry):\n"
        "            return b'one two'\n"
        "    Client.__module__ = '__main__'\n"
        "    return Client()\n"
        "CLIENT = make()\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    asked = ["folder", "abc", "--client", "remote_client:CLIENT", "--cache", str(tmp_path / "cache"), "--out", str(tmp_path / "out")]
    assert main(asked, spark) == 0
    found = [json.loads(p.read_text()) for p in (tmp_path / "out").rglob("part-*.txt")]
    assert [(d["name"] if "name" in d else None, d["text"]) for d in found] in ([("a.txt", "one two")], [(None, "one two")])


def test_averages_leave_out_what_is_no_number(spark):
    rows = spark.createDataFrame([(1.0, float("nan")), (float("nan"), float("nan")), (2.0, None), (None, None)], "a double, b double")
    assert tuple(rows.agg(safe_average(F.col("a")), safe_average(F.col("b"))).head()) == (1.5, None)
