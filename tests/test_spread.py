"""Work is dealt over tasks by rows, a package is read once, listings have few files."""

import io
import os
import zipfile

import pytest

from paperloom.plans import catalogue, files, records  # noqa: F401
from paperloom.sources import packages

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["block_runs", "chart_points", "first_slides", "sheet_rows", "sheet_charts", "delimited_cells", "presentation_slides"])
def test_dealt_by_rows(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and (name != "sheet_charts" or "Join" not in plan)


def test_few_listing_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records.sinks, "scratch_folder", lambda spark, label: f"{tmp_path}/{label}")
    assert catalogue.QUERIES["folder_listing"](spark, SF).count() > 0
    pages = [d for f in os.listdir(tmp_path / "listing") if f.startswith("folder=") for d in os.listdir(tmp_path / "listing" / f)]
    assert set(pages) == {"page=0"}  # 200 ids


def test_pack():
    long = "x" * 50_000
    with zipfile.ZipFile(io.BytesIO(packages.pack([("a.xml", "é"), ("b/ü.xml", None), ("c.mp4", long), ("d.xml", long)]))) as z:
        assert z.testzip() is None and [z.read(n).decode() for n in z.namelist()] == ["é", "", long, long]
        assert z.namelist()[1] == "b/ü.xml" and z.getinfo("c.mp4").compress_size == 50_000 > 100 * z.getinfo("d.xml").compress_size
    with zipfile.ZipFile(io.BytesIO(packages.pack([(f"{i}.txt", "t") for i in range(70_000)]))) as z:
        assert len(z.namelist()) == 70_000
