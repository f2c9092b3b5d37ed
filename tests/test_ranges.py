"""Files read by ranges: blocks, requests and bytes, and records that are the same either way."""

import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom.options import Options
from paperloom.sources.ranges import ArrowRanges, RangeFile
from paperloom.sources.reader import read_paths
from test_reader_record import _book, _deck, _png, _zip


def counting(log):
    """A client that notes each read in a file of the test's; made here, so that the tasks need no module of the tests."""
    log = str(log)

    class Counting(ArrowRanges):
        def read(self, path, start, end):
            with open(log, "a") as f:
                f.write(f"{os.path.basename(path)} {end - start}\n")
            return ArrowRanges.read(self, path, start, end)

    return Counting()


def _reads(log):
    found = {}
    for line in open(log).read().split("\n")[:-1]:
        name, size = line.split()
        found.setdefault(name, []).append(int(size))
    return found


def test_neighbouring_reads_are_few_requests():
    data = bytes(i % 251 for i in range(10_000))
    file = RangeFile(lambda a, b: data[a:b], len(data), block=1024)
    for start in range(0, 9_000, 300):
        file.seek(start)
        assert file.read(120) == data[start : start + 120]
    assert file.requests <= 10
    file.seek(9_990)
    assert file.read() == data[9_990:] and file.read(5) == b"" and file.tell() == len(data)
    before = file.requests
    file.seek(0)
    assert file.read(5_000) == data[:5_000] and file.requests == before + 1  # one request, past the blocks


def test_blocks_that_were_not_used_go_first():
    data = bytes(range(256)) * 40
    file = RangeFile(lambda a, b: data[a:b], len(data), block=100, most_blocks=3)
    r = random.Random(4)
    for _ in range(300):
        start, size = r.randrange(len(data) + 50), r.randrange(0, 700)
        file.seek(start)
        assert file.read(size) == data[start : start + size] and len(file._blocks) <= 3
    file.want(0, 5_000)
    before = file.requests
    file.seek(17)
    assert file.read(4_000) == data[17:4_017] and file.requests == before
    with pytest.raises(ValueError):
        file.seek(-1)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    held = io.BytesIO(_deck())
    with zipfile.ZipFile(held, "a") as archive:
        archive.writestr("ppt/media/media1.mp4", random.Random(1).randbytes(4 << 20))
    word = _zip({"word/document.xml": "<w><p><t>First</t></p></w>", "word/media/a.png": _png(60, 60)})
    files = {"big.pptx": held.getvalue(), "i.xlsx": _book(), "h.docx": word, "t.txt": b"words", "deck": _deck(), "bad.pptx": b"x" * 99, "tool.exe": b"x", "z.zip": _zip({"in.docx": word, "a.txt": "x"})}
    for name, data in files.items():
        (at / name).write_bytes(data)
    return at, files


def test_records_are_the_same_by_range_and_whole(spark, folder, tmp_path):
    at, files = folder
    paths = spark.createDataFrame([(f"file://{at}/{n}",) for n in [*files, "none.docx"]], "path string")
    got = {}
    for kind, threshold in (("range", 0), ("buffer", 1 << 30)):
        found = read_paths(paths, counting(tmp_path / kind), options=Options(range_threshold=threshold, block=16 << 10))
        got[kind] = {os.path.basename(r.path): r for r in found.collect()}
    by_range, whole = got["range"], got["buffer"]
    for name, r in by_range.items():
        assert r.asDict() | {"strategy": 0, "fetched": 0} == whole[name].asDict() | {"strategy": 0, "fetched": 0}, name
    big = by_range["big.pptx"]
    assert (big.strategy, big.units, big.stats.charts) == ("range", 4, 1) and [i.name for i in big.images][-1] == "media1.mp4"
    reads = _reads(tmp_path / "range")
    assert sum(reads["big.pptx"]) == big.fetched < len(files["big.pptx"]) / 4
    assert {n: r.strategy for n, r in whole.items() if n in ("big.pptx", "i.xlsx", "h.docx")} == {"big.pptx": "buffer", "i.xlsx": "buffer", "h.docx": "buffer"}
    once = _reads(tmp_path / "buffer")
    assert all(once[n] == [len(files[n])] for n in ("big.pptx", "i.xlsx", "h.docx", "bad.pptx"))  # one read a file
    assert by_range["deck"].error == "UNSUPPORTED_FILE_TYPE" or by_range["deck"].kind == "zip"
    assert by_range["bad.pptx"].error == "EXTRACTION_FAILED" and by_range["none.docx"].error == "FILE_NOT_FOUND" and by_range["tool.exe"].error == "UNSUPPORTED_FILE_TYPE"
    assert by_range["t.txt"].text == "words" and by_range["z.zip"].units == 2


def lengths():
    class Lengths:
        """A converter that tells what it was given."""

        def convert(self, name, content):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                return " ".join(f"{i.filename}={i.file_size}" for i in archive.infolist() if "media" in i.filename) or "none"

    return Lengths()


def test_a_converter_gets_a_slim_copy_of_what_was_read_by_ranges(spark, folder):
    at, files = folder
    paths = spark.createDataFrame([(f"file://{at}/big.pptx",)], "path string")
    slim = read_paths(paths, converter=lengths(), options=Options(range_threshold=0)).head()
    assert "media1.mp4=0" in slim.markdown and "a.png=0" in slim.markdown and slim.text.startswith("one")
    assert f"media1.mp4={4 << 20}" in read_paths(paths, converter=lengths()).head().markdown


def test_limits_are_options(spark, folder):
    at, _ = folder
    paths = spark.createDataFrame([(f"file://{at}/{n}",) for n in ("i.xlsx", "t.txt", "big.pptx")], "path string")
    got = {os.path.basename(r.path): r for r in read_paths(paths, options=Options(most_sheet_rows=3, most_bytes=4)).collect()}
    assert got["i.xlsx"].error == "FILE_TOO_LARGE" == got["t.txt"].error
    got = read_paths(paths.where(F.endswith("path", F.lit("xlsx"))), options=Options(most_sheet_rows=3)).head()
    assert got.warnings == ['Sheet "Two" cut at 3 rows.'] and got.sections[1].text.count("\n") == 3
