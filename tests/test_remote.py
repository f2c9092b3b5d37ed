"""A remote folder read as a whole, and again from the cache."""

import hashlib

from pyspark.sql import functions as F

from paperloom.options import Options, PaperloomError
from paperloom.sources.remote import read_folders


def remote(log, files, broken=()):
    log = str(log)

    class Remote:
        def pages(self, folder):
            if folder == "gone":
                raise PaperloomError("DRIVE_REQUEST_FAILED", "404")
            entries = [{"id": i, "name": n, "mimeType": m, "size": None if d is None else str(len(d)), "md5Checksum": None if d is None or i == "p" else hashlib.md5(d).hexdigest()} for i, (n, m, d) in files.items()]
            yield entries[:2]
            yield entries[2:]

        def fetch(self, entry):
            with open(log, "a") as f:
                f.write(entry["id"] + "\n")
            if entry["id"] in broken:
                raise PaperloomError("DRIVE_REQUEST_FAILED", "500")
            return files[entry["id"]][2] or b"exported"

    return Remote()


FILES = {
    "a": ("a.txt", "text/plain", b"alpha beta"), "b": ("b.md", "text/markdown", b"# Title"), "c": ("copy.txt", "text/plain", b"alpha beta"), "d": ("bad.pdf", "application/pdf", b"%PDF-1.4 garbage"),
    "e": ("sub", "application/vnd.google-apps.folder", None), "f": ("tool.exe", "x/y", b"x"), "p": ("plain.txt", "text/plain", b"no key"), "g": ("gone.txt", "text/plain", b"lost"), "h": ("big.txt", "text/plain", b"x" * 400),
}


def test_a_folder_and_again(spark, tmp_path):
    folders, cache, options = spark.createDataFrame([("in",), ("gone",)], "folder string"), str(tmp_path / "cache"), Options(most_bytes=300)
    first = read_folders(folders, remote(tmp_path / "1", FILES, {"g"}), cache, "1", options)
    rows = {r.id: r for r in first.documents.collect()}
    assert {i: (r.text, r.error and r.error.split(":")[0], r.cached) for i, r in rows.items()} == {
        "a": ("alpha beta", None, False), "b": ("Title", None, False), "c": ("alpha beta", None, False), "d": (None, "EXTRACTION_FAILED", False), "p": ("no key", None, False),
        "g": (None, "DRIVE_REQUEST_FAILED", False), "h": (None, "FILE_TOO_LARGE", False), None: (None, "DRIVE_REQUEST_FAILED", False),
    }
    assert sorted((tmp_path / "1").read_text().split()) in (["a", "b", "d", "g", "p"], ["b", "c", "d", "g", "p"])  # equal contents once, the large one not at all
    assert sorted((r.id, r.kind) for r in first.skipped.collect()) == [("e", "folder"), ("f", "unsupported")]
    assert {r.folder: tuple(r)[1:] for r in first.counts.collect()} == {"in": (7, 4, 3, 0, 7), "gone": (1, 0, 1, 0, 1)}
    again = read_folders(folders.where("folder = 'in'"), remote(tmp_path / "2", FILES), cache, "2", options)
    rows = {r.id: r for r in again.documents.collect()}
    assert sorted((tmp_path / "2").read_text().split()) == ["d", "g", "p"]  # what failed, and what has no key
    assert {i for i, r in rows.items() if r.cached} == {"a", "b", "c"} and rows["c"].name == "copy.txt" and rows["b"].markdown == "# Title" and rows["g"].text == "lost"
    one = read_folders(folders.where("folder = 'in'"), remote(tmp_path / "3", FILES), cache, "3", options, only=spark.createDataFrame([("g",), ("f",)], "id string"))
    assert [(r.id, r.cached, r.text) for r in one.documents.collect()] == [("g", True, "lost")] and one.counts.select(F.sum("hits")).head()[0] == 1
