"""An injected converter, and what PDF files say of themselves."""

import sys

from pyspark import cloudpickle

from paperloom.sources import pdf
from paperloom.sources.reader import read_documents

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


class Shouting:
    def convert(self, name, content):
        if b"bad" in content:
            raise OSError("no")
        return None if b"none" in content else "# Title\n\n**" + content.decode() + "**" + "x" * (300_000 if b"long" in content else 0)


def test_converter_comes_first(spark):
    rows = [("a.xls", b"cells"), ("b.xls", b"bad"), ("c.html", b"<p>none"), ("d.html", b"hi"), ("e.txt", b"plain"), ("f.csv", b"long")]
    got = {r.path: r for r in read_documents(spark.createDataFrame(rows, "path string, content binary"), converter=Shouting()).collect()}
    assert (got["a.xls"].text, got["a.xls"].error, got["a.xls"].sections[0].reason, got["a.xls"].units) == ("Title\n\ncells", None, "tabular data", 1)
    assert got["b.xls"].error == "NEEDS_MARKITDOWN" and got["b.xls"].warnings == ["The converter failed: OSError"]
    assert got["c.html"].text == "none" and got["c.html"].warnings == ["The converter gave nothing."] and got["d.html"].markdown == "# Title\n\n**hi**" and got["d.html"].stats.words == 2
    assert got["e.txt"].text == "plain" and got["e.txt"].markdown is None and len(got["f.csv"].markdown) == 200_000 and got["f.csv"].warnings


def test_pdf_metadata(spark):
    body = b"%PDF-1.4\n1 0 obj << /Title (A \\(b\\)) /Author <FEFF00C9> /Subject () /CreationDate (D:20240506) >> endobj 2 0 obj << /Type /Catalog /Pages 3 0 R >> endobj 3 0 obj << /Kids [4 0 R] >> endobj 4 0 obj << /Type /Page >> endobj trailer << /Root 2 0 R /Info 1 0 R >>"
    df = spark.createDataFrame([("a.pdf", body), ("b.pdf", b"%PDF no"), ("c.pdf", None)], "path string, content binary")
    assert {(r.key, r.value) for r in pdf.pdf_metadata(df).where("path = 'a.pdf'").collect()} == {("Title", "A (b)"), ("Author", "É"), ("CreationDate", "2024-05-06T00:00:00Z")}
    got = {r.path: r for r in read_documents(df).collect()}
    assert got["a.pdf"].metadata["Title"] == "A (b)" and got["b.pdf"].error == "EXTRACTION_FAILED" and not got["b.pdf"].metadata
