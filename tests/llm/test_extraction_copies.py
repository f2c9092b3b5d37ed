"""Copies of a page on a host take no text away."""

from paperloom.llm import extraction

SCHEMA = "page_id long, url string, html string"


def test_copies_of_pages_count_once(spark):
    one = "<html><body><div class=text><p>The only block.</p></div></body></html>"
    many = "<html><body><div class=top>Same everywhere</div><div class=text>" + "".join(f"<p>Paragraph {i} of the copied page.</p>" for i in range(10)) + "</div></body></html>"
    own = "<html><body><div class=top>Same everywhere</div><div class=text><p>Own words {}.</p></div></body></html>"
    rows = [(i, "http://one.x/p", one) for i in range(5)] + [(i, f"http://many.x/{i}", many) for i in range(5, 3005)] + [(i, "http://many.x/o", own.format(i)) for i in range(3005, 3025)]
    got = {r.page_id: r.text for r in extraction.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    copied = "\n".join(f"Paragraph {i} of the copied page." for i in range(10))
    assert all(got[i] == "The only block." for i in range(5))
    assert all(got[i] == copied for i in range(5, 3005)) and all(got[i] == f"Own words {i}." for i in range(3005, 3025))
