"""Names of branches alone empty no page."""

import pytest

from paperloom.llm import extraction

LONG = "This is the main text of the page, which goes on for a while."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body class='right-sidebar'><p>{LONG}</p></body>", LONG),
        (f"<body><div class='content header-fixed'><article><p>{LONG}</p></article></div><footer>f</footer></body>", LONG),
        (f"<body><form id=aspnetForm><div><p>{LONG}</p></div></form></body>", LONG),
        (f"<body><form><nav>a b</nav><div><p>{LONG}</p></div></form></body>", LONG),
        (f"<body><div class=text><p>{LONG} {LONG}</p></div><article><p>Teaser</p></article></body>", f"{LONG} {LONG}\nTeaser"),
        (f"<html><head><title>T</title><script>'<div>'</script><meta charset=utf-8><body><p>{LONG}</p></body>", LONG),
        (f"<head><title>T</title><link href=x><p>{LONG}</p>", LONG),
        (f"<body><article><p>{LONG}</p><div class=comments>bad</div></article><aside>no</aside></body>", LONG),
    ],
)
def test_rules(spark, page, want):
    assert [r.text for r in extraction.extract_main_text(spark.createDataFrame([(1, "http://a.b/c", page)], "page_id long, url string, html string")).collect()] == [want]
