"""Repeated blocks in parts that are only likely to be the article."""

from quarry.llm.html_text import extract_text

from .test_models import prose


def test_likely_parts_lose_repeated_blocks_but_keep_quotes(spark):
    notice = "Read more of our stories every day in the free letter by mail"
    quote = "We shall never leave the harbour before the last ship is home"
    page = lambda i: f'<div class="content"><p>{prose(i, 20)}</p><p>{notice}</p><blockquote>{quote}</blockquote><p>{prose(50 + i, 9)} {quote}</p></div>'
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(4)] + [(10 + i, f"http://h.example/n{i}", f'<div class="post"><p>{notice}</p></div><p>x{i}</p>') for i in range(2)]
    rows.append((20, "http://h.example/main", f"<article><p>{notice}</p></article>"))
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(4):
        assert got[i] == f"{prose(i, 20)} {quote} {prose(50 + i, 9)} {quote}"
    assert got[10] == got[11] == got[20] == notice
