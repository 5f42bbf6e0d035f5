"""Page text on hosts of many shards: as if one suffix array held the whole host."""

from quarry.llm.html_text import extract_text

from .test_models import prose


def test_shards_do_not_change_the_result(spark):
    passage = "Terms of this offer hold for members who signed up before the end of spring"
    rows = [(i, f"http://big.example/{i}", f"<div>{passage if i in (3, 40) else ''}</div><div>{prose(i, 20)}</div>") for i in range(60)]
    rows += [(100 + i, f"http://big.example/copy{i}", f"<div>{prose(500, 30)}</div>") for i in range(20)]  # equal pages are one page
    rows += [(200 + i, f"http://small.example/{i}", f"<div>{passage}</div><div>{prose(300 + i, 20)}</div>") for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {r["page_id"]: r for r in extract_text(df, shard=1000).collect()}
    dealt = {r["page_id"]: r for r in extract_text(df, shard=2).collect()}
    assert dealt == whole
    assert all(dealt[i]["text"] == prose(i, 20) and dealt[i]["n_repeated"] > 0 for i in (3, 40))
    assert dealt[100]["text"] == prose(500, 30) and dealt[100]["n_repeated"] == 0
    assert {i: r for i, r in dealt.items()} == {r["page_id"]: r for r in extract_text(df, least=2, shard=7).collect()}
    assert {r["page_id"]: r for r in extract_text(df, least=3, shard=3).collect()} == {r["page_id"]: r for r in extract_text(df, least=3, shard=1000).collect()}
