"""Line numbers of delimited files, counted block by block."""

import pytest

from quarry.sources.readers import SourceError, numbered_lines, read


def test_numbers_over_blocks_and_files(spark, tmp_path):
    for name, lo, hi in (("a.txt", 0, 5000), ("b.txt", 5000, 5003)):
        (tmp_path / name).write_text("".join(f"line {i}\n" for i in range(lo, hi)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = numbered_lines(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 3
        assert sorted((r["n"], r["value"]) for r in got.collect()) == [(i + 1, f"line {i}") for i in range(5003)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ranges_and_trailers(spark, tmp_path):
    (tmp_path / "x.csv").write_text("made by hand\nno,name\n1,a\n2,b\n3,c\nrows: 3\n")
    opts = {"PATH": str(tmp_path / "x.csv"), "START_AT": 2}
    assert [tuple(r) for r in read(spark, "FLATFILE", opts | {"END_AT": 4}).collect()] == [("1", "a"), ("2", "b")]
    assert [tuple(r) for r in read(spark, "FLATFILE", opts | {"COUNT_AT_END": "ON"}).collect()] == [("1", "a"), ("2", "b"), ("3", "c")]
    with pytest.raises(SourceError, match="counts 3"):
        read(spark, "FLATFILE", opts | {"START_AT": 3, "COUNT_AT_END": "ON"})


def test_top_percent_by_a_boundary_takes_the_same_rows(spark):
    from quarry.operators.windows import top_percent

    df = spark.range(0, 3000, 1, 5).selectExpr("id", "case when id % 11 = 0 then null else id % 7 end as a", "cast(id % 13 as double) as b")
    for order in ("a DESC, b", "b NULLS LAST, a DESC, id", "a, b DESC, id DESC"):
        whole, split = (top_percent(df, order, 12.5, n) for n in (10_000, 10))
        total = "id" in order
        key = lambda r: (r["id"],) if total else (r["a"], r["b"])  # noqa: B023, E731
        assert sorted(map(key, whole.collect()), key=str) == sorted(map(key, split.collect()), key=str)
        assert split.count() == 375
