import csv

import pytest

from lathe.sources import io


def test_scan_rules(spark, tmp_path):
    with pytest.raises(io.SourceError):
        io.read_table(spark, str(tmp_path / "missing.csv"))
    with pytest.raises(io.SourceError):
        io.read_table(spark, str(tmp_path / "data.txt"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    path = str(tmp_path / "Data.CSV")  # suffix check is case-insensitive
    df.coalesce(1).write.option("header", True).csv(path)
    got = io.read_table(spark, path)
    assert got.count() == 2 and got.columns == ["x", "y"]
    assert dict(got.dtypes)["x"] == "int"  # inferred without a schema
    empty = str(tmp_path / "empty.parquet")
    spark.createDataFrame([], "x int").write.parquet(empty)
    with pytest.raises(io.SourceError):
        io.read_table(spark, empty)


def test_merge_by_name(spark, tmp_path):
    a = spark.createDataFrame([(1, "a")], "x int, y string")
    b = spark.createDataFrame([("b", 2)], "y string, x int")
    pa, pb = str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")
    a.write.parquet(pa)
    b.write.parquet(pb)
    merged = io.read_tables(spark, f"{pa},{pb}")
    assert merged.columns == ["x", "y"] and sorted(tuple(r) for r in merged.collect()) == [(1, "a"), (2, "b")]
    c = spark.createDataFrame([(3, "c", 1.0)], "x int, y string, z double")
    with pytest.raises(io.SourceError):
        io.merge_tables([a, c])


def test_report_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("m1", 0.5)], "model_id string, value double")
    path = io.write_report(df, str(tmp_path / "r"))
    assert io.read_report(spark, path, df.schema).collect() == df.collect()


CELLS = ["plain", "a,b", 'He said ""hi"", ok', "line one\nline two", "dos\r\nline", "old\rmac", ' "', '"', "\\", 'x\\"', "tail\\", " padded ", "\n", "é,\"日\"", "5\" pipe", "'"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("cells", [CELLS, [c for c in CELLS if "\n" not in c and "\r" not in c], ["p", "q"]])
def test_quoted_csv(spark, tmp_path, cells, end):
    """Python's csv module writes and reads the same cells."""
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in cells for b in cells)]
    path = str(tmp_path / "a.csv")
    with open(path, "w", newline="", encoding="utf-8") as out:
        csv.writer(out, lineterminator=end).writerows([("id", "a", "b"), *rows])
    assert io.cells_span_lines(spark, path) == any("\n" in c or "\r" in c for c in cells)
    kept = [(i, a.replace(end, "\n"), b.replace(end, "\n")) for i, a, b in rows]
    assert sorted(tuple(r) for r in io.read_table(spark, path).collect()) == kept
    mine = io.write_csv(spark.createDataFrame(rows, "id int, a string, b string").coalesce(1), str(tmp_path / "b.csv"))
    assert sorted(tuple(r) for r in io.read_table(spark, mine, schema="id int, a string, b string").collect()) == rows
    part = next((tmp_path / "b.csv").glob("part-*"))
    with open(part, newline="", encoding="utf-8") as lines:
        assert sorted(csv.reader(lines)) == sorted([["id", "a", "b"], *([str(i), a, b] for i, a, b in rows)])


def test_csv_merge_with_line_breaks(spark, tmp_path):
    for name, text in (("a.csv", 'x,y\n1,"p\nq"\n'), ("b.csv", 'y,x\n"r, ""s""",2\n,3\n')):
        (tmp_path / name).write_text(text)
    got = io.read_tables(spark, f"{tmp_path}/a.csv, {tmp_path}/b.csv")
    assert sorted((r.x, r.y) for r in got.collect()) == [(1, "p\nq"), (2, 'r, "s"'), (3, None)]
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        (tmp_path / "c.csv").write_text('x,y\n1,2,3\n')
        io.read_table(spark, str(tmp_path / "c.csv")).collect()


def test_splittable_where_no_cell_spans_lines(spark, tmp_path):
    """A file without line breaks in cells is read by many tasks, one with them by one."""
    body = "".join(f'{i},"a ""b"", c"\n' for i in range(40_000))
    (tmp_path / "a.csv").write_text("x,y\n" + body)
    (tmp_path / "b.csv").write_text("x,y\n" + body + '1,"p\nq"\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        a, b = (io.read_table(spark, str(tmp_path / n), schema="x int, y string") for n in ("a.csv", "b.csv"))
        assert a.rdd.getNumPartitions() > 3 and b.rdd.getNumPartitions() == 1
        assert (a.count(), b.count()) == (40_000, 40_001) and a.select("y").distinct().count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
