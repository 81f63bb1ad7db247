"""Readers and writers on small files."""

import pytest

from flowloom.operators.schema import SchemaError
from flowloom.sources import flows, lines


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_public_csv(spark, tmp_path):
    p = put(tmp_path / "a.csv", "﻿ Source IP, Timestamp,X,X,labels\n1.1.1.1,03/07/2017 08:55:58,1,2,BENIGN\n2.2.2.2,bad,3,4,DoS\n")
    df = flows.read_flow_csv(spark, p, strict=True).orderBy("row_id")
    assert df.columns == ["Source IP", "Timestamp", "X", "X.1", "Label", "row_id"]
    got = df.select("row_id", "`Source IP`", "`X.1`", "Label", "Timestamp").collect()
    assert [tuple(map(str, r)) for r in got] == [
        ("0", "1.1.1.1", "2", "BENIGN", "2017-07-03 08:55:58"), ("1", "2.2.2.2", "4", "DoS", "None")]


def test_strict_reading(spark, tmp_path):
    with pytest.raises(flows.InputError, match="no rows"):
        flows.read_flow_csv(spark, put(tmp_path / "e.csv", "a,b\n"), strict=True)
    with pytest.raises(flows.InputError, match="empty"):
        flows.read_flow_csv(spark, put(tmp_path / "z.csv", ""), strict=True)
    with pytest.raises(flows.InputError, match="UTF-8"):
        flows.read_flow_csv(spark, put(tmp_path / "l.csv", "a,b\né,2\n", "latin-1"), strict=True)


def test_corporate_columns(spark, tmp_path):
    with pytest.raises(SchemaError, match="Destination IP"):
        flows.read_corporate_csv(spark, put(tmp_path / "c.csv", "Label,Source IP\nBENIGN,1.1.1.1\n"))
    full = "Label,Source IP,Destination IP\nBENIGN,1.1.1.1,2.2.2.2\n"
    assert flows.read_corporate_csv(spark, put(tmp_path / "d.csv", full)).count() == 1
    with pytest.raises(SchemaError, match="Timestamp"):
        flows.read_corporate_csv(spark, put(tmp_path / "f.csv", full), strict_timestamp=True)


def test_append_needs_equal_schema(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    flows.write_prepared(df, path)
    flows.write_prepared(df, path, append=True)
    for other in (df.select("y", "x"), df.drop("y"), df.selectExpr("*", "1 AS z")):
        with pytest.raises(SchemaError):
            flows.write_prepared(other, path, append=True)
    assert spark.read.parquet(path).count() == 2


def test_cache_follows_the_source(spark, tmp_path):
    p = tmp_path / "f.csv"
    root = str(tmp_path / "cache")
    put(p, "a,Label\n1,x\n")
    assert flows.read_flows(spark, str(p), columnar_cache=True, cache_root=root).count() == 1
    put(p, "a,Label\n1,x\n2,y\n")
    assert flows.read_flows(spark, str(p), columnar_cache=True, cache_root=root).count() == 2
    assert [r.a for r in flows.read_flows(spark, str(p), row_limit=1).collect()] == ["1"]


def test_labels_json(spark, tmp_path):
    p = put(tmp_path / "l.json", '[{"sample_id": "a", "is_attack": 1}, {"sample_id": "b", "is_attack": 0}]')
    assert sorted(tuple(r) for r in lines.read_labels(spark, p).select("sample_id", "is_attack").collect()) == [("a", "1"), ("b", "0")]


def test_row_ids_follow_the_files_without_moving_rows(spark, tmp_path):
    """Several files, in splits of a few lines and packed into few partitions; no exchange carries a column of the file."""
    for f, n in (("b", 500), ("a", 40), ("c", 3)):
        (tmp_path / f"{f}.csv").write_text("x,payload\n" + "".join(f"{f}{i:04d},p{i}\n" for i in range(n)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        df = flows.with_row_ids(flows.read_csv_text(spark, str(tmp_path)))
        got = [(r.row_id, r.x) for r in df.orderBy("row_id").collect()]
        parts = df.rdd.getNumPartitions()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    expected = sorted(f"{f}{i:04d}" for f, n in (("a", 40), ("b", 500), ("c", 3)) for i in range(n))
    assert got == list(enumerate(expected)) and parts > 4
    assert df.columns == ["x", "payload", "row_id"]
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan
    assert flows.with_row_ids(flows.read_csv_text(spark, str(tmp_path)).filter("x = 'none'")).count() == 0


def test_labelled_files_of_other_orders(spark, tmp_path):
    """Values go by name; quoted commas, blank lines, short rows and a file of only a header are read as they are."""
    for name, text in {
        "a.csv": ' x , y\n1,"p,q"\n\n2,\n', "b.csv": "Y,z,X\nr,7,3\ns\n", "c.csv": "z\n", "d.csv": "z,x\nz,x\n",
    }.items():
        put(tmp_path / name, text)
    df = flows.read_labelled_files(spark, [str(tmp_path / f"{n}.csv") for n in "abcd"])
    got = [tuple(r) for r in df.select("row_id", "x", "y", "z", "source_file").orderBy("row_id").collect()]
    assert got == [
        (0, "1", "p,q", None, "a.csv"), (1, "2", None, None, "a.csv"), (2, "3", "r", "7", "b.csv"), (3, None, "s", None, "b.csv"),
        (4, "x", None, "z", "d.csv"),
    ]
