"""General forms where the probes' tables are too small or too plain to tell right from wrong."""

import datetime
import random

import numpy as np
from palimpsest.operators import decode
from palimpsest.plans import shapes
from tests import builders as B


def test_asof_over_many_ranges(spark):
    r = np.random.default_rng(1)
    times, starts = r.integers(0, 10**9, 400_000), np.unique(r.integers(10**6, 10**9, 30_000))
    probes = spark.createDataFrame(__import__("pandas").DataFrame({"k": np.arange(len(times)), "t": times}))
    points = spark.createDataFrame(__import__("pandas").DataFrame({"s": starts, "v": np.arange(len(starts))}))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = shapes.asof(probes, "t", points, "s", ["v"]).toPandas().sort_values("k")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want = np.searchsorted(starts, times, "right") - 1
    assert len(got) == len(times) and (got.v.fillna(-1).to_numpy() == want).all()


def test_asof_of_odd_times(spark):
    day = lambda k: datetime.datetime(2020, 1, k)
    probes = spark.createDataFrame([(1, None), (2, day(1)), (3, day(2)), (4, day(9)), (4, day(9))], "k int, t timestamp_ntz")
    points = spark.createDataFrame([(day(2), "a"), (day(2), "b"), (day(5), "c"), (None, "never")], "s timestamp_ntz, v string")
    got = sorted((x.k, x.v) for x in shapes.asof(probes, "t", points, "s", ["v"]).collect())
    assert got == [(1, None), (2, None), (3, got[2][1]), (4, "c"), (4, "c")] and got[2][1] in ("a", "b")
    assert [x.v for x in shapes.asof(probes, "t", points.where("false"), "s", ["v"]).collect()] == [None] * 5
    assert shapes.asof(probes.where("false"), "t", points, "s", ["v"]).count() == 0


def test_outputs_keep_their_folders(spark, tmp_path):
    rows = [("Disk/A/Backup.scpt", "one"), ("Disk/B/Backup.scpt", "two"), ("Disk/B/Backup.scpt", "two"), ("Disk/a:b?/x. ", "three"), ("Disk/none", None), ("../up", "four")]
    done = spark.createDataFrame([("i", rel, "decompile", out, ".applescript", None, False) for rel, out in rows], "file_id string, rel string, cmd string, out string, ext string, error string, skipped boolean")
    decode.write_results(done, str(tmp_path / "table"))
    want = {"Disk/A/Backup.applescript": "one", "Disk/B/Backup.applescript": "two", "Disk/a_b_/x__.applescript": "three"}
    got = {r.file: r.out for r in spark.read.parquet(str(tmp_path / "table")).collect()}
    assert {k: v for k, v in got.items() if v != "four"} == want
    told = decode.write_files(done, str(tmp_path / "files")).collect()
    assert len(told) == 4 and all((tmp_path / "files" / k).read_text() == v for k, v in want.items())
    assert not (tmp_path / "up.applescript").exists()


def test_analytics_over_results(spark):
    schema = "rel string, cmd string, out string, error string, skipped boolean, kind string"
    before = spark.createDataFrame([("a", "d", "x\ny\nz", None, False, "script"), ("b", "d", "same", None, False, "text"), ("c", "d", None, "bad", False, "stack"), ("e", "d", None, None, True, "stack")], schema)
    after = spark.createDataFrame([("a", "d", "x\nz\ny", None, False, "script"), ("b", "d", "same", None, False, "text"), ("c", "d", "new", None, False, "stack")], schema)
    assert {r.outcome: r.n for r in decode.outcomes(before).collect()} == {"pass": 1, "plaintext": 1, "fail": 1, "skip": 1}
    got = {r.rel: r["diff"].split("\n")[3:] for r in decode.differences(before, after).collect()}
    assert got == {"a": [" x", "+z", " y", "-z"], "c": ["+new"]}
    assert decode.status(before).first().status == 1 and decode.status(before.where("error is null")).first().status == 0
    assert decode.status(before.where("false")).first().status == 0


def test_cards_missing(spark):
    whole = B.stack()
    damaged = bytearray(whole)
    at = whole.index(b"STAK") - 4
    damaged[at + 44 : at + 48] = (99).to_bytes(4, "big")
    files = spark.createDataFrame([("whole", "stack", bytearray(whole), None), ("damaged", "stack", damaged, None)], "file_id string, kind string, data binary, rsrc binary")
    found = {r.file_id: (r.told, r.found) for r in decode.cards_missing(files).collect()}
    assert found["damaged"][0] == 99 and found["damaged"][1] > 0
    assert {r.file_id: r.n_cards for r in decode.cards_told(files).collect()}["damaged"] == 99


def test_lines_that_changed(spark):
    r = random.Random(2)
    a, b = ([(r.choice("pqrs"), r.randint(0, 3)) for _ in range(200)] for _ in range(2))
    left, right = (spark.createDataFrame(x, "k string, v int") for x in (a, b))
    got = sorted((x.k, x.v, x.change) for x in shapes.changed_lines(left, right).collect())
    want = sorted([(*x, "-") for x in left.exceptAll(right).collect()] + [(*x, "+") for x in right.exceptAll(left).collect()])
    assert got == want
