import json

from palimpsest.operators import decode
from palimpsest.streaming import arrivals
from tests import builders as B


def test_arrivals(spark, tmp_path):
    files, lists = tmp_path / "files", tmp_path / "lists"
    files.mkdir(), lists.mkdir()
    for name, data in {"a.scpt": B.compiled(), "b.scpt": B.compiled(), "s": B.stack(), "disk": B.disk(True, [("in", B.stack(b"\xff" * 96), b"")])}.items():
        (files / name).write_bytes(data)
    put = lambda n, *names: (lists / f"{n}.json").write_text("".join(json.dumps({"path": str(files / x), "rel": x, "arrived": f"2026-01-01T00:0{n}:00"}) + "\n" for x in names))
    put(1, "a.scpt", "gone")
    stream = arrivals.first_seen(arrivals.read(arrivals.listed(spark, str(lists), 1)))
    q = stream.writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
        put(2, "b.scpt", "s", "disk")
        q.processAllAvailable()
        seen = spark.table("seen")
        assert sorted(r.rel for r in seen.collect()) == ["a.scpt", "disk/Disk/in", "gone", "s"]
        assert seen.where("kind = 'error'").count() == 1 and decode.layers(seen).count() == 6
    finally:
        q.stop()
