"""Repeats across batches and restarts of a stream; prints as one file a resource."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peakfold.sources import printfiles
from peakfold.streaming.worker import unique_entries


def test_repeats_across_batches_and_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def put(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"ts": f"2026-01-01T{t}:00Z", "key": k, "value": v}) for t, k, v in rows))

    def run():
        stream = spark.readStream.schema("ts timestamp, key string, value string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = unique_entries(stream, ["key", "value"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(((r.key, r.value, r.n) for r in spark.read.parquet(str(tmp_path / "out")).groupBy("key", "value").agg(F.count("*").alias("n")).collect()), key=repr)

    put("1.json", [("10:00", "a", "x"), ("10:00", "a", "x"), ("10:01", "b", "x")])
    assert run() == [("a", "x", 1), ("b", "x", 1)]
    put("2.json", [("10:02", "a", "x"), ("10:02", "a", "y")])
    assert run() == [("a", "x", 1), ("a", "y", 1), ("b", "x", 1)]
    put("3.json", [("10:03", "a", "y"), ("10:03", "c", "z")])
    put("4.json", [("10:04", "c", "z"), ("10:04", None, None), ("10:04", None, None)])
    assert run() == [("a", "x", 1), ("a", "y", 1), ("b", "x", 1), ("c", "z", 1), (None, None, 1)]
    for name, rows in (("5.json", [("11:00", "d", "w")]), ("6.json", [("11:30", "e", "w")]), ("7.json", [("11:31", "a", "x")])):
        put(name, rows)
        last = run()
    assert ("a", "x", 2) in last and ("d", "w", 1) in last  # the first one's state has expired by then, so it is a new entry


PRINTS = "resource_id long, hash long, t1 int, f1 int"


def test_a_file_for_each_resource(spark, tmp_path):
    path = str(tmp_path / "tdb")
    rows = [(r, 100 * r + t, t, t % 5 if r % 2 else None) for r in range(-1, 12) for t in range(30)]
    printfiles.write_print_files(spark.createDataFrame(rows, PRINTS).repartition(5), path)
    assert sorted(p.name for p in (tmp_path / "tdb").iterdir()) == sorted(f"{r}.tdb" for r in range(-1, 12))
    assert (tmp_path / "tdb" / "3.tdb").read_text().splitlines()[:2] == ["300 0 0", "301 1 1"]
    back = printfiles.read_print_files(spark, path)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    one = back.where("resource_id = 3")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 30
    plan = one._jdf.queryExecution().executedPlan().toString()
    reader = printfiles.Reader({"path": path})
    left = list(reader.pushFilters([printfiles.EqualTo(("resource_id",), 3), printfiles.In(("resource_id",), (3, 4)), printfiles.EqualTo(("hash",), 1)]))
    assert [p.names for p in reader.partitions()] == [(f"{path}/3.tdb",)] and len(left) == 1 and "printfiles" in plan
    assert back.where("resource_id in (1, 2, 99)").count() == 60 and back.where("resource_id = 99").count() == 0


def test_files_are_replaced_and_odd_lines_passed_over(spark, tmp_path):
    path = str(tmp_path / "tdb")
    frame = lambda rows: spark.createDataFrame(rows, PRINTS)
    printfiles.write_print_files(frame([(1, 5, 1, None), (2, 6, 1, None)]), path)
    printfiles.write_print_files(frame([(1, 7, 2, 3)]), path)
    assert sorted(map(tuple, printfiles.read_print_files(spark, path).collect())) == [(1, 7, 2, 3), (2, 6, 1, None)]
    printfiles.write_print_files(frame([(3, 8, 2, 3)]), path, "overwrite")
    (tmp_path / "tdb" / "4.tdb").write_text("x y\n9 1\n\n10 2 3 4\n11 5 6")
    (tmp_path / "tdb" / "note.txt").write_text("1 2 3")
    assert sorted(map(tuple, printfiles.read_print_files(spark, path).collect()), key=repr) == [(3, 8, 2, 3), (4, 11, 5, 6), (4, 9, 1, None)]
    with pytest.raises(Exception, match="write_print_files"):
        frame([(5, 1, 1, 1), (6, 1, 1, 1), (5, 2, 2, 2)]).coalesce(1).write.format("printfiles").mode("append").save(path)
    assert sorted(p.name for p in (tmp_path / "tdb").iterdir()) == ["3.tdb", "4.tdb", "note.txt"]


def test_print_files_are_written_from_batches_and_read_many_at_a_time(tmp_path):
    """A resource's rows may go on in the next batch; a batch that is read has the rows of several files."""
    schema = pa.schema([("resource_id", pa.int64()), ("hash", pa.int64()), ("t1", pa.int32()), ("f1", pa.int32())])
    rows = [(1, 5, 1, None), (1, 6, 2, 7), (2, 8, 0, None), (3, 9, 3, 4)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)
    writer = printfiles.Writer({"path": str(tmp_path)}, False)
    writer.commit([writer.write(iter([batch(rows[:1]), batch(rows[1:])]))])
    assert (tmp_path / "1.tdb").read_text() == "5 1\n6 2 7\n" and len(list(tmp_path.iterdir())) == 3
    reader = printfiles.Reader({"path": str(tmp_path)})
    (part,) = reader.partitions()
    (back,) = reader.read(part)
    assert [tuple(r.values()) for r in back.to_pylist()] == rows
    with pytest.raises(ValueError, match="write_print_files"):
        writer.write(iter([batch([rows[0], rows[2], rows[1]])]))
