"""Leases that run out, of a log at rest and of a stream."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from peakfold.streaming import leases

LOG = "key long, owner string, ts timestamp, kind string"
START = dt.datetime(2026, 1, 1, 10)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def plain(rows, idle, now):
    """Each lease against each later row of its owner."""
    rows = [r for r in rows if None not in r[:3]]
    out = set()
    for k, o, t, kind in rows:
        done = any(r[:3] == (k, o, t) and r[3] == leases.DONE for r in rows)
        heard = any(r[:2] == (k, o) and t < r[2] <= t + dt.timedelta(seconds=idle) for r in rows)
        if kind != leases.DONE and not done and not heard and t + dt.timedelta(seconds=idle) < now:
            out.add((k, o, t, t + dt.timedelta(seconds=idle)))
    return sorted(out)


def made(n, seed):
    """Many rows of one entry, ties, repeats and the very ends of leases."""
    rng = random.Random(seed)
    kinds = ["delivered", "renewed", "renewed", leases.DONE, None]
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.choice("ab"), at(rng.randrange(0, 4000, 5)), rng.choice(kinds)) for _ in range(n)]
    return rows + rows[:9] + [(9, "a", at(0), "delivered"), (9, "a", at(60), "renewed"), (9, "a", at(121), leases.DONE)]


def result(df):
    return sorted(map(tuple, df.collect()))


def test_leases_of_a_log_equal_a_plain_version(spark):
    rows = made(300, 1)
    odd = [(None, "a", at(1), "renewed"), (1, None, at(1), "renewed"), (1, "a", None, "renewed")]
    now = at(4000)
    got = result(leases.lapsed(spark.createDataFrame(rows + odd, LOG).withColumn("lapsed", F.lit("clash")), 60, F.lit(now)))
    assert got == plain(rows + odd, 60, now)
    assert (9, "a", at(60), at(120)) in got and (9, "a", at(0), at(60)) not in got
    assert leases.lapsed(spark.createDataFrame([], LOG), 60, F.lit(now)).count() == 0


def test_leases_of_a_stream_equal_those_of_the_log(spark, tmp_path):
    rows = made(120, 2)
    end = [(99, "z", at(9000), leases.DONE)]
    (tmp_path / "in").mkdir()

    def put(name, part):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"key": k, "owner": o, "ts": t.isoformat() + "Z", "kind": kind}) for k, o, t, kind in part))

    def run():
        read = lambda: spark.readStream.schema(LOG).json(str(tmp_path / "in"))
        q = leases.lapsed_stream(read(), read(), 60).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return result(spark.read.parquet(str(tmp_path / "out")))

    rows.sort(key=lambda r: r[2])
    cut = rows[len(rows) // 2][2]
    put("1.json", [r for r in rows if r[2] <= cut])
    first = run()
    put("2.json", [r for r in rows if r[2] > cut])
    put("3.json", end)
    assert first and all(r[3] <= cut for r in first)
    assert run() == plain(rows + end, 60, at(9000))
