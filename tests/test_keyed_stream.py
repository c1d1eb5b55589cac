"""Keyed state in a stream: late and repeated rows over several runs give what one batch gives."""

import datetime as dt
import random

from pyspark.sql import functions as F

from granary.streaming import ingest as I
from granary.streaming import keyed as K

SCHEMA = "k string, ts timestamp, seq string, title string, cited int"
START = dt.datetime(2024, 1, 1)


def row(key, hours, seq, cited=None):
    return (key, START + dt.timedelta(hours=hours) if hours is not None else None, seq, f"{key}-{seq}", cited)


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, out, chk, late="2 days", horizon=3600):
    stream = I.files(spark, folder, spark.createDataFrame([], SCHEMA).schema, per_trigger=1)
    K.keep(K.changes(stream, "k", "ts", "seq", ["cited"], late, horizon), out, chk)


def table(df):
    return sorted(tuple(r) for r in df.select("k", "ts", "seq", "title", "cited").collect())


def test_three_runs_with_late_rows_give_the_batch_result(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    rng = random.Random(3)
    rows = [row(rng.choice("abcdefgh"), rng.randrange(40), f"{i:03}", rng.choice([None, i])) for i in range(300)] + [row("hot", i % 40, f"h{i:04}", i) for i in range(1500)]
    rng.shuffle(rows)
    for part in range(3):  # each run starts from the state that the one before left
        add(spark, src, rows[part::3] + [row(None, 1, "x"), row("n", None, "x")])
        run(spark, src, out, chk)
    written = spark.read.parquet(out)
    want = table(K.current(spark.createDataFrame(rows, SCHEMA), "k", "ts", "seq", ["cited"]))
    assert table(K.current(written, "k", "ts", "seq", ["cited"])) == want and len(want) == 9
    assert written.count() < len(rows) / 10  # what changes nothing is not written
    plain = {}
    for r in rows:
        plain.setdefault(r[0], []).append(r)
    for k, ts, seq, title, cited in want:
        first = min(plain[k], key=lambda r: (r[1], r[2]))
        patch = [r for r in plain[k] if r[4] is not None]
        assert (ts, seq, title) == first[1:4] and cited == (max(patch, key=lambda r: (r[1], r[2]))[4] if patch else None)


def test_silent_keys_are_forgotten_and_rows_behind_the_watermark_left_out(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    for rows in ([row("a", 0, "1", 1), row("b", 0, "1")], [row("b", 100, "2", 5)], [row("b", 101, "3"), row("a", 1, "0", 9)], [row("a", 102, "4", 7), row("b", 103, "5", 6)]):
        add(spark, src, rows)
        run(spark, src, out, chk, late="1 hour")
    got = sorted((r.k, r.seq, r.action) for r in spark.read.parquet(out).collect())
    # a is forgotten when the clock has passed it, so its row of hour 102 is a row again; its row of hour 1 came too late.
    assert ("a", "0", "row") not in got and ("a", "4", "row") in got and ("b", "2", "patch") in got
    assert ("a", START, "1", "a-1", 7) in table(K.current(spark.read.parquet(out), "k", "ts", "seq", ["cited"]))
    assert spark.read.parquet(out).where(F.col("action") == "row").where("k = 'b'").count() <= 2
