"""Files as streams with offsets, and record files with a two-phase commit."""

from __future__ import annotations

import csv
import json

import pytest
from pyspark.sql import functions as F

from orderweave.sources import sinks, tables
from orderweave.sources.files import FrameFiles, LineLogs, natural
from orderweave.sources.record_files import RecordFiles


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    for source in (FrameFiles, LineLogs, RecordFiles):
        spark.dataSource.register(source)


def run(stream, tmp_path, collect):
    query = stream.writeStream.foreachBatch(lambda df, n: collect.append([tuple(r) for r in df.collect()])).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()


def test_natural_order():
    names = ["b.jpg", "a10.jpg", "A2.jpg", "a1.jpg", "10.jpg", "9.jpg", "a01.jpg"]
    assert sorted(names, key=natural) == ["9.jpg", "10.jpg", "a01.jpg", "a1.jpg", "A2.jpg", "a10.jpg", "b.jpg"]


def test_frames_in_order_as_table(spark, tmp_path):
    for n in (1, 10, 2, 33):
        (tmp_path / f"f{n}.PNG").write_bytes(bytes([n]))
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "sub.jpg").mkdir()
    read = spark.read.format("frame_files").option("path", str(tmp_path)).option("content", "true").option("together", "2").load()
    assert [tuple(r) for r in read.orderBy("place").collect()] == [(k, "image", f"f{n}.PNG", 1, bytearray([n])) for k, n in enumerate((1, 2, 10, 33))]
    (tmp_path / "v1.mp4").write_bytes(b"")
    assert [r["name"] for r in spark.read.format("frame_files").option("path", str(tmp_path)).load().collect()] == ["v1.mp4"]
    (tmp_path / "none").mkdir()
    assert spark.read.format("frame_files").option("path", str(tmp_path / "none")).load().count() == 0


def test_a_restart_loses_and_repeats_no_frame(spark, tmp_path):
    folder, got = tmp_path / "in", []
    folder.mkdir()
    stream = lambda: spark.readStream.format("frame_files").option("path", str(folder)).load()
    for new in ((1, 2, 10), (11, 100), (), (101,)):
        for n in new:
            (folder / f"cam{n}.jpg").write_bytes(b"x")
        run(stream(), tmp_path, got)
    assert [(r[0], r[2]) for batch in got for r in sorted(batch)] == [(k, f"cam{n}.jpg") for k, n in enumerate((1, 2, 10, 11, 100, 101))]
    (folder / "cam5.jpg").write_bytes(b"x")  # before what was read
    with pytest.raises(Exception, match="lie before cam101.jpg"):
        run(stream(), tmp_path, got)


def test_a_restart_loses_and_repeats_no_line(spark, tmp_path):
    folder, got = tmp_path / "in", []
    folder.mkdir()
    log = folder / "site1.log"
    stream = lambda: spark.readStream.format("line_logs").option("path", str(folder)).option("piece", "7").load()
    log.write_bytes("first\nsécond\n\nhalf".encode())
    run(stream(), tmp_path, got)
    with log.open("ab") as f:
        f.write(b" a line\r\nlast\n")
    (folder / "site2.log").write_bytes(b"other\n" + b"long " * 5000 + b"\n")
    run(stream(), tmp_path, got)
    run(stream(), tmp_path, got)
    lines = sorted(r for batch in got for r in batch)
    assert [r[2] for r in lines] == ["first", "sécond", "", "half a line", "last", "other", "long " * 5000]
    assert [r[1] for r in lines[:5]] == [0, 6, 14, 15, 28] and sorted(got[0]) == lines[:3]


def test_commands_from_a_log(spark, tmp_path):
    folder, got = tmp_path / "in", []
    folder.mkdir()
    rows = [("shop/s1/cmd/Reset", {"type": "a", "tray_id": "003"}), ("shop/s1/cmd/plot", {"enable": "TRUE"}), ("other/cmd/x", {})]
    text = "".join(json.dumps({"ts": "2024-01-01T00:00:00", "topic": t, "payload": json.dumps(p)}) + "\n" for t, p in rows) + json.dumps({"topic": "shop/s1/cmd/reset", "payload": "{broken"}) + "\n"
    (folder / "feed.log").write_text(text)
    lines = spark.readStream.format("line_logs").option("path", str(folder)).load()
    feed = lines.select(F.from_json("line", "ts string, topic string, payload string").alias("m")).select("m.*")
    run(tables.commands(feed, "shop/s1").select("cmd", "tray_id", "type", "enable"), tmp_path, got)
    assert got == [[("reset", "003", "a", None), ("plot", None, None, True)]]


def records(folder):
    out = []
    for p in sorted(folder.glob("*.csv")):
        raw = p.read_bytes()
        assert raw.startswith(b"\xef\xbb\xbf") and raw.count(b"\xef\xbb\xbf") == 1
        rows = list(csv.reader(raw.decode("utf-8-sig").splitlines()))
        assert rows[0] == list(sinks.RECORD)
        out += [(p.name[:13], *r) for r in rows[1:]]
    return out


def orders(spark, *days):
    rows = [(f"t{k}", "001", day, [("お茶,\"x\"", 2)], 1.005) for k, day in enumerate(days)]
    df = spark.createDataFrame(rows, "tray_id string, order_number string, dt string, expected_item array<struct<item:string,n:int>>, expected_item_count double")
    return df.select("dt", *(sinks.record_field(F.col(c), df.schema[c].dataType).alias(c) if c in df.columns else F.lit("").alias(c) for c in sinks.RECORD))


def save(df, folder, batch):
    df.repartition("dt").write.format("record_files").mode("append").option("path", str(folder)).option("host", "kitchen-ab12").option("batch", batch).save()


def test_a_batch_of_records_is_written_once(spark, tmp_path):
    df = orders(spark, "20240101", "20240102", "20240101")
    save(df, tmp_path, "b1")
    save(df, tmp_path, "b1")
    save(orders(spark, "20240102"), tmp_path, "b2")
    got = records(tmp_path)
    assert sorted(r[:2] for r in got) == [("20240101_ab12", "t0"), ("20240101_ab12", "t2"), ("20240102_ab12", "t0"), ("20240102_ab12", "t1")]
    assert json.loads(got[0][5]) == [{"item": "お茶,\"x\"", "n": 2}] and not list((tmp_path / "_staging").glob("*"))


def test_a_failed_batch_leaves_nothing_and_may_be_repeated(spark, tmp_path):
    df = orders(spark, *["20240101"] * 50)
    boom = df.withColumn("tray_id", F.when(F.col("tray_id") == "t40", F.raise_error(F.lit("boom"))).otherwise(F.col("tray_id")))
    with pytest.raises(Exception, match="boom"):
        save(boom, tmp_path, "b1")
    assert records(tmp_path) == []
    # A commit that broke off after it had put some files in their place.
    (tmp_path / "20240101_ab12_b1_0.csv").write_text("﻿" + ",".join(sinks.RECORD) + "\r\nhalf\r\n")
    save(df, tmp_path, "b1")
    assert len(records(tmp_path)) == 50


def test_records_of_a_stream_are_written_once(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    out.mkdir()

    def go():
        stream = spark.readStream.schema(orders(spark, "x").schema).parquet(str(source))
        stream.writeStream.format("record_files").option("path", str(out)).option("host", "ab12").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    orders(spark, "20240101", "20240102").write.mode("append").parquet(str(source))
    go()
    for p in (tmp_path / "state" / "commits").glob("*"):  # the sink has the batch, but the query doesn't know
        p.unlink()
    orders(spark, "20240103").write.mode("append").parquet(str(source))
    go()
    assert sorted(r[0] for r in records(out)) == ["20240101_ab12", "20240102_ab12", "20240103_ab12"]
