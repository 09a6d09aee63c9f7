"""Capture files: many of them, cut ones, splits at any byte, growing files in a stream."""

import os
import random

import pytest

from tests.test_streams import drained
from tracewell.plans import sources as plans
from tracewell.sources import capture
from tracewell.sources.capture_files import BLOCK_HEAD, CaptureFiles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(CaptureFiles)


def records(spark):
    return plans._records(spark, SF).select("record")


def load(spark, path, **options):
    return spark.read.format("capture").options(**options).load(str(path))


def files(path):
    return sorted(f for f in os.listdir(path) if not f.startswith("."))


@pytest.mark.parametrize("layout,block_bytes", [("framed", 200), ("framed", 4000), ("framed", 262144), ("fixed", 0)])
def test_records_of_many_files(spark, tmp_path, layout, block_bytes):
    options = {"layout": layout} | ({"block_bytes": block_bytes} if block_bytes else {"record_size": 128})
    records(spark).repartition(5).write.format("capture").options(**options).mode("append").save(str(tmp_path / "c"))
    assert len(files(tmp_path / "c")) == 5
    want = capture.decoded(records(spark)).select("timestamp_ns", "pid", "kind", "src_ip", "payload")
    for most in (3001, 1 << 20):  # splits within blocks and records
        got = capture.decoded(load(spark, tmp_path / "c", max_partition_bytes=most, **options)).select(want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    places = load(spark, tmp_path / "c", **options).select("path", "offset", "place")
    assert places.distinct().count() == places.count() == 1000


@pytest.mark.parametrize("cut", [1, 30, 61, 300, 1000])
def test_a_cut_file_gives_its_whole_records(spark, tmp_path, cut):
    records(spark).repartition(3).write.format("capture").option("block_bytes", 900).mode("append").save(str(tmp_path / "c"))
    name = tmp_path / "c" / files(tmp_path / "c")[1]
    before = [r.record for r in load(spark, name).orderBy("offset", "place").collect()]
    other = load(spark, tmp_path / "c").count() - len(before)
    data = name.read_bytes()[:-cut]
    name.write_bytes(data)
    # What is whole, walking over the blocks by hand.
    at, left = 28, 0
    while at + 28 <= len(data):
        n, count, _ = BLOCK_HEAD.unpack_from(data, at + 16)
        body, k = data[at + 28 : at + 28 + n], 0
        while k + 4 <= len(body) and k + 4 + int.from_bytes(body[k : k + 4], "little") <= len(body):
            k += 4 + int.from_bytes(body[k : k + 4], "little")
            left += 1
        at += 28 + n
    for most in (1777, 1 << 20):
        got = [r.record for r in load(spark, name, max_partition_bytes=most).orderBy("offset", "place").collect()]
        assert got == before[:left] and len(got) < len(before)
    assert load(spark, tmp_path / "c").count() == other + left
    fixed = tmp_path / "fixed"
    records(spark).coalesce(1).write.format("capture").options(layout="fixed", record_size=100).mode("append").save(str(fixed))
    name = fixed / files(fixed)[0]
    name.write_bytes(name.read_bytes()[:-cut])
    assert load(spark, fixed, layout="fixed", record_size=100).count() == (100_000 - cut) // 100


def test_damaged_and_odd_files(spark, tmp_path):
    path = tmp_path / "c"
    records(spark).coalesce(1).write.format("capture").option("block_bytes", 900).mode("append").save(str(path))
    name = path / files(path)[0]
    data = bytearray(name.read_bytes())
    data[200] ^= 1  # within the first block: its checksum doesn't hold
    name.write_bytes(data)
    count = int.from_bytes(data[28 + 20 : 28 + 24], "little")
    assert load(spark, path).count() == 1000 - count
    (path / "empty").write_bytes(b"")
    (path / "_hidden").write_bytes(b"nothing of ours")
    assert load(spark, path).count() == 1000 - count
    (path / "other").write_bytes(b"nothing of ours, but as long as a header")
    with pytest.raises(Exception, match="no file of captured blocks"):
        load(spark, path).count()
    with pytest.raises(Exception, match="capture files are appended to"):
        records(spark).write.format("capture").mode("overwrite").save(str(path))
    (tmp_path / "none").mkdir()
    assert load(spark, tmp_path / "none").count() == 0


@pytest.mark.parametrize("layout", ["framed", "fixed"])
def test_stream_resumes_in_growing_files(spark, tmp_path, layout):
    options = {"layout": layout, "block_bytes": 700, "record_size": 100}
    whole = tmp_path / "whole"
    records(spark).repartition(3).write.format("capture").options(**options).mode("append").save(str(whole))
    data = {f: (whole / f).read_bytes() for f in files(whole)}
    want = sorted(r.record for r in load(spark, whole, **options).collect())
    live, out, checkpoint = tmp_path / "live", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    live.mkdir()
    rng = random.Random(3)
    shown = dict.fromkeys(data, 0)
    turns = 0
    while any(shown[f] < len(data[f]) for f in data):
        for f in data:  # cut anywhere, within blocks and headers too
            shown[f] = min(len(data[f]), shown[f] + rng.choice([0, 5, 40, 9000, 25000, 60000]))
            (live / f).write_bytes(data[f][: shown[f]])
        stream = spark.readStream.format("capture").options(**options).load(str(live))
        drained(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        turns += 1
    assert turns > 3
    assert sorted(r.record for r in spark.read.parquet(out).collect()) == want


def test_decoded_files_equal_the_table(spark):
    got = plans.capture_files(spark, SF)
    want = plans.record_decode(spark, SF).drop("seq")
    assert sorted(map(tuple, got.select(sorted(want.columns)).collect())) == sorted(map(tuple, want.select(sorted(want.columns)).collect()))
