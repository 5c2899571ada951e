import numpy as np
from pyspark.sql import functions as F

from fringework.operators import dedisp
from fringework.streaming import blocks, sources


def chunks(spark, path, rows, schema, n=5):
    for k in range(n):
        spark.createDataFrame(rows[k::n], schema).coalesce(1).write.mode("append").parquet(path)


def test_power_cycle_comes_out_once(spark, tmp_path):
    rows = [(b, beam, (b * 7 + beam * 3 + i) % 256) for b in range(20) for beam in range(3) for i in range(4)]
    chunks(spark, f"{tmp_path}/in", rows, "block bigint, beam int, value bigint")
    s = spark.readStream.schema("block bigint, beam int, value bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    # a block's rows may come in several batches, so blocks are made whole first
    whole = spark.createDataFrame(rows, "block bigint, beam int, value bigint")
    for b in range(20):
        whole.where(f"block = {b}").coalesce(1).write.parquet(f"{tmp_path}/whole/b={b:02d}")
    s = spark.readStream.schema("block bigint, beam int, value bigint").option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/whole/*")
    c = blocks.power_cycle(s, 8)
    got = sources.finished(spark, blocks.to_folder(c, f"{tmp_path}/out", f"{tmp_path}/state"), f"{tmp_path}/out", c.schema)
    want = blocks.cycle_sums(whole, 8).where("cycle < 2")
    key = lambda d: sorted((r.beam, r.cycle, round(r.mean, 9), round(r.mean_square, 6)) for r in d.collect())
    assert key(got) == key(want) and got.count() == 6


def test_stream_of_voltages_with_weights(spark, tmp_path):
    rows = [(t, 0, a, p, (t * 31 + a * 17 + p) % 256) for t in range(6) for a in range(4) for p in range(2)]
    schema = "t bigint, chan int, ant int, pol int, byte int"
    chunks(spark, f"{tmp_path}/in", rows, schema, 3)
    w = spark.createDataFrame([(0, b, a, b - a, a) for b in range(2) for a in range(4)], "chan int, beam int, ant int, wre int, wim int")
    s = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = blocks.to_folder(s, f"{tmp_path}/out", f"{tmp_path}/state", lambda b: blocks.beams_with(b, lambda: w))
    whole = blocks.beams_with(spark.createDataFrame(rows, schema), lambda: w)
    got = sources.finished(spark, q, f"{tmp_path}/out", whole.schema)
    add = lambda d: sorted(map(tuple, d.groupBy("chan", "pol", "t", "beam").agg(F.sum("re"), F.sum("im")).collect()))
    assert add(got) == add(whole)


def test_overlapping_blocks_lose_nothing(spark):
    rows = [(0, c, t, (c * 5 + t * t) % 97) for c in range(4) for t in range(50)]
    fb = spark.createDataFrame(rows, "beam bigint, chan int, t bigint, x bigint")
    shifts = spark.createDataFrame([(c, d, c * d) for c in range(4) for d in range(4)], "chan int, dm_idx int, shift bigint")
    a = dedisp.shifted_sum(fb, shifts).select("beam", "dm_idx", "t", "value")
    for size in (7, 16, 100):
        b = dedisp.dedispersed_blocks(fb, shifts, size).select("beam", "dm_idx", "t", "value")
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_overlap_is_kept_between_batches(spark, tmp_path):
    """Blocks of nine samples, one micro-batch each: as the whole series, without what the end leaves incomplete."""
    rows = [(b, c, t, float((b * 11 + c * 5 + t * t) % 97)) for b in range(2) for c in range(4) for t in range(50)]
    schema = "beam bigint, chan int, t bigint, x double"
    for k in range(0, 50, 9):
        spark.createDataFrame([r for r in rows if k <= r[2] < k + 9], schema).coalesce(1).write.parquet(f"{tmp_path}/in/k={k:03d}")
    shifts = np.array([[0, 0, 0, 0], [7, 4, 2, 0], [13, 8, 3, 0]])
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = blocks.to_folder(blocks.dedispersed_stream(s, shifts), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sources.finished(spark, q, f"{tmp_path}/out", "beam bigint, dm_idx int, t bigint, value double")
    table = spark.createDataFrame([(c, d, int(shifts[d, c])) for c in range(4) for d in range(3)], "chan int, dm_idx int, shift bigint")
    whole = dedisp.shifted_sum(spark.createDataFrame(rows, schema), table, 50, complete=True)
    key = lambda x: sorted((r.beam, r.dm_idx, r.t, r.value) for r in x.collect())
    assert key(got) == key(whole) and q.lastProgress["batchId"] >= 4


def test_channels_that_come_later_are_added(spark, tmp_path):
    """A beam's channels over several micro-batches, one of them in pieces and behind the others, another twice: rows add up to the whole."""
    rows = [(b, c, t, float((b * 11 + c * 5 + t * t) % 97)) for b in range(2) for c in range(4) for t in range(50)]
    parts = [
        [r for r in rows if r[1] < 2], [r for r in rows if r[1] == 2 and r[2] < 20], [r for r in rows if r[1] == 3 and r[0] == 0],
        [r for r in rows if r[1] == 2 and r[2] >= 20], [r for r in rows if r[1] == 3 and r[0] == 1], [r for r in rows if r[1] == 1],
    ]
    schema = "beam bigint, chan int, t bigint, x double"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/k={k}")
    shifts = np.array([[0, 0, 0, 0], [7, 4, 2, 0], [13, 8, 3, 0]])
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = blocks.to_folder(blocks.dedispersed_stream(s, shifts), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sources.finished(spark, q, f"{tmp_path}/out", "beam bigint, dm_idx int, t bigint, value double").groupBy("beam", "dm_idx", "t").agg(F.sum("value").alias("value"))
    table = spark.createDataFrame([(c, d, int(shifts[d, c])) for c in range(4) for d in range(3)], "chan int, dm_idx int, shift bigint")
    whole = dedisp.shifted_sum(spark.createDataFrame([r for p in parts for r in p], schema), table, 50, complete=True)
    key = lambda x: sorted((r.beam, r.dm_idx, r.t, r.value) for r in x.collect())
    assert key(got) == key(whole) and q.lastProgress["batchId"] >= 5
