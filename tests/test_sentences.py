"""Streams against the batch operators: shuffled micro-batches, late tasks and expiring state."""

from __future__ import annotations

import random

import pytest

from linewright.operators import captions
from linewright.streaming import sentences

DAY = 1_700_000_000_000


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sentences.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def streamed(spark, tmp_path, batches, schema, operator):
    """All rows that an operator gives for micro-batches, one file each."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i:03d}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = operator(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.read.parquet(f"{tmp_path}/out").collect(), query


CUES = "track_id string, pos long, start_ms long, end_ms long, text string"


def test_sentences_in_any_order_of_arrival(rocks, tmp_path):
    rng = random.Random(9)
    rows = []
    for k in ("a", "b", "c"):
        at = DAY
        for i in range(60):
            length = rng.choice([400, 1500, 2600, 7000])
            rows.append((k, i, at, at + length, " ".join(rng.choices(["w", "x y", "end.", "so,"], k=rng.choice([1, 2, 4])))))
            at += length + rng.choice([0, 300])
    batch = captions.sentence_segments(rocks.createDataFrame(rows, CUES), ["track_id"], ["start_ms", "pos"]).collect()
    arriving = sorted(rows, key=lambda r: r[2] + rng.randrange(40_000))  # at most forty seconds late
    batches = [arriving[i : i + 40] for i in range(0, len(arriving), 40)]
    far = DAY + 10**8
    batches += [[("end", 0, far, far + 1, "x")], [("end", 1, far + 10**7, far + 10**7, "y")], [("end", 2, far + 2 * 10**7, far + 2 * 10**7, "z")]]
    found, query = streamed(rocks, tmp_path, batches, CUES, lambda s: sentences.sentence_segments(s, "1 minute", 120_000))
    assert sorted(tuple(r) for r in found if r.track_id != "end") == sorted(tuple(r) for r in batch)
    # the tracks that ended have left no state: only the last one, still open, has some
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6


def test_late_tasks_fill_only_absent_keys(rocks, tmp_path):
    schema = "job string, batch_num long, task long, text string, at timestamp"
    stamp = lambda m: rocks.sql(f"select timestamp_millis({DAY + m * 60_000}) t").first().t
    batches = [
        [("j", 1, 2, "two", stamp(0)), ("j", 1, 1, "one", stamp(0)), ("j", 2, 1, None, stamp(0))],
        [("j", 1, 3, "late", stamp(1)), ("j", 2, 5, "filled", stamp(1)), ("k", 1, 9, "other", stamp(1))],
        [("j", 2, 1, "earlier task, later arrival", stamp(2))],
        [("z", 0, 0, "clock", stamp(10_000))],
        [("z", 1, 0, "clock", stamp(20_000))],
        [("z", 2, 0, "clock", stamp(30_000))],
    ]
    found, query = streamed(rocks, tmp_path, batches, schema, lambda s: sentences.fill_missing(s, "10 minutes", 3_600_000))
    assert sorted(tuple(r) for r in found if r.job != "z") == [("j", 1, 1, "one"), ("j", 2, 5, "filled"), ("k", 1, 9, "other")]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


