"""Slot arithmetic of token shards beyond what the test tables reach."""

import pytest
from pyspark.sql import functions as F

from lodestrand.llm import token_shards


@pytest.mark.parametrize("shards", [1, 3, 200, (1 << 21) + 5, 1 << 22, 5_000_000, 1 << 23, 9_000_000, 1 << 25])
def test_shards_and_places_of_many_shards(spark, shards):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("number"), F.lit(0).alias("part"))
    got = token_shards.in_training_order(rows, shards)
    bits = token_shards.place_bits(shards)
    low, high, least, most, distinct = got.agg(F.min("shard"), F.max("shard"), F.min("place"), F.max("place"), F.countDistinct("place")).first()
    assert 0 <= low <= high < shards and 0 <= least <= most < shards << bits and distinct == 20_000
    assert got.where(F.shiftright("place", bits) != F.col("shard")).count() == 0
    # Even over the shards: no half holds much more than half.
    assert shards < 2 or abs(got.where(F.col("shard") < shards // 2).count() - 20_000 * (shards // 2) / shards) < 500


def test_too_many_shards_are_refused():
    with pytest.raises(ValueError):
        token_shards.place_bits(1 << 40)


def test_tasks_are_few_however_many_shards():
    size = 4096 * token_shards.record_type().itemsize
    tasks = {shards: -(-shards // token_shards.shards_a_task(shards)) for shards in (1, 150, 400, 270_000, 27_000_000)}
    assert tasks[1] == 1 and tasks[150] == 150 and tasks[400] == 200
    # 1 TB and 100 TB of input, about: each task writes a quarter of a gigabyte.
    assert 4000 < tasks[270_000] < 4500 and 400_000 < tasks[27_000_000] < 450_000 and token_shards.shards_a_task(27_000_000) * size <= token_shards.TASK_BYTES


def test_several_shards_a_task_make_the_same_files(spark, tmp_path):
    rows = spark.range(500).select(F.xxhash64("id").alias("number"), F.lit(0).alias("part"), F.col("id").alias("doc_id"), F.lit(2).alias("n_tokens"), F.unhex(F.lit("0100c4c4")).alias("ids"))
    order = token_shards.in_training_order(rows, 8)
    read = []
    for per_task in (1, 3, 8):
        path = str(tmp_path / str(per_task))
        token_shards.written_shards(order, path, 8, length=8, per_task=per_task)
        read.append([tuple(r) for r in token_shards.records(spark, path, 8).orderBy("slot").collect()])
    assert read[0] == read[1] == read[2] and len(read[0]) == 500
