"""Histories kept by conversation while messages come."""

import random
import time

from pyspark.sql import functions as F

from lodestone.operators import session
from lodestone.streaming import conversation

SCHEMA = "conv_id long, turn long, role string, text string"


def _folders(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    return source, out, progress


def _rows(df):
    return sorted((r.conv_id, r.turn, r.role or "", r.content or "") for r in df.collect())


def _message(draw, conv, turn):
    text = draw.choice(["**[GRAPH]** ", "", " "]) + "w😀 é"[turn % 4] * draw.choice([0, 3, 390, 401, 900])
    return conv, turn, draw.choice(["user", "assistant", None]), None if turn % 11 == 7 else text


def test_stream_equals_history_in_any_order(spark, tmp_path):
    draw = random.Random(4)
    rows = [_message(draw, conv, turn) for conv in range(12) for turn in range(draw.randint(1, 15))]
    draw.shuffle(rows)
    source, out, progress = _folders(spark, tmp_path)
    came = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    for part in range(2):  # the query stops and goes on from its progress
        odd = [(None, 1, "user", "x"), (3, None, "user", "y")]
        spark.createDataFrame(rows[part::2] + odd, SCHEMA).repartition(2).write.mode("append").parquet(source)
        conversation.keep_versions(conversation.history_stream(came, interval=0), out, progress, once=True).awaitTermination()
    versions = spark.read.schema(conversation.VERSIONS).parquet(out)
    want = session.history(spark.createDataFrame(rows, SCHEMA))
    assert _rows(conversation.latest(versions)) == _rows(want)
    assert versions.groupBy("conv_id", "version", "turn").count().filter("count > 1").isEmpty()
    assert versions.agg(F.max("version")).first()[0] > 1


def test_a_turn_that_comes_again_replaces(spark, tmp_path):
    source, out, progress = _folders(spark, tmp_path)
    came = spark.readStream.schema(SCHEMA).parquet(source)
    for rows in ([(1, 1, "user", "a"), (1, 2, "user", "b" * 700)], [(1, 2, "user", "c"), (1, 1, "user", "z")], [(1, 3, "user", "d")]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        conversation.keep_versions(conversation.history_stream(came, interval=0), out, progress, once=True).awaitTermination()
    assert _rows(conversation.latest(spark.read.parquet(out))) == [(1, 1, "user", "z"), (1, 2, "user", "c"), (1, 3, "user", "d")]


def test_versions_wait_for_the_interval_and_the_last_is_shown(spark, tmp_path):
    source, out, progress = _folders(spark, tmp_path)
    spark.createDataFrame([], conversation.VERSIONS).write.parquet(out)
    came = spark.readStream.schema(SCHEMA).parquet(source)
    read = lambda: spark.read.schema(conversation.VERSIONS).parquet(out)

    def shown(turn):
        until = time.time() + 30
        while time.time() < until and read().filter(f"turn = {turn}").isEmpty():
            time.sleep(0.3)

    query = conversation.keep_versions(conversation.history_stream(came, interval=8.0), out, progress)
    try:
        for turn in range(3):
            spark.createDataFrame([(1, turn, "user", f"m{turn}")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
            if turn == 0:
                shown(0)
        shown(2)
    finally:
        query.stop()
    assert [r.content for r in conversation.latest(read()).orderBy("turn").collect()] == ["m0", "m1", "m2"]
    assert read().agg(F.max("version")).first()[0] == 2  # what came in between waited for the timer
