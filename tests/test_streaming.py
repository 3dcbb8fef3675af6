import random

from edgewise.streaming.groups import RunningGroups
from test_components import union_find


def test_running_groups(spark, tmp_path):
    rng = random.Random(3)
    parts = [[(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(14)] + [("n01", None)] for _ in range(3)]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "`from` string, `to` string").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    running = RunningGroups(spark)
    stream = spark.readStream.schema("`from` string, `to` string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = stream.writeStream.foreachBatch(running.update).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    expected = union_find([p for rows in parts for p in rows if None not in p])
    assert {r["node"]: r["group_key"] for r in running.labels.collect()} == expected
    before = running.last_batch
    running.update(spark.createDataFrame([("n00", "zzz")], "`from` string, `to` string"), before)
    assert running.labels.filter("node = 'zzz'").isEmpty()


def test_a_new_object_goes_on(spark, tmp_path):
    schema = "`from` string, `to` string"
    first = RunningGroups(spark, path=str(tmp_path / "state"))
    first.update(spark.createDataFrame([("c", "d"), ("a", "b"), ("x", "y")], schema), 0)
    first.update(spark.createDataFrame([("b", "c")], schema), 1)
    again = RunningGroups(spark, path=str(tmp_path / "state"))
    assert again.last_batch == 1
    again.update(spark.createDataFrame([("lost", "row")], schema), 1)
    again.update(spark.createDataFrame([], schema), 2)
    again.update(spark.createDataFrame([("y", "0"), ("d", "e")], schema), 3)
    assert {r["node"]: r["group_key"] for r in again.labels.collect()} == dict.fromkeys("abcde", "a") | dict.fromkeys("xy0", "0")
