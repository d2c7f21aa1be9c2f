"""Published versions and the outbox: what fails leaves the old state, what runs again changes nothing."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.sources import published


def _read(spark, at, schema="id long"):
    return sorted(r.id for r in published.published(spark, at, schema).collect())


@pytest.mark.parametrize("uri", [False, True])
def test_round_trip_and_rotation(spark, tmp_path, uri):
    at = (tmp_path / "t").as_uri() if uri else str(tmp_path / "t")
    assert _read(spark, at) == [] and published.versions(at) == []
    for n in (3, 5, 0, 7):
        published.publish(spark.range(n).repartition(3), at, keep=2)
    assert _read(spark, at) == list(range(7))
    assert [(v["version"], v["rows"]) for v in published.versions(at)] == [(3, 0), (4, 7)]
    assert published.published(spark, at, "id long", 3).count() == 0
    with pytest.raises(ValueError):
        published.published(spark, at, "id long", 1)
    assert len(list((tmp_path / "t" / "_versions").iterdir())) == 2


def test_a_failing_task_leaves_the_old_version(spark, tmp_path):
    at = str(tmp_path / "t")
    published.publish(spark.range(10), at)
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        published.publish(bad, at)
    assert _read(spark, at) == list(range(10)) and len(published.versions(at)) == 1
    published.publish(spark.range(4), at)
    assert _read(spark, at) == list(range(4)) and [v["version"] for v in published.versions(at)] == [1, 2]


def _writer(at, **options):
    return published.VersionWriter(pa.schema([("id", pa.int64())]), {"path": at, **options}, True)


def _batch(*ids):
    return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64())})


def test_a_lost_driver_and_repeated_attempts(spark, tmp_path):
    at = str(tmp_path / "t")
    published.publish(spark.range(3), at)
    lost = _writer(at)
    lost.write(iter([_batch(8)]))  # the driver is gone before it can commit
    assert _read(spark, at) == [0, 1, 2]
    again = _writer(at)
    again.write(iter([_batch(1), _batch(2)]))  # an attempt whose message never came
    parts = [again.write(iter([_batch(1), _batch(2)])), again.write(iter([])), None]
    again.commit(parts)
    assert _read(spark, at) == [1, 2] and [v["version"] for v in published.versions(at)] == [1, 2]


def test_a_driver_lost_before_its_version_is_current(spark, tmp_path):
    at = str(tmp_path / "t")
    published.publish(spark.range(3), at)
    lost = _writer(at)
    part = lost.write(iter([_batch(8)]))
    store = published.Store(at)
    store.replace(f"{lost.folder}/_version.json", {"version": 2, "folder": lost.folder, "at": 0.0, "files": [part.name], "rows": 1})
    assert _read(spark, at) == [0, 1, 2] and [v["version"] for v in published.versions(at)] == [1]
    published.publish(spark.range(5), at)
    assert _read(spark, at) == list(range(5)) and [(v["version"], v["rows"]) for v in published.versions(at)] == [(1, 3), (2, 5)]


def test_old_versions_go_by_age(tmp_path, spark):
    at = str(tmp_path / "t")
    for n in (1, 2, 3):
        published.publish(spark.range(n), at, keep=9)
    for name in (tmp_path / "t" / "_versions").iterdir():
        mark = json.loads((name / "_version.json").read_text())
        if mark["version"] < 3:
            (name / "_version.json").write_text(json.dumps(mark | {"at": mark["at"] - 86_400 * 3}))
    published.publish(spark.range(4), at, keep=9, max_age_days=2)
    assert [v["version"] for v in published.versions(at)] == [3, 4]


def test_appending_is_refused(spark, tmp_path):
    spark.dataSource.register(published.PublishedSource)
    with pytest.raises(Exception, match="overwrite"):
        spark.range(1).write.format("quarry_published").option("path", str(tmp_path / "t")).mode("append").save()


def test_replayed_batches_push_once(spark, tmp_path):
    at = str(tmp_path / "out")
    push = published.OutboxWriter(pa.schema([("id", pa.int64())]), {"path": at})
    push.commit([push.write(iter([_batch(1, 2)])), push.write(iter([]))], 0)
    push.commit([push.write(iter([_batch(1, 2)]))], 0)  # replayed: the same events again
    failed = push.write(iter([_batch(3)]))
    push.abort([failed, None], 1)
    push.commit([push.write(iter([_batch(3)]))], 1)
    assert sorted(r.id for r in published.pushed(spark, at, "id long").collect()) == [1, 2, 3]
    assert len(list((tmp_path / "out" / "events").iterdir())) == 2


def test_a_stream_restarted_without_its_last_note(spark, tmp_path):
    spark.dataSource.register(published.OutboxSource)

    def run():
        stream = spark.readStream.schema("id long").json(str(tmp_path / "in"))
        query = stream.writeStream.format("quarry_outbox").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    spark.range(5).coalesce(1).write.json(str(tmp_path / "in"))
    run()
    for note in (tmp_path / "cp" / "commits").glob("*0*"):
        note.unlink()  # the batch was pushed, but the stream was lost before it could note that
    run()
    spark.range(5, 8).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    run()
    assert sorted(r.id for r in published.pushed(spark, str(tmp_path / "out"), "id long").collect()) == list(range(8))
