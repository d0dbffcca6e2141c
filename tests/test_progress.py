"""Progress files of running jobs and streams."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from inkstone.progress import StreamWatch, Tasks, Watch, replace
from inkstone.streaming import learn


def slow(spark, tasks, seconds):
    def run(batches):
        for batch in batches:
            time.sleep(seconds)
            yield batch

    return spark.range(tasks * 10, numPartitions=tasks).mapInArrow(run, "id long")


def read(path):
    return json.loads(path.read_text())


def test_watch_of_jobs(spark, tmp_path):
    path, seen = tmp_path / "progress.log", []
    stop = threading.Event()

    def look():
        while not stop.wait(0.05):
            if path.exists():
                seen.append(read(path))  # never half a file

    reader = threading.Thread(target=look)
    reader.start()
    with Watch(spark, str(path), combo="a + b", seconds=0.1):
        assert slow(spark, 16, 0.3).groupBy((F.col("id") % 3).alias("k")).count().count() == 3
        assert slow(spark, 4, 0.1).count() == 40
    stop.set()
    reader.join()
    last = read(path)
    assert last["status"] == "complete" and last["completed"] == last["total"] >= 20 and last["percent"] == 100
    assert seen[0]["status"] == "running" and any(0 < s["completed"] < s["total"] for s in seen)
    done = [s["completed"] for s in seen]
    assert done == sorted(done) and {s["current_combo"] for s in seen} == {"a + b"}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["progress.log"]


def test_watch_counts_its_own_jobs_only(spark, tmp_path):
    path = tmp_path / "p"
    spark.sparkContext.setJobGroup("outer", "before")
    with Watch(spark, str(path), seconds=5):
        pass
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == "outer"
    spark.range(100, numPartitions=7).count()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert read(path) == {"completed": 0, "total": 0, "percent": 0, "eta_minutes": 0, "current_combo": "", "status": "complete"}


def test_failure_is_told_and_goes_on(spark, tmp_path):
    path = tmp_path / "p"
    with pytest.raises(ZeroDivisionError), Watch(spark, str(path), seconds=5):
        spark.range(10, numPartitions=2).count()
        raise ZeroDivisionError
    assert read(path)["status"] == "failed" and read(path)["completed"] > 0


def test_unwritable_file_stops_nothing(spark, tmp_path):
    with Watch(spark, str(tmp_path / "none" / "p"), seconds=0.05):
        assert slow(spark, 2, 0.2).count() == 20


def test_skipped_and_forgotten_stages():
    class Info:
        def __init__(self, **more):
            self.__dict__.update(more)

    class Tracker:
        status = "RUNNING"
        stages = {1: Info(numTasks=8, numCompletedTasks=8), 2: Info(numTasks=4, numCompletedTasks=1), 3: Info(numTasks=5, numCompletedTasks=0)}

        def getJobIdsForGroup(self, group):
            return [7]

        def getJobInfo(self, job):
            return Info(status=self.status, stageIds=[1, 2, 3])

        def getStageInfo(self, stage):
            return self.stages.get(stage)

    tracker = Tracker()
    tasks = Tasks(tracker, "g")
    assert tasks.count() == (9, 17)
    tracker.status, tracker.stages = "SUCCEEDED", {2: Info(numTasks=4, numCompletedTasks=4), 3: Info(numTasks=5, numCompletedTasks=0)}
    assert tasks.count() == (12, 12)  # stage 1 is forgotten, stage 3 was skipped
    tracker.stages = {}
    assert tasks.count() == (12, 12)


def test_watch_of_a_stream(spark, tmp_path):
    inbox, path = tmp_path / "in", tmp_path / "p"
    spark.createDataFrame([("a", f"one text number {i}") for i in range(30)], "author string, text string").repartition(3).write.json(str(inbox))
    listener = StreamWatch(str(path))
    spark.streams.addListener(listener)
    try:
        learn.learn(spark, str(inbox), str(tmp_path / "store"), files_a_batch=1).awaitTermination()
        until = time.time() + 20
        while time.time() < until and (not path.exists() or read(path)["status"] == "running"):
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert read(path) == {"completed": 30, "total": 30, "percent": 100, "eta_minutes": 0, "current_combo": "batch 2", "status": "complete"}


def test_replace(tmp_path):
    replace(str(tmp_path / "f"), "one")
    replace(f"file://{tmp_path}/f", "two")
    assert (tmp_path / "f").read_text() == "two"
