"""Folders of a manifest are listed once, by few tasks."""

from lodestone.sources import ingest


def test_many_folders_are_listed_once_by_few_tasks(spark, tmp_path):
    rows = []
    for k in range(40):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "a.txt").write_text(f"text {k}")
        rows.append((k, f"{tmp_path}/d{k}/a.txt", "text"))
    context, before = spark.sparkContext, spark.conf.get(ingest.LISTERS)
    manifest = spark.createDataFrame(rows, "pos long, path string, format string")
    context.setJobGroup("listing", "listing")
    good, bad = ingest.ingest(spark, manifest, "c")
    context.setJobGroup("other", "other")
    tracker = context.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    most = 4 * context.defaultParallelism
    assert max(tasks) <= most and tasks.count(most) == 1, tasks
    assert spark.conf.get(ingest.LISTERS) == before
    assert {(r.doc_pos, r.content) for r in good.collect()} == {(k, f"text {k}") for k in range(40)} and bad.isEmpty()


def test_missing_folders(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x[1].txt").write_text("b")
    rows = [(k, f"{tmp_path}/{d}/x[1].txt", "text") for k, d in enumerate("abc")]
    good, bad = ingest.ingest(spark, spark.createDataFrame(rows, "pos long, path string, format string"), "c")
    assert [r.content for r in good.collect()] == ["b"] and {(r.pos, r.error_type) for r in bad.collect()} == {(0, "FileNotFound"), (2, "FileNotFound")}
    gone, bad = ingest.ingest(spark, spark.createDataFrame(rows[:1], "pos long, path string, format string"), "c")
    assert gone.isEmpty() and bad.count() == 1
