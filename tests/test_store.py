"""Table maintenance is safe to repeat and touches only what it must."""
import os

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from recollect.operators import retrieval as RV
from recollect.plans.timeline import as_of
from recollect.sources import changes
from recollect.sources import store
from recollect.sources import views


def embed(rows, column):
    return RV.embed_text(rows, column)


def table(spark, tmp_path):
    path = str(tmp_path / "memory")
    store.append(store.stored(views.memory(spark, SMALL, text=True)), path)
    return path


def test_forget_touches_only_recent_partitions(spark, tmp_path):
    path = table(spark, tmp_path)
    day = "level=0/date=2024-01-03"
    before = {f: os.path.getmtime(f"{path}/{day}/{f}") for f in os.listdir(f"{path}/{day}")}
    now = as_of(spark, SMALL)
    n = store.forget_recent(spark, path, now, 60 * 24)
    assert n > 0 and store.read_memory(spark, path).count() == 1000 - n
    assert store.forget_recent(spark, path, now, 60 * 24) == 0
    assert before == {f: os.path.getmtime(f"{path}/{day}/{f}") for f in os.listdir(f"{path}/{day}")}


def test_compaction_can_be_repeated(spark, tmp_path):
    path, archive = table(spark, tmp_path), str(tmp_path / "archive")
    now = as_of(spark, SMALL)
    n = store.compact(spark, path, archive, now, "2024-02-01", embed)
    first = sorted(r["id"] for r in store.read_memory(spark, path).select("id").collect())
    # A second run finds nothing new; one that failed before its delete changes nothing either.
    assert store.compact(spark, path, archive, now, "2024-02-01", embed) == 0
    assert first == sorted(r["id"] for r in store.read_memory(spark, path).select("id").collect())
    assert store.archive_read(spark, archive).count() == n


def test_compaction_after_a_failed_run(spark, tmp_path):
    path, archive = table(spark, tmp_path), str(tmp_path / "archive")
    now = as_of(spark, SMALL)
    source = store.read_memory(spark, path).filter("level = 0 and date < '2024-01-02'")
    store.append(store.hour_records(source, embed), path)          # the failed run got this far
    store.archive_write(source, archive, "2024-02-01")
    n = store.compact(spark, path, archive, now, "2024-02-01", embed)
    t = store.read_memory(spark, path)
    assert t.select("id").distinct().count() == t.count()
    assert store.archive_read(spark, archive).count() == n


def members(spark, path):
    return store.read_memory(spark, path).filter("level = 1").agg(
        F.sum(F.get_json_object("data_json", "$.count").cast("long"))).first()[0]


def test_late_rows_reach_a_record(spark, tmp_path, monkeypatch):
    path, archive = table(spark, tmp_path), str(tmp_path / "archive")
    now = as_of(spark, SMALL)
    n = store.compact(spark, path, archive, now, "2024-02-01", embed)
    rows = spark.createDataFrame(store.archive_read(spark, archive).limit(9).collect()).select(
        F.concat(F.lit("late"), "id").alias("id"), "time_start", "time_end", F.lit(0).alias("level"),
        F.lit(False).alias("archived"), "data_json", F.array().cast("array<float>").alias("embedding"))
    store.append(rows, path)
    assert store.compact(spark, path, archive, now, "2024-02-01", embed) == 9
    # Rows that come between the archive and the delete stay for the next run.
    write = store.archive_write

    def slow(*args):
        write(*args)
        store.append(rows.withColumn("id", F.concat(F.lit("x"), "id")), path)

    store.append(rows.withColumn("id", F.concat(F.lit("y"), "id")), path)
    monkeypatch.setattr(store, "archive_write", slow)
    assert store.compact(spark, path, archive, now, "2024-02-01", embed) == 9
    monkeypatch.setattr(store, "archive_write", write)
    assert store.compact(spark, path, archive, now, "2024-02-01", embed) == 9
    assert members(spark, path) == store.archive_read(spark, archive).count() == n + 27


def test_notes_of_a_second_batch_follow(spark, tmp_path):
    notes = lambda *rows: spark.createDataFrame(
        rows, "title string, ts string, seq long, body string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    path = str(tmp_path / "notes")
    store.append_notes(notes(("a", "2024-01-01 10:00:00", 1, "x"), ("a", "2024-01-02 10:00:00", 2, "y")), path)
    store.append_notes(notes(("a", "2024-01-01 09:00:00", 3, "z"), ("b", "2024-01-01 09:00:00", 4, "w")), path)
    got = [(r["stem"], r["pos"], "# " in r["section"]) for r in store.read_notes(spark, path).orderBy("stem", "pos").collect()]
    assert got == [("a", 1, True), ("a", 2, False), ("a", 3, False), ("b", 1, True)]


def test_sealed_at_rest(spark, tmp_path):
    path, archive, key = str(tmp_path / "m"), str(tmp_path / "a"), "0123456789abcdef0123456789abcdef"
    rows = store.stored(views.memory(spark, SMALL, text=True)).filter("time_start < '2024-01-03'")
    store.append(rows, path, key)
    plain = lambda df: sorted((r["id"], r["data_json"]) for r in df.select("id", "data_json").collect())
    assert plain(store.read_memory(spark, path, key)) == plain(rows)
    assert store.read_memory(spark, path).filter(~F.col("data_json").startswith("enc1:")).isEmpty()
    n = store.compact(spark, path, archive, as_of(spark, SMALL), "2024-02-01", embed, key=key)
    assert n == rows.count() and plain(store.archive_read(spark, archive, key=key)) == plain(rows)
    assert store.read_memory(spark, path).filter(~F.col("data_json").startswith("enc1:")).isEmpty()
    assert store.read_memory(spark, path, key).agg(F.sum(F.get_json_object("data_json", "$.count").cast("long"))).first()[0] == n


def test_wipe_clears_the_archive(spark, tmp_path):
    path, archive = table(spark, tmp_path), str(tmp_path / "archive")
    store.archive_write(store.read_memory(spark, path), archive, "2024-02-01")
    assert store.wipe_all(spark, path, archive) == 1000
    assert store.read_memory(spark, path).count() == store.archive_read(spark, archive).count() == 0


def test_wipe_and_ids(spark, tmp_path):
    path = table(spark, tmp_path)
    ids = spark.createDataFrame([("1",), ("2",), ("nope",)], "id string")
    assert store.delete_by_ids(spark, path, ids) == 2
    assert store.wipe_all(spark, path) == 998
    assert store.read_memory(spark, path).count() == 0


def test_export_lines(spark):
    line = store.export_recent(views.memory(spark, SMALL, text=True), 3)
    assert line.count() == 3
    assert line.filter(F.get_json_object("line", "$.data.app_name").isNotNull()).count() == 3


# --- whatever is added meanwhile stays -----------------------------------------------

def late(spark, path, tag, n=5):
    """Rows that another writer adds: copies of stored rows under new ids."""
    rows = store.read_memory(spark, path).filter("level = 0").limit(n).drop("date")
    rows = rows.withColumn("id", F.concat(F.lit(tag), "id")).collect()
    store.append(spark.createDataFrame(rows, store.read_memory(spark, path).drop("date").schema), path)
    return {r["id"] for r in rows}


def ids(spark, path):
    rows = [r["id"] for r in store.read_memory(spark, path).select("id").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("where", ["stage", "finish", "_move"])
def test_rows_appended_during_a_delete_stay(spark, tmp_path, monkeypatch, where):
    path = table(spark, tmp_path)
    before, added, real = ids(spark, path), set(), getattr(changes, where)

    def busy(*args):
        if not added:
            added.update(late(spark, path, "x"))
        return real(*args)

    monkeypatch.setattr(changes, where, busy)
    doomed = spark.createDataFrame([("1",), ("2",), ("17",)], "id string")
    assert store.delete_by_ids(spark, path, doomed) == 3
    assert len(added) == 5 and ids(spark, path) == before - {"1", "2", "17"} | added


@pytest.mark.parametrize("where", ["archive_write", "hour_records", "delete_by_ids", "rewrite"])
def test_rows_appended_during_a_compaction_stay(spark, tmp_path, monkeypatch, where):
    path, archive = table(spark, tmp_path), str(tmp_path / "archive")
    now, added, real = as_of(spark, SMALL), set(), getattr(store, where)
    level0 = lambda: {r["id"] for r in store.read_memory(spark, path).filter("level = 0").select("id").collect()}
    open_rows = {r["id"] for r in store.read_memory(spark, path).filter(F.col("time_start") >= F.date_trunc("hour", F.lit(now))).collect()}

    def busy(*args, **named):
        if not added:
            added.update(late(spark, path, "x"))
        return real(*args, **named)

    monkeypatch.setattr(store, where, busy)
    n = store.compact(spark, path, archive, now, "2024-02-01", embed)
    monkeypatch.setattr(store, where, real)
    assert level0() == open_rows | added
    assert store.compact(spark, path, archive, now, "2024-02-01", embed) == len(added) == 5
    assert members(spark, path) == store.archive_read(spark, archive).count() == n + 5


@pytest.mark.parametrize("where", ["_move", "_mark"])
def test_a_delete_that_was_cut_short_is_ended(spark, tmp_path, monkeypatch, where):
    path = table(spark, tmp_path)
    before = ids(spark, path)

    def cut(*args):
        raise OSError("cut")

    if where == "_mark":  # the files have moved, the old ones are still there
        real = changes._move
        monkeypatch.setattr(changes, "_move", lambda *a: (real(*a), cut()))
    else:
        monkeypatch.setattr(changes, "_move", cut)
    doomed = spark.createDataFrame([("1",), ("2",)], "id string")
    with pytest.raises(OSError, match="cut"):
        store.delete_by_ids(spark, path, doomed)
    monkeypatch.undo()
    changes.recover(spark, path)
    assert ids(spark, path) == before - {"1", "2"}
    changes.recover(spark, path)
    assert store.delete_by_ids(spark, path, doomed) == 0 and ids(spark, path) == before - {"1", "2"}


def test_rows_that_cannot_be_judged_stay(spark, tmp_path):
    path = table(spark, tmp_path)
    odd = spark.createDataFrame([("n1", None, None, False, "{broken", None, 0), ("n2", None, None, False, None, None, 0)],
                                store.read_memory(spark, path).drop("date").schema)
    store.append(odd, path)
    store.forget_recent(spark, path, as_of(spark, SMALL), 60 * 24)
    store.delete_by_tag(spark, path)
    assert {"n1", "n2"} <= ids(spark, path)


def test_a_repeated_batch_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    rows = store.stored(views.memory(spark, SMALL, text=True))
    first, second = rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")
    save = store.sink(path, "screen")
    save(first, 0)
    save(first, 0)
    assert len(ids(spark, path)) == first.count()
    real = changes._move
    monkeypatch.setattr(changes, "_mark", lambda *a: (_ for _ in ()).throw(OSError("cut")))
    with pytest.raises(OSError):
        save(second, 1)  # its files are in place, but not noted
    monkeypatch.undo()
    assert real is changes._move
    store.sink(path, "screen")(second, 1)
    store.sink(path, "screen")(first, 0)
    store.sink(path, "other")(first.limit(0), 0)
    assert ids(spark, path) == {r["id"] for r in rows.select("id").collect()}


def test_weeks_roll_up_once(spark, tmp_path):
    path, archive = table(spark, tmp_path), str(tmp_path / "archive")
    now = as_of(spark, SMALL)
    assert store.compact_weeks(spark, path, archive, "2024-02-02", embed) == 0
    rows = store.compact(spark, path, archive, now, "2024-02-01", embed)
    hours = store.read_memory(spark, path).filter("level = 1").count()
    done = store.compact_weeks(spark, path, archive, "2024-02-02", embed)
    t = store.read_memory(spark, path)
    weeks = t.filter("level = 2").agg(F.count("*"), F.sum(F.get_json_object("data_json", "$.count").cast("long"))).first()
    assert 0 < done <= hours and weeks[0] > 0 and weeks[1] == done
    assert t.filter("level = 1").count() == hours - done
    assert store.archive_read(spark, archive).groupBy("level").count().orderBy("level").collect() == [(0, rows), (1, done)]
    assert store.compact_weeks(spark, path, archive, "2024-02-02", embed) == 0
    assert ids(spark, path)


def test_weeks_after_a_failed_run(spark, tmp_path):
    path, archive = table(spark, tmp_path), str(tmp_path / "archive")
    store.compact(spark, path, archive, as_of(spark, SMALL), "2024-02-01", embed)
    source = store.read_memory(spark, path).filter("level = 1")
    store.append(store.week_records(source, embed), path)          # the failed run got this far
    store.archive_write(source, archive, "2024-02-02")
    n = source.count()
    assert store.compact_weeks(spark, path, archive, "2024-02-03", embed) == n
    t = store.read_memory(spark, path)
    assert t.filter("level = 1").count() == 0 and ids(spark, path)
    assert t.filter("level = 2").agg(F.sum(F.get_json_object("data_json", "$.count").cast("long"))).first()[0] == n
    assert store.archive_read(spark, archive).filter("level = 1").count() == n


def few_rows(spark, ids):
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "id string, text string")
    at = F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")
    return store.stored(rows.select("id", at.alias("time_start"), at.alias("time_end"), F.lit(0).alias("level"),
                                    F.lit(False).alias("archived"), F.lit("x").alias("app_name"), F.lit("").alias("window_title"), "text"))


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def data_shuffled(rows):
    return any("Exchange" in l and "Broadcast" not in l for l in plan(rows).splitlines())


def test_marked_rows_stay_where_they_are_read(spark, tmp_path):
    """Places of a file beyond one bitmap, repeated and null ids, by both ways."""
    path = str(tmp_path / "memory")
    n = 70_000
    store.append(few_rows(spark, ["a", "b", "b", None]), path)
    store.append(few_rows(spark, range(n)).coalesce(1), path)
    ids = spark.createDataFrame([("b",), ("b",), ("0",), ("32767",), ("32768",), (str(n - 1),), ("none",), (None,)], "id string")
    table = store.read_memory(spark, path)
    marks = changes.marks_of(table, ids)
    inside, outside = changes.split(table, marks, True), changes.split(table, marks, False)
    assert not data_shuffled(inside) and not data_shuffled(outside)
    wanted = ["0", "32767", "32768", str(n - 1), "b", "b"]
    assert sorted(r["id"] for r in inside.collect()) == sorted(wanted) and outside.count() == n + 4 - 6
    few, changes.MARKS = changes.MARKS, 0
    try:
        assert sorted(r["id"] for r in changes.split(table, marks, True).collect()) == sorted(wanted)
    finally:
        changes.MARKS = few
    assert store.delete_by_ids(spark, path, ids) == 6
    left = store.read_memory(spark, path)
    assert left.count() == n - 2 and left.filter("id is null").count() == 1 and left.filter("id = 'a'").count() == 1
    assert store.delete_by_ids(spark, path, ids) == 0


def test_rows_are_not_dealt_out_before_they_are_written(spark, tmp_path):
    """An append and a rewrite leave one file a task; a shuffle by date would leave one in all."""
    path = str(tmp_path / "memory")
    store.append(few_rows(spark, range(40)).repartition(4), path)
    files = lambda: store.read_memory(spark, path).select(changes.file_of()).distinct().count()
    assert files() == 4
    store.delete_by_ids(spark, path, spark.createDataFrame([(str(i),) for i in range(0, 40, 2)], "id string"))
    assert files() > 1 and store.read_memory(spark, path).count() == 20
    assert all(f.endswith(".zstd.parquet") for _, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_archive_with_some_rows_new(spark, tmp_path):
    archive = str(tmp_path / "archive")
    for ids, total in ((["1", "2", None], 3), (["1", "2"], 3), (["2", "3"], 4), (["8", "9"], 6), ([None], 7)):
        store.archive_write(few_rows(spark, ids), archive, "2024-02-01")
        assert store.archive_read(spark, archive).count() == total


def test_rows_are_written_into_many_partitions_without_a_sort(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter
    seen, real = [], DataFrameWriter.parquet

    def parquet(self, *args, **kwargs):
        seen.append(int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")))
        return real(self, *args, **kwargs)
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    monkeypatch.setattr(changes, "WRITERS", 2)  # fewer than there are dates: the rest is sorted
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 5).cast("int")).cast("timestamp_ntz")
    rows = spark.range(0, 200, 1, 3).select(
        F.col("id").cast("string").alias("id"), day.alias("time_start"), day.alias("time_end"), F.lit(0).alias("level"),
        F.lit(False).alias("archived"), F.lit("a").alias("app_name"), F.lit("t").alias("window_title"), F.lit("x").alias("text"))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    store.append(store.stored(rows), str(tmp_path / "m"))
    store.archive_write(store.read_memory(spark, str(tmp_path / "m")), str(tmp_path / "a"), "2024-02-01")
    assert seen == [2, 2] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    for found in (store.read_memory(spark, str(tmp_path / "m")), store.archive_read(spark, str(tmp_path / "a"))):
        assert sorted(int(r["id"]) for r in found.collect()) == list(range(200))


def test_compaction_takes_on_a_portion_at_a_time(spark, tmp_path, monkeypatch):
    """Table, archive and records do not hold all rows at once; ids that come again on other days are rows of their own."""
    rows = spark.range(60).selectExpr(
        "cast(id % 40 as string) AS id", "timestamp_ntz'2024-01-01 00:30:00' + make_interval(0, 0, 0, 0, id * 5) AS time_start",
        "timestamp_ntz'2024-01-20 00:00:00' AS time_end", "0 AS level", "false AS archived",
        "concat('{\"app_name\":\"a\",\"text\":\"t', id, '\"}') AS data_json", "cast(array() AS array<float>) AS embedding")
    real, held, found = store.archive_write, [], []
    for portion in (1, 1 << 40):
        path, archive = str(tmp_path / f"m{portion}"), str(tmp_path / f"a{portion}")
        monkeypatch.setattr(store, "PORTION", portion, raising=False)
        monkeypatch.setattr(store, "PORTIONS", 3, raising=False)
        store.append(rows, path)

        def watched(*args):
            real(*args)
            held.append(store.read_memory(spark, path).filter("level = 0").count() + store.archive_read(spark, archive).count())

        monkeypatch.setattr(store, "archive_write", watched)
        assert store.compact(spark, path, archive, F.lit("2024-02-01").cast("timestamp_ntz"), "2024-02-01", embed) == 60
        if portion == 1:
            assert len(held) > 2 and max(held) < 100
        assert store.compact_weeks(spark, path, archive, "2024-02-02", embed, 1, 1) == 60
        found.append([sorted(tuple(map(str, r)) for r in t.select("id", "time_start", "level", "data_json").collect())
                      for t in (store.read_memory(spark, path), store.archive_read(spark, archive))])
    assert found[0] == found[1] and len(found[0][1]) == 120
