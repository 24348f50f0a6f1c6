"""The ingest stream: state across runs, ties within a batch, nulls."""

import datetime as dt
import shutil

from paperloom.streaming import ingest

SCHEMA = "id long, day date, title string"
START = dt.date(2024, 1, 1)


def land(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    ingest.ingest(spark, f"{folder}/in new", schema, f"{folder}/out", f"{folder}/state", id_col="id", day_col="day", start=START, days=7, files_per_batch=1)


def taken(spark, folder):
    return sorted((r["id"] or 0, r["title"], r["window_no"]) for r in spark.read.parquet(f"{folder}/out").collect())


def test_ingest_keeps_ids_in_its_state(spark, tmp_path):
    day = lambda n: START + dt.timedelta(days=n)
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    source = f"{tmp_path}/in new"
    land(spark, [(1, day(9), "late"), (1, day(1), "early"), (2, day(3), "two"), (2, day(3), "two"), (None, day(0), "none"), (None, day(1), "none again")], source)
    run(spark, tmp_path)
    first = [(0, "none", 0), (1, "early", 0), (2, "two", 0)]
    assert taken(spark, tmp_path) == first
    run(spark, tmp_path)
    assert taken(spark, tmp_path) == first
    # Rows collected before are not looked at: with them gone, their ids are still known.
    shutil.move(f"{tmp_path}/out", f"{tmp_path}/before")
    land(spark, [(1, day(0), "known"), (3, day(20), "three"), (None, day(0), "known")], source)
    land(spark, [(3, day(0), "known or three"), (2, None, "known")], source)
    run(spark, tmp_path)
    [row] = taken(spark, tmp_path)
    assert row in [(3, "three", 2), (3, "known or three", 0)]  # whichever file the stream read first
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider


def test_ingest_of_an_id_over_many_files_is_reproducible(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    rows = [(i % 7, START + dt.timedelta(days=i % 3), f"t{i}") for i in range(200)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/in")
    got = []
    for turn in range(2):
        ingest.ingest(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out{turn}", f"{tmp_path}/state{turn}", id_col="id", day_col="day", start=START, days=7)
        got.append(sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out{turn}").select("id", "day", "title").collect())))
    assert got[0] == got[1] and [r[0] for r in got[0]] == list(range(7)) and {r[1] for r in got[0]} == {START}


def test_ingest_reads_large_files_in_small_splits(spark, tmp_path, monkeypatch):
    """A file of many row groups is dealt to many tasks, and the session's own split size is left as it was."""
    name, seen = "spark.sql.files.maxPartitionBytes", []
    before = spark.conf.get(name)
    first_seen = ingest.first_seen
    monkeypatch.setattr(ingest, "SPLIT_BYTES", 2048)
    monkeypatch.setattr(ingest, "first_seen", lambda stream, **columns: seen.append(spark.conf.get(name)) or first_seen(stream, **columns))
    rows = [(i, START + dt.timedelta(days=i % 30), f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows + rows, SCHEMA)
    df.coalesce(1).write.option("parquet.block.size", 2048).parquet(f"{tmp_path}/in new")
    run(spark, tmp_path)
    assert seen == ["2048"] and spark.conf.get(name) == before
    assert taken(spark, tmp_path) == [(i, f"t{i}", i % 30 // 7) for i in range(3000)]
