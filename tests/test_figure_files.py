"""The figure writer: one file a figure, whatever is retried."""

import os

import pyarrow as pa
import pytest

from paperloom.sources import figure_files as ff
from paperloom.sources.files import figure_stats

PNG, JPG, GIF = b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF89a"


def tree(path):
    path = str(path)
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if "/_" not in d and not f.startswith((".", "_")))


def test_figures_are_written_once(spark, tmp_path):
    path = f"{tmp_path}/figs"
    rows = [("a/1", "f1", PNG + b"x"), ("a/1", "f1", PNG + b"x"), ("a/1", "f2", JPG + b"1"), ("a/1", "f2", GIF + b"22"), ("..", ".", GIF), ("b", "", b"?"),
            (None, "f", PNG), ("c", None, PNG), ("c", "f", None), ("d", "f", b""), (".e", "f", PNG)]
    df = spark.createDataFrame(rows, "paper_id string, figure_id string, content binary")
    ff.write_figures(df.repartition(3), path)
    first = tree(path)
    assert len(first) == 5 and {"a_1/f1.png", "p_../p_..gif", "b/p_.png", "p_.e/f.png"} < set(first)
    assert sorted(r["p"] for r in df.where("length(content) > 0").dropna().select(ff.image_path(df["paper_id"], df["figure_id"], df["content"]).alias("p")).distinct().collect()) == sorted({*first, "a_1/f2.gif", "a_1/f2.jpg"})
    # A later run replaces what it names, also where the format has changed.
    ff.write_figures(spark.createDataFrame([("a/1", "f1", GIF + b"new")], df.schema), f"file://{path}")
    assert tree(path) == sorted({*first, "a_1/f1.gif"} - {"a_1/f1.png"})
    got = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in ff.read_figures(spark, path).collect()}
    assert {r["path"] for r in ff.list_figures(spark, path).collect()} == {f"{path}/{p}" for p in tree(path)}
    assert got["f1.gif"] == GIF + b"new" and not any(n.startswith(ff.STAGING) for n in os.listdir(path))
    stats = {r["ext"]: r["files"] for r in figure_stats(ff.list_figures(spark, path)).collect()}
    assert sum(stats.values()) == 5 and stats[".png"] == 2


def test_empty_table_writes_no_figure(spark, tmp_path):
    ff.write_figures(spark.createDataFrame([], "paper_id string, figure_id string, content binary"), f"{tmp_path}/figs")
    assert tree(f"{tmp_path}/figs") == [] and ff.read_figures(spark, f"{tmp_path}/figs").count() == 0


def batches(*rows, fail=False):
    yield pa.RecordBatch.from_pylist([dict(zip(("folder", "figure", "ext", "content"), r)) for r in rows])
    if fail:
        raise OSError("lost")


def test_retried_tasks_leave_one_file(tmp_path):
    writer = ff.FigureWriter(str(tmp_path), "1")
    rows = [("a", "1", ".png", b"one"), ("a", "2", ".png", b"two")]
    with pytest.raises(OSError):
        writer.write(batches(rows[0], fail=True))
    messages = [writer.write(batches(*rows)), writer.write(batches(*rows))]  # doubled by speculation, one message counts
    os.makedirs(tmp_path / f"{ff.STAGING}-1" / "killed")
    writer.commit([messages[0], None])
    assert tree(tmp_path)[-2:] == ["a/1.png", "a/2.png"] and len(os.listdir(tmp_path / ff.INDEX)) == 1 and not any(n.startswith(ff.STAGING) for n in os.listdir(tmp_path))
    assert (tmp_path / "_SUCCESS").read_text() == '{"figures": 2, "bytes": 6}\n'
