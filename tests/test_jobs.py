"""The jobs on growing, odd and empty input, run again and after a stop."""

import json
import subprocess
import sys
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import activity_graph, document_graph
from jobs.common import settings

ROOT = Path(__file__).resolve().parents[1]
DOCS = "doc_id long, text string, source string, lang string, n_chars long, line string"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def files(folder):
    return {p: p.stat().st_mtime_ns for p in Path(folder).rglob("*") if p.is_file()}


# ---- documents


def write_documents(spark, folder, docs):
    spark.createDataFrame([(i, t, s, x, 0, "w") for i, t, s, x in docs], DOCS).write.mode("overwrite").parquet(f"{folder}/documents.parquet")


SHARED = [f"line number {i} has some words" for i in range(5)]


def test_documents_that_share_rare_lines(spark, tmp_path):
    common = "a licence that everybody has"
    docs = [(i, f"{common}\nown words of document {i} here", "s", "en") for i in range(20)]
    docs[3] = (3, f"{common}\n  {SHARED[0]} \n{SHARED[0]}", "s", "en")
    docs[7] = (7, f"{SHARED[0]}\n{SHARED[1]}", "s", "en")
    docs[9] = (9, SHARED[1], "t", None)
    docs += [(30, None, None, None), (31, "", "s", "de"), (9, SHARED[2], "a", "fr"), (40, SHARED[2], "s", "x"), (None, SHARED[0], "s", "x"), (41, "two words\ntwo words", "s", "x"), (42, "two words", "s", "x")]
    write_documents(spark, tmp_path, docs)
    wanted = settings(document_graph.__file__) | {"max_documents": 10}
    path = document_graph.run(spark, str(tmp_path), str(tmp_path / "out"), wanted)
    got = {r["doc_id"]: r for r in document_graph.read(spark, str(tmp_path / "out")).collect()}
    assert set(got) == {d[0] for d in docs} - {None}
    linked = {3, 7, 9, 40}
    for i, r in got.items():
        assert (r["cluster"], r["cluster_size"]) == ((3, 4) if i in linked else (i, 1))
        assert set(r["first"]) <= linked and len(r["first"]) <= 5 and (r["degree"] > 0) == (i in linked)
    assert got[7]["degree"] == 2 and got[7]["first"] == [3, 9] and got[9]["source"] == "a" and got[30]["source"] is None
    assert {r["fold"] for i, r in got.items() if i in linked} == {got[3]["fold"]} and all(0 <= r["fold"] < 10 for r in got.values())
    assert {p.name for p in Path(path).iterdir() if p.is_dir()} == {f"fold={r['fold']}" for r in got.values()}
    first = rows(document_graph.read(spark, str(tmp_path / "out")))
    document_graph.run(spark, str(tmp_path), str(tmp_path / "out"), wanted)
    assert rows(document_graph.read(spark, str(tmp_path / "out"))) == first


def test_folds_never_divide_a_cluster_and_hubs_are_cut(spark, tmp_path):
    docs = [(i, f"{SHARED[0]}\nplain text of number {i} only", "s", "en") for i in range(40)] + [(100 + i, f"text number {i} stands alone", "s", "en") for i in range(200)]
    write_documents(spark, tmp_path, docs)
    document_graph.run(spark, str(tmp_path), str(tmp_path / "out"), settings(document_graph.__file__))
    got = document_graph.read(spark, str(tmp_path / "out"))
    assert got.groupBy("cluster").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert got.select("fold").distinct().count() == 10
    hub = got.where("doc_id = 0").first()
    assert hub["degree"] == 39 and len(hub["first"]) == 5 and len(hub["second"]) == 3


def test_no_documents(spark, tmp_path):
    write_documents(spark, tmp_path, [])
    document_graph.run(spark, str(tmp_path), str(tmp_path / "out"), settings(document_graph.__file__))
    write_documents(spark, tmp_path, [(1, None, None, None)])
    document_graph.run(spark, str(tmp_path), str(tmp_path / "out"), settings(document_graph.__file__))
    assert [r["doc_id"] for r in document_graph.read(spark, str(tmp_path / "out")).collect()] == [1]
    with pytest.raises(ValueError):
        document_graph.run(spark, str(tmp_path), str(tmp_path / "out"), settings(document_graph.__file__) | {"fanouts": [3]})


# ---- events


def events(n, start, day):
    return [(start + i, datetime(2024, 1, day, 23, 59) + timedelta(seconds=30 * i), i % 3 if i % 7 else None, "ab"[i % 2] if i % 5 else None) for i in range(n)]


def add(spark, folder, made):
    spark.createDataFrame(made, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def counted(made):
    return sorted(map(repr, [(*k, n) for k, n in Counter((f"{t:%Y-%m-%d}", u, k) for _, t, u, k in made if t).items()]))


def test_only_new_events_are_taken(spark, tmp_path, monkeypatch):
    target, wanted, seen = str(tmp_path / "out"), settings(activity_graph.__file__), []
    first = events(40, 0, 5) + [(900, None, 1, "a")]
    add(spark, tmp_path, first)
    real = activity_graph.windowed_activity
    monkeypatch.setattr(activity_graph, "windowed_activity", lambda batch, width: seen.append(batch.count()) or real(batch, width))
    zone = spark.conf.get(activity_graph.ZONE)
    activity_graph.run(spark, str(tmp_path), target, wanted)
    assert rows(activity_graph.read(spark, target)) == counted(first) and seen == [40]
    assert spark.conf.get(activity_graph.ZONE) == zone
    before = files(target)
    activity_graph.run(spark, str(tmp_path), target, wanted)
    assert files(target).items() >= before.items() and seen == [40]  # nothing is written where nothing is new
    late = events(10, 100, 5) + events(10, 200, 20)  # one old day, one new one
    add(spark, tmp_path, late)
    activity_graph.run(spark, str(tmp_path), target, wanted)
    assert rows(activity_graph.read(spark, target)) == counted(first + late) and seen == [40, 20]
    assert {p.name for p in Path(target, "edges").iterdir() if p.is_dir()} == {f"day=2024-01-{d}" for d in ("05", "06", "20", "21")}


@pytest.mark.parametrize("stop", ["delta", "edges", "mark"])
def test_a_run_that_stopped_is_made_good(spark, tmp_path, monkeypatch, stop):
    target, wanted = str(tmp_path / "out"), settings(activity_graph.__file__)
    first, more = events(30, 0, 5), events(30, 50, 6)
    add(spark, tmp_path, first)
    activity_graph.run(spark, str(tmp_path), target, wanted)
    add(spark, tmp_path, more)
    with monkeypatch.context() as m:
        if stop == "delta":  # after a batch's delta is there, before the stream knows that it is done
            real = activity_graph.log.info
            m.setattr(activity_graph.log, "info", lambda text, *a: (_ for _ in ()).throw(RuntimeError("stop")) if text.startswith("batch") else real(text, *a))
        elif stop == "edges":  # before the days are written
            m.setattr(activity_graph, "refresh", lambda *a: (_ for _ in ()).throw(RuntimeError("stop")))
        else:  # after the days are written, before the mark is
            real_range = type(spark).range
            m.setattr(type(spark), "range", lambda self, *a, **k: (_ for _ in ()).throw(RuntimeError("stop")) if a == (1,) else real_range(self, *a, **k))
        with pytest.raises(Exception, match="stop"):
            activity_graph.run(spark, str(tmp_path), target, wanted)
    activity_graph.run(spark, str(tmp_path), target, wanted)
    assert rows(activity_graph.read(spark, target)) == counted(first + more)
    last = Path(target, "mark")
    assert spark.read.parquet(str(last)).collect()[0][0] == 1


def test_days_do_not_depend_on_the_session_zone(spark, tmp_path):
    made = events(20, 0, 9)
    add(spark, tmp_path, made)
    zone = spark.conf.get(activity_graph.ZONE)
    spark.conf.set(activity_graph.ZONE, "America/New_York")
    try:
        activity_graph.run(spark, str(tmp_path), str(tmp_path / "out"), settings(activity_graph.__file__))
        assert spark.conf.get(activity_graph.ZONE) == "America/New_York"
    finally:
        spark.conf.set(activity_graph.ZONE, zone)
    assert rows(activity_graph.read(spark, str(tmp_path / "out"))) == counted(made)


def test_no_events(spark, tmp_path):
    add(spark, tmp_path, [])
    activity_graph.run(spark, str(tmp_path), str(tmp_path / "out"), settings(activity_graph.__file__))
    assert activity_graph.read(spark, str(tmp_path / "out")).count() == 0


# ---- the command line


def test_settings(tmp_path):
    own = settings(activity_graph.__file__)
    (tmp_path / "c.json").write_text(json.dumps({"files_at_once": 1}))
    assert settings(activity_graph.__file__, str(tmp_path / "c.json")) == own | {"files_at_once": 1}
    (tmp_path / "d.json").write_text(json.dumps({"file_at_once": 1}))
    with pytest.raises(ValueError, match="file_at_once"):
        settings(activity_graph.__file__, str(tmp_path / "d.json"))


def test_command_line(spark, tmp_path):
    made = events(20, 0, 9)
    add(spark, tmp_path, made[:10])
    add(spark, tmp_path, made[10:])
    (tmp_path / "c.json").write_text(json.dumps({"files_at_once": 1}))
    done = subprocess.run([sys.executable, str(ROOT / "jobs/activity_graph.py"), "--input", str(tmp_path), "--output", str(tmp_path / "out"), "--config", str(tmp_path / "c.json")], cwd=tmp_path, capture_output=True, text=True, timeout=300, env=None)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "reading" in done.stderr and "wrote" in done.stderr and "batch 1" in done.stderr
    assert rows(activity_graph.read(spark, str(tmp_path / "out"))) == counted(made)
