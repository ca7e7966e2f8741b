"""File ingest (R01), streaming ingest (S01), validated append (R04), registry (R05), sink (R06)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from fieldwork.operators import store as ST
from fieldwork.sources import files as FL
from fieldwork.sources import sinks as SK
from fieldwork.streaming.ingest import read_ingested, stream_ingest


def _write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def _raw(tmp_dir):
    root = os.path.join(tmp_dir, "raw")
    _write(f"{root}/proj/a.txt", b"a\r\nb")
    _write(f"{root}/proj/empty.txt", b"")
    _write(f"{root}/proj/spaces.txt", b"  \n\t ")
    _write(f"{root}/proj/bad.txt", b"\xff\xfe")
    _write(f"{root}/proj/x.TXT", b"ignored")
    _write(f"{root}/proj/c.txt", "  текст\rвторая  ".encode())
    _write(f"{root}/other/d.txt", b"d")
    return root


def test_ingest_rules(spark, tmp_dir):
    root = _raw(tmp_dir)
    good, bad = FL.ingest_text(spark, root)
    got = sorted((r["project_name"], os.path.basename(r["path"]), r["content"]) for r in good.collect())
    assert got == [("other", "d.txt", "d"), ("proj", "a.txt", "a\nb"), ("proj", "c.txt", "текст\nвторая")]
    reasons = sorted((os.path.basename(r["payload"]), r["reason"]) for r in bad.collect())
    assert ("bad.txt", "invalid utf-8") in reasons and ("spaces.txt", "empty content") in reasons
    assert all(name != "x.TXT" for name, _ in reasons)


def test_stream_ingest_each_file_once(spark, tmp_dir):
    root = os.path.join(tmp_dir, "raw")
    _write(f"{root}/project=p1/f1.txt", b"one")
    _write(f"{root}/project=p1/f2.txt", b"two")
    table, ckpt = os.path.join(tmp_dir, "t"), os.path.join(tmp_dir, "ck")
    stream_ingest(spark, root, table, ckpt)
    assert read_ingested(spark, table).count() == 2
    stream_ingest(spark, root, table, ckpt)  # rerun: nothing new
    assert read_ingested(spark, table).count() == 2
    _write(f"{root}/project=p2/f3.txt", b"three")
    stream_ingest(spark, root, table, ckpt)
    got = sorted((r["project_name"], r["content"]) for r in read_ingested(spark, table).collect())
    assert got == [("p1", "one"), ("p1", "two"), ("p2", "three")]


def test_stream_ingest_in_bounded_batches(spark, tmp_dir, monkeypatch):
    import fieldwork.streaming.ingest as SI
    from fieldwork.session import ensure_checkpoint_dir, local_path
    monkeypatch.setattr(SI, "FILES_PER_BATCH", 2, raising=False)
    root = os.path.join(tmp_dir, "raw")
    for i in range(7):
        _write(f"{root}/project=p{i % 2}/f{i}.txt", b" \n" if i == 3 else f"text {i}".encode())
    table, ckpt = os.path.join(tmp_dir, "t"), os.path.join(tmp_dir, "ck")
    scratch = f"{local_path(ensure_checkpoint_dir(spark))}/fieldwork-scratch"
    before = set(os.listdir(scratch)) if os.path.exists(scratch) else set()
    stream_ingest(spark, root, table, ckpt)
    rows = read_ingested(spark, table).collect()
    assert sorted(r["content"] for r in rows) == [f"text {i}" for i in range(7) if i != 3]
    assert sorted(r["interview_id"] for r in rows) == [*range(1, 7)]
    assert spark.read.parquet(f"{table}/rejects").count() == 1
    assert max(sum(r["batch_id"] == b for r in rows) for b in range(4)) <= 2 and {r["batch_id"] for r in rows} <= set(range(4))
    tops = [max((r["interview_id"] for r in rows if r["batch_id"] <= b), default=0) for b in range(4)]
    assert all(r["interview_id"] > tops[r["batch_id"] - 1] for r in rows if r["batch_id"])  # ids follow those of the batches before
    assert not [f for f in set(os.listdir(scratch)) - before if f.startswith("ingest-staged")]
    stream_ingest(spark, root, table, ckpt)  # nothing new
    assert read_ingested(spark, table).count() == 6


def test_validate_rows_split(spark):
    rows = spark.createDataFrame(
        [(1, "ok", "m", " prompt "), (1, "interview", None, "p"), (1, "interview", "m", "   ")],
        "project long, analysis_type string, model string, prompt string").withColumn(
        "input_tokens", F.lit(1)).withColumn("output_tokens", F.lit(1))
    valid, rejects = ST.validate_rows(rows, "llm_answers")
    v = valid.collect()
    assert len(v) == 1 and v[0]["prompt"] == "prompt" and v[0]["answer_content"] == "" and v[0]["created"]
    assert sorted(r["reason"] for r in rejects.collect()) == ["model required", "prompt required"]


def test_register_projects(spark):
    existing = spark.createDataFrame([(1, "a"), (2, "b"), (5, "a")], "project_id long, project_name string")
    names = spark.createDataFrame([("c",), ("a",), ("d",), ("c",)], "project_name string")
    got = sorted(tuple(r) for r in ST.register_projects(existing, names).collect())
    assert got == [(1, "a"), (2, "b"), (6, "c"), (7, "d")]
    assert ST.resolve_project(ST.register_projects(existing, names), "a").first()["project_id"] == 1


def test_report_sink_round_trip(spark, tmp_dir):
    blocks = spark.createDataFrame(
        [("p", "interviews", i, f"\nblock {i}") for i in range(1, 30)] + [("p", "summary", 1, "S")],
        "project_name string, report_type string, block_no long, text string")
    path = SK.write_reports(blocks, os.path.join(tmp_dir, "reports"), num_partitions=4)
    folder = os.path.join(path, "project_name=p", "report_type=interviews")
    parts = sorted(f for f in os.listdir(folder) if f.endswith(".txt"))
    text = "".join(open(os.path.join(folder, f), encoding="utf-8").read() for f in parts)
    assert text == "".join(f"\nblock {i}\n" for i in range(1, 30))
    assert len(parts) > 1  # one project written by several tasks


def test_documents_become_one_file_each(spark, tmp_dir):
    rows = [("a+b", "x"), ("50%/[1]=\"q\"", "y\ny"), ("дом", "z"), ("дом", "z"), (None, "w"), ("", None), ("n", "")]
    docs = spark.createDataFrame(rows, "project_name string, text string").repartition(3)
    root = os.path.join(tmp_dir, "files")
    _write(f"{root}/project=old/old.txt", b"replaced")
    FL.write_documents_as_files(docs, root)
    docs.selectExpr("project_name as project", "text").write.option("maxRecordsPerFile", 1).partitionBy("project").text(f"{root}-by-spark")

    def found(at, suffix):
        return sorted((os.path.basename(d), open(os.path.join(d, f), "rb").read()) for d, _, names in os.walk(at) for f in names if f.endswith(suffix))

    assert found(root, ".txt") == found(f"{root}-by-spark", ".txt") and len(found(root, ".txt")) == len(rows)
    assert all(f.endswith(".txt") for d, _, names in os.walk(root) for f in names if "project=" in d)  # no second file a document
    good, bad = FL.ingest_text(spark, root, layout="hive")
    hive = "__HIVE_DEFAULT_PARTITION__"
    assert sorted(tuple(r) for r in good.select("project_name", "content").collect()) == sorted((p or hive, t) for p, t in rows if t)
    assert bad.count() == 2


def test_small_files_share_tasks(spark, tmp_dir):
    for i in range(100):
        _write(f"{tmp_dir}/raw/p/{i:03d}.txt", f"text {i}".encode())
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a scan partition for every file
    try:
        good, _ = FL.ingest_text(spark, f"{tmp_dir}/raw")
        rows = sorted(good.select("interview_id", "content").collect())
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert [tuple(r) for r in rows] == [(i + 1, f"text {i}") for i in range(100)]
    assert len(good.inputFiles()) <= 4 * spark.sparkContext.defaultParallelism  # what the staging tasks wrote
