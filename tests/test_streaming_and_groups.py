"""Stream = batch for the latest answer (S02); item groups against a brute-force union-find (P05)."""

from __future__ import annotations

import itertools
import os
import random
from collections import Counter

from pyspark.sql import functions as F

from conftest import SF_SMALL
from fieldwork.operators import components
from fieldwork.operators import latest as L
from fieldwork.operators import sections as SEC
from fieldwork.operators.components import item_groups
from fieldwork.sources import tables as TB
from fieldwork.streaming.latest import _parts, _pointers, current_view, stream_latest, write_snapshot


def test_stream_latest_equals_batch_on_shuffled_arrival(spark, tmp_dir):
    log = TB.answers_fixture(spark, SF_SMALL)
    log_dir = os.path.join(tmp_dir, "log")
    log.orderBy(F.rand(3)).repartition(6).write.parquet(log_dir)
    out = os.path.join(tmp_dir, "updates")
    stream_latest(spark, log_dir, out, os.path.join(tmp_dir, "ck"), schema=log.schema)
    streamed = sorted(tuple(r) for r in current_view(spark, out).collect())
    batch = sorted(tuple(r) for r in L.latest_answers(log).select(
        "project", "interview", "analysis_step", "id", "answer_content").collect())
    assert streamed == batch and len(batch) > 0


def test_latest_view_reads_a_snapshot_and_the_batches_after_it(spark, tmp_dir):
    log = TB.answers_fixture(spark, SF_SMALL).withColumn("created", F.col("created").cast("timestamp_ntz"))
    log_dir, out = os.path.join(tmp_dir, "log2"), os.path.join(tmp_dir, "updates2")
    log.repartition(7).write.parquet(log_dir)
    stream_latest(spark, log_dir, out, os.path.join(tmp_dir, "ck2"), schema=log.schema, compact_every=3)
    assert sorted(f for f in os.listdir(f"{out}/snapshots") if "=" in f) == ["upto=2", "upto=5"]
    assert sorted(f for f in os.listdir(f"{out}/pointers") if "=" in f) == ["upto=2", "upto=5"]
    # the batches that the older snapshot covers are gone, those after it are kept for its readers
    assert sorted(f for f in os.listdir(f"{out}/updates") if "=" in f) == [f"batch_id={i}" for i in (3, 4, 5, 6)]
    read = {r["batch_id"] for r in _parts(spark, out).select("batch_id").distinct().collect()}
    assert read <= {5, 6} and 5 in read  # the snapshot and the one batch after it
    batch = sorted(tuple(r) for r in L.latest_answers(log).select(
        "project", "interview", "analysis_step", "id", "answer_content").collect())
    assert sorted(tuple(r) for r in current_view(spark, out).collect()) == batch


def test_an_unfinished_snapshot_is_not_read(spark, tmp_dir):
    log = TB.answers_fixture(spark, SF_SMALL).withColumn("created", F.col("created").cast("timestamp_ntz"))
    log_dir, out = os.path.join(tmp_dir, "log3"), os.path.join(tmp_dir, "updates3")
    log.repartition(5).write.parquet(log_dir)
    stream_latest(spark, log_dir, out, os.path.join(tmp_dir, "ck3"), schema=log.schema, compact_every=2)
    want = sorted(tuple(r) for r in current_view(spark, out).collect())
    held = current_view(spark, out)  # planned before the next snapshot
    # a writer stops after some rows of a newer snapshot, before its pointer
    some = spark.read.parquet(f"{out}/snapshots/upto=3").limit(2)
    some.write.parquet(f"{out}/snapshots/upto=4")
    assert sorted(tuple(r) for r in current_view(spark, out).collect()) == want and len(want) > 2
    write_snapshot(spark, out, 4)  # the retried batch writes it anew
    assert _pointers(spark, out) and max(_pointers(spark, out)) == 4
    assert sorted(tuple(r) for r in current_view(spark, out).collect()) == want
    assert sorted(tuple(r) for r in held.collect()) == want  # a reader of the older view is not disturbed


def _letter_runs(text):
    runs, cur = [], []
    for ch in text:
        if ch.isalpha():
            cur.append(ch)
        elif cur:
            runs.append("".join(cur))
            cur = []
    if cur:
        runs.append("".join(cur))
    return runs


def _brute_groups(items, share):
    """Union-find over all pairs of a project's items that reach the similarity, written from the definition."""
    by_project = {}
    for project, item in items:
        by_project.setdefault(project, set()).add(item)
    out = {}
    for project, nodes in by_project.items():
        words = {n: set(_letter_runs(n.lower())) for n in nodes}
        parent = {n: n for n in nodes}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for n, m in itertools.combinations(sorted(w for w in nodes if words[w]), 2):
            if len(words[n] & words[m]) * 100 >= round(share * 100) * len(words[n] | words[m]):
                a, b = find(n), find(m)
                parent[max(a, b)] = min(a, b)
        for n in nodes:
            out[(project, n)] = find(n)
    return out


def _check_groups(items, pairs):
    result = item_groups(items, "codes").collect()
    for share, column in ((0.5, "group_label"), (0.8, "subtopic_label")):
        assert {(r["project"], r["item"]): r[column] for r in result} == _brute_groups(pairs, share)
    sizes = Counter((r["project"], r["group_label"]) for r in result)
    assert all(r["group_size"] == sizes[(r["project"], r["group_label"])] for r in result)


def _item_rows(spark, items):
    return spark.createDataFrame([(p, 1, i, "codes") for p, i in items], "project long, interview long, item string, tag string")


def test_item_groups_lose_no_link_among_very_common_words(spark, monkeypatch):
    """A few words are in most items; sizes differ; ties in rarity; equal sets; every path of the join."""
    rnd = random.Random(3)
    common, rare = ["the", "a", "of", "and"], [chr(97 + i) + chr(97 + j) + "x" for i in range(20) for j in range(10)]
    items = set()
    for _ in range(260):
        words = rnd.sample(common, rnd.randrange(0, 4)) + rnd.sample(rare, rnd.randrange(0, 4))
        items.add((rnd.randrange(2), " ".join(words)))
    for base in (["k", "l", "m", "n", "o", "p"], ["k", "l", "q", "r", "s", "t"]):
        for _ in range(40):
            items.add((1, " ".join(rnd.sample(base, rnd.randrange(3, 7)))))
    items |= {(0, "of the"), (0, "The OF"), (0, "1 2"), (0, ""), (0, "--")}
    for limit, block in ((64, 1000), (3, 7)):
        monkeypatch.setattr(components, "LONG", limit)
        monkeypatch.setattr(components, "BLOCK", block)
        _check_groups(_item_rows(spark, items), items)


def test_items_that_all_share_words_emit_no_pairs(spark):
    """400 items, every two of them similar: the index would pair all; blocks return one link an item."""
    items = {(1, "common word " + "z" * i) for i in range(1, 401)}
    sets = components.word_sets(_item_rows(spark, items).select("project", "item"))
    assert components.similar_links(sets, 50, 80).count() <= 400
    result = item_groups(_item_rows(spark, items)).collect()
    assert {r["group_size"] for r in result} == {400} and len({r["subtopic_label"] for r in result}) == 400
    assert item_groups(_item_rows(spark, items).limit(0)).collect() == []


def test_item_groups_match_union_find(spark):
    latest = L.latest_answers(TB.answers_fixture(spark, SF_SMALL))
    items = SEC.section_items(SEC.interview_sections(latest)).where(F.col("tag") == "codes")
    pairs = [(r["project"], r["item"]) for r in items.select("project", "item").collect()]
    _check_groups(items, pairs)


def _brute_connections(rows, distance):
    seen = {}
    for a, b in itertools.combinations(rows, 2):
        if a[:3] == b[:3] and abs(a[3] - b[3]) <= distance and a[4] != b[4]:
            seen.setdefault((a[0], *sorted((a[4], b[4]))), set()).add(a[1])
    return sorted((*k, len(v)) for k, v in seen.items())


def test_item_connections_match_brute_force(spark):
    from fieldwork.operators.insights import item_connections_from_sections
    latest = L.latest_answers(TB.answers_fixture(spark, SF_SMALL))
    secs = SEC.interview_sections(latest)
    items = SEC.section_items(secs)
    rows = [(r["project"], r["interview"], r["ord"], r["item_no"], r["item"]) for r in items.where(F.col("tag") == "codes").collect()]
    for d in (1, 2):
        got = sorted(tuple(r) for r in item_connections_from_sections(secs, "codes", d).collect())
        assert got == _brute_connections(rows, d) and len(got) > 0
