"""Streams hold the same results as the tables they have read."""

from __future__ import annotations

import datetime

import pytest

from wordloom.operators import versions
from wordloom.streaming import streams

SCHEMA = "set_id string, doc_id long, snapshot int, match_hash string, ordinal int, text string"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    streams.with_state_store(spark)
    yield spark
    spark.conf.set(key, before)


def test_link_groups_equal_those_of_the_last_snapshots_after_every_batch(rocks, tmp_path):
    spark = rocks
    snapshot = lambda s, doc, number, hashes: [(s, doc, number, h, i, f"{h} in {doc}.{number}") for i, h in enumerate(hashes)] or [(s, doc, number, None, None, None)]
    batches = [
        [("a", 1, 1, "xyx"), ("a", 2, 1, "xy"), ("b", 3, 1, "x"), (None, 4, 1, "z"), (None, 5, 1, "zz")],
        [("a", 1, 2, "xyx"), ("a", 2, 2, "w")],  # one comes again, one is changed
        [("a", 6, 1, "xw"), ("b", 7, 1, "x")],
        [("a", 1, 3, ""), (None, 4, 2, "z")],  # one is removed
        [("a", 1, 2, "xyx"), ("a", 2, 2, "xxxx")],  # late and repeated numbers
        [("a", 1, 4, "w"), ("a", 2, 3, "xw"), (None, 5, 2, "")],
    ]
    last: dict = {}
    for n, batch in enumerate(batches):
        rows = [r for b in batch for r in snapshot(*b)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streams.stream_document_changes(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/changes", f"{tmp_path}/c1").awaitTermination()
        streams.stream_link_groups(spark.readStream.schema(streams.CHANGE).parquet(f"{tmp_path}/changes"), f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
        for s, doc, number, hashes in batch:
            if number > last.get(doc, (0,))[0]:
                last[doc] = (number, s, hashes)
        want = {}
        for doc, (number, s, hashes) in sorted(last.items()):
            for i, h in enumerate(hashes):
                g = want.setdefault((s, h), [0, set(), f"{h} in {doc}.{number}"])
                g[0] += 1
                g[1].add(doc)
        got = {(r["set_id"], r["match_hash"]): (r["members"], r["documents"]) for r in streams.streamed_link_groups(spark.read.parquet(f"{tmp_path}/out")).collect()}
        assert got == {k: (m, len(docs)) for k, (m, docs, _) in want.items() if len(docs) > 1}, n


def test_a_batch_says_only_what_it_touches(rocks, tmp_path):
    spark = rocks
    for number in (1, 2):
        rows = [("a", doc, number, h, i, h) for doc in (1, 2, 3) for i, h in enumerate("pqrs" if doc > 1 or number < 2 else "pqr")]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streams.stream_document_changes(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/changes", f"{tmp_path}/c1").awaitTermination()
    said = spark.read.parquet(f"{tmp_path}/changes")
    assert said.count() == 13 and [tuple(r) for r in said.where("n = 0").select("doc_id", "match_hash").collect()] == [(1, "s")]


def test_job_status_ends_and_outlives_a_restart(rocks, tmp_path):
    spark = rocks
    schema = "event_id long, ts timestamp, job_id long, status string"
    at = lambda minute: datetime.datetime(2024, 5, 1) + datetime.timedelta(minutes=minute)
    batches = [
        [(1, at(0), 1, "running"), (2, at(3), 1, "completed"), (2, at(3), 1, "completed"), (3, at(1), 2, "running"), (4, None, 2, "lost")],
        [(3, at(1), 2, "running"), (5, at(2), 2, "queued"), (6, at(20), 3, "running")],  # one is repeated; the newest is at 20
        [(7, at(1), 3, "late"), (8, at(21), 2, "completed"), (9, at(200), 4, "running")],  # the first is more than 10 behind 20: late
        [(10, at(201), 5, "running")],
        [(11, at(202), 2, "running"), (12, at(203), 4, "failed")],
    ]
    got, held = [], []
    for n, batch in enumerate(batches):  # every batch is a query of its own that starts from the checkpoint
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = []
        status = streams.stream_job_status(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "10 minutes", keep="30 minutes", idle="1 hour")
        stream = status.writeStream.outputMode("update").foreachBatch(lambda df, _, rows=rows: rows.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        stream.awaitTermination()
        got.append(sorted((r["job_id"], r["status"], r["updated_at"], r["events"]) for r in rows))
        held.append([o["numRowsTotal"] for o in stream.lastProgress["stateOperators"] if "transformWithState" in o["operatorName"]])
    assert got[0] == [(1, "completed", at(3), 2), (2, "running", at(1), 1)]
    assert got[1] == [(2, "queued", at(2), 2), (3, "running", at(20), 1)]
    assert got[2] == [(2, "completed", at(21), 3), (4, "running", at(200), 1)]
    assert got[4] == [(2, "running", at(202), 1), (4, "failed", at(203), 2)], "job 2 had ended"
    assert held == [[2], [3], [1], [2], [3]], "jobs 1, 2 and 3 go once the watermark has passed their last events"


def test_text_at_version_over_ranges(spark):
    import random

    rnd = random.Random(4)
    rows = [(k, v, f"before {v}" if rnd.random() < 0.05 else None, "now", k) for k in ("hot", None, "c") for v in range(900 if k == "hot" else 7)]
    out = versions.text_at_version(spark.createDataFrame(rows, "element string, version int, b string, n string, _own string"), ["element"], "version", "b", "n").drop("_own").collect()
    for r in out:
        later = [b for k, v, b, *_ in rows if k == r["element"] and v > r["version"] and b]
        assert r["text_at_version"] == (later[0] if later else "now")
    assert len(out) == len(rows)
    empty = spark.createDataFrame([], "element string, version int, b string, n string")
    assert versions.text_at_version(empty, ["element"], "version", "b", "n").count() == 0
