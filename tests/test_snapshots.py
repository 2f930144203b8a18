"""Snapshots in every layout that the parsers accept."""

import gzip
import json

from helioscope.sources import snapshots as sn


def test_blocks(spark, tmp_path):
    for n, doc in {7: {"netuid": [1, 3], "Emission": [[1, None, 2.5], [[0, 4], [5, 6]]], "Tempo": [360, {"bits": 9}]}, 8: {"netuid": [1, 3], "Emission": [[1], []]}, 9: {"netuid": 4, "Tempo": [[True]]}}.items():
        doc["block_info"] = {"number": n, "hash": "h", "timestamp": "2024-01-01T00:00:00" if n < 9 else None}
        with gzip.open(tmp_path / f"block_{n}.json.gz", "wt") as f:
            json.dump(doc, f)
    (tmp_path / "notes.txt").write_text("")
    done = sn.collected_blocks(spark, str(tmp_path))
    assert sorted(r.block for r in done.collect()) == [7, 8, 9]
    wanted = sn.spaced_blocks(spark, 3, 10, 36 / 2592000)
    assert [r.block for r in wanted.collect()] == [7, 8, 9, 10]
    assert [r.block for r in sn.pending(wanted, done).collect()] == [10]
    blocks = sn.read_blocks(spark, str(tmp_path / "block_*"), ["Emission", "Tempo"])
    filled = sn.by_market(sn.fill_sampled(blocks, ["Tempo"]), ["Emission", "Tempo"])
    assert sorted((r.block, r.netuid, r.v) for r in filled.withColumn("v", sn.scalar(filled["Tempo"])).collect()) == [(7, 1, 360.0), (7, 3, 9.0), (8, 1, 360.0), (8, 3, 9.0), (9, 4, 1.0)]
    got = sn.vector(filled, "Emission", ["block", "netuid"])
    assert sorted(tuple(r) for r in got.collect()) == [(7, 1, 0, 1.0), (7, 1, 2, 2.5), (7, 3, 0, 4.0), (7, 3, 5, 6.0), (8, 1, 0, 1.0)]


def test_layouts(spark):
    scalars = {"5": 5.0, "[2]": 2.0, '{"value": 3}': 3.0, '{"bits": 4}': 4.0, "true": 1.0, "[1,2]": 1.0, "[]": None, "x": None, None: None}
    rows = spark.createDataFrame([(k,) for k in scalars], "c string")
    assert {r.c: r.v for r in rows.withColumn("v", sn.scalar(rows["c"])).collect()} == scalars
    vectors = spark.createDataFrame([(1, "[[1,2,3]]"), (2, "[]"), (3, None), (4, '[{"value":7},null]'), (5, "[[3,1],[3,2]]"), (6, "bad")], "k int, v string")
    assert sorted(tuple(r) for r in sn.vector(vectors, "v", ["k"]).collect()) == [(1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0), (4, 0, 7.0), (5, 3, 2.0)]
    keys = spark.createDataFrame([(1, '["a","",{"ss58":"b"}]')], "k int, v string")
    assert sorted((r.uid, r.value) for r in sn.vector(keys, "v", ["k"], sn.account).collect()) == [(0, "a"), (2, "b")]
    m = spark.createDataFrame([(1, 3, "[[2,[[0,5],[9,1],[0,6]]],[7,[[0,8]]]]"), (2, 2, "[[1,2],[3,4]]"), (3, 3, "[[[1,5]],[]]"), (4, 3, "[]"), (5, 3, None)], "k int, n int, m string")
    assert sorted(tuple(r) for r in sn.matrix(m, "m", ["k"], "n").collect()) == [(1, 2, 0, 6.0), (2, 0, 0, 1.0), (2, 0, 1, 2.0), (2, 1, 0, 3.0), (2, 1, 1, 4.0), (3, 0, 1, 5.0)]
