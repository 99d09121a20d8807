"""Top-k search: repeated rows against the query's SQL, large numbers, and pairs of blocks that are never brought together."""

import duckdb
import numpy as np
import pytest

from flowgauge.llm import topk
from flowgauge.llm.queries import QUERIES, SQL
from tests.conftest import same_rows


def test_repeated_ids_and_rows_against_sql(spark, tmp_path):
    """Query rows that share an id, with one vector and with several; a row that comes very often; bad rows."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(300)]
    rows += [(50, rng.normal(size=6).tolist()), (50, rows[50][1]), (100, rows[100][1])] + [(7, [1.0] * 6)] * 400 + [(150, [1.0] * 6)] * 40
    rows += [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (250, [float("nan")] * 6), (None, [9.0] * 6)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'").fetchall()
    want = con.execute(SQL["op9_top_k"]).fetchdf()
    assert same_rows(QUERIES["op9_top_k"](spark, str(tmp_path)).toPandas(), want)
    blocks = topk.top_k(table.filter("vec_id % 50 = 0"), table, block_rows=40, query_rows=3)
    assert same_rows(blocks.toPandas(), want)
    assert topk._usable(table, "vec_id", "embedding", 5).filter("id = 7").count() == 6  # five copies of one row, and another


@pytest.mark.parametrize("size", [1e6, 1e9, 1e14])
def test_large_components(spark, size):
    """Beyond what doubles hold: ties and differences of one in numbers of up to 33 digits, by the same trees."""
    rng = np.random.default_rng(1)
    v = np.floor(rng.normal(size=(120, 4)) * size)
    v[10:20] = v[5]
    v[15, 0] += 1
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    exact = [[int(e) for e in row] for row in v]
    clamp = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = []
    for i in range(0, 120, 5):
        best = sorted((-sum(a * b for a, b in zip(exact[i], w)), j) for j, w in enumerate(exact) if j != i)[:3]
        want += [(i, r, j, clamp(-s)) for r, (s, j) in enumerate(sorted(best, key=lambda x: (-clamp(-x[0]), x[1])), 1)]
    for block in (1000, 16):
        got = topk.top_k(table.filter("vec_id % 5 = 0"), table, k=3, scale=1, block_rows=block, query_rows=8).collect()
        if size < 1e14:  # held to 64 bits, unequal scores can tie across blocks
            assert sorted(map(tuple, got)) == want
        else:
            assert sorted((r["query_id"], r["rank"], r["score"]) for r in got) == sorted((q, r, s) for q, r, _, s in want)


def test_pairs_of_far_blocks_are_not_shipped(spark, monkeypatch):
    """Clusters that point in different ways: most pairs of blocks fall to their roots, and nothing is lost."""
    rng = np.random.default_rng(8)
    ways = np.linalg.qr(rng.normal(size=(32, 32)))[0] * 4
    v = (ways[rng.integers(0, 32, 4000)] + rng.normal(size=(4000, 32)) * 0.02).round(4)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    counted = {}
    keep = topk.written
    monkeypatch.setattr(topk, "written", lambda df, name: counted.update({name: keep(df, name)}) or counted[name])
    got = topk.top_k(table.filter("vec_id % 50 = 0"), table, block_rows=64, query_rows=8).collect()
    assert counted["alive"].count() < 0.4 * counted["pairs"].count()
    whole = np.floor(256 * v)
    for q in range(0, 4000, 50):
        s = whole @ whole[q]
        best = sorted((-int(s[j]), j) for j in range(4000) if j != q)[:5]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(j, -s) for s, j in best]
