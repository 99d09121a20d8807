"""The prefix trie against plain Python over hand-made and drawn conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from flowgauge.llm import trie
from flowgauge.llm.queries import QUERIES, SQL
from tests.conftest import same_rows


def brute(convs):
    """Conversations {id: [(role, text), ...]} to the nodes of their trie."""
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in nodes:
        if path:
            kids[path[:-1]].append(path)

    def fold(path):
        below = [fold(k) for k in kids[path]]
        saved = (len(nodes[path]) - 1) * (len(path[-1][1].encode()) if path else 0) + sum(s for _, s in below)
        totals[path] = (sum(n for n, _ in below) or 1, saved)
        return totals[path]

    totals = {}
    if nodes:
        fold(())
    for path, members in nodes.items():
        ends = sorted(c for c in members if len(convs[c]) == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        yield (min(members), len(path), parent, len(members), len(kids[path]), *totals[path], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())


def check(spark, convs):
    rows = [(c, p, role, text, "x") for c, turns in convs.items() for p, (role, text) in enumerate(turns, 1)]
    table = spark.createDataFrame(rows, "conv_id long, pos int, role string, text string, conv string")
    steps = table.select("conv_id", "pos", trie.turn_key(F.col("role"), F.col("text")).alias("key"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    assert sorted(map(tuple, trie.prefix_trie(steps, ids).collect()), key=str) == sorted(brute(convs), key=str)


def test_small(spark):
    check(spark, {})
    check(spark, {5: []})
    check(spark, {5: [], 3: [], -2: []})
    check(spark, {9: [("u", "a"), ("a", "bé")]})
    check(spark, {9: [("u", "a"), ("a", "bé")], 4: [("u", "a"), ("a", "bé")]})
    check(spark, {1: [("u", "a")], 2: [("u", "a"), ("a", "b")], 3: [], 4: [("ua", "")], 5: [("u", "a"), ("a", "b")], 10: [("a", "a")]})


def test_drawn(spark):
    draw = random.Random(4)
    turn = lambda: (draw.choice("ua"), draw.choice(["", "x", "yé", "long " * 50]))
    convs = {c * 7 - 100: [turn() for _ in range(draw.randrange(6))] for c in range(300)}
    for c in range(40):
        convs[5000 + c] = [("u", "hot")] * 12  # copies
    convs[9000] = [("u", "hot")] * 11 + [("u", "cold")] + [turn() for _ in range(300)]  # one long conversation that parts late
    convs[9001] = convs[9000]
    check(spark, convs)


def test_pieces_of_many_ids(spark):
    """Copies over several ranges: one hash over all ids in order."""
    ids = [*range(0, 3000, 7), 10**12, -5]
    check(spark, {c: [("u", "same")] for c in ids} | {1: [("u", "other")]})


@pytest.mark.parametrize("broken", [False, True])
def test_query(spark, tmp_path, broken):
    """Nulls, gaps, repeated rows, copies and missing bases against the SQL."""
    draw = random.Random(8)
    rows = []
    for c in [*range(0, 60), *range(100, 160, 3)]:
        for t in range(draw.randrange(1, 12)):
            rows.append((c, t, draw.choice(["user", "assistant"]), draw.choice(["a", "b", "cc"])))
    if broken:
        rows += [(None, 0, "user", "lost"), (7, None, "user", "first"), (7, None, None, None), (8, 1, "user", None), (8, 1, "user", ""), (9, 0, "user", "dup"), (9, 0, "user", "dup")]
        rows += [(33, t, "user", "w " * 40_000) for t in range(3)] + [(34, t, "user", "w " * 40_000) for t in range(3)]
    table = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, key string, pos int")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'").fetchall()
    assert same_rows(QUERIES["op13_prefix_trie"](spark, str(tmp_path)).toPandas(), con.execute(SQL["op13_prefix_trie"]).fetchdf())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op13_prefix_trie"](spark, str(tmp_path)).count() == 0


def test_crc():
    """The SQL's checksum is the usual one."""
    con = duckdb.connect()
    inner = SQL["op13_prefix_trie"].split("select c, xor(")[1].split(" % 9 h from n")[0]
    for c in (0, 7, 123456, -1):
        assert con.execute(f"select xor({inner} from (select {c}::bigint c)").fetchall() == [(zlib.crc32(str(c).encode()),)]
