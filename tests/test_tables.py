import hashlib

import pytest
from pyspark.sql import functions as F

from flowgauge import schemas
from flowgauge.operators import alerts, audit, tables
from flowgauge.tables import stored


def test_chain(spark):
    rows = [(i, "T", "me", None, None, f"d{i}", 1000 + i, i % 2) for i in range(1, 8)]
    log = audit.build_chain(spark.createDataFrame(rows, schemas.AUDIT + ", segment int"))
    last = {}
    for r in log.orderBy("id").collect():
        text = f"T|me|||{r['details']}|{r['created_at_ms']}|{last.get(r['segment'], '')}"
        assert r["previous_hash"] == last.get(r["segment"]) and r["entry_hash"] == hashlib.sha256(text.encode()).hexdigest()
        last[r["segment"]] = r["entry_hash"]
    assert audit.verify_chain(log).filter("not ok").count() == 0
    forged = log.withColumn("actor", F.when(F.col("id") == 3, "you").otherwise(F.col("actor")))
    assert [r["id"] for r in audit.verify_chain(forged).filter("not ok").collect()] == [3]
    assert [r["id"] for r in audit.verify_chain(log.filter("id <> 3")).filter("not ok").collect()] == [5]


def test_parts_of_a_segment(spark):
    rows = [(i, "T", "me", None, None, "d", 0, 0) for i in range(25)]
    log = audit.build_chain(spark.createDataFrame(rows, schemas.AUDIT + ", segment int"), part_rows=10)
    starts = [r["id"] for r in log.orderBy("id").collect() if r["previous_hash"] is None]
    assert starts == [0, 10, 20] and audit.verify_chain(log, part_rows=10).filter("not ok").count() == 0
    assert audit.build_chain(log.select(*rows_of(schemas.AUDIT), "segment").limit(0)).count() == 0


@pytest.fixture(scope="module")
def sparse(spark):
    """A log whose ids are far apart and come twice each, null segments among them, written and read back."""
    rows = [((i // 2) * 1_000_003, "T", f"a|{i % 5}", None, None, f"d{i}\\", 1000 + i, None if i % 3 == 2 else i % 3) for i in range(4000)]
    return stored(audit.build_chain(spark.createDataFrame(rows, schemas.AUDIT + ", segment int").repartition(5), part_rows=300), "log")


def problems(log, heads):
    return sorted((r["segment"] is None, r["segment"] or 0, r["part"], r["problem"]) for r in audit.verify_parts(log, heads).filter("problem is not null").collect())


def test_untouched_log_verifies(sparse):
    assert sparse.filter("previous_hash is not null").count() == 4000 - sparse.select("segment", "part").distinct().count()
    assert audit.verify_chain(sparse, part_rows=300).filter("not ok").count() == 0
    assert problems(sparse, audit.chain_heads(sparse)) == []


def test_each_forgery_is_found(sparse):
    """A field, a swapped pair, an entry, a part and a tail."""
    heads = stored(audit.chain_heads(sparse), "heads")
    bad = lambda log: sorted((r["segment"], r["entry"]) for r in audit.verify_chain(log, part_rows=300).filter("not ok and segment = 0").collect())
    assert bad(sparse.withColumn("actor", F.when(F.expr("segment = 0 and entry = 7"), "x").otherwise(F.col("actor")))) == [(0, 7)]
    swapped = sparse.withColumn("entry", F.expr("case when segment = 0 and entry = 7 then 8 when segment = 0 and entry = 8 then 7 else entry end").cast("long"))
    assert bad(swapped) == [(0, 7), (0, 8), (0, 9)]
    assert bad(sparse.filter("not (segment <=> 0 and entry = 12)")) == [(0, 13)]
    assert bad(sparse.filter("not (segment <=> 0 and entry = 301)")) == [(0, 302)]
    # what no entry tells of, the heads do
    assert bad(sparse.filter("not (segment <=> 1 and part = 2)")) == []
    assert problems(sparse.filter("not (segment <=> 1 and part = 2)"), heads) == [(False, 1, 2, "missing")]
    assert problems(sparse.filter("not (segment is null and part = 1 and entry = 600)"), heads) == [(True, 0, 1, "short")]
    again = sparse.withColumn("entry_hash", F.when(F.expr("segment = 0 and entry = 300"), "0").otherwise(F.col("entry_hash")))
    assert problems(again, heads) == [(False, 0, 0, "forged")]
    assert problems(sparse, heads.filter("not (segment <=> 1 and part = 2)")) == [(False, 1, 2, "unknown"), (False, 1, 3, "head")]


def merkle(leaves):
    """All levels of a tree in plain Python."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    levels = [[sha("leaf|" + x) for x in leaves]]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("node|" + last[k] + last[k + 1]) if k + 1 < len(last) else last[k] for k in range(0, len(last), 2)])
    return levels


def test_merkle_tree(spark):
    """Segments of many sizes, over several passes of the builder: roots, proofs, and a proof of a forged entry."""
    rows = [(n, k + 1, f"{n}-{k}") for n in (1, 2, 3, 7, 8, 9, 33, 100) for k in range(n)]
    log = spark.createDataFrame(rows, "segment int, entry long, entry_hash string").repartition(4)
    tree = stored(audit.merkle_tree(log, tier=2), "tree")
    want = {n: merkle([f"{n}-{k}" for k in range(n)]) for n in {r[0] for r in rows}}
    assert {(r["segment"], r["n_entries"], r["root"]) for r in audit.roots(tree).collect()} == {(n, n, t[-1][0]) for n, t in want.items()}
    proofs = audit.prove(tree, log.select("segment", "entry")).join(log, ["segment", "entry"]).join(audit.roots(tree), "segment")
    proofs = proofs.withColumn("led", audit.root_of(F.col("entry_hash"), F.col("proof"))).withColumn("forged", audit.root_of(F.lit("x"), F.col("proof")))
    for r in proofs.collect():
        assert r["led"] == r["root"] != r["forged"] and len(r["proof"]) <= (r["segment"] - 1).bit_length()
        assert [s["hash"] for s in r["proof"]] == [
            lv[(r["entry"] - 1 >> k) ^ 1] for k, lv in enumerate(want[r["segment"]]) if (r["entry"] - 1 >> k) ^ 1 < len(lv) > 1
        ]
    assert audit.merkle_tree(log.limit(0)).count() == 0 and audit.prove(tree.limit(0), log.select("segment", "entry").limit(0)).count() == 0


def test_proofs_in_tiers(spark):
    """Proofs over several tiers, of some entries and with their own columns; the plan makes no row of an entry and a level."""
    log = spark.range(150).select(F.lit(7).alias("segment"), (F.col("id") + 1).alias("entry"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("entry_hash"), "id")
    tree, want = stored(audit.merkle_tree(log), "tree"), merkle([f"h{k}" for k in range(150)])
    some = log.filter("id % 4 = 1 or id = 149").select("id", "segment", "entry", "entry_hash")
    some = some.unionByName(some.filter("id < 9"))
    proofs = audit.prove(tree, some, tier=3)
    assert proofs.columns == [*some.columns, "proof"]
    found = proofs.collect()
    assert sorted(r["id"] for r in found) == sorted({*range(1, 150, 4), 149})
    for r in found:
        place = r["entry"] - 1
        assert [tuple(s) for s in r["proof"]] == [(k, (place >> k) % 2 == 1, lv[(place >> k) ^ 1]) for k, lv in enumerate(want) if (place >> k) ^ 1 < len(lv) > 1]
    assert "explode" not in proofs._jdf.queryExecution().optimizedPlan().toString()


def rows_of(schema):
    return [c.split()[0] for c in schema.split(", ")]


def test_configure(spark):
    table = spark.createDataFrame(schemas.SEED_CONFIGS, schemas.SYMBOL_CONFIG)
    changes = spark.createDataFrame([("ethusdt", 4.0, 0.2, 5), ("xrp", 2.0, 0.1, 1), (None, 1.0, 0.1, 1)], schemas.SYMBOL_CONFIG)
    new, entries = tables.configure(table, changes, "ann", F.lit(9), first_id=7)
    assert {r["symbol"]: r["z_threshold"] for r in new.collect()} == {"BTCUSDT": 3.0, "DOGEUSDT": 2.5, "ETHUSDT": 4.0, "XRP": 2.0}
    assert sorted((r["id"], r["symbol"], r["actor"], r["created_at_ms"]) for r in entries.collect()) == [(7, "ETHUSDT", "ann", 9), (8, "XRP", "ann", 9)]


def test_numbered(spark):
    t = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"))
    assert all(r["sequence"] == r["x"] + 1 for r in tables.numbered(t, ["x"], part_rows=90).collect())


def test_bounded_ranges(spark):
    """Tiny parts don't make more ranges than shuffle partitions, and give the same rows, also within a hot key."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = spark.range(10_000).select(((F.col("id") * 7919) % 10_000).alias("x"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 500 > 0, F.col("id").cast("string")).alias("k"))
    assert tables._dealt(t, ["x"], 3).select("_part").distinct().count() <= most
    assert all(r["sequence"] == r["x"] + 1 for r in tables.numbered(t, ["x"], part_rows=3).collect())
    want = sorted(map(tuple, tables.numbered(t, ["x"], key="k").collect()), key=str)
    for part_rows in (0, 3):
        assert sorted(map(tuple, tables.numbered(t, ["x"], key="k", part_rows=part_rows).collect()), key=str) == want
    sums = tables.running(t, {"s": F.col("x"), "n": F.lit(1)}, ["x"], part_rows=3).collect()
    assert all(r["s"] == r["x"] * (r["x"] + 1) // 2 and r["n"] == r["x"] + 1 for r in sums)
    assert tables.numbered(t.limit(0), ["x"], part_rows=0).count() == 0


def test_previous(spark):
    """Keys over many ranges, one of a single row, null keys and ties of order."""
    rows = [("hot", i, i * 7) for i in range(300)] + [("one", 5, 1), (None, 2, 20), (None, 1, 10), ("two", 1, 1), ("two", 2, 2)]
    t = spark.createDataFrame(rows, "k string, n long, v long")
    for part_rows in (1000, 20):
        found = {(r["k"], r["n"]): r["before"] for r in tables.previous(t, "v", "k", ("n",), "before", part_rows).collect()}
        assert all(found["hot", i] == (None if i == 0 else (i - 1) * 7) for i in range(300))
        assert found["one", 5] is None and found[None, 1] is None and found[None, 2] == 10 and found["two", 2] == 1
        assert len(found) == len(rows)
    assert tables.previous(t.limit(0), "v", "k", ("n",), "before").count() == 0


@pytest.mark.parametrize("name", ["_key", "_at", "_of", "_at_part"])
def test_ranges_of_any_key(spark, name):
    """Helpers that deal rows by ranges take a key of any name."""
    rows = spark.range(60).select((F.col("id") % 3).alias(name), "id", F.when(F.col("id") % 4 == 0, F.col("id")).alias("x"))
    for found in (
        tables.running(rows, {"n": F.lit(1).cast("long")}, ["id"], name, part_rows=7),
        tables.previous(rows, "x", name, ("id",), "n", part_rows=7),
        tables.filled(rows, ("x",), ["id"], name, part_rows=7),
    ):
        assert found.count() == 60


def test_upsert_and_seed(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, tables.seed(old, new, ["k"]).collect())) == [("a", 1), ("b", 2), ("c", 4)]


def test_pages(spark):
    t = spark.range(10)
    assert [r[0] for r in alerts.page(t, [F.desc("id")], 3, 2).collect()] == [7, 6, 5]
    for limit, offset in ((0, 0), (501, 0), (1, -1)):
        with pytest.raises(ValueError):
            alerts.page(t, ["id"], limit, offset)


def test_alert_json(spark):
    scored = spark.createDataFrame([("S", 3.1234567891, 1.0, 2.0, 0.5, True), ("T", 1.0, 1.0, 1.0, 1.0, False)], "symbol string, z_score double, ewma double, ewma_var double, signed_ofi double, is_toxic boolean")
    made = alerts.alert_json(alerts.build_alerts(scored, F.lit(7))).collect()
    assert [r["key"] for r in made] == ["S"] and '"z_score":3.123457' in made[0]["value"] and '"alert_type":"toxicity"' in made[0]["value"]


def test_shared_folder():
    from types import SimpleNamespace

    from flowgauge.tables import shared_dir

    def session(master, path=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: path), sparkContext=SimpleNamespace(master=master, applicationId="a"))

    assert shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(session("local[4]")) == shared_dir(session("local")) and shared_dir(session("local[4]")).startswith("file://")
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))
