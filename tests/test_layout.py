"""Snapshots, deep pages and clustered tables: what they give, and which files they read."""

import random

import pytest
from pyspark.sql import functions as F

from flowgauge.operators import alerts, layout, snapshots
from flowgauge.sources.files import exists, listed


def states(spark, rows):
    return spark.createDataFrame(rows, "symbol string, n long")


def held(spark, path, version=None):
    return {r["symbol"]: r["n"] for r in snapshots.snapshot(path, version).rows(spark).collect()}


def test_snapshots_copy_only_what_changes(spark, tmp_path):
    path = str(tmp_path)
    assert snapshots.snapshot(path) is None
    first = snapshots.merge(path, states(spark, [(f"s{k}", k) for k in range(200)]), ["symbol"], 16)
    assert first.total == 200 and len(first.buckets) == 16
    second = snapshots.merge(path, states(spark, [("s3", -3), ("new", 1)]), ["symbol"])
    changed = {b for b in second.buckets if second.buckets[b]["files"] != first.buckets[b]["files"]}
    assert len(changed) <= 2 and second.total == 201
    assert held(spark, path) == {f"s{k}": k for k in range(200)} | {"s3": -3, "new": 1} and held(spark, path, 0)["s3"] == 3
    # a page and the total are of one version, whatever is merged meanwhile
    snapshots.merge(path, states(spark, [("later", 5)]), ["symbol"])
    rows, total = second.page(spark, [F.desc("n"), F.col("symbol")], 3, 1)
    assert [r["symbol"] for r in rows.collect()] == ["s198", "s197", "s196"] and total == 201
    # a version that is there already stands
    again = snapshots.merge(path, states(spark, [("other", 9)]), ["symbol"], version=1)
    assert again == second and "other" not in held(spark, path)
    before = set(snapshots.snapshot(path, 1).files)
    assert snapshots.expire(path, 1) > 0 and snapshots.versions(path) == [2] and held(spark, path)["later"] == 5
    kept = set(snapshots.snapshot(path).files)
    assert all(exists(f) for f in kept) and not any(exists(f) for f in before - kept)


def test_snapshots_of_nothing_and_of_nulls(spark, tmp_path):
    path = str(tmp_path)
    assert snapshots.merge(path, states(spark, []), ["symbol"], 4).total == 0 and held(spark, path) == {}
    snapshots.merge(path, states(spark, [(None, 1), ("a", 2)]), ["symbol"])
    assert snapshots.merge(path, states(spark, []), ["symbol"]).total == 2 and held(spark, path) == {None: 1, "a": 2}
    with pytest.raises(ValueError, match="other keys"):
        snapshots.merge(path, states(spark, [("a", 1)]).withColumn("x", F.lit(1)), ["symbol"])
    assert len(listed(f"{path}/versions")) == 3


def test_deep_pages_read_two_files_at_most(spark, tmp_path):
    rows = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k"), (F.col("id") % 3).alias("v"))
    path, order = f"{tmp_path}/t", [F.desc("k")]
    layout.write_sorted(rows, path, order, 20)
    assert layout.sorted_total(spark, path) == 5000
    for offset in (0, 1, 249, 2500, 4990):
        page = layout.sorted_page(spark, path, order, 50, offset)
        assert [r["k"] for r in page.collect()] == list(range(4999 - offset, max(-1, 4949 - offset), -1))
        assert len(page.inputFiles()) <= 2
    assert layout.sorted_page(spark, path, order, 50, 5000).count() == 0
    assert [r["k"] for r in layout.next_page(spark, path, order, 3, F.col("k") < 2000).collect()] == [1999, 1998, 1997]
    layout.write_sorted(rows.limit(0), f"{tmp_path}/none", order, 4)
    assert layout.sorted_total(spark, f"{tmp_path}/none") == 0


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    draw = random.Random(5)
    names = [f"S{k}USDT" for k in range(8)]
    rows = [(k, names[0] if draw.random() < 0.3 else draw.choice(names), draw.gauss(0, 1) * 4, 1_700_000_000 + draw.randrange(10**6)) for k in range(20_000)]
    table = spark.createDataFrame(rows, "id long, symbol string, z_score double, at long").withColumn("alerted_at", F.timestamp_seconds("at"))
    path = f"{tmp_path_factory.mktemp('curve')}/t"
    layout.write_alerts(table, path, 64)
    return table, path


@pytest.mark.parametrize(
    "asked,share",
    [
        ({"symbol": "s3usdt "}, 0.5),
        ({"from_time": "2023-11-20 00:00:00", "to_time": "2023-11-21 00:00:00"}, 0.7),
        ({"min_z": 8.0}, 0.35),
        ({"symbol": "S0USDT", "from_time": "2023-11-20 00:00:00", "to_time": "2023-11-21 00:00:00", "min_z": 6.0}, 0.15),
        ({"symbol": "none"}, 0.0),
        ({}, 1.0),
    ],
)
def test_curve_leaves_files_out(spark, clustered, asked, share):
    """The history of the whole table, from a share of its files, by any of three dimensions."""
    table, path = clustered
    files = layout.alert_files(spark, path, **asked)
    got = alerts.alert_history(layout.curve_rows(spark, path, files), **asked)
    want = alerts.alert_history(table, **asked)
    assert sorted(r["id"] for r in got.select("id").collect()) == sorted(r["id"] for r in want.select("id").collect())
    assert len(files) <= share * len(spark.read.parquet(f"{path}/data").inputFiles())


def test_curve_of_nothing(spark, clustered, tmp_path):
    path = f"{tmp_path}/none"
    layout.write_alerts(clustered[0].limit(0), path, 4)
    assert layout.curve_rows(spark, path, layout.alert_files(spark, path, symbol="A")).count() == 0


def test_audit_curve(spark, tmp_path):
    rows = [(k, ["ALERT", "CONFIG_CHANGE"][k % 5 == 0], None if k % 50 == 0 else f"S{k % 7}", 1000 * k) for k in range(5000)]
    table = spark.createDataFrame(rows, "id long, event_type string, symbol string, created_at_ms long")
    path = f"{tmp_path}/log"
    layout.write_audit(table, path, 32)
    for asked, test in (
        ({"event_type": "CONFIG_CHANGE"}, "event_type = 'CONFIG_CHANGE'"),
        ({"symbol": "S3", "from_ms": 100_000, "to_ms": 400_000}, "symbol = 'S3' and created_at_ms between 100000 and 400000"),
        ({}, "true"),
    ):
        got = layout.audit_history(spark, path, **asked)
        assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in table.filter(test).collect())
        assert not asked or len(got.inputFiles()) < 20
