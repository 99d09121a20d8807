"""The search of near-dedup: which texts are compared, and that none is lost."""

import itertools
import random

import numpy as np
import pytest

from flowgauge.llm import simhash
from tests.llm.test_near_dedup import kept_by_all_pairs


def test_prefixes_meet():
    """Sets of a similarity of 0.8 or more share a hash of their prefixes, whatever comes last."""
    rng = np.random.default_rng(3)
    met = 0
    for n in [*range(1, 30), 100, 400]:
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            gone = rng.permutation(n)[: rng.integers(0, n // 5 + 1)]
            b = np.unique(np.concatenate([np.delete(a, gone), rng.integers(0, 1 << 63, rng.integers(0, n // 5 + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both < 0.8 * (len(a) + len(b) - both):
                continue
            met += 1
            for often in (a[:0], np.sort(rng.permutation(a)[: n // 2]), np.setdiff1d(a, b), np.intersect1d(a, b)):
                assert len(np.intersect1d(simhash.prefix(a, 0.8, often), simhash.prefix(b, 0.8, often)))
    assert met > 600


def test_group_links(monkeypatch):
    """Side by side and in blocks, links join what all close pairs join; rows of a part are joined unseen."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (40, 6)).astype(np.uint64)
    rows = np.repeat(base, 5, axis=0)
    for k in range(len(rows)):
        rows[k, rng.integers(0, 4, 24)] ^= np.uint64(1) << rng.integers(0, 64, 24).astype(np.uint64)
    rows[:, 4] = rng.integers(90, 112, len(rows))
    rows = rows[rng.permutation(len(rows))]
    sizes, whole = np.array([2, 90, 1, 3, 60, 40, 4]), np.array([True] * 6 + [False])

    def components(pairs):
        root = list(range(len(rows)))
        for i, j in pairs:
            old, new = root[max(i, j)], root[min(i, j)]
            root = [new if r == old else r for r in root]
        return [sorted(k for k, r in enumerate(root) if r == x) for x in sorted(set(root))]

    ends = np.cumsum(sizes).tolist()
    expected = list(itertools.pairwise(range(ends[-2], ends[-1])))
    for s, e in zip([0, *ends], ends[:-1]):
        for i, j in itertools.combinations(range(s, e), 2):
            m, n = sorted(rows[[i, j], 4].tolist())
            bits = np.bitwise_count(rows[i, :4] ^ rows[j, :4]).tolist()
            if sum(bits[:2]) <= 45 and sum(bits) <= 72 and m >= 0.8 * n:
                expected.append((i, j))
    assert len(expected) > 20
    for small in (0, 64):
        monkeypatch.setattr(simhash, "SMALL_GROUP", small)
        got = [p for i, j in simhash.group_links(rows, sizes, whole, 72, 4, 0.8) for p in zip(i.tolist(), j.tolist())]
        assert sum(map(len, components(got))) == len(rows) and components(sorted(got)) == components(sorted(expected))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(5000)]
    line = " ".join(rng.choices(words, k=30))
    texts = [f"{line} own{k} {' '.join(rng.choices(words, k=60))}" for k in range(150)]
    family = rng.choices(words, k=150)
    texts += [" ".join(w if rng.random() > 0.01 else rng.choice(words) for w in family) for _ in range(80)]
    texts += [" ".join(rng.choices(words, k=80)) for _ in range(150)]
    texts += [t + " again" for t in texts[::3]]
    return [(k + 1, t) for k, t in enumerate(texts)]


def test_unlike_texts_never_meet(spark, rows, monkeypatch):
    """Texts without a common shingle, or with a frequent line alone, are not compared."""
    monkeypatch.setattr(simhash, "tiled", None)  # no pairs of tiles
    texts = [t for k, t in rows if k <= 150 or 230 < k <= 380]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    frequent = simhash.frequent_shingles(docs, 5)
    assert len(frequent) == 26
    held = spark.sparkContext.broadcast(frequent)
    docs = docs.select(simhash.near_key_column("text", 5, 4, 0.8, held).alias("x")).select("x.fp", "x.prefix")
    assert simhash.prefix_groups(docs).count() == 0
    family = [(t,) for k, t in rows if k in (151, 152)]
    docs = spark.createDataFrame(family * 3, "text string").repartition(2)
    docs = docs.select(simhash.near_key_column("text", 5, 4, 0.8, held).alias("x")).select("x.fp", "x.prefix")
    assert [len(r["members"]) for r in simhash.prefix_groups(docs).collect()] == [2]


@pytest.mark.parametrize("group, sub_tile", [(1 << 16, 1 << 21), (20, 1 << 21), (1 << 16, 800), (20, 800)])
def test_all_pairs(spark, rows, monkeypatch, group, sub_tile):
    """Large groups cut into parts and large components cut into tiles and sub-tiles keep what all pairs keep."""
    whole = simhash.jaccard_class_links
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "SUB_TILE", sub_tile)
    monkeypatch.setattr(simhash, "jaccard_class_links", lambda *a, tile_size: whole(*a, tile_size=30))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    assert got == kept_by_all_pairs(rows) and 250 < len(got) < len(rows) - 150
