"""Near-dedup against the Jaccard similarity of all pairs."""

import random
import re

import numpy as np
import pytest

from flowgauge.llm import simhash


LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def kept_by_all_pairs(rows):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and 5 * len(a & b) >= 4 * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i for i in root if root[i] == i}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    line = " ".join(rng.choices(words, k=12))
    texts = []
    for _ in range(60):
        base = rng.choices(words, k=rng.choice([40, 120, 300]))
        texts.append(base)
        for share in (0.005, 0.02, 0.03, 0.05, 0.08):  # similarities around 0.8, above and below
            texts.append([w if rng.random() > share else rng.choice(words) for w in base])
    # texts that share a line many times over, and little else
    texts += [rng.choices(words, k=80) + line.split() * 30 for _ in range(10)]
    # few shingles: of five one is missing, and six words of which five are shared
    nine = rng.choices(words, k=9)
    texts += [nine, nine[:8], nine[:6], [*nine[:5], "other"]]
    return [(k + 1, " ".join(t)) for k, t in enumerate(texts)]


def test_all_pairs(spark, rows, monkeypatch):
    whole = simhash.jaccard_class_links  # several tiles
    monkeypatch.setattr(simhash, "jaccard_class_links", lambda *a, tile_size: whole(*a, tile_size=200))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    expected = kept_by_all_pairs(rows)
    assert 100 < len(expected) < len(rows) - 100
    assert got == expected


def test_sub_tiles(rows, monkeypatch):
    """Links by sub-tiles join what all pairs join."""
    keys, sets = zip(*(simhash.shingle_set(t, 5, 4) for _, t in rows))
    table = np.frombuffer(b"".join(keys), np.uint64).reshape(len(rows), 6)
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    monkeypatch.setattr(simhash, "SUB_TILE", 1500)
    at = [np.arange(0, len(rows), 2), np.arange(1, len(rows), 2)]
    for a, b in ((0, 0), (0, 1), (1, 1)):
        found = simhash.candidate_rows(table[at[a]], None if a == b else table[at[b]], 72, 4, 0.8)
        for x, y in {f[:2] for f in found}:
            mine = [(side, at[b if side and a != b else a][r]) for fx, fy, side, r in found if (fx, fy) == (x, y)]
            ids, side = [r for _, r in mine], np.array([s for s, _ in mine])
            for p, q in simhash.jaccard_links(table[ids], side, [sets[r] for r in ids], 72, 4, 0.8):
                p, q = sorted((find(ids[p]), find(ids[q])))
                root[q] = p
    assert {rows[k][0] for k in range(len(rows)) if root[k] == k} == kept_by_all_pairs(rows)
