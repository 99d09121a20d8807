"""The learner against follow-the-regularised-leader written out over dicts."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from flowgauge.llm import quality

ALPHA, BETA, L1, L2, BITS = 1.0, 1.0, 0.01, 0.01, 18
M32 = (1 << 32) - 1


def slots_of(text):
    raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    tokens = re.findall(rb"[a-z0-9\x80-\xff]+|[^\x20\x09-\x0Da-z0-9\x80-\xff]+", raw)
    h = [zlib.crc32(t) for t in tokens]
    found = [(x ^ x >> 16) for x in h]
    for a, b in zip(h, h[1:]):
        p = (a * 0x9E3779B1 + (b ^ b >> 15) * 0x85EBCA77) & M32
        found.append(p ^ p >> 13)
    counts = Counter(x & (1 << BITS) - 1 for x in found)
    size = math.sqrt(sum(c * c for c in counts.values())) or 1.0
    return {s: c / size for s, c in counts.items()}


def learn(examples, epochs=3):
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= L1:
            return 0.0
        return (math.copysign(L1, z[i]) - z[i]) / ((BETA + math.sqrt(n[i])) / ALPHA + L2)

    for _ in range(epochs):
        for features, label in examples:
            x = {**features, "bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z)}


def test_weights_and_scores(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    repeated = docs.unionByName(docs.filter("doc_id % 3 = 0"))  # a doc_id is one example
    got = quality.train_quality(repeated, labels)
    order = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"))).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    examples = [(slots_of(texts[i]), marks[i]) for i in sorted(marks, key=lambda i: order[i]) if i in texts]
    assert len(examples) > 20 and {0, 1} == {y for _, y in examples}
    expected = learn(examples)
    for i, w in expected.items():
        assert math.isclose(got[-1 if i == "bias" else i], w, rel_tol=1e-3, abs_tol=1e-4)
    assert np.count_nonzero(got) <= len(expected)
    scores = {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality.quality_score(F.col("text"), got).alias("s")).collect()}
    for i, t in texts.items():
        total = expected.get("bias", 0.0) + sum(expected.get(s, 0.0) * v for s, v in slots_of(t).items())
        assert math.isclose(scores[i], 1 / (1 + math.exp(-total)), abs_tol=1e-3)


def test_a_doc_id_with_many_rows_is_one_example(spark):
    docs = spark.createDataFrame([(1, "good words here")] + [(2, f"bad {k}") for k in range(500)] + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    few = spark.createDataFrame([(1, "good words here"), (2, "bad 0"), (3, None)], "doc_id long, text string")
    assert (quality.train_quality(docs, labels) == quality.train_quality(few, labels)).all()
