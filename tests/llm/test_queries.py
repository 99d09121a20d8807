"""The registered queries against SQL or brute force, over whole small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import regex
import tiktoken
import xxhash

import corpus_pipeline
from flowgauge.llm import bpe, decontam, licenses, quality, simhash
from flowgauge.llm.queries import QUERIES, SQL
from flowgauge.llm.token_counts import zipf_scores
from tests.conftest import same_rows
from tests.llm.test_near_dedup import kept_by_all_pairs

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'").fetchall()
    return con


@pytest.fixture(scope="module")
def docs(db):
    return db.execute("select doc_id, text from documents order by doc_id").fetchall()


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, db, name):
    assert same_rows(QUERIES[name](spark, SF).toPandas(), db.execute(SQL[name]).fetchdf())


def test_revisits_and_repeats(spark, tmp_path, db):
    """Pages of which many are equal: the tables at this size have none."""
    db.execute("select * from pages").fetchdf().assign(html=lambda d: d.html.where(d.page_id % 3 > 0, d.html.iloc[0])).to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet'").fetchall()
    got = QUERIES["op1_warc"](spark, str(tmp_path)).toPandas()
    assert (got.record_type == "revisit").sum() > 10
    assert same_rows(got, con.execute(SQL["op1_warc"]).fetchdf())


def test_token_counts(spark, docs):
    scores = zipf_scores(P.path("byte_bpe_50k.tiktoken"))

    def best(word):
        raw = word.encode()
        found = [(0.0, 0)]
        for end in range(1, len(raw) + 1):
            found.append(min((found[s][0] - scores[raw[s:end]], found[s][1] + 1) for s in range(end) if raw[s:end] in scores))
        return found[-1][1]

    find = regex.compile(P.PATTERN).findall
    known = {w: best(w) for _, t in docs for w in set(find(t or ""))}
    expected = {i: sum(known[w] for w in find(t or "")) for i, t in docs}
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op2_token_counts"](spark, SF).collect()}
    assert got == expected


def brute_lm(docs, held, order):
    texts = {i: [" ", *split(t), "\n"] for i, t in docs}
    grams = {k: Counter() for k in range(1, order + 1)}
    for i, w in texts.items():
        for p in range(1, len(w) if not held(i) else 0):
            for k in grams:
                if p - k + 1 >= 0:
                    grams[k][tuple(w[p - k + 1 : p + 1])] += 1
    n, v = grams[1].total(), len(grams[1])
    discount = {}
    for k, c in grams.items():
        n1, n2 = (sum(x == m for x in c.values()) for m in (1, 2))
        discount[k] = min(0.9, max(0.1, n1 / (n1 + 2 * n2)))
    followed, kinds = Counter(), Counter()
    for k in range(2, order + 1):
        for g, c in grams[k].items():
            followed[g[:-1]] += c
            kinds[g[:-1]] += 1

    def p(h, w):
        if not h:
            return (max(grams[1][(w,)] - discount[1], 0) + discount[1] * v / (v + 1)) / n
        if not followed[h]:
            return p(h[1:], w)
        d = discount[len(h) + 1]
        return max(grams[len(h) + 1][(*h, w)] - d, 0) / followed[h] + d * kinds[h] / followed[h] * p(h[1:], w)

    for i, w in texts.items():
        base = sum(math.log10((grams[1][(x,)] + 1) / (n + v + 1)) for x in w[1:])
        score = sum(math.log10(p(tuple(w[max(0, q - order + 1) : q]), w[q])) for q in range(1, len(w)))
        yield i, held(i), len(w) - 1, sum(grams[1][(x,)] > 0 for x in w[1:]), n, base, score


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm(spark, docs, order):
    from pyspark.sql import functions as F

    from flowgauge.llm.lm import score_texts

    if order == 2:
        got = QUERIES["op3_lm_score"](spark, SF)
    else:  # small blocks, so that totals come from several
        train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
        got = score_texts(spark.read.parquet(f"{SF}/documents.parquet"), train, order, block_tokens=5_000)
    got = {r["doc_id"]: tuple(r) for r in got.collect()}
    for row in brute_lm(docs, lambda i: zlib.crc32(str(i).encode()) % 7 == 2, order):
        assert got[row[0]][:5] == row[:5]
        assert np.allclose(got[row[0]][5:], row[5:], rtol=1e-10)


@pytest.mark.parametrize("order,meeting,buckets", [(2, 3, 700), (3, 2, 20_000), (1, 40, 300)])
def test_lm_of_units(spark, docs, order, meeting, buckets):
    """More blocks than may meet in one place: units add up what theirs have, and every score is the same."""
    from pyspark.sql import functions as F

    from flowgauge.llm.lm import score_texts

    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = score_texts(table, train, order, block_tokens=900, bucket_tokens=buckets, meeting=meeting)
    got = {r["doc_id"]: tuple(r) for r in got.collect()}
    for row in brute_lm(docs, lambda i: zlib.crc32(str(i).encode()) % 7 == 2, order):
        assert got[row[0]][:5] == row[:5]
        assert np.allclose(got[row[0]][5:], row[5:], rtol=1e-10)


def test_lm_is_better_than_base(spark):
    got = QUERIES["op3_lm_score"](spark, SF).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def brute_licenses(text, templates):
    """Every run of passages against every template, one by one; of overlapping matches, that with most in common stays."""

    def words(t):
        return re.findall(r"[^\W_]+(?:\.\d+)*", t.lower())

    def bag(w):
        w = ["", *w, ""]
        return Counter(zip(w, w[1:]))

    bags = [(name, bag(words(t))) for name, ts in templates.items() for t in ts]
    largest = max(sum(b.values()) for _, b in bags)
    passages = [w for p in re.split(r"\n+|(?<=[.!?;])\s+", text or "") if (w := words(p))]
    starts = np.cumsum([0, *map(len, passages)]).tolist()
    found = []
    for i in range(len(passages)):
        run = []
        for j in range(i, len(passages)):
            run += passages[j]
            if len(run) > 2 * largest:
                break
            mine, top = bag(run), None
            for name, b in bags:
                common = sum(min(c, b[g]) for g, c in mine.items() if g in b)
                score = 2 * common / (sum(mine.values()) + sum(b.values()))
                if score >= 0.8 and (top is None or (-score, name) < top[0]):
                    top = (-score, name), common
            if top:
                found.append((-top[1], top[0][0], starts[i], starts[j + 1], top[0][1]))
    out, taken = [], set()
    for _, score, s, e, name in sorted(found):
        if not taken & set(range(s, e)):
            taken |= set(range(s, e))
            out.append((name, -score))
    return out


def test_licenses(spark, docs):
    templates = {k: [t[k] for t in (licenses.TEMPLATES, licenses.TEXTS) if k in t] for k in [*licenses.TEMPLATES, *licenses.TEXTS]}
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op4_licenses"](spark, SF).collect()}
    short = [(i, t) for i, t in docs if len(t or "") < 5_000]
    assert len(short) > 150
    for i, t in short:
        found = brute_licenses(t, templates)
        assert got[i] == (len(found), ",".join(sorted({k for k, _ in found})), max([d for _, d in found], default=0.0))
    assert sum(n for n, _, _ in got.values()) > 0


def print_of(text, shingle, lanes):
    """A fingerprint bit by bit; the lanes as the operator mixes them."""
    w = split(text)
    if not w:
        return (0,) * lanes
    pieces = [" ".join(w[k : k + shingle]).encode() for k in range(max(1, len(w) - shingle + 1))]
    h = simhash._hashes(pieces, lanes)
    assert [int(x) for x in h[:, 0]] == [xxhash.xxh64_intdigest(x, seed=42) for x in pieces]
    return tuple(sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[:, k]) > len(pieces)) for k in range(lanes))


def groups(ids, prints, radius):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if sum((x ^ y).bit_count() for x, y in zip(prints[a], prints[b])) <= radius:
                p, q = sorted((find(a), find(b)), key=lambda k: ids[k])
                root[q] = p
    return {i: ids[find(k)] for k, i in enumerate(ids)}


def test_simhash(spark, docs):
    ids, prints = [i for i, _ in docs], [print_of(t, 3, 1) for _, t in docs]
    expected = groups(ids, prints, 3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op5_simhash"](spark, SF).collect()}
    assert got == {i: (f"{p[0]:016x}", expected[i]) for i, p in zip(ids, prints)}


def test_simhash_tiles(spark):
    """Many small tiles give the components that all pairs give; a chain joins what is far apart."""
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    chain = [rows[0]]
    for f in flips[:40]:
        chain.append(chain[-1] ^ f)
    values = sorted({int(x) for x in [*rows, *(rows ^ flips), *chain]})
    table = spark.createDataFrame([(x.to_bytes(8, "little"), x.bit_count()) for x in values], "fp binary, pop int")
    from flowgauge.llm.components import connected_components

    links = simhash.near_links(table, 3, tile_size=32)
    found = {bytes(r["node"]): bytes(r["root"]) for r in connected_components(links).collect()}
    expected = groups(list(range(len(values))), [(x,) for x in values], 3)
    label = [found.get(x.to_bytes(8, "little"), x.to_bytes(8, "little")) for x in values]
    for a in range(len(values)):
        for b in range(a):
            assert (label[a] == label[b]) == (expected[a] == expected[b])


def test_bpe(spark, docs):
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op7_bpe"](spark, SF).collect()}
    for i, t in docs:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        assert got[i] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_bpe_of_odd_words():
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.Coder(ranks, *bpe.merge_table(ranks), P.PATTERN)
    rng = np.random.default_rng(3)
    texts = ["x" * 5000, "ab" * 400 + "aab" * 300, "=-" * 900, "é" * 700, "日本語 です  x", "it's \t\n  a  b\n c ", " ", "a ", "\x85a\x1c b", "🙂" * 300]
    texts += ["".join(rng.choice(list("etaoinsh"), 2000)), "".join(map(chr, rng.integers(32, 0x3000, 3000)))]
    for t, packed in zip(texts, coder.encode(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == enc.encode_ordinary(t)
    assert [x.decode() for x in coder.decode(coder.encode(texts))] == texts


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op10_quality"](spark, sf).toPandas()
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    both = got[got.held_out].merge(labels, on="doc_id")
    good, bad = (both[both.quality == q].score.to_numpy() for q in (1, 0))
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (good[:, None] > bad[None]).mean() > 0.95 and (good >= 0.3).mean() > 0.97


def test_top_k_of_clusters():
    """Points that a tree can prune, with copies and ties, against all pairs."""
    from flowgauge.llm.topk import dual_tree_top_k

    rng = np.random.default_rng(5)
    centers = rng.integers(-200, 200, (20, 8))
    v = (centers[rng.integers(0, 20, 3000)] + rng.integers(-3, 4, (3000, 8))).astype(float)
    v[:900] = v[0]
    ids, q = rng.permutation(3000), np.arange(0, 3000, 40)
    scores, found, scored = dual_tree_top_k(ids[q], v[q], ids, v, 5)
    assert scored < 0.35 * len(q) * len(v)
    for k, row in enumerate(q):
        expected = sorted((-int(v[row] @ v[j]), int(ids[j])) for j in range(3000) if j != row)[:5]
        assert [(-int(s), int(i)) for s, i in zip(scores[k], found[k])] == expected
    # known kth scores prune more and lose nothing that reaches them
    again, same, fewer = dual_tree_top_k(ids[q], v[q], ids, v, 5, floor=scores[:, -1])
    assert fewer < scored and (again == scores).all() and (same == found).all()


def test_top_k_of_the_table_prunes():
    from flowgauge.llm.topk import dual_tree_top_k

    table = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    v, ids = np.floor(256 * np.stack(table.embedding.to_numpy()).astype(float)), table.vec_id.to_numpy()
    q = ids % 50 == 0
    scores, found, scored = dual_tree_top_k(ids[q], v[q], ids, v, 5)
    assert scored < 0.6 * q.sum() * len(v)
    for row, s, i in zip(np.nonzero(q)[0], scores, found):
        expected = sorted((-int(v[row] @ v[j]), int(ids[j])) for j in range(len(v)) if j != row)[:5]
        assert [(-int(x), int(y)) for x, y in zip(s, i)] == expected


def test_pipeline(spark, docs):
    """Each stage by brute force: scores one by one, all pairs of fingerprints, all windows, the tokenizer's library."""
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    w = quality.train_quality(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    kept = []
    for i, t in docs:
        slots, values = quality.features(t, 18)
        if 1 / (1 + math.exp(-max(-35, min(35, w[slots] @ values + w[-1])))) >= 0.3:
            kept.append((i, t))
    # the contract's rule: five-word shingles at a Jaccard similarity of 0.8 or more, all pairs
    stay = kept_by_all_pairs(kept)
    kept = [(i, t) for i, t in kept if i in stay]
    benchmark = pd.read_parquet(f"{SF}/benchmark.parquet")
    runs = {run for t in benchmark.text for run in decontam.item_windows(decontam.item_words(t), 13)}
    sizes = {len(r) for r in runs}
    clean = []
    for i, t in kept:
        words = decontam.item_words(t)
        hit = {k for n in sizes for p in range(len(words) - n + 1) if tuple(words[p : p + n]) in runs for k in range(p, p + n)}
        if not (hit and 20 * len(hit) >= len(words)):
            clean.append((i, t))
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert set(got) == {i for i, _ in clean} and len(clean) < len(docs)
    for i, t in clean:
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == enc.encode_ordinary(t or "") and got[i]["exact"]
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "byte_bpe"]
