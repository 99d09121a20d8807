"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from flowgauge.llm import bpe, chat, decontam, licenses, lm, quality, simhash, token_counts, topk, warc

LONG = "lorem ipsum dolor " * 30_000
DOCS = [(1, "a b c d e f"), (2, None), (3, ""), (4, "a b c d e f"), (4, "a b c d e f"), (None, "x y"), (5, LONG), (6, " \n\t ")]
CLASH = "doc_id long, text string, score string, fp int, component_id string, n_hit int, licenses string, ids2 int, root int, label int, at string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s", 1, "c", 2, "l", 3, 4, 5, "z") for i, t in DOCS]
    return spark.createDataFrame(rows, CLASH)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_simhash(docs, none):
    got = {(r["doc_id"], r["fp"].hex()): r["component_id"] for r in simhash.simhash_components(docs).collect()}
    zero = "00" * 8
    assert simhash.simhash_components(docs).count() == len(DOCS)
    assert got[(2, zero)] == got[(3, zero)] == got[(6, zero)] == 2
    assert got[(4, simhash.fingerprint("a b c d e f").hex())] == 1
    assert got[(None, simhash.fingerprint("x y").hex())] is None
    assert simhash.simhash_components(none).count() == 0


def test_near_dedup(docs, none):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 2, 5]
    assert simhash.drop_near_duplicates(none).count() == 0


def test_near_dedup_keeps_one_of_repeated_rows_and_null_ids(spark):
    rows = [(7, "p q r s t u"), (7, "p q r s t u"), (None, "only nulls here"), (None, "only nulls here"), (None, "others")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == [(-1, "only nulls here"), (-1, "others"), (7, "p q r s t u")]


def test_lm(docs, none):
    got = lm.score_texts(docs, F.col("doc_id") != 5).collect()
    assert len(got) == len(DOCS)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_tokens"] == by[6]["n_tokens"] == 1 and by[5]["n_tokens"] == 90_001
    assert by[5]["held_out"] and by[5]["n_known"] == 1 and by[5]["score"] < 0
    assert not by[None]["held_out"]
    assert lm.score_texts(none, F.lit(True)).count() == 0
    assert {r["score"] for r in lm.score_texts(docs.filter("doc_id = 1"), F.lit(False)).collect()} == {0.0}


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (None, 1), (5, None), (3, 0)], "doc_id long, quality int")
    weights = quality.train_quality(docs, labels, folds=7)
    scores = [r[0] for r in docs.select(quality.quality_score(F.col("text"), weights)).collect()]
    assert len(scores) == len(DOCS) and all(0 <= s <= 1 for s in scores)
    assert scores[1] == scores[2] == scores[7]
    blank = quality.train_quality(docs, labels.limit(0))
    assert {r[0] for r in docs.select(quality.quality_score("text", blank)).collect()} == {0.5}
    assert quality.keep_quality(docs, labels.limit(0)).columns == docs.columns
    assert quality.keep_quality(none, labels).count() == 0


def test_decontaminate(docs, none, spark):
    items = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "x y"), (4, "lorem ipsum dolor")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for most in (0, 5, 1_000_000):  # one window too many for 0, all of them within the others
        found = decontam.annotate_contamination(docs, benchmark, max_broadcast_windows=most)
        got = sorted((str(r["doc_id"]), r["_contamination"].asDict(True)) for r in found.collect())
        by = dict(got)
        assert by["1"] == {"n_words": 6, "n_hit": 3, "items": [1], "spans": [{"start": 0, "end": 3}]}
        assert by["2"] == {"n_words": 0, "n_hit": 0, "items": [], "spans": []} and by["None"]["n_hit"] == 0
        assert by["5"]["n_hit"] == 90_000 and by["5"]["items"] == [4]
    assert sorted(r["doc_id"] or -1 for r in decontam.decontaminate(docs, benchmark).collect()) == [-1, 2, 3, 6]
    cut = decontam.decontaminate(docs, benchmark, action="spans")
    assert cut.columns == docs.columns and {r["text"] for r in cut.filter("doc_id in (1, 4)").collect()} == {" d e f"}
    assert decontam.decontaminate(none, benchmark).count() == 0
    for taken, most in (("_contamination", 9), ("_row", 0), ("_at", 0)):
        with pytest.raises(ValueError):
            decontam.annotate_contamination(docs.withColumn(taken, F.lit(1)), benchmark, max_broadcast_windows=most)
    assert decontam.decontaminate(docs, benchmark.limit(0)).count() == len(DOCS)


def test_bpe(docs, none):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    coded = bpe.bpe_decode(bpe.bpe_encode(docs, path, P.PATTERN), path)
    assert coded.columns == [*docs.columns, "ids", "decoded"]
    assert all((r["text"] or "").encode() == bytes(r["decoded"]) for r in coded.collect())
    assert bpe.bpe_encode(none, path, P.PATTERN).count() == 0
    for call in (lambda: bpe.bpe_encode(docs, path, P.PATTERN, out="LICENSES"), lambda: bpe.bpe_encode(docs, path, P.PATTERN, decoded="at"), lambda: bpe.bpe_decode(coded, path)):
        with pytest.raises(ValueError):
            call()


def test_token_counts(docs, none):
    import public_tokenizers as P

    scores = token_counts.zipf_scores(P.path("byte_bpe_50k.tiktoken"))
    got = [(r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(docs, scores, P.PATTERN).collect()]
    assert len(got) == len(DOCS) and dict(got)[2] == dict(got)[3] == 0 and dict(got)[5] >= 90_000
    assert token_counts.count_tokens(none, scores, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, {b"a": 0.0}, P.PATTERN)
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, scores, P.PATTERN, out="at")
    long = docs.sparkSession.createDataFrame([("ab" * 50_000,)], "text string")  # one pre-token
    assert 0 < token_counts.count_tokens(long, scores, P.PATTERN).first()["n_tokens"] <= 50_000


def test_licenses(docs, none, spark):
    more = docs.union(docs.filter("doc_id = 1").withColumn("text", F.lit("Hello.\nreleased under the mit licence\nBye")))
    got = licenses.scan_licenses(more, {"MIT": licenses.TEMPLATES["MIT"], "none": ""}, 0.6)
    assert got.columns == docs.columns
    assert [x["license"] for r in got.collect() for x in r["licenses"]] == ["MIT"]
    assert licenses.scan_licenses(none).count() == 0


def test_warc(spark):
    same = "y" * 200
    rows = [(3, "u/3", same), (1, "u/1 é%", same), (2, None, None), (4, "", "short"), (5, "x", "short"), (6, "z", "ü" * 500_000), (1, "u/1 é%", same), (None, "n", same)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, payload string, digest int")
    manifest = warc.write_warc(pages, archive_size=100_000)
    back = warc.read_warc(manifest).collect()
    assert len(back) == len(rows)
    by = {r["page_id"]: r for r in back}
    assert by[3]["record_type"] == "revisit" and by[3]["refers_to"] == 1 and by[3]["payload_bytes"] == 200
    assert by[3]["payload_digest"] == hashlib.sha256(same.encode()).hexdigest()
    assert by[1]["record_type"] == "response" and by[1]["url"] == "u/1 é%" and by[2]["payload_bytes"] == 0 and by[2]["url"] is None
    assert by[4]["record_type"] == by[5]["record_type"] == "response" and by[None]["refers_to"] == 1
    assert bytes(by[6]["payload"]).decode() == "ü" * 500_000
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


def test_archive_layout():
    import io
    import struct

    import zstandard

    records = [warc.record_bytes(i, f"http://h/{i}", f"<p>page {i} of many similar pages</p>".encode() * 9, "0" * 64, None) for i in range(300)]
    data, size = warc.archive_bytes(records, 3, 4096, 1 << 20)
    assert struct.unpack("<II", data[:8]) == (0x184D2A5D, size) and data[8:12] == b"\x37\xa4\x30\xec"
    assert list(warc.read_archive(io.BytesIO(data))) == records
    # any record can be read by itself, with the dictionary
    frame = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj()
    assert frame.decompress(data[8 + size :]) == records[0]
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data[:-3])))


def test_chat(spark):
    rows = [(1, 0, "user", "hi <|im_end|> \\ <\\| \n"), (1, 1, "assistant", "é😀<|"), (1, 1, "assistant", "é😀<|"), (1, None, None, None), (2, 0, "a\nb", ""), (None, 0, "assistant", "x")]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, start int")
    chats = chat.format_chat(table.withColumn("parts", chat.text_parts(F.col("text"))))
    got = {
        r["conv_id"]: r
        for r in chats.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("l")).collect()
    }
    assert [tuple(t) for t in got[1]["t"]] == [("", ""), ("user", rows[0][3]), ("assistant", "é😀<|"), ("assistant", "é😀<|")]
    assert got[1]["l"] == "é😀<|é😀<|" and got[None]["l"] == "x" and [tuple(t) for t in got[2]["t"]] == [("a\nb", "")]
    assert chat.format_chat(table.limit(0).withColumn("parts", chat.text_parts(F.col("text")))).count() == 0


def test_chat_parts(spark):
    parts = [
        {"type": "text", "text": "see <|"},
        {"type": "image", "ref": "s3/cat.png", "width": 1024, "height": 513},
        {"type": "audio", "ref": "a.wav", "seconds": 2.1},
        {"type": "document", "ref": "d.pdf", "pages": 3},
        None,
        {"type": "other", "text": None},
        {"type": "image", "ref": None},
    ]
    full = [None if p is None else {k: p.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")} for p in parts]
    turns = spark.createDataFrame([(1, 0, "user", full), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.format_chat(turns).first()
    assert r["formatted"] == "<|im_start|>user\nsee <\\|<|image:1|><|audio:2|><|document:3|><|image:4|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [tuple(a) for a in r["attachments"]] == [
        (1, 1, "image", "s3/cat.png", 85 + 170 * 4),
        (1, 2, "audio", "a.wav", 53),
        (1, 3, "document", "d.pdf", 1500),
        (1, 4, "image", None, 255),
    ]
    assert r["expanded_tokens"] == sum(a["tokens"] for a in r["attachments"])
    assert [(m["start"], m["length"]) for m in r["loss_mask"]] == [(len(r["formatted"]) - len("<|im_end|>\n"), 0)]


def test_top_k(spark):
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (None, [9.0, 9.0]),
        (6, [1.0, 2.0, 3.0]), (7, [-1.0, 0.0]), (8, []),
    ]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, rank string, score int")
    got = sorted(tuple(r) for r in topk.top_k(table.filter("vec_id in (0, 1)"), table, k=2).collect())
    # both rows with the id 0 are candidates of the query 1, none of them of the query 0; both ask, and their results are ranked together
    assert got == [(0, 1, 1, 32768), (0, 2, 1, 32768), (1, 1, 0, 32768), (1, 2, 0, 32768)]
    blocks = sorted(tuple(r) for r in topk.top_k(table.filter("vec_id in (0, 1)"), table, k=2, block_rows=1, query_rows=1).collect())
    assert blocks == got
    assert topk.top_k(table.limit(0), table).count() == 0 and topk.top_k(table, table.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e15, 1.0]), (1, [1e15, 3.0]), (2, [1e15, 2.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in topk.top_k(huge.filter("vec_id = 0"), huge, k=2).orderBy("rank").collect()] == [1, 2]


@pytest.mark.parametrize("bits", [4, 10, 20])
def test_join_equals_broadcast_for_any_filter(spark, bits):
    """However much the filter lets through: a window that is everywhere, short items, shared windows, repeats inside a text."""
    said = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    items = spark.createDataFrame([(1, said), (2, said), (3, "tiny item"), (4, " ".join(f"w{k}" for k in range(60))), (5, ""), (None, said)], "item_id long, text string")
    texts = [said, f"{said} {said}", "x " + said.replace("fox", "cat"), "a tiny item in a tiny item", "w3 " * 40, " ".join(f"w{k}" for k in range(5, 40)), None, "", "dog " * 500]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 5)], "doc_id long, text string").repartition(3)
    packed = decontam.pack_items(items.filter("item_id is not null"), 13)
    rows = lambda df: sorted((r["doc_id"], r["_contamination"]) for r in df.collect())
    want = rows(decontam.annotate_by_broadcast(docs, packed))
    assert rows(decontam.annotate_by_join(docs, packed, bits)) == want and any(c["n_hit"] for _, c in want)
    assert len(decontam.window_filter(packed, bits)) == max(1, 2**bits // 8)
    assert decontam.annotate_by_join(docs, packed.limit(0), bits).filter("_contamination.n_hit > 0").count() == 0


def test_chat_of_very_long_texts_and_many_turns(spark):
    """A text of several megabytes, and a conversation of thousands of turns: read back as they were."""
    long = "words <|im_end|> \\ and more " * 150_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)] + [(2, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(5000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    chats = chat.format_chat(turns.drop("text"))
    got = {r["conv_id"]: r for r in chats.select("conv_id", chat.read_turns("formatted").alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    assert [t["text"] for t in got[1]["turns"]] == [long, long] and got[1]["loss"] == long
    assert [t["text"] for t in got[2]["turns"]] == [f"turn {k}" for k in range(5000)]
    assert got[2]["loss"] == "".join(f"turn {k}" for k in range(0, 5000, 2))


def test_pipeline_on_empty_tables_and_taken_names(spark, tmp_path):
    import corpus_pipeline

    schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    documents = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents, str(tmp_path)).columns == documents.columns, name
    for name, taken in (("near_dedup", "_near_fp"), ("decontamination", "_contamination")):
        with pytest.raises(ValueError, match=taken):
            dict(corpus_pipeline.STAGES)[name](spark, documents.withColumn(taken, F.lit(1)), str(tmp_path))
