"""Long words against the tokenizer's own library."""

import base64
import os
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from flowgauge.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(coder, text):
    return np.frombuffer(coder.encode([text])[0], "<u4").tolist()


def test_words_of_a_hundred_thousand_characters(ranks, library, tmp_path, monkeypatch):
    """In a folder that can't be written to, with no folder to spill to."""
    monkeypatch.chdir(tmp_path)
    os.chmod(tmp_path, 0o500)
    rng = np.random.default_rng(0)
    coder = bpe.Coder(ranks, *bpe.merge_table(ranks), P.PATTERN)
    texts = [
        rng.integers(97, 123, 100_000).astype(np.uint8).tobytes().decode(),
        "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 100_000))),
        base64.b64encode(rng.bytes(75_000)).decode(),
        "x" * 100_000,
        "ab" * 9_000 + "aab" * 4_000,
    ]
    for t in texts:
        assert ids(coder, t) == library.encode_ordinary(t)
    assert coder.db.execute("select current_setting('temp_directory')").fetchall()[0][0] in ("", None)
    assert not list(tmp_path.iterdir())


def test_many_words_of_all_lengths(ranks, library):
    """Letters, Thai, Chinese and base64 without spaces: words around and beyond the border between the queries, many at once."""
    rng = np.random.default_rng(7)
    letters = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    drawn = lambda low, high, n: "".join(map(chr, rng.integers(low, high, n)))
    texts = [letters(n) for n in (*range(bpe.SHORT - 3, bpe.SHORT + 4), 1000, 1500, 2500, *rng.integers(1, 700, 150))]
    texts += [drawn(0xE01, 0xE3A, n) for n in rng.integers(20, 400, 60)] + [drawn(0x4E00, 0x5200, n) for n in rng.integers(20, 400, 60)]
    texts += [base64.b64encode(rng.bytes(n)).decode() for n in rng.integers(20, 2000, 40)] + ["q" * 600, "q" * 601, "qr" * 700]
    coder = bpe.Coder(ranks, *bpe.merge_table(ranks), P.PATTERN)
    for got, text in zip(coder.encode(texts), texts):
        assert np.frombuffer(got, "<u4").tolist() == library.encode_ordinary(text)
    assert coder.decode(coder.encode(texts)) == [t.encode() for t in texts]


def test_time_and_memory_of_many_middling_words(ranks, library):
    """No cliff between the queries, and no query holds the rounds of all words at once."""
    rng = np.random.default_rng(3)

    def seconds(n, size):
        texts = [rng.integers(97, 123, size).astype(np.uint8).tobytes().decode() for _ in range(n)]
        coder = bpe.Coder(ranks, *bpe.merge_table(ranks), P.PATTERN)
        start = time.perf_counter()
        coder.encode(texts)
        return time.perf_counter() - start

    seconds(5, 50)
    assert seconds(200, 300) < 2 * seconds(200, 250) + 0.2
    assert seconds(200, 540) < 2 * seconds(200, 500) + 0.4
    seconds(6000, 120)  # 80 million rows of all rounds, far beyond the connection's memory


def test_any_word_by_the_query_for_long_ones(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "SHORT", 0)
    coder = bpe.Coder(ranks, *bpe.merge_table(ranks), P.PATTERN)
    rng = np.random.default_rng(4)
    for alphabet in ("ab", "xy", "xxxxxy", "aeinrst", "the and", "=-", "0123456789", "éa", "lo"):
        for size in (2, 3, 17, 300, 1500):
            word = "".join(rng.choice(list(alphabet), size)).replace(" ", "")
            if word:
                assert ids(coder, word) == library.encode_ordinary(word)


def test_a_vocabulary_whose_merged_pieces_rank_before_their_parts(monkeypatch):
    """Ranks at random, so that a contraction often makes a pair of a smaller rank: against pair after pair."""
    rng = np.random.default_rng(9)
    pieces = sorted({"".join(rng.choice(list("abc"), n)) for n in (2, 2, 3, 3, 4, 5, 6) for _ in range(9)})
    order = rng.permutation(len(pieces))
    ranks = {bytes([b]): b for b in range(256)} | {pieces[k].encode(): 256 + i for i, k in enumerate(order)}

    def one_by_one(word):
        toks = [word[k : k + 1] for k in range(len(word))]
        while True:
            best = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(toks, toks[1:])) if a + b in ranks), default=None)
            if best is None:
                return [ranks[t] for t in toks]
            k = best[1]
            toks[k : k + 2] = [toks[k] + toks[k + 1]]

    words = ["".join(rng.choice(list("abc"), n)) for n in (3, 9, 40, 200, 400, 400)] + ["abab" * 60, "a" * 200]
    for short in (0, 1000):
        monkeypatch.setattr(bpe, "SHORT", short)
        coder = bpe.Coder(ranks, *bpe.merge_table(ranks), r"\S+")
        for w in words:
            assert ids(coder, w) == one_by_one(w.encode()), (short, w)
