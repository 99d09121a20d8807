"""Language-model scores: a weighted backoff automaton over smoothed n-grams.

Contexts of training n-grams are states; a state has an arc for each word that
followed it and a failure arc to the context without its oldest word. Weights
are log-probabilities of interpolated absolute discounting, so that a failure
arc's weight is exact. A text is scored by one traversal from left to right.

The automaton of a corpus outgrows any one machine. Texts are packed into
blocks; each block sends its distinct n-grams once, bucketed by hash, receives
their corpus totals, and so builds just the part of the automaton that its own
texts can reach. Nothing is broadcast but a few totals for each order.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import words, written

#: Tasks of a shuffle at most, however large the corpus.
MOST_TASKS = 20_000
#: No word has white space: these stand for the start of a text, which is a context only, and its end, a token.
START, END = b" ", b"\n"
BLOCKS = "block long, doc_id array<long>, train array<boolean>, sizes array<int>, words binary, tokens binary"
SENT = "order int, bucket int, block long, n long, keys binary, counts binary, kinds binary"
BACK = "order int, bucket int, block long, counts binary, kinds binary, n1 long, n2 long, kept long, total long"
RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _pack(a: np.ndarray) -> bytes:
    """Numbers with their bytes sorted by place, compressed: high bytes are mostly zero."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(data.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def encode_blocks(docs: DataFrame, train: Column, block_tokens: int) -> DataFrame:
    """Texts as word numbers, about ``block_tokens`` tokens a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {START: 0, END: 1}
        ids, learns, sizes, parts, held = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
            row = {
                "block": [uuid4().int >> 65],
                "doc_id": [ids],
                "train": [learns],
                "sizes": [sizes],
                "words": [hashes.tobytes()],
                "tokens": [_pack(np.concatenate(parts))],
            }
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds)], names=list(row))

        for b in (whole.slice(k, 1000) for whole in batches for k in range(0, whole.num_rows, 1000)):
            for doc_id, text, learn in zip(*(b.column(k).to_pylist() for k in range(3))):
                w = words(text)
                parts.append(np.fromiter((numbers.setdefault(x, len(numbers)) for x in w), np.uint32, len(w)))
                parts.append(np.array([1], np.uint32))
                ids.append(doc_id)
                learns.append(learn)
                sizes.append(len(w) + 1)
                held += len(w) + 1
                if held >= block_tokens:
                    yield block()
                    numbers = {START: 0, END: 1}
                    ids, learns, sizes, parts, held = [], [], [], [], 0
        if ids:
            yield block()

    columns = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    return docs.select(*columns, F.coalesce(train, F.lit(True)).alias("train")).mapInArrow(run, BLOCKS)


class Block:
    """A block's n-grams: for each order its distinct hashes and, for each token, which of them ends there."""

    def __init__(self, row, order: int):
        self.sizes = np.asarray(row.sizes, np.int64)
        self.train = np.repeat(np.asarray(row.train, bool), self.sizes)
        hashes = np.frombuffer(row.words, np.uint64)
        tokens = _unpack(row.tokens, "<u4")
        self.first = np.cumsum(self.sizes) - self.sizes
        place = np.arange(len(tokens)) - np.repeat(self.first, self.sizes)
        word = hashes[tokens]
        gram, context = word, None
        #: of each order: distinct hashes, number of the n-gram that ends at a token (-1: none), a token where each ends
        self.keys, self.ends, self.at, self.contexts, self.context_at = {}, {}, {}, {}, {}
        for k in range(1, order + 1):
            if k > 1:
                # an n-gram's hash mixes its context's, the shorter n-gram that ended a token before, with its word's
                before = np.concatenate([gram[:1], gram[:-1]])
                context = np.where(place == k - 2, self._start(hashes, word, self.first, k, place), before)
                gram = self._mix(context, word)
            there = place >= k - 2
            keys, at, inverse = np.unique(gram[there], return_index=True, return_inverse=True)
            ends = np.full(len(tokens), -1, np.int32)
            ends[there] = inverse
            self.keys[k], self.ends[k], self.at[k] = keys, ends, np.nonzero(there)[0][at]
            if k > 1:
                self.contexts[k], of_gram = np.unique(context[self.at[k]], return_inverse=True)
                self.context_at[k] = of_gram  # of each distinct n-gram

    @staticmethod
    def _mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
        x = context * np.uint64(0x9E3779B97F4A7C15) + word
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def _start(self, hashes, word, first, k, place) -> np.ndarray:
        """For tokens at place k - 2: the context that begins with the start of the text."""
        c = np.full(len(word), hashes[0])
        for back in range(k - 2, 0, -1):
            c = self._mix(c, np.concatenate([word[:back], word[:-back]]) if back < len(word) else word)
        return c

    def counts(self, k: int) -> np.ndarray:
        """Training occurrences of each distinct n-gram of the block."""
        use = self.ends[k][self.train & (self.ends[k] >= 0)]
        return np.bincount(use, minlength=len(self.keys[k]))


def _send(
    order: int, block: int, first: int, last: int, buckets: int, keys: np.ndarray, counts: np.ndarray, kinds: np.ndarray
) -> Iterator[tuple]:
    """Sorted keys of the buckets ``first`` to ``last`` of ``buckets``, dealt by their high bits, as differences."""
    bounds = [min((1 << 64) - 1, (b * (1 << 64)) // buckets) for b in range(first + 1, last)]
    cuts = [0, *np.searchsorted(keys, np.array(bounds, np.uint64)).tolist(), len(keys)]
    for b, (s, e) in enumerate(zip(cuts, cuts[1:]), first):
        if s < e:
            steps = np.diff(keys[s:e], prepend=np.uint64(0))
            yield order, b, block, e - s, _pack(steps), _pack(counts[s:e].astype("<i8")), _pack(kinds[s:e].astype("<i8"))


class Sums:
    """What several senders sent of one order: the distinct keys with their sums, and which of them each sent."""

    def __init__(self, group: pd.DataFrame, order: int):
        self.senders = list(zip(group["block"], group["n"]))
        keys = np.concatenate([np.cumsum(_unpack(x, "<u8"), dtype=np.uint64) for x in group["keys"]])
        self.keys, self.inverse = np.unique(keys, return_inverse=True)
        del keys
        self.counts = np.concatenate([_unpack(x, "<i8") for x in group["counts"]])
        self.total = np.zeros(len(self.keys), np.int64)
        np.add.at(self.total, self.inverse, self.counts)
        self.kinds = np.zeros(len(self.keys), np.int64)
        if order < 0:  # n-grams are sent without
            np.add.at(self.kinds, self.inverse, np.concatenate([_unpack(x, "<i8") for x in group["kinds"]]))

    def first(self) -> np.ndarray:
        """Marks, of the senders that saw a key in training, the first."""
        seen = np.nonzero(self.counts > 0)[0][::-1]
        first = np.full(len(self.keys), -1)
        first[self.inverse[seen]] = seen
        return first[self.inverse] == np.arange(len(self.inverse))

    def answers(self, order: int, bucket: int, total: np.ndarray, kinds: np.ndarray) -> list[tuple]:
        """A row for each sender: of each key that it sent the total, and its number in ``kinds``."""
        rows, at = [], 0
        for sender, n in self.senders:
            of = slice(at, at + n)
            rows.append((order, bucket, sender, _pack(total[self.inverse[of]]), _pack(kinds[of].astype("<i8")), 0, 0, 0, 0))
            at += n
        return rows


def _back(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in BACK.split(", ")]
    columns = dict(zip(names, map(list, zip(*rows)), strict=True)) if rows else {c: [] for c in names}
    return pd.DataFrame(columns | {"block": pd.array(columns["block"], "Int64")})


def _totals(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Adds up what was sent for a bucket, answers each sender, and sums up the counts in a row without block.

    ``kinds`` come back as sums, too; for n-grams (sent as zeros) as 1 for one
    sender that saw the n-gram in training, which makes distinct n-grams countable.
    """
    order, bucket = int(key[0]), int(key[1])
    sums = Sums(group, order)
    t = sums.total
    rows = sums.answers(order, bucket, t, sums.first() if order > 0 else sums.kinds[sums.inverse])
    return _back([*rows, (order, bucket, None, None, None, int((t == 1).sum()), int((t == 2).sum()), int((t > 0).sum()), int(t.sum()))])


def _merge(within: int, buckets: int):
    """Adds up what the blocks of a unit sent for a wide bucket, and sends it on as the unit's to the buckets within."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        order, wide, unit = (int(k) for k in key)
        sums = Sums(group, order)
        rows = _send(order, unit, wide * within, (wide + 1) * within, buckets, sums.keys, sums.total, sums.kinds)
        return pd.DataFrame(list(rows), columns=[x.split()[0] for x in SENT.split(", ")])

    return run


def _answer(key: tuple, sent: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
    """Hands what a unit was answered on to its blocks; a new n-gram counts for the first that saw it."""
    if not len(sent):
        return _back([])
    order, wide = int(key[0]), int(key[1])
    sums = Sums(sent, order)
    kinds = _received(back, order, "kinds")[sums.inverse]
    return _back(sums.answers(order, wide, _received(back, order, "counts"), (kinds > 0) & sums.first() if order > 0 else kinds))


def _received(back: pd.DataFrame, order: int, column: str) -> np.ndarray:
    """``counts`` or ``kinds`` for all of a block's keys, in key order."""
    mine = back[back["order"] == order].sort_values("bucket")
    return np.concatenate([np.zeros(0, np.int64), *[_unpack(x, "<i8") for x in mine[column]]])


class Automaton:
    """The part of the backoff automaton that a block's texts can reach.

    States of order k - 1 have arcs for the n-grams of order k seen in training;
    ``arcs[k]`` holds the weight of each distinct n-gram, NaN where there is no
    arc, ``fails[k]`` the weight of the failure arc of each n-gram's state.
    """

    def __init__(self, block: Block, order: int, totals: dict, contexts: dict, stats: dict):
        n, v = stats[1]["total"], stats[1]["kept"]
        d = stats[1]["discount"]
        c = totals[1]
        p = (np.maximum(c - d, 0) + d * v / (v + 1)) / n if n else np.full(len(c), 1.0)
        self.order, self.arcs, self.fails = order, {1: np.log10(p)}, {}
        for k in range(2, order + 1):
            d = stats[k]["discount"]
            followed, kinds = contexts[k]
            of = block.context_at[k]
            with np.errstate(divide="ignore", invalid="ignore"):
                weight = np.where(followed > 0, d * kinds / followed, 1.0)
                lower = self._probability(block, k - 1, block.at[k])
                p = np.maximum(totals[k] - d, 0) / followed[of] + weight[of] * lower
                self.arcs[k] = np.where(totals[k] > 0, np.log10(p), np.nan)
                self.fails[k] = np.log10(weight)[of]

    def _probability(self, block: Block, k: int, at: np.ndarray) -> np.ndarray:
        """P of the tokens ``at``, given the k - 1 words before."""
        g = block.ends[k][at]
        arc = self.arcs[k][g]
        if k == 1:
            return 10.0**arc
        return np.where(np.isnan(arc), 10.0 ** self.fails[k][g] * self._probability(block, k - 1, at), 10.0**arc)

    def traverse(self, block: Block) -> list[float]:
        """Each text's log-probability."""
        out = []
        for start, size in zip(block.first.tolist(), block.sizes.tolist()):
            grams = {k: block.ends[k][start : start + size] for k in self.arcs}
            arcs = {k: self.arcs[k][g].tolist() for k, g in grams.items()}
            fails = {k: self.fails[k][grams[k]].tolist() for k in self.fails}
            state, total = 2, 0.0  # arcs of this order leave the state: at first, that of the start of a text
            for i in range(size):
                k = min(state, self.order)
                while (weight := arcs[k][i]) != weight:  # NaN: no arc
                    total += fails[k][i]
                    k -= 1
                total += weight
                state = k + 1
            out.append(total)
        return out


def score_texts(
    docs: DataFrame, train: Column, order: int = 2, block_tokens: int = 1_000_000, bucket_tokens: int = 1_000_000, meeting: int = 2048
) -> DataFrame:
    """Scores of ``docs(doc_id, text)`` under the model of the rows where ``train`` holds: the columns of ``RESULT``.

    Words lie between ASCII white space, A-Z lowered; one end follows each text
    and counts as a token; the first word's context is the start of the text.
    ``score`` is the log10 probability of the whole text under interpolated
    absolute discounting up to ``order`` words; a word unknown to training is
    one further event beside the V known ones. ``base_score`` is that of
    add-one-smoothed words. Each order's discount is n1 / (n1 + 2 n2) over all
    its n-grams, held between 0.1 and 0.9.

    Null and empty texts are one end. Repeated rows are learned and scored each.
    A null ``train`` counts as true. Without training rows all probabilities of
    words are 1. Other columns are not read. n-grams meet by a 64-bit hash.
    ``block_tokens`` bounds a task's memory (a longer text makes a block of its
    own), and so does ``bucket_tokens``: n-grams of an order are counted in a
    bucket for each so many tokens of the corpus. ``meeting`` bounds the blocks
    that send to one place: of more, units of so many add up what they have
    first, so that messages don't shrink as the corpus grows.
    """
    spark = docs.sparkSession
    blocks = written(encode_blocks(docs, train, block_tokens), "blocks")
    held = blocks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n)), F.lit(0)).alias("tokens")).first()
    # what a bucket holds does not grow with the corpus, their number does; a task takes one after another
    buckets = max(spark.sparkContext.defaultParallelism, -(-held["tokens"] // bucket_tokens))
    tasks = min(MOST_TASKS, max(spark.sparkContext.defaultParallelism, held["n"] // 2))
    units = -(-held["n"] // meeting)
    if units > 1:  # blocks send to few wide buckets, units of blocks to all
        wide = max(1, min(buckets, meeting * block_tokens // bucket_tokens))
        within = -(-buckets // wide)
        buckets = wide * within
    else:
        wide, within = buckets, 1
    sent_names, orders = [x.split()[0] for x in SENT.split(", ")], range(1, order + 1)

    def send_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                b = Block(row, order)
                for k in orders:
                    counts = b.counts(k)
                    rows = list(_send(k, row.block, 0, wide, wide, b.keys[k], counts, np.zeros(len(counts), np.int64)))
                    yield pd.DataFrame(rows, columns=sent_names)

    def send_contexts(key: tuple, mine: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        for row in mine.itertuples(index=False):
            b = Block(row, order)
            for k in orders[1:]:
                of, n = b.context_at[k], len(b.contexts[k])
                followed = np.bincount(of, b.counts(k), n).astype(np.int64)
                kinds = np.bincount(of, _received(back, k, "kinds"), n).astype(np.int64)
                rows += _send(-k, row.block, 0, wide, wide, b.contexts[k], followed, kinds)
        return pd.DataFrame(rows, columns=sent_names)

    def count(sent: DataFrame) -> DataFrame:
        return sent.repartition(min(MOST_TASKS, buckets), "order", "bucket").groupBy("order", "bucket").applyInPandas(_totals, BACK)

    def exchange(sent: DataFrame) -> DataFrame:
        if units <= 1:
            return written(count(sent), "totals")
        sent = written(sent.withColumn("unit", F.pmod(F.xxhash64("block"), F.lit(units))), "sent")
        by_unit = lambda table, bucket: table.repartition(min(MOST_TASKS, wide * units), "order", bucket, "unit").groupBy("order", bucket, "unit")
        totals = written(count(by_unit(sent, "bucket").applyInPandas(_merge(within, buckets), SENT)), "totals")
        told = totals.filter("block is not null").withColumn("wide", F.floor(F.col("bucket") / within).cast("int")).withColumnRenamed("block", "unit")
        answers = by_unit(sent, "bucket").cogroup(by_unit(told, "wide")).applyInPandas(_answer, BACK)
        return written(answers.unionByName(totals.filter("block is null")), "answers")

    by_block = lambda table: table.repartition(tasks, "block").groupBy("block")
    grams = exchange(blocks.mapInPandas(send_grams, SENT))
    sums = grams.filter("block is null").groupBy("order").agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "kept", "total")])
    stats = {k: {"n1": 0, "n2": 0, "kept": 0, "total": 0} for k in orders} | {r["order"]: r.asDict() for r in sums.collect()}
    for s in stats.values():
        s["discount"] = min(0.9, max(0.1, s["n1"] / (s["n1"] + 2 * s["n2"]))) if s["n1"] + s["n2"] else 0.5
    grams = grams.filter("block is not null").select("order", "block", "bucket", "counts", "kinds")
    # each way carries what it needs: first which n-grams are new, then their totals
    back = grams.withColumn("kinds", F.lit(None).cast("binary"))
    if order > 1:
        new = grams.filter("order > 1").select("order", "block", "bucket", "kinds")
        contexts = by_block(blocks).cogroup(by_block(new)).applyInPandas(send_contexts, SENT)
        back = back.union(exchange(contexts).filter("block is not null").select(*grams.columns))

    def score(key: tuple, mine: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in mine.itertuples(index=False):
            b = Block(row, order)
            totals = {k: _received(back, k, "counts") for k in orders}
            followed = {k: (_received(back, -k, "counts"), _received(back, -k, "kinds")) for k in orders[1:]}
            automaton = Automaton(b, order, totals, followed, stats)
            n, v = stats[1]["total"], stats[1]["kept"]
            c = totals[1][b.ends[1]]
            base = np.add.reduceat(np.log10((c + 1) / (n + v + 1)), b.first)
            known = np.add.reduceat((c > 0).astype(np.int64), b.first)
            frame = pd.DataFrame({"doc_id": pd.array([None if x is None or x != x else int(x) for x in row.doc_id], "Int64")})
            frame["held_out"] = ~np.asarray(row.train, bool)
            frame["n_tokens"], frame["n_known"], frame["train_tokens"] = b.sizes, known, n
            frame["base_score"], frame["score"] = base, automaton.traverse(b)
            out.append(frame)
        names = [x.split()[0] for x in RESULT.split(", ")]
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in names})

    return by_block(blocks).cogroup(by_block(back)).applyInPandas(score, RESULT)
