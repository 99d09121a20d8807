"""Benchmark decontamination: windows of test items looked up in training texts.

The windows of all items become a hash set that is broadcast: sorted 64-bit
hashes with the place of each window in the items' packed words. It is made in
tasks, and sent while it has no more than a stated number of windows. Beyond that
a Bloom filter of their hashes, of fixed size, is sent in its place, and what
passes it is joined with the windows. Either way a hash hit is verified word by
word before it counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import LOWER, new_names, written

#: Words are runs of a-z, 0-9 and anything beyond ASCII, after lowering A-Z.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RESULT = "n_words long, n_hit long, items array<long>, spans array<struct<start:int,end:int>>"
PACKED = "item_id long, n int, windows long, words binary, hashes binary, places binary"
_PRIME = 0x9E3779B97F4A7C15


def item_words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").translate(LOWER)) if text else []


def item_windows(w: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    """All runs of ``window`` words; a shorter item, but not an empty one, is one window."""
    return [tuple(w[k : k + window]) for k in range(max(1, len(w) - window + 1))] if w else []


def _rolled(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` words, from the words' hashes."""
    out = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for k in range(n if len(out) else 0):
        out = out * np.uint64(_PRIME) + words[k : len(out) + k]
    return out


def _word_hashes(w: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, w, repeat(7)), np.uint64, len(w))


def pack_items(items: DataFrame, window: int) -> DataFrame:
    """``items(item_id, text)`` to schema PACKED: of each item its words, joined, and the hashes and places of its windows.

    A place is (first byte, byte after the last) in the joined words. Items
    without words have no row.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for item_id, text in zip(b["item_id"], b["text"]):
                w = item_words(text)
                if not w:
                    continue
                n = min(window, len(w))
                ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
                starts = np.concatenate([[0], ends[:-1]])[: len(w) - n + 1]
                places = np.stack([starts, ends[n - 1 :] - 1], axis=1)
                rows.append((item_id, n, len(starts), b" ".join(w), _rolled(_word_hashes(w), n).tobytes(), places.astype(np.int32).tobytes()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")])

    return items.mapInPandas(pack, PACKED)


class WindowSet:
    """Windows of one length: distinct sorted hashes, and for each the windows that have it.

    ``places`` holds the windows of hash k at ``bounds[k]:bounds[k + 1]``: where
    their words lie in ``words``, and the item. About 30 bytes a window.
    """

    def __init__(self, n: int, rows: list):
        self.n = n
        self.words = b"\n".join(r["words"] for r in rows)
        sizes = np.array([len(r["words"]) + 1 for r in rows], np.int64)
        counts = np.array([r["windows"] for r in rows], np.int64)
        places = np.concatenate([np.frombuffer(r["places"], np.int32).reshape(-1, 2) for r in rows]).astype(np.int64)
        places += np.repeat(np.cumsum(sizes) - sizes, counts)[:, None]
        hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
        order = np.argsort(hashes, kind="stable")
        self.items = np.repeat(np.array([r["item_id"] for r in rows], np.int64), counts)[order]
        self.places = places[order]
        self.hashes, first = np.unique(hashes[order], return_index=True)
        self.bounds = np.append(first, len(order))
        self.known: dict[int, list[tuple[bytes, frozenset]]] = {}

    def of(self, k: int) -> list[tuple[bytes, frozenset]]:
        """The different windows of hash ``k``: their words and items. Kept once it was asked for."""
        found = self.known.get(k)
        if found is None:
            owners: dict[bytes, set[int]] = {}
            for (s, e), item in zip(self.places[self.bounds[k] : self.bounds[k + 1]].tolist(), self.items[self.bounds[k] : self.bounds[k + 1]].tolist()):
                owners.setdefault(self.words[s:e], set()).add(item)
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[k] = [(text, frozenset(who)) for text, who in owners.items()]
        return found


def scan_windows(w: list[bytes], sets: list[WindowSet]) -> tuple[np.ndarray, set[int]]:
    """Which words lie inside an occurrence of a window, and the items that occur."""
    hit, found = np.zeros(len(w) + 1, np.int64), set()
    words = _word_hashes(w)
    for known in sets:
        n = known.n
        h = _rolled(words, n)
        if not len(h):
            continue
        k = np.minimum(np.searchsorted(known.hashes, h), len(known.hashes) - 1)
        for p in np.nonzero(known.hashes[k] == h)[0].tolist():
            run = b" ".join(w[p : p + n])
            for text, who in known.of(int(k[p])):
                if text == run:
                    hit[p] += 1
                    hit[p + n] -= 1
                    found |= who
    return np.cumsum(hit)[:-1] > 0, found


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as (first word, word after the last)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _row(n_words: int, hit: np.ndarray, found) -> dict:
    return {
        "n_words": n_words,
        "n_hit": int(hit.sum()),
        "items": sorted(found),
        "spans": [{"start": a, "end": b} for a, b in _spans(hit)],
    }


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null and item_id is not null")


def annotate_by_broadcast(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """``docs`` scanned with the windows of ``packed`` (schema PACKED), which the driver puts in order."""
    by_length: dict[int, list] = {}
    for r in packed.collect():
        by_length.setdefault(r["n"], []).append(r)
    held = docs.sparkSession.sparkContext.broadcast([WindowSet(n, by_length[n]) for n in sorted(by_length)])

    @F.pandas_udf(RESULT)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            w = item_words(t)
            rows.append(_row(len(w), *scan_windows(w, held.value)))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])

    return docs.withColumn("_contamination", scan(F.col("text")))


def _bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The two places of each hash in a filter of 2^bits bits."""
    low = np.uint64((1 << bits) - 1)
    return np.concatenate([hashes & low, (hashes >> np.uint64(64 - bits)) & low]).astype(np.int64)


def window_filter(packed: DataFrame, bits: int) -> bytes:
    """A Bloom filter of the hashes of all windows: 2^bits bits, made in tasks by stretches of 2^16 bytes.

    More windows make it let more through; its size stays.
    """
    stretch = 1 << min(bits, 19)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["hashes"]:
                at = np.unique(_bits(np.frombuffer(raw, np.uint64), bits))
                yield pd.DataFrame({"part": (at // stretch).astype(np.int32), "at": (at % stretch).astype(np.int32)})

    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(stretch, np.uint8)
        held[group["at"].to_numpy()] = 1
        return pd.DataFrame([(key[0], np.packbits(held, bitorder="little").tobytes())], columns=["part", "bits"])

    parts = packed.select("hashes").mapInPandas(place, "part int, at int").distinct().groupBy("part").applyInPandas(fill, "part int, bits binary")
    out = bytearray(1 << max(bits - 3, 0))
    size = stretch // 8
    for r in parts.collect():  # the filter itself: 2^bits bits
        out[r["part"] * size : (r["part"] + 1) * size] = r["bits"]
    return bytes(out)


def _each_window(packed: DataFrame) -> DataFrame:
    """``(hash, n, words, who)``: the different windows of all items, with the items that have them."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                at = np.frombuffer(r.places, np.int32).reshape(-1, 2).tolist()
                hashes = np.frombuffer(r.hashes, np.uint64).view(np.int64)
                yield pd.DataFrame({"hash": hashes, "n": r.n, "words": [r.words[x:y] for x, y in at], "item_id": r.item_id})

    rows = packed.mapInPandas(cut, "hash long, n int, words binary, item_id long")
    return rows.groupBy("hash", "n", "words").agg(F.collect_set("item_id").alias("who"))


def annotate_by_join(docs: DataFrame, packed: DataFrame, filter_bits: int = 27) -> DataFrame:
    """As ``annotate_by_broadcast``, for windows that are too many to send: a filter of fixed size is sent instead.

    Runs of words that pass it, the hits and a small share of others, are joined
    with the windows by hash, and count if their words are equal. Column names
    ``_row``, ``_items`` and ``_at`` are reserved.
    """
    new_names(docs, "_row", "_items", "_at")
    lengths = sorted(r["n"] for r in packed.select("n").distinct().collect())  # a row for each length up to the window's
    held = docs.sparkSession.sparkContext.broadcast(window_filter(packed, filter_bits))
    numbered = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")

    def survivors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.frombuffer(held.value, np.uint8)
        for b in batches:
            for row, t in zip(b["_row"], b["text"]):
                w = item_words(t)
                words, places = _word_hashes(w), {}
                for n in lengths:
                    h = _rolled(words, n)
                    if not len(h):
                        continue
                    at = _bits(h, filter_bits)
                    there = (known[at >> 3] >> (at & 7).astype(np.uint8) & 1).reshape(2, -1).all(axis=0)
                    for p in np.flatnonzero(there).tolist():
                        places.setdefault((int(h[p].view(np.int64)), n, b" ".join(w[p : p + n])), []).append(p)
                yield pd.DataFrame([(row, *k, p) for k, p in places.items()], columns=["_row", "hash", "n", "words", "pos"])

    seen = numbered.select("_row", "text").mapInPandas(survivors, "_row long, hash long, n int, words binary, pos array<int>")
    hits = seen.join(written(_each_window(packed), "each-window"), ["hash", "n", "words"])
    found = hits.groupBy("_row").agg(F.array_distinct(F.flatten(F.collect_list("who"))).alias("_items"), F.collect_list(F.struct("pos", "n")).alias("_at"))

    @F.pandas_udf(RESULT)
    def combine(texts: pd.Series, items: pd.Series, at: pd.Series) -> pd.DataFrame:
        rows = []
        for t, who, where in zip(texts, items, at):
            n = len(item_words(t))
            edge = np.zeros(n + 1, np.int64)
            for x in where if where is not None else ():
                p = np.asarray(x["pos"], np.int64)
                np.add.at(edge, p, 1)
                np.add.at(edge, p + x["n"], -1)
            rows.append(_row(n, np.cumsum(edge)[:-1] > 0, [int(x) for x in who] if who is not None else ()))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])

    joined = numbered.join(found, "_row", "left")
    return joined.withColumn("_contamination", combine("text", "_items", "_at")).drop("_row", "_items", "_at")


def annotate_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, max_broadcast_windows: int = 2_000_000) -> DataFrame:
    """``docs`` with ``_contamination(n_words, n_hit, items, spans)``: verified hits of test windows.

    ``items`` are the distinct item_ids with a window in the text, ascending;
    ``spans`` the runs of hit words. Null and empty texts have no words. Items
    with a null id or text, or without words, have no window; repeated items
    count once. An empty benchmark hits nothing. Whole texts are scanned. Up to
    ``max_broadcast_windows`` (some 30 bytes each, beside the items' words) are
    broadcast, more are joined; the rows are the same. The name
    ``_contamination`` is reserved.
    """
    new_names(docs, "_contamination")
    packed = written(pack_items(_items(benchmark).distinct(), window), "windows")
    n = packed.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    return annotate_by_broadcast(docs, packed) if n <= max_broadcast_windows else annotate_by_join(docs, packed)


def contaminated(share: int = 20):
    """Column: some word is hit, and at least one word in ``share``."""
    c = F.col("_contamination")
    return (c["n_hit"] > 0) & (share * c["n_hit"] >= c["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", **options) -> DataFrame:
    """``docs`` without its contamination, all columns kept.

    ``action`` "documents" drops contaminated documents; "spans" cuts hit runs
    out of the text instead, from the first to the last hit word.
    """
    marked = annotate_contamination(docs, benchmark, **options)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if action == "documents":
        return marked.filter(~contaminated()).select(*columns)
    if action != "spans":
        raise ValueError(f"action {action!r}")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, gone in zip(texts, spans):
            if t is None or gone is None or not len(gone):
                out.append(t)
                continue
            raw = t.encode("utf-8", "surrogatepass")
            at = [m.span() for m in WORD.finditer(raw.translate(LOWER))]
            keep, last = [], 0
            for s in gone:
                keep.append(raw[last : at[s["start"]][0]])
                last = at[s["end"] - 1][1]
            out.append(b"".join([*keep, raw[last:]]).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    text = cut(F.col("text"), F.col("_contamination.spans"))
    return marked.withColumn("text", text).select(*columns)
