"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared in square tiles with numpy exclusive-or and bit
counts. Distinct fingerprints are dealt into tiles by their number of set bits;
two tiles whose bit counts lie further apart than the radius are never paired,
and inside a pair of tiles the same test over 16-bit quarters skips blocks.

Near-dedup compares fingerprints only where texts share a shingle of their
prefixes, and takes them as a search for candidates only: a pair is linked once
the Jaccard similarity of its distinct shingles has been counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import new_names, words, written
from flowgauge.llm.components import connected_components

#: Rows and columns of the blocks compared at once inside a pair of tiles.
BLOCK = 512
#: Shingles of the rows that are verified at once on either side of a pair.
SUB_TILE = 1 << 21
#: Candidates' fingerprints are looked up by this many slots first, so that their broadcast is bounded.
SLOTS = 1 << 20
#: Rows of the sample by which shingles are put in order, how many of these hold a frequent one, and frequent ones at most.
SAMPLE_ROWS, FREQUENT, MOST_FREQUENT = 4096, 6, 100_000
#: Texts dealt by their prefixes at once, and texts that a task remembers as dealt.
PREFIX_ROWS, DEALT = 500, 500_000
#: Texts that share a shingle and are compared in one task; of more, all become candidates.
GROUP = 1 << 16
#: Groups of so many texts at most are compared side by side, and pairs compared at once.
SMALL_GROUP, PAIRS = 64, 1 << 20
#: Pairs of tiles that a task compares, while there are fewer than so many tasks.
PAIRS_A_TASK, MOST_TASKS = 4, 20_000


def _hashes(shingles: list[bytes], lanes: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle; further lanes are mixed from it."""
    return _lanes(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(shingles)), lanes)


def _lanes(first: np.ndarray, lanes: int) -> np.ndarray:
    out = [first]
    for lane in range(1, lanes):
        x = first + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out, axis=1)


def fingerprint(text: str | None, shingle: int = 3, lanes: int = 1) -> bytes:
    """The text's fingerprint: ``8 * lanes`` bytes, each lane little-endian.

    Shingles of ``shingle`` words, repeats included; fewer words make one
    shingle, none the zero fingerprint. A bit is set if over half of the
    shingles' hashes have it.
    """
    w = words(text)
    return _majority(_hashes(_shingles(w, shingle), 1)[:, 0], lanes) if w else bytes(8 * lanes)


def _shingles(w: list[bytes], shingle: int) -> list[bytes]:
    whole = b" ".join(w)
    if len(w) <= shingle:
        return [whole]
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(w) - shingle + 1].tolist()
    return [whole[a : b - 1] for a, b in zip(starts, ends[shingle - 1 :].tolist())]


def _majority(hashes: np.ndarray, lanes: int) -> bytes:
    """The bits that over half of the hashes have."""
    counts = np.zeros(64 * lanes, np.int64)
    for k in range(0, len(hashes), 65536):  # bounded memory for very long texts
        h = _lanes(hashes[k : k + 65536], lanes)
        bits = np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def shingle_set(text: str | None, shingle: int, lanes: int) -> tuple[bytes, np.ndarray]:
    """Key and sorted hashes of the text's distinct shingles.

    The key is their fingerprint, their number and a digest of them: texts
    share a key if they have the same shingles.
    """
    w = words(text)
    if not w:
        return bytes(8 * lanes + 16), np.zeros(0, np.uint64)
    hashes = np.unique(_hashes(_shingles(w, shingle), 1)[:, 0])
    tail = np.array([len(hashes), xxhash.xxh64_intdigest(hashes.tobytes())], np.uint64)
    return _majority(hashes, lanes) + tail.tobytes(), hashes


def prefix(hashes: np.ndarray, similarity: float, frequent: np.ndarray) -> np.ndarray:
    """The first of the sorted ``hashes``, in an order in which ``frequent`` (sorted) ones come last.

    Two sets of this Jaccard similarity share ``similarity`` of either's hashes.
    So many are left behind the prefix, less one, that the first hash they
    share, in any order that is the same for all sets, is in both prefixes.
    """
    n = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1 if len(hashes) else 0
    if not len(frequent):
        return hashes[:n]
    often = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
    first = hashes[~often][:n]
    return first if len(first) == n else np.concatenate([first, hashes[often][: n - len(first)]])


def frequent_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of shingles that many rows of ``docs(text)`` hold, by a sample.

    They only decide the order that ``prefix`` goes by, that is, what the
    search costs, never what it finds.
    """
    share = min(1.0, SAMPLE_ROWS / max(docs.count(), 1))

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), PREFIX_ROWS):
                found = [shingle_set(t, shingle, 1)[1] for t in b["text"].iloc[k : k + PREFIX_ROWS]]
                yield pd.DataFrame({"h": np.concatenate(found).view(np.int64)})

    rows = docs.select("text").sample(share, 42).mapInPandas(hashes, "h long").groupBy("h").agg(F.count("*").alias("n"))
    most = rows.filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT)
    return np.sort(np.array([r["h"] for r in most.collect()], np.int64).view(np.uint64))


def near_key_column(text, shingle: int, lanes: int, similarity: float, frequent):
    """Column ``struct(fp binary, pop int, prefix binary)`` of a text column: key, the fingerprint's number of set bits, prefix.

    ``frequent`` is a broadcast variable.
    """

    @F.pandas_udf("fp binary, pop int, prefix binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = [shingle_set(t, shingle, lanes) for t in texts]
        pops = [int.from_bytes(x[: 8 * lanes], "little").bit_count() for x, _ in found]
        first = [prefix(h, similarity, frequent.value).tobytes() for _, h in found]
        return pd.DataFrame({"fp": [x for x, _ in found], "pop": pops, "prefix": first})

    return of(text)


def fingerprint_column(text, shingle: int = 3, lanes: int = 1):
    """Column ``struct(fp binary, pop int)`` of a text column: fingerprint and its number of set bits."""

    @F.pandas_udf("fp binary, pop int")
    def of(texts: pd.Series) -> pd.DataFrame:
        fps = [fingerprint(t, shingle, lanes) for t in texts]
        return pd.DataFrame({"fp": fps, "pop": [int.from_bytes(x, "little").bit_count() for x in fps]})

    return of(text)


def tile_bands(counts: dict[int, int], tile_size: int) -> list[tuple[int, int, int]]:
    """Bands ``(lowest, highest, tiles)`` of bit counts that hold about ``tile_size`` rows a tile."""
    bands: list[tuple[int, int, int]] = []
    low, n = None, 0
    for p in sorted(counts):
        if low is not None and n + counts[p] > tile_size:
            bands.append((low, last, max(1, -(-n // tile_size))))
            low, n = None, 0
        low, n, last = p if low is None else low, n + counts[p], p
    if low is not None:
        bands.append((low, last, max(1, -(-n // tile_size))))
    return bands


def _quarters(a: np.ndarray) -> np.ndarray:
    """Set bits of each 16-bit quarter of each fingerprint."""
    return np.bitwise_count(a.view(np.uint16).reshape(len(a), -1)).astype(np.int16)


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``a`` and ``b`` that differ in at most ``radius`` bits."""
    lanes = a.shape[1]
    first = min(2, lanes)
    d = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.uint16 if lanes > 1 else np.uint8, copy=False)
    for k in range(1, first):
        d = d + np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    i, j = np.nonzero(d <= radius)
    if lanes > first and len(i):
        rest = d[i, j].astype(np.int64)
        for k in range(first, lanes):
            rest += np.bitwise_count(a[i, k] ^ b[j, k])
        i, j = i[rest <= radius], j[rest <= radius]
    return i, j


def spanning_links(
    a: np.ndarray, b: np.ndarray | None, radius: int, lanes: int | None = None, near: Callable = near_pairs
) -> list[tuple[int, int]]:
    """Links that join the rows of ``a`` (and ``b``, numbered after ``a``) just as all near pairs would.

    A union-find over the tile pair emits at most one link a row, so that a
    group of near copies never emits all of its pairs. Of rows with further
    numbers the first ``lanes`` are the fingerprint; ``near`` finds the pairs of
    two blocks.
    """
    n = len(a)
    rows = a if b is None else np.concatenate([a, b])
    root = np.arange(len(rows))
    quarters = _quarters(np.ascontiguousarray(rows[:, :lanes]))
    links: list[tuple[int, int]] = []

    def blocks(lo: int, hi: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        return [
            (s, e := min(s + BLOCK, hi), quarters[s:e].min(axis=0), quarters[s:e].max(axis=0)) for s in range(lo, hi, BLOCK)
        ]

    left = blocks(0, n)
    right = left if b is None else blocks(n, len(rows))
    if not left or not right:
        return links
    low, high = np.stack([x[2] for x in right]), np.stack([x[3] for x in right])
    for x, (s, e, lo, hi) in enumerate(left):
        apart = np.maximum(np.maximum(low - hi, lo - high), 0).sum(axis=1)
        for y in np.nonzero(apart <= radius)[0]:
            if b is None and y < x:
                continue
            s2, e2 = right[y][:2]
            i, j = near(rows[s:e], rows[s2:e2], radius)
            ri, rj = root[i + s], root[j + s2]
            new = ri != rj
            if not new.any():
                continue
            keys = np.unique(np.stack([ri[new], rj[new]], axis=1), axis=0)
            parent: dict[int, int] = {}

            def find(v: int) -> int:
                while (p := parent.get(v, v)) != v:
                    v = p
                return v

            for p, q in keys.tolist():
                p, q = find(p), find(q)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    links.append((p, q))
            moved = np.arange(len(rows))
            for v in parent:
                moved[v] = find(v)
            root = moved[root]
    return links


def tiled(classes: DataFrame, radius: int, lanes: int, tile_size: int) -> DataFrame:
    """``classes(fp, pop)``, distinct, to ``(p, q, left, right)``: the rows of each pair of tiles to compare.

    A row of a tile has ``lanes`` numbers of 8 bytes; ``right`` is null where a
    tile meets itself.
    Only the counts of rows by number of set bits (64 * lanes + 1 at most) reach
    the driver. Pairs are listed by tasks, a row each, and dealt one by one.
    """
    spark = classes.sparkSession
    counts = {r["pop"]: r["n"] for r in classes.groupBy("pop").agg(F.count("*").alias("n")).collect()}
    bands = tile_bands(counts, tile_size)
    first = np.cumsum([0] + [n for _, _, n in bands])
    low, high = (np.array([x[k] for x in bands], np.int64) for k in (0, 1))
    pops = [next((k for k, (lo, hi, _) in enumerate(bands) if lo <= p <= hi), 0) for p in range(64 * lanes + 1)]
    band = F.element_at(F.array(*map(F.lit, pops)), F.col("pop") + 1) if bands else F.lit(0)
    size = F.element_at(F.array(*[F.lit(n) for _, _, n in bands]), band + 1) if bands else F.lit(1)
    start = F.element_at(F.array(*[F.lit(int(x)) for x in first]), band + 1)
    n_tiles = int(first[-1])
    # bands within the radius of each band, itself and later ones: all of their tiles are partners
    reach = [int(np.searchsorted(low, h + radius, "right")) for h in high.tolist()]
    n_pairs = sum(n * int(first[reach[k]] - first[k + 1]) + n * (n + 1) // 2 for k, (_, _, n) in enumerate(bands))

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        a = np.frombuffer(b"".join(group["fp"]), np.uint64).reshape(len(group), lanes)
        a = a[np.lexsort(_quarters(a).T)]
        return pd.DataFrame([(int(key[0]), a.tobytes())], columns=["tile", "rows"])

    def partners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["id"].tolist():
                last = int(first[reach[int(np.searchsorted(first, t, "right")) - 1]])
                for k in range(t, last, 100_000):
                    yield pd.DataFrame({"p": np.int32(t), "q": np.arange(k, min(last, k + 100_000), dtype=np.int32)})

    tile = start + F.pmod(F.xxhash64("fp"), size)
    dealt = classes.select("fp", tile.cast("int").alias("tile")).groupBy("tile")
    tiles = written(dealt.applyInPandas(pack, "tile int, rows binary"), "tiles")
    pairs = spark.range(n_tiles).mapInPandas(partners, "p int, q int")
    left = tiles.select(F.col("tile").alias("p"), F.col("rows").alias("left"))
    right = tiles.select(F.col("tile").alias("q"), F.col("rows").alias("right"))
    joined = pairs.join(left, "p").join(right, "q").withColumn("right", F.when(F.col("p") != F.col("q"), F.col("right")))
    # a task for every few pairs, whatever the bytes: comparing is what costs
    return joined.repartition(max(1, min(n_pairs, MOST_TASKS, n_pairs // PAIRS_A_TASK + 1)), "p", "q")


def _tile_parts(row, width: int) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64).reshape(-1, width) for x in (row["left"], row["right"]) if x is not None]


def near_links(classes: DataFrame, radius: int, lanes: int = 1, tile_size: int = 8192) -> DataFrame:
    """``classes(fp, pop)``, distinct, to links ``(a, b)`` of fingerprints.

    The links join exactly the fingerprints that chains of pairs within
    ``radius`` bits join.
    """

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        parts = _tile_parts(group.iloc[0], lanes)
        rows = np.concatenate(parts)
        links = spanning_links(parts[0], parts[1] if len(parts) > 1 else None, radius)
        return pd.DataFrame([(rows[p].tobytes(), rows[q].tobytes()) for p, q in links], columns=["a", "b"], dtype=object)

    return tiled(classes, radius, lanes, tile_size).groupBy("p", "q").applyInPandas(compare, "a binary, b binary")


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, lanes: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``a`` and ``b`` within ``radius`` bits whose numbers of shingles allow the similarity.

    The first half of the lanes has to lie within 5/8 of the radius, which
    spares the rest.
    """
    half = max(1, lanes // 2)
    d = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    for k in range(1, half):
        d = d + np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    i, j = np.nonzero(d <= (radius if half == lanes else radius * 5 // 8))
    return _close(a, b, i, j, d[i, j].astype(np.int64), half, radius, lanes, similarity)


def _close(a, b, i, j, d, half, radius, lanes, similarity) -> tuple[np.ndarray, np.ndarray]:
    for k in range(half, lanes):
        d += np.bitwise_count(a[i, k] ^ b[j, k])
    m, n = a[i, lanes].astype(np.int64), b[j, lanes].astype(np.int64)
    ok = (d <= radius) & (np.minimum(m, n) >= similarity * np.maximum(m, n))
    return i[ok], j[ok]


def candidate_rows(
    a: np.ndarray, b: np.ndarray | None, radius: int, lanes: int, similarity: float, sub_tile: int | None = None
) -> list[tuple]:
    """``(x, y, side, row)``: the rows of ``a`` and ``b`` (or of ``a`` alone) that have a candidate, by pairs of sub-tiles.

    A candidate pair is one of ``close_pairs``. Sub-tiles hold about
    ``sub_tile`` (``SUB_TILE``) shingles.
    """
    same = b is None
    b = a if same else b
    sizes, subs = [x[:, lanes].astype(np.int64) for x in (a, b)], []
    for n in sizes:
        subs.append((np.cumsum(n) - n) // (sub_tile or SUB_TILE))
    marks = [np.zeros((len(x), int(other[-1]) + 1 if len(other) else 0), bool) for x, other in zip((a, b), subs[::-1])]
    for s in range(0, len(a), BLOCK):
        for s2 in range(s if same else 0, len(b), BLOCK):
            i, j = close_pairs(a[s : s + BLOCK], b[s2 : s2 + BLOCK], radius, lanes, similarity)
            i, j = i + s, j + s2
            if same:
                i, j = i[i < j], j[i < j]
            marks[0][i, subs[1][j]] = True
            marks[1][j, subs[0][i]] = True
    out = {(int(subs[0][i]), int(y), 0, int(i)) for i, y in zip(*np.nonzero(marks[0]))}
    for j, x in zip(*np.nonzero(marks[1])):
        x, y = int(x), int(subs[1][j])
        out.add((x, y, 0 if same and x == y else 1, int(j)))
    return sorted(out)


def group_links(
    rows: np.ndarray, sizes: np.ndarray, whole: np.ndarray, radius: int, lanes: int, similarity: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that join the rows of each group just as all of its pairs by ``close_pairs`` would.

    Groups of ``sizes`` rows lie one after another. The rows of one that is not
    ``whole`` are all joined.
    """
    starts = np.cumsum(sizes) - sizes
    half = max(1, lanes // 2)
    for n in np.unique(sizes[whole & (sizes <= SMALL_GROUP)]).tolist():
        at = starts[whole & (sizes == n)]
        left, right = np.triu_indices(n, 1)
        for k in range(0, len(at), step := max(1, PAIRS // max(1, len(left)))):
            i, j = ((at[k : k + step, None] + x).ravel() for x in (left, right))
            d = np.zeros(len(i), np.int64)
            for lane in range(half):
                d += np.bitwise_count(rows[i, lane] ^ rows[j, lane])
            near = d <= (radius if half == lanes else radius * 5 // 8)
            yield _close(rows, rows, i[near], j[near], d[near], half, radius, lanes, similarity)
    near = lambda a, b, radius: close_pairs(a, b, radius, lanes, similarity)
    for s, n in zip(*(x[whole & (sizes > SMALL_GROUP)].tolist() for x in (starts, sizes))):
        links = np.array(spanning_links(rows[s : s + n], None, radius, lanes, near), np.int64).reshape(-1, 2) + s
        yield links[:, 0], links[:, 1]
    for s, n in zip(*(x[~whole].tolist() for x in (starts, sizes))):
        yield np.full(n - 1, s), np.arange(s + 1, s + n)


def jaccard_links(
    rows: np.ndarray, side: np.ndarray, sets: list[np.ndarray], radius: int, lanes: int, similarity: float
) -> list[tuple[int, int]]:
    """Links that join the rows just as all candidate pairs of Jaccard similarity ``similarity`` or more would.

    Pairs of rows on different sides, or all pairs if there is one side. A pair
    that is joined already isn't counted.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[ids] > 1  # by two rows or more
    ends = np.concatenate([[0], np.cumsum(shared)])[np.cumsum(sizes)]
    ids = ids[shared].astype(np.int32)
    starts = np.concatenate([[0], ends[:-1]])
    flag = np.zeros(len(counts), bool)
    root = np.arange(len(rows))
    links: list[tuple[int, int]] = []
    two = len(np.unique(side)) > 1
    for i in np.nonzero(side == 0)[0] if two else range(len(rows)):
        j = np.nonzero(root != root[i])[0]
        j = j[side[j] == 1] if two else j[j > i]
        j = j[np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i])]
        j = j[np.bitwise_count(rows[j, :lanes] ^ rows[i, :lanes]).sum(axis=1, dtype=np.int64) <= radius]
        if not len(j):
            continue
        flag[ids[starts[i] : ends[i]]] = True
        for k in range(0, len(j), 1024):
            part = j[k : k + 1024]
            both = np.fromiter((np.count_nonzero(flag[ids[starts[x] : ends[x]]]) for x in part), np.int64, len(part))
            alike = part[both / (sizes[part] + sizes[i] - both) >= similarity]
            roots, at = np.unique(root[alike], return_index=True)
            new = roots != root[i]
            links += [(int(i), int(x)) for x in alike[at[new]]]
            root[np.isin(root, roots)] = root[i]
        flag[ids[starts[i] : ends[i]]] = False
    return links


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted batches anew, so that no run of rows with one ``key`` is cut."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and (cut or held[-1].column(key)[-1].as_py() != keys[-1]):
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        elif held:
            held.append(b)
        else:
            if cut:
                yield pa.Table.from_batches([b.slice(0, cut)])
            held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def prefix_groups(docs: DataFrame) -> DataFrame:
    """``docs(fp, prefix)`` to ``(members, whole)``: the classes, by hash, that share a hash of their prefixes.

    Each set of members comes once. More than ``GROUP`` are cut into parts,
    all with the first of them, that are not ``whole``.
    """
    most = GROUP

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt: set[int] = set()  # copies of a text are dealt once in a task
        for b in batches:
            for k in range(0, b.num_rows, PREFIX_ROWS):
                ids = b.column("c")[k : k + PREFIX_ROWS].to_pylist()
                new = [x for x, i in enumerate(ids) if not (i in dealt or dealt.add(i))]
                if len(dealt) > DEALT:
                    dealt.clear()
                found = [b.column("prefix")[k + x].as_py() for x in new]
                counts = [len(x) // 8 for x in found]
                c = np.repeat(np.array([ids[x] for x in new], np.int64), counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(found), np.int64)), pa.array(c)], names=["h", "c"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "h"):
            h, c = (t.column(x).to_numpy() for x in ("h", "c"))
            new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
            h, c = h[new], c[new]
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            sizes = np.diff(np.append(starts, len(h)))
            some = (sizes > 1) & (sizes <= most)
            members = pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes[some])).astype(np.int32), c[np.repeat(some, sizes)])
            yield pa.RecordBatch.from_arrays([members, pa.array(np.ones(len(members), bool))], names=["members", "whole"])
            for s, n in zip(starts[sizes > most].tolist(), sizes[sizes > most].tolist()):
                parts = [np.append(c[s], c[k : min(k + most, s + n)]) for k in range(s + 1, s + n, most)]
                members = pa.array(parts, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([members, pa.array(np.zeros(len(members), bool))], names=["members", "whole"])

    dealt = docs.select(F.xxhash64("fp").alias("c"), "prefix").mapInArrow(deal, "h long, c long")
    groups = dealt.repartition("h").sortWithinPartitions("h", "c").mapInArrow(meet, "members array<long>, whole boolean")
    return written(groups.distinct(), "groups")


def candidate_components(docs: DataFrame, classes: DataFrame, radius: int, lanes: int, similarity: float) -> DataFrame:
    """``(fp, root)``: classes that chains of candidates join; a class without a candidate has no row.

    Candidates share a hash of their prefixes and are close by ``close_pairs``.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "g"):
            g, whole = (t.column(x).to_numpy() for x in ("g", "whole"))
            fps = t.column("fp").to_pylist()
            rows = np.frombuffer(b"".join(fps), np.uint64).reshape(len(fps), lanes + 2)
            starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            sizes = np.diff(np.append(starts, len(g)))
            for i, j in group_links(rows, sizes, np.logical_and.reduceat(whole, starts), radius, lanes, similarity):
                for k in range(0, len(i), 10_000):
                    pair = [pa.array([fps[r] for r in x[k : k + 10_000].tolist()], pa.binary()) for x in (i, j)]
                    yield pa.RecordBatch.from_arrays(pair, names=["a", "b"])

    groups = prefix_groups(docs).select(F.xxhash64("members").alias("g"), "whole", F.explode("members").alias("c"))
    members = groups.join(classes.select(F.xxhash64("fp").alias("c"), "fp"), "c").select("g", "whole", "fp")
    links = members.repartition("g").sortWithinPartitions("g").mapInArrow(compare, "a binary, b binary")
    return written(connected_components(links).withColumnRenamed("node", "fp"), "candidates")


def jaccard_class_links(
    docs: DataFrame, classes: DataFrame, shingle: int, radius: int, lanes: int, similarity: float, tile_size: int
) -> DataFrame:
    """``classes(fp, pop)`` of ``docs(fp, text, prefix)`` by ``near_key_column`` to verified links ``(a, b)``.

    Components of candidates are verified many at once, while they hold
    ``SUB_TILE`` shingles at most. In a larger one tiles name the rows that have
    a candidate, and each pair of sub-tiles verifies its own. Shingles are read
    from the texts of candidates only.
    """
    width, sub_tile = lanes + 2, SUB_TILE
    found = candidate_components(docs, classes, radius, lanes, similarity)
    # the number of shingles, from the key's bytes
    size = sum(F.conv(F.hex(F.substring("fp", 8 * lanes + 1 + k, 1)), 16, 10).cast("long") * 256**k for k in range(6))
    sizes = written(found.groupBy("root").agg(F.count("*").alias("rows"), F.sum(size).alias("shingles")), "sizes")
    large = F.col("shingles") > sub_tile
    total, n_large = sizes.agg(F.sum(F.when(~large, F.col("shingles"))), F.count_if(large)).first()
    packs = 2 * (total or 0) // sub_tile + 1
    keys = [F.lit(0).alias(k) for k in ("p", "q", "x", "y", "side")]
    small = found.join(sizes.filter(~large).select("root"), "root")
    wanted = small.select(F.pmod(F.xxhash64("root"), F.lit(packs)).alias("pack"), *keys, "root", "fp")

    def search(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        root, p, q = key
        parts = [
            np.frombuffer(b"".join(part.sort_values()), np.uint64).reshape(len(part), width)
            for part in (group["fp"][group["tile"] == t] for t in sorted({p, q}))
        ]
        rows = candidate_rows(parts[0], parts[1] if len(parts) > 1 else None, radius, lanes, similarity, sub_tile)
        of = lambda side, r: parts[side if len(parts) > 1 else 0][r].tobytes()
        names = ["p", "q", "x", "y", "side", "root", "fp"]
        return pd.DataFrame([(p, q, x, y, side, root, of(side, r)) for x, y, side, r in rows], columns=names)

    if n_large:
        tiles = F.ceil(F.col("rows") / tile_size).cast("int")
        rows = found.join(F.broadcast(sizes.filter(large)), "root").withColumn("tile", F.pmod(F.xxhash64("fp"), tiles).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        pairs = rows.select("root", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile", "fp")
        listed = pairs.groupBy("root", "p", "q").applyInPandas(search, "p int, q int, x int, y int, side int, root binary, fp binary")
        wanted = wanted.union(listed.select((-1 - F.pmod(F.xxhash64("root"), F.lit(1 << 62))).alias("pack"), "*"))

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 1000):
                found = [shingle_set(t, shingle, lanes)[1].tobytes() for t in b["text"].iloc[k : k + 1000]]
                yield pd.DataFrame({"fp": b["fp"].iloc[k : k + 1000], "hashes": found})

    def verify(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["root", "side", "fp"])
        rows = np.frombuffer(b"".join(group["fp"]), np.uint64).reshape(len(group), width)
        sets = [np.frombuffer(x, np.uint64) for x in group["hashes"]]
        side, roots, out = group["side"].to_numpy(), group["root"].to_numpy(), []
        cuts = [0, *(np.flatnonzero(roots[1:] != roots[:-1]) + 1).tolist(), len(group)]
        for s, e in zip(cuts, cuts[1:]):
            links = jaccard_links(rows[s:e], side[s:e], sets[s:e], radius, lanes, similarity)
            out += [(rows[s + a].tobytes(), rows[s + b].tobytes()) for a, b in links]
        return pd.DataFrame(out, columns=["a", "b"], dtype=object)

    wanted = written(wanted, "wanted")
    slot = F.pmod(F.xxhash64("fp"), F.lit(SLOTS)).alias("slot")
    slots = F.broadcast(wanted.select(slot).distinct())
    # one text of each class, reduced before the shuffle: a class may hold a third of all rows
    texts = docs.select("fp", "text", slot).join(slots, "slot", "left_semi").groupBy("fp").agg(F.first("text").alias("text"))
    sets = written(texts.mapInPandas(shingles, "fp binary, hashes binary"), "sets")
    return wanted.join(sets, "fp").groupBy("pack", "p", "q", "x", "y").applyInPandas(verify, "a binary, b binary")


def fingerprint_classes(fingerprints: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(doc_id, fp, pop)`` to ``(fp, root, n, component_id, several)``, a row per distinct fingerprint.

    ``links`` gives the links ``(a, b)`` of the classes ``(fp, pop, first, n)``.
    ``n`` is the fingerprint's number of rows, ``root`` the smallest fingerprint
    of its component, ``component_id`` the smallest doc_id there and ``several``
    whether the component holds more than one row.
    """
    classes = written(
        fingerprints.groupBy("fp", "pop").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes"
    )
    roots = written(connected_components(links(classes)), "roots")
    roots = roots.withColumnRenamed("node", "fp")
    linked = written(classes.join(roots, "fp").select("fp", "root", "n", "first"), "linked")
    smallest = written(linked.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    alone = classes.join(roots, "fp", "left_anti").select(
        "fp", F.col("fp").alias("root"), "n", F.col("first").alias("component_id"), (F.col("n") > 1).alias("several")
    )
    # a linked fingerprint has at least one other in its component
    joined = linked.join(smallest, "root").select("fp", "root", "n", "component_id", F.lit(True).alias("several"))
    return written(alone.union(joined), "components")


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3, lanes: int = 1) -> DataFrame:
    """Near-duplicate components of ``docs(doc_id, text)``: ``(doc_id, fp, component_id)``, a row per row.

    Null and empty texts have the zero fingerprint and are linked like any
    other. Repeated rows are all returned. A null ``doc_id`` never becomes a
    component's id unless its component has no other. Other columns of ``docs``
    are not read. An empty table gives an empty one.
    """
    print_ = fingerprint_column("text", shingle, lanes).alias("p")
    fps = written(docs.select("doc_id", print_).select("doc_id", "p.fp", "p.pop"), "fingerprints")
    classes = fingerprint_classes(fps, lambda c: near_links(c.select("fp", "pop"), radius, lanes))
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(
    docs: DataFrame, shingle: int = 5, radius: int = 72, lanes: int = 4, similarity: float = 0.8
) -> DataFrame:
    """``docs`` without near-duplicates, all columns kept: the row with the smallest doc_id of each group stays.

    Of repeated rows that share that doc_id, one stays; of a group whose
    doc_ids are all null, one stays. Groups are what chains of pairs of Jaccard
    similarity ``similarity`` or more over distinct five-word shingles join (a
    shorter text is one shingle). Pairs within ``radius`` of 256 bits are
    counted: two texts of similarity s differ in about 256 / pi * acos(2s / (1 + s))
    bits, 39 with a deviation of 6 at 0.8; four shingles of five differ most, in
    48. Only texts that share a shingle of their prefixes are compared, as all
    pairs of the similarity do. Null and empty texts form one group. Column
    names starting with ``_near`` are reserved.
    """
    new_names(docs, "_near", "_near_fp", "_near_pop", "_near_prefix", "_near_root", "_near_keep", "_near_twice")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # fingerprints are worked out once and stored beside the texts
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, shingle))
    print_ = near_key_column(F.col("text"), shingle, lanes, similarity, frequent).alias("_near")
    keys = [F.col(f"_near.{k}").alias(f"_near_{k}") for k in ("fp", "pop", "prefix")]
    marked = written(docs.select("*", print_).select(*columns, *keys), "marked")
    fps = marked.select("doc_id", F.col("_near_fp").alias("fp"), F.col("_near_pop").alias("pop"))
    texts = marked.select(F.col("_near_fp").alias("fp"), "text", F.col("_near_prefix").alias("prefix"))
    classes = fingerprint_classes(
        fps, lambda c: jaccard_class_links(texts, c, shingle, radius, lanes, similarity, tile_size=16384)
    )
    # only groups of several rows decide anything; in some, several rows share the doc_id that stays
    groups = written(classes.filter("several").select("fp", "root", "component_id"), "groups")
    stay = fps.join(groups, "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    twice = stay.groupBy("root").agg(F.count("*").alias("rows")).filter("rows > 1").select("root", F.lit(True).alias("twice"))
    twice = written(twice, "twice")
    repeats = not twice.isEmpty()
    # both sides are written tables, so that AQE can split a root with many fingerprints
    flagged = groups.join(twice, "root", "left") if repeats else groups.withColumn("twice", F.lit(False))
    groups = flagged.select(
        F.col("fp").alias("_near_fp"),
        F.col("root").alias("_near_root"),
        F.col("component_id").alias("_near_keep"),
        F.coalesce("twice", F.lit(False)).alias("_near_twice"),
    )
    if repeats:
        groups = written(groups, "decisions")
    # one join by sort and merge, at every size: texts are shuffled once
    marked = marked.drop("_near_prefix")
    joined = marked.join(groups.hint("merge"), "_near_fp", "left")
    stays = F.col("doc_id").eqNullSafe(F.col("_near_keep"))
    kept = joined.filter(F.col("_near_root").isNull() | (stays & ~F.col("_near_twice"))).select(*columns)
    if not repeats:
        return kept
    again = marked.join(groups.filter("_near_twice"), "_near_fp").filter(stays).dropDuplicates(["_near_root"])
    return kept.unionByName(again.select(*columns))
