"""Exact top-k inner-product search by dual-tree traversal of cover trees.

Queries and data are dealt into blocks of neighbours, by the nearest of some
sampled centres, each with a cover tree that is built once. A pair of blocks is
one group, which walks both trees at once. A pair of nodes is pruned when even
points at the rims of both covering balls, as far towards each other as the
balls and the lengths of their points allow, score less than the worst kth score
among the query node's queries. Each query block meets one block of data first;
with the kth scores found there, pairs of blocks are judged by their roots, and
only those that survive are brought together.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.llm.common import written

#: Rows of a leaf of queries and of data, and children of a node at most.
QUERY_LEAF, DATA_LEAF, FANOUT = 1, 4, 32
FOUND = "query_id long, vec_id long, score long"
BLOCK = "dim int, block int, ids binary, data binary, tree binary, center array<double>, radius double, norm double, most double"


class Tree:
    """A cover tree over rows, which it holds in the order of its nodes.

    Node 0 is the root. Node n has the rows ``start[n]:end[n]``, all within
    ``radius[n]`` of its centre, a row of length ``norm[n]``; ``most[n]`` is the
    longest row's length. Its children are ``first[n]`` to ``last[n]``.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        """A node's children are centres chosen farthest first, the node's own among them, until every row lies within
        half the node's radius of one (covering) or there are ``FANOUT``; chosen centres lie at least that far apart
        (separation). A child's radius is that of its rows."""
        order = np.arange(len(points))
        away = lambda rows, c: np.sqrt(np.square(points[rows] - points[c]).sum(axis=1))
        from_root = away(order, 0)
        nodes = [[0, float(from_root.max()), 0, len(points), 0, 0]]  # center, radius, start, end, first, last
        waiting = [(0, from_root)]
        while waiting:
            n, nearest = waiting.pop()
            center, radius, start, end = nodes[n][:4]
            rows = order[start:end]
            if len(rows) <= leaf or radius == 0:
                continue
            owner, centers = np.zeros(len(rows), np.int64), [center]
            while len(centers) < FANOUT and nearest.max() > radius / 2:
                centers.append(int(rows[int(nearest.argmax())]))
                d = away(rows, centers[-1])
                owner[d < nearest] = len(centers) - 1
                nearest = np.minimum(nearest, d)
            sort = np.argsort(owner, kind="stable")
            order[start:end] = rows[sort]
            nearest, owner = nearest[sort], owner[sort]
            cuts = np.searchsorted(owner, np.arange(len(centers) + 1)).tolist()
            nodes[n][4] = len(nodes)
            for c, s, e in zip(centers, cuts, cuts[1:]):
                if s < e:
                    waiting.append((len(nodes), nearest[s:e]))
                    nodes.append([c, float(nearest[s:e].max()), start + s, start + e, 0, 0])
            nodes[n][5] = len(nodes)
        center, self.radius, self.start, self.end, self.first, self.last = (np.array(x) for x in zip(*nodes))
        self.order = order
        lengths = np.sqrt(np.square(points).sum(axis=1))
        self.centers, self.norm = points[center], lengths[center]
        self.most = np.array([lengths[order[s:e]].max() for s, e in zip(self.start.tolist(), self.end.tolist())])

    def pack(self) -> bytes:
        return pickle.dumps(vars(self))

    @classmethod
    def unpack(cls, raw: bytes) -> Tree:
        tree = cls.__new__(cls)
        vars(tree).update(pickle.loads(raw))
        return tree


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    counts = ends - starts
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


def bounds(a: Tree, n: int, b: Tree, m: np.ndarray) -> np.ndarray:
    """What any row of a's node ``n`` scores with any row of b's nodes ``m`` at most.

    Of two bounds the smaller: the centres' product and what the radii can add,
    and half of what the longest rows' squares exceed the squared distance that
    the balls keep (2xy = x^2 + y^2 - (x - y)^2), which is the angle's bound
    where lengths are alike.
    """
    product = b.centers[m] @ a.centers[n]
    reach = product + a.radius[n] * b.norm[m] + b.radius[m] * a.norm[n] + a.radius[n] * b.radius[m]
    apart = np.sqrt(np.maximum(a.norm[n] ** 2 + b.norm[m] ** 2 - 2 * product, 0)) - a.radius[n] - b.radius[m]
    ball = (a.most[n] ** 2 + b.most[m] ** 2 - np.square(np.maximum(apart - 1e-6, 0))) / 2
    most = np.minimum(reach, ball)
    return most + 1e-9 * (np.abs(most) + 1)


def dual_tree_top_k(
    qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int, trees: tuple[Tree, Tree] | None = None, floor: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of each query's ``k`` best rows of ``v`` (-inf where there are fewer), and the pairs that were scored.

    Rows hold whole numbers. Where a double may not hold their inner products
    exactly, those of rows that the bounds let through are taken in Python's
    integers; the bounds themselves are doubles, rounded up. Ties go to the
    smaller id; a row with the query's id is no candidate. ``floor`` are scores
    below which a query needs no candidate.
    """
    nobody = np.iinfo(np.int64).max
    longest = max(np.abs(q).max(initial=0), np.abs(v).max(initial=0))
    exact = longest * longest * max(1, q.shape[1]) < 2.0**53
    scores, ids = np.full((len(q), k), -np.inf, float if exact else object), np.full((len(q), k), nobody)
    if not len(q) or not len(v):
        return scores, ids, 0
    a, b = trees or (Tree(q, QUERY_LEAF), Tree(v, DATA_LEAF))
    qq, qi, vv, vi = q[a.order], qid[a.order], v[b.order], vid[b.order]
    least = np.full(len(q), -np.inf) if floor is None else floor[a.order].astype(float)
    whole = lambda x: np.array([[int(e) for e in row] for row in x], object).reshape(x.shape)
    scored = 0
    worst = lambda n: float(np.maximum(scores[a.start[n] : a.end[n], -1], least[a.start[n] : a.end[n]]).min())

    def base(n: int, leaves: np.ndarray) -> None:
        nonlocal scored
        at, rows = slice(a.start[n], a.end[n]), _ranges(b.start[leaves], b.end[leaves])
        s = qq[at] @ vv[rows].T if exact else whole(qq[at]) @ whole(vv[rows]).T
        scored += s.size
        cand = vi[rows]
        s[qi[at, None] == cand[None]] = -np.inf
        for row in range(len(s)):
            i = at.start + row
            hot = np.nonzero(s[row] >= max(scores[i, -1], least[i]))[0]
            if len(hot):
                all_s = np.concatenate([scores[i], s[row, hot]])
                all_i = np.concatenate([ids[i], np.where(s[row, hot] == -np.inf, nobody, cand[hot])])
                best = np.lexsort((all_i, -all_s))[:k] if exact else sorted(range(len(all_s)), key=lambda j: (-all_s[j], all_i[j]))[:k]
                scores[i], ids[i] = all_s[best], all_i[best]

    stack = [(0, np.zeros(1, np.int64))]
    while stack:
        n, nodes = stack.pop()
        inner = a.last[n] > a.first[n]
        while True:  # opens the data nodes: at an inner node of queries those that are wider than it, at a leaf all
            most = bounds(a, n, b, nodes)
            near = ~(most < worst(n))
            nodes, most = nodes[near], most[near]
            opens = b.last[nodes] > b.first[nodes]
            if inner:
                opens &= b.radius[nodes] > a.radius[n]
            if not opens.any():
                break
            nodes = np.concatenate([nodes[~opens], _ranges(b.first[nodes[opens]], b.last[nodes[opens]])])
        if inner:
            stack += [(c, nodes) for c in range(a.first[n], a.last[n])]
            continue
        order = np.argsort(-most)  # the most promising first
        nodes, most, done, step = nodes[order], most[order], 0, 4 * k
        while done < len(nodes) and not most[done] < (least_now := worst(n)):
            stop = min(done + step, int(np.searchsorted(-most, -least_now, "right")))
            base(n, nodes[done:stop])
            done, step = stop, 2 * step
    back_s, back_i = np.empty_like(scores), np.empty_like(ids)
    back_s[a.order], back_i[a.order] = scores, ids
    return back_s, back_i, scored


def _found(qid, q, vid, v, k: int, trees: tuple[Tree, Tree], floor: np.ndarray | None) -> list[tuple[int, int, int]]:
    """The rows of ``dual_tree_top_k``, scores held to 64 bits."""
    scores, ids, _ = dual_tree_top_k(qid, q, vid, v, k, trees, floor)
    low, high = -(1 << 63), (1 << 63) - 1
    return [(i, j, max(low, min(high, int(s)))) for i, row, found in zip(qid.tolist(), scores.tolist(), ids.tolist()) for s, j in zip(row, found) if s != -np.inf]


def _usable(table: DataFrame, id_column: str, vector: str, k: int) -> DataFrame:
    """``(id, x, dim)`` of the rows that take part, at most ``k`` of those with one id and vector: no more can be found."""
    x = F.col(vector).cast("array<double>")
    rows = table.select(F.col(id_column).cast("long").alias("id"), x.alias("x")).filter(
        "id is not null and x is not null and forall(x, e -> e is not null and not isnan(e) and abs(e) < double('infinity'))"
    )
    counted = rows.groupBy("id", "x").agg(F.count("*").alias("n"))
    copies = F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k)))
    return counted.select("id", "x", F.size("x").alias("dim"), F.explode(copies).alias("copy"))


def _spread(drawn: list[list[float]], n: int) -> list[list[float]]:
    """``n`` of the vectors drawn, farthest first, of each length in proportion: what lies apart gets a center of its own."""
    out = []
    for dim in sorted({len(x) for x in drawn}):
        own = [r for r in drawn if len(r) == dim]
        x = np.array(own, np.float64).reshape(len(own), dim)
        x = x / max(1.0, np.abs(x).max(initial=0))  # huge components must not overflow
        away, chosen = np.full(len(x), np.inf), []
        while len(chosen) < -(-n * len(own) // len(drawn)) and away.max() > 0:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, np.square(x - x[chosen[-1]]).sum(axis=1))
        out += [own[k] for k in chosen]
    return out


def _packed(rows: DataFrame, centers: list[list[float]], block_rows: int, scale: float, leaf: int) -> DataFrame:
    """Vectors with their trees in blocks of about ``block_rows`` (schema BLOCK), written.

    Rows of one nearest center are neighbours; where these are more than a
    block, they are dealt by hash, so that no center gathers more than its share.
    """
    by_dim: dict[int, np.ndarray] = {}
    for c in centers:
        by_dim.setdefault(len(c), []).append(c)
    by_dim = {d: np.array(c, np.float64).reshape(len(c), d) for d, c in by_dim.items()}

    def nearest(batches):
        for b in batches:
            cell = np.zeros(len(b), np.int32)
            for d in set(b["dim"].tolist()) & set(by_dim):
                at = np.flatnonzero((b["dim"] == d).to_numpy())
                if len(by_dim[d]) > 1:
                    x, c = np.array(b["x"].iloc[at].tolist(), np.float64).reshape(len(at), d), by_dim[d]
                    cell[at] = ((c * c).sum(axis=1)[None] - 2 * x @ c.T).argmin(axis=1)
            yield b.assign(cell=cell)

    if centers:
        near = written(rows.mapInPandas(nearest, "id long, x array<double>, dim int, copy long, cell int"), "vectors")
    else:
        near = rows.withColumn("cell", F.lit(0))
    # a row for each center and length
    cells = near.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n"))
    order = Window.orderBy("dim", "cell").rowsBetween(Window.unboundedPreceding, -1)
    numbers = cells.withColumn("start", F.coalesce(F.sum("n").over(order), F.lit(0)))
    dealt = near.join(F.broadcast(numbers), ["dim", "cell"])
    block = (F.col("start") + F.pmod(F.xxhash64("id", "x", "copy"), F.col("n"))).cast("int")

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        data = np.floor(np.array(group["x"].tolist(), np.float64).reshape(len(group), int(key[0])) * scale)
        ids = group["id"].to_numpy()
        order = np.lexsort((*data.T[::-1], ids))
        ids, data = ids[order], data[order]
        tree = Tree(data, leaf)
        row = (key[0], key[1], ids.tobytes(), data.tobytes(), tree.pack(), tree.centers[0].tolist(), float(tree.radius[0]), float(tree.norm[0]), float(tree.most[0]))
        return pd.DataFrame([row], columns=[c.split()[0] for c in BLOCK.split(", ")])

    return written(dealt.select("id", "x", "dim", block.alias("block")).groupBy("dim", "block").applyInPandas(pack, BLOCK), "blocks")


def _may_meet(least: Column) -> Column:
    """Whether a pair of blocks, by their roots, may hold a score of ``least`` or more: ``bounds`` for the roots."""
    product = F.aggregate(F.zip_with("q_center", "center", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    reach = product + F.col("q_radius") * F.col("norm") + F.col("radius") * F.col("q_norm") + F.col("q_radius") * F.col("radius")
    apart = F.sqrt(F.greatest(F.col("q_norm") * F.col("q_norm") + F.col("norm") * F.col("norm") - 2 * product, F.lit(0.0))) - F.col("q_radius") - F.col("radius")
    kept = F.greatest(apart - 1e-6, F.lit(0.0))
    ball = (F.col("q_most") * F.col("q_most") + F.col("most") * F.col("most") - kept * kept) / 2
    most = F.least(reach, ball)
    return F.coalesce(F.isnan(most) | (most + 1e-9 * (F.abs(most) + 1) >= least), F.lit(True))


#: Centers by which vectors are dealt, at most: a bound on what the driver holds and on what dealing a row costs.
MOST_CENTERS = 256


def top_k(
    queries: DataFrame,
    data: DataFrame,
    k: int = 5,
    scale: float = 256,
    id_column: str = "vec_id",
    vector: str = "embedding",
    block_rows: int = 8192,
    query_rows: int = 16384,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of ``data`` with the largest inner product for each query.

    Components x count as floor(``scale`` * x), so scores are whole numbers;
    they are exact, and held to 64 bits. Ties go to the smaller id. A row with
    the query's id is no candidate. Rows with a null id, a null vector, or null
    or non-finite components take no part; vectors of different lengths never
    meet. Rows of ``data`` that share an id are candidates each, and of queries
    that share one every row asks: their results are ranked together. Fewer than
    ``k`` candidates give fewer rows, an empty table none. Other columns are not
    read.

    A pair of blocks returns at most ``k`` rows a query, which a window ranks.
    """
    asking, rows = (written(_usable(t, id_column, vector, k), "usable") for t in (queries, data))
    n = -(-rows.count() // block_rows)
    drawn = rows.orderBy(F.xxhash64("id", "x"), "id").limit(8 * min(n, MOST_CENTERS)).select("x").collect() if n > 1 else []
    centers = _spread([r["x"] for r in drawn], min(n, MOST_CENTERS))
    q, v = _packed(asking, centers, query_rows, scale, QUERY_LEAF), _packed(rows, centers, block_rows, scale, DATA_LEAF)
    roots = ("center", "radius", "norm", "most")
    v_roots = v.select("dim", F.col("block").alias("v"), *roots)
    q_roots = q.select("dim", F.col("block").alias("q"), *[F.col(c).alias(f"q_{c}") for c in roots])
    # blocks of queries against blocks of data, a row of numbers for each pair: the smallest distance of centers comes first
    gap = F.aggregate(F.zip_with("q_center", "center", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = written(q_roots.join(v_roots, "dim").withColumn("home", -gap), "pairs")
    home = pairs.groupBy("dim", "q").agg(F.max_by("v", F.struct("home", -F.col("v"))).alias("v"))

    def unpack(g: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, Tree | None]:
        if not len(g):
            return np.zeros(0, np.int64), np.zeros((0, dim)), None
        r = g.iloc[0]
        ids = np.frombuffer(r["ids"], np.int64)
        return ids, np.frombuffer(r["data"], np.float64).reshape(len(ids), dim), Tree.unpack(r["tree"])

    def search(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        (qid, qs, q_tree), (vid, vs, v_tree) = unpack(a, int(key[0])), unpack(b, int(key[0]))
        found = []
        if len(qid) and len(vid):
            held = a["floor"].iloc[0] if "floor" in a else None
            found = _found(qid, qs, vid, vs, k, (q_tree, v_tree), None if held is None else np.frombuffer(held, np.float64))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    blocks = ("ids", "data", "tree")
    q_blocks, v_blocks = q.select("dim", F.col("block").alias("q"), *blocks), v.select("dim", F.col("block").alias("v"), *blocks)
    keys = "dim", "q", "v"

    def meet(some: DataFrame, asked: DataFrame) -> DataFrame:
        some = some.select(*keys)
        return asked.join(some, ["dim", "q"]).groupBy(*keys).cogroup(v_blocks.join(some, ["dim", "v"]).groupBy(*keys)).applyInPandas(search, FOUND)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if n <= 1:  # a block of each length of vectors
        return ranked(meet(home, q_blocks))
    first = written(meet(home, q_blocks), "first")
    kth = ranked(first).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    # a score that was held to 64 bits tells nothing of what lies below
    kth = kth.filter((F.col("n") == k) & (F.col("kth") > -(1 << 63))).select("query_id", "kth")
    of_block = q.select("dim", F.col("block").alias("q"), "ids").mapInPandas(_query_ids, "dim int, q int, at int, query_id long")
    known = written(of_block.join(kth, "query_id", "left").groupBy("dim", "q").applyInPandas(_floors, "dim int, q int, floor binary, least double"), "floors")
    rest = pairs.join(home.withColumnRenamed("v", "_home"), ["dim", "q"]).filter(F.col("v") != F.col("_home"))
    alive = written(rest.join(known.select("dim", "q", "least"), ["dim", "q"]).filter(_may_meet(F.col("least"))).select(*keys), "alive")
    return ranked(first.unionByName(meet(alive, q_blocks.join(known.drop("least"), ["dim", "q"]))))


def _query_ids(batches):
    """The ids of each block, a row each, with their places."""
    for b in batches:
        for dim, q, raw in zip(b["dim"], b["q"], b["ids"]):
            ids = np.frombuffer(raw, np.int64)
            yield pd.DataFrame({"dim": dim, "q": q, "at": np.arange(len(ids), dtype=np.int32), "query_id": ids})


def _floors(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """The kth scores of a block's queries in order, -inf where there is none yet, and the least of them."""
    held = np.nextafter(group.sort_values("at")["kth"].astype("float64").fillna(-np.inf).to_numpy(), -np.inf)
    return pd.DataFrame([(*key, held.tobytes(), held.min())], columns=["dim", "q", "floor", "least"])
