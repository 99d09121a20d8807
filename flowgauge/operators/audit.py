"""Hash-chained audit logs with a Merkle tree over them.

A chain is sequential by nature. To let it grow beyond one task, entries are
numbered within a segment (a symbol, some years, ...) and cut by number into
parts of ``part_rows``, each a chain of its own; parts are built and verified in
parallel, whatever ids look like and however large a segment is. The parts' last
hashes and counts are chained in turn (the heads), so that a part that is gone
or cut short is found, and a Merkle tree over all entries gives a root for the
whole segment and short proofs for single entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgauge.operators.tables import numbered
from flowgauge.tables import stored

PART_ROWS = 100_000
#: Levels of the tree that one task builds at once, over 2 to this power nodes.
TIER = 12
FIELDS = ("event_type", "actor", "symbol", "event_id", "details", "created_at_ms")


def canonical(previous: Column) -> Column:
    """The text that an entry's hash covers: its fields and the previous hash, joined by ``|``, nulls empty.

    A ``|`` or a backslash inside a field takes a backslash before it, so that no two entries have one text.
    """
    plain = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    parts = [x for c in FIELDS for x in (F.coalesce(plain(c), F.lit("")), F.lit("|"))]
    return F.concat(*parts, F.coalesce(previous, F.lit("")))


def _lists(b: pa.RecordBatch, *names: str) -> list[list]:
    return [b.column(b.schema.get_field_index(c)).to_pylist() for c in names]


def build_chain(events: DataFrame, segment: str = "segment", part_rows: int = PART_ROWS) -> DataFrame:
    """``events`` (schema AUDIT and ``segment``) with ``entry``, ``part``, ``previous_hash`` and ``entry_hash``.

    ``entry`` numbers a segment's entries from 1 by (id, text); ids may repeat
    and have gaps. A part's entries go through one task as a sorted stream, which
    holds the last hash and nothing else.
    """
    rows = events.select(segment, "id", *FIELDS, canonical(F.lit("")).alias("_body"))
    with_number = numbered(rows, ["id", "_body"], "entry", key=segment)
    dealt = with_number.withColumn("part", F.floor((F.col("entry") - 1) / F.lit(part_rows)).cast("long"))
    names = [segment, "part", "entry", "id", *FIELDS]

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, None
        for b in batches:
            before, own = [], []
            for *where, text in zip(*_lists(b, segment, "part", "_body")):
                if where != at:
                    at, last = where, None
                before.append(last)
                last = hashlib.sha256((text + (last or "")).encode()).hexdigest()
                own.append(last)
            kept = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(before, pa.string()), pa.array(own, pa.string())], names=[*names, "previous_hash", "entry_hash"])

    kinds = {f.name: f for f in dealt.schema.fields}
    hashes = [T.StructField(c, T.StringType()) for c in ("previous_hash", "entry_hash")]
    ready = dealt.repartition(segment, "part").sortWithinPartitions(segment, "part", "entry")
    return ready.mapInArrow(chain, T.StructType([kinds[c] for c in names] + hashes))


def verify_chain(log: DataFrame, segment: str = "segment", part_rows: int = PART_ROWS) -> DataFrame:
    """``log`` with ``ok``: the number follows that of the entry before, and the stated hashes are the entry's own and its predecessor's."""
    order = Window.partitionBy(segment, "part").orderBy("entry")
    starts = (F.col("entry") - 1) % F.lit(part_rows) == 0
    follows = F.when(starts, F.lag("entry").over(order).isNull()).otherwise(F.coalesce(F.lag("entry").over(order) == F.col("entry") - 1, F.lit(False)))
    placed = F.col("part") == F.floor((F.col("entry") - 1) / F.lit(part_rows))
    linked = F.col("previous_hash").eqNullSafe(F.lag("entry_hash").over(order))
    own = F.col("entry_hash").eqNullSafe(F.sha2(canonical(F.col("previous_hash")), 256))
    return log.withColumn("ok", F.coalesce(follows & placed, F.lit(False)) & linked & own)


def _ends(log: DataFrame, segment: str) -> DataFrame:
    return log.groupBy(segment, "part").agg(F.count("*").alias("n_entries"), F.max_by("entry_hash", "entry").alias("last_hash"))


def _head(part: Column, n: Column, last: Column, previous: Column) -> Column:
    text = [part.cast("string"), n.cast("string"), last, F.coalesce(previous, F.lit(""))]
    return F.sha2(F.concat_ws("|", *text), 256)


def chain_heads(log: DataFrame, segment: str = "segment") -> DataFrame:
    """``(segment, part, n_entries, last_hash, previous_head, head_hash)``: the parts of each segment, chained in order.

    A row for each part, of which one task takes a segment's as a sorted stream.
    """
    ends = _ends(log, segment)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, None
        for b in batches:
            before, own = [], []
            for where, part, n, end in zip(*_lists(b, segment, "part", "n_entries", "last_hash")):
                if (where,) != at:
                    at, last = (where,), None
                before.append(last)
                last = hashlib.sha256(f"{part}|{n}|{end}|{last or ''}".encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.string()), pa.array(own, pa.string())], names=[*b.schema.names, "previous_head", "head_hash"])

    hashes = [T.StructField(c, T.StringType()) for c in ("previous_head", "head_hash")]
    return ends.repartition(segment).sortWithinPartitions(segment, "part").mapInArrow(chain, T.StructType([*ends.schema.fields, *hashes]))


def verify_parts(log: DataFrame, heads: DataFrame, segment: str = "segment") -> DataFrame:
    """``(segment, part, problem)`` for every part of the log or the heads; ``problem`` is null for a sound one.

    ``missing``: a head's part is gone; ``unknown``: a part has no head;
    ``short`` and ``long``: its number of entries isn't the head's; ``forged``:
    its last hash isn't; ``head``: the head itself isn't chained to the one before.
    """
    found = _ends(log, segment).select(F.col(segment).alias("_segment"), F.col("part").alias("_part"), F.col("n_entries").alias("_n"), F.col("last_hash").alias("_last"))
    same = F.col(segment).eqNullSafe(F.col("_segment")) & (F.col("part") == F.col("_part"))
    order = Window.partitionBy(segment).orderBy("part")
    follows = F.coalesce(F.lag("part").over(order), F.lit(-1)) == F.col("part") - 1
    linked = F.lag("head_hash").over(order).eqNullSafe(F.col("previous_head"))
    own = F.col("head_hash").eqNullSafe(_head(F.col("part"), F.col("n_entries"), F.col("last_hash"), F.col("previous_head")))
    stated = heads.withColumn("_sound", follows & linked & own)
    problem = (
        F.when(F.col("part").isNull(), "unknown")
        .when(~F.col("_sound"), "head")
        .when(F.col("_part").isNull(), "missing")
        .when(F.col("_n") < F.col("n_entries"), "short")
        .when(F.col("_n") > F.col("n_entries"), "long")
        .when(~F.col("_last").eqNullSafe(F.col("last_hash")), "forged")
    )
    joined = stated.join(found, same, "full")
    return joined.select(F.when(F.col("part").isNull(), F.col("_segment")).otherwise(F.col(segment)).alias(segment), F.coalesce("part", "_part").alias("part"), problem.alias("problem"))


def _leaf(entry_hash: Column) -> Column:
    return F.sha2(F.concat(F.lit("leaf|"), entry_hash), 256)


def merkle_tree(log: DataFrame, segment: str = "segment", tier: int = TIER) -> DataFrame:
    """``(segment, level, idx, hash)``: all nodes of a tree over each segment's entries, leaves (level 0) by number from 0.

    A node hashes the two below it; the last of an odd number goes up as it is.
    Each pass builds ``tier`` levels: blocks of 2^tier neighbouring nodes, cut by
    number, go through tasks as sorted streams, a block at a time. The topmost
    level has one node for each segment, its root.
    """
    most = log.agg(F.max("entry")).first()[0] or 0
    width = 1 << tier

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rise(where: list, nodes: list[str]) -> pa.RecordBatch:
            of, level, block = where
            out = []
            for up in range(1, tier + 1):
                pairs = [nodes[k : k + 2] for k in range(0, len(nodes), 2)]
                nodes = [hashlib.sha256(f"node|{p[0]}{p[1]}".encode()).hexdigest() if len(p) == 2 else p[0] for p in pairs]
                out += [(of, level + up, (block << (tier - up)) + k, h) for k, h in enumerate(nodes)]
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["segment", "level", "idx", "hash"])

        at, nodes = None, []
        for b in batches:
            kinds = (b.schema.field("segment").type, pa.int32(), pa.int64(), pa.string())
            for where, run in groupby(zip(*_lists(b, "segment", "level", "_block", "hash")), key=lambda r: r[:3]):
                if where != at:
                    if nodes:
                        yield rise(at, nodes)
                    at, nodes = where, []
                nodes += [r[3] for r in run]
        if nodes:
            yield rise(at, nodes)

    leaves = log.select(F.col(segment).alias("segment"), F.lit(0).alias("level"), (F.col("entry") - 1).alias("idx"), _leaf(F.col("entry_hash")).alias("hash"))
    levels = [stored(leaves, "leaves")]
    size, top = most, 0
    while size > 1:
        below = levels[-1].filter(F.col("level") == top).withColumn("_block", F.floor(F.col("idx") / width).cast("long"))
        ready = below.repartition("segment", "_block").sortWithinPartitions("segment", "_block", "idx")
        levels.append(stored(ready.mapInArrow(build, levels[0].schema), "levels"))
        size, top = -(-size // width), top + tier
    tree = levels[0]
    for level in levels[1:]:
        tree = tree.unionByName(level)
    return tree


def roots(tree: DataFrame) -> DataFrame:
    """``(segment, n_entries, root)`` of a tree."""
    leaves = F.sum((F.col("level") == 0).cast("long")).alias("n_entries")
    return tree.groupBy("segment").agg(leaves, F.max_by("hash", "level").alias("root"))


def prove(tree: DataFrame, entries: DataFrame, tier: int = TIER) -> DataFrame:
    """``entries(segment, entry, ...)`` with ``proof``: the hashes beside the way to the root, ``(level, on_left, hash)`` in order.

    A proof has as many hashes as the tree has levels at most. What is asked of a
    block of 2^tier neighbouring nodes meets the nodes of the block's ``tier``
    levels in one row, so that each node is shuffled once, not once for each entry
    below it, and no entry's proof is shuffled. The ways on from blocks, the tiers
    above, are found first in the same manner: a row for each block.
    """
    top = tree.agg(F.max("level")).first()[0] or 0
    others = [c for c in entries.columns if c != "segment"]
    above = None
    for base in reversed(range(0, max(top, 1), tier)):
        place = F.shiftright(F.col("entry") - 1, base).alias("place")
        wanted = [place] if base else [place, F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")]
        block = F.shiftright(F.col("entry") - 1, base + tier).alias("block")
        asked = entries.select("segment", block, F.struct(*wanted).alias("of")).groupBy("segment", "block").agg(F.collect_set("of").alias("asked"))
        levels = tree.filter(F.col("level").between(base, base + tier - 1)).withColumn("block", F.expr(f"shiftright(idx, {base + tier} - level)"))
        at = lambda k, base=base: F.when(F.col("level") == base + k, F.struct("idx", "hash"))
        # a row of two numbers for each block, of which none but those asked of are gathered
        near = levels.join(F.broadcast(asked.select("segment", "block")), ["segment", "block"], "left_semi")
        nodes = near.groupBy("segment", "block").agg(*[F.sort_array(F.collect_list(at(k))).alias(f"level_{k}") for k in range(tier)])
        found = asked.join(nodes, ["segment", "block"], "left")
        if above is not None:
            found = found.join(above, ["segment", "block"], "left")

        def way(start: Column, base: int = base, above: DataFrame | None = above) -> Column:
            steps = []
            for k in range(tier):
                beside = F.shiftright(start, k).bitwiseXOR(F.lit(1).cast("long"))
                node = F.get(F.col(f"level_{k}"), (beside - F.shiftleft("block", tier - k)).cast("int"))
                steps.append(F.when(node.isNotNull(), F.struct(F.lit(base + k).alias("level"), (beside % 2 == 0).alias("on_left"), node["hash"].alias("hash"))))
            own = F.filter(F.array(*steps), lambda s: s.isNotNull())
            return own if above is None else F.concat(own, F.coalesce("on", F.array().cast(above.schema["on"].dataType)))

        ways = F.transform("asked", lambda a: F.struct(*([a["place"].alias("block")] if base else [a["row"].alias("row")]), way(a["place"]).alias("on")))
        above = found.select("segment", F.inline(ways))
    made = above.select("segment", "row.*", F.col("on").alias("proof"))
    return made.select(*[F.col(f"`{c}`") for c in entries.columns], "proof")


def root_of(entry_hash: Column, proof: Column) -> Column:
    """The root that an entry's hash and its proof lead to."""
    node = lambda left, right: F.sha2(F.concat(F.lit("node|"), left, right), 256)
    return F.aggregate(proof, _leaf(entry_hash), lambda h, s: F.when(s["on_left"], node(s["hash"], h)).otherwise(node(h, s["hash"])))
