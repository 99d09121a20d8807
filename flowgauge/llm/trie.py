"""The prefix trie of conversations, by partition refinement.

All conversations start in one class, the root. Each round splits the classes
that are still active by their next turn; a class of one distinct sequence of
turns is retired, and what is left of it becomes a unary chain at once. Totals
of subtrees are then folded back, from the deepest round to the root.

Equal conversations are one sequence with a weight from the start, so that
neither a group of copies nor a conversation repeated without end is refined
more than once, and rounds end where distinct sequences part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import written
from flowgauge.operators.tables import running

#: Ids that are joined to one piece of text before they go on to be hashed.
PIECE = 20_000
PIECES = "fp string, len long, total long, first long, n long, text string"
SEQUENCES = "conv long, len long, total long, m long, ends string"
NOTHING = hashlib.sha256().hexdigest()


def turn_key(role: Column, text: Column) -> Column:
    """The SHA-256 of a turn, 32 bytes; null is empty."""
    role, text = (F.coalesce(c, F.lit("")) for c in (role, text))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one sequence's conversations, sorted, as pieces of text."""
    for b in batches:
        for k in range(0, b.num_rows, PIECE):
            part = b.slice(k, PIECE)
            columns = [part.column(part.schema.get_field_index(c)).to_pylist() for c in ("fp", "len", "total", "conv")]
            out = []
            for (fp, size, total), run in groupby(zip(*columns), key=lambda r: r[:3]):
                ids = [r[3] for r in run]
                out.append((fp, size, total, ids[0], len(ids), ",".join(map(str, ids))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                names=["fp", "len", "total", "first", "n", "text"],
            )


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each sequence from its sorted pieces: its smallest conversation, their number, and their hash."""
    at, first, m, digest, done = None, None, 0, None, []

    def rows() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=["conv", "len", "total", "m", "ends"])

    for b in batches:
        for fp, size, total, start, n, text in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("fp", "len", "total", "first", "n", "text"))):
            if at is None or fp != at[0]:
                if at is not None:
                    done.append((first, *at[1:], m, digest.hexdigest()))
                at, first, m, digest = (fp, size, total), start, 0, hashlib.sha256()
            elif m:
                digest.update(b",")
            digest.update(text.encode())
            m += n
        if done:
            yield rows()
            done = []
    if at is not None:
        done.append((first, *at[1:], m, digest.hexdigest()))
        yield rows()


def distinct_sequences(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """``(conv, len, total, m, ends)``: each distinct sequence of turns under its smallest conversation.

    ``m`` conversations have it, and ``ends`` is the SHA-256 of their ids in
    order, joined by commas. Sequences are equal where sums of two 64-bit hashes
    of (place, turn) and their numbers of turns are. A sequence of very many
    conversations is cut into ranges of ids, each joined to pieces of text;
    hashing the pieces one after another is all that one task does.
    """
    spark = steps.sparkSession
    wide = lambda *c: F.xxhash64(*c).cast("decimal(20,0)")
    none = convs.select(F.col("conv_id").alias("conv"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("bytes"))
    each = steps.select(F.col("conv_id").alias("conv"), "pos", "key", "bytes").unionByName(none).groupBy("conv").agg(
        F.count("pos").alias("len"),
        F.sum("bytes").alias("total"),
        F.sum(F.when(F.col("pos").isNotNull(), wide("pos", "key"))).alias("a"),
        F.sum(F.when(F.col("pos").isNotNull(), wide("key", "pos", F.lit(1)))).alias("b"),
    )
    fp = F.concat_ws("/", F.col("len").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))
    known = written(each.select("conv", "len", "total", fp.alias("fp")), "conversations")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = known.repartitionByRange(parts, "fp", "conv").sortWithinPartitions("fp", "conv").mapInArrow(_pieces, PIECES)
    return written(pieces.repartition("fp").sortWithinPartitions("fp", "first").mapInArrow(_sequences, SEQUENCES), "sequences")


def prefix_trie(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``steps(conv_id, pos, key, bytes)``, places counted from 1, over the conversations ``convs(conv_id)``.

    Ids are distinct longs; a conversation without steps ends at the root.
    Returns ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256)``: a node is known by its smallest conversation
    and its depth; ``saved_tokens`` adds up (n_convs - 1) times the bytes of the
    last turn over its subtree, and ``ends_sha256`` hashes the ids of the
    conversations that end there. No conversations give no nodes.

    A round is a join and two aggregations by (class, turn), all with partial
    steps; there are as many rounds as turns that two distinct sequences share.
    """
    seqs = distinct_sequences(steps, convs)
    # each distinct sequence's turns once, sorted by place: a round reads the row groups of its own
    turns = written(
        steps.withColumnRenamed("conv_id", "conv").join(seqs.select("conv"), "conv").repartitionByRange("pos", "conv").sortWithinPartitions("pos", "conv"), "turns"
    )
    own = ("conv", "len", "total", "m", "ends")
    every = seqs.agg(F.min("conv").alias("top"), F.count("*").alias("n_seqs"), F.sum("m").alias("n_convs"), F.max(F.when(F.col("len") == 0, F.col("ends"))).alias("here")).first()
    columns = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not every["n_seqs"]:
        return steps.sparkSession.createDataFrame([], columns)
    alone = every["n_seqs"] == 1
    members = seqs.select(
        *own,
        F.lit(every["top"]).alias("class"),
        F.lit(None).cast("long").alias("parent"),
        F.lit(every["n_seqs"]).alias("n_seqs"),
        F.lit(every["n_convs"]).alias("n_convs"),
        F.lit(every["here"]).cast("string").alias("here"),
        F.lit(0).cast("long").alias("bytes"),
        F.lit(0).cast("long").alias("upto"),
    )
    levels = [members]
    while not alone:
        depth = len(levels)
        active = levels[-1].filter((F.col("n_seqs") > 1) & (F.col("len") >= depth)).select(*own, F.col("class").alias("parent"), "upto")
        if active.isEmpty():
            break
        step = active.join(turns.filter(F.col("pos") == depth).select("conv", "key", "bytes"), "conv")
        classes = step.groupBy("parent", "key").agg(
            F.min("conv").alias("class"),
            F.count("*").alias("n_seqs"),
            F.sum("m").alias("n_convs"),
            F.max(F.when(F.col("len") == depth, F.col("ends"))).alias("here"),
        )
        split = step.join(written(classes, "classes"), ["parent", "key"])
        levels.append(written(split.select(*levels[0].columns[:-1], (F.col("upto") + F.col("bytes")).alias("upto")), "split"))

    tail = F.col("total") - F.col("upto")
    retired = F.col("n_seqs") == 1
    folded, below = [], None
    for depth in range(len(levels) - 1, -1, -1):
        nodes = levels[depth].filter(F.col("conv") == F.col("class"))
        own_saved = (F.col("n_convs") - 1) * F.col("bytes")
        if below is None:
            nodes = nodes.withColumns({c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")})
        else:
            nodes = nodes.join(below, "class", "left")
        level = nodes.select(
            F.col("class").alias("conv_id"),
            F.lit(depth).cast("long").alias("depth"),
            F.col("parent").alias("parent_conv_id"),
            "n_convs",
            F.when(retired, (F.col("len") > depth).cast("long")).otherwise(F.col("children")).alias("n_children"),
            F.when(retired, F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("n_leaves"),
            (own_saved + F.when(retired, (F.col("m") - 1) * tail).otherwise(F.col("saved"))).alias("saved_tokens"),
            F.coalesce("here", F.lit(NOTHING)).alias("ends_sha256"),
        )
        folded.append(written(level, "folded") if depth else level)
        sums = (F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        below = folded[-1].groupBy(F.col("parent_conv_id").alias("class")).agg(*sums)

    # the tails of retired classes: one distinct sequence each, so that no turn of them is shared but by copies
    left = [lv.filter(retired & (F.col("len") > d)).select("conv", "len", "m", "ends", F.lit(d).cast("long").alias("from")) for d, lv in enumerate(levels)]
    tails = left[0]
    for t in left[1:]:
        tails = tails.unionByName(t)
    chain = turns.join(written(tails, "tails"), "conv").filter("pos > from")
    copied = chain.filter("m > 1").select("conv", "pos", "bytes", "len", "m", "ends")
    back = running(copied, {"rest": F.col("bytes")}, [F.desc("pos")], "conv", 0).withColumn("saved", (F.col("m") - 1) * F.col("rest")).drop("rest")
    single = chain.filter("m = 1").select(*copied.columns).withColumn("saved", F.lit(0).cast("long"))
    unary = single.unionByName(back).select(
        F.col("conv").alias("conv_id"),
        F.col("pos").cast("long").alias("depth"),
        F.col("conv").alias("parent_conv_id"),
        F.col("m").alias("n_convs"),
        (F.col("pos") < F.col("len")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.when(F.col("pos") == F.col("len"), F.col("ends")).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )
    for level in folded:
        unary = unary.unionByName(level)
    return unary
