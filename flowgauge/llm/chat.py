"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is a list of typed parts. Text stays text; images, audio and
documents become ordered placeholders, recorded with their reference and the
number of tokens that they expand to. The template marks turns with control
strings, which texts can never contain: they are escaped reversibly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
#: Tokens that an attachment expands to: an image's by tiles of so many pixels and a base, audio's by second, a document's by page.
IMAGE_TILE, IMAGE_TILE_TOKENS, IMAGE_BASE_TOKENS = 512, 170, 85
AUDIO_TOKENS_A_SECOND, PAGE_TOKENS = 25, 500


def escape(text: Column) -> Column:
    """Doubles backslashes and parts ``<|`` by one, so that no control string is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Undoes ``escape``: after it, a single backslash stands between ``<`` and ``|`` only where it was put."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """One text part of a plain text; null is empty."""
    nothing = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    fields = [F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text")]
    return F.array(F.struct(*fields, *[F.lit(None).cast(t).alias(n) for n, t in nothing.items()])).cast(PARTS)


def _tokens(part: Column) -> Column:
    tiles = F.ceil(F.greatest(part["width"], F.lit(1)) / IMAGE_TILE) * F.ceil(F.greatest(part["height"], F.lit(1)) / IMAGE_TILE)
    count = (
        F.when(part["type"] == "image", IMAGE_BASE_TOKENS + IMAGE_TILE_TOKENS * tiles)
        .when(part["type"] == "audio", F.ceil(F.greatest(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS_A_SECOND))
        .when(part["type"] == "document", F.greatest(part["pages"], F.lit(0)) * PAGE_TOKENS)
    )
    return F.coalesce(count, F.lit(0)).cast("long")


def flatten_parts(parts: Column) -> tuple[Column, Column]:
    """Visits a turn's parts in order: the escaped content, and its attachments.

    The k-th attachment of a turn (from 1) becomes ``<|type:k|>``; attachments
    are ``(number, type, ref, tokens)``. Parts of other types, or of none, count
    as text; a null text is empty, and so are null parts.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull())
    is_file = lambda p: F.coalesce(p["type"].isin("image", "audio", "document"), F.lit(False))
    files = F.transform(
        F.filter(parts, is_file),
        lambda p, k: F.struct((k + 1).alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens")),
    )
    # the places of attachments, found once: the k-th attachment is at the k-th place
    places = F.filter(F.transform(parts, lambda p, k: F.when(is_file(p), k)), lambda k: k.isNotNull())
    visit = lambda p, k: F.when(
        is_file(p), F.concat(F.lit("<|"), p["type"], F.lit(":"), F.array_position(places, k).cast("string"), F.lit("|>"))
    ).otherwise(escape(F.coalesce(p["text"], F.lit(""))))
    return F.array_join(F.transform(parts, visit), ""), files


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``turns(conv_id, turn, role, parts)`` to a row per conversation.

    ``formatted`` is, for each turn by (turn, role, content), the start mark,
    the role (percent-encoded), a new line, the content, the end mark and a new
    line. ``loss_mask`` has the (start, length) of each content of
    ``loss_role`` in it, in code points; ``attachments`` the turn's position,
    number, type, reference and expanded tokens; ``expanded_tokens`` their sum.
    A null role is empty, a null turn comes first, and repeated rows are
    repeated turns; null conv_ids are one conversation. Other columns are not
    read. A conversation becomes one row, so its turns meet in one task.
    """
    content, files = flatten_parts(F.col("parts"))
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(START), F.url_encode(role), F.lit("\n"))
    rows = turns.select(
        "conv_id", "turn", role.alias("role"), head.alias("head"), content.alias("content"), files.alias("files")
    ).withColumn("length", F.length("head") + F.length("content") + len(END) + 1)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("number", F.row_number().over(order)).withColumn("start", before + F.length("head"))
    packed = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("number", "start", "role", "head", "content", "files"))).alias("all")
    )
    every = F.col("all")
    mask = F.transform(
        F.filter(every, lambda t: t["role"] == loss_role),
        lambda t: F.struct(t["start"].cast("long").alias("start"), F.length(t["content"]).cast("long").alias("length")),
    )
    attached = F.flatten(
        F.transform(
            every,
            lambda t: F.transform(
                t["files"],
                lambda f: F.struct(
                    t["number"].alias("turn"), f["number"].alias("number"), f["type"].alias("type"), f["ref"].alias("ref"), f["tokens"].alias("tokens")
                ),
            ),
        )
    )
    return packed.select(
        "conv_id",
        F.array_join(F.transform(every, lambda t: F.concat(t["head"], t["content"], F.lit(END + "\n"))), "").alias("formatted"),
        mask.alias("loss_mask"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda n, f: n + f["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, ``array<struct<role, text>>``, unescaped."""
    pieces = F.filter(F.split(formatted, F.lit(r"\Q" + START + r"\E")), lambda x: x != "")
    return F.transform(
        pieces,
        lambda x: F.struct(
            F.url_decode(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(F.substring(x, F.instr(x, "\n") + 1, F.length(x) - F.instr(x, "\n") - len(END) - 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(
            loss_mask, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))
        ),
        "",
    )
