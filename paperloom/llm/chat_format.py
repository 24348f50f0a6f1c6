"""Chat formatting with typed content parts, in DataFrame functions only.

The template writes each turn as ``<|turn|>role``, a line break, the flattened content
and ``<|end|>`` with a line break.  Inside roles and texts ``&``, ``<``, ``[`` become
entities (and a line break in a role), so no control string of this template, nor of
others that bracket theirs with these signs, can occur in content; reading reverses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.binding import let

TURN, END, BREAK = "<|turn|>", "<|end|>", "\n"
# The order matters, the escape sign itself goes first.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
ROLE_BREAK = (BREAK, "&br;")
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TILE, TOKENS_PER_TILE, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 1, 25, 600


def escape(text: Column, role: bool = False) -> Column:
    for plain, entity in (*ENTITIES, *([ROLE_BREAK] if role else [])):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for plain, entity in reversed((*ENTITIES, *([ROLE_BREAK] if role else []))):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def text_parts(text: Column) -> Column:
    """A plain text as a list of one typed part."""
    null = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in null.items()]))


def part_tokens(part: Column) -> Column:
    """Tokens an attachment expands to: tiles of an image, seconds of audio, pages of a document."""
    def tiles(side: Column) -> Column:
        return F.ceil(F.coalesce(side, F.lit(0)) / F.lit(TILE))

    return (
        F.when(part.kind == "image", F.greatest(tiles(part.width) * tiles(part.height), F.lit(1)) * TOKENS_PER_TILE)
        .when(part.kind == "audio", F.greatest(F.ceil(F.coalesce(part.seconds, F.lit(0.0)) * TOKENS_PER_SECOND), F.lit(1)))
        .when(part.kind == "document", F.greatest(F.coalesce(part.pages, F.lit(1)), F.lit(1)) * TOKENS_PER_PAGE)
        .otherwise(F.lit(0))
        .cast("long")
    )


def visit(parts: Column) -> tuple[Column, Column]:
    """Flatten typed parts in order: the escaped text with a placeholder per attachment, and the attachments.

    A placeholder names its kind and its number within the turn; an attachment records
    its reference and expanded tokens.  A part of unknown kind is kept as a placeholder
    of that (escaped) kind; a null part, text or list is empty.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    marked = F.transform(parts, lambda p, i: F.struct(p.alias("part"), F.when(p.kind == "text", F.lit(0)).otherwise(F.size(F.filter(F.slice(parts, 1, i + 1), lambda q: ~q.kind.eqNullSafe(F.lit("text"))))).alias("n")))
    body = F.array_join(F.transform(marked, lambda m: F.when(m.part.kind == "text", escape(F.coalesce(m.part.text, F.lit("")))).otherwise(
        F.concat(F.lit("<|"), escape(F.coalesce(m.part.kind, F.lit("unknown")), role=True), F.lit("_"), m.n.cast("string"), F.lit("|>")))), "")
    attached = F.transform(F.filter(marked, lambda m: ~m.part.kind.eqNullSafe(F.lit("text"))), lambda m: F.struct(
        m.n.alias("n"), m.part.kind.alias("kind"), m.part.ref.alias("ref"), part_tokens(m.part).alias("tokens")))
    return body, attached


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", trained: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, mask, attachments, expanded_tokens``.

    ``mask`` lists the stretches of ``formatted`` under the loss as (start, length) in
    code points from 0: the content of every turn of the ``trained`` role.  Rows are
    ordered by turn (null first), ties by role and content, and none is dropped; null
    roles are empty; null conversation ids form a conversation of their own; an empty
    table gives an empty one.  One shuffle, by conversation: a conversation is a single
    text in the end, so its rows meet in one task.
    """
    body, attached = visit(F.col(f"`{parts}`"))
    head = F.concat(F.lit(TURN), escape(F.coalesce(F.col(f"`{role}`"), F.lit("")), role=True), F.lit(BREAK))
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), head.alias("head"), body.alias("body"), attached.alias("attached"),
        (F.col(f"`{role}`") == trained).alias("loss"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "head", "body")
    length = F.length("head") + F.length("body") + F.lit(len(END) + len(BREAK))
    placed = rows.withColumn("n", F.row_number().over(order)).withColumn(
        "start", F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head"))
    piece = F.struct("n", F.concat("head", "body", F.lit(END + BREAK)).alias("piece"), F.when(F.col("loss"), F.struct("start", F.length("body").cast("long").alias("length"))).alias("span"), "attached")
    one = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("rows"))
    attachments = F.flatten(F.transform("rows", lambda r: F.transform(r.attached, lambda a: F.struct(r.n.alias("turn_number"), a.n.alias("n"), a.kind.alias("kind"), a.ref.alias("ref"), a.tokens.alias("tokens")))))
    return one.select(
        "conv_id", F.array_join(F.transform("rows", lambda r: r.piece), "").alias("formatted"),
        F.filter(F.transform("rows", lambda r: r.span), lambda s: s.isNotNull()).alias("mask"), attachments.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda t, a: t + a.tokens))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as (role, text), with escapes undone; placeholders stay in the text."""
    def turn(piece: Column) -> Column:
        return let(F.locate(BREAK, piece), lambda at: F.struct(
            unescape(F.substring(piece, F.lit(1), at - 1), role=True).alias("role"),
            unescape(F.substring(piece, at + 1, F.length(piece) - at - len(END) - len(BREAK))).alias("text")))

    return F.transform(F.filter(F.split(formatted, r"<\|turn\|>"), lambda piece, i: i > 0), turn)


def read_masked(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order and with nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), s.length.cast("int")))), "")
