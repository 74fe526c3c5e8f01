"""Chat formatting with typed content parts, in DataFrame operations only.

A turn is a role and an array of parts: text, image, audio or document.  The visitor walks the
parts in order: text is escaped, any other part becomes a numbered placeholder, and its
reference and the tokens it stands for are recorded.  Turns are marked, and what a model is
trained on is given as spans of code points.

Every ``<``, ``[`` and ``&`` of a text or role is written as an entity, so no control string (the
template's own or another's) can occur inside one; reading back undoes it.  Nulls: a null role or
text is empty, a null part is skipped, a turn without parts is empty, turns with a null number
come first, and a null conversation id is a conversation of its own.  Turns of equal number are
ordered by role and content; repeated rows stay.  Texts of any length are kept whole; an empty table gives no
rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
OPEN, BREAK, CLOSE = "<|turn|>", "<|says|>", "<|end|>\n"
# Fixed at both ends, so that undoing in reverse order gives the text back.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """A content array that holds one text part."""
    none = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("type"), text.cast("string").alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"),
            none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages"),
        )
    ).cast(f"array<{PART}>")


def part_tokens(part: Column, patch: int, audio_rate: float, page_tokens: int) -> Column:
    """Tokens that a placeholder expands to: image patches, audio frames, document pages."""
    side = lambda x: F.ceil(F.coalesce(x, F.lit(0)) / F.lit(float(patch)))
    return (
        F.when(part["type"] == "image", side(part["width"]) * side(part["height"]))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * F.lit(float(audio_rate))))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)) * F.lit(page_tokens))
        .otherwise(F.lit(0))
        .cast("long")
    )


def format_chats(
    turns: DataFrame, *, trained: str = "assistant", patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 1024
) -> DataFrame:
    """``turns(conv_id, turn, role, parts)`` to one row per conversation.

    Columns: ``conv_id, n_turns, formatted``, ``loss_spans`` (start and length in code points of
    each trained text in ``formatted``) and ``attachments`` (place, type, reference, tokens; the
    place numbers the placeholders of the conversation).  A conversation is one output string, so
    its turns meet in one task; one shuffle serves the running sums and the collection.
    """
    empty = F.array().cast(f"array<{PART}>")
    parts = F.filter(F.coalesce(F.col("parts").cast(f"array<{PART}>"), empty), lambda p: p.isNotNull())
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), parts.alias("parts"),
    )
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    others = lambda a: F.filter(a, lambda p: ~is_text(p))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", F.to_json("parts"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("files", others(F.col("parts"))).withColumn("number", F.row_number().over(order))
    rows = rows.withColumn("first", F.sum(F.size("files")).over(so_far) - F.size("files"))
    place = lambda k: F.col("first") + F.size(others(F.slice("parts", 1, k)))
    shown = F.transform(
        "parts",
        lambda p, k: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<|"), escape(p["type"]), F.lit(":"), place(k).cast("string"), F.lit("|>"))
        ),
    )
    rows = rows.withColumn("body", F.array_join(shown, "")).withColumn("shown_role", escape(F.col("role")))
    rows = rows.withColumn("piece", F.concat(F.lit(OPEN), "shown_role", F.lit(BREAK), "body", F.lit(CLOSE)))
    rows = rows.withColumn("begin", F.sum(F.char_length("piece")).over(so_far) - F.char_length("piece"))
    start = F.col("begin") + F.lit(len(OPEN) + len(BREAK)) + F.char_length("shown_role")
    span = F.struct(start.cast("long").alias("start"), F.char_length("body").cast("long").alias("length"))
    attached = F.transform(
        "files",
        lambda p, i: F.struct(
            (F.col("first") + i).cast("long").alias("place"), p["type"].alias("type"), p["ref"].alias("ref"),
            part_tokens(p, patch, audio_rate, page_tokens).alias("tokens"),
        ),
    )
    kept = F.struct("number", "piece", F.when(F.col("role") == trained, span).alias("span"), attached.alias("attached"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(kept)).alias("turns"))
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.piece", "").alias("formatted"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"), F.flatten("turns.attached").alias("attachments"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns(role, text), loss_text, formatted`` from the formatted string and its spans.

    Spans are cut from the string in UTF-32, where a code point's place is known, so reading is
    linear in the length of the conversation.
    """
    pieces = F.filter(F.split("formatted", r"<\|turn\|>"), lambda s: s != "")
    turns = F.transform(
        pieces,
        lambda s: F.struct(
            unescape(F.split_part(s, F.lit(BREAK), F.lit(1))).alias("role"),
            unescape(F.regexp_replace(F.split_part(s, F.lit(BREAK), F.lit(2)), r"<\|end\|>\n$", "")).alias("text"),
        ),
    )
    wide = formatted.withColumn("wide", F.encode("formatted", "UTF-32"))
    loss = F.expr("array_join(transform(loss_spans, s -> decode(substring(wide, cast(4 * s.start + 1 as int), cast(4 * s.length as int)), 'UTF-32')), '')")
    return wide.select("conv_id", turns.alias("turns"), unescape(loss).alias("loss_text"), "formatted")
