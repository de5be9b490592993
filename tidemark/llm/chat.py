"""Chat formatting as DataFrame expressions: typed parts, reversible escapes, a loss mask.

A message is a row of (conversation, turn, role, parts); a part is a struct of type, text, ref, width, height,
seconds, pages. The visitor keeps parts in order: texts are escaped, an image, audio clip or document becomes a
placeholder ``<|image|>``, ``<|audio|>`` or ``<|document|>``, and its reference, its place in the formatted string and
the number of tokens it stands for are recorded in the same order, and the tokens added up. Unknown types become ``<|unknown|>`` and stand for one token.

A turn is ``<|role:ROLE|>TEXT<|end|>``. Texts and roles are escaped so that no template mark or other control string
(they all need one of ``< > [``) can appear in them: ``~`` is written ``~0``, ``<`` ``~1``, ``[`` ``~2``, ``>`` ``~3``.

Null texts are empty, null roles are the empty role, null parts no parts. Turns are ordered by turn, ties by role,
then content; null turns come first, repeated rows stay. A null conversation is a conversation of its own. An empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import spans as S

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens: an image one for each square of so many pixels, audio so many a second, documents so many a page.
IMAGE_PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 256
_ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), (">", "~3"))


def escape(x: Column) -> Column:
    for a, b in _ESCAPES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def unescape(x: Column) -> Column:
    for a, b in reversed(_ESCAPES):
        x = F.replace(x, F.lit(b), F.lit(a))
    return x


def text_part(text: Column) -> Column:
    """One text part."""
    null = lambda t: F.lit(None).cast(t)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null("string").alias("ref"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages")))


def _shown(p: Column) -> Column:
    kind = p["type"]
    return (
        F.when(kind == "text", escape(F.coalesce(p["text"], F.lit(""))))
        .when(kind.isin("image", "audio", "document"), F.concat(F.lit("<|"), kind, F.lit("|>")))
        .otherwise(F.lit("<|unknown|>"))
    )


def _tokens(p: Column) -> Column:
    squares = lambda c: F.ceil(F.coalesce(p[c], F.lit(0)) / F.lit(IMAGE_PATCH))
    return (
        F.when(p["type"] == "text", F.lit(0))
        .when(p["type"] == "image", squares("width") * squares("height"))
        .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(0)) * PAGE_TOKENS)
        .otherwise(F.lit(1))
        .cast("long")
    )


def format_chats(messages: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, end in code points of ``formatted``, by turn),
    loss_turns (which turns are under the mask), attachments (turn, type, ref, tokens, place in code points of
    ``formatted``; in order), attachment_tokens.

    One shuffle, on the conversation: the running offset and the grouping use the same partitioning and sort.
    """
    m = messages.select(
        messages["conv_id"].alias("conv_id"),
        messages["turn"].alias("turn"),
        F.coalesce(messages["role"], F.lit("")).alias("role"),
        F.coalesce(messages["parts"], F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    m = m.select(
        "conv_id",
        "turn",
        "role",
        F.concat(F.lit("<|role:"), escape(F.col("role")), F.lit("|>")).alias("head"),
        F.transform("parts", lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens"), _shown(p).alias("shown"))).alias("parts"),
    )
    before = S.sums_before(F.transform("parts", lambda p: F.length(p["shown"])))
    placed = S.let(before, lambda b: F.zip_with("parts", b, lambda p, at: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens"), at.alias("at"))))
    m = m.select(
        "conv_id",
        "turn",
        "role",
        "head",
        F.array_join(F.transform("parts", lambda p: p["shown"]), "").alias("body"),
        F.filter(placed, lambda p: p["type"].isNull() | (p["type"] != "text")).alias("refs"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("tokens"),
    )
    tail = "<|end|>"
    order = W.partitionBy("conv_id").orderBy("turn", "role", "body", F.to_json("refs"))
    size = F.length("head") + F.length("body") + F.lit(len(tail))
    m = m.withColumn("no", F.row_number().over(order)).withColumn("upto", F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0)))
    m = m.withColumn("stop", F.col("upto") - F.lit(len(tail)))
    one = F.struct("no", F.concat("head", "body", F.lit(tail)).alias("piece"), (F.col("role") == learn_role).alias("learn"), (F.col("stop") - F.length("body")).alias("start"), "stop", "refs", "turn")
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"), F.sum("tokens").alias("attachment_tokens"))
    return g.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("end"))).alias("loss_spans"),
        F.transform("t", lambda x: x["learn"]).alias("loss_turns"),
        F.flatten(F.transform("t", lambda x: F.transform(x["refs"], lambda r: F.struct(x["turn"].alias("turn"), r["type"].alias("type"), r["ref"].alias("ref"), r["tokens"].alias("tokens"), (x["start"] + r["at"]).cast("long").alias("place"))))).alias("attachments"),
        "attachment_tokens",
    )


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, read from the formatted string by the mask's spans, unescaped."""
    return F.array_join(F.transform(S.cut(formatted, loss_spans), unescape), "")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped; placeholders stay as they are."""
    pieces = F.split(formatted, r"<\|end\|>")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    role = lambda p: F.substring_index(p, "|>", 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substr(role(p), F.lit(len("<|role:") + 1))).alias("role"),
            unescape(F.substr(p, F.length(role(p)) + F.lit(3))).alias("text"),
        ),
    )
