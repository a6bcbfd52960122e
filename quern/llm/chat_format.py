"""Chat formatting with column functions only.

A conversation's turns become one string.  Each turn is
``<|im_start|>role LF content<|im_end|> LF``.  Content is a list of typed parts; the
visitor writes text parts as they are (escaped) and puts an ordered placeholder
for image, audio and document parts, whose references and expanded token counts go
into ``attachments``.  ``loss`` holds the code-point ranges of the trained turns.

Escaping: every ``<|`` of a text gets a bar more (``<||``).  A control string
begins with ``<|`` and a letter, so none can come from a text, and taking the bar
away again gives every text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>", "\n"
#: Line feeds in role names, which would end the header line.
ROLE_LINE = "<|lf|>"
#: Tokens one unit of an attachment expands to: an image tile, a second of audio, a page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
PARTS = "array<struct<type:string,text:string,ref:string,units:int>>"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def _placeholder(kind: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("<|"), kind, F.lit(":"), ordinal.cast("string"), F.lit("|>"))


def text_parts(text: Column) -> Column:
    """A plain text as the one part of a turn; null is an empty text."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).alias("units")))


def format_chats(df: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, trained: tuple[str, ...] = ("assistant",), unit_tokens: dict[str, int] | None = None) -> DataFrame:
    """One row a conversation: conv_id, formatted, loss, attachments.

    ``parts`` names a column of type ``PARTS``; without it ``text`` is the content.
    Turns are put in order by turn, then role and content, so repeated rows have a
    defined place.  Null roles and texts are empty ones, null part lists have no part,
    parts of an unknown type are texts.  ``loss`` is array<struct<start, length>> in
    code points from 0; ``attachments`` is array<struct<place, turn, type, ref, tokens>>.
    """
    units = UNIT_TOKENS | (unit_tokens or {})
    content = F.coalesce(F.col(f"`{parts}`").cast(PARTS), F.array().cast(PARTS)) if parts else text_parts(F.col(f"`{text}`"))
    src = df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), content.alias("parts"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    attached = F.filter("parts", lambda p: p["type"].isin(*units))
    src = src.withColumn("n_attached", F.size(attached).cast("long"))
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    src = src.withColumn("before", F.coalesce(F.sum("n_attached").over(so_far), F.lit(0).cast("long"))).withColumn("place", F.row_number().over(order))
    # ordinals of a turn's attachments: those of the turns before, then its own in order
    refs = F.transform(
        attached,
        lambda p, i: F.struct(
            (F.col("before") + i).cast("long").alias("ordinal"), F.col("place").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"),
            (F.coalesce(p["units"], F.lit(0)) * F.element_at(F.create_map(*[F.lit(x) for kv in units.items() for x in kv]), p["type"])).cast("long").alias("tokens"),
        ),
    )

    def visit(acc: Column, p: Column) -> Column:
        """One part more; a bar behind a text that ends in < is escaped as in one text."""
        plain = F.coalesce(p["text"], F.lit(""))
        seam = F.when(F.endswith(acc["body"], F.lit("<")) & F.startswith(plain, F.lit("|")), F.lit("|")).otherwise(F.lit(""))
        placed = p["type"].isin(*units)
        piece = F.when(placed, _placeholder(p["type"], acc["n"])).otherwise(F.concat(seam, escape(plain)))
        return F.struct(F.concat(acc["body"], piece).alias("body"), (acc["n"] + F.when(placed, 1).otherwise(0)).alias("n"))

    body = F.aggregate("parts", F.struct(F.lit("").alias("body"), F.col("before").alias("n")), visit, lambda acc: acc["body"])
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit(LINE), F.lit(ROLE_LINE)), F.lit(LINE))
    src = src.select("conv_id", "place", refs.alias("refs"), F.col("role").isin(*trained).alias("in_loss"), head.alias("head"), body.alias("body"))
    src = src.withColumn("size", F.length("head") + F.length("body") + F.lit(len(END + LINE)))
    by_place = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    src = src.withColumn("at", F.coalesce(F.sum("size").over(by_place), F.lit(0).cast("long")))
    one = F.struct(
        "place", F.concat("head", "body", F.lit(END + LINE)).alias("piece"), "refs",
        F.when(F.col("in_loss"), F.struct((F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))).alias("loss"),
    )
    turns = src.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    return turns.select(
        "conv_id",
        F.array_join(F.col("t.piece"), "").alias("formatted"),
        F.filter(F.col("t.loss"), lambda x: x.isNotNull()).alias("loss"),
        F.transform(F.flatten(F.col("t.refs")), lambda r: F.struct(r["ordinal"].alias("place"), r["turn"].alias("turn"), r["type"].alias("type"), r["ref"].alias("ref"), r["tokens"].alias("tokens"))).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """Turns of a formatted string: array<struct<role, text>>, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")
    body = F.transform(pieces, lambda x: F.substring(x, len(START) + 1, 2**31 - 1))
    cut = lambda x: F.locate(LINE, x)
    return F.transform(
        body,
        lambda x: F.struct(
            unescape(F.replace(F.substring(x, F.lit(1), cut(x) - 1), F.lit(ROLE_LINE), F.lit(LINE))).alias("role"),
            unescape(F.substring(x, cut(x) + 1, F.lit(2**31 - 1))).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the mask, unescaped, without anything between the ranges."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def chat_digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from the formatted rows."""
    back = formatted.withColumns({"turns": read_turns(F.col("formatted")), "trained": read_loss(F.col("formatted"), F.col("loss"))})
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
