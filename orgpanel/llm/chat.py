"""Chat formatting with typed content parts.

A turn holds an ordered array of parts (type, text, uri, units). A visitor takes them one by one: a text part
gives its escaped text, an image, audio or document part a placeholder ``<|image|>``, ``<|audio|>`` or ``<|document|>``, an attachment
reference (turn, place, type, uri) and ``units`` times the tokens of its type, at least one unit.

A turn reads ``<|im_start|>role LF parts<|im_end|>LF``. Inside texts and roles every ``<``, backslashes, ``|`` gets one more
backslash before the bar, so no control string can occur there, and taking one backslash away gives back the
text exactly. Roles also write LF as backslash n, and backslash as two.

Beside the text the formatter writes its layout: for each turn the characters before its first part, and for each part its characters, whether they are
under the loss mask (text parts of assistant turns), and its attachment, if it has one. The way back cuts the text by the layout alone, so typed parts come back
as they were, and a text that reads like a placeholder stays a text.

A conversation is one record: its turns meet in one row, whatever else is in
the table, and conversations are dealt by conv_id. Only DataFrame and SQL functions are used.

Edge cases: null role, text or parts are empty; a null part or type is an attachment without a type; a null turn comes first; equal turns go by role and text; repeated
rows are turns of their own; null conv_ids form one conversation; unknown part types have the placeholder of
documents and come back as they were; very long texts are one string each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatConfig:
    image_tokens: int = 256
    audio_tokens: int = 50
    document_tokens: int = 512


PART = "array<struct<type:string,text:string,uri:string,units:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*+)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    pieces = F.transform(F.split(unescape(role), r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(pieces, "\\")


def text_parts(text: Column) -> Column:
    """A turn with nothing but a text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("bigint").alias("units"))).cast(PART)


def format_chats(turns: DataFrame, cfg: ChatConfig = ChatConfig()) -> DataFrame:
    """One row for each conversation: conv_id, formatted, layout, attachments, media_tokens.

    ``turns`` has conv_id, turn, role and parts (an array of type, text, uri, units). layout is an array by turn of
    (header, parts: array of (chars, loss, attachment)), where attachment is a place in attachments or null.
    """
    parts = F.coalesce(F.col("parts").cast(PART), F.array().cast(PART))
    seen = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))

    def piece(p: Column, place: Column) -> Column:
        kind = F.when(p["type"] == "text", "text").when(p["type"].isin("image", "audio"), p["type"]).otherwise("document")
        each = F.when(kind == "image", cfg.image_tokens).when(kind == "audio", cfg.audio_tokens).otherwise(cfg.document_tokens)
        written = F.when(kind == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>")))
        tokens = F.when(kind != "text", each * F.greatest(F.coalesce(p["units"], F.lit(1)), F.lit(1))).cast("long")
        return F.struct(written.alias("s"), kind.alias("kind"), p["type"].alias("type"), p["uri"].alias("uri"), p["units"].alias("units"), place.cast("int").alias("place"), tokens.alias("tokens"))

    made = seen.select("conv_id", "turn", "role", F.transform("parts", piece).alias("pieces"))
    body = F.array_join(F.transform("pieces", lambda p: p["s"]), "")
    one = made.select("conv_id", F.struct("turn", "role", body.alias("body"), "pieces").alias("t"))
    # a turn's text must not reach over its own end, so equal turns sort by what follows
    chats = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    written = F.array_join(F.transform("t", lambda t: F.concat(F.lit("<|im_start|>"), escape_role(t["role"]), F.lit("\n"), t["body"], F.lit("<|im_end|>\n"))), "")
    attached = F.expr("flatten(transform(t, (x, k) -> transform(filter(x.pieces, p -> p.kind != 'text'), p -> named_struct('turn', x.turn, 'place', p.place, 'type', p.type, 'uri', p.uri, 'units', p.units, 'tokens', p.tokens))))")
    own = "p -> named_struct('chars', length(p.s), 'loss', p.kind = 'text' and x.role = 'assistant', 'media', p.kind != 'text')"
    header = F.transform("t", lambda t: F.length(escape_role(t["role"])) + F.length(F.lit("<|im_start|>\n")))
    layout = F.arrays_zip(header.alias("header"), F.expr(f"transform(t, x -> transform(x.pieces, {own}))").alias("parts"))
    out = chats.select("conv_id", written.alias("formatted"), layout.alias("layout"), attached.alias("attachments"))
    return out.withColumn("media_tokens", F.expr("aggregate(attachments, 0L, (a, x) -> a + x.tokens)"))


def read_chats(chats: DataFrame) -> DataFrame:
    """The rows with ``turns`` (role, text, loss, parts) read back from ``formatted``, ``layout`` and ``attachments``.

    text is that of the text parts and the placeholders, loss what is under the mask, parts those that were formatted (texts null were empty).
    """
    whole = F.split("formatted", r"<\|im_end\|>\n", -1)
    cut = F.slice(whole, 1, F.size(whole) - 1)
    start = F.length(F.lit("<|im_start|>"))

    def turn(s: Column, plan: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(plan["parts"], F.lit(1), i), plan["header"], lambda a, p: a + p["chars"])
        own = F.transform(plan["parts"], lambda p, i: F.struct(F.substring(s, before(i) + 1, p["chars"]).alias("s"), p["loss"].alias("loss"), p["media"].alias("media")))
        return F.struct(unescape_role(F.substring(s, start + 1, plan["header"] - start - 1)).alias("role"), own.alias("own"))

    read = chats.withColumn("_read", F.zip_with(cut, "layout", turn))
    # how many attachments come before each turn
    read = read.withColumn("_sizes", F.expr("transform(layout, x -> size(filter(x.parts, p -> p.media)))"))
    text = lambda p: F.when(p["media"], p["s"]).otherwise(unescape(p["s"]))

    def parts(x: Column, k: Column) -> Column:
        first = F.aggregate(F.slice("_sizes", F.lit(1), k), F.lit(0), lambda a, n: a + n)

        def part(p: Column, i: Column) -> Column:
            earlier = F.size(F.filter(F.slice(x["own"], F.lit(1), i), lambda q: q["media"]))
            at = F.get(F.col("attachments"), first + earlier)
            plain = F.struct(F.lit("text").alias("type"), unescape(p["s"]).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("long").alias("units"))
            other = F.struct(at["type"].alias("type"), F.lit(None).cast("string").alias("text"), at["uri"].alias("uri"), at["units"].alias("units"))
            return F.when(p["media"], other).otherwise(plain)

        return F.transform(x["own"], part)

    made = F.transform(
        "_read",
        lambda x, k: F.struct(
            x["role"].alias("role"), F.array_join(F.transform(x["own"], text), "").alias("text"),
            F.array_join(F.transform(F.filter(x["own"], lambda p: p["loss"]), text), "").alias("loss"), parts(x, k).alias("parts"),
        ),
    )
    return read.withColumn("turns", made).drop("_read", "_sizes")


def chat_digests(turns: DataFrame, cfg: ChatConfig = ChatConfig()) -> DataFrame:
    """The contract of op4 over a table (conv_id, turn, role, text), read back from the formatted texts and their mask."""
    made = format_chats(turns.select("conv_id", "turn", "role", text_parts(F.coalesce("text", F.lit(""))).alias("parts")), cfg)
    read = read_chats(made.select("conv_id", "formatted", "layout", "attachments"))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: t["loss"]), "")
    out = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every.cast("binary"), 256).alias("turns_sha256"), loss.alias("loss"), "formatted")
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
