r"""Chat formatting with typed content parts.

A turn holds ordered parts of type text, image, audio or document. `visit_parts` flattens them
into one text with a placeholder for each attachment and records what each placeholder stands
for and how many tokens it expands to. The template is

    <|im_start|>role\ntext<|im_end|>\n

Control strings inside texts are escaped reversibly: in `<|`, and in `<\|`, `<\\|`, ..., one more
backslash goes between the two characters, so `<|` occurs only where the template wrote it.
Line ends and percent signs of a role are percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.util import let

START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Expansion of attachments: pixels of a square patch, audio tokens a second, tokens a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 576
ATTACHED = ("image", "audio", "document")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def encode_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def decode_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def part_tokens(p: Column) -> Column:
    """Tokens that an attachment expands to; sizes that are not given count as the least."""
    patches = F.ceil(F.coalesce(p["width"], F.lit(PATCH)) / F.lit(PATCH)) * F.ceil(F.coalesce(p["height"], F.lit(PATCH)) / F.lit(PATCH))
    return (
        F.when(p["type"] == "image", patches)
        .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * F.lit(float(AUDIO_RATE))))
        .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(1)) * F.lit(PAGE_TOKENS))
        .otherwise(F.lit(0))
        .cast("long")
    )


def visit_parts(parts: Column) -> Column:
    """struct(content, attachments) of an array of parts: escaped text with placeholders, and what they refer to.

    The texts between two attachments are joined before they are escaped, so a control string that
    is spread over several parts is escaped as well.
    """
    is_attached = lambda p: F.coalesce(p["type"].isin(*ATTACHED), F.lit(False))
    placeholder = lambda p, i: F.concat(F.lit("<|"), p["type"], F.lit(":"), i.cast("string"), F.lit("|>"))
    places = F.filter(F.transform(parts, lambda p, i: F.when(is_attached(p), i)), lambda i: i.isNotNull())

    def joined(places: Column) -> Column:
        before = lambda k: F.coalesce(F.get(places, k - 1), F.lit(-1))
        said = lambda k, end: F.array_join(F.transform(F.slice(parts, before(k) + 2, end - before(k) - 1), lambda p: F.coalesce(p["text"], F.lit(""))), "")
        own = lambda end, k: F.concat(escape(said(k, end)), F.when(end < F.size(parts), placeholder(F.get(parts, end), end)).otherwise(F.lit("")))
        return F.array_join(F.transform(F.concat(places, F.array(F.size(parts))), own), "")

    content = let(places, joined)
    numbered = F.transform(
        parts,
        lambda p, i: F.struct(i.cast("long").alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), placeholder(p, i).alias("placeholder"), part_tokens(p).alias("tokens"), is_attached(p).alias("kept")),
    )
    listed = F.transform(
        F.filter(numbered, lambda a: a["kept"]),
        lambda a: F.struct(a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["placeholder"].alias("placeholder"), a["tokens"].alias("tokens")),
    )
    return F.struct(content.alias("content"), listed.alias("attachments"))


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conv_id: formatted, loss_spans (offset and length in code points), attachments, expanded_tokens.

    `turns` has conv_id, turn, role and either `parts` (array of PART) or `text`; other columns
    are ignored. Null texts, roles and parts count as empty, a null conv_id is a conversation of
    its own. Turns sort by turn (nulls first), ties by role and text, so repeated rows stay
    repeated turns in a fixed order. An empty table gives no rows.
    One row a conversation is the result asked for; offsets come from a running sum, so the work
    on a conversation is linear in its turns.
    """
    parts = (
        F.coalesce(F.col("parts"), F.array())
        if "parts" in turns.columns
        else F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))
    )
    role = F.coalesce("role", F.lit(""))
    seen = turns.select("conv_id", "turn", role.alias("role"), visit_parts(parts).alias("v"))
    head = F.concat(F.lit(START), encode_role(F.col("role")), F.lit("\n"))
    seen = seen.select("conv_id", "turn", "role", "v", F.concat(head, F.col("v.content"), F.lit(END + "\n")).alias("piece"), F.length(head).alias("head_n"))
    up_to = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "piece").rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumn("end", F.sum(F.length("piece").cast("long")).over(up_to))
    begin = F.col("end") - F.length("piece")
    span = F.when(F.col("role") == trained_role, F.struct((begin + F.col("head_n")).alias("offset"), F.length("v.content").cast("long").alias("length")))
    grouped = seen.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("end", "piece", span.alias("span"), "turn", F.col("v.attachments").alias("attachments")))).alias("t")
    )
    attachments = F.flatten(F.transform("t", lambda t: F.transform(t["attachments"], lambda a: F.struct(t["turn"].alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["placeholder"].alias("placeholder"), a["tokens"].alias("tokens")))))
    return grouped.select(
        "conv_id",
        F.array_join(F.col("t.piece"), "").alias("formatted"),
        F.filter(F.col("t.span"), lambda s: s.isNotNull()).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(F.flatten(F.col("t.attachments")), F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of struct(role, text) read back from a formatted conversation, unescaped."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def one(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = F.substring(p, F.length(role) + F.lit(2), F.length(p) - F.length(role) - F.lit(len(END) + 2))
        return F.struct(decode_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, one)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["offset"].cast("int") + F.lit(1), s["length"].cast("int")))), "")


def digest(chats: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, read back from the output."""
    read = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens")
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_attachments",
        "expanded_tokens",
    )


