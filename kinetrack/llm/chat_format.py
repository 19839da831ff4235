"""Chat formatting with typed content parts (DataFrame functions only).

A turn holds parts of the types text, image, audio and document.  ``visit_parts`` flattens them in
order: text is escaped, any other part becomes a placeholder with its ordinal in the conversation;
each leaves a reference to its attachment and its expanded number of tokens.  ``format_turns``
writes conversations with marked turns and the spans of the assistants' text (the loss mask);
``read_back`` gets the turns from the output alone.

Escape: in a text one backslash goes after the first character of whatever could open a control
string ("<" before "|", "s>" or "/s>", "[" before "INST]" or "/INST]", with any backslashes
between); reading removes one.  Roles write "%", line feeds and "<" as %25, %0A and %3C.

Edge cases: null text is empty, null role is the empty role, null turns sort first; turns with
equal numbers go by role, then text; rows that repeat are turns that repeat; an empty table gives
no conversation; a part of another type is an attachment of that type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrack.llm.exprs import let

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>\n"
_OPEN = r"(<(?=\\*(?:\||/?s>))|\[(?=\\*/?INST\]))"
_ESCAPED = r"(<(?=\\+(?:\||/?s>))|\[(?=\\+/?INST\]))\\"

PART = "struct<type:string,text:string,ref:string,width:int,height:int,millis:bigint,pages:int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _OPEN, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def part_tokens(part: Column, patch: int = 28, audio_ms: int = 40, page_tokens: int = 258) -> Column:
    """Tokens that a placeholder expands to; zero for text."""
    up = lambda a, b: F.ceil(F.coalesce(a, F.lit(0)) / b)
    return (
        F.when(part["type"] == "image", up(part["width"], patch) * up(part["height"], patch))
        .when(part["type"] == "audio", up(part["millis"], audio_ms))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)) * page_tokens)
        .otherwise(F.lit(0))
        .cast("long")
    )


def is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def visit_parts(turns: Column) -> Column:
    """array<struct<turn, role, parts>> -> struct(turns: array<struct<turn, role, body>>, attachments).

    Bodies are escaped text with placeholders such as ``<|image:2|>``; ordinals run over the conversation.
    """
    flat = F.flatten(
        F.transform(turns, lambda t, i: F.transform(t["parts"], lambda p, j: F.struct(i.alias("at"), j.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"), is_text(p).alias("text"))))
    )
    media = let(
        F.filter(flat, lambda x: ~x["text"]),
        lambda m: F.transform(m, lambda x, k: F.struct((k + 1).alias("ordinal"), x["at"].alias("turn_index"), x["part"].alias("part_index"), x["type"].alias("type"), x["ref"].alias("ref"), x["tokens"].alias("tokens"))),
    )

    def bodies(found: Column) -> Column:
        def body(t: Column, i: Column) -> Column:
            def one(p: Column, j: Column) -> Column:
                mark = F.get(F.filter(found, lambda m: (m["turn_index"] == i) & (m["part_index"] == j)), F.lit(0))
                return F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), escape_role(p["type"]), F.lit(":"), mark["ordinal"].cast("string"), F.lit("|>")))

            return F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.array_join(F.transform(t["parts"], one), "").alias("body"))

        return F.struct(F.transform(turns, body).alias("turns"), found.alias("attachments"))

    return let(media, bodies)


def text_parts(text: Column) -> Column:
    """A turn of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(k).alias(n) for n, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("millis", "long"), ("pages", "int"))]))


def format_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, parts -> conv_id, formatted, loss_spans (start, length in characters from 0),
    attachments, expanded_tokens."""
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), "parts"))).alias("turns"))
    visited = grouped.select("conv_id", visit_parts(F.col("turns")).alias("v"))
    pieces = visited.select(
        "conv_id", F.col("v.attachments").alias("attachments"),
        F.transform("v.turns", lambda t: F.struct(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), t["body"].alias("body"), (t["role"] == "assistant").alias("loss"))).alias("pieces"),
    )
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END)
    empty = F.array().cast("array<struct<start:int,length:int>>")
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + size(p)).alias("at"),
            F.when(p["loss"], F.array_append(s["spans"], F.struct((s["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length")))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return pieces.select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        spans.alias("loss_spans"), "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text, formatted_chars; all from ``formatted`` and ``loss_spans``."""

    def turn(x: Column) -> Column:
        rest = F.substring(x, len(START) + 1, 2147483647)
        return let(rest, lambda r: F.struct(unescape_role(F.substring_index(r, "\n", 1)).alias("role"), unescape(r.substr(F.instr(r, F.lit("\n")) + 1, F.length(r))).alias("text")))

    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda x: x != "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.select("conv_id", F.transform(pieces, turn).alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query's contract."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )
