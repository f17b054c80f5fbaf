"""Chat formatting of typed content parts, in DataFrame operations only.

A message's content is an ordered array of parts. A visitor, one branch per type, renders each:
text is escaped, image, audio and document become one placeholder each, and what they refer to
goes into ``attachments`` with the tokens the placeholder stands for.

A turn is ``<|im_start|>role\\n`` text ``<|im_end|>\\n``. Inside texts, roles and references a
backslash is doubled, ``<|`` becomes ``<\\|`` and, in roles, a line feed becomes ``\\n``; every
escape pair starts with a backslash, so reading pairs from the left undoes it. No control string
survives in a text, hence none can be forged.

The output's loss mask is kept by segment: ``segments`` is the formatted text cut into pieces, in
order, each flagged whether it is trained on (the body of assistant turns). A mask by segment
stays linear for a conversation of any length.

Defined cases: null roles and texts are empty; a null turn comes first; equal turns are ordered by
role, then parts; repeated rows are repeated turns; unknown part types render as escaped text;
rows of a null conv_id are one conversation; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import let, whole

START, END = "<|im_start|>", "<|im_end|>"
#: One part; unused fields are null.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


@dataclass(frozen=True)
class TokenRules:
    """Tokens that a placeholder expands to."""

    image_patch: int = 28
    audio_tokens_per_second: int = 25
    document_tokens_per_page: int = 1024


def escape(text: Column) -> Column:
    return F.replace(F.replace(whole(text), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Undoes escape."""
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def unescape_role(role: Column) -> Column:
    """Undoes escape_role: between doubled backslashes stand only single pairs."""
    pieces = F.split(role, r"\\\\")
    single = lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|"))
    return F.array_join(F.transform(pieces, single), "\\")


def visit(part: Column, rules: TokenRules) -> Column:
    """What one part turns into: its rendering and, for attachments, kind, reference and tokens."""
    size = F.lit(rules.image_patch)
    patches = F.ceil(F.coalesce(part["width"], F.lit(0)) / size) * F.ceil(F.coalesce(part["height"], F.lit(0)) / size)
    sound = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * rules.audio_tokens_per_second)
    pages = F.coalesce(part["pages"], F.lit(0)).cast("long") * rules.document_tokens_per_page
    kind = part["type"]
    tokens = F.when(kind == "image", patches).when(kind == "audio", sound).when(kind == "document", pages)
    shown = F.when(tokens.isNotNull(), F.concat(F.lit("<|"), kind, F.lit("|>"))).otherwise(escape(part["text"]))
    return F.struct(shown.alias("shown"), F.when(tokens.isNotNull(), kind).alias("kind"), part["ref"].alias("ref"), tokens.cast("long").alias("tokens"))


def text_parts(text: Column) -> Column:
    """A plain text as content."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])).cast(f"array<{PART}>")


def render(messages: DataFrame, rules: TokenRules = TokenRules(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: conv_id, formatted, segments, attachments, n_placeholder_tokens.

    segments: array<struct<text, loss>>, whose texts joined are ``formatted``. attachments: in
    order, array<struct<turn, kind, ref, tokens>>, turn counting from 0.
    """
    visited = F.transform(F.coalesce(F.col(f"`{content}`"), F.array().cast(f"array<{PART}>")), lambda p: visit(p, rules))
    rows = messages.select(F.col(f"`{conv_id}`").alias("conv_id"), F.struct(F.col(f"`{turn}`").alias("turn"), whole(F.col(f"`{role}`")).alias("role"), visited.alias("parts")).alias("m"))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))

    def pieces(m: Column) -> Column:
        head = F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n"))
        body = F.array_join(F.transform(m["parts"], lambda p: p["shown"]), "")
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(part(head, F.lit(False)), part(body, m["role"].isin(*trained)), part(F.lit(END + "\n"), F.lit(False)))

    def attached(m: Column, i: Column) -> Column:
        return F.transform(F.filter(m["parts"], lambda p: p["kind"].isNotNull()), lambda p: F.struct(i.alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))

    conv = conv.select("conv_id", F.flatten(F.transform("m", pieces)).alias("segments"), F.flatten(F.transform("m", attached)).alias("attachments"))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    total = F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return conv.select("conv_id", formatted.alias("formatted"), "segments", "attachments", total.alias("n_placeholder_tokens"))


#: Before and after each placeholder. In escaped text no control string survives, so these are placeholders only.
_PLACEHOLDER = r"<\|(?:image|audio|document)\|>"
_AROUND = rf"(?={_PLACEHOLDER})|(?<=<\|image\|>)|(?<=<\|audio\|>)|(?<=<\|document\|>)"


def parse(formatted: Column) -> Column:
    """Reads turns back: array<struct<role, text, parts>>, unescaped. text keeps placeholders; parts is array<struct<type, text>>, text null for placeholders.

    The k-th part that is no text is the k-th attachment. Texts side by side come back as one.
    """
    chunks = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 2147483647 - 2)

    def part(piece: Column) -> Column:
        held = piece.rlike("^" + _PLACEHOLDER + "$")
        return F.struct(F.when(held, F.substring(piece, F.lit(3), F.length(piece) - 4)).otherwise("text").alias("type"), F.when(~held, unescape(piece)).alias("text"))

    def one(chunk: Column) -> Column:
        at = F.instr(chunk, F.lit("\n"))
        role = F.substring(chunk, F.lit(1), at - 1)
        body = F.substring(chunk, at + 1, F.length(chunk) - at - len(END) - 1)
        parts = F.transform(F.filter(F.split(body, _AROUND), lambda p: p != ""), part)
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"), parts.alias("parts"))

    return F.transform(chunks, one)


def loss_text(segments: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, n_placeholder_tokens: all read back from the output."""
    line = lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))
    of_turns = lambda t: F.struct(F.size(t).cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform(t, line), ""), 256).alias("turns_sha256"))
    of_loss = lambda x: F.struct(F.length(x).cast("long").alias("loss_chars"), F.sha2(x, 256).alias("loss_sha256"))
    rows = rendered.select(
        "conv_id",
        let(parse(F.col("formatted")), of_turns).alias("t"),
        let(loss_text(F.col("segments")), of_loss).alias("l"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "n_placeholder_tokens",
    )
    return rows.select("conv_id", "t.*", "l.*", "formatted_chars", "n_attachments", "n_placeholder_tokens")
