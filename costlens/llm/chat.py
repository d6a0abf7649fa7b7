"""Chat formatting with typed content parts.

A message is a role and a list of parts: text, image, audio or document. A
visitor flattens the parts in order: text is escaped, every attachment becomes
one placeholder, and an attachment list records, in the order of the
placeholders, what stands there and how many tokens it will expand to (image
tiles, seconds of sound, pages).

The template is ``<|im_start|>role\\n`` text ``<|im_end|>\\n``. Texts cannot
fake it: in a text every ``<`` followed by any number of backslashes and ``|``
gets one more backslash, so no control string is left, and taking one away
restores the text. In roles, backslashes and line feeds are escaped as well.
The loss mask lists, turn by turn, the characters of assistant texts.

Only DataFrame functions run here, built into one row per conversation; the
rows of a conversation meet in one group because its output is one string.
Everything read back comes from the formatted string and the mask.

Defined results: null roles and texts are empty; rows of one conversation are
ordered by turn (null first), then role and text, and repeated rows are
repeated turns; a message without parts has an empty text; unknown part types
become placeholders named after the type ``file``; a null conv_id is one
conversation; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.llm.common import let

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens: an image costs TILE_TOKENS for each tile of TILE pixels square and
#: BASE_TOKENS more, sound SECOND_TOKENS a second, documents PAGE_TOKENS a page.
TILE, TILE_TOKENS, BASE_TOKENS, SECOND_TOKENS, PAGE_TOKENS = 512, 170, 85, 25, 800

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    plain = unescape(role)
    # Two backslashes are one, a backslash and n a line feed; left to right,
    # so the text is cut at the pairs first.
    return F.array_join(F.transform(F.split(plain, r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment takes in place of its placeholder."""
    tiles = F.ceil(F.coalesce(part["width"], F.lit(TILE)) / TILE) * F.ceil(F.coalesce(part["height"], F.lit(TILE)) / TILE)
    return (
        F.when(part["type"] == "image", tiles * TILE_TOKENS + BASE_TOKENS)
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * SECOND_TOKENS))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def _kind(part: Column) -> Column:
    return F.when(part["type"].isin("image", "audio", "document"), part["type"]).otherwise(F.lit("file"))


def flatten_parts(parts: Column) -> Column:
    """The parts' rendering: escaped texts and placeholders, in order."""

    def render(part: Column) -> Column:
        text = escape(F.coalesce(part["text"], F.lit("")))
        return F.when(part["type"] == "text", text).otherwise(F.concat(F.lit("<|"), _kind(part), F.lit("|>")))

    return F.array_join(F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), render), "")


def attachments(parts: Column) -> Column:
    """Reference, kind and tokens of each placeholder, in order."""
    others = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: ~F.coalesce(p["type"] == "text", F.lit(False)))
    return F.transform(
        others, lambda p: F.struct(_kind(p).alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"))
    )


def text_part(text: Column) -> Column:
    """A plain text as a message's only part."""
    empty = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            F.coalesce(text, F.lit("")).alias("text"),
            *[F.lit(None).cast(k).alias(n) for n, k in empty.items()],
        )
    )


def format_chats(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, parts) to one row per conversation:
    formatted, loss_mask (turn number from 0, start and length inside that
    turn's rendering) and attachments."""
    role = escape_role(F.coalesce(F.col("role"), F.lit("")))
    body = flatten_parts(F.col("parts"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.col("role").alias("role"),
        F.concat(head, body, F.lit(END + "\n")).alias("rendered"),
        F.length(head).alias("start"),
        F.length(body).alias("length"),
        attachments(F.col("parts")).alias("attached"),
    )
    turns = messages.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    spans = F.transform(
        F.col("turns"),
        lambda t, i: F.struct(i.alias("turn"), t["start"].alias("start"), t["length"].alias("length"), (t["role"] == "assistant").alias("on")),
    )
    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"),
        F.transform(
            F.filter(spans, lambda s: F.coalesce(s["on"], F.lit(False))),
            lambda s: F.struct(s["turn"].alias("turn"), s["start"].alias("start"), s["length"].alias("length")),
        ).alias("loss_mask"),
        F.flatten(F.transform("turns", lambda t: t["attached"])).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """Role and text of every turn, from the formatted string alone."""

    def turn(piece: Column) -> Column:
        cut = F.locate("\n", piece)
        tail = len(END) + 1
        return F.struct(
            unescape_role(F.substring(piece, 1, cut - 1)).alias("role"),
            unescape(F.substring(piece, cut + 1, F.length(piece) - cut - tail)).alias("text"),
        )

    return F.transform(rendered_turns(formatted), turn)


def rendered_turns(formatted: Column) -> Column:
    """The renderings of the turns without their start mark."""
    return F.filter(F.split(formatted, r"<\|im_start\|>"), lambda piece, i: i > 0)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""

    def part(pieces: Column) -> Column:
        return F.array_join(
            F.transform(
                mask,
                lambda m: unescape(F.substring(F.get(pieces, m["turn"]), m["start"] - len(START) + 1, m["length"])),
            ),
            "",
        )

    return let(rendered_turns(formatted), part)


def digest(chats: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations."""
    turns = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = masked_text(F.col("formatted"), F.col("loss_mask"))
    return chats.select(
        "conv_id",
        F.size(rendered_turns(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
