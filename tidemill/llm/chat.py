"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import let

START, END, NEXT, BREAK = "<|im_start|>", "<|im_end|>", "<|im_next|>", "<|im_line|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Put one more backslash between ``<`` and ``|``, so that no control string is left in the text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """As ``escape``; line breaks, which end the role in the template, become a control string."""
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))


def _blocks(turns: Column) -> Column:
    """Merge adjacent turns of one role: array of (role, texts)."""
    starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))

    def block(start: Column, end: Column) -> Column:
        return F.struct(F.get(turns, start)["role"].alias("role"), F.transform(F.slice(turns, start + 1, end - start), lambda t: t["text"]).alias("texts"))

    return let(starts, lambda s: F.transform(s, lambda x, i: block(x, F.coalesce(F.get(s, i + 1), F.size(turns)))))


def _segments(block: Column) -> Column:
    """A block as consecutive pieces of the output, each with its loss flag."""
    loss = block["role"] == F.lit(LOSS_ROLE)
    piece = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
    head = F.concat(F.lit(START), escape_role(block["role"]), F.lit("\n"))
    inner = F.flatten(
        F.transform(
            block["texts"],
            lambda t, i: F.array(piece(F.when(i == 0, head).otherwise(F.lit(NEXT)), F.lit(False)), piece(escape(t), loss)),
        )
    )
    return F.concat(inner, F.array(piece(F.lit(END + "\n"), F.lit(False))))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: (conv_id, formatted, segments, n_rows, n_blocks).

    Turns are sorted by number, then role, then text (nulls first); adjacent turns of one role share a block:
    ``<|im_start|>role``, a line break, the texts with ``<|im_next|>`` between them, ``<|im_end|>`` and a line
    break. ``segments`` cuts ``formatted`` into pieces (text, loss); those with the loss flag are the
    assistant's texts and nothing else. Control strings in texts and roles are escaped, and ``read_chats``
    gets all turns back. Null roles and texts are empty; repeated rows are turns of their own; rows without a
    conversation form one. A conversation becomes one row, so it has to fit into one; conversations are never
    cut. Other columns are dropped. An empty table gives no rows.
    """
    c = lambda name: F.col(f"`{name}`")
    each = F.struct(c(turn).alias("turn"), F.coalesce(c(role), F.lit("")).alias("role"), F.coalesce(c(text), F.lit("")).alias("text"))
    gathered = turns.groupBy(c(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(each)).alias("turns"))
    blocked = gathered.select("conv_id", F.size("turns").cast("long").alias("n_rows"), _blocks(F.col("turns")).alias("blocks"))
    segmented = blocked.select(
        "conv_id", "n_rows", F.size("blocks").cast("long").alias("n_blocks"), F.flatten(F.transform("blocks", _segments)).alias("segments")
    )
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return segmented.select("conv_id", formatted.alias("formatted"), "segments", "n_rows", "n_blocks")


def read_chats(formatted: Column) -> Column:
    """All turns of a formatted conversation, as array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        body = F.regexp_replace(block, r"<\|im_end\|>\n\z", "")
        cut = F.locate("\n", body)
        texts = F.split(F.substring(body, cut + 1, F.char_length(body)), r"<\|im_next\|>", -1)
        return F.transform(texts, lambda t: F.struct(unescape_role(F.substring(body, F.lit(1), cut - 1)).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
