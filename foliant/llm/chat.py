"""Chat formatting with a grammar round trip. DataFrame functions only.

A conversation is rendered as a header line and, for each turn, ``### role: text</turn>``
and a line feed. The rendering is parsed again by the grammar below, and the recovered
turns are compared with the source; conversations that do not come back identical are
rendered anew at the next level of escaping:

- level 0: texts as they are;
- level 1: a backslash after every backslash, ``<``, ``#`` and ``:`` of roles and texts;
- level 2: roles and texts in hexadecimal UTF-8, which no marker can occur in.

The header tells the level, so the parser needs nothing but the rendered text:

    chat = "[chat " level "]" LF *turn;  turn = "### " role ": " text "</turn>" LF

``### `` and ``</turn>`` are reserved: a turn that holds one besides its own is not read.

The loss mask lists the places of the assistant's texts in the rendered text.

A conversation is one example and thus one row, however long; conversations are spread
over tasks by their id. Defined results: a null text or role is empty; turns are ordered by turn, role and text,
nulls first; equal rows are turns of their own; a null conv_id is a conversation; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import doc_rows

START, END = "### ", "</turn>"
LEVELS = 3
LOSS_ROLE = "assistant"


def _escaped(value: Column, level: int) -> Column:
    if level == 1:
        return F.regexp_replace(value, r"([\\<#:])", r"$1\\")
    return F.hex(value.cast("binary")) if level == 2 else value


def _unescaped(value: Column, level: int) -> Column:
    if level == 1:
        return F.regexp_replace(value, r"([\\<#:])\\", "$1")
    return F.unhex(value).cast("string") if level == 2 else value


def render(turns: Column, level: int) -> Column:
    """The rendered text of ``turns`` (array of role and text)."""
    parts = F.transform(
        turns,
        lambda t: F.concat(F.lit(START), _escaped(t["role"], level), F.lit(": "), _escaped(t["text"], level), F.lit(END + "\n")),
    )
    return F.concat(F.lit(f"[chat {level}]\n"), F.array_join(parts, ""))


def _pieces(rendered: Column) -> Column:
    """What follows each start marker up to the next one."""
    split = F.split(rendered, START)
    return F.slice(split, F.lit(2), F.size(split))


def _turn(piece: Column, level: int) -> Column:
    """The (role, text) of a piece; null where the grammar does not hold."""
    head = F.locate(": ", piece)
    size = F.length(piece) - head - 1 - len(END) - 1
    text = F.substring(piece, head + 2, size)
    turn = F.struct(_unescaped(F.substring(piece, F.lit(1), head - 1), level).alias("role"), _unescaped(text, level).alias("text"))
    return F.when((head > 0) & (size >= 0) & piece.endswith(END + "\n") & (F.locate(END, piece) == F.length(piece) - len(END)), turn)


def parse(rendered: Column) -> Column:
    """The turns (role, text) that the grammar reads from ``rendered``."""
    level = F.substring(rendered, 7, 1)

    def reader(n: int):
        return lambda piece: _turn(piece, n)

    out = None
    for n in reversed(range(LEVELS)):
        turns = F.transform(_pieces(rendered), reader(n))
        out = turns if out is None else F.when(level == str(n), turns).otherwise(out)
    return out


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask, level): one row for each conversation, its rendered text round-trip safe.

    ``loss_mask``: (start, length) in characters, from 0, of each text of the assistant.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = doc_rows(conversations, "conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    turns = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    safe = grouped.select("conv_id", turns.alias("turns"))

    def attempt(level: int) -> Column:
        if level == LEVELS - 1:
            return render(F.col("turns"), level)
        keep = lambda text: F.when(parse(text).eqNullSafe(F.col("turns")), text).otherwise(attempt(level + 1))
        return F.element_at(F.transform(F.array(render(F.col("turns"), level)), keep), 1)

    rendered = safe.select("conv_id", attempt(0).alias("formatted"))
    return rendered.select("conv_id", "formatted", loss_mask(F.col("formatted")).alias("loss_mask"), F.substring("formatted", 7, 1).cast("int").alias("level"))


def loss_mask(rendered: Column) -> Column:
    """(start, length) of the assistant's texts in ``rendered``, by the grammar."""
    wanted = F.when(F.substring(rendered, 7, 1) == "2", F.lit(LOSS_ROLE.encode().hex().upper())).otherwise(F.lit(LOSS_ROLE))
    begin = F.length(F.substring_index(rendered, "\n", 1)) + 1
    start = F.struct(begin.alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        head = F.locate(": ", piece)
        span = F.struct(
            (state["at"] + len(START) + head + 1).alias("start"), (F.length(piece) - head - 1 - len(END) - 1).alias("length")
        )
        mine = F.substring(piece, F.lit(1), head - 1) == wanted
        spans = F.when(mine, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + len(START) + F.length(piece)).alias("at"), spans.alias("spans"))

    return F.aggregate(_pieces(rendered), start, step, lambda state: state["spans"])


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` with ``turns`` and ``loss_texts``, both taken from the rendered text (and its mask) alone."""
    level = F.substring("formatted", 7, 1)
    masked = lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["length"])
    plain = lambda text: F.when(level == "0", text).when(level == "1", _unescaped(text, 1)).otherwise(_unescaped(text, 2))
    return chats.withColumns({"turns": parse(F.col("formatted")), "loss_texts": F.transform("loss_mask", lambda s: plain(masked(s)))})
