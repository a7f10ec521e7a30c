"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted by turn (then role, then
text, so ties and repeated rows have one order), adjacent turns of one role are merged by
an array aggregation into a block, and blocks are concatenated:

    <|im_start|>ROLE\\nTEXT[<|im_next|>TEXT ...]<|im_end|>\\n

In roles and texts & becomes &amp; and <| becomes &lt;|, so a text can never hold a
control string and reading back restores it; in roles a line feed becomes &nl; besides, since
the first one ends the role. A null role is an empty one, as is a null text; a null turn number sorts first; turns of a null conversation are one conversation. An
empty table gives no rows. Other columns are not read. One conversation is one cell of the
result, so it is gathered in one task whatever its length; the turns are pre-sorted nowhere
else and nothing larger than a conversation is held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("&nl;"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("&nl;"), F.lit("\n")))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """conv_col, formatted, loss_spans: array of (start, length) in code points from 0 of
    what is trained on, which is each text of the role named by trained."""
    turn = F.struct(F.col(turn_col).alias("turn"), escape_role(F.coalesce(F.col(role_col).cast("string"), F.lit(""))).alias("role"), escape(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    got = turns.groupBy(F.col(conv_col)).agg(F.array_sort(F.collect_list(turn)).alias("__turns"))
    merged = got.select(F.col(conv_col), _merge("__turns").alias("__blocks"))
    piece = lambda b: F.concat(F.lit(START), b["role"], F.lit("\n"), F.array_join(b["texts"], NEXT), F.lit(END))
    return merged.select(
        F.col(conv_col),
        F.array_join(F.transform("__blocks", piece), "").alias("formatted"),
        _spans("__blocks", trained).alias("loss_spans"),
    )


def _merge(turns: str) -> Column:
    """Blocks of adjacent turns of one role. Block numbers come first, so that each block is
    a slice of the sorted turns and nothing is copied again for every turn."""
    starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    return let(
        starts,
        lambda s: F.transform(
            s,
            lambda a, k: F.struct(
                F.get(turns, a)["role"].alias("role"),
                F.transform(F.slice(F.col(turns), a + 1, F.coalesce(F.get(s, k + 1), F.size(turns)) - a), lambda t: t["text"]).alias("texts"),
            ),
        ),
    )


_SPANS = "cast(array() as array<struct<start:int,length:int>>)"


def _spans(blocks: str, trained: str) -> Column:
    """Where the texts of trained blocks stand. Block ends are a running sum over blocks, text
    ends one over the texts of a trained block, so a long text costs its length once."""

    def texts(at, b):
        step = lambda acc, t: F.struct((acc["at"] + F.length(t) + len(NEXT)).alias("at"), F.array_append(acc["got"], F.struct(acc["at"].alias("start"), F.length(t).alias("length"))).alias("got"))
        return F.aggregate(b["texts"], F.struct(at.alias("at"), F.expr(_SPANS).alias("got")), step, lambda acc: acc["got"])

    def size(b):
        return F.aggregate(b["texts"], F.lit(len(START) + 1 + len(END) - len(NEXT)) + F.length(b["role"]), lambda n, t: n + F.length(t) + len(NEXT))

    heads = F.aggregate(
        F.transform(blocks, size),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")),
        lambda acc: acc["all"],
    )
    own = lambda b, at: F.when(b["role"] == escape_role(F.lit(trained)), texts(at + len(START) + F.length(b["role"]) + 1, b)).otherwise(F.expr(_SPANS))
    return let(heads, lambda h: F.flatten(F.transform(blocks, lambda b, k: own(b, F.get(h, k)))))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, span after span."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation again: array of (role, text), unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")

    def turns(b):
        body = F.substring(b, F.instr(b, "\n") + 1, F.length(b))
        texts = F.split(F.left(body, F.length(body) - len(END)), r"<\|im_next\|>")
        role = unescape_role(F.substring_index(b, "\n", 1))
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))
