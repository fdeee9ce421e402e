"""Chat formatting: conversations as one templated text each, with Spark expressions only.

The turns of a conversation are collected as structs and sorted; runs of adjacent turns of one role are merged
into a block by array aggregation; blocks are written as

    <|start|>ROLE<|sep|>TEXT<|cont|>TEXT...<|end|>\\n

with ``<|cont|>`` between merged turns, so that turns can be read back. Inside roles and texts every ``&``
becomes ``&amp;``, and the first character of each control string (of this template and of two other common
ones) becomes an entity; ``unescaped`` undoes that exactly. The loss mask covers the texts of ``train_roles``.

Defined cases: a null text, role or turn counts as '', '' and a turn before all others; equal turns are ordered by
role, then text; repeated rows are turns of their own; rows without conv_id form one conversation; an empty
table gives an empty result; extra columns are ignored. One conversation is one row, so its turns have to
fit in a task's memory; rows of a conversation are the only rows brought together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings that texts must not hold, and how each is written inside a text.
CONTROL = (("<|", "&lt;|"), ("<s>", "&lt;s>"), ("</s>", "&lt;/s>"), ("[INST]", "&lsqb;INST]"), ("[/INST]", "&lsqb;/INST]"), ("<<SYS>>", "&lt;<SYS>>"), ("<</SYS>>", "&lt;</SYS>>"))
START, SEP, CONT, END = "<|start|>", "<|sep|>", "<|cont|>", "<|end|>\n"


def escaped(text: Column) -> Column:
    """text without control strings."""
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), (("&", "&amp;"), *CONTROL), text)


def unescaped(text: Column) -> Column:
    """The text that was escaped."""
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), (("&lt;", "<"), ("&lsqb;", "["), ("&amp;", "&")), text)


def merged_turns(chats: DataFrame) -> DataFrame:
    """chats (conv_id, turns: sorted) with ``blocks``: array<struct<role, texts>>, adjacent turns of a role merged.

    Blocks are cut at the places where the role changes, so that work grows with the turns alone. Arrays that are read
    inside lambdas are columns of their own, which are referred to twice, so that Spark doesn't compute them again and again.
    """
    turns, opens = F.col("turns"), F.col("_opens")
    n = F.size(turns)

    def block(i: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(opens, k + 1), n)
        return F.struct(F.get(turns, i)["role"].alias("role"), F.transform(F.slice(turns, i + 1, stop - i), lambda t: t["text"]).alias("texts"))

    changes = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    return chats.withColumn("_opens", changes).select("conv_id", F.transform(opens, block).alias("blocks"))


def sums_before(values: Column, group: int = 256) -> Column:
    """For each of a column of numbers in arrays the sum of those before it; in groups, so that no long array is grown by one."""

    def running(some: Column, start: Column) -> Column:
        state = F.struct(start.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(some, state, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / group).cast("int")), lambda g: F.slice(values, g * group + 1, F.lit(group)))
    starts = running(F.transform(groups, lambda g: F.aggregate(g, F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0))
    return F.flatten(F.zip_with(groups, starts, running))


def format_chats(conversations: DataFrame, train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, n_blocks, ``formatted``, and ``loss_spans``.

    ``loss_spans`` is array<struct<start, length>> in code points of ``formatted``: what the loss counts.
    """
    turn = F.struct(
        F.col("turn"),
        escaped(F.coalesce("role", F.lit(""))).alias("role"),
        escaped(F.coalesce("text", F.lit(""))).alias("text"),
    )
    chats = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    blocks = merged_turns(chats)

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("piece"), loss.alias("loss"))

    def written(b: Column) -> Column:
        """The pieces of a block: what opens it, then each text and what stands behind it."""
        learnt, no = b["role"].isin(*[escape_plain(r) for r in train_roles]), F.lit(False)
        texts = F.transform(b["texts"], lambda t, k: F.array(piece(t, learnt), piece(F.when(k + 1 < F.size(b["texts"]), CONT).otherwise(END), no)))
        return F.concat(F.array(piece(F.concat(F.lit(START), b["role"], F.lit(SEP)), no)), F.flatten(texts))

    pieces = blocks.select("conv_id", F.size("blocks").cast("long").alias("n_blocks"), F.flatten(F.transform("blocks", written)).alias("pieces"))
    placed = pieces.withColumn("sizes", F.transform("pieces", lambda p: F.length(p["piece"]).cast("long"))).withColumn("at", sums_before(F.col("sizes")))
    spans = F.filter(F.zip_with("pieces", "at", lambda p, at: F.struct(at.alias("start"), F.length(p["piece"]).cast("long").alias("length"), p["loss"].alias("loss"))), lambda s: s["loss"])
    return placed.select(
        "conv_id",
        "n_blocks",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["start"], s["length"])).alias("loss_spans"),
    )


def escape_plain(text: str) -> str:
    """``escaped`` of a constant."""
    return reduce(lambda x, pair: x.replace(*pair), (("&", "&amp;"), *CONTROL), text)


def with_masked_text(chats: DataFrame, chunk: int = 1 << 15) -> DataFrame:
    """chats (formatted, loss_spans) with ``learnt``: the unescaped texts under the spans, joined.

    The text is cut into chunks first, so that a span is sought in its own chunks only.
    """
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.length("formatted") / chunk).cast("int")), lambda k: F.substr(F.col("formatted"), k * chunk + 1, F.lit(chunk)))

    def cut(s: Column) -> Column:
        first, last = F.floor(s["start"] / chunk).cast("int"), F.floor((s["start"] + s["length"]) / chunk).cast("int")
        here = F.concat(F.get("_chunks", first), F.array_join(F.slice("_chunks", first + 2, last - first), ""))
        return unescaped(F.substr(here, (s["start"] % chunk + 1).cast("int"), s["length"].cast("int")))

    return chats.withColumn("_chunks", chunks).withColumn("learnt", F.array_join(F.transform("loss_spans", cut), "")).drop("_chunks")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, unescaped, in order."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(F.substring(block, len(START) + 1, 1 << 30), SEP, 1)
        body = F.substring(block, F.length(role) + F.lit(len(START) + len(SEP) + 1), F.length(block))
        return F.transform(F.split(body, r"<\|cont\|>", -1), lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def chat_digest(conversations: DataFrame, train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per conversation what is read back from the formatted text: its turns, and the text under the loss mask."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = with_masked_text(format_chats(conversations, train_roles))
    return back.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_turns(F.col("formatted")).alias("turns"), "learnt").select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        "formatted_chars",
    )
