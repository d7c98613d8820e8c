"""Chat formatting checked by a grammar round trip. DataFrame functions only.

Grammar of the output, with four control strings::

    chat := turn*
    turn := "<s>" "[INST]" " " role " " "[/INST]" text "</s>"

A text may hold control strings itself. In an escaped chat, every control
string inside a role or text carries one more backslash after its first
character (``</s>`` becomes ``<\\/s>``, ``<\\/s>`` becomes ``<\\\\/s>``), so none
is left that the parser could take for its own, and taking one backslash away
gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKER = r"</?s>|\[/?INST\]"
#: What a round trip without escaping would change: a control string, with or without backslashes.
CONFLICT = r"<\\*/?s>|\[\\*/?INST\]"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<(\\*)(/?s>)", r"<$1\\$2")
    return F.regexp_replace(text, r"\[(\\*)(/?INST\])", r"[$1\\$2")


def unescape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<\\(\\*)(/?s>)", "<$1$2")
    return F.regexp_replace(text, r"\[\\(\\*)(/?INST\])", "[$1$2")


def render(turns: Column, fold) -> Column:
    """The chat of an array of (role, text); fold is applied to every role and text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<s>[INST] "), fold(t["role"]), F.lit(" [/INST]"), fold(t["text"]), F.lit("</s>"))), "")


def parse(df: DataFrame, chat: str, out: str) -> DataFrame:
    """df with the (role, text) turns of a chat as column ``out``, null where it doesn't follow the grammar.

    The control strings of a chat must be whole turns of four, and the fields
    between them must be empty but for the role and the text. Control strings
    and fields are columns of their own, split once, so the work is linear in
    the number of turns. Fields stay as column ``{out}_fields``.
    """
    markers, fields, n = F.col("__markers"), F.col(f"{out}_fields"), F.col("__n")
    df = df.withColumns({"__markers": F.regexp_extract_all(chat, F.lit(MARKER), F.lit(0)), f"{out}_fields": F.split(chat, MARKER, -1)})
    df = df.withColumn("__n", F.floor(F.size(markers) / 4).cast("int"))
    whole = F.flatten(F.array_repeat(F.array(F.lit("<s>"), F.lit("[INST]"), F.lit("[/INST]"), F.lit("</s>")), n))
    place = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda i, k: F.get(fields, i * 4 + k)
    plain = F.forall(place, lambda i: (at(i, 0) == "") & (at(i, 1) == "") & at(i, 2).startswith(" ") & at(i, 2).endswith(" ") & (F.length(at(i, 2)) >= 2))
    turns = F.transform(place, lambda i: F.struct(unescape(F.substring(at(i, 2), F.lit(2), F.length(at(i, 2)) - 2)).alias("role"), unescape(at(i, 3)).alias("text")))
    return df.withColumn(out, F.when((markers == whole) & plain & (F.element_at(fields, -1) == ""), turns)).drop("__markers", "__n")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One chat per conversation, verified to read back as its turns.

    A conversation is rendered as it is and reparsed; where the recovered
    turns differ from the source, it is rendered again with its conflicting
    content escaped and must then read back identically, or the job fails.

    Returns conv_id, formatted, escaped, turns (read back from formatted) and
    mask: the lengths in code points of the formatted text's consecutive
    parts, with loss true for assistant texts. Null roles and texts count as
    empty; a null conv_id is a conversation of its own. Rows with the same
    turn number are ordered by role and text, nulls first; repeated rows stay
    repeated. A conversation is one output row, so all its turns meet there.
    """
    clean = F.struct(F.col(turn_col).alias("at"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = turns.groupBy(F.col(conv_col).alias("conv")).agg(F.array_sort(F.collect_list(clean)).alias("rows"))
    chats = chats.select("conv", F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    chats = chats.withColumn("plain", render(F.col("source"), lambda x: x))
    chats = parse(chats, "plain", "read")
    chats = chats.withColumn("escaped", ~F.coalesce(F.col("read") == F.col("source"), F.lit(False))).drop("read", "read_fields")
    chats = chats.withColumn("formatted", F.when(F.col("escaped"), render(F.col("source"), escape)).otherwise(F.col("plain"))).drop("plain")
    chats = parse(chats, "formatted", "turns")
    identical = F.coalesce(F.col("turns") == F.col("source"), F.lit(False))
    chats = chats.withColumn("turns", F.when(identical, F.col("turns")).otherwise(F.raise_error(F.lit("a chat does not read back as its turns"))))
    fields = F.col("turns_fields")
    mask = F.flatten(
        F.transform(
            "turns",
            lambda t, i: F.array(
                F.struct((F.lit(len("<s>[INST][/INST]")) + F.length(F.get(fields, i * 4 + 2))).alias("chars"), F.lit(False).alias("loss")),
                F.struct(F.length(F.get(fields, i * 4 + 3)).alias("chars"), (t["role"] == "assistant").alias("loss")),
                F.struct(F.lit(len("</s>")).alias("chars"), F.lit(False).alias("loss")),
            ),
        )
    )
    return chats.select(F.col("conv").alias(conv_col), "formatted", "escaped", "turns", mask.alias("mask"))


def digests(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What format_chats() output reads back as: counts and digests of all turns and of the text under the loss mask."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return chats.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
