"""Chat formatting by prefix-target expansion.

Main path: DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: What must not occur in a text: our own marks and those of other common templates, without the opening character.
CONTROL = r"\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>|/?INST\]"
_ESCAPE = rf"([<\[])(\\*)(?={CONTROL})"
_UNESCAPE = rf"([<\[])\\(\\*)(?={CONTROL})"


def escaped(text: Column) -> Column:
    """A control string gets a backslash after its opening character, one more than it has: `<|end|>` to `<\\|end|>`, that to `<\\\\|end|>`. All other text stays as it is."""
    return F.regexp_replace(text, F.lit(_ESCAPE), F.lit(r"$1\\$2"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_UNESCAPE), F.lit("$1$2"))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """Training examples: conv, example, n_turns, formatted, loss_start, loss_chars.

    Every turn of role target becomes an example of its own: all turns before it as context, and that turn. Only that reply's text is trainable: the loss_chars code points from loss_start (0-based) of formatted. Turns after the last such turn, or a conversation without any, give one more example that trains nothing (loss_start null, loss_chars 0), so formatted texts hold every turn. n_turns is the number of turns in formatted; example counts from 0.

    A turn reads `<|turn|>role\\ntext<|end|>\\n`, the role URL-encoded, control strings in the text escaped reversibly. Turns are ordered by turn, role and text; equal turn numbers and repeated rows stay, all of them. A null role or text is empty, a null turn comes first, rows of a null conv are one conversation. Other columns are ignored.

    One shuffle by conversation. An example holds the whole context by definition, so a conversation must fit a row of 2 GB; nothing else is gathered.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chats = df.select(F.col(conv).alias("conv"), row.alias("row")).groupBy("conv").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    pieces = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), F.concat(F.lit(TURN), F.url_encode(r["role"]), F.lit("\n")).alias("head"), escaped(r["text"]).alias("body")))
    chats = chats.select("conv", pieces.alias("pieces"))
    n = F.size("pieces")
    ends = F.filter(F.transform("pieces", lambda p, i: F.when((p["role"] == target) | (i == n - 1), i)), lambda i: i.isNotNull())
    chats = chats.select("conv", "pieces", F.posexplode(ends).alias("example", "last"))
    upto = F.slice("pieces", F.lit(1), F.col("last") + 1)
    chats = chats.select(
        "conv", "example", (F.col("last") + 1).alias("n_turns"), F.array_join(F.transform(upto, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"), F.element_at("pieces", F.col("last") + 1).alias("reply")
    )
    trains, size = F.col("reply.role") == target, F.length("reply.body")
    return chats.select(F.col("conv").alias(conv), "example", "n_turns", "formatted", F.when(trains, F.length("formatted") - len(END) - size).alias("loss_start"), F.when(trains, size).otherwise(0).alias("loss_chars"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: an array of (role, text)."""
    parts = F.split(formatted, END.replace("|", r"\|"))
    turns = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.struct(F.url_decode(F.substr(F.substring_index(p, "\n", 1), F.lit(len(TURN) + 1))).alias("role"), unescaped(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2)).alias("text")))
    return turns


def chat_digest(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, read back from examples (see format_chats): n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    reply = unescaped(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_chars")))
    last = F.struct("n_turns", "formatted")
    grouped = examples.groupBy(conv).agg(
        F.max(last).alias("last"),
        F.array_sort(F.collect_list(F.when(F.col("loss_start").isNotNull(), F.struct("example", reply.alias("text"))))).alias("replies"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    turns = grouped.withColumn("turns", read_turns(F.col("last.formatted"))).withColumn("loss", F.array_join(F.transform("replies", lambda r: r["text"]), ""))
    return turns.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
