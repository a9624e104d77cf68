"""Conversations formatted as training windows of a bounded number of tokens.

Only DataFrame operations. A turn is written as START role SEP text END, and control strings inside a role or
text are broken by a backslash (see escaped), so that a window can be read back. Prefix sums of the turns'
tokens place the turns: a conversation's sums are first made by CHUNK turn numbers, then within each. The new
turns of a window are those that begin in one cell of the conversation, a cell being half of what
the budget leaves after the system turn and the history; a turn longer than a cell has a window of its
own, so that a window is above the budget only if its system turn or that one turn is. Before its new
turns, a window repeats the system turn and whole turns of at most `history` tokens that come just before.
The loss mask covers the texts of new assistant turns only, each of which is new in exactly one window.

Turns are dealt out by (conversation, block of STEPS cells), together with the few that the next block
repeats, so a conversation of any length is many groups of bounded size.

Nulls and other cases: a null text or role is empty; rows without conv_id are one conversation; rows stand in order of turn
(null first), role and text; equal rows are turns each, and are written as often as they occur; a conversation
may have any roles and no system turn; the first turn with the role `system` is the one retained, from
the windows after it on; an empty table gives no windows; other columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylattice.llm.common import words_count

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of common chat templates that texts must not hold as they are.
CONTROL = (START, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>")
_OPENS = "[<\\[](?=" + "|".join(c[1:].replace("|", "\\|").replace("]", "\\]") for c in CONTROL) + ")"
#: Tokens of a window, of the turns that it repeats, of a turn's marks, and the least that is left for new turns.
BUDGET, HISTORY, MARKS, LEAST = 1024, 256, 4, 128
#: Turn numbers whose tokens are summed together, and cells of a block.
CHUNK, STEPS = 64, 16


def escaped(text: Column) -> Column:
    """Backslashes doubled, and one put after the first character of every control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _OPENS, "$0\\\\")


def unescaped(text: Column) -> Column:
    """Of two backslashes one stays, a single one goes."""
    return F.regexp_replace(text, "\\\\(\\\\?)", "$1")


def turn_tokens(text: Column) -> Column:
    """Words of a text and its marks; any other count of tokens above 0 will do."""
    return words_count(text) + MARKS


def _placed(turns: DataFrame, tokens, budget: int, history: int) -> DataFrame:
    """Every turn with before, the tokens of its conversation's earlier turns, its system turn and cell, the tokens of a cell."""
    rows = turns.select(
        F.col("conv_id"), F.col("conv_id").isNull().alias("no_id"), F.coalesce(F.col("conv_id"), F.lit(0)).alias("c"), F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns({"tokens": tokens(F.col("text")).cast("long"), "chunk": F.coalesce(F.shiftright("turn", CHUNK.bit_length() - 1), F.lit(-(1 << 60)))})
    key = ["no_id", "c", "chunk"]
    turn = F.struct("turn", "role", "text", "tokens")
    sums = rows.groupBy(*key).agg(F.sum("tokens").alias("in_chunk"), F.min(F.when(F.col("role") == "system", turn)).alias("system"))
    conversation = W.partitionBy("no_id", "c")
    first_of = F.coalesce(F.sum("in_chunk").over(conversation.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(LEAST), F.lit(budget - history) - F.coalesce(F.col("system.tokens"), F.lit(0)))
    sums = sums.select(*key, first_of.alias("chunk_at"), F.min("system").over(conversation).alias("system")).withColumn("cell", F.shiftright(left, 1))
    earlier = F.coalesce(F.sum("tokens").over(W.partitionBy(*key).orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    is_system = F.coalesce(F.struct("turn", "role", "text", "tokens") == F.col("system"), F.lit(False))
    return rows.join(sums, key).withColumns({"before": F.col("chunk_at") + earlier, "is_system": is_system}).drop("chunk_at", "chunk")


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=turn_tokens) -> DataFrame:
    """conv_id, window (where its new turns begin, in tokens of the conversation), text, n_tokens, repeated (turns at
    the front that earlier windows have) and loss (first, end) in characters of text."""
    rows = _placed(turns, tokens, budget, history)
    size = F.col("cell") * STEPS
    block = F.floor(F.col("before") / size)
    ahead = F.floor((F.col("before") + history) / size)
    dealt = rows.withColumn("block", F.explode(F.when(ahead > block, F.array(block, ahead)).otherwise(F.array(block)))).withColumn("new", F.col("block") == block)
    item = F.struct("before", "role", "text", "tokens", "is_system")
    within = W.partitionBy("no_id", "c", "block").orderBy("before").rangeBetween(-history, -1)
    dealt = dealt.withColumn("item", item).withColumn("recent", F.collect_list("item").over(within))
    spans = dealt.where("new").groupBy("no_id", "c", "block", F.floor(F.col("before") / F.col("cell")).alias("at"), (F.col("tokens") > F.col("cell")).alias("long"))
    spans = spans.agg(
        F.min("conv_id").alias("conv_id"), F.min("before").alias("window"), F.min_by("recent", "before").alias("recent"), F.sort_array(F.collect_list("item")).alias("own"),
        F.min(F.struct("turn", "role", "text", "tokens")).alias("first"), F.min("system").alias("system"),
    )
    later = F.coalesce(F.col("system") < F.col("first"), F.lit(False))
    kept = F.when(later, F.array(F.struct(F.lit(0).cast("long").alias("before"), "system.role", "system.text", "system.tokens", F.lit(True).alias("is_system")))).otherwise(F.slice("own", 1, 0))
    spans = spans.withColumn("context", F.concat(kept, F.filter("recent", lambda x: ~x["is_system"])))
    write = lambda new: lambda x: F.struct(
        F.concat(F.lit(START), escaped(x["role"]), F.lit(SEP)).alias("head"), escaped(x["text"]).alias("body"), (F.lit(new) & (x["role"] == "assistant")).alias("loss"), x["tokens"].alias("tokens")
    )
    written = F.concat(F.transform("context", write(False)), F.transform("own", write(True)))
    spans = spans.select("conv_id", "window", F.size("context").alias("repeated"), written.alias("turns"))
    mask = F.array().cast("array<struct<first:int,end:int>>")

    def step(state: Column, x: Column) -> Column:
        first = state["at"] + F.length(x["head"])
        end = first + F.length(x["body"])
        here = F.array(F.struct(first.cast("int").alias("first"), end.cast("int").alias("end")))
        return F.struct((end + len(END)).cast("int").alias("at"), F.when(x["loss"], F.concat(state["mask"], here)).otherwise(state["mask"]).alias("mask"))

    masked = F.aggregate("turns", F.struct(F.lit(0).alias("at"), mask.alias("mask")), step)["mask"]
    text = F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    total = F.aggregate("turns", F.lit(0).cast("long"), lambda n, x: n + x["tokens"])
    return spans.select("conv_id", "window", text.alias("text"), total.alias("n_tokens"), "repeated", masked.alias("loss"))


def parsed_turns(text: Column) -> Column:
    """The turns (role, text) of a window."""

    def turn(part: Column) -> Column:
        role = F.substring_index(part, SEP, 1)
        body = part.substr(F.length(role) + len(SEP) + 1, F.length(part) - F.length(role) - len(SEP) - len(END))
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"))

    parts = F.split(text, START.replace("|", "\\|"))
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def read_back(windows: DataFrame) -> DataFrame:
    """The new turns of every window and its texts under the loss mask, unescaped, read from its text: conv_id, window, turns, losses."""
    every = parsed_turns(F.col("text"))
    new = F.slice(every, F.col("repeated") + 1, F.size(every))
    under = F.transform("loss", lambda s: unescaped(F.col("text").substr(s["first"] + 1, s["end"] - s["first"])))
    return windows.select("conv_id", "window", F.length("text").alias("chars"), new.alias("turns"), under.alias("losses"))


def digests(windows: DataFrame) -> DataFrame:
    """What a conversation's windows hold, read back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest takes a conversation's text from its start to its end, so this puts one whole conversation into a row."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read_back(windows).select("conv_id", "window", F.size("turns").alias("n"), said.alias("said"), F.array_join("losses", "").alias("loss"), "chars")
    parts = F.sort_array(F.collect_list(F.struct("window", "said", "loss")))
    out = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), parts.alias("parts"))
    loss = F.array_join("parts.loss", "")
    return out.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(F.array_join("parts.said", ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
