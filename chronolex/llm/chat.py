"""Chat formatting: one template, and prefix-target examples that share the formatted conversation.

A turn is written `<s>role\\ntext</s>` if it is a reply (role assistant), else `[INST]role\\ntext[/INST]`.  A control
string inside a role or text gets a backslash after its first character, one more if it has some already; taking one
away restores it.  Prefix-target expansion gives every reply an example of its own: its context is the formatted
conversation up to it, and only the reply's text is trainable.  The context of each example is a prefix of the same
string, so an example is stored as offsets into it (context_chars, loss_start, loss_chars), which keeps the output
linear in the input however long a conversation is; example_texts() writes the texts out.

A conversation is formatted in blocks of TURNS_PER_BLOCK turn numbers, so that a conversation with a large share of all
rows is spread over tasks.  Only column expressions are used.

Defined results: null text and null role count as empty; a null conv_id is a conversation of its own; rows of one turn
number come in the order of role, then text, repeated rows each count; an empty table gives no rows; extra columns are
dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURNS_PER_BLOCK = 256
REPLY = "assistant"
CONTROL = r"/?(?:INST\]|s>)"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([\[<])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([\[<])\\(\\*)({CONTROL})", "$1$2$3")


def _role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unrole(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_blocks(df: DataFrame, *, turns_per_block: int = TURNS_PER_BLOCK) -> DataFrame:
    """conv_id, block, formatted, n_turns, formatted_chars, examples (turn, context_chars, loss_start, loss_chars in the block)."""
    reply = F.col("role") == REPLY
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.when(reply, "<s>").otherwise("[INST]"), _role(F.col("role")), F.lit("\n"))
    rows = rows.select("*", F.floor(F.col("turn") / turns_per_block).alias("block"), head.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.when(reply, "</s>").otherwise("[/INST]"))).withColumn("reply", reply)
    within = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.length("piece").cast("long")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rows = rows.select("conv_id", "block", "turn", "piece", "reply", before.alias("at"), F.row_number().over(within).alias("nth"), F.length("head").cast("long").alias("h"), F.length("body").cast("long").alias("b"))
    example = F.when(F.col("reply"), F.struct("turn", F.col("at").alias("context_chars"), (F.col("at") + F.col("h")).alias("loss_start"), F.col("b").alias("loss_chars"), "nth"))
    return rows.groupBy("conv_id", "block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "piece"))), lambda x: x["piece"]), "").alias("formatted"),
        F.count("*").alias("n_turns"),
        F.sum(F.length("piece").cast("long")).alias("formatted_chars"),
        F.array_sort(F.collect_list(example), lambda x, y: x["nth"] - y["nth"]).alias("examples"),
    )


def examples(blocks: DataFrame) -> DataFrame:
    """One row per reply: conv_id, block, turn, context_chars, loss_start and loss_chars in the whole conversation, reply."""
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("conv_id", "block", F.coalesce(F.sum("formatted_chars").over(before), F.lit(0)).alias("base"))
    rows = blocks.select("conv_id", "block", F.explode("examples").alias("e"), F.col("formatted"))
    rows = rows.select("conv_id", "block", "e", unescape(F.substring(F.col("formatted"), F.col("e.loss_start").cast("int") + 1, F.col("e.loss_chars").cast("int"))).alias("reply"))
    rows = rows.alias("r").join(bases.alias("b"), F.col("r.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("r.block").eqNullSafe(F.col("b.block")))
    base = F.col("b.base")
    return rows.select("r.conv_id", "r.block", "e.turn", (base + F.col("e.context_chars")).alias("context_chars"), (base + F.col("e.loss_start")).alias("loss_start"), "e.loss_chars", "reply")


def example_texts(blocks: DataFrame) -> DataFrame:
    """Examples written out: conv_id, turn, context, target; as large as all prefixes together, so for conversations that are short."""
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumn("prefix", F.array_join(F.collect_list("formatted").over(before), "")).select("conv_id", "prefix", "formatted", F.explode("examples").alias("e"))
    return rows.select("conv_id", "e.turn", F.concat("prefix", F.expr("substring(formatted, 1, int(e.context_chars))")).alias("context"), F.expr("substring(formatted, int(e.context_chars) + 1, int(e.loss_start + e.loss_chars - e.context_chars))").alias("target"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string: an array of (role, text)."""
    inner = F.regexp_extract_all(formatted, F.lit(r"(?s)(?:\[INST\]|<s>)(.*?)(?:\[/INST\]|</s>)"), F.lit(1))
    return F.transform(inner, lambda x: F.struct(_unrole(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substr(x, F.locate("\n", x) + 1)).alias("text")))


def digests(df: DataFrame) -> DataFrame:
    """Per conversation what is read back from the blocks and the examples; context_chars is the sum over the examples."""
    blocks = format_blocks(df)
    turns = F.array_join(F.transform(read_turns(F.col("formatted")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    none = F.lit(None)
    a = blocks.select("conv_id", "block", F.size(read_turns(F.col("formatted"))).cast("long").alias("n"), "formatted_chars", turns.alias("turns"), none.cast("string").alias("reply"), none.cast("long").alias("at"), none.cast("long").alias("context"))
    b = examples(blocks).select("conv_id", "block", none.cast("long").alias("n"), none.cast("long").alias("formatted_chars"), none.cast("string").alias("turns"), "reply", F.col("loss_start").alias("at"), F.col("context_chars").alias("context"))
    joined = lambda name, *order: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(name).isNotNull(), F.struct(*order, name)))), lambda x: x[name]), "")
    out = a.unionByName(b).groupBy("conv_id").agg(F.sum("n").alias("n_turns"), joined("turns", "block").alias("t"), joined("reply", "block", "at").alias("l"), F.sum("formatted_chars").alias("formatted_chars"), F.coalesce(F.sum("context"), F.lit(0)).alias("context_chars"))
    return out.select("conv_id", "n_turns", F.sha2("t", 256).alias("turns_sha256"), F.length("l").cast("long").alias("loss_chars"), F.sha2("l", 256).alias("loss_sha256"), "formatted_chars", "context_chars")
