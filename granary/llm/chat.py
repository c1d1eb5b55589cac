"""Chat formatting: turn-aligned windows of a token budget, with loss on each assistant turn once.

Only DataFrame functions. Prefix sums of a conversation's tokens decide where a new window opens: when the turns since
the window's start exceed the budget (in later windows less the room for the system turn and the repeated history).
Later windows begin with the system turn, if the conversation opens with one, and with the last turns before the window
that fit `history` tokens; those repeated turns are outside the loss mask. A turn longer than the budget has a window of
its own and is never cut. Tokens are counted by PIECE, runs of letters, digits or other characters of a bounded length.

Template: <|im_start|>role, a line break, text, <|im_end|>, a line break. A backslash in a role or text is doubled, and
control strings (of this template and of other usual ones) get a backslash behind their first character; removing
each backslash restores the text. A line break in a role has one before it.

Scale: conversations are worked in blocks of at most `block` turns; a window ends where a block does, and what it repeats of
the block before comes along, so that no task holds more than a block. Usual conversations are one block and cross the
network once. Longer ones are sorted by range first, and their turns are numbered by the counts of the ranges before.

Defined cases: a null text or role counts as empty; turns with the same number follow by role and text; null turn
numbers come first; rows without a conv_id are one conversation; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import checkpointed, stored

BUDGET, HISTORY, BLOCK = 1024, 256, 4096
TURN_TOKENS = 6
#: What counts as a token (Java and RE2 syntax alike).
PIECE = r"[\p{L}\p{M}]{1,6}|\p{N}{1,3}|[^\x20\x09-\x0D\p{L}\p{M}\p{N}]"
START, END = "<|im_start|>", "<|im_end|>\n"
#: What follows the first character (< or [) of a control string.
_CONTROL = r"(<|\[)(?=\||/?s>|/?INST\]|<SYS>>|</SYS>>|</SYS>|<SYS>)"
#: Long conversations and their ranges are broadcast up to so many narrow rows.
BROADCAST_ROWS = 100_000
#: How a turn belongs to a block: as the conversation's system turn, as history, or as its own.
_SYSTEM, _BEFORE, _OWN = 0, 1, 2


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens_of(text: Column) -> Column:
    """Tokens of a turn with this text, the template's own included."""
    return (F.regexp_count(text, F.lit(PIECE)) + TURN_TOKENS).cast("long")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _blocks(rows: DataFrame, block: int, history: int) -> DataFrame:
    """rows (conv_id, turn, role, text) with block and kind; turns that a block repeats come once more for it."""
    counts = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    long_ = checkpointed(counts.select(F.col("conv_id").alias("_conv"), F.lit(True).alias("_long")))
    whole = rows.withColumn("block", F.lit(0).cast("long")).withColumn("kind", F.lit(_OWN))
    if not long_.count():
        return whole
    marked = rows.join(_few(long_), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    keys = ["conv_id", "turn", "role", "text", "_tie"]
    many = marked.where("_long").drop("_long").withColumn("_tie", F.monotonically_increasing_id())
    many = many.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    many = stored(many.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")))
    ranges = many.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    each = Window.partitionBy("conv_id")  # one row a range
    ranges = ranges.withColumn("_before", F.sum("_n").over(each.orderBy("_part")) - F.col("_n")).withColumn("_all", F.sum("_n").over(each))
    ranges = checkpointed(ranges.select(F.col("conv_id").alias("_conv"), F.col("_part").alias("_p"), "_first", "_before", "_all"))
    placed = many.join(_few(ranges), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_part") == F.col("_p")))
    placed = placed.withColumn("_i", F.col("_id") - F.col("_first") + F.col("_before")).withColumn("_b", F.expr(f"_i div {block}"))
    last, ahead = F.expr(f"(_all - 1) div {block}"), history // TURN_TOKENS + 1
    own = F.array(F.struct(F.col("_b").alias("block"), F.lit(_OWN).alias("kind")))
    system = F.when((F.col("_i") == 0) & (F.col("role") == "system") & (last > 0), F.transform(F.sequence(F.lit(1), last), lambda b: F.struct(b.cast("long").alias("block"), F.lit(_SYSTEM).alias("kind"))))
    before = F.when((F.col("_i") % block >= block - ahead) & (F.col("_b") < last), F.array(F.struct((F.col("_b") + 1).alias("block"), F.lit(_BEFORE).alias("kind"))))
    none = own.cast("array<struct<block:bigint,kind:int>>")
    every = F.concat(none, F.coalesce(system, F.slice(none, 1, 0)), F.coalesce(before, F.slice(none, 1, 0)))
    parts = placed.select(*rows.columns, F.explode(every).alias("_e")).select(*rows.columns, "_e.block", "_e.kind")
    return whole.join(_few(long_), F.col("conv_id").eqNullSafe(F.col("_conv")), "left_anti").unionByName(parts)


def windows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY, block: int = BLOCK) -> DataFrame:
    """Rows conv_id, window, repeated (leading turns that earlier windows have), turns (new ones), tokens, formatted, loss.

    Windows are numbered from 0 in each block, plus `block` for each block before. loss lists (start, length) in code
    points of formatted: the escaped texts of the new assistant turns.
    """
    name, body = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    turns = _blocks(rows.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), name.alias("role"), body.alias("text")), block, history)
    order = Window.partitionBy("conv_id", "block").orderBy("kind", "turn", "role", "text")
    turns = turns.withColumn("tokens", tokens_of(F.col("text")))
    turns = turns.withColumn("i", F.row_number().over(order) - 1).withColumn("pre", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens"))
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    turns = turns.withColumn("head", head).withColumn("body", escape(F.col("text")))
    one = F.struct("i", "kind", "pre", "tokens", "role", F.length("head").alias("from"), F.length("body").alias("chars"), F.concat("head", "body", F.lit(END)).alias("made"))
    blocks = turns.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(one)).alias("t"))
    first = F.get("t", F.lit(0))
    kept = F.when(F.when(F.col("block") == 0, first["role"] == "system").otherwise(first["kind"] == _SYSTEM), 1).otherwise(0)
    blocks = blocks.withColumn("kept", kept).withColumn("later", F.greatest(F.lit(1).cast("long"), F.lit(budget - history) - F.when(F.col("kept") == 1, first["tokens"]).otherwise(F.lit(0))))

    def opens(acc: Column, x: Column) -> Column:
        room = F.when((F.size(acc["at"]) == 1) & (F.col("block") == 0), F.lit(budget).cast("long")).otherwise(F.col("later"))
        new = (F.size(acc["at"]) == 0) | (x["pre"] + x["tokens"] - acc["base"] > room)
        return F.when((x["kind"] == _OWN) & new, F.struct(x["pre"].alias("base"), F.concat(acc["at"], F.array(x["i"])).alias("at"))).otherwise(acc)

    start = F.struct(F.lit(0).cast("long").alias("base"), F.array().cast("array<int>").alias("at"))
    starts = F.aggregate("t", start, opens, lambda acc: acc["at"])
    reach = history // TURN_TOKENS + 1

    def span(at: Column, a: Column, k: Column) -> Column:
        later = (F.col("block") > 0) | (k > 0)
        low = F.greatest(F.col("kept"), a - reach)
        fits = F.size(F.filter(F.slice("t", low + 1, F.greatest(a - low, F.lit(0))), lambda x: F.get("t", a)["pre"] - x["pre"] <= history))
        behind, front = F.when(later, fits).otherwise(F.lit(0)), F.when(later, F.col("kept")).otherwise(F.lit(0))
        end = F.coalesce(F.get(at, k + 1), F.size("t"))

        def cut(n: Column) -> Column:
            parts = F.concat(F.slice("t", F.lit(1), front), F.slice("t", a - n + 1, n + end - a))
            return F.struct((F.col("block") * block + k).alias("window"), (front + n).alias("repeated"), (end - a).alias("turns"), parts.alias("p"))

        return _let(behind, cut)

    spans = blocks.select("conv_id", F.explode(_let(starts, lambda at: F.transform(at, lambda a, k: span(at, a, k)))).alias("w")).select("conv_id", "w.*")

    def mask(at: Column) -> Column:
        targets = F.filter(F.sequence(F.col("repeated"), F.size("p") - 1), lambda i: F.get("p", i)["role"] == "assistant")
        return F.transform(targets, lambda i: F.struct((F.get(at, i) + F.get("p", i)["from"]).alias("start"), F.get("p", i)["chars"].alias("length")))

    begins = F.aggregate("p", F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(t["made"]))))
    tokens = F.aggregate("p", F.lit(0).cast("long"), lambda acc, t: acc + t["tokens"])
    return spans.select("conv_id", "window", "repeated", "turns", tokens.alias("tokens"), F.array_join(F.transform("p", lambda t: t["made"]), "").alias("formatted"), _let(begins, mask).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From the rows of windows() alone, one row a window: conv_id, window, turns (role, text) without repeats, loss_text, formatted_chars."""
    blocks = F.regexp_extract_all("formatted", F.lit(r"(?s)<\|im_start\|>(.*?)<\|im_end\|>\n"), F.lit(1))

    def parsed(block: Column) -> Column:
        head = F.regexp_extract(block, r"(?s)^((?:[^\\\n]|\\.)*)\n", 1)
        return _let(head, lambda h: F.struct(unescape(h).alias("role"), unescape(F.substr(block, F.length(h) + 2)).alias("text")))

    new = F.transform(F.slice(blocks, F.col("repeated") + 1, F.col("turns")), parsed)
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"]))), "")
    return formatted.select("conv_id", "window", new.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))
