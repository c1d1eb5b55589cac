"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree (say domain, language, source). At each node it is split among the children in
proportion to their weights; a child takes no more than its documents give in `max_epochs` passes, and what it leaves
goes to its siblings first. Only what a whole group of siblings can't take goes to the siblings of their parent, as
the parent's own limit is the sum of theirs. Each leaf then takes whole epochs and of one more epoch a prefix of
tokens, in an order drawn from a hash of seed, epoch and id.

Only DataFrame functions. Scale: documents are aggregated to one row per leaf. The end of a prefix is found by slices of
the hash's range: SLICES rows a leaf say in which slice it falls, that slice is cut again, and so on until it holds few
documents, which are sorted; so no task sees more than SLICES rows of a leaf, or LAST_SLICE in the end. The selection
comes down to one number per leaf. Documents pick it up by a join with the leaf table, which is broadcast up to
BROADCAST_ROWS leaves, so that texts stay where they are; above that both sides are salted, so that a large leaf is dealt
to SALT tasks at least.

Defined cases: a null level counts as the empty string; a null or wordless text has no tokens and comes along free of
charge where its hash lies in the prefix; rows of one doc_id with different texts have hashes of their own; rows equal in
both come or go together; a level value without a weight has weight 1; weights must be positive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import WORD, as_row, checkpointed

SEED, MAX_EPOCHS = 42, 4
#: Bits of the hash, and how many of them number the slices of a round.
HASH_BITS, SLICE_BITS = 60, 10
#: A slice of at most so many documents is sorted.
LAST_SLICE = 4096
#: Leaf tables of up to so many narrow rows are broadcast; beyond that each leaf is dealt to so many tasks.
BROADCAST_ROWS, SALT = 200_000, 32


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def seeded(seed: int, epoch: Column, doc_id: Column, text_hash: Column) -> Column:
    """A long of HASH_BITS bits."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")), text_hash)
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def text_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def _weight(level: str, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for value, weight in weights.items():
        out = F.when(F.col(level) == value, F.lit(float(weight))).otherwise(out)
    return out


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], budget: float, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves (levels, tokens) with column budget: the tokens that each leaf gives."""
    flows = None
    for depth, level in enumerate(levels):
        path, parent = levels[: depth + 1], levels[:depth]
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).cast("double").alias("most")).withColumn("w", _weight(level, weights.get(level, {})))
        nodes = nodes.withColumn("flow", F.lit(float(budget))) if flows is None else nodes.join(flows, parent)
        order = Window.partitionBy(*parent).orderBy(F.col("most") / F.col("w"), level)
        nodes = nodes.withColumn("before", F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("most"))
        nodes = nodes.withColumn("rest", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        nodes = nodes.withColumn("full", F.col("most") * F.col("rest") <= (F.col("flow") - F.col("before")) * F.col("w"))
        group = Window.partitionBy(*parent)
        nodes = nodes.withColumn("spent", F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(group)).withColumn("open", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(group))
        share = F.when(F.col("full"), F.col("most")).otherwise((F.col("flow") - F.col("spent")) * F.col("w") / F.col("open"))
        flows = nodes.select(*path, share.alias("flow"))
    return leaves.join(flows.select(*levels, F.floor("flow").cast("long").alias("budget")), levels)


def _few(df: DataFrame) -> bool:
    return df.count() <= BROADCAST_ROWS


def _with_leaf(rows: DataFrame, leaves: DataFrame, levels: list[str], few: bool, spread: Column) -> DataFrame:
    """rows with the columns of their leaf. leaves are materialised; spread deals a leaf's rows to tasks if there are many leaves."""
    if few:
        return rows.join(F.broadcast(leaves), levels)
    salted = leaves.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_salt", F.pmod(spread, F.lit(SALT)).cast("int")).join(salted, [*levels, "_salt"]).drop("_salt")


def plan(rows: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], budget_share: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """rows (levels, id, text_hash, tokens) to one row per leaf: levels, tokens, budget, epochs (whole ones) and cut (largest hash taken of the next)."""
    leaves = checkpointed(rows.groupBy(*levels).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    few = _few(leaves)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    leaves = budgets(leaves, levels, weights, budget_share * total, max_epochs)
    leaves = leaves.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("int"))
    leaves = checkpointed(leaves.withColumn("part", F.col("budget") - F.col("epochs") * F.col("tokens")))
    keyed = _with_leaf(rows, leaves.select(*levels, "epochs", "part"), levels, few, F.xxhash64("id", "text_hash"))
    keyed = keyed.select(*levels, "part", "tokens", seeded(seed, F.col("epochs"), F.col("id"), F.col("text_hash")).alias("key"))
    order, shift = Window.partitionBy(*levels).orderBy("slice"), HASH_BITS
    while True:  # a round leaves of each leaf the slice in which its prefix ends, and of its budget what is left for that slice
        shift -= SLICE_BITS
        slices = keyed.groupBy(*levels, F.shiftright("key", shift).alias("slice")).agg(F.sum("tokens").alias("here"), F.count(F.lit(1)).alias("docs"), F.first("part").alias("part"))
        slices = checkpointed(slices).withColumn("until", F.sum("here").over(order))
        ends = slices.where("until > part").groupBy(*levels).agg(F.min(F.struct("slice", (F.col("part") - F.col("until") + F.col("here")).alias("left"), "docs")).alias("e"))
        ends = checkpointed(ends.select(*levels, F.col("e.slice").alias("slice"), F.col("e.left").alias("left"), F.col("e.docs").alias("docs")))
        keyed = _with_leaf(keyed, ends.drop("docs"), levels, few, F.col("key")).where(F.shiftright("key", shift) == F.col("slice"))
        keyed = checkpointed(keyed.select(*levels, F.col("left").alias("part"), "tokens", "key"))
        if shift < SLICE_BITS or (ends.agg(F.max("docs")).first()[0] or 0) <= LAST_SLICE:
            break
    last = keyed.groupBy(*levels, "part", "key").agg(F.sum("tokens").alias("tokens"))
    last = last.withColumn("until", F.sum("tokens").over(Window.partitionBy(*levels).orderBy("key")))
    cuts = last.where("until <= part").groupBy(*levels).agg(F.max("key").alias("last_key"))
    none = F.shiftleft(F.col("slice"), shift) - 1
    every = F.lit((1 << HASH_BITS) - 1)
    ends = ends.select(*levels, "slice")
    return leaves.join(ends, levels, "left").join(cuts, levels, "left").select(*levels, "tokens", "docs", "budget", "epochs", F.coalesce("last_key", none, every).alias("cut"))


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, float]], id_col: str = "doc_id", text_col: str = "text", budget_share: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Columns row (all of docs as a struct), the levels, n_tokens and epoch: one row for each time a document is taken.

    levels: from the root down, each level's name and how documents give it. The budget is budget_share of all tokens.
    """
    names = list(levels)
    values = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()]
    text = F.col(f"`{text_col}`")
    rows = checkpointed(docs.select(*values, F.col(f"`{id_col}`").alias("id"), text_hash(text).alias("text_hash"), tokens_of(text).alias("tokens")))
    leaves = checkpointed(plan(rows, names, weights, budget_share, max_epochs, seed).select(*names, "epochs", "cut"))
    text = F.col(f"row.`{text_col}`")
    picked = _with_leaf(docs.select(*values, as_row(docs)), leaves, names, _few(leaves), F.xxhash64(text))
    more = (seeded(seed, F.col("epochs"), F.col(f"row.`{id_col}`"), text_hash(text)) <= F.col("cut")).cast("int")
    times = F.sequence(F.lit(0), F.col("epochs") + F.col("_more") - 1)
    picked = picked.withColumn("_more", more).where(F.col("epochs") + F.col("_more") > 0)
    return picked.select("row", *names, tokens_of(text).alias("n_tokens"), F.explode(times).alias("epoch"))
