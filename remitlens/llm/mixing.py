"""Mixing sources to target weights by fixed-length blocks.

The words of a source lie on one line, documents behind each other, cut into
blocks of ``block`` words. The output is a sequence of slots, each filled with one
block. A source gets a fixed number of slots (its target in blocks); which slots is
decided by one pseudorandom permutation of all slots, so that the source counts of a
shard (a range of slots) are a multinomial draw given the totals. The k-th
slot of a source takes block p(k): every pass over the source's blocks is a fresh
pseudorandom permutation, so no block is used again before all others were. Slots and
blocks meet in a join on (source, block).

Permutations are four-round Feistel networks on a grid of about sqrt(n) by sqrt(n)
with cycle walking, written as column expressions: nothing is sorted, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from remitlens.llm.common import buckets_for, stage, text_of, word_count
from remitlens.session import shuffle_width

MAX_EPOCHS = 3
BLOCK = 64
#: A source has at least this many blocks; smaller sources get shorter blocks.
LEAST_BLOCKS = 128
GROUP_ROWS = 2_000
SHARD_SLOTS = 16_384
ROUNDS, WALK = 4, 16


def _grid(n: Column) -> tuple[Column, Column]:
    """Sides a, b of the smallest near-square grid with a * b >= n; fewer than a cells are left over."""
    a = F.ceil(F.sqrt(n)).cast("long")
    return a, F.ceil(n / a).cast("long")


def permuted(x: Column, n: Column, *seed: Column) -> Column:
    """Pseudorandom permutation of 0 .. n-1, another one for every seed.

    The cells of the grid beyond n are walked over. There are fewer than sqrt(n) + 1
    of them, so up to 256 numbers 16 steps always suffice, and beyond that more are
    needed with a probability below 16 ** -16.
    """
    a, b = _grid(n)

    def network(v: Column) -> Column:
        left, right = F.pmod(v, a), F.floor(v / a).cast("long")
        for i in range(0, ROUNDS, 2):
            left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(i), *seed), a), a)
            right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(i + 1), *seed), b), b)
        return right * a + left

    first = network(x)
    walked = F.aggregate(F.array_repeat(F.lit(0), WALK), first, lambda at, _: F.when(at < n, at).otherwise(network(at)))
    return F.when(first < n, first).otherwise(walked)


def source_plan(sized: DataFrame, block: int, max_epochs: int) -> DataFrame:
    """One row per source: weight, source_size, target, block length, block and slot counts, first slot.

    Weights are 1, 2, 3 in turn by code point, null last. With sources in the order
    of max_epochs * size / weight, a source is at its limit while the share per unit of
    weight of what the earlier ones leave is above that ratio.
    """
    every = Window.partitionBy(F.lit(0))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = sources.withColumn("weight", (F.row_number().over(every.orderBy(F.asc_nulls_last("source"))) - 1) % 3 + 1)
    ratio = F.col("source_size") * max_epochs / F.col("weight")
    earlier = every.orderBy("ratio", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - max_epochs * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    shared = named.withColumn("ratio", ratio).withColumn("share", left / weights)
    free = shared.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("share"), F.struct("ratio", "share"))).over(every)["share"])
    target = F.least(F.col("source_size") * float(max_epochs), F.coalesce(F.col("level") * F.col("weight"), F.lit(float("inf"))))
    planned = free.withColumn("target", target.cast("double"))
    length = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long")
    blocks = F.ceil(F.col("source_size") / F.col("length")).cast("long")
    slots = F.when(F.col("blocks") == 0, 0).otherwise(F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).cast("long")
    planned = planned.withColumn("length", length).withColumn("blocks", blocks).withColumn("slots", F.least(slots, max_epochs * F.col("blocks")))
    before = every.orderBy(F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    return planned.select(
        "source", "weight", "source_size", "target", "length", "blocks", "slots",
        F.coalesce(F.sum("slots").over(before), F.lit(0)).alias("slots_before"), F.sum("slots").over(every).alias("slots_in_all"),
    )


def mix_slots(plan: DataFrame, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Every output slot with what fills it: shard, slot, source, pass, block.

    A source's slots are listed in two steps of about sqrt(slots), so that one row
    never unfolds into a large array.
    """
    step = F.greatest(F.lit(1), F.ceil(F.sqrt("slots"))).cast("long")
    runs = plan.filter("slots > 0").withColumn("step", step).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / F.col("step")))))
    runs = runs.repartition(shuffle_width(plan.sparkSession), "source", "run")
    first = F.col("run") * F.col("step")
    slots = runs.withColumn("k", F.explode(F.sequence(first, F.least(first + F.col("step"), F.col("slots")) - 1)))
    slots = slots.withColumn("pass", F.floor(F.col("k") / F.col("blocks")).cast("long"))
    slot = permuted(F.col("slots_before") + F.col("k"), F.col("slots_in_all"), F.lit(seed))
    block = permuted(F.pmod("k", "blocks"), F.col("blocks"), F.lit(seed), F.coalesce("source", F.lit("")), F.col("pass"))
    return slots.select(slot.alias("slot"), "source", "pass", block.alias("block")).withColumn("shard", F.floor(F.col("slot") / shard_slots).cast("long"))


def document_spans(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Where each row of ``sized`` lies on its source's line: adds start and the plan's columns.

    Running totals are taken inside hash buckets of about GROUP_ROWS rows and moved
    by the totals of earlier buckets, so a source held by a third of all rows is
    many small windows.
    """
    buckets = buckets_for(sized, GROUP_ROWS)
    dealt = sized.withColumn("bucket", F.pmod(F.xxhash64("id", "body"), F.lit(buckets)))
    totals = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("id", "body", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets.hint("merge"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    lines = plan.select(F.col("source").alias("_name"), "source_size", "target", "length")
    placed = placed.withColumn("start", F.col("offset") + F.col("within")).select("id", "source", "size", "start")
    return placed.join(lines, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0, block: int = BLOCK, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """How many words of each row of ``docs`` the mix takes.

    Returns id_col, source, size (words; null text: 0), source_size, target, taken
    (repeats counted) and first_slot (the first output slot with words of the row,
    null if none). Every row is answered, also rows that repeat an id. Null is a
    source of its own. A row without words takes none; a table without words or rows
    takes none. A source's taken words differ from its target by less than a block.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_of(text_col)).alias("size"), F.xxhash64(text_of(text_col)).alias("body"))
    sized = stage(sized, "mix-sizes")
    plan = stage(source_plan(sized, block, max_epochs).coalesce(1), "mix-plan")
    spans = stage(document_spans(sized, plan), "mix-spans")
    uses = mix_slots(plan, seed).groupBy("source", "block").agg(F.count("*").alias("uses"), F.min("slot").alias("slot"))
    # Unfolded slots are far more than the planner expects of the small plan: never a broadcast.
    uses = uses.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "uses", "slot").hint("merge")
    row = ["id", "source", "size", "source_size", "target", "start"]
    last = F.col("start") + F.col("size") - 1
    cut = spans.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.col("length")), F.floor(last / F.col("length")))))
    low, high = F.col("block") * F.col("length"), (F.col("block") + 1) * F.col("length")
    cut = cut.withColumn("words", F.least(high, last + 1) - F.greatest(low, F.col("start")))
    met = cut.join(uses, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")), "left")
    taken = met.groupBy(*row).agg(F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).alias("taken"), F.min("slot").alias("first_slot"))
    none = spans.filter("size = 0").select(*row, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return taken.unionByName(none).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken", "first_slot")
