"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a fixed random order, repeated
when the target asks for more than the source holds. A document's virtual
finish time is the number of words its source has sent up to its end, divided
by the source's target. All documents go into one order of finish times, cut
where the words reach the budget, so every source gets its share to within a
document.

Only DataFrame functions run. Nothing gathers a source in one task: running
sums are taken inside (source, bucket of the random key) and put on the sums of
the buckets before; the global order is cut first between slots of finish time,
then inside the one slot that crosses the budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yardline.llm.storage import stored

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
KEY_DIGITS = 3
SLOTS = 4096


def _targets(sizes: DataFrame) -> DataFrame:
    """Targets of the sources: shares by weight 1, 2, 3, ... of all words, none above ``MOST`` times its source.

    Sources in the order of cap / weight are capped while the share that the
    rest would get reaches the cap.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumn("cap", F.lit(MOST) * F.col("source_size"))
    order = everything.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything)
    levels = ranked.withColumn("budget", total).withColumn("level", (total - before) / rest)
    free = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))
    level = F.max(free).over(everything)
    target = F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(float(MOST))) * F.col("weight"))
    return levels.select("source", "rank", "source_size", target.alias("target"), "budget")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken, finish``.

    ``taken`` counts the words of all copies of the document in the mix,
    ``finish`` is the virtual finish time of its first copy. Null texts have no
    words, and null is a source of its own, ordered last. Sources without words
    have the target 0. Repeated rows queue one after another. No rows give no
    rows; further columns are ignored.
    """
    sized = stored(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.col(source_column).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
    )
    targets = _targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    key = F.md5(F.concat(F.lit("mix-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    keyed = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select(
        "doc_id", "size", "rank", "source_size", "target", "budget", key.alias("key"), F.substring(key, 1, KEY_DIGITS).alias("bucket")
    )
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("rank", "bucket").agg(F.sum("size").alias("held"))
    offsets = offsets.select("rank", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("rank", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.join(offsets, ["rank", "bucket"]).withColumn("end", F.col("offset") + F.sum("size").over(inside))
    queued = stored(placed.select("doc_id", "size", "rank", "source_size", "target", "budget", "key", "end"))

    finish = (F.col("pass") * F.col("source_size") + F.col("end")) / F.col("target")
    begun = F.col("pass") * F.col("source_size") + F.col("end") - F.col("size") < F.col("target")
    slot = F.least(F.floor(F.col("finish") * SLOTS), F.lit(2 * SLOTS)).cast("long")
    copies = (
        queued.where("target > 0")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))))
        .where(begun)
        .withColumn("finish", finish)
        .withColumn("slot", slot)
    )
    ordered = Window.partitionBy(F.lit(0)).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = copies.groupBy("slot").agg(F.sum("size").alias("held"), F.max("budget").alias("budget"))
    slots = slots.withColumn("sent", F.sum("held").over(ordered)).where("sent > budget")
    crossing = slots.agg(F.min(F.struct("slot", (F.col("sent") - F.col("held")).alias("sent"))).alias("c")).select("c.*")
    turn = F.struct("finish", "rank", "key", "doc_id", "size", "pass")
    within = Window.partitionBy("slot").orderBy("finish", "rank", "key", "doc_id", "size", "pass").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        copies.join(F.broadcast(crossing.where("slot IS NOT NULL")), "slot")
        .withColumn("total", F.col("sent") + F.sum("size").over(within))
        .agg(F.max("slot").alias("cut_slot"), F.max(F.when(F.col("total") <= F.col("budget"), turn)).alias("last"))
    )

    cut = last.first()
    if cut["last"] is not None:
        cut_turn = F.struct(*(F.lit(v).cast(copies.schema[c].dataType).alias(c) for c, v in cut["last"].asDict().items()))

    def sent(n: int):
        copy = {"finish": (F.lit(n) * F.col("source_size") + F.col("end")) / F.col("target"), "pass": F.lit(n)}
        begun_n = F.lit(n) * F.col("source_size") + F.col("end") - F.col("size") < F.col("target")
        slot_n = F.least(F.floor(copy["finish"] * SLOTS), F.lit(2 * SLOTS)).cast("long")
        early = F.lit(True)
        if cut["cut_slot"] is not None:
            early = slot_n < cut["cut_slot"]
            if cut["last"] is not None:
                turn_n = F.struct(*(copy.get(c, F.col(c)).alias(c) for c in cut["last"].asDict()))
                early = early | ((slot_n == cut["cut_slot"]) & (turn_n <= cut_turn))
        return F.when((F.col("target") > 0) & begun_n, F.when(early, 1).otherwise(0)).otherwise(0)

    taken = sum((sent(n) for n in range(1, MOST)), sent(0))
    return queued.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * taken).alias("taken"),
        F.when(F.col("target") > 0, F.col("end") / F.col("target")).alias("finish"),
    )
