"""Mixing sources to target weights by a low-discrepancy schedule.

Every source gets a target: its share, by weight, of SHARE times all words,
but never over CAP times its own words; what a capped source leaves is shared
again by weight until no source is above. Slots of equal size are dealt to
sources by a golden-ratio sequence: the fractional part of n times the golden
ratio falls into one of the intervals that the targets cut from [0, 1). Slots
are ranked within their source and slot k takes block k of the source, whose
documents stand in the order of a hash, repeated as often as the target asks.
The points give a source a few blocks more or less than its target asks:
what is too much is cut, what lacks is added in slots after the others, and of
the last block only the words up to the target (rounded) are taken. So every
source gives its target exactly, be it less than a block. A document's taken
words are what the taken blocks hold of it.

Running sums and ranks are taken in two levels, over hash buckets and within
them, so that no task holds a whole source. The number of slots is fixed, so
blocks grow with the corpus and the schedule does not.

Cases: null texts have no words and are never taken; a null source is a source
of its own, the last; repeated rows are documents of their own; words of very
long texts fall into many blocks; without any words all is zero; an empty
table gives an empty result; other columns are kept by mix and not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm.common import WORD, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
#: Slots of the schedule; a block is the target words of all sources over these.
SLOTS = 1 << 20
#: Hash buckets of a source, runs of slots that are ranked together, and cells of [0, 1).
BUCKETS, RUN, CELLS = 2048, 4096, 4096
#: The golden ratio less one, as a fraction of 2^32 (odd, so that no point repeats).
GOLDEN, TURN = 2654435769, 1 << 32
SEED = 17


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds weight and target to a table of sources (source, source_size).

    The level is the words per weight at which the capped targets sum to the
    share of all words. Sources in the order of cap over weight are capped up
    to some one, and the rest stay below: each prefix gives a level, and the
    one that fits is the highest that its next source's cap does not undercut.
    """
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights)) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    # Spark's string order is by UTF-8 bytes, which is the order of code points.
    by_need = W.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_need.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(
        by_need.rowsBetween(0, W.unboundedFollowing)
    )
    rows = rows.withColumn("level", level)
    fits = F.max(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))).over(everything)
    return rows.withColumn("target", F.least("most", F.coalesce(fits * F.col("weight"), F.col("most")))).select("source", "source_size", "weight", "target")


def wanted() -> Column:
    """The words that a source gives: its target, rounded."""
    return F.round("target").cast("long")


def schedule(mix_targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Slots as (source, block, slot): slot n takes the block of its rank within its source.

    mix_targets has source, target and block_size; as many of the slots are
    dealt as the sum of targets fills. A source has as many blocks as its target
    needs, the last one for a part perhaps.
    """
    spark = mix_targets.sparkSession
    order = W.orderBy(F.col("source").isNull(), "source")
    total = F.sum("target").over(W.partitionBy())
    upto = F.sum("target").over(order.rowsBetween(W.unboundedPreceding, 0))
    share = ((upto - F.col("target")) / total).alias("low"), (upto / total).alias("high")
    needs = F.ceil(wanted() / F.col("block_size")).cast("long").alias("needs")
    cuts = mix_targets.where("target > 0").select("source", *share, F.ceil(total / F.col("block_size")).alias("used"), needs)
    cells = cuts.select(
        "source",
        "low",
        "high",
        "used",
        "needs",
        F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell"),
    )
    point = (F.col("id") * F.lit(GOLDEN)) % F.lit(TURN) / F.lit(float(TURN))
    points = spark.range(1, slots + 1).select(F.col("id").alias("slot"), point.alias("point"))
    dealt = points.withColumn("cell", F.floor(F.col("point") * CELLS)).join(cells, "cell").where("point >= low and point < high and slot <= used")
    dealt = dealt.select("source", "slot", "needs", F.floor(F.col("slot") / RUN).alias("run"))
    runs = dealt.groupBy("source", "run").agg(F.count(F.lit(1)).alias("n"))
    first = F.sum("n").over(W.partitionBy("source").orderBy("run")) - F.col("n")
    runs_of = runs.groupBy(F.col("source").alias("_source")).agg(F.sum("n").alias("got"))
    runs = runs.select(F.col("source").alias("_source"), F.col("run").alias("_run"), first.alias("first"))
    ranked = dealt.join(runs, dealt["source"].eqNullSafe(runs["_source"]) & (dealt["run"] == runs["_run"]))
    rank = F.row_number().over(W.partitionBy("source", "run").orderBy("slot"))
    ranked = ranked.select("source", (F.col("first") + rank - 1).cast("long").alias("block"), "slot", "needs").where("block < needs").drop("needs")
    got = F.coalesce("got", F.lit(0))
    lacks = cuts.join(runs_of, cuts["source"].eqNullSafe(runs_of["_source"]), "left").select("source", "used", got.alias("got"), (F.col("needs") - got).alias("lack")).where("lack > 0")
    before = F.sum("lack").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("lack")
    added = lacks.select("source", "got", (F.col("used") + before + 1).alias("slot"), F.explode(F.sequence(F.lit(0), F.col("lack") - 1)).alias("k"))
    return ranked.unionByName(added.select("source", (F.col("got") + F.col("k")).cast("long").alias("block"), (F.col("slot") + F.col("k")).cast("long").alias("slot")))


def _placed(rows: DataFrame) -> DataFrame:
    """Adds start: the words of the source before the document, in the order of a hash.

    rows have source, size, mark (a hash of the document) and doc_id (breaks ties of it).
    """
    bucket = F.pmod("mark", F.lit(BUCKETS))
    rows = rows.withColumn("bucket", bucket)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n")
    sums = sums.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), before.alias("_before"))
    joined = rows.join(sums, rows["source"].eqNullSafe(sums["_source"]) & (rows["bucket"] == sums["_bucket"]))
    inside = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("mark", "doc_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    return joined.withColumn("start", F.col("_before") + inside).drop("_source", "_bucket", "_before", "bucket")


def _mark(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], docs["text"], F.lit(SEED))


ROW = ("doc_id", "mark", "source", "size", "source_size", "target", "start")


def taken(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Per row of docs: doc_id, mark, source, size, source_size, target, start, taken."""
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["source"].cast("string").alias("source"),
        words(docs["text"].cast("string")).alias("size"),
        _mark(docs).alias("mark"),
    )
    rows = written(rows, "mixing-sizes")  # four plans below read these narrow rows instead of the texts
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    block_size = F.greatest(F.ceil(F.sum("target").over(W.partitionBy()) / slots), F.lit(1)).cast("long")
    goals = goals.select(F.col("source").alias("_s"), "source_size", "target", block_size.alias("block_size"))
    goals = written(goals, "mixing-targets")
    placed = _placed(rows)
    placed = placed.join(goals, placed["source"].eqNullSafe(goals["_s"])).drop("_s")
    # A source's stream is repeated up to CAP times; a document's words lie in these blocks of it.
    passes = placed.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(int(CAP) - 1))).alias("pass"))
    passes = passes.withColumn("at", F.col("start") + F.col("pass") * F.col("source_size"))
    spread = passes.select("*", F.explode(F.expr("sequence(at div block_size, (at + size - 1) div block_size)")).alias("part"))
    low = F.greatest(F.col("at"), F.col("part") * F.col("block_size"))
    high = F.least(F.col("at") + F.col("size"), (F.col("part") + 1) * F.col("block_size"))
    pieces = spread.select(*ROW, "part", F.greatest(F.least(high, wanted()) - low, F.lit(0)).alias("n"))
    plan = schedule(goals.select(F.col("_s").alias("source"), "target", "block_size"), slots).select(F.col("source").alias("_s"), F.col("block").alias("_b"), "slot")
    met = pieces.join(plan, pieces["source"].eqNullSafe(plan["_s"]) & (pieces["part"] == plan["_b"]), "left")
    got = F.sum(F.when(F.col("slot").isNotNull(), F.col("n")).otherwise(0)).cast("long").alias("taken")
    none = placed.where("size = 0").select(*ROW, F.lit(0).cast("long").alias("taken"))
    return met.groupBy(*ROW).agg(got).unionByName(none)


def mixed(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The rows of docs as often as the mix takes them, in whole documents: taken over size, rounded."""
    rows = taken(docs, slots).where("size > 0").groupBy("doc_id", "mark")
    copies = rows.agg(F.sum(F.floor(F.col("taken") / F.col("size") + 0.5)).alias("copies"), F.count(F.lit(1)).alias("alike")).where("copies > 0")
    copies = copies.select(F.col("doc_id").alias("id"), "mark", "copies", "alike")
    held = docs.select(F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("own"), docs["source"].cast("string").alias("source"), _mark(docs).alias("mark"))
    # The join and the window share one shuffle, by mark, which is confirmed after the window.
    # Rows that are alike share their copies evenly.
    joined = held.join(copies, "mark").withColumn("same", F.col("own").eqNullSafe(F.col("id")))
    rank = F.row_number().over(W.partitionBy("mark", "own").orderBy(F.desc("same"), "source"))
    mine = F.expr("copies div alike") + F.when(F.col("rank") <= F.col("copies") % F.col("alike"), 1).otherwise(0)
    counted = joined.withColumn("rank", rank).withColumn("mine", mine.cast("int")).where("same and mine > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1), F.col("mine"))).alias("copy")).select("row.*")
