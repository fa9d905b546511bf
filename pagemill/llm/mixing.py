"""Mixing sources to target weights (operator 3) by entropy balancing, with DataFrame operations alone.

Of all document rates that make each source's words meet its target and that take no document more than ``cap`` times, the wanted ones are
closest in (bounded) relative entropy to the corpus, document by document. Its dual is convex, with a multiplier m for each source's constraint on
words: a document of base rate q whose size is x times its source's mean is tilted to ``cap q e^(m x) / (cap - q + q e^(m x))``, so the words that a
source has too few or too many of come from its long documents first, and short ones stay near their base rate. Newton's method solves it: each
iteration sums the gradient (words now taken less the target) and the curvature over the cells of documents of one source, size and base rate, and moves all
multipliers at once; a step that would leave the interval known to hold a multiplier halves that instead, so it always converges. Sums are
of integers, so reruns agree. Rates are then rounded to whole copies: along each source's documents, largest first, the sum of copies
follows the sum of rates to half a copy. Where a long document holds much of a source that is off by up to half of its words; all other
free documents of the source settle what is over or missing, so that the words are off by less than the smallest free document has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROWS, cut, plain_plans, whole

WEIGHTS, CAP = (5, 2, 1), 3
#: Documents to each part of a table whose copies are numbered by themselves in each source and size class; parts at most.
BLOCK, PARTS = 1000, 100_000
#: Of a rate, the unit in which rates are summed.
UNIT = 1 << 24
#: Rounds of the correction that spread the residue evenly, and how much smaller than it a document is that takes part.
SPREAD, FINE = 2, 16
#: How near the words come to the target (as a share) before copies are rounded.
TOLERANCE, ITERATIONS = 1e-6, 200


def _key() -> Column:
    """The source; null is a source of its own, and last."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, h, size) of every row: its source's key, a hash of the whole row that orders rows, its number of words."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return rows.select("doc_id", _key().alias("key"), F.xxhash64("doc_id", "source", "text").alias("h"), size.alias("size"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(key, source_size, target), one row a source: shares of all words by weight, none above ``cap`` times its own words."""
    own = rows.groupBy("key").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("key") == "~", "key"))
    own = own.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place - 1) % len(weights) + 1))
    # the share of one unit of weight once the sources that reach their cap first are full: the largest over all such prefixes
    order = W.orderBy(F.col("source_size") * cap / F.col("weight"), "key")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    all_ = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = F.sum("source_size").over(all_) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0.0))
    unit = rest / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    own = own.withColumn("unit", unit).withColumn("unit", F.max("unit").over(all_))
    return own.select("key", "source_size", F.least(F.col("unit") * F.col("weight"), F.col("source_size") * F.lit(float(cap))).alias("target"))


def balanced(rows: DataFrame, goals: DataFrame, cap: float = CAP, base: Column | None = None) -> DataFrame:
    """(key, m, mean) of every source: the multiplier that makes the tilted rates meet ``goals`` (a null m: the rate is ``cap``), the mean size."""
    cells = cut(rows.where("size > 0").withColumn("q", (F.lit(1.0) if base is None else base).cast("double")).groupBy("key", "size", "q").agg(F.count("*").alias("n")))
    few = (cells.count() + goals.count()) // ROWS + 1
    cells, goals = whole(cells, few), whole(goals, few)
    means = cells.groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    full = F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)
    start = goals.join(means, "key", "left").select("key", "target", F.coalesce("mean", F.lit(1.0)).alias("mean"), F.when(~full, 0.0).alias("m"))
    done = start.where("m is null").select("key", "m", "mean")
    dual = cut(start.where("m is not null").select("*", F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")).coalesce(few))
    words = (F.col("size") * F.col("n")).cast("decimal(20,0)")
    for turn in range(ITERATIONS):
        x = F.col("size") / F.col("mean")
        rate = tilted(F.col("q"), F.col("m") * x, cap)
        now = F.sum(words * F.round(rate * UNIT).cast("decimal(18,0)")).cast("double") / UNIT
        slope = F.sum(words * F.round(x * rate * (1 - rate / cap) * UNIT).cast("decimal(18,0)")).cast("double") / UNIT
        sums = cells.join(whole(dual, few), "key").groupBy("key", "target", "mean", "m", "low", "high").agg(now.alias("now"), slope.alias("slope"))
        gap = F.col("now") - F.col("target")
        sums = sums.withColumn("gap", gap).withColumn("low", F.when(gap < 0, F.col("m")).otherwise(F.col("low"))).withColumn("high", F.when(gap < 0, F.col("high")).otherwise(F.col("m")))
        step = F.when(F.col("slope") > 0, F.col("m") - F.col("gap") / F.col("slope"))
        inside = (step > F.col("low")) & (step < F.col("high"))
        wide = F.when(F.col("high") == float("inf"), 2 * F.abs("m") + 1).when(F.col("low") == float("-inf"), -2 * F.abs("m") - 1).otherwise((F.col("low") + F.col("high")) / 2)
        far = F.abs(F.col("gap")) > TOLERANCE * F.col("target")
        dual = cut(sums.select("key", "target", "mean", F.when(~far, F.col("m")).when(inside, step).otherwise(wide).alias("m"), "low", "high", far.alias("far")).coalesce(few))
        if turn % 3 == 2 and dual.where("far").isEmpty():  # a multiplier that has arrived stays
            return done.unionByName(dual.select("key", "m", "mean"))
        dual = dual.drop("far")
    raise RuntimeError(f"the multipliers of the mix haven't converged in {ITERATIONS} iterations")


def tilted(q: Column, tilt: Column, cap: float) -> Column:
    return F.lit(float(cap)) * q / (q + (F.lit(float(cap)) - q) * F.exp(-tilt))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, h, size, source_size, target, copies) of every row of ``docs`` (doc_id, text, source; others are ignored).

    A null text has no words; a null source is a source; rows of equal id and text are rows of their own, and which of them
    gets a further copy doesn't show. A document without words is taken as often as its base rate says, no words
    each time, or never where its source's target is 0. An empty table gives none.
    """
    rows = cut(sizes(docs))
    goals = cut(targets(rows, weights, cap))
    dual = balanced(rows, goals, cap)
    rates = cut(goals.join(dual, "key").select("key", "source_size", "target", "m", "mean"))
    # blocks: sources by falling size class, each cut by hash into the same number of parts
    parts = min(PARTS, rows.count() // BLOCK + 1)
    rows = rows.withColumn("k", F.floor(F.log2(F.col("size") + 1.0)).cast("int")).withColumn("s", F.pmod(F.xxhash64("h"), F.lit(parts)).cast("int"))
    # documents of a block and a size have one rate: its sums need the sizes alone
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("m").isNull(), float(cap)).otherwise(tilted(F.lit(1.0), F.col("m") * F.col("size") / F.col("mean"), cap))
    unit = F.round(rate * UNIT).cast("long")
    cells = rows.groupBy("key", "k", "s", "size").agg(F.count("*").alias("n")).join(rates, "key")
    blocks = cells.groupBy("key", "k", "s", "source_size", "target", "m", "mean").agg(F.sum(F.col("n") * unit).alias("units"))
    ahead = W.partitionBy("key").orderBy(F.desc("k"), "s").rowsBetween(W.unboundedPreceding, -1)
    blocks = cut(blocks.withColumn("ahead", F.coalesce(F.sum("units").over(ahead), F.lit(0))).drop("units"))
    within = W.partitionBy("key", "k", "s").orderBy(F.desc("size"), "h")
    rows = rows.join(blocks, ["key", "k", "s"]).withColumn("unit", unit).withColumn("i", F.row_number().over(within))
    upto = F.col("ahead") + F.sum("unit").over(within.rowsBetween(W.unboundedPreceding, 0))
    whole = F.expr(f"(upto + {UNIT // 2}) div {UNIT} - (upto - unit + {UNIT // 2}) div {UNIT}")
    rows = cut(rows.withColumn("upto", upto).select("doc_id", "h", "key", "k", "s", "i", "size", "source_size", "target", F.least(whole, F.lit(cap)).cast("long").alias("copies")))
    with plain_plans(docs.sparkSession):
        rows = settled(rows, cap)
    return rows.select("doc_id", "h", "size", "source_size", "target", "copies")


def _short(rows: DataFrame, cap: int) -> tuple[DataFrame, Column]:
    """(key, k, s, missing): the words that the block's source lacks, below 0 if over; and whether a row can be moved to mend that."""
    own = rows.groupBy("key", "k", "s").agg(F.first("target").alias("goal"), F.sum(F.col("copies") * F.col("size")).alias("words"))
    short = own.select("key", "k", "s", (F.col("goal") - F.sum("words").over(W.partitionBy("key"))).alias("missing"))
    free = (F.col("size") > 0) & (((F.col("missing") > 0) & (F.col("copies") < cap)) | ((F.col("missing") < 0) & (F.col("copies") > 0)))
    return cut(short), free


def settled(rows: DataFrame, cap: int) -> DataFrame:
    """``rows`` with copies moved by one at a time until no free document of a source is as small as what its words are off.

    The first rounds spread the residue evenly over all free documents far smaller than it, which is one rate more for them;
    the others take free documents, largest first, up to the residue, which leaves two thirds of it at most. Last, a single document
    may overshoot, if that is nearer.
    """
    block, move = ["key", "k", "s"], F.signum("missing").cast("long")
    within, ahead = W.partitionBy(*block).orderBy("i").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("key").orderBy(F.desc("k"), "s").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy("key")
    turn = 0
    while True:
        spread, turn = turn < SPREAD, turn + 1
        short, free = _short(rows, cap)
        can = free & (F.col("size") <= F.abs("missing") / (FINE if spread else 1))
        sums = rows.join(short, block).where(can).groupBy(*block).agg(F.first("missing").alias("missing"), F.count("*").alias("n"), F.sum("size").alias("words"))
        share = F.least(F.lit(1.0), F.abs("missing") / F.sum("words").over(everything))
        sums = cut(sums.select(*block, "missing", share.alias("share"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n_ahead"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("words_ahead")))
        if sums.isEmpty():
            if spread:
                continue
            break
        marked = rows.join(sums, block, "left").withColumn("can", F.coalesce(can, F.lit(False)))
        place = F.col("n_ahead") + F.sum(F.col("can").cast("long")).over(within)
        words = F.col("words_ahead") + F.sum(F.when(F.col("can"), F.col("size")).otherwise(0)).over(within)
        taken = F.floor(F.col("share") * place + 0.5) > F.floor(F.col("share") * (place - 1) + 0.5) if spread else words <= F.abs("missing")
        rows = cut(marked.withColumn("copies", F.col("copies") + F.when(F.col("can") & taken, move).otherwise(0)).select(*rows.columns))
    near = rows.join(short, block).where(free & (F.col("size") < 2 * F.abs("missing")))
    near = near.groupBy("key").agg(F.min(F.struct("size", "h", "k", "s", "i", move.alias("move"))).alias("x")).select("key", "x.k", "x.s", "x.i", "x.move")
    return rows.join(near, [*block, "i"], "left").withColumn("copies", F.col("copies") + F.coalesce("move", F.lit(0)))

def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row: the words that the mix takes of it, repeats counted."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as ``copies`` says."""
    names = docs.columns
    h = F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    plan = copies(docs).withColumn("__i", F.row_number().over(W.partitionBy("doc_id", "h").orderBy(F.desc("copies"))))  # above 1 for equal rows alone
    plan = cut(plan.where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("h").alias("__g"), "__i", F.col("copies").alias("__copies")))
    rows = docs.withColumn("__h", h).withColumn("__j", F.row_number().over(W.partitionBy("doc_id", "__h").orderBy("__h")))
    taken = rows.join(plan, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__g")) & (F.col("__j") == F.col("__i")))
    return taken.withColumn("__n", F.explode(F.expr("sequence(1, cast(__copies as int))"))).select(*names)
