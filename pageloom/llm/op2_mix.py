"""Mixing sources to target weights by entropy balancing.

Of all document rates in [0, 3] that give each source its target of words, the ones closest to "every document once" in
(bounded) relative entropy are r = 3 / (1 + 2 exp(-lambda * size / scale)), an exponential tilt of the even rate by the
document's size. The multiplier of each source solves the convex dual; Newton's iterations run over the counts of
(source, size), which the rates depend on alone, with a bracket that halves where a step leaves it. Rates become whole
copies by a rounding that a checksum of doc_id decides, and what a source then lacks or has too much is made up by
documents that fit into the gap.

Null texts count as empty and have size 0; documents without words are taken not at all. A null source is a source of
its own, the last. Repeated rows are rounded as one or apart, with the same total. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, dropped, table, text_of, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
STEPS, CLOSE = 30, 1e-7
REPAIRS = 4
#: Rows that a bucket of the repairs holds on average.
PER_BUCKET = 2048
EDGE = 1e4


def target_table(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, sid, source_size, target, scale: one row per source. All windows here run over sources, not documents."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size").cast("double") * F.col("size")).alias("squares"))
    ranked = sources.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    most = (F.col("source_size") * MOST).cast("double")
    ranked = ranked.withColumn("weight", weight).withColumn("most", most)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("most") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    # The level after all sources that fill up earlier stand at their most.
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = ranked.withColumn("level", level).withColumn("full", F.col("most") < F.col("weight") * F.col("level"))
    in_order = Window.orderBy(F.col("most") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(in_order)
    return levels.withColumn("target", F.least("most", F.col("weight") * F.coalesce(last, "level"))).select(
        "source", "sid", "source_size", "target", F.when(F.col("source_size") > 0, F.col("squares") / F.col("source_size")).otherwise(1.0).alias("scale")
    )


def rate(multiplier: Column, size: Column, scale: Column) -> Column:
    return F.when(multiplier >= EDGE, F.lit(float(MOST))).otherwise(MOST / (1 + (MOST - 1) * F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -multiplier * size / scale)))))


def solve(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """sid, multiplier: Newton's iterations on the dual, one pass over the counts each."""
    full = F.col("target") >= F.col("source_size") * MOST * (1 - 1e-12)
    state = written(
        targets.select("sid", "target", "scale", F.when(full, EDGE).otherwise(0.0).alias("multiplier"), F.lit(-EDGE).alias("low"), F.lit(EDGE).alias("high"), full.alias("done")).coalesce(1)
    )
    for _ in range(STEPS):
        r = rate(F.col("multiplier"), F.col("size"), F.col("scale"))
        mass = F.col("n") * F.col("size")
        sums = (
            counts.join(state.filter("not done").select("sid", "multiplier", "scale"), "sid")
            .groupBy("sid")
            .agg(F.sum(mass * r).alias("has"), F.sum(mass * F.col("size") / F.col("scale") * r * (1 - r / MOST)).alias("slope"))
        )
        gap, old = F.col("has") - F.col("target"), F.col("multiplier")
        low, high = F.when(gap < 0, old).otherwise(F.col("low")), F.when(gap > 0, old).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, old - gap / F.col("slope"))
        step = F.when((newton > low) & (newton < high), F.greatest(old - 8.0, F.least(old + 8.0, newton))).otherwise((low + high) / 2)
        now_done = F.col("done") | F.col("has").isNull() | (F.abs(gap) <= CLOSE * F.col("target"))
        new = written(
            state.join(sums, "sid", "left")
            .select("sid", "target", "scale", F.when(now_done, old).otherwise(step).alias("multiplier"), F.when(now_done, F.col("low")).otherwise(low).alias("low"), F.when(now_done, F.col("high")).otherwise(high).alias("high"), now_done.alias("done"))
            .coalesce(1)
        )
        dropped(state)
        state = new
        if state.filter("not done").isEmpty():
            break
    return state.select("sid", "multiplier")


def _draw(seed: int) -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed))


def repair(rows: DataFrame, buckets: int, seed: int) -> DataFrame:
    """One copy more, or less, of documents that fit into their source's gap, in the order of a checksum. Sums run over
    buckets of that order first, so that no task sees a whole source."""
    gaps = rows.groupBy("sid").agg(F.first("target").alias("goal"), F.sum(F.col("copies") * F.col("size")).alias("has"))
    gaps = written(gaps.select("sid", F.signum(F.col("goal") - F.col("has")).cast("int").alias("way"), F.abs(F.col("goal") - F.col("has")).alias("gap")).coalesce(1))
    fits = (F.col("size") > 0) & (F.col("size") <= F.col("gap")) & (F.col("copies") + F.col("way")).between(0, MOST)
    marked = rows.join(gaps, "sid").withColumn("draw", _draw(seed)).withColumn("bucket", F.pmod("draw", F.lit(buckets))).withColumn("room", F.when(fits, F.col("size")).otherwise(0))
    sums = marked.groupBy("sid", "bucket").agg(F.sum("room").alias("all"))
    sums = written(sums.withColumn("before", F.sum("all").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("all")).select("sid", "bucket", "before"))
    inside = F.sum("room").over(Window.partitionBy("sid", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    taken = (F.col("room") > 0) & (F.col("before") + inside <= F.col("gap"))
    return marked.join(sums, ["sid", "bucket"]).withColumn("taken_now", taken).select("doc_id", "sid", "size", "source_size", "target", "rate", (F.col("copies") + F.when(F.col("taken_now"), F.col("way")).otherwise(0)).alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies of every row: the source's target and the document's share in it."""
    sized = written(docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size")))
    targets = written(target_table(sized, weights).coalesce(1))
    rows = sized.join(targets, sized.source.eqNullSafe(targets.source)).select("doc_id", "size", "sid", "source_size", "target", "scale")
    counts = written(rows.groupBy("sid", "size").agg(F.count(F.lit(1)).alias("n")))
    solved = solve(counts, targets)
    r = rate(F.col("multiplier"), F.col("size"), F.col("scale"))
    chance = F.shiftrightunsigned(_draw(0), 11) / float(1 << 53)
    rows = written(
        rows.join(solved, "sid")
        .withColumn("rate", F.when(F.col("size") > 0, r).otherwise(0.0))
        .select("doc_id", "sid", "size", "source_size", "target", "rate", F.least(F.lit(MOST), F.floor(F.col("rate") + chance)).cast("int").alias("copies"))
    )
    buckets = max(1, -(-rows.count() // PER_BUCKET))
    for k in range(1, REPAIRS + 1):
        new = written(repair(rows, buckets, k))
        dropped(rows)
        rows = new
    return rows


def apply(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "rate")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"))
