"""I-Match fingerprints with several randomised lexicons.

The lexicon holds the terms (runs of letters and digits, lower-cased) whose document frequency is within
[LEAST, MOST] of all documents, and at least two documents, that is those in a band of inverse document frequency. It
has at most (mean distinct terms of a document) / LEAST terms at any size of corpus, so it is handed to all tasks.
A randomised lexicon is a random part of it, and an entry of a fingerprint the hash of the document's sorted distinct terms
in one. WIDE lexicons keep three quarters of the band each, so that their entries cover every term and agree where
hardly any term differs. The others are PARTS of 2 ** level equal parts, at the two levels at which such a part has about
half a term, or a quarter, of a document of this length; each sees few terms, and the share of them that agree falls
evenly with what texts share. Two fingerprints are as like as the larger of two shares: of the wide entries that agree,
and of the parts that agree among those in which either has a term, at a level that both have.

Null texts count as empty. A text with fewer than FEW terms in the band is fingerprinted by all its terms, one without
terms by the text itself. The next document is the one with the next larger doc_id, a number or a string (null is the
least; rows of one doc_id go by the checksum of their text), after the last the first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of, written

LEAST, MOST = 5e-4, 0.2
PARTS, FEW, WIDE = 24, 4, 6
LOWEST_LEVEL = 5
#: Documents whose successors one window finds, on average, and the most buckets.
PER_BUCKET, MOST_BUCKETS = 2048, 1 << 16
#: Bounds of buckets that are looked through at once.
AT_ONCE = 256


def terms(text: Column) -> Column:
    """Hashes of the distinct terms."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""), lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame) -> DataFrame:
    """term: hashes of the terms in the band."""
    counted = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = docs.count()
    return written(counted.filter((F.col("n") >= max(2, LEAST * total)) & (F.col("n") <= max(2, MOST * total))).select("term"))


@contextmanager
def constants(values: DataFrame, kinds: dict[str, str]) -> Iterator[dict[str, Column]]:
    """The columns of the one row of values as literals in expressions, by SQL variables that are there meanwhile."""
    spark, tag = values.sparkSession, uuid.uuid4().hex
    values.createOrReplaceTempView(f"values_{tag}")
    made = []
    try:
        for name, kind in kinds.items():
            spark.sql(f"DECLARE VARIABLE {name}_{tag} {kind}")
            made.append(name)
            spark.sql(f"SET VARIABLE {name}_{tag} = (SELECT {name} FROM values_{tag})")
        yield {name: F.expr(f"{name}_{tag}") for name in kinds}
    finally:
        for name in made:
            spark.sql(f"DROP TEMPORARY VARIABLE {name}_{tag}")
        spark.catalog.dropTempView(f"values_{tag}")


def as_buckets(lexicon: DataFrame) -> tuple[DataFrame, int]:
    """The lexicon as one array of buckets, which a hash leads to, and their number."""
    size = 1 << max(4, lexicon.count().bit_length())
    held = lexicon.groupBy(F.pmod("term", F.lit(size)).alias("slot")).agg(F.collect_list("term").alias("terms"))
    full = lexicon.sparkSession.range(size).join(held, F.col("id") == F.col("slot"), "left")
    pairs = full.select(F.struct("id", F.coalesce("terms", F.array().cast("array<bigint>")).alias("terms")).alias("pair"))
    return pairs.agg(F.transform(F.array_sort(F.collect_list("pair")), lambda p: p["terms"]).alias("lexicon")), size


def with_fingerprint(rows: DataFrame, text: str, name: str, buckets: Column, size: int) -> DataFrame:
    """rows with the fingerprint of the column text as name."""
    own, band, level, some = f"_{name}_own", f"_{name}_band", f"_{name}_level", f"_{name}_some"
    rows = rows.withColumn(own, terms(F.col(text)))
    rows = rows.withColumn(band, F.filter(own, lambda t: F.array_contains(F.element_at(buckets, (F.pmod(t, F.lit(size)) + 1).cast("int")), t)))
    rows = rows.withColumn(band, F.sort_array(F.when(F.size(band) >= FEW, F.col(band)).otherwise(F.col(own))))
    rows = rows.withColumn(level, F.greatest(F.lit(LOWEST_LEVEL), F.ceil(F.log2(F.greatest(F.size(band), F.lit(1)))).cast("int") + 1))
    # The part is told by other bits than those of the bucket.
    part = lambda t, lv: F.shiftrightunsigned(t, 20) % F.pow(F.lit(2.0), lv).cast("long")
    rows = rows.withColumn(some, F.filter(band, lambda t: part(t, F.col(level)) < PARTS))

    def wide_entry(k: int) -> Column:
        held = F.filter(band, lambda t: F.shiftrightunsigned(t, 50 + 2 * k).bitwiseAND(F.lit(3)) != 0)
        return F.lower(F.lpad(F.hex(F.shiftrightunsigned(F.xxhash64(held), 40)), 6, "0"))

    def entries(lv: Column) -> Column:
        def entry(k: Column) -> Column:
            own_terms = F.filter(some, lambda t: part(t, lv) == k)
            return F.when(F.size(own_terms) == 0, "-").otherwise(F.lower(F.lpad(F.hex(F.xxhash64(own_terms).bitwiseAND(F.lit(0xFFFF))), 4, "0")))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), entry), ".")

    print_ = F.concat_ws(":", F.col(level).cast("string"), entries(F.col(level)), entries(F.col(level) + 1), F.array_join(F.array(*map(wide_entry, range(WIDE))), "."))
    return rows.withColumn(name, F.when(F.size(band) == 0, F.concat(F.lit("0:"), F.sha2(text, 256))).otherwise(print_)).drop(own, band, level, some)


def likeness(a: str, b: str) -> Column:
    """From 0 to 1, of two columns of fingerprints."""
    x, y = F.split(a, ":"), F.split(b, ":")
    step = F.get(x, 0).cast("int") - F.get(y, 0).cast("int")
    of_a = F.split(F.get(x, F.when(step < 0, 2).otherwise(1)), r"\.")
    of_b = F.split(F.get(y, F.when(step > 0, 2).otherwise(1)), r"\.")
    both = F.zip_with(of_a, of_b, lambda p, q: F.when((p == "-") & (q == "-"), 0).when(p == q, 2).otherwise(1))
    either, same = F.size(F.filter(both, lambda v: v > 0)), F.size(F.filter(both, lambda v: v == 2))
    parts = F.when((F.abs(step) > 1) | (either == 0), 0.0).otherwise(same / either)
    wide = F.size(F.filter(F.zip_with(F.split(F.get(x, 3), r"\."), F.split(F.get(y, 3), r"\."), lambda p, q: p == q), lambda v: v)) / float(WIDE)
    return F.when(F.col(a) == F.col(b), 1.0).when(F.startswith(F.col(a), F.lit("0:")) | F.startswith(F.col(b), F.lit("0:")), 0.0).otherwise(F.greatest(parts, wide))


def bounds_of(ids: DataFrame) -> list:
    """The first doc_id of each of even ranges, MOST_BUCKETS at most; the first one is the least of all. Equal ids are in
    one range."""
    n = max(1, min(MOST_BUCKETS, -(-ids.count() // PER_BUCKET)))
    ranges = ids.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).groupBy(F.spark_partition_id().alias("p"))
    found = ranges.agg(F.min("doc_id").alias("first"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).collect()
    firsts = sorted({r["first"] for r in found if r["first"] is not None})
    return [None, *firsts[1:]] if any(r["nulls"] for r in found) and firsts else firsts or [None]


def with_next(rows: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """rows with next_... of the columns, from the row that follows in doc_id. Buckets are ranges of doc_id; each also
    gets a copy of the next bucket's first row."""
    kind, bounds = dict(ids.dtypes)["doc_id"], bounds_of(ids)
    inner = [bounds[k : k + AT_ONCE] for k in range(1, len(bounds), AT_ONCE)]
    literals = ids.sparkSession.createDataFrame([(bounds, [group[0] for group in inner], inner)], f"bounds array<{kind}>, firsts array<{kind}>, inner array<array<{kind}>>")
    with constants(literals, {"bounds": f"ARRAY<{kind}>", "firsts": f"ARRAY<{kind}>", "inner": f"ARRAY<ARRAY<{kind}>>"}) as c:
        till = lambda some: F.size(F.filter(some, lambda b: b <= F.col("doc_id")))
        both = rows.withColumn("group", till(c["firsts"]))
        both = both.withColumn("bucket", F.when(F.col("group") == 0, 0).otherwise((F.col("group") - 1) * AT_ONCE + till(F.get(c["inner"], F.col("group") - 1))))
        is_first = F.col("doc_id").eqNullSafe(F.get(c["bounds"], F.col("bucket")))
        own, copy = F.struct(F.col("bucket").alias("to"), F.lit(False).alias("is_copy")), F.struct(F.pmod(F.col("bucket") - 1, F.lit(len(bounds))).alias("to"), F.lit(True).alias("is_copy"))
        both = both.withColumn("place", F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own))))
    # Plain columns: a field of a struct would be named anew by each window, and the texts shuffled for each.
    both = both.withColumns({"to": F.col("place.to"), "is_copy": F.col("place.is_copy")}).drop("group", "bucket", "place")
    inside = Window.partitionBy("to").orderBy("is_copy", F.col("doc_id").asc_nulls_first(), "tie")
    both = both.withColumns({f"next_{c}": F.lead(c).over(inside) for c in columns})
    return both.filter("NOT is_copy").drop("to", "is_copy")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    rows = docs.select("doc_id", text_of().alias("text"))
    held, size = as_buckets(lexicon(rows))
    with constants(held, {"lexicon": "ARRAY<ARRAY<BIGINT>>"}) as c:
        rows = with_fingerprint(rows, "text", "fingerprint", c["lexicon"], size).withColumn("tie", F.xxhash64("text"))
        rows = with_next(rows, docs.select("doc_id"), ["text", "fingerprint"])
        n = F.length("text")
        cut = F.floor(n / 4).cast("int")
        rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
        rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "next_fingerprint", "edited")
        rows = with_fingerprint(rows, "edited", "edited_fingerprint", c["lexicon"], size)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
