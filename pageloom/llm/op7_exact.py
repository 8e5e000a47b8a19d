"""Exact dedup of incoming rows against an immutable snapshot.

The snapshot's distinct digests are dealt to shards, each with a static binary-fuse filter (Graf and Lemire, 2022).
Incoming digests are screened by their shard's filter; positives join the snapshot's exact buckets, and the rest, which
are surely new, are grouped among themselves. Texts of every bucket are then compared byte by byte.

Nulls count as the empty text, and equal texts are those identical after no change. The row with the largest doc_id of
equal texts stays (a null doc_id is the smallest). Repeated rows give repeated rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of, table, text_of, with_keys, written

#: Distinct digests of a shard on average: what a task holds.
PER_SHARD = 1 << 16


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A finaliser of 64 bits."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class FuseFilter:
    """A three-wise binary-fuse filter with fingerprints of 16 bits; it has no false negatives."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray) -> None:
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def places(hashes: np.ndarray, segment: int, segments: int) -> np.ndarray:
        """The three slots of each key, in three neighbouring segments."""
        first = ((hashes >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        start = first.astype(np.int64) * segment
        mask = segment - 1
        return np.stack([start + k * segment + ((hashes >> np.uint64(18 - 9 * k if k < 2 else 0)).astype(np.int64) * (2 * k + 1) & mask) for k in range(3)])

    @staticmethod
    def fingerprints(hashes: np.ndarray) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(37))) & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """keys: distinct unsigned 64-bit integers. Slots that hold one key are peeled, all at once, until none is left."""
        n = max(len(keys), 2)
        segment = max(4, 1 << min(18, int(math.log(n) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)) if n > 2 else 3.0
        segments = max(1, -(-int(n * factor) // segment) - 2)
        slots = (segments + 2) * segment
        for seed in range(1, 100):
            hashes = _mixed(keys, seed)
            at = cls.places(hashes, segment, segments)
            held = np.bincount(at.ravel(), minlength=slots)
            owner = np.zeros(slots, np.int64)
            index = np.arange(len(keys))
            for row in at:
                np.bitwise_xor.at(owner, row, index)
            layers, left = [], len(keys)
            while left:
                alone = np.flatnonzero(held == 1)
                if not len(alone):
                    break
                who, pick = np.unique(owner[alone], return_index=True)
                layers.append((who, alone[pick]))
                for row in at:
                    np.subtract.at(held, row[who], 1)
                    np.bitwise_xor.at(owner, row[who], who)
                left -= len(who)
            if not left:
                break
        else:
            raise RuntimeError("no seed gives a filter; keys repeat")
        prints, marks = np.zeros(slots, np.uint16), cls.fingerprints(hashes)
        for who, slot in reversed(layers):
            prints[slot] = 0
            prints[slot] = marks[who] ^ prints[at[0][who]] ^ prints[at[1][who]] ^ prints[at[2][who]]
        return cls(seed, segment, segments, prints)

    def might_have(self, keys: np.ndarray) -> np.ndarray:
        hashes = _mixed(keys, self.seed)
        a, b, c = self.places(hashes, self.segment, self.segments)
        return self.fingerprints(hashes) == self.prints[a] ^ self.prints[b] ^ self.prints[c]


def _keys(digests: pd.Series) -> np.ndarray:
    return np.array([int(d[:16], 16) for d in digests], np.uint64)


def _shard(shards: int) -> Column:
    """From other bits than the filter's keys."""
    return F.pmod(F.conv(F.substring("digest", 17, 12), 16, 10).cast("long"), F.lit(shards)).cast("int")


def build_filters(buckets: DataFrame, shards: int) -> DataFrame:
    """shard, seed, segment, segments, prints: the filters of a snapshot's distinct digests."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        f = FuseFilter.build(np.unique(_keys(rows["digest"])))
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "prints": [f.prints.tobytes()]})

    return buckets.select("digest", _shard(shards).alias("shard")).groupBy("shard").applyInPandas(build, "shard int, seed long, segment long, segments long, prints binary")


def screen(buckets: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The rows of buckets with maybe: false where the snapshot surely lacks the digest."""
    names, types = ["digest", "last", "n"], dict(buckets.dtypes)

    def look(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return rows[names].assign(maybe=False)
        if not len(found):
            return rows[names].assign(maybe=False)
        x = found.iloc[0]
        f = FuseFilter(int(x["seed"]), int(x["segment"]), int(x["segments"]), np.frombuffer(x["prints"], np.uint16))
        return rows[names].assign(maybe=f.might_have(_keys(rows["digest"])))

    schema = ", ".join(f"{c} {types[c]}" for c in names) + ", maybe boolean"
    return buckets.select(*names, _shard(shards).alias("shard")).groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(look, schema)


def classes(rows: DataFrame) -> DataFrame:
    """digest, keep_id, group_size over digest, doc_id, incoming."""
    by = lambda side: side.groupBy("digest").agg(F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    old, new = written(by(rows.filter(~F.col("incoming")))), written(by(rows.filter("incoming")))
    shards = max(1, -(-max(old.count(), new.count()) // PER_SHARD))
    screened = written(screen(new, written(build_filters(old, shards)), shards))
    met = screened.filter("maybe").select("digest", F.col("last").alias("new_last"), F.col("n").alias("new_n"))
    bucket = old.join(met, "digest", "left").select(
        "digest",
        F.greatest("last", F.coalesce("new_last", "last")).alias("keep_id"),
        (F.col("n") + F.coalesce("new_n", F.lit(0))).alias("group_size"),
    )
    false_alarms = met.join(old.select("digest"), "digest", "left_anti").select("digest", F.col("new_last").alias("keep_id"), F.col("new_n").alias("group_size"))
    fresh = screened.filter("not maybe").select("digest", F.col("last").alias("keep_id"), F.col("n").alias("group_size"))
    return bucket.unionByName(false_alarms).unionByName(fresh)


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _short(digest: str) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def dedup(docs: DataFrame, incoming: Callable[[str], Column] | None = None, digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row. incoming: which rows are not of the snapshot, from
    the name of the id column; by default every other id by its checksum, so that one table plays both parts."""
    incoming = incoming or (lambda name: F.pmod(crc_of(name), F.lit(2)) == 1)
    texts = docs.select("doc_id", text_of().alias("text")).withColumn("digest", digest(F.col("text")))
    rows = written(texts.select("doc_id", "digest", incoming("doc_id").alias("incoming"), F.sha2("text", 256).alias("text_sha256")))
    found = written(classes(rows).filter("group_size > 1"))
    # The texts of buckets with several rows, and no others, travel for the comparison of bytes.
    shorts = written(found.select(_short("digest").alias("short")).distinct())
    several = with_keys(texts.withColumn("short", _short("digest")), shorts, "short").drop("short")
    # Written before they are joined and before rows are made distinct, so that a hot digest can be dealt to several tasks.
    one = written(several.groupBy("digest").agg(F.max("text").alias("other")))
    mixed = written(written(several.join(one, "digest").filter("text != other").select("digest")).distinct())
    result = rows.join(found, "digest", "left").select("doc_id", "digest", "text_sha256", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
    if not mixed.isEmpty():  # different texts under one digest: each text is a class of its own
        result = result.join(mixed, "digest", "left_anti")
        torn = several.join(mixed, "digest", "left_semi")
        groups = torn.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        result = result.unionByName(torn.join(groups, ["digest", "text"]).select("doc_id", "digest", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    return result.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size,
       doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))
"""
