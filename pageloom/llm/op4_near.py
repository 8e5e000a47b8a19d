"""Near-duplicate documents by min-max hashing of word shingles.

A document's set holds its distinct shingles as 64-bit hashes. Every permutation gives two signature values, its least
and its greatest; bands of BAND permutations, as many as a pair at the threshold needs to meet with a chance of 1 - MISS,
give buckets. Documents of one set are one class from the start. In each bucket one class is the hub and the others are
held against it on their full sets; buckets whose classes are in one component by then are settled, and large ones go on
with other hubs while those link enough. Of the classes that are left, those pairs of different components are compared
whose differences from the hub share a rare shingle early on (a prefix filter on differences, see pairs_left()), which
every link must. So the work follows the rows of a bucket and not their square, and no pair that could join two
components goes unseen.

Null or blank texts have the empty set and link with nothing. A text with fewer words than a shingle is one shingle.
Rows with a null doc_id get a null component_id and stay; repeated rows give repeated rows, and rows of one doc_id with
several texts are one document with several sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, dropped, small_batches, table, text_of, tidy, with_keys, written

BAND, MISS = 3, 1e-5
#: Buckets of more than LARGE classes of several components get other hubs while one in ENOUGH of the pairs is a link.
LARGE, ENOUGH = 256, 20
#: What one in SHARE of a hub's classes has is frequent.
SHARE = 16
REMEMBERED = 300_000


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** (2 * BAND)))


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.clear()

    def clear(self) -> None:
        import xxhash

        digest = xxhash.xxh64_intdigest

        class Known(dict):
            def __missing__(known, word: bytes) -> int:  # noqa: N805
                known[word] = n = digest(word)
                return n

        self.known, self.digest = Known(), digest

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.clear()
        docs = [t.encode("utf-8", "replace").lower().split() for t in texts]
        look, width = self.known.__getitem__, self.width
        words = np.fromiter((h for d in docs for h in map(look, d)), np.uint64, sum(map(len, docs)))
        mixed = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            mixed = mixed * np.uint64(0x9FB21C651E98DF25) + words[k : k + len(mixed)]
        mixed = _finish(mixed)
        out, at = [], 0
        for d in docs:
            if len(d) >= width:
                out.append(np.unique(mixed[at : at + len(d) - width + 1]))
            else:
                out.append(np.array([self.digest(b" ".join(d), len(d))] if d else [], np.uint64))
            at += len(d)
        return out


def band_keys(sets: list[np.ndarray], bands: int) -> np.ndarray:
    """A 64-bit key of each band by document; sets must not be empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    numbers = np.random.RandomState(20_011).randint(0, 1 << 62, (bands * BAND, 2), np.uint64)
    keys = np.zeros((len(sets), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sets), band + 1, np.uint64)
        for a, b in numbers[band * BAND : (band + 1) * BAND]:
            seen = ((flat * (a * np.uint64(2) + np.uint64(1)) + b) >> np.uint64(32)).astype(np.uint32)
            for part in (np.minimum, np.maximum):
                key = key * np.uint64(0x9FB21C651E98DF25) + part.reduceat(seen, starts)
        keys[:, band] = _finish(key)
    return keys


def sign(docs: DataFrame, width: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, cid (16 bytes: the set's class; null if empty), keys (of the bands)."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_of().alias("text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(width)
        for batch in batches:
            sets = shingler.sets(batch.column(1).to_pylist())
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(full, bands) if full else ())
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(keys).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "cid", "keys"],
            )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_shingles long, cid binary, keys array<long>")


def full_sets(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """cid, shingles (sorted 64-bit integers) of each class, from the text of one of its documents."""
    ids = classes.select("cid", F.col("first_id").alias("doc_id"))
    rows = with_keys(docs.select("doc_id", text_of().alias("text")), ids, "doc_id").select("cid", "text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(width)
        for batch in batches:
            cids, out = batch.column(0).to_pylist(), []
            for cid, s in zip(cids, shingler.sets(batch.column(1).to_pylist()), strict=True):
                out.append(s.tobytes() if xxhash.xxh3_128_digest(s.tobytes()) == cid else None)  # another row of that id
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["cid", "shingles"])

    return rows.mapInArrow(run, "cid binary, shingles binary").filter("shingles IS NOT NULL")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked (whether their full sets are similar enough) of each pair."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a")), "a")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                common = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                linked.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    kind = dict(pairs.dtypes)["a"]
    return both.select("a", "b", "of_a", "of_b").mapInArrow(run, f"a {kind}, b {kind}, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """node, label (one node of the component, the same for all) of every node of the edges a, b. Every node hooks to its
    least neighbour, if that is less; the edges between what has become one go, and the rest are those of the next turn.
    A component loses half its nodes each turn or more, and a star all but one."""
    now = written(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u != v").distinct())
    turns: list[DataFrame] = []
    while not now.isEmpty():
        hooks = now.union(now.select("v", "u")).groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("to"))
        further = hooks.select(F.col("node").alias("to"), F.col("to").alias("root"))
        hooks = written(hooks.join(further, "to").select("node", "root"))
        turns.append(hooks)
        left, right = hooks.select(F.col("node").alias("u"), F.col("root").alias("p")), hooks.select(F.col("node").alias("v"), F.col("root").alias("q"))
        new = now.join(left, "u").join(right, "v").filter("p != q").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct()
        new = written(new)
        dropped(now)
        now = new
    if not turns:
        return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    found = turns[0].withColumnRenamed("root", "label")
    for hooks in turns[1:]:
        found = found.join(hooks.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    return found


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = 16) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what is made of very long sets at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """hub, id, diff (the shingles that one of the two has and the other lacks, sorted) of each pair hub, id."""
    both = pairs.join(sets.select("id", F.col("shingles").alias("own")), "id").join(sets.select(F.col("id").alias("hub"), F.col("shingles").alias("of_hub")), "hub")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            out = [np.setxor1d(np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64), True).tobytes() for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["hub", "id", "diff"])

    kind = dict(pairs.dtypes)["id"]
    return both.select("hub", "id", "own", "of_hub").mapInArrow(run, f"hub {kind}, id {kind}, diff binary")


def exploded(diffs: DataFrame, often: DataFrame | None = None) -> DataFrame:
    """hub, id, s of each shingle of the differences, but for those that are frequent in their hub's."""
    rows = diffs.select("hub", "id", "diff", F.lit(None).cast("array<long>").alias("often")) if often is None else diffs.join(bounded(often), "hub", "left").select("hub", "id", "diff", "often")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            values = []
            for diff, late in zip(batch.column(2), batch.column(3), strict=True):
                own = np.frombuffer(diff.as_buffer(), np.int64)
                values.append(own[~np.isin(own, late.values.to_numpy())] if late.is_valid else own)
            owner = pa.array(np.repeat(np.arange(len(values)), [len(v) for v in values]))
            yield pa.record_batch([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(np.concatenate(values))], names=["hub", "id", "s"])

    kind = dict(diffs.dtypes)["id"]
    return rows.mapInArrow(run, f"hub {kind}, id {kind}, s long")


def in_order(diffs: DataFrame) -> DataFrame:
    """diffs with rare and often: the shingles of a difference that others of its hub have as well, from the rarest on.
    Those that one in SHARE of the hub's classes has are looked up from a list, at most SHARE times as long as a
    difference on average, so that the rows of no shingle meet in one place."""
    sizes = diffs.groupBy("hub").agg(F.count(F.lit(1)).alias("size"))
    counts = exploded(diffs).groupBy("hub", "s").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    counts = written(counts.join(bounded(written(sizes)), "hub"))
    by_count = lambda: F.transform(F.array_sort(F.collect_list(F.struct("c", "s"))), lambda x: x["s"])
    often = written(counts.filter(F.col("c") * SHARE >= F.col("size")).groupBy("hub").agg(by_count().alias("often")))
    rare = exploded(diffs, often).join(counts.select("hub", "s", "c"), ["hub", "s"]).groupBy("hub", "id").agg(by_count().alias("rare"))
    return written(diffs.join(rare, ["hub", "id"], "left").join(bounded(often), "hub", "left"))


def first_shingles(diffs: DataFrame, percent: int) -> DataFrame:
    """hub, s, at, id, label, n, d, weight: the beginning of each difference of d shingles, as far as a class of another
    label that is similar enough must have one of them too. Shingles that no other class has come first and are left out."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            shingles, places = [], []
            parts = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist(), batch.column(7), batch.column(8), batch.column(9), strict=True)
            for d, weight, least, rare, often, diff in parts:
                own = rare.values.to_numpy() if rare.is_valid else np.zeros(0, np.int64)
                if often.is_valid:
                    late = often.values.to_numpy()
                    own = np.concatenate([own, late[np.isin(late, np.frombuffer(diff.as_buffer(), np.int64))]])
                alone = d - len(own)
                own = own[: max(0, d - max(1, -(-(weight + least) // (2 * (100 + percent)))) + 1 - alone)]
                shingles.append(own)
                places.append(np.arange(alone, alone + len(own)))
            rows = pa.array(np.repeat(np.arange(len(shingles)), [len(x) for x in shingles]))
            if len(rows):
                columns = [batch.column(0).take(rows), pa.array(np.concatenate(shingles)), pa.array(np.concatenate(places)), *[batch.column(k).take(rows) for k in (1, 2, 3, 4, 5)]]
                yield pa.record_batch(columns, names=["hub", "s", "at", "id", "label", "n", "d", "weight"])

    kind = dict(diffs.dtypes)["id"]
    return diffs.select("hub", "id", "label", "n", "d", "weight", "least", "rare", "often", "diff").mapInArrow(run, f"hub {kind}, s long, at long, id {kind}, label {kind}, n long, d long, weight long")


def pairs_left(open_rows: DataFrame, hubs: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs a, b of classes of different labels in open buckets that are surely linked, and those that may be.

    Let x and y differ from their bucket's hub by the sets X and Y. They differ from each other by X + Y - 2 shared(X, Y)
    shingles, so that a link asks for 2 (100 + percent) shared(X, Y) >= weight(x) + weight(y), where weight(x) =
    (100 + percent) |X| - (100 - percent) |x|. Weights that add up to no more than 0 are a link; all others must meet in
    the beginnings of X and Y in any common order, and do so seldom if the rarest comes first."""
    members = open_rows.join(hubs, "key").select("hub", "id", "n", "label").distinct()
    diffs = differences(members.select("hub", "id"), sets).join(members, ["hub", "id"]).withColumn("d", (F.length("diff") / 8).cast("long"))
    diffs = written(diffs.withColumn("weight", (100 + percent) * F.col("d") - (100 - percent) * F.col("n")))
    least = written(diffs.groupBy("hub").agg(F.min(F.struct("weight", "id")).alias("best")).select("hub", F.col("best.weight").alias("least"), F.col("best.id").alias("best")))
    weighed = in_order(diffs).join(bounded(least), "hub")
    sure = written(weighed.filter((F.col("weight") + F.col("least") <= 0) & (F.col("id") != F.col("best"))).select(F.col("id").alias("a"), F.col("best").alias("b")))
    begun = written(first_shingles(weighed, percent))
    other = begun.select("hub", "s", *[F.col(c).alias(f"other_{c}") for c in ("at", "id", "label", "n", "d", "weight")])
    total = F.col("weight") + F.col("other_weight")
    room = F.least(F.col("d") - F.col("at"), F.col("other_d") - F.col("other_at"))  # what both have from here on
    met = begun.join(other, (begun["hub"] == other["hub"]) & (begun["s"] == other["s"]) & (F.col("id") < F.col("other_id")) & (F.col("label") != F.col("other_label")) & near_size(percent) & (total > 0) & (2 * (100 + percent) * room >= total))
    maybe = written(met.select(F.col("id").alias("a"), F.col("other_id").alias("b")).distinct())
    dropped(diffs, weighed, least, begun)
    return sure, maybe


def near_size(percent: int) -> Column:
    return F.least("n", "other_n") * 100 >= F.greatest("n", "other_n") * percent


def class_components(classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame | None:
    """id, label of the documents that a link joins with others; None without links. classes: cid, n, keys, id (the least
    doc_id of the class)."""
    rows = classes.select("id", "n", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = written(rows.join(buckets, "key").select("key", "id", "n", "size"))
    if members.isEmpty():
        return None
    # Those in the largest buckets are nearest to what the others are copies of.
    central = written(members.groupBy("id").agg(F.sum("size").alias("central"), F.first("n").alias("n")))
    candidates = written(classes.join(central, "id", "left_semi").select("cid", F.col("id").alias("first_id")))
    sets = full_sets(docs, candidates, width)
    sets = written(sets.join(bounded(candidates), "cid").select(F.col("first_id").alias("id"), "shingles"))
    hubs = written(members.select("key", "id").join(central, "id").groupBy("key").agg(F.max(F.struct("central", "id", "n")).alias("best")))
    met = members.select("key", "id", "n").join(hubs, "key").groupBy("id", "n").agg(F.max("best").alias("best")).select("id", "n", F.col("best.id").alias("other"), F.col("best.n").alias("other_n"))
    met = met.filter("id != other").filter(near_size(percent)).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    tested = written(confirm(met, sets, percent))
    edges = tested.filter("linked").select("a", "b")
    labels = None if edges.isEmpty() else written(components(edges))
    turn = 0
    while True:
        open_rows = members.withColumn("label", F.col("id"))
        if labels is not None:
            open_rows = members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        # Buckets of one component are settled; in large ones of many, other hubs come first while they link enough.
        by_label = open_rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
        left = by_label.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.sum("c").alias("all")).filter("labels > 1")
        left = written(left.select("key", (F.col("all") > LARGE).alias("large")))
        turn += 1
        if left.filter("large").isEmpty():
            break
        large = open_rows.join(left.filter("large").select("key"), "key").select("key", "id", "n", "label")
        order = F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "n", "label")
        hub = large.groupBy("key").agg(F.min(order).alias("hub")).select("key", *[F.col(f"hub.{c}").alias(f"other_{c}") for c in ("id", "n", "label")])
        met = large.join(hub, "key").filter((F.col("label") != F.col("other_label")) & near_size(percent)).select(F.least("id", "other_id").alias("a"), F.greatest("id", "other_id").alias("b")).distinct()
        held = written(confirm(met.join(tested, ["a", "b"], "left_anti"), sets, percent))
        new = held.filter("linked").select("a", "b")
        tested = tested.unionByName(held)
        n_held, n_new = held.count(), new.count()
        if n_new:
            edges = edges.union(new)
            labels = written(components(edges))
        if n_new * ENOUGH < n_held or not n_new:
            break
    if not left.isEmpty():
        open_rows = members.withColumn("label", F.col("id")) if labels is None else members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        open_rows = open_rows.join(left.select("key"), "key").select("key", "id", "n", "label")
        sure, maybe = pairs_left(open_rows, hubs.select("key", F.col("best.id").alias("hub")), sets, percent)
        new = sure.unionByName(written(confirm(maybe.join(tested, ["a", "b"], "left_anti"), sets, percent)).filter("linked").select("a", "b"))
        if not new.isEmpty():
            edges = edges.union(new)
            labels = written(components(edges))
    dropped(members, central, candidates, sets, hubs, tested)
    return labels.withColumnRenamed("node", "id") if labels is not None else None


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: documents are linked if 100 times the intersection of their
    sets is at least percent times the union, and the least doc_id reachable names the component and stays."""
    signed = written(sign(docs, width, bands_for(percent)))
    linked = signed.filter("cid IS NOT NULL AND doc_id IS NOT NULL")
    classes = linked.groupBy("cid").agg(F.min("doc_id").alias("id"), F.min_by(F.struct("n_shingles", "keys"), "doc_id").alias("of"))
    classes = written(classes.select("cid", "id", F.col("of.n_shingles").alias("n"), "of.keys"))
    labels = class_components(classes, docs, width, percent)
    named = classes.select("cid", F.col("id").alias("component_id"))
    if labels is not None:
        labelled = classes.select("cid", "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        least = labelled.groupBy("label").agg(F.min("id").alias("component_id"))
        named = labelled.join(least, "label").select("cid", "component_id")
    result = signed.select("doc_id", "n_shingles", "cid").join(named, "cid", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(d, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON r.m = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.m AS component_id, c.m = d.doc_id AS kept
FROM documents d JOIN (SELECT d, min(m) AS m FROM r GROUP BY d) c ON c.d = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
