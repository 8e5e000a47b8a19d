"""Toxicity: a linear-chain conditional random field tags toxic words, and its marginals give scores and offsets.

Labels mark documents, the field needs marked words. Words that stand almost only in toxic training documents, in many
different surroundings, are marked there; all others are not. The field has two states and hashed features of the word
and its neighbours; its potentials are fitted by gradients from forward-backward marginals on at most TOXIC_ROWS and
CLEAN_ROWS labelled rows of up to LONGEST characters, those with the smallest checksums of their id. A logistic function
of the document's marginals, fitted on the same rows, is the score.

Null texts count as empty; a text without words has the score of no evidence. Repeated label rows of a document count as
toxic if one says so; null labels are ignored. Without toxic or without clean training rows every score is 0.
Words are taken whole, however long the text; repeated rows give repeated rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of, small_batches, table, text_of, tidy

TOXIC_ROWS, CLEAN_ROWS, LONGEST = 400, 1600, 12_000
THRESHOLD = 0.7
SLOTS = 1 << 18
#: Words whose features a worker remembers before it starts anew.
REMEMBERED = 200_000
CHUNK = 64
PREFIXES = (3, 4, 5, 6, 7, 8)
OWN = len(PREFIXES) + 3
EDGES = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def keys_of(core: bytes) -> list[bytes]:
    """The word and its beginnings of three to eight characters."""
    text = core.decode("utf-8", "replace")
    return [b"w" + core, *(b"p" + text[:n].encode() for n in PREFIXES if len(text) > n)]


_DIGIT = re.compile(rb"[0-9]").search
_END, _WORD, _BEGIN, _SHAPE, _BEFORE, _AFTER = map(zlib.crc32, (b"s", b"w", b"p", b"h", b"<", b">"))


def features(word: bytes) -> list[int]:
    """OWN slots of the word's own features, then of it as the next word's and as the previous word's neighbour. Those of
    its own that repeat, or that it lacks, have slot 0, which stays at nothing."""
    crc, core = zlib.crc32, word.strip(EDGES) or word
    own = [crc(core[-4:], _END), crc(core, _WORD)]
    if core.isascii():
        size, other = len(core), b""
        own += [crc(core[:n], _BEGIN) for n in PREFIXES if n < size]
    else:
        text, other = core.decode("utf-8", "replace"), b"x"
        own += [crc(text[:n].encode(), _BEGIN) for n in PREFIXES if n < len(text)]
    own.append(crc(b"%b%b%b%d" % (b"d" if _DIGIT(core) else b"", b"u" if core != word else b"", other, min(len(core), 12)), _SHAPE))
    own = [x % (SLOTS - 1) + 1 for x in own]
    if len(set(own)) < len(own):
        own = [0 if x in own[:k] else x for k, x in enumerate(own)]
    return [*own, *[0] * (OWN - len(own)), crc(core, _BEFORE) % (SLOTS - 1) + 1, crc(core, _AFTER) % (SLOTS - 1) + 1]


def words_of(text: str) -> list[bytes]:
    """Runs of other bytes than the ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "replace").lower().split()


def scan(e: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> np.ndarray:
    """For sequences one after another: the state vectors v[t] = (v[t-1] @ step) * (1, e[t]), each scaled to sum 1, from
    the first state before each sequence. Chunks of all sequences advance together."""
    chunks = -(-lengths // CHUNK)
    rows, first_row = int(chunks.sum()), np.cumsum(chunks) - chunks
    first = np.cumsum(lengths) - lengths
    at = np.arange(len(e)) + np.repeat(first_row * CHUNK - first, lengths)
    grid = np.ones(rows * CHUNK)
    grid[at] = e
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    (a, b), (c, d) = step
    # The product of each chunk, row by row of the two.
    m = [np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)]
    if chunks.max(initial=0) > 1:
        for x in grid:
            m = [m[0] * a + m[1] * c, (m[0] * b + m[1] * d) * x, m[2] * a + m[3] * c, (m[2] * b + m[3] * d) * x]
            total = m[0] + m[1] + m[2] + m[3]
            m = [q / total for q in m]
    v0, v1 = np.ones(rows), np.zeros(rows)
    longer, k = np.flatnonzero(chunks > 1), 1
    while len(longer):
        r = first_row[longer] + k
        p = r - 1
        n0, n1 = v0[p] * m[0][p] + v1[p] * m[2][p], v0[p] * m[1][p] + v1[p] * m[3][p]
        v0[r], v1[r] = n0 / (n0 + n1), n1 / (n0 + n1)
        k += 1
        longer = longer[chunks[longer] > k]
    out = np.empty((CHUNK, rows))
    for x, o in zip(grid, out, strict=True):
        n0, n1 = v0 * a + v1 * c, (v0 * b + v1 * d) * x
        o[:] = v1 = n1 / (n0 + n1)
        v0 = 1 - v1
    return out.T.reshape(-1)[at]


def forward_backward(score: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the second state, and the forward and backward vectors' second entries; clean states stand before
    and after each sequence."""
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return np.zeros(0), np.zeros(0), np.zeros(0)
    e = np.exp(np.clip(score, -30, 30))
    forth = scan(e, lengths, step)
    back = scan(e[::-1], lengths[::-1], step.T)[::-1]
    p1, p0 = forth * back / e, (1 - forth) * (1 - back)
    return p1 / (p1 + p0), forth, back


@dataclass
class Field:
    weights: np.ndarray
    bias: float
    step: np.ndarray
    shape: np.ndarray  # of the logistic function of evidence()

    def documents(self, marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(evidence(marginals, lengths) @ self.shape)))


def evidence(marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each document: a constant, how many toxic words it has, how sure the surest is, and that in a long document."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    most = np.zeros(len(lengths))
    np.maximum.at(most, owner, marginals)
    sure = np.log(np.clip(most, 0.01, 0.9999)) - np.log1p(-np.clip(most, 0.01, 0.9999))
    total = np.log1p(np.bincount(owner, marginals, len(lengths)))
    return np.stack([np.ones(len(lengths)), total, most, sure, most * np.log1p(lengths)], 1)


def mark_words(docs: list[list[bytes]], toxic: np.ndarray) -> set[bytes]:
    """Words, and beginnings of words, that are toxic documents' own: in several of them and in different surroundings,
    and rarely in a clean document."""
    dirty: Counter[bytes] = Counter()
    known: dict[bytes, list[bytes]] = {}
    for words, bad in zip(docs, toxic, strict=True):
        if bad:
            own = set(words)
            known.update((w, keys_of(w.strip(EDGES) or w)) for w in own if w not in known)
            dirty.update({k for w in own for k in known[w]})
    least = max(3, 0.02 * toxic.sum())
    picked = {k for k, n in dirty.items() if n >= least}
    clean: Counter[bytes] = Counter()
    for words, bad in zip(docs, toxic, strict=True):
        if not bad:
            clean.update({k for w in set(words) for k in known.get(w) or keys_of(w.strip(EDGES) or w) if k in picked})
    weight = max(1.0, toxic.sum() / max(1, (~toxic).sum()))
    picked = {k for k in picked if clean[k] * weight <= 0.12 * dirty[k]}
    around = defaultdict(set)
    for words, bad in zip(docs, toxic, strict=True):
        if bad:
            for before, w, after in zip([b"", *words], words, [*words[1:], b""], strict=False):
                for k in known[w]:
                    if k in picked:
                        around[k].add((before, after))
    return {k for k in picked if len(around[k]) >= least}


def fit(texts: list[str], toxic: list[int], rounds: int = 30) -> Field | None:
    pairs = dict(zip(texts, toxic, strict=True))  # copies teach nothing new
    docs, y = [words_of(t) for t in pairs], np.array(list(pairs.values()), bool)
    if not y.any() or y.all():
        return None
    marked = mark_words(docs, y)
    index: dict[bytes, int] = {}
    slots: list[list[int]] = []
    is_marked: list[bool] = []
    for words in docs:
        for w in words:
            if w not in index:
                index[w] = len(slots)
                slots.append(features(w))
                is_marked.append(not marked.isdisjoint(keys_of(w.strip(EDGES) or w)))
    lengths = np.array([len(d) for d in docs])
    token = np.fromiter((index[w] for d in docs for w in d), np.int32, int(lengths.sum()))
    gold = np.array(is_marked, bool)[token] & np.repeat(y, lengths)
    slot = np.array(slots, np.int32).reshape(-1, OWN + 2)  # of each distinct word
    del docs, slots
    inner = np.ones(len(token), bool)  # has a previous word
    ends = np.cumsum(lengths)
    inner[(ends - lengths)[lengths > 0]] = False
    before, after = np.flatnonzero(inner) - 1, np.flatnonzero(inner)
    weights, bias, step = np.zeros(SLOTS), -4.0, np.log(np.array([[0.9, 0.1], [0.9, 0.1]]))
    squares, bias_square, step_square = np.full(SLOTS, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    sequences = lengths[lengths > 0]
    starts = np.zeros(len(token), bool)
    starts[(np.cumsum(sequences) - sequences)] = True
    lasts = np.cumsum(sequences) - 1
    for _ in range(rounds):
        score = weights[slot[:, :OWN]].sum(1)[token] + bias
        score[after] += weights[slot[:, OWN]][token[before]]
        score[before] += weights[slot[:, OWN + 1]][token[after]]
        a = np.exp(step)
        p, forth, back = forward_backward(score, lengths, a)
        gap = p - gold
        of_word = np.bincount(token, gap, len(slot))
        gradient = np.bincount(slot[:, :OWN].ravel(), np.repeat(of_word, OWN), SLOTS)
        gradient += np.bincount(slot[:, OWN], np.bincount(token[before], gap[after], len(slot)), SLOTS)
        gradient += np.bincount(slot[:, OWN + 1], np.bincount(token[after], gap[before], len(slot)), SLOTS)
        # Pairs of neighbours, the clean states at the ends among them.
        prev = np.where(starts, 0.0, np.roll(forth, 1))
        pair = [[(1 - prev) * (1 - back) * a[0, 0], (1 - prev) * back * a[0, 1]], [prev * (1 - back) * a[1, 0], prev * back * a[1, 1]]]
        whole = pair[0][0] + pair[0][1] + pair[1][0] + pair[1][1]
        was = np.where(starts, False, np.roll(gold, 1))
        expected, seen = np.array([[(x / whole).sum() for x in row] for row in pair]), np.array([[(~was & ~gold).sum(), (~was & gold).sum()], [(was & ~gold).sum(), (was & gold).sum()]], float)
        tail, tail_gold = forth[lasts], gold[lasts]
        end = np.stack([(1 - tail) * a[0, 0], tail * a[1, 0]], 1)
        expected[:, 0] += (end / end.sum(1, keepdims=True)).sum(0)
        seen[:, 0] += [(~tail_gold).sum(), tail_gold.sum()]
        gradient += 0.02 * weights
        gradient[0] = 0
        squares += gradient**2
        weights -= 1.0 * gradient / np.sqrt(squares)
        g = gap.sum()
        bias_square += g * g
        bias -= 0.5 * g / np.sqrt(bias_square)
        g = expected - seen + 0.1 * step
        step_square += g * g
        step = np.clip(step - 0.3 * g / np.sqrt(step_square), -8, 8)
    field = Field(weights.astype(np.float32), float(bias), np.exp(step), np.zeros(5))
    x = evidence(p, lengths)
    shape = np.zeros(5)
    for _ in range(30):  # Newton's steps, with a small penalty
        q = 1 / (1 + np.exp(-np.clip(x @ shape, -30, 30)))
        shape -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(5), x.T @ (q - y) + 0.05 * shape)
    field.shape = shape
    return field


def train(docs: DataFrame, labels: DataFrame) -> Field | None:
    """Learns from labelled rows whose crc32 of doc_id modulo 3 is not 1. Rows that repeat a picked doc_id count once, by
    the greatest of their texts, so that what reaches the driver is bounded by TOXIC_ROWS, CLEAN_ROWS and LONGEST."""
    own = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.filter(F.pmod(crc_of(), F.lit(3)) != 1)
    some = lambda bad, n: own.filter(F.col("toxic") == bad).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = some(1, TOXIC_ROWS).unionByName(some(0, CLEAN_ROWS))
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id").filter(F.length("text") <= LONGEST)
    found = sorted(rows.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).select("doc_id", "text", "toxic").collect())
    return fit([r.text for r in found], [r.toxic for r in found])


class Tagger:
    """Marginals of batches of documents by a field."""

    def __init__(self, field: Field) -> None:
        self.field = field
        self.clear()

    def clear(self) -> None:
        new: list[int] = []

        class Known(dict):
            def __missing__(known, word: bytes) -> int:  # noqa: N805
                new.extend(features(word))
                known[word] = n = len(known)
                return n

        self.known, self.new, self.values = Known(), new, np.zeros((0, 3), np.float32)

    def marginals(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.clear()
        lengths = np.array([len(d) for d in docs], np.int64)
        look = self.known.__getitem__
        token = np.fromiter((i for d in docs for i in map(look, d)), np.int32, int(lengths.sum()))
        if self.new:
            w = self.field.weights[np.array(self.new, np.int32).reshape(-1, OWN + 2)]
            self.values = np.concatenate([self.values, np.stack([w[:, :OWN].sum(1), w[:, OWN], w[:, OWN + 1]], 1)])
            self.new.clear()
        if not len(token):
            return np.zeros(0), lengths
        own, forth, back = self.values[token].T.astype(float)
        score = own + self.field.bias
        inner = np.ones(len(token), bool)
        inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
        score[1:] += np.where(inner[1:], forth[:-1], 0)
        score[:-1] += np.where(inner[1:], back[1:], 0)
        return forward_backward(score, lengths, self.field.step)[0], lengths


def spans(text: str, wanted: np.ndarray) -> list[dict]:
    """Offsets of words in code points, ends exclusive, neighbours joined."""
    places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out: list[dict] = []
    for i in np.flatnonzero(wanted):
        if out and i and out[-1]["last"] == i - 1:
            out[-1] |= {"end": places[i][1], "last": i}
        else:
            out.append({"start": places[i][0], "end": places[i][1], "last": i})
    return [{"start": x["start"], "end": x["end"]} for x in out]


def with_scores(docs: DataFrame, field: Field | None, score: str = "score", found: str = "spans") -> DataFrame:
    """The rows with the score and the spans (array of start, end) of their texts, under names that docs must not have."""
    spark = docs.sparkSession
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    if field is None:
        return docs.select("*", F.lit(0.0).alias(score), F.array().cast(kind).alias(found))
    small_batches(spark)
    shared = spark.sparkContext.broadcast(field)  # SLOTS weights

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            p, lengths = tagger.marginals([words_of(t) for t in texts])
            places, ends = [], np.cumsum(lengths)
            for text, end, n in zip(texts, ends, lengths, strict=True):
                wanted = p[end - n : end] >= 0.5
                places.append(spans(text, wanted) if wanted.any() else [])
            columns = [*batch.columns, pa.array(shared.value.documents(p, lengths), pa.float64()), pa.array(places, spans_type)]
            yield pa.record_batch(columns, names=[*batch.schema.names, score, found])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(found, kind)]))


def apply(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return with_scores(docs.select("doc_id", "text"), train(docs, labels)).select(
        "doc_id", (F.pmod(crc_of(), F.lit(3)) == 1).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "spans"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
