"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing names, against brute
force, and the registered queries on the smallest driver tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pageloom.llm import common, entry, op1_pii, op2_mix, op3_lm, op4_near, op5_warc, op6_imatch, op7_exact, op8_html, op9_bpe, op10_toxic

DATA = "/root/testdata/sf0.001"
LONG = "word%d " * 3000 % tuple(range(3000))
ODD = [
    (1, "a b c d e f", "en", "s1"), (2, "a b c d e f", "en", "s1"), (3, None, None, None), (4, "", "de", "s2"), (5, " \n\t ", "de", "s2"), (6, LONG, "en", "s1"), (7, LONG + "more", "en", "s3"),
    (8, "é中😀 x\x01y", "fr", "s3"), (9, "a b c d e f", "en", None), (9, "a b c d e f", "en", None), (10, "mail a@b.co or +1 (555) 123-4567", "en", "s1"), (11, "one", "en", "s9"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """With columns of names that operators use inside."""
    rows = spark.createDataFrame(ODD, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    return rows.select("*", F.lit(1).alias("digest"), F.lit(2).alias("size"), F.lit(3).alias("cid"), F.lit("x").alias("label"), F.lit(0.5).alias("score")).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA + ", n_chars long")


def ascii_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def test_pii(odd, none):
    got = {r.doc_id: r for r in op1_pii.apply(odd).collect()}
    assert (got[10].n_email, got[10].n_phone, got[10].spans) == (1, 1, "email:5:11,phone:15:32")
    assert got[10].base_sha256 == hashlib.sha256(b"email:5:11,phone:15:32").hexdigest()
    assert got[3].spans == got[4].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert op1_pii.apply(none).count() == 0
    assert {r.doc_id: r.text for r in op1_pii.redact(odd).collect()}[10] == "mail [email] or [phone]"


def _luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    """The contract's base spans, by Python's own patterns."""
    digits = lambda v: re.sub("[^0-9]", "", v)
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and _luhn(digits(m[0]))]
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_pii_base_spans_of_odd_texts(spark):
    import random

    rng = random.Random(9)
    bits = ["a@b.co", "x.y@z", "@", ".", "1.2.3.4", "300.1.1.1", "255.255.255.255.9", "0004.1.2.3", "4111 1111 1111 1111", "4111111111111111", "-", " ", "+1 (555) 123-4567", "+49.30.1234567", "+", "(", "é", "😀", "\x01", "12", "3", "b.c@d.e.f", "%", "a" * 30, "\n", "9" * 21]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    got = {r.doc_id: r for r in op1_pii.apply(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        wanted = base_spans(text)
        joined = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in wanted)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(w[1] == k for w in wanted) for k in range(4)]
        assert set(joined.split(",")) <= set(got[i].spans.split(",")) | {""}


def test_pii_added_spans(spark):
    """What only the trees find, what they leave alone, and that nothing overlaps what is there."""
    rows = [(1, "write to joe(at)example.com please"), (2, "call (555) 123-4567 now"), (3, 'token = "ghX4kk29sLq8ZZ0pQw7rT5yU" end'), (4, "order 1234567890123456 shipped"), (5, "a plain text, version 1.20.300.4000"), (6, "ssn 123-45-6789")]
    got = {r.doc_id: r.spans for r in op1_pii.apply(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "email:9:27" and got[2] == "phone:5:19" and got[3].startswith("secret:9:") and got[4] == got[5] == "" and got[6] == "ssn:4:15"
    spans = "array<struct<start: int, end: int, kind: string>>"
    chosen = spark.range(1).select(op1_pii.added(F.expr(f"from_json('[{{\"start\": 10, \"end\": 20, \"kind\": \"ip\"}}]', '{spans}')"), F.expr(
        "array(named_struct('start', 15, 'end', 25, 'kind', 'card', 'margin', 9D), named_struct('start', 20, 'end', 30, 'kind', 'phone', 'margin', 1D), named_struct('start', 25, 'end', 35, 'kind', 'card', 'margin', 1D), named_struct('start', 30, 'end', 40, 'kind', 'ssn', 'margin', 0.5D), named_struct('start', 20, 'end', 32, 'kind', 'card', 'margin', 1D))"
    )).alias("s")).first().s
    assert [tuple(x) for x in chosen] == [(10, 20, "ip"), (20, 32, "card")]  # ties: the first start, then the longest


def test_pii_of_very_long_texts(spark):
    """Patterns that repeat for a million characters, and many matches, take seconds and no stack."""
    import time

    texts = ["a@" + "b." * 500_000 + "c", "7" * 1_000_000, "Ab9/" * 250_000, "a@b.co " * 100_000, "call (555) 123-4567 " * 10_000, "1.2.3.4, " * 100_000, "x" * 1_000_000 + "@", "1-" * 500_000, "+1" * 400_000, "0" * 500_000 + ".0.0.0"]
    began = time.time()
    got = {r.doc_id: r for r in op1_pii.apply(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    assert time.time() - began < 120
    assert (got[0].n_email, got[3].n_email, got[4].spans.count("phone"), got[5].n_ip, got[9].n_ip) == (1, 100_000, 10_000, 100_000, 1)


def targets(sizes, weights):
    left, total, out = dict(zip(sizes, weights, strict=True)), sum(sizes.values()), {}
    while left:
        level = (total - sum(out.values())) / sum(left.values())
        full = [s for s, w in left.items() if w * level > 3 * sizes[s]]
        if not full:
            return out | {s: w * level for s, w in left.items()}
        for s in full:
            out[s] = 3 * sizes[s]
            del left[s]
    return out


def test_mix(odd, none):
    rows = op2_mix.apply(odd).collect()
    assert len(rows) == len(ODD) and op2_mix.apply(none).count() == 0
    own = Counter()
    for _, text, _, source in ODD:
        own[source] += len(ascii_words(text))
    order = sorted((s for s in own if s is not None)) + [None]
    wanted = targets({s: own[s] for s in order}, [(5, 2, 1)[i % 3] for i in range(len(order))])
    by_id = {i: s for i, _, _, s in ODD}
    for r in rows:
        assert r.target == pytest.approx(wanted[by_id[r.doc_id]]) and r.source_size == own[by_id[r.doc_id]]
        assert r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op2_mix.apply(odd).collect()))


def test_mix_meets_targets(spark):
    base = "/root/testdata/sf0.01"
    sources = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "source")
    for r in op2_mix.query(spark, base).join(sources, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.03)


def test_base_scores(odd, none):
    got = op3_lm.lm_scores(odd).collect()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in ODD}
    counts, ends = Counter(), 0
    for i, text, *_ in ODD:
        if not held[i]:
            counts.update(ascii_words(lowered(text)))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    texts = {i: t for i, t, *_ in ODD}
    assert len(got) == len(ODD)
    for r in got:
        words = ascii_words(lowered(texts[r.doc_id]))
        logs = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        assert (r.held_out, r.n_tokens, r.train_tokens, r.n_known) == (held[r.doc_id], len(words) + 1, n, sum(counts[w] > 0 for w in words) + (ends > 0))
        assert r.base_score == pytest.approx(logs) and r.score < 0
    assert op3_lm.lm_scores(none).count() == 0


def test_rare_words_are_joined(odd, monkeypatch):
    whole = sorted((r.doc_id, round(r.base_score, 6), r.n_known) for r in op3_lm.lm_scores(odd).collect())
    monkeypatch.setattr(op3_lm, "HEAD", 0)
    assert sorted((r.doc_id, round(r.base_score, 6), r.n_known) for r in op3_lm.lm_scores(odd).collect()) == whole


def test_language_model_learns_from_all_training_texts(spark, monkeypatch):
    """Texts that nothing foretells: those of training are all known to the tables, and all their decisions teach weights."""
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=80)) for _ in range(300)]
    models, taught, score, newton = [], [], op3_lm.score_rows, getattr(op3_lm, "newton", None)
    monkeypatch.setattr(op3_lm, "score_rows", lambda rows, model, head: models.append(model) or score(rows, model, head))
    monkeypatch.setattr(op3_lm, "newton", lambda x, gate, n: taught.append(n.sum()) or newton(x, gate, n), raising=False)
    got = op3_lm.lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert max(r.bits_per_byte for r in got if not r.held_out) < min(r.bits_per_byte for r in got if r.held_out) - 1
    code, wanted = models[0].code, 0
    for text in (texts[r.doc_id] for r in got if not r.held_out):
        wanted += code.length.take(code.paired(op3_lm.laid_out([text.encode()])[0])).sum()
    assert taught == [wanted]


def test_language_model_of_small_splits(spark):
    """Many small splits are learned from together, so that first weights are no worse."""
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")

    def held(df):
        got = [r for r in op3_lm.lm_scores(df).collect() if r.held_out]
        return sum(r.bits for r in got) / sum(r.bits / r.bits_per_byte for r in got)

    assert held(rows.repartition(16)) == pytest.approx(held(rows.coalesce(1)), rel=0.005)


def components(docs, width, percent):
    sets = {}
    for i, text, *_ in docs:
        w = ascii_words(lowered(text))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[a] & sets[b]:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_duplicates(spark, odd, none):
    chain = [(100 + k, " ".join(f"w{j}" for j in range(k * 4, k * 4 + 120)), "en", "s") for k in range(12)]
    apart = [(200 + k, " ".join(f"v{k}x{j // 2}" if j % 2 else f"c{j}" for j in range(80)), "en", "s") for k in range(10)]
    docs = ODD + chain + apart + [(300, "A", "en", "s"), (301, "a", "en", "s"), (302, "a b", "en", "s")]
    got = {r.doc_id: r for r in op4_near.near_duplicates(spark.createDataFrame(docs, SCHEMA), 3, 85).collect()}
    for i, (n, component) in components(docs, 3, 85).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, component, component == i), i
    assert op4_near.near_duplicates(odd).count() == len(ODD) and op4_near.near_duplicates(none).count() == 0


def test_near_duplicates_in_one_large_bucket(spark, monkeypatch):
    """Hub rounds and pairs together find what brute force finds."""
    import random

    monkeypatch.setattr(op4_near, "LARGE", 4)
    rng, base = random.Random(4), [f"b{j}" for j in range(60)]
    docs = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(60)] = f"x{rng.randrange(6)}"
        docs.append((k, " ".join(words), "en", "s"))
    got = {r.doc_id: r.component_id for r in op4_near.near_duplicates(spark.createDataFrame(docs, SCHEMA), 3, 85).collect()}
    assert got == {i: c for i, (_, c) in components(docs, 3, 85).items()}


@pytest.mark.parametrize(("seed", "large"), [(1, 3), (2, 256), (3, 8)])
def test_near_duplicates_of_outliers_and_lengths(spark, monkeypatch, seed, large):
    """Copies around one text that differ from each other more than from it, in length too, and a template: what is left
    after the hubs is found by the differences from them."""
    import random

    monkeypatch.setattr(op4_near, "LARGE", large)
    rng, docs = random.Random(seed), []
    base, template = [f"b{j}" for j in range(90)], [f"t{j}" for j in range(100)]
    for k in range(70):
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        cut = rng.choice([0, 0, 0, 3, 6, 9, 12])
        docs.append((k, " ".join(words[cut:] + [f"e{j}" for j in range(rng.choice([0, 0, 4, 8]))]), "en", "s"))
    for k in range(20):
        docs.append((100 + k, " ".join(template[:88] + [f"own{k}x{j}" for j in range(rng.choice([6, 7, 8, 14]))]), "en", "s"))
    got = {r.doc_id: r.component_id for r in op4_near.near_duplicates(spark.createDataFrame(docs, SCHEMA), 3, 85).collect()}
    assert got == {i: c for i, (_, c) in components(docs, 3, 85).items()}


def test_keys_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = spark.createDataFrame([(i if i % 9 else None, f"t{i}") for i in range(200)], "doc_id long, _hit string")
    keys = common.written(spark.createDataFrame([(i, -i) for i in range(0, 150, 3)], "doc_id long, n long"))
    for most in (common.BROADCAST_BYTES, 0):
        monkeypatch.setattr(common, "BROADCAST_BYTES", most)
        assert sorted(r.doc_id for r in common.with_keys(rows, keys, "doc_id").collect()) == [i for i in range(200) if i % 9 and i % 3 == 0 and i < 150]
        left = [r.doc_id for r in common.without_keys(rows, keys, "doc_id").collect()]
        assert sorted(i for i in left if i is not None) == [i for i in range(200) if i % 9 and (i % 3 or i >= 150)] and left.count(None) == 23
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    docs = spark.createDataFrame(ODD, SCHEMA)
    assert sorted(map(tuple, op7_exact.dedup(docs).collect())) == exact(ODD)
    assert {r.doc_id: r.component_id for r in op4_near.near_duplicates(docs, 3, 85).collect()} == {i: c for i, (_, c) in components(ODD, 3, 85).items()}


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        common._own_folder(Context())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (100, 60), (200, 201), (5, 5)]
    got = {r.node: r.label for r in op4_near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and got[50] == got[60] == got[100] != got[0] and got[200] == got[201]
    assert op4_near.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_revisits(spark):
    m = lambda **h: {k.replace("_", "-"): v for k, v in h.items()}
    rows = [
        (1, "http://A.com/x/?b=2&utm_source=q&a=1#f", 10, "response", m(ETag='"v1"', Age="0", Content_Length="5"), "one"), (2, "https://www.a.com:443/x?a=1&b=2", 20, "revisit", m(etag='W/"v1"', age="9", content_length="0"), None),
        (3, "http://a.com/x?a=1&b=2", 30, "response", m(ETag='"v2"', Last_Modified="d"), "two"), (4, "http://a.com/x?a=1&b=2", 40, "revisit", m(ETag='"v1"'), None), (5, "http://a.com/x?a=1&b=2", 50, "revisit", m(Last_Modified="d"), None),
        (6, "http://b.com/", 5, "revisit", m(), None), (7, None, 60, "revisit", None, None), (8, "http://a.com/x?a=1&b=2", None, "revisit", m(), None), (9, "http://a.com/x?a=1&b=2", 30, "revisit", m(ETag='"v2"'), None),
    ]
    schema = "record_id long, url string, date long, kind string, headers map<string,string>, body string"
    got = {r.record_id: r for r in op5_warc.resolve(spark.createDataFrame(rows, schema), ("body",)).collect()}
    assert (got[2].state, got[2].target_id, got[2].body) == ("resolved", 1, "one")
    assert got[2].headers == {"etag": 'W/"v1"', "age": "9", "content-length": "5"}
    assert (got[4].state, got[4].target_id, got[4].body) == ("changed", 3, None)
    assert [got[i].state for i in (5, 6, 7, 8, 9)] == ["resolved", "unknown", "unknown", "unknown", "resolved"]
    assert op5_warc.resolve(spark.createDataFrame([], schema)).count() == 0


def test_fingerprints(odd, none):
    got = sorted(op6_imatch.fingerprints(odd).collect(), key=lambda r: r.doc_id)
    assert len(got) == len(ODD) and op6_imatch.fingerprints(none).count() == 0
    texts = sorted((i, t or "") for i, t, *_ in ODD)
    for (i, t), (_, after), r in zip(texts, texts[1:] + texts[:1], got, strict=True):
        k = len(t) // 4
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (i, len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest())
    prints = {}
    for (_, t), r in zip(texts, got, strict=True):
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_revisits_against_brute_force(spark, monkeypatch):
    """Ties, repeated records, one date far off, and carried columns with names that the operator uses inside."""
    import random

    monkeypatch.setattr(op5_warc, "RANGES", 6)
    rng = random.Random(3)
    rows = []
    for i in range(400):
        kind = rng.choice(["response", "revisit"])
        date = rng.choice([None, 10**15, *range(20)]) if i % 7 else rng.randrange(1000)
        rows.append((i // 2 if kind == "revisit" else i, f"http://h{rng.choice('aaab')}.com/", date, kind, {"ETag": f'"{rng.randrange(3)}"', "Last-Modified": "x" * rng.choice([0, 5000])} if i % 11 else None, f"d{i}", i, f"k{i}"))
    schema = "record_id long, url string, date long, kind string, headers map<string,string>, digest string, part int, row string"
    got = op5_warc.resolve(spark.createDataFrame(rows, schema), ("digest", "part", "row")).collect()
    wanted = Counter()
    for record, url, date, kind, headers, *_ in rows:
        if kind == "revisit":
            earlier = [r for r in rows if r[3] == "response" and date is not None and r[1] == url and r[2] is not None and (r[2], r[0]) < (date, record)]
            target = max(earlier, key=lambda r: (r[2], r[0])) if earlier else None
            good = bool(target and headers and target[4] and target[4]["ETag"] == headers["ETag"])
            wanted[record, target and target[0], "unknown" if target is None else "resolved" if good else "changed", *(target[5:] if good else (None, None, None))] += 1
    assert Counter((r.record_id, r.target_id, r.state, r.digest, r.part, r.row) for r in got) == wanted


@pytest.mark.parametrize("ids", [[-(2**63), 0, 2**63 - 1, None, 7, 7], ["b", "a", "", None, "zz", "a\n"], [5], [None, None]])
def test_fingerprints_of_any_ids(spark, monkeypatch, ids):
    """The next document over many buckets, at the ends of the range of numbers, by strings, and past the last."""
    monkeypatch.setattr(op6_imatch, "PER_BUCKET", 1)
    monkeypatch.setattr(op6_imatch, "AT_ONCE", 2)
    kind = "string" if isinstance(ids[0], str) else "long"
    texts = [f"{'xyzuvw'[k] * (8 + k)} common words here" for k in range(len(ids))]
    rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {kind}, text string")
    ties = {r.text: r.tie for r in rows.select("text", F.xxhash64("text").alias("tie")).collect()}
    order = sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, ties[r[1]]))
    wanted = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 4
        wanted[i, hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()] += 1
    got = op6_imatch.fingerprints(rows).collect()
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == wanted


def _share(a, b):
    """The likeness of two fingerprints by their text."""
    x, y = a.split(":"), b.split(":")
    if a == b:
        return 1.0
    if "0" in (x[0], y[0]):
        return 0.0
    step, parts = int(x[0]) - int(y[0]), 0.0
    if abs(step) <= 1:
        pairs = list(zip(x[1 + (step < 0)].split("."), y[1 + (step > 0)].split("."), strict=True))
        either = [(p, q) for p, q in pairs if (p, q) != ("-", "-")]
        parts = sum(p == q for p, q in either) / len(either) if either else 0.0
    wide = [p == q for p, q in zip(x[3].split("."), y[3].split("."), strict=True)]
    return max(parts, sum(wide) / len(wide))


def test_likeness_by_the_fingerprints_text(spark):
    rows = sorted(op6_imatch.query(spark, DATA).collect(), key=lambda r: r.doc_id)
    for r, after in zip(rows, rows[1:] + rows[:1], strict=True):
        assert r.near_edited == pytest.approx(_share(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(_share(r.fingerprint, after.fingerprint))


def test_wide_lexicons_cover_every_term(spark):
    """The order of terms does not count; one term more changes the entries of the wide lexicons that it is in."""
    words = " ".join(f"w{j}" for j in range(60))
    rows = spark.createDataFrame([(0, words), (1, words + " another"), (2, " ".join(reversed(words.split())))], "doc_id long, text string")
    wide = [r.fingerprint.split(":")[3].split(".") for r in sorted(op6_imatch.fingerprints(rows).collect(), key=lambda r: r.doc_id)]
    assert wide[0] == wide[2] != wide[1] and len(wide[0]) == op6_imatch.WIDE


def test_fingerprints_tell_apart(spark):
    rows = op6_imatch.query(spark, "/root/testdata/sf0.01").agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).first()
    assert rows.e > 0.4 and rows.n < 0.05


def exact(docs):
    last, n = {}, Counter()
    for i, t, *_ in docs:
        last[t or ""] = max(last.get(t or "", i), i)
        n[t or ""] += 1
    return sorted((i, last[t or ""], n[t or ""], i == last[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in docs)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(odd, none, weak):
    """weak: a digest of the first character alone, so that bytes must tell the texts apart."""
    more = {"digest": lambda t: F.sha2(F.substring(t, 1, 1), 256)} if weak else {}
    assert sorted(map(tuple, op7_exact.dedup(odd, **more).collect())) == exact(ODD)
    assert op7_exact.dedup(none, **more).count() == 0


def test_pages(spark):
    rows = spark.createDataFrame([(1, None, "u"), (2, "<p>x", "u"), (2, "<p>x", "u")], "page_id long, html string, text string")
    assert sorted(map(tuple, op8_html.extract(rows).collect())) == [(1, ""), (2, "x"), (2, "x")]


def test_bpe(odd, none):
    got = op9_bpe.apply(odd).collect()
    texts = {i: t or "" for i, t, *_ in ODD}
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and (r.n_tokens == 0) == (texts[r.doc_id] == "")
    assert len(got) == len(ODD) and op9_bpe.apply(none).count() == 0


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 1) for i, *_ in ODD], "doc_id long, toxic int, quality int")
    got = op10_toxic.apply(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert op10_toxic.apply(none, labels).count() == 0
    assert {r.score for r in op10_toxic.apply(odd, labels.limit(0)).collect()} == {0.0}


def test_toxicity_of_repeated_ids(spark):
    """Rows that repeat a labelled id reach the driver once, and are scored each; clashing columns pass through."""
    seen = []
    docs = spark.createDataFrame([(1, f"some words {k}") for k in range(500)] + [(2, "other bad words"), (None, None)], "doc_id long, text string").withColumn("label", F.lit("x"))
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    real = op10_toxic.fit
    op10_toxic.fit = lambda texts, toxic: seen.append(len(texts)) or real(texts, toxic)
    try:
        assert op10_toxic.apply(docs, labels).count() == 502
    finally:
        op10_toxic.fit = real
    assert seen and seen[0] <= 2


def test_toxicity_held_out(spark):
    base = "/root/testdata/sf0.1"
    rows = op10_toxic.query(spark, base).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").filter("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r.toxic: r.p for r in rows}
    assert share[1] > 0.85 and share[0] < 0.03


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, DATA)
        assert out.columns == columns, name
        path = f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/{name.replace(' ', '_')}"
        out.write.mode("overwrite").parquet(path)
        before, seen = seen, spark.read.parquet(path)
        if name == "exact dedup":
            assert seen.count() == before.select("text").distinct().count()
        if name == "near dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert sorted(r.doc_id for r in seen.collect()) == sorted(i for i, (_, c) in components(rows, 5, 80).items() if c == i)
    last = corpus_pipeline.STAGES[-1][1](spark, seen, DATA)
    assert last.count() == seen.count()
    assert corpus_pipeline.run(spark, DATA).count() == last.count()


def test_repeated_rows_are_one(spark, odd):
    rows = odd.select("doc_id", "text", "lang", "source", "n_chars")
    out = corpus_pipeline.exact_dedup(spark, rows, DATA).collect()
    assert Counter(r.text or "" for r in out).most_common(1)[0][1] == 1 and len(out) == len({t or "" for _, t, *_ in ODD})


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query_against_sql(spark, name):
    import duckdb

    got = entry.QUERIES[name](spark, DATA)
    if name not in entry.ORACLE_SQL:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    wanted = con.execute(entry.ORACLE_SQL[name]).df()
    columns = sorted(wanted.columns)
    assert sorted(got.columns) == columns
    text = lambda v: str(int(v)) if isinstance(v, float) and v == v else str(v)
    assert sorted(tuple(map(text, r)) for r in got.select(columns).toPandas().itertuples(index=False)) == sorted(tuple(map(text, r)) for r in wanted[columns].itertuples(index=False))


def test_stages_leave_other_results_and_columns_alone(spark):
    """Nulls, blanks, copies and clashing names in every stage, and a result held while a run deletes its own tables."""
    rows = spark.createDataFrame(ODD, SCHEMA).select("*", *[F.lit(f"own {c}").alias(c) for c in ("_words", "_id", "_size", "_copies", "_toxic_score", "size", "key")])
    held = op2_mix.mix(spark.createDataFrame(ODD, SCHEMA))
    out = rows
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = common.written(stage(spark, out, DATA))
        assert out.columns == rows.columns and {r._words for r in out.collect()} == {"own _words"}, name
    none = rows.limit(0)
    assert corpus_pipeline.STAGES[3][1](spark, none, DATA).count() == corpus_pipeline.STAGES[1][1](spark, none, DATA).count() == 0
    with common.Tables() as own:
        mine = common.written(rows.limit(2))
        own.forget(spark)
    assert not own.paths and held.count() == len(ODD)
    with pytest.raises(Exception, match="(?i)path|file"):
        mine.count()
