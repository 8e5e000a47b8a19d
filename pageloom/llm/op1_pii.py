"""Personal data by candidate gradient boosting, in SQL functions.

Base spans follow fixed patterns and always stay. High-recall generators propose further spans, which may overlap; boosted
trees score them by format and by the words before, and a threshold for each kind, calibrated on examples that the trees
have not seen, selects those that are added, the surest first, where they overlap no span that is there already.

The trees are grown on the driver from the generated examples of examples(), a fixed number, whose candidates and
features come from the same SQL functions; they are applied as SQL expressions.

Null texts count as empty and have no spans. Offsets are code points, ends exclusive. U+0001 in a text is read as U+0002,
which no pattern tells apart. Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "iban", "secret")
#: The contract's patterns; runs are possessive and start where no longer run does, so that no text takes quadratic time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|\z)){4}\z"
GENERATORS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|[(\[{] ?at ?[)\]}]) ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[{] ?dot ?[)\]}]) ?[A-Za-z0-9-]++)++",
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,18}(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,64}[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}",
}
BEFORE = 28
FEW = 64
HINTS = {
    "says_secret": r"(?i)(?:token|secret|passw|pwd|api.?key|key|auth|bearer|credential)[^A-Za-z0-9]{0,6}\z",
    "says_card": r"(?i)(?:card|visa|credit|debit|mastercard|amex|\bcc)\b[^0-9]{0,10}\z",
    "says_phone": r"(?i)(?:phone|tel|call|mobile|fax|cell|whatsapp|sms)\b[^0-9]{0,10}\z",
    "says_ssn": r"(?i)(?:ssn|social security|tax id)[^0-9]{0,12}\z",
    "says_bank": r"(?i)(?:iban|account|acct|bank|transfer)[^0-9]{0,10}\z",
    "says_other": r"(?i)(?:order|invoice|version|isbn|ref|item|page|build|commit|sha|md5|serial|ticket|released?|doi|batch|model)[^0-9]{0,10}\z",
}
FEATURES = ("kind_number", "digits", "length", "upper", "lower", "marks", "luhn", "plus", "octets", "at", "quoted", "hex", "grouped", *HINTS)
TREES, DEPTH, SHRINK = 40, 3, 0.3
SPAN = "struct<start: int, end: int, value: string, before: string>"
KINDED = "struct<start: int, end: int, kind: string>"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def scan(array: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """What emit(state, x), an array of the kind, gives for each x of the array, one after another; step(state, x) is the
    next state. Arrays of n > FEW are walked in chunks of about sqrt(n), so that no output is copied n times."""
    nothing = F.array().cast(f"array<{kind}>")

    def of_chunk(chunk: Column, state: Column) -> Column:
        return F.aggregate(
            chunk,
            F.struct(state.alias("state"), nothing.alias("out")),
            lambda a, x: F.struct(step(a["state"], x).alias("state"), F.concat(a["out"], emit(a["state"], x)).cast(f"array<{kind}>").alias("out")),
            lambda a: a["out"],
        )

    def begun(chunks: Column) -> Column:
        """The state before each chunk, and after the last."""
        return F.aggregate(
            chunks,
            F.struct(zero.alias("state"), F.array(zero).alias("all")),
            lambda a, chunk: let(F.aggregate(chunk, a["state"], step), lambda end: F.struct(end.alias("state"), F.concat(a["all"], F.array(end)).alias("all"))),
            lambda a: a["all"],
        )

    def in_chunks(whole: Column, width: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / width).cast("int")), lambda j: F.slice(whole, j * width + 1, width))
        paired = let(chunks, lambda c: F.zip_with(c, F.slice(begun(c), F.lit(1), F.size(c)), lambda x, z: F.struct(x.alias("x"), z.alias("z"))))
        return F.flatten(F.transform(paired, lambda p: of_chunk(p["x"], p["z"])))

    long = lambda whole: let(F.ceil(F.sqrt(F.size(whole))).cast("int"), lambda width: in_chunks(whole, width))
    return let(array, lambda whole: F.when(F.size(whole) <= FEW, of_chunk(whole, zero)).otherwise(long(whole)))


def found(text: Column, pattern: str) -> Column:
    """array of (start, end, value, before): the leftmost matches that do not overlap, and the BEFORE characters before
    them. Matches are set off by U+0001, and the lengths of the parts add up to their places."""
    parts = F.split(F.regexp_replace(F.translate(text, "\x01", "\x02"), pattern, "\x01$0\x01"), "\x01", -1)
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.lit("").alias("before"))

    def step(state: Column, part: Column) -> Column:
        return F.struct((state["at"] + F.length(part)).alias("at"), (~state["inside"]).alias("inside"), F.right(F.concat(state["before"], part), F.lit(BEFORE)).alias("before"))

    def emit(state: Column, part: Column) -> Column:
        own = F.struct(state["at"].alias("start"), (state["at"] + F.length(part)).alias("end"), part.alias("value"), state["before"].alias("before"))
        return F.when(state["inside"], F.array(own)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return scan(parts, zero, step, emit, SPAN)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether there are 12 to 19 digits and they pass the check of card numbers."""
    digits = F.reverse(digits_of(value))
    fits = F.length(digits).between(12, 19)
    places = F.sequence(F.lit(0), F.greatest(F.length(digits) - 1, F.lit(0)))

    def weight(i: Column) -> Column:
        d = F.substring(digits, i + 1, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, double).otherwise(d)

    total = F.aggregate(F.transform(places, weight), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))
    return F.when(fits, total % 10 == 0).otherwise(False)


def base_spans(text: Column, kind: str) -> Column:
    all_ = found(text, BASE[kind])
    n = lambda s: F.length(digits_of(s["value"]))
    if kind == "ip":
        return F.filter(all_, lambda s: s["value"].rlike(OCTETS))
    if kind == "card":
        return F.filter(all_, lambda s: luhn(s["value"]))
    if kind == "phone":
        return F.filter(all_, lambda s: n(s).between(9, 15))
    return all_


def kind_of(generator: str, value: Column) -> Column:
    """The kind that a candidate is if it is one at all; null if it can be none."""
    if generator == "mail":
        return F.lit("email")
    if generator != "number":
        return F.lit(generator)
    n = F.length(digits_of(value))
    return F.when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}\z"), "ssn").when(n >= 16, "card").when(n.between(12, 15) & ~value.startswith("+") & ~value.rlike(r"[()]"), "card").when(n >= 9, "phone")


def described(spans: Column, generator: str) -> Column:
    """The spans with their kinds and features."""
    count = lambda v, cls: F.length(F.regexp_replace(v, f"[^{cls}]", "")).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)

    def row(s: Column) -> Column:
        v, kind = s["value"], kind_of(generator, s["value"])
        before = s["before"]
        number = F.coalesce(*[F.when(kind == k, float(i)) for i, k in enumerate(KINDS)])
        cells = {
            "kind_number": number,
            "digits": count(v, "0-9"),
            "length": F.length(v).cast("double"),
            "upper": count(v, "A-Z"),
            "lower": count(v, "a-z"),
            "marks": F.length(F.regexp_replace(v, "[A-Za-z0-9]", "")),
            "luhn": flag(luhn(v)),
            "plus": flag(v.startswith("+")),
            "octets": flag(v.rlike(OCTETS)),
            "at": flag(v.contains("@")),
            "quoted": flag(before.rlike("[\"'=:] ?\\z")),
            "hex": flag(v.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)\z")),
            "grouped": flag(v.rlike(r"^[(+]?[0-9]{1,4}\)?(?:[ .-][(]?[0-9]{2,4}\)?){2,4}\z")),
            **{name: flag(before.rlike(pattern)) for name, pattern in HINTS.items()},
        }
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"), *[cells[f].cast("double").alias(f) for f in FEATURES])

    return F.filter(F.transform(spans, row), lambda c: c["kind"].isNotNull())


def candidates(text: Column) -> Column:
    """All generators' spans, described; they may overlap."""
    return F.concat(*[described(found(text, pattern), name) for name, pattern in GENERATORS.items()])


def examples() -> list[tuple[str, int, int, str]]:
    """(text, start, end, kind) of invented data to be found, and (text, 0, 0, '') without any: a few of each form, over
    running numbers."""

    def digits(i: int, n: int) -> str:
        return "".join(str((i * 7919 + k * k * 31 + k * (i % 13) + i // (k + 1)) % 10) for k in range(n))

    def passing(i: int, n: int) -> str:
        body = digits(i, n - 1)
        total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    def letters(i: int, n: int, of: str) -> str:
        return "".join(of[(i * 31 + k * k * 17 + k * 7 + i // (k + 2)) % len(of)] for k in range(n))

    low, hexes, mixed, up = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "aB3dE5gH7jK9mN1pQrS2tUvW4xYz6", "ABCDEFGHJKLMNPQRSTUVWXYZ"
    out = []

    def add(before: str, value: str, after: str, kind: str) -> None:
        out.append((before + value + after, len(before), len(before) + len(value), kind))

    for i in range(1, 41):
        word, name = letters(i, 5 + i % 4, low), letters(i + 5, 6, low)
        d = lambda n, i=i: digits(i + n, n)
        lead = (f"{word} {name} ", "contact: ", f"{name}. ", "write to ")[i % 4]
        add(lead, f"{name}{'(at)' if i % 2 else ' [at] '}{word}{'.' if i % 3 else ' (dot) '}com", f" {word}", "email")
        add(("call ", "tel. ", "phone: ", "mobile ")[i % 4], (f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(3)} {d(4)}")[i // 4 % 4], f" {word}", "phone")
        add(lead, f"+{1 + i % 9} ({d(3)}) {d(3)}-{d(4)}", f", {word}", "phone")
        add(lead, f"({d(3)}) {d(3)}-{d(4)}", f" {word}", "phone")
        add(("card ", "visa: ", "credit card no ", f"{word} ")[i % 4], passing(i, 16), f" {word}", "card")
        add(("card ", "paid by ", "visa ", f"{word} ")[i % 4], "/".join(passing(i, 16)[k : k + 4] for k in (0, 4, 8, 12)), f" {word}", "card")
        add(("ssn ", "social security ", f"{word} ", f"{name}, ")[i % 4], f"{d(3)}-{d(2)}-{d(4)}", f" {word}", "ssn")
        add(("iban ", "account ", f"{word} ", "transfer to ")[i % 4], f"{letters(i, 2, up)}{d(2)} " + " ".join(digits(i + k, 4) for k in range(4 + i % 2)), f" {word}", "iban")
        add(('token = "', "api_key=", "secret: ", 'password = "')[i % 4], (letters(i, 40, hexes) + "7", letters(i, 24 + i % 9, mixed) + "3", "sk-" + letters(i, 32, mixed) + "8", letters(i, 32, hexes) + "5")[i // 4 % 4], '" ' + word, "secret")
        for text in (
            f"order {d(16)} {word}", f"{word} {d(16)} {name}"[:80], f"invoice {d(9)}, {word}", f"version {i}.{i % 7}.{d(3)}.{d(4)} {word}", f"isbn {d(3)}-{d(1)}-{d(3)}-{d(5)}-{d(1)} {word}",
            f"{word} 20{i % 30:02d}-{1 + i % 12:02d}-{1 + i % 28:02d} {name}", f"{word} {d(7)} {name}", f"commit {letters(i, 40, hexes)}9 {word}", f"{word}-{name}-{letters(i, 8, low)}{i} {name}", f"page {d(3)} of {d(4)}, {word}",
            f"{word} {d(4)} {d(4)} {name}", f"build {d(8)} {d(4)}", f"{word}_{name}_{letters(i, 9, low)}_{i}", f"serial {letters(i, 4, up)}{d(12)} {word}", f"{word} {' '.join(d(12 + i % 8))} {name}", f"{word} {d(3)}.{d(3)}.{d(3)} {name}", f"released {1 + i % 28}.{1 + i % 12}.20{i % 30:02d} {word}",
        ):
            if not any(w.isdigit() and len(w) >= 12 and passes(w) for w in text.split(" ")):
                out.append((text, 0, 0, ""))
    return out


def passes(digits: str) -> bool:
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


@dataclass
class Model:
    trees: list[list[tuple]]  # each a list of (path, value): path of (feature, bound, not greater)
    thresholds: dict[str, float]

    def margin(self, c: Column) -> Column:
        def leaf(path: tuple, value: float) -> tuple[Column, float]:
            test = F.lit(True)
            for feature, bound, below in path:
                test = test & ((c[feature] <= bound) if below else (c[feature] > bound))
            return test, value

        total = F.lit(0.0)
        for tree in self.trees:
            case = None
            for path, value in tree:
                test, v = leaf(path, value)
                case = F.when(test, v) if case is None else case.when(test, v)
            total = total + case.otherwise(0.0)
        return total


def grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, path: tuple, depth: int) -> list[tuple]:
    """Leaves of a tree of Newton steps."""
    value = -SHRINK * float(gradient.sum() / (weight.sum() + 1.0))
    best = (1e-6, None)
    if depth:
        score = lambda g, h: g * g / (h + 1.0)
        whole = score(gradient.sum(), weight.sum())
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for bound in (values[:-1] + values[1:]) / 2:
                below = x[:, f] <= bound
                gain = score(gradient[below].sum(), weight[below].sum()) + score(gradient[~below].sum(), weight[~below].sum()) - whole
                if gain > best[0] + 1e-9:
                    best = (gain, (f, float(bound), below))
    if best[1] is None:
        return [(path, value)]
    f, bound, below = best[1]
    out = []
    for side, at in ((True, below), (False, ~below)):
        out += grow(x[at], gradient[at], weight[at], (*path, (FEATURES[f], bound, side)), depth - 1)
    return out


def applied(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for path, value in tree:
        at = np.ones(len(x), bool)
        for feature, bound, below in path:
            column = x[:, FEATURES.index(feature)]
            at &= (column <= bound) if below else (column > bound)
        out[at] = value
    return out


_grown: list[Model] = []


def grown(spark: SparkSession) -> Model:
    """The model of train(), which is the same each time and kept."""
    if not _grown:
        _grown.append(train(spark))
    return _grown[0]


def train(spark: SparkSession) -> Model:
    """Trees from three quarters of the examples, thresholds from the others: of each kind where nine tenths of the
    selected candidates are right, midway to the next candidate, and no less than even odds."""
    made = examples()
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("text")) for i, (t, *_) in enumerate(made)])).alias("e")
    rows = spark.range(1).select(values).select("e.i", F.explode(candidates(F.col("e.text"))).alias("c")).collect()
    rows.sort(key=lambda r: (r.i, r.c.start, r.c.end, r.c.kind))
    x = np.array([[r.c[f] for f in FEATURES] for r in rows])
    y = np.array([r.c.kind == made[r.i][3] and (r.c.start, r.c.end) == made[r.i][1:3] for r in rows], float)
    unseen = np.array([(r.i * 2654435761 >> 7) % 4 == 3 for r in rows])  # of each form some
    margin, trees = np.zeros(len(x)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        fit = ~unseen
        tree = grow(x[fit], (p - y)[fit], (p * (1 - p))[fit], (), DEPTH)
        trees.append(tree)
        margin += applied(tree, x)
    thresholds = {}
    for k, kind in enumerate(KINDS):
        own = unseen & (x[:, 0] == k)
        order = np.argsort(-margin[own], kind="stable")
        right = np.cumsum(y[own][order]) / np.arange(1, order.size + 1)
        good = np.flatnonzero(right >= 0.9)
        ordered = [*margin[own][order], -np.inf]
        thresholds[kind] = max(0.0, float(ordered[good[-1]] + max(0.0, ordered[good[-1] + 1])) / 2) if good.size else 1e9
    return Model(trees, thresholds)


def added(base: Column, proposed: Column) -> Column:
    """The base spans and the proposed ones, from the surest on, that overlap no span before them. Spans that overlap,
    be it by way of others, are a cluster; only those of one cluster are held against each other."""
    last = F.lit(-float("inf"))  # base spans come before all others

    def row(s: Column, margin: Column, own: bool) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), margin.alias("m"), F.lit(own).alias("own"))

    kind = "struct<start: int, end: int, kind: string, m: double, own: boolean>"
    all_ = F.array_sort(F.concat(F.transform(base, lambda s: row(s, last, True)), F.transform(proposed, lambda c: row(c, -c["margin"], False))).cast(f"array<{kind}>"))
    # Empty spans do not occur, so that a span begins a cluster where none before it reaches beyond its start.
    ranked = "struct<cluster: int, m: double, start: int, less: int, kind: string, own: boolean>"
    zero = F.struct(F.lit(-1).alias("cluster"), F.lit(-1).alias("until"))
    cluster = lambda state, x: F.when(x["start"] >= state["until"], x["start"]).otherwise(state["cluster"])
    marked = scan(
        all_,
        zero,
        lambda state, x: F.struct(cluster(state, x).alias("cluster"), F.greatest(state["until"], x["end"]).alias("until")),
        lambda state, x: F.array(F.struct(cluster(state, x).alias("cluster"), x["m"].alias("m"), x["start"].alias("start"), (-x["end"]).alias("less"), x["kind"].alias("kind"), x["own"].alias("own"))),
        ranked,
    )
    spans = "array<struct<start: int, end: int>>"
    kept = lambda state, x: F.when(state["cluster"] == x["cluster"], state["kept"]).otherwise(F.array().cast(spans))
    stays = lambda before, x: x["own"] | ~F.exists(before, lambda s: (s["start"] < -x["less"]) & (x["start"] < s["end"]))
    one = lambda x: F.array(F.struct(x["start"].alias("start"), (-x["less"]).alias("end")))
    chosen = scan(
        F.array_sort(marked),
        F.struct(F.lit(-1).alias("cluster"), F.array().cast(spans).alias("kept")),
        lambda state, x: let(kept(state, x), lambda before: F.struct(x["cluster"].alias("cluster"), F.when(stays(before, x), F.concat(before, one(x))).otherwise(before).cast(spans).alias("kept"))),
        lambda state, x: F.when(stays(kept(state, x), x), F.array(F.struct(x["start"].alias("start"), (-x["less"]).alias("end"), x["kind"].alias("kind")))).otherwise(F.array().cast(f"array<{KINDED}>")),
        KINDED,
    )
    return F.when(F.size(proposed) > 0, chosen).otherwise(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind."""
    number = lambda kind: F.coalesce(*[F.when(kind == k, i) for i, k in enumerate(KINDS)])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), number(s["kind"]).alias("number"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, text, base (array of start, end, kind), spans (the same with those added) of every row."""
    model = model or grown(docs.sparkSession)
    kind = f"array<{KINDED}>"
    rows = docs.select("doc_id", text_of().alias("text"))
    # Every pattern needs a digit or one of these.
    hit = F.col("text").rlike(r"[0-9@]|[(\[{] ?at ?[)\]}]")
    nothing = F.array().cast(kind)
    for k in BASE_KINDS:
        name = F.lit(k)
        named = F.transform(base_spans(F.col("text"), k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), name.alias("kind"))).cast(kind)
        rows = rows.withColumn(k, F.when(hit, named).otherwise(nothing))
    rows = rows.withColumn("base", F.concat(*BASE_KINDS))
    fields = "start: int, end: int, kind: string, " + ", ".join(f"{f}: double" for f in FEATURES)
    rows = rows.withColumn("proposed", F.when(hit, candidates(F.col("text")).cast(f"array<struct<{fields}>>")).otherwise(F.array().cast(f"array<struct<{fields}>>")))
    scored = F.transform("proposed", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), model.margin(c).alias("margin")))
    bound = lambda kind: F.coalesce(*[F.when(kind == k, t) for k, t in model.thresholds.items()])
    rows = rows.withColumn("proposed", F.filter(scored, lambda c: c["margin"] >= bound(c["kind"])))
    return rows.withColumn("spans", added(F.col("base"), F.col("proposed")))


def redact(docs: DataFrame, mask: str = "[{}]") -> DataFrame:
    """doc_id, text with each span replaced by its kind. Where spans overlap, the first one names them all."""
    rows = find(docs).select("doc_id", "text", F.array_sort("spans").alias("spans"))
    # Once as characters, so that no part is sought from the text's start.
    rows = rows.withColumn("chars", F.when(F.size("spans") > 0, F.split("text", "")))
    part = lambda start, end: F.array_join(F.slice("chars", start + 1, F.greatest(end - start, F.lit(0))), "")
    pieces = scan(
        F.concat("spans", F.array(F.struct(F.length("text").alias("start"), F.length("text").alias("end"), F.lit(None).cast("string").alias("kind")))),
        F.lit(0),
        lambda at, s: F.greatest(at, s["end"]),
        lambda at, s: F.when(s["start"] < at, F.array().cast("array<string>")).otherwise(F.array(part(at, s["start"]), F.when(s["kind"].isNull(), "").otherwise(F.format_string(mask.replace("{}", "%s"), s["kind"])))),
        "string",
    )
    return rows.select("doc_id", F.when(F.size("spans") > 0, F.array_join(pieces, "")).otherwise(F.col("text")).alias("text"))


def apply(docs: DataFrame) -> DataFrame:
    rows = find(docs)
    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"))
