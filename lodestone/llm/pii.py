"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides.

Base spans (emails, IP addresses, cards, phone numbers of fixed forms) always
stay. Beside them looser patterns propose spans: numbers that stand inside
what a base form gave up, and kinds that have no base form. On every span
labelers vote for, against, or not: its format, its check sum or range,
gazetteers, words before it, and what it borders on. EM over how often each
combination of votes occurs estimates how reliable each labeler is and how
likely each combination; a logistic regression learned from these decides
about the proposed spans. Only DataFrame operations touch the texts; what comes
to the driver is a row per combination of votes (at most 243 a kind).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, texts

OPEN, SHUT = "\x01", "\x02"
#: Base forms, in Java's dialect: possessive and anchored at the ends of runs, so that none needs quadratic time or deep recursion; each finds what the plain pattern finds, of cards only the runs of 16 to 19 digits, which alone can count.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Proposals beyond the base forms.
MORE = {
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?",
}
#: A text without these has no such span, which is cheaper to see; those kinds that need a digit are looked at only where there is one.
HINT = {"email": "@", "phone": "\\+", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "ssn": "[0-9]-[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "name": "(?:Mr|Mrs|Ms|Dr|Prof)\\.?\\x20"}
DIGITS = {"ip", "card", "phone", "ssn", "iban"}
KINDS = ("email", "ip", "card", "phone", "iban", "name", "ssn")
NEAR = 40
#: Characters in which marks are placed together; spans that are replaced in one stretch of a text.
PIECE, SPANS = 512, 512
#: Words before a span that speak for its kind.
WORDS = {
    "email": "mail|contact|write|reach", "ip": "(?i:ip|address|host|server|login)", "card": "card|visa|master|amex|credit|debit|pay",
    "phone": "phone|call|tel|mobile|fax|contact", "iban": "iban|account|bank|konto|compte|cuenta", "name": "name|from|by|dear|patient|client", "ssn": "ssn|social|security",
}
#: Gazetteers: starts of card numbers, calling codes, top-level domains, countries of bank accounts, given names.
ISSUERS = "(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
CALLING = "(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
DOMAINS = "(?i:com|org|net|edu|gov|info|biz|io|de|fr|es|uk|it|nl|eu|us|ch|at)"
BANKS = "(?:AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IL|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SA|SE|SI|SK|TR)"
NAMES = "(?:Anna|Ben|Carlos|David|Elena|Emma|Hans|Ines|James|John|Julia|Karl|Laura|Luis|Maria|Marie|Mary|Michael|Paul|Peter|Pierre|Sarah|Thomas)"
LABELERS = ("format", "check", "gazetteer", "context", "border")
#: What EM starts from: how often a labeler that votes is right. It counts as PRIOR votes.
START, PRIOR = (0.8, 0.95, 0.75, 0.85, 0.65), 20.0
ROUNDS = 40
SPAN = "array<struct<kind:string,start:bigint,end:bigint,match:string,before:string,after:string>>"


def _once(value: Column, use) -> Column:
    """``use(value)``, for which ``value`` is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def mark_places(marked: Column) -> Column:
    """Where the marks of a text stand, in code points of the text without them, in order.

    An array that an aggregate adds to is copied at every step, so the text is
    taken in pieces of ``PIECE`` characters: sums within pieces are short, and
    so are those over pieces.
    """
    sums = lambda lengths, first: F.aggregate(lengths, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    marks = f"[{OPEN}{SHUT}]"
    parts = F.regexp_extract_all(marked, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def each(pieces: Column) -> Column:
        before = sums(F.transform(pieces, lambda p: F.length(F.regexp_replace(p, marks, "")).cast("long")), F.lit(0).cast("long"))
        inner = lambda z: _once(F.split(z["p"], marks, -1), lambda q: F.slice(sums(F.transform(q, lambda x: F.length(x).cast("long")), z["b"]), 2, F.size(q) - 1))
        return F.flatten(F.transform(F.slice(F.arrays_zip(pieces.alias("p"), before.alias("b")), 1, F.size(pieces)), inner))

    return _once(parts, each)


def find(text: Column, kind: str, pattern: str, possible: Column) -> Column:
    """Leftmost spans of ``pattern``, which do not overlap: their kind, code-point offsets, text and surroundings; none where not ``possible``."""

    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{SHUT}"))

    def spans(both: Column) -> Column:
        # Pieces stand alternately outside and inside of spans; each begins at a mark.
        pieces, start = both["pieces"], F.concat(F.array(F.lit(0).cast("long")), both["places"])
        rows = F.arrays_zip(pieces.alias("p"), start.alias("s"), F.slice(pieces, 2, F.size(pieces)).alias("nxt"), F.concat(F.array(F.lit("")), pieces).alias("last"))
        inside = F.filter(F.slice(rows, 1, F.size(pieces)), lambda a, i: i % 2 == 1)
        return F.transform(
            inside,
            lambda a: F.struct(F.lit(kind).alias("kind"), a["s"].alias("start"), (a["s"] + F.length(a["p"])).alias("end"), a["p"].alias("match"), F.right(a["last"], F.lit(NEAR)).alias("before"), F.left(a["nxt"], F.lit(1)).alias("after")),
        )

    split = lambda m: _once(F.struct(F.split(m, f"[{OPEN}{SHUT}]", -1).alias("pieces"), mark_places(m).alias("places")), spans)
    return F.when(possible & text.rlike(HINT[kind]), _once(marked, split).cast(SPAN)).otherwise(F.array().cast(SPAN))


def passed(values: Column, asked: Column, equal: bool) -> Column:
    """How many of ``values`` (longs) are less than each of ``asked`` (longs), or not more (``equal``); by sorting both together.

    In the order of both, as many of the values stand before one that is asked
    for as its place there is beyond its place among those asked for.
    """
    own = F.sort_array(F.transform(asked, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    placed = F.transform(own, lambda x, j: F.struct(x["v"].alias("v"), F.lit(1 if equal else 0).alias("side"), j.alias("j"), x["i"].alias("i")))
    other = F.transform(values, lambda v: F.struct(v.alias("v"), F.lit(0 if equal else 1).alias("side"), F.lit(-1).alias("j"), F.lit(-1).alias("i")))
    ranked = F.transform(F.sort_array(F.concat(placed, other)), lambda x, place: F.struct(x["i"].alias("i"), (place - x["j"]).alias("n")))
    return F.transform(F.sort_array(F.filter(ranked, lambda x: x["i"] >= 0)), lambda x: x["n"])


def apart(more: Column, base: Column) -> Column:
    """The spans of ``more`` that overlap none of ``base``, whose own spans of a kind do not overlap each other.

    As many base spans overlap one as begin before its end and have not ended at its start.
    """
    begun = passed(F.transform(base, lambda b: b["start"]), F.transform(more, lambda c: c["end"]), False)
    ended = passed(F.transform(base, lambda b: b["end"]), F.transform(more, lambda c: c["start"]), True)
    free = F.filter(F.arrays_zip(more.alias("c"), begun.alias("b"), ended.alias("e")), lambda z: z["b"] == z["e"])
    return F.when((F.size(more) == 0) | (F.size(base) == 0), more).otherwise(F.transform(free, lambda z: z["c"]))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def base_holds(kind: str, m: Column) -> Column:
    """Whether a base form's match counts."""
    d = digits(m)
    return {
        "email": F.lit(True),
        "ip": m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"),
        "card": F.length(d).between(16, 19) & F.call_function("luhn_check", d),
        "phone": F.length(d).between(8, 15),
    }[kind]


def _iban_holds(m: Column) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(turned, F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97))
    return rest == 1


def votes(c: Column) -> list[Column]:
    """The labelers' votes on a span: 1 for, -1 against, 0 none; in the order of LABELERS."""
    m, d = c["match"], digits(c["match"])
    kind = lambda k: c["kind"] == k
    sign = lambda x: F.when(x, 1).otherwise(-1)
    some = lambda x: F.when(x, 1).otherwise(0)
    form = (
        F.when(kind("email"), sign(m.rlike(r"^[^@]{1,64}@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")))
        .when(kind("ip"), sign(m.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$")))
        .when(kind("card"), some(m.rlike(r"^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$")))
        .when(kind("phone"), sign(m.rlike(r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}$")))
        .when(kind("iban"), some(~m.contains(" ") | m.rlike("^[A-Z0-9]{4}(?: [A-Z0-9]{4})+$")))
        .otherwise(F.lit(0))
    )
    check = (
        F.when(kind("card"), sign(F.call_function("luhn_check", d) & F.length(d).between(13, 19)))
        .when(kind("ip"), sign(base_holds("ip", m)))
        .when(kind("phone"), sign(F.length(d).between(8, 15)))
        .when(kind("iban"), sign(_iban_holds(m)))
        .when(kind("ssn"), sign(~m.rlike("^(?:000|666|9)|-00-|-0000$")))
        .otherwise(F.lit(0))
    )
    known = (
        F.when(kind("card"), some(d.rlike("^" + ISSUERS)))
        .when(kind("phone"), some(d.rlike("^" + CALLING)))
        .when(kind("email"), some(m.rlike(r"\." + DOMAINS + "$")))
        .when(kind("ip"), F.when(m.rlike(r"^(?:0|10|127|22[4-9]|2[3-5][0-9]|169\.254|192\.168)\."), -1).otherwise(1))
        .when(kind("iban"), sign(m.rlike("^" + BANKS)))
        .when(kind("name"), some(m.rlike(r"\x20" + NAMES + r"(?:\x20|$)")))
        .otherwise(F.lit(0))
    )
    context = F.lit(0)
    for k, words in WORDS.items():
        context = F.when(kind(k) & F.lower(c["before"]).rlike(words), 1).otherwise(context)
    border = sign(~c["before"].rlike(r"[A-Za-z0-9@]$") & ~c["after"].rlike(r"^[A-Za-z0-9@]"))
    return [x.cast("int") for x in (form, check, known, context, border)]


def candidates(df: DataFrame) -> DataFrame:
    """``df`` (with ``text``) and ``base`` (spans that stay) and ``spans``: those and what is proposed, with ``base`` and the votes ``v``."""
    marks = F.translate(F.coalesce("text", F.lit("")), OPEN + SHUT, "\x03\x03")
    df = df.withColumn("_t", marks)
    df = df.withColumn("_digit", F.col("_t").rlike("[0-9]"))
    possible = {k: F.col("_digit") if k in DIGITS else F.lit(True) for k in KINDS}
    for k, p in BASE.items():
        df = df.withColumn(f"_b_{k}", F.filter(find(F.col("_t"), k, p, possible[k]), _holds(k)))
    for k, p in MORE.items():
        df = df.withColumn(f"_m_{k}", find(F.col("_t"), k, p, possible[k]))
    df = df.withColumn("base", F.concat(*[F.col(f"_b_{k}") for k in BASE]))
    more = F.concat(*[F.col(f"_m_{k}") for k in MORE])
    df = df.withColumn("_all", more).withColumn("_more", apart(F.col("_all"), F.col("base")))
    told = lambda base: lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.lit(base).alias("base"), F.array(*votes(c)).alias("v"))
    df = df.withColumn("spans", F.concat(F.transform("base", told(True)), F.transform("_more", told(False))))
    return df.withColumn("base", F.transform("base", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))).drop("_t", "_digit", "_more", "_all", *[f"_b_{k}" for k in BASE], *[f"_m_{k}" for k in MORE])


def _holds(kind: str):
    return lambda c: base_holds(kind, c["match"])


@dataclass
class Model:
    """The classifier: an intercept, and for each kind its own weight and one per labeler; and the rates that EM found."""

    intercept: float = -1.0
    weights: dict[str, list[float]] = field(default_factory=dict)
    right: dict[tuple[str, str], float] = field(default_factory=dict)

    def score(self, c: Column) -> Column:
        out = F.lit(0.0)
        for k, (own, *rest) in self.weights.items():
            z = F.lit(own)
            for i, w in enumerate(rest):
                z = z + c["v"][i] * F.lit(w)
            out = F.when(c["kind"] == k, z).otherwise(out)
        return 1.0 / (1.0 + F.exp(-(out + F.lit(self.intercept))))


def estimate(rows: list[tuple[str, tuple[int, ...], int]]) -> tuple[list[float], dict[tuple[str, str], float]]:
    """EM over (kind, votes, count): each row's probability of being personal data, and how often each labeler's votes on a kind are right.

    A labeler has, per kind and class, a chance of each vote, none included, so
    that one which votes on both classes alike has no weight. The chances are
    estimated from the kind's counts (as shares of 1000 votes) and from PRIOR
    votes that are right as often as START says; so is the share of the class.
    """
    speaks = 0.8
    prior = {(j, v, c): (1 - speaks if not v else speaks * (r if (v > 0) == bool(c) else 1 - r)) for j, r in enumerate(START) for v in (-1, 0, 1) for c in (0, 1)}
    post, right = [0.5] * len(rows), {}
    for kind in sorted({k for k, _, _ in rows}):
        mine = [i for i, (k, _, _) in enumerate(rows) if k == kind]
        total = sum(rows[i][2] for i in mine)
        share, chance = 0.5, dict(prior)
        for _ in range(ROUNDS):
            for i in mine:
                odds = math.log(share / (1 - share)) + sum(math.log(chance[j, v, 1] / chance[j, v, 0]) for j, v in enumerate(rows[i][1]))
                post[i] = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            weight = {(i, c): 1000 * rows[i][2] / total * (post[i] if c else 1 - post[i]) for i in mine for c in (0, 1)}
            share = (PRIOR / 2 + sum(weight[i, 1] for i in mine)) / (PRIOR + 1000)
            for j, v, c in prior:
                votes_ = sum(weight[i, c] for i in mine if rows[i][1][j] == v)
                chance[j, v, c] = (PRIOR * prior[j, v, c] + votes_) / (PRIOR + sum(weight[i, c] for i in mine))
        for j, name in enumerate(LABELERS):
            spoke = {(v, c): (share if c else 1 - share) * chance[j, v, c] for v in (-1, 1) for c in (0, 1)}
            right[kind, name] = (spoke[1, 1] + spoke[-1, 0]) / sum(spoke.values())
    return post, right


def learn(found: DataFrame) -> Model:
    """Fits the model on the votes in ``spans`` of all rows; without spans it is the default, which adds none."""
    seen = found.select(F.explode_outer("spans").alias("c")).filter("c.kind is not null").groupBy("c.kind", "c.v").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sorted((r.kind, tuple(r.v), r.n) for r in seen)
    if not rows:
        return Model()
    post, right = estimate(rows)
    total = sum(n for *_, n in rows)
    kinds = sorted({k for k, _, _ in rows})
    marked = [(label, n / total * (p if label else 1 - p), *(float(k == x) * z for x in kinds for z in (1, *v))) for (k, v, n), p in zip(rows, post, strict=True) for label in (0.0, 1.0)]
    inputs = [f"{k}_{name}" for k in kinds for name in ("itself", *LABELERS)]
    frame = found.sparkSession.createDataFrame(marked, ", ".join(["label double", "weight double", *(f"{i} double" for i in inputs)])).coalesce(1)
    ready = VectorAssembler(inputCols=inputs, outputCol="features").transform(frame).select("label", "weight", "features")
    fit = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=60, standardization=False).fit(ready)
    w, wide = [float(x) for x in fit.coefficients], len(LABELERS) + 1
    return Model(float(fit.intercept), {k: w[i * wide : (i + 1) * wide] for i, k in enumerate(kinds)}, right)


def decide(found: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``found`` with ``spans`` now those that are personal data: all base spans, and proposed ones that the classifier takes; by kind and start."""
    keep = F.filter("spans", lambda c: c["base"] | (model.score(c) >= threshold))
    rank = F.array(*map(F.lit, KINDS))
    put = F.transform(keep, lambda c: F.struct(F.array_position(rank, c["kind"]).alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    return found.withColumn("spans", F.sort_array(put))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"])), ",")


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): ``base`` the base spans by kind and start, ``spans`` all, with kind, start and end in code points.

    Null texts are empty. Characters U+0001 and U+0002 count as any other
    control character. Repeated rows give a row each; texts are taken whole, in
    time that grows with them; other columns play no part. Without a proposed
    span in any text there is nothing to learn, and none is added.
    """
    found = cut(candidates(texts(df, id_col, text_col)).select("doc_id", "base", "spans"))
    return decide(found, learn(found))


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of :func:`detect`."""
    got = detect(df, id_col, text_col)
    counts = [F.size(_of("base", k)).cast("long").alias(f"n_{k}") for k in BASE]
    return got.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _of(col: str, kind: str) -> Column:
    return F.filter(col, lambda c: c["kind"] == kind)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``df`` with every span replaced by its kind in brackets, overlapping ones by one; ``size_col`` follows where there is one.

    Null texts stay null. The votes are counted in a first pass and the texts
    changed in a second, in which no text is shuffled.
    """
    model = learn(candidates(texts(df, id_col, text_col)))
    cols = df.columns
    rows = df.select(F.struct(*cols).alias("_row"), F.col(text_col).alias("text"))
    found = decide(candidates(rows), model)
    spans = F.sort_array(F.transform("spans", lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), c["end"].alias("end"), c["kind"].alias("kind"))))
    found = found.withColumn("_cuts", spans).withColumn("_ends", F.sort_array(F.transform("_cuts", lambda c: c["end"])))
    # A span goes if one before it reaches beyond its start, that is if not all before it have ended there.
    ended = passed(F.col("_ends"), F.transform("_cuts", lambda c: c["start"]), True)
    fresh = F.filter(F.transform(F.arrays_zip(F.col("_cuts").alias("c"), ended.alias("n")), lambda z, i: F.struct(z["c"].alias("c"), (z["n"] == i).alias("fresh"), F.coalesce(F.get(F.col("_ends"), i - 1), F.lit(0).cast("long")).alias("at"))), lambda z: z["fresh"])
    found = found.withColumn("_fresh", fresh)
    text = F.col("text")

    # In stretches, as each look into a text walks to its place: a stretch of the text is cut out once.
    def stretch(some: Column) -> Column:
        base, upto = some[0]["at"], F.element_at(some, -1)["c"]["start"]
        part = F.substring(text, (base + 1).cast("int"), (upto - base).cast("int"))
        one = lambda p: F.array_join(F.transform(some, lambda z: F.concat(F.substring(p, (z["at"] - base + 1).cast("int"), (z["c"]["start"] - z["at"]).cast("int")), F.lit("["), F.upper(z["c"]["kind"]), F.lit("]"))), "")
        return _once(part, one)

    starts = F.sequence(F.lit(0), F.floor((F.size("_fresh") - 1) / SPANS).cast("int"))
    parts = F.transform(starts, lambda i: _once(F.slice("_fresh", i * SPANS + 1, F.lit(SPANS)), stretch))
    new = F.concat(F.array_join(parts, ""), F.substring(text, (F.array_max("_ends") + 1).cast("int"), F.length(text)))
    found = found.withColumn("_new", F.when(F.size("spans") > 0, new).otherwise(text))
    fresh = [F.col("_new").alias(c) if c == text_col else F.length("_new").cast(df.schema[c].dataType).alias(c) if c == size_col else F.col("_row")[c].alias(c) for c in cols]
    return found.select(*fresh)
