"""Operator 3: personal data by weak supervision, in DataFrame functions only.

Patterns propose spans; labelers (pattern validity, structure, gazetteers,
contexts, borders) vote on each; expectation-maximisation estimates from the
votes alone how reliable each labeler is; and a logistic span classifier fitted
on the resulting probabilities decides which spans are added to the base ones.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crisismap.llm.common import own_columns, stored, table

KINDS = ("email", "ip", "card", "phone")
# Stand-ins inside a working copy of the text, one character each; the text's own ones become BLANK there.
JOINT, MARK, BLANK = "\x01", "\x02", "\x03"

# What counts as personal data of each kind (see the module's query contract).
LOCAL = "A-Za-z0-9._%+-"
HOST = "A-Za-z0-9-"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
CARD_DIGITS = (14, 19)
PHONE_DIGITS = (10, 15)

# Gazetteers and context words of the labelers.
TOP_DOMAINS = ("com org net edu gov mil int info biz name io co me app dev eu uk us de fr es it nl at ch be pt pl se no "
               "fi dk ie cz gr ru ua tr ca au nz jp cn in br mx ar cl za kr il").split()
HINTS = {
    "email": "e-?mail|mail|contact|write|kontakt|courriel|correo|reach",
    "ip": "ip|address|server|host|adresse|direcci[oó]n|login|client",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|payment",
    "phone": "phone|call|tel|telefon|tel[eé]fono|t[eé]l[eé]phone|mobile|cell|fax|dial|whatsapp",
}
COUNTER_HINTS = "version|v|release|section|chapter|isbn|issn|order|invoice|ref|build|license|page|fig|figure|table"
BEFORE_CHARS, AFTER_CHARS = 40, 24

EM_ROUNDS = 10
ACCEPT_AT = 0.5
LABELERS = ("rule", "structure", "gazetteer", "hint", "counter", "border")


def _working_copy(text: Column) -> Column:
    """The text with no stand-in of its own; the same length in code points."""
    own = text.contains(JOINT) | text.contains(MARK)
    return F.when(own, F.translate(text, JOINT + MARK, BLANK + BLANK)).otherwise(text)


def _cut(text: Column, pattern: str, gate: Column) -> Column:
    """The text between and at the matches of a pattern, in turn; empty where the gate is shut."""
    return F.when(gate, F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)).otherwise(
        F.array().cast("array<string>"))


def _sources(text: Column) -> list[tuple[str, bool, Column]]:
    """(kind, whether base, cut text) of each pattern.

    Repeated groups are written as classes, after joining separators to a
    stand-in, so that no run of characters, however long, needs deep recursion
    or is tried again from each of its places.
    """
    digits = text.rlike(r"[0-9][0-9 ().:/_-]{5}")
    dots = F.regexp_replace(text, rf"(?<=[{HOST}])\.(?=[{HOST}])", JOINT)
    gaps = F.regexp_replace(text, r"(?<=[0-9])[ -](?=[0-9])", JOINT)
    many = f"{{{CARD_DIGITS[0] - 1},}}+"
    return [
        ("email", True, _cut(dots, rf"(?:(?<![{JOINT}{LOCAL}])|\G)[{JOINT}{LOCAL}]++@[{HOST}]++{JOINT}[{JOINT}{HOST}]++",
                             text.contains("@"))),
        ("ip", True, _cut(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", text.rlike(r"[0-9]\.[0-9]"))),
        ("card", True, _cut(gaps, rf"(?<![0-9{JOINT}])[0-9][0-9{JOINT}]{many}", digits)),
        ("phone", True, _cut(text, PHONE, text.contains("+"))),
        ("email", False, _cut(text, rf"(?<![{LOCAL}])[{LOCAL}]++ ?[(\[]at[)\]] ?[{HOST}]++(?: ?(?:[(\[]dot[)\]]|\.) ?[{HOST}]++)"
                              "{1,4}", text.contains("at)") | text.contains("at]"))),
        ("ip", False, _cut(text, r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
                           text.contains(":"))),
        ("card", False, _cut(text, r"(?<![0-9])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])", digits)),
        ("phone", False, _cut(text, r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[. -])[0-9]{3}[. -][0-9]{4}(?![0-9])"
                              r"|(?<![0-9+().-])00[1-9][0-9 ().-]{7,16}[0-9](?![0-9])", digits)),
    ]


def _ends(cut: Column) -> Column:
    """Where each part of a cut text ends, in code points, after a leading zero."""
    return F.aggregate(F.transform(cut, F.char_length), F.array(F.lit(0)),
                       lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))


def _spans(kind: str, base: bool, cut: Column, ends: Column) -> Column:
    """The matches in a cut text as structs with their place in code points and their surroundings."""

    def span(part: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"), F.get(ends, i).alias("start"),
            F.get(ends, i + 1).alias("end"), F.translate(part, JOINT, "." if kind == "email" else "-").alias("match"),
            F.substring(F.translate(F.get(cut, i - 1), JOINT, "."), -BEFORE_CHARS, BEFORE_CHARS).alias("before"),
            F.substring(F.translate(F.get(cut, i + 1), JOINT, "."), 1, AFTER_CHARS).alias("after")))

    return F.filter(F.transform(cut, span), lambda s: s.isNotNull())


def _luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        digit = F.ascii(F.substr(digits, -i, F.lit(1))) - 48
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), step) % 10 == 0


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _judged(s: Column) -> Column:
    """A span with the labelers' votes and its shape: all the classifier sees of it."""
    kind, match = s["kind"], s["match"]
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.char_length(digits)
    of = {name: kind == i for i, name in enumerate(KINDS)}
    octets = match.rlike(OCTETS)
    luhn = F.when(n.between(*CARD_DIGITS), _luhn(digits)).otherwise(F.lit(False))
    phone_size = n.between(*PHONE_DIGITS)
    valid = s["base"] & (of["email"] | (of["ip"] & octets) | (of["card"] & luhn) | (of["phone"] & phone_size))
    plausible = (of["email"] | (of["ip"] & (octets | match.contains(":"))) | (of["card"] & luhn)
                 | (of["phone"] & phone_size))
    domain = F.lower(F.regexp_extract(match, r"([A-Za-z]+)[^A-Za-z]*$", 1))
    known = F.when(of["email"], domain.isin(TOP_DOMAINS)).when(of["card"], digits.rlike("^(?:3[0-9]|4|5[1-5]|2[2-7]|6)")) \
        .when(of["phone"], digits.rlike("^(?:00)?(?:1?[2-9][0-9]{2}[2-9]|[2-9][0-9])")) \
        .otherwise(~match.rlike(r"^0*(?:0|127|22[4-9]|2[3-5][0-9])\."))
    unknown = F.when(of["email"] | of["card"], ~known).otherwise(F.lit(False))
    hint = F.lit(False)
    for name, pattern in HINTS.items():
        hint = hint | (of[name] & s["before"].rlike(rf"(?i)\b(?:{pattern})\b[^A-Za-z0-9]*(?:[A-Za-z]+[^A-Za-z0-9]+)?$"))
    counter = s["before"].rlike(rf"(?i)\b(?:{COUNTER_HINTS})[ .:#]*$") | s["before"].rlike(r"[=/#\"']$")
    glued = s["before"].rlike("[A-Za-z0-9]$") | s["after"].rlike("^[A-Za-z0-9]")
    votes = {
        "rule": F.when(s["base"], F.when(valid, 1).otherwise(-1)).otherwise(0),
        "structure": F.when(plausible, 1).otherwise(-1),
        "gazetteer": _vote(F.coalesce(known, F.lit(False)), F.coalesce(unknown, F.lit(False))),
        "hint": _vote(hint, F.lit(False)),
        "counter": _vote(F.lit(False), counter),
        "border": F.when(glued, -1).otherwise(1),
    }
    return F.struct(s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end"), valid.alias("base"),
                    *[v.cast("int").alias(name) for name, v in votes.items()],
                    F.least(n, F.lit(20)).alias("digits"),
                    F.least(F.floor(F.char_length(match) / 8), F.lit(5)).cast("int").alias("size"))


def candidates(docs: DataFrame, name: str = "candidates") -> DataFrame:
    """``docs`` with an array of judged spans in a column ``name``; one map over whole texts, no shuffle."""
    work = f"text_{uuid.uuid4().hex}"
    found = docs.withColumn(work, _working_copy(F.coalesce("text", F.lit(""))))
    sources = _sources(F.col(work))
    cuts = [f"cut{i}_{uuid.uuid4().hex}" for i in range(len(sources))]
    found = found.select(*own_columns(docs), *[cut.alias(c) for c, (_, _, cut) in zip(cuts, sources, strict=True)])
    # columns of their own: an expression inside a function over arrays would be worked out again for each element
    ends = [f"ends_{c}" for c in cuts]
    found = found.select("*", *[_ends(F.col(c)).alias(e) for c, e in zip(cuts, ends, strict=True)])
    every = f"spans_{uuid.uuid4().hex}"
    found = found.select(*own_columns(docs), F.concat(*[
        _spans(kind, base, F.col(c), F.col(e)) for c, e, (kind, base, _) in zip(cuts, ends, sources, strict=True)]).alias(every))
    return found.select(*own_columns(docs), F.transform(every, _judged).alias(name))


FEATURES = (*LABELERS, "digits", "size", *[f"is_{k}" for k in KINDS])


@dataclass(frozen=True)
class SpanClassifier:
    """Weights of the features, an intercept, and the labelers' estimated reliabilities (for inspection)."""

    weights: dict[str, float]
    intercept: float
    reliability: dict[str, float]

    def probability(self, span: Column) -> Column:
        """That a judged span is personal data."""
        total = F.lit(self.intercept)
        for name, weight in self.weights.items():
            value = (span["kind"] == KINDS.index(name[3:])).cast("double") if name.startswith("is_") else span[name]
            total = total + F.lit(weight) * value
        return 1 / (1 + F.exp(-total))


def _posterior(patterns: DataFrame, rounds: int) -> tuple[Column, dict[str, float]]:
    """Probability of each vote pattern after EM over (votes, kind, n), and the labelers' reliabilities.

    The first guess is the majority of the votes. Each round is one small
    aggregation: how often each labeler votes so, given each class.
    """
    p = 1 / (1 + F.exp(-sum((F.col(j) for j in LABELERS[1:]), F.col(LABELERS[0])).cast("double")))
    reliability = {}
    for _ in range(rounds):
        shares = ((1, F.col("yes")), (0, F.col("no")))
        sums = [F.sum(F.when(F.col(j) == v, q)).alias(f"{j}{v}{y}") for j in LABELERS for v in (-1, 0, 1) for y, q in shares]
        sums += [F.sum(F.when(F.col("kind") == k, q)).alias(f"kind{k}{y}") for k in range(len(KINDS)) for y, q in shares]
        split = patterns.withColumn("p", p).withColumn("yes", F.col("n") * F.col("p")).withColumn(
            "no", F.col("n") * (1 - F.col("p")))
        got = {name: value or 0.0 for name, value in split.agg(*sums).first().asDict().items()}
        odds = F.lit(0.0)
        for k in range(len(KINDS)):
            odds = odds + F.when(F.col("kind") == k, F.log(F.lit((got[f"kind{k}1"] + 1) / (got[f"kind{k}0"] + 1)))).otherwise(0.0)
        for j in LABELERS:
            whole = [sum(got[f"{j}{v}{y}"] for v in (-1, 0, 1)) + 3 for y in (0, 1)]
            for v in (-1, 0, 1):
                ratio = (got[f"{j}{v}1"] + 1) / whole[1] / ((got[f"{j}{v}0"] + 1) / whole[0])
                odds = odds + F.when(F.col(j) == v, F.log(F.lit(ratio))).otherwise(0.0)
            right = got[f"{j}11"] + got[f"{j}-10"]
            spoken = right + got[f"{j}10"] + got[f"{j}-11"]
            reliability[j] = (right + 1) / (spoken + 2)
        p = 1 / (1 + F.exp(-odds))
    return p, reliability


def train(found: DataFrame, name: str = "candidates", rounds: int = EM_ROUNDS) -> SpanClassifier | None:
    """Fit on all judged spans of a table that has them; None if there is no span.

    Spans count only through their votes and shape, whose combinations are
    bounded, so the spans of the whole corpus come down to a small table.
    """
    span = ("kind", *LABELERS, "digits", "size")
    patterns = stored(found.select(F.explode(name).alias("s")).groupBy(*[F.col("s")[c].alias(c) for c in span])
                      .agg(F.count("*").cast("double").alias("n")), "pii-patterns").coalesce(1)
    if patterns.isEmpty():
        return None
    p, reliability = _posterior(patterns, rounds)
    marked = patterns.withColumn("p", p)
    for i, kind in enumerate(KINDS):
        marked = marked.withColumn(f"is_{kind}", (F.col("kind") == i).cast("double"))
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("weight")),
                             F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("weight"))))
    rows = marked.withColumn("both", both).select(*FEATURES, "both.label", "both.weight").where("weight > 0")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    fitted = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=1e-4,
                                maxIter=30, standardization=False).fit(rows)
    return SpanClassifier(dict(zip(FEATURES, map(float, fitted.coefficients), strict=True)), float(fitted.intercept),
                          reliability)


def accepted(found: Column, classifier: SpanClassifier | None, threshold: float = ACCEPT_AT) -> Column:
    """Sorted spans of a document: the base ones, and those added that overlap none of them."""
    base = F.filter(found, lambda s: s["base"])
    if classifier is None:
        return F.sort_array(base)
    added = F.filter(found, lambda s: ~s["base"] & (classifier.probability(s) >= threshold)
                     & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.sort_array(F.concat(base, added))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of base spans by kind, base_sha256, spans (all spans).

    NULL and empty texts have no span: counts 0, the digest of an empty list,
    spans ''. Ids may be NULL or repeated; other columns aren't read. An empty
    table, or one without any span, fits no classifier and adds nothing.
    """
    found = stored(candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"), "pii-spans")
    spans = found.select("doc_id", accepted(F.col("candidates"), train(found)).alias("spans"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [_count(base, i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"))


def _redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind in square brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        gap = F.substr(text, done["at"] + 1, s["start"] - done["at"])
        return F.when(s["start"] < done["at"], F.struct(F.greatest(done["at"], s["end"]).alias("at"), done["out"].alias("out"))) \
            .otherwise(F.struct(s["end"].alias("at"), F.concat(done["out"], gap, F.get(names, s["kind"])).alias("out")))

    return F.aggregate(spans, first, step, lambda done: F.concat(done["out"], F.substr(text, done["at"] + 1, F.char_length(text))))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind; ``n_chars``, if there, follows the new text.

    Texts without a span, NULL ones included, and all other columns stay as they are.
    """
    name = f"candidates_{uuid.uuid4().hex}"  # clashes with no column
    found = stored(candidates(docs, name), "pii-docs")
    spans = accepted(F.col(name), train(found, name))
    some = found.withColumn(name, spans)
    text = F.when(F.size(name) > 0, _redacted(F.col("text"), F.col(name))).otherwise(F.col("text"))
    out = some.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size(name) > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*own_columns(docs))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return report(table(spark, sf_dir, "documents"))


QUERIES = {"op3_pii": op3_pii}
ORACLE: dict[str, str] = {}
