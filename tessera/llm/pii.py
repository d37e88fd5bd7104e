"""Operator 5: personal data by candidate spans and boosted trees, in DataFrame
operations only.

Base spans are matched and validated by rule. Beside them, generators of high
recall propose overlapping spans of the same kinds (any digit group that might
be a number, spelled-out addresses, ...). Gradient boosted trees score a
proposal on its format (length, digits, separators, checksum, ranges) and its
context (neighbouring characters, cue words before it); a threshold per kind,
calibrated on proposals outside of all base spans, picks the additional
redactions.

The trees learn from the rules: a proposal counts as personal if it lies in a
validated base span of its kind (a local number inside an international one),
and as not personal if it lies outside and nothing tells of a value; they see
no marker (``+``) that would spell the rule out. What is told outside of base
spans (``told``: a spelled-out address, a number in its national form or right
behind a cue word, a card number of another length with a true checksum and a
cue) is kept from training altogether. It is what the thresholds are measured
on, against all other outside proposals. Nothing is sampled: proposals enter as
counts per feature vector.

Everything stays in one pass per row: spans are arrays, found with
``regexp_extract_all`` beside ``split`` (the texts between the matches give
the offsets), and the fitted trees are applied as a SQL expression.

Patterns are the base ones in a form Java's matcher runs in linear time and
without recursion (possessive repeats, a look-behind where a run of characters
would be tried from each of its ends); they match the same spans.

Defined cases: NULL text counts as empty and has no spans; very long digit or
word runs are matched whole and fail their checks; repeated rows are each
scanned; with too few proposals to train on, only base spans are returned.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

SPANS = "array<struct<kind:string,s:int,e:int>>"
KINDS = ("email", "ip", "card", "phone")
EMAIL_CHARS = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{EMAIL_CHARS}]))[{EMAIL_CHARS}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{2,63}+"
             r"(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]{2,63}+){1,8}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:[.][0-9]{1,3}+){2,4}+(?![0-9])",
    "card": r"(?<![0-9-])[0-9]{3,6}+(?:[ -]?[0-9]{3,6}+){2,5}+(?![0-9])",
    "phone": r"(?<![0-9(])\(?[0-9]{2,4}+\)?[ .-]?[0-9]{2,4}+(?:[ .-][0-9]{2,4}+){1,3}+(?![0-9])",
}
CUES = {"email": "mail|contact|write|address|kontakt|correo", "ip": r"\bip\b|host|server|address|login|adresse",
        "card": "card|visa|master|credit|payment|karte|carte|tarjeta|account",
        "phone": "phone|call|tel|mobile|fax|contact|anruf|appel|llam"}
# a cue word right before the value
CUE_AT = {"card": r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\b[^0-9]{0,12}$",
          "phone": r"(?i)\b(?:phone|telephone|call|tel|mobile|fax|anruf|appel)\b[^0-9]{0,12}$",
          "email": r"(?i)\b(?:e-?mail|mail|write|contact|kontakt|correo)\b[^@]{0,12}$"}
IP_PART = "^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, t>>: matches of ``pattern`` with code point offsets."""
    hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gap = F.split(text, pattern, -1)
    size = F.transform(F.arrays_zip(gap.alias("g"), hit.alias("m")), lambda x: F.struct(
        F.length(x["g"]).alias("g"), F.length(x["m"]).alias("n"), x["m"].alias("t")))
    empty = F.array().cast("array<struct<s:int,e:int,t:string>>")
    walk = F.aggregate(
        F.filter(size, lambda x: x["t"].isNotNull()), F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.struct((a["at"] + x["g"] + x["n"]).alias("at"), F.concat(a["out"], F.array(F.struct(
            (a["at"] + x["g"]).alias("s"), (a["at"] + x["g"] + x["n"]).alias("e"), x["t"].alias("t")))).alias("out")),
        lambda a: a["out"])
    return F.when(text.rlike(pattern), walk).otherwise(empty)


def digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def valid(kind: str, t: Column) -> Column:
    d = digits(t)
    if kind == "ip":
        return F.forall(F.split(t, r"\."), lambda p: p.rlike(IP_PART))
    if kind == "card":
        return F.length(d).between(16, 19) & F.call_function("luhn_check", d)
    if kind == "phone":
        return F.length(d).between(8, 15)
    return F.lit(True)


def features(text: Column, kind: str, x: Column) -> Column:
    """Format and context of a proposal, as array<double>."""
    t = F.regexp_replace(x["t"], r"^\+", "")  # the rule's own marker is not a feature
    d = digits(t)
    before = F.substring(text, F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24)))
    after = F.substring(text, x["e"] + 1, F.lit(1))
    n = F.length(t)
    cols = [F.lit(KINDS.index(kind)), n, F.length(d), F.size(F.split(t, r"[ .()-]+", -1)),
            F.length(F.regexp_replace(t, "[^ ]", "")), F.length(F.regexp_replace(t, "[^-]", "")),
            F.length(F.regexp_replace(t, "[^.]", "")), F.length(F.regexp_replace(t, "[^A-Za-z]", "")),
            F.call_function("luhn_check", F.when(d == "", F.lit("1")).otherwise(d)).cast("int"),
            F.forall(F.split(t, r"\."), lambda p: p.rlike(IP_PART)).cast("int"),
            t.rlike(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}$").cast("int"),
            before.rlike(f"(?i){CUES[kind]}").cast("int"), before.rlike("[A-Za-z0-9_]$").cast("int"),
            after.rlike("[A-Za-z0-9_]").cast("int"), (F.length(d) / F.greatest(n, F.lit(1)))]
    return F.array(*[c.cast("double") for c in cols])


def told(text: Column, kind: str, x: Column) -> Column:
    """What tells that a match is a value of its kind although no base span
    covers it: its spelling, national form, checksum, or a cue right before it."""
    t, d = x["t"], digits(x["t"])
    if kind == "ip":
        return F.lit(False)  # every address is a base span
    before = F.substring(text, F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24)))
    cue = before.rlike(CUE_AT[kind])
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(F.lower(t), r" ?(?:@|\(at\)|\[at\]) ?", "@"),
                                 r" ?(?:\(dot\)|\[dot\]) ?", ".")
        return plain.rlike(r"^[a-z0-9._-]++@[a-z0-9-][a-z0-9.-]*\.[a-z]{2,}$") & (t.rlike(r"[(\[]at[)\]]") | cue)
    if kind == "card":
        return F.length(d).between(13, 19) & F.call_function("luhn_check", d) & cue
    return t.rlike(r"^\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}$") | (F.length(d).between(8, 15) & cue)


def proposals(text: Column, kind: str) -> Column:
    """Matches of both generators of a kind, with features. ``ok``: a valid
    base span; ``y``: lies in one; ``w``: something else tells of a value."""
    base = matches(text, BASE[kind])
    spans = F.filter(base, lambda x: valid(kind, x["t"]))
    both = F.concat(F.transform(base, lambda x: F.struct(x["s"], x["e"], x["t"], valid(kind, x["t"]).alias("ok"),
                                                         F.lit(False).alias("w"))),
                    F.transform(matches(text, MORE[kind]), lambda x: F.struct(
                        x["s"], x["e"], x["t"], F.lit(False).alias("ok"), told(text, kind, x).alias("w"))))
    return F.transform(both, lambda x: F.struct(
        F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["ok"].alias("ok"),
        F.exists(spans, lambda b: (b["s"] <= x["s"]) & (x["e"] <= b["e"])).alias("y"),
        x["w"].alias("w"),
        features(text, kind, x).alias("f")))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def overlaps(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"]))


def with_proposals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, ``base`` (array of kind, s, e) and ``all`` proposals; sparse."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    # texts without digit or at sign have neither base spans nor proposals
    t = F.when(F.col("t").rlike(r"[0-9@]|[(\[]at[)\]]"), F.col("t")).otherwise(F.lit(""))
    rows = rows.select("doc_id", t.alias("t"))
    rows = rows.select("doc_id", F.concat(*[proposals(F.col("t"), k) for k in KINDS]).alias("all"))
    base = F.transform(F.filter("all", lambda x: x["ok"]), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return rows.select("doc_id", base.cast(SPANS).alias("base"), "all")


class Trees:
    """Fitted boosted trees as a Column expression, and a threshold per kind."""

    def __init__(self, trees: list, weights: list[float]):
        self.trees, self.weights, self.thresholds = trees, weights, {k: float("inf") for k in KINDS}

    def accepts(self, x: Column) -> Column:
        least = F.create_map(*[F.lit(v) for kv in self.thresholds.items() for v in kv])
        return self.margin(x["f"]) >= F.element_at(least, x["kind"])

    def margin(self, f: Column) -> Column:
        def node(n) -> Column:
            if isinstance(n, float):
                return F.lit(n)
            i, cut, left, right = n
            return F.when(f[i] <= cut, node(left)).otherwise(node(right))
        out = F.lit(0.0)
        for w, t in zip(self.weights, self.trees):
            out = out + F.lit(w) * node(t)
        return out


def _read_tree(n):
    if n.getClass().getSimpleName() == "LeafNode":
        return float(n.prediction())
    s = n.split()
    return s.featureIndex(), float(s.threshold()), _read_tree(n.leftChild()), _read_tree(n.rightChild())


def fit(rows: DataFrame, precision: float = 0.8, trees: int = 10, depth: int = 4, least: int = 200) -> Trees | None:
    """Boosted trees on all proposals and a threshold per kind: the lowest
    margin above which ``precision`` of the proposals outside of base spans are
    told to be values; those never train. Proposals of equal features are one
    weighted row, so what is fitted does not grow with the text. A kind without
    told proposals gets no additions."""
    x = rows.select("base", F.explode("all").alias("x")).select(
        "x.kind", F.col("x.y").cast("double").alias("y"), F.col("x.f").alias("f"), F.col("x.w").alias("w"),
        (~F.col("x.y") & ~overlaps(F.col("x"), F.col("base"))).alias("outside"))
    x = materialise(x.groupBy("kind", "y", "f", "w", "outside").agg(F.count(F.lit(1)).alias("n")), "pii-formats")
    n, pos = x.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("y") * F.col("n")), F.lit(0.0))).first()
    if n < least or not 0 < pos < n:
        return None
    train = x.where("not (outside and w)").groupBy("y", "f").agg(F.sum("n").cast("double").alias("n")) \
        .select("y", array_to_vector("f").alias("v"), "n").cache()
    formats = train.count()
    if train.select("y").distinct().count() < 2:
        train.unpersist()
        return None
    # bins: split points come from all rows up to the square of their number
    model = GBTClassifier(featuresCol="v", labelCol="y", weightCol="n", maxIter=trees, maxDepth=depth, seed=5,
                          maxBins=max(32, math.isqrt(formats) + 1)).fit(train)
    train.unpersist()
    t = Trees([_read_tree(t._call_java("rootNode")) for t in model.trees], list(model.treeWeights))
    # margins take at most as many values as leaf combinations occur
    told_n, other_n = (F.sum(F.when(c, F.col("n")).otherwise(0)) for c in (F.col("w"), ~F.col("w")))
    curve = x.where("outside").groupBy("kind", t.margin(F.col("f")).alias("m")).agg(
        told_n.alias("p"), other_n.alias("other")).orderBy(F.desc("m"), "kind").collect()
    good, total = dict.fromkeys(KINDS, 0), dict.fromkeys(KINDS, 0)
    for r in curve:
        good[r.kind] += r.p
        total[r.kind] += r.p + r.other
        if good[r.kind] and good[r.kind] >= precision * total[r.kind]:
            t.thresholds[r.kind] = r.m
    return t


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``doc_id``, counts ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` of base
    spans, ``base`` and ``spans`` (arrays of kind, s, e, ordered by kind as
    listed, then start) for each row."""
    rows = materialise(with_proposals(docs, id_col, text_col), "pii-proposals")
    trees = fit(rows, **how)
    added = F.array().cast(SPANS)
    if trees is not None:
        more = F.filter("all", lambda x: ~x["ok"] & ~overlaps(x, F.col("base"))
                        & trees.accepts(x))
        # of proposals that overlap, the first (longest at its start) is taken
        ordered = F.array_sort(F.transform(more, lambda x: F.struct(
            x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))))
        added = F.aggregate(ordered, added, lambda a, x: F.when(
            F.exists(a, lambda y: (x["s"] < y["e"]) & (y["s"] < -x["e"])), a).otherwise(
            F.concat(a, F.array(F.struct(x["kind"].alias("kind"), x["s"].alias("s"), (-x["e"]).alias("e"))))))

    def by_kind(spans: Column) -> Column:
        return F.flatten(F.array(*[F.array_sort(of_kind(spans, k)) for k in KINDS]))

    rows = rows.select("doc_id", by_kind(F.col("base")).alias("base"), by_kind(F.concat("base", added)).alias("spans"))
    count = [F.size(of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *count, "base", "spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
