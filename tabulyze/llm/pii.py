"""Personal data by gradient-boosted span candidates, in DataFrame functions only.

Generators with high recall propose spans of each kind; they may overlap. Spans of the base kinds
that pass their format check are always kept. The other proposals are judged by boosted trees over
format and context features, with a threshold for each kind calibrated on rows the trees have not
seen. The trees are turned into column expressions, so judging is a projection.

There are no hand-made labels for spans. The trees learn from rules of thumb: a base proposal is
personal if its format check holds; a long key is if it mixes letters and digits and a word such as
"token" assigns it; a phone number without country code is if a word such as "tel" stands before
it. Proposals alike in kind, label and features are one weighted row, so every proposal of the
table takes part: of those alike, half teach the trees and half set the thresholds (a hash says
where the odd one goes), so both follow the whole table, wherever in their texts proposals stand.

Defined results: null is an empty text in `personal_data` and stays null in `redacted`; empty texts
and tables have no spans; repeated rows and ids are judged one by one; extra columns are ignored by
`personal_data` and carried along by `redacted`. Without both labels to learn from nothing is added.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabulyze.functions.columns import col
from tabulyze.llm.stamping import unused, written

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "local_phone")

LOCAL = "A-Za-z0-9._%+-"
#: Possessive forms of the base expressions: the same matches, without going back over long runs.
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+",
    "local_phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: What a text must hold before the expression above is tried.
HINTS = {
    "email": "@", "phone": "+",
    "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}",
    "secret": PATTERNS["secret"], "local_phone": r"[0-9][\x20.-][0-9]{4}",
}
OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
KEYWORD = r"(?i)(?:token|secret|passw|api|key|auth|tel|phone|call|fax|mobil)\W*$"
CONTEXT = 16
SPAN = "array<struct<s:int,kind:int,e:int,v:string>>"


@dataclass(frozen=True)
class PiiOptions:
    """balance bounds what all proposals together weigh for the trees, equally by kind and label.

    Thresholds are set on plain counts.
    """

    balance: float = 20_000.0
    trees: int = 6
    depth: int = 3
    precision: float = 0.95


def _hinted(text: Column, kind: str) -> Column:
    if kind in ("email", "phone"):
        return text.contains(HINTS[kind])
    return text.rlike(HINTS[kind])


def _matches(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches; places come from the lengths of what lies between."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("v"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["v"])
        span = F.struct(start.alias("s"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("e"),
                        x["v"].alias("v"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    empty = F.array().cast(SPAN)
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step,
                        lambda a: a["out"])
    return F.when(_hinted(text, kind), spans).otherwise(empty)


def _luhn(digits: Column) -> Column:
    def doubled(i: Column) -> Column:
        x = F.substring(digits, -i, F.lit(1)).cast("int") * (2 - i % 2)
        return F.when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0),
                        lambda a, i: a + doubled(i))
    return total % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    """The format check of a base kind; false for the others."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == KINDS.index("email"), True)
        .when(kind == KINDS.index("ip"), value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
        .when(kind == KINDS.index("card"),
              F.when(n.between(14, 19), _luhn(digits)).otherwise(False))
        .when(kind == KINDS.index("phone"), n.between(10, 15))
        .otherwise(False)
    )


def _described(text: Column, span: Column) -> Column:
    """A span with its check, weak label and features."""
    value, kind = span["v"], span["kind"]
    begin = F.greatest(span["s"] - CONTEXT, F.lit(0))
    left = F.substring(text, begin + 1, span["s"] - begin)
    right = F.substring(text, span["e"] + 1, F.lit(1))
    valid = _valid(kind, value)
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    keyword = left.rlike(KEYWORD)
    weak = (
        F.when(kind < len(BASE_KINDS), valid)
        .when(kind == KINDS.index("secret"), keyword & (digits > 0) & (letters > 0))
        .otherwise(keyword)
    )
    numbers = [
        *(kind == i for i in range(len(KINDS))), valid, keyword, left.rlike('["\']$'),
        left.rlike(r"[A-Za-z0-9]$"), right.rlike(r"[A-Za-z0-9]"),
    ]
    counts = [
        F.length(value), digits, letters, F.length(value) - digits - letters,
        F.length(F.regexp_replace(value, "[^A-Z]", "")),
        F.size(F.regexp_extract_all(value, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]"), F.lit(0))),
    ]
    features = F.array(*(x.cast("double") for x in [*numbers, *counts]))
    return F.struct(span["s"].alias("s"), kind.alias("kind"), span["e"].alias("e"),
                    valid.alias("valid"), weak.alias("weak"), features.alias("f"))


def candidates(text: Column) -> Column:
    """All proposals for a text, by start and kind, with checks, labels and features."""
    body = F.coalesce(text, F.lit(""))
    spans = F.concat(*(_matches(body, kind) for kind in KINDS))
    return F.array_sort(F.transform(spans, lambda x: _described(body, x)))


def _tree(node, features: Column) -> Column:
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(node.prediction())
    split = node.split()
    return F.when(
        features[split.featureIndex()] <= split.threshold(), _tree(node.leftChild(), features)
    ).otherwise(_tree(node.rightChild(), features))


@dataclass(frozen=True)
class SpanJudge:
    """Boosted trees and the least margin for each kind."""

    roots: tuple = ()
    weights: tuple[float, ...] = ()
    least: tuple[float | None, ...] = ()

    def margin(self, features: Column) -> Column:
        return reduce(lambda a, b: a + b, (
            _tree(root, features) * w for root, w in zip(self.roots, self.weights)))

    def accepts(self, span: Column) -> Column:
        """Whether a proposal that is no valid base span is personal data."""
        if not self.roots:
            return F.lit(False)
        margin = self.margin(span["f"])
        return reduce(or_, (
            (span["kind"] == kind) & (margin >= least)
            for kind, least in enumerate(self.least)
            if kind >= len(BASE_KINDS) and least is not None
        ), F.lit(False))


def fit_judge(proposals: DataFrame, options: PiiOptions = PiiOptions()) -> SpanJudge:
    """Trees and thresholds from all spans in column `spans`."""
    rows = proposals.select(F.explode("spans").alias("x")).select(
        F.col("x.kind").alias("kind"), F.col("x.weak").cast("double").alias("label"),
        F.col("x.f").alias("f"))
    odd = F.pmod(F.xxhash64("kind", "label", "f"), F.lit(2))
    alike = written(rows.groupBy("kind", "label", "f").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "held", F.shiftright(F.col("n") + odd, 1)).withColumn(
        "taught", F.col("n") - F.col("held")), "alike-spans")
    # At most a row for each kind and label.
    sizes = {(r["kind"], r["label"]): r for r in alike.filter("taught > 0").groupBy(
        "kind", "label").agg(F.sum("taught").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
    if len({label for _, label in sizes}) < 2:
        return SpanJudge()
    share = options.balance / len(sizes)
    scales = {key: min(1.0, share / r["n"]) for key, r in sizes.items()}
    scale = reduce(lambda a, x: a.when(
        (F.col("kind") == x[0][0]) & (F.col("label") == x[0][1]), x[1]), scales.items(), F)
    taught = alike.filter("taught > 0").select(
        "label", array_to_vector("f").alias("features"),
        (F.col("taught") * scale).alias("weight"))
    # The trees look for splits in a part of the rows only if these outnumber the bins squared.
    bins = math.isqrt(sum(r["rows"] for r in sizes.values())) + 1
    weight = sum(r["n"] * scales[key] for key, r in sizes.items())
    model = GBTClassifier(maxIter=options.trees, maxDepth=options.depth, seed=1, stepSize=0.3,
                          weightCol="weight", maxBins=max(32, bins),
                          minWeightFractionPerNode=min(5 / weight, 0.49)).fit(taught)
    judge = SpanJudge(tuple(t._java_obj.rootNode() for t in model.trees),
                      tuple(model.treeWeights))
    falling = W.partitionBy("kind").orderBy(F.desc("margin"))  # a row per margin, not per span
    least = {r["kind"]: r["least"] for r in alike.filter("held > 0").groupBy(
        "kind", judge.margin(F.col("f")).alias("margin")
    ).agg(F.sum(F.col("label") * F.col("held")).alias("good"), F.sum("held").alias("n")).select(
        "kind", "margin", F.sum("good").over(falling).alias("good"),
        F.sum("n").over(falling).alias("n")
    ).filter(F.col("good") >= options.precision * F.col("n"))
        .groupBy("kind").agg(F.min("margin").alias("least")).collect()}
    return SpanJudge(judge.roots, judge.weights, tuple(
        None if k not in least else least[k] - 1e-9 if least[k] > 0 else 0.0
        for k in range(len(KINDS))))


def selected(spans: Column, judge: SpanJudge) -> Column:
    """Valid base spans, and accepted proposals that touch none of them."""
    base = F.filter(spans, lambda x: x["valid"])
    added = F.filter(
        spans, lambda x: ~x["valid"] & judge.accepts(x) & ~F.exists(
            base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return F.array_sort(F.transform(
        F.concat(base, added),
        lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"))))


def _name(kind: Column) -> Column:
    return F.element_at(F.array(*(F.lit(k) for k in KINDS)), kind + 1)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(
        spans, lambda x: F.concat_ws(":", _name(x["kind"]), x["s"].cast("string"),
                                     x["e"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  options: PiiOptions = PiiOptions()) -> DataFrame:
    """One row per text: counts and digest of its base spans, and the list of all spans."""
    found = written(docs.select(col(id_column).alias("id"),
                                candidates(col(text_column)).alias("spans")), "spans")
    judge = fit_judge(found, options)
    base = F.filter("spans", lambda x: x["valid"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == KINDS.index(kind))).cast("long")

    return found.select(
        F.col("id").alias(id_column), *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(selected(F.col("spans"), judge)).alias("spans"),
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    def step(a: Column, x: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, F.greatest(x["s"] - a["at"], F.lit(0)))
        mark = F.concat(F.lit("["), F.upper(_name(x["kind"])), F.lit("]"))
        return F.struct(
            F.greatest(a["at"], x["e"]).alias("at"),
            F.when(x["s"] >= a["at"], F.concat(a["out"], F.array(gap, mark)))
            .otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    parts = F.aggregate(spans, start, step, lambda a: F.concat(
        a["out"], F.array(F.substring(text, a["at"] + 1, F.length(text)))))
    return F.when(F.size(spans) > 0, F.array_join(parts, "")).otherwise(text)


def redacted(docs: DataFrame, text_column: str = "text",
             options: PiiOptions = PiiOptions()) -> DataFrame:
    """The rows with personal data in the text replaced; all columns stay."""
    spans = unused("spans", docs)
    found = written(docs.withColumn(spans, candidates(col(text_column))), "spans")
    judge = fit_judge(found.select(col(spans).alias("spans")), options)
    return found.withColumn(
        text_column, redact(col(text_column), selected(col(spans), judge))).drop(spans)
