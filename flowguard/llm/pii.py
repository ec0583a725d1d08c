"""Personal data by candidate gradient boosting, in built-in functions and MLlib only.

Base patterns (e-mail, ip, card, phone) give spans that always stay. High-recall generators propose
further, overlapping spans of the four kinds: addresses without a domain suffix, dotted numbers of any
size, also with bracketed dots, digit runs of card length whatever their check digit and separators,
numbers grouped like phone numbers.

Boosted trees, fitted with MLlib on the candidates of all documents, judge each candidate by its format
and its context. They have to find what the base patterns miss, so no label may be read off a base
pattern's own mark: each base span is shown once without it, in its place in the text
(a phone number without plus and country code, a card number with other separators, an address
without its suffix, an ip with bracketed dots), and is then a positive. Candidates that meet no base
span of their kind are negatives, as they are and rewritten in the same way, so that the rewriting
tells nothing. The trees learn from one half of the documents; for each kind the threshold is calibrated on the other half, as the
lowest probability above which ``PRECISION`` of the candidates are positive; a kind without positives
or without negatives there adds nothing. A candidate is added if it reaches the threshold of its kind
and overlaps no base span.

The fitted trees become one SQL expression, so all documents are judged in one pass without any
shuffle, explode or Python; every text is searched whole.

Patterns are written so that matching is linear: they start at the edge of a run of their characters
or where the last match ended, and take runs possessively; the matches are those of the plain ones.

Defined results: a null text is empty; an empty text has no spans; equal rows are judged, and count, each; documents
without positive or without negative candidates add nothing. Extra columns pass through ``mark``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowguard.functions.once import once
from flowguard.llm.common import digest_of, materialize, spare
from flowguard.llm.spans import spans

KINDS = ["email", "ip", "card", "phone"]
TREES, DEPTH = 10, 4
PRECISION = 0.95
#: Different candidates in one task of the fit.
PART = 1 << 16

LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[{LABEL}]++(?:\.[{LABEL}]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
OUTSIDE = r"\s@<>()\[\],;:\x22"
WIDE = {
    "email": rf"(?:(?<=[{OUTSIDE}])|^|\G)[^{OUTSIDE}]++@[^{OUTSIDE}]*[A-Za-z0-9]",
    "ip": r"(?:(?<![0-9.])|\G)[0-9]++(?:\[?\.\]?[0-9]++)++",
    "card": r"(?<![0-9])[0-9](?:[ .-]{0,2}[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9])[+]?[(]?[0-9][0-9 ().-]{6,18}[0-9](?![0-9])",
}
#: Words before a candidate that speak for a kind.
CUES = {
    "email": "mail|contact|correo|courriel|write",
    "ip": r"\bip\b|host|server|addr|login",
    "card": "card|visa|credit|account|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobil",
}
CONTEXT = 24
#: Characters kept on both sides of a span that is shown without its mark.
AROUND = 64
FEATURES = [
    "kind", "long", "digits", "letters", "groups", "marks", "dots", "luhn", "bytes", "round", "zero", "before_word", "after_word",
    *(f"cue_{k}" for k in KINDS),
]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    parts = F.split(F.reverse(digits), "")
    value = F.transform(
        parts,
        lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(
            (x.cast("int") * 2) - F.when(x.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(value, F.lit(0), lambda s, x: s + x) % 10 == 0


def _byte(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)


def _passes(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _byte)
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _hint(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike("[0-9]" if kind == "card" else r"[0-9]\.[0-9]")


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, stop>> of the base patterns; kind as its place in KINDS."""

    def of(k: int, kind: str) -> Column:
        own = F.filter(spans(text, BASE[kind], _hint(kind, text)), lambda s: _passes(kind, s["value"]))
        return F.transform(own, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["stop"].alias("stop")))

    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


def candidates(text: Column) -> Column:
    """array<struct<start, kind, stop, features...>> of the generators."""

    def of(k: int, kind: str) -> Column:
        hint = {"phone": text.rlike("[0-9]"), "ip": text.rlike(r"[0-9]\[?\.")}.get(kind, _hint(kind, text))
        return F.transform(spans(text, WIDE[kind], hint), lambda s: _features(text, k, s))

    return F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)])


def _features(text: Column, k: int, s: Column) -> Column:
    value = s["value"]
    digits = _digits(value)
    n = F.length(digits)
    before = F.lower(F.substring(text, F.greatest(F.lit(1), s["start"] + 1 - CONTEXT), F.least(F.lit(CONTEXT), s["start"])))
    after = F.substring(text, s["stop"] + 1, F.lit(1))
    number = {
        "kind": F.lit(k),
        "long": F.length(value),
        "digits": n,
        "letters": F.length(F.regexp_replace(value, "[^A-Za-z]", "")),
        "groups": F.size(F.split(value, "[^0-9]+")),
        "marks": F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")),
        "dots": F.length(F.regexp_replace(value, "[^.]", "")),
        "luhn": F.when(n.between(12, 19), luhn(digits)).otherwise(False).cast("int"),
        "bytes": F.when(value.rlike(r"^[0-9.\[\]]+$"), F.forall(F.split(value, r"\[?\.\]?"), _byte)).otherwise(False).cast("int"),
        "round": F.contains(value, F.lit("(")).cast("int"),
        "zero": F.startswith(digits, F.lit("0")).cast("int"),
        "before_word": before.rlike("[a-z0-9]$").cast("int"),
        "after_word": after.rlike("[A-Za-z0-9]").cast("int"),
        **{f"cue_{kind}": before.rlike(CUES[kind]).cast("int") for kind in KINDS},
    }
    return F.struct(
        s["start"].alias("start"), F.lit(k).alias("kind_no"), s["stop"].alias("stop"), *[number[f].cast("double").alias(f) for f in FEATURES]
    )


class Judge:
    """Fitted trees as an expression, and the threshold of each kind; without trees it adds nothing."""

    def __init__(self, trees: list, weights: list[float], thresholds: dict[int, float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def probability(self, c: Column) -> Column:
        terms = [self._tree(t, c) * w for t, w in zip(self.trees, self.weights)]
        return 1 / (1 + F.exp(sum(terms, F.lit(0.0)) * -2))

    def _tree(self, node, c: Column) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        feature, threshold, left, right = node
        return F.when(c[FEATURES[feature]] <= threshold, self._tree(left, c)).otherwise(self._tree(right, c))

    def added(self, found: Column, base: Column) -> Column:
        if not self.trees:
            return F.filter(base, lambda s: F.lit(False))

        def wanted(c: Column) -> Column:
            least = F.lit(2.0)
            for k, t in self.thresholds.items():
                least = F.when(c["kind_no"] == k, F.lit(t)).otherwise(least)
            free = ~F.exists(base, lambda s: (s["start"] < c["stop"]) & (c["start"] < s["stop"]))
            return free & (self.probability(c) >= least)

        return F.transform(
            F.filter(found, wanted), lambda c: F.struct(c["start"].alias("start"), c["kind_no"].alias("kind"), c["stop"].alias("stop"))
        )


def _read_tree(node):
    """A tree of the fitted model as nested tuples."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _read_tree(node.leftChild()), _read_tree(node.rightChild())


def unmarked(kind: Column, value: Column, way: Column) -> Column:
    """A span of a kind without the mark that its base pattern needs; ``way`` is 0, 1 or 2."""
    digits = _digits(value)
    national = F.regexp_replace(value, r"^\+[0-9]{1,3}[ .-]+|^\+[0-9]", "")

    def one_of(*ways: Column) -> Column:
        return F.when(way == 0, ways[0]).when(way == 1, ways[1]).otherwise(ways[2])

    def fours(between: str) -> Column:
        return F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", f"$1{between}")

    phone = one_of(
        national,
        F.concat(F.lit("0"), F.regexp_replace(national, "[()]", "")),
        F.regexp_replace(F.regexp_replace(national, "^[^0-9]+", ""), "[^0-9]+", "."),
    )
    of = {
        "email": F.regexp_replace(value, r"(@[A-Za-z0-9-]+)\..*$", "$1"),
        "ip": F.regexp_replace(value, r"(?<!\[)\.", "[.]"),
        "card": one_of(fours("."), fours("  "), fours(" -")),
        "phone": phone,
    }
    return F.element_at(F.array(*[of[k] for k in KINDS]), kind + 1)


def _meets(base: Column, c: Column) -> Column:
    """Whether a candidate overlaps a base span of its own kind."""
    return F.exists(base, lambda s: (s["kind"] == c["kind_no"]) & (s["start"] < c["stop"]) & (c["start"] < s["stop"]))


def labelled(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Features, label and half (``fits``) of every candidate of every document: as they are, and without the marks.

    One pass over the texts, which are not kept: each span goes on with the characters around it.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    fits = F.pmod(F.crc32(F.coalesce(F.col(id).cast("string"), F.lit(""))), F.lit(2)) == 0
    rows = once(docs.select(fits.alias("fits"), whole.alias("text")), base=base_spans(F.col("text")), found=candidates(F.col("text")))
    names = ["kind_no", *FEATURES]
    kept = f"struct<kind_no:int,{','.join(f'{f}:double' for f in FEATURES)}>"

    def unit(s: Column, kind: Column, label: float, plain: Column) -> Column:
        first = F.greatest(F.lit(0), s["start"] - AROUND)
        return F.struct(
            F.lit(label).alias("label"), kind.alias("kind"), plain.cast(kept).alias("plain"),
            F.substring("text", first + 1, s["start"] - first).alias("before"),
            F.substring("text", s["start"] + 1, s["stop"] - s["start"]).alias("value"),
            F.substring("text", s["stop"] + 1, F.lit(AROUND)).alias("after"),
        )

    hits = F.transform("base", lambda s: unit(s, s["kind"], 1.0, F.lit(None)))
    others = F.filter("found", lambda c: ~_meets(F.col("base"), c))
    misses = F.transform(others, lambda c: unit(c, c["kind_no"], 0.0, F.struct(*[c[n].alias(n) for n in names])))
    units = rows.select("fits", F.explode(F.concat(hits, misses)).alias("u")).select("fits", "u.*")
    way = F.pmod(F.xxhash64("value"), F.lit(3))
    units = once(units, bare=unmarked(F.col("kind"), F.col("value"), way))
    units = once(units, shown=candidates(F.concat("before", "bare", "after")))
    start = F.length("before")
    # what is of one kind is of no other; of a miss only its own kind is known
    exact = F.filter(
        "shown",
        lambda c: (c["start"] == start) & (c["stop"] == start + F.length("bare")) & ((F.col("label") == 1) | (c["kind_no"] == F.col("kind"))),
    )
    label = lambda c: F.when(c["kind_no"] == F.col("kind"), F.col("label")).otherwise(0.0)
    row = f"array<struct<label:double,c:{kept}>>"
    shown = F.transform(exact, lambda c: F.struct(label(c).alias("label"), F.struct(*[c[n].alias(n) for n in names]).alias("c")))
    plain = F.when(F.col("plain").isNotNull(), F.array(F.struct(F.lit(0.0).alias("label"), F.col("plain").alias("c"))))
    every = F.concat(F.coalesce(plain.cast(row), F.array().cast(row)), shown.cast(row))
    return units.select("fits", F.inline(every)).select("fits", "label", "c.*")


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text") -> Judge:
    """Trees and thresholds from the candidates of all documents, half of them each; equal rows count each.

    Candidates of equal features and label are one row with their number as its weight.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = labelled(docs, id, text).groupBy("fits", "kind_no", *FEATURES, "label").agg(F.count("*").cast("double").alias("n"))
    rows = materialize(rows, "pii-candidates")
    fits = rows.where("fits")
    different = {r.label: r.n for r in fits.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if different.keys() != {0.0, 1.0}:
        return Judge([], [], {})
    total = sum(different.values())
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    # up to two parts the sums of the trees have one order, and the trees are the same each time
    dealt = fits.repartition(-(-total // PART), *FEATURES, "label").sortWithinPartitions(*FEATURES, "label")
    # MLlib takes its split points from a sample, except of tables of up to the square of the bins
    bins = max(32, math.isqrt(total) + 1)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=bins, weightCol="n", seed=7).fit(assemble.transform(dealt))
    trees = [_read_tree(t._call_java("rootNode")) for t in model.trees]
    scored = model.transform(assemble.transform(rows.where("NOT fits")))
    scored = scored.select("kind_no", "label", "n", vector_to_array("probability")[1].alias("p"))
    # candidates of equal probability are taken or left together
    level = scored.groupBy("kind_no", "p").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n"))
    down = Window.partitionBy("kind_no").orderBy(F.desc("p"))
    level = level.withColumn("precision", F.sum("good").over(down) / F.sum("n").over(down))
    level = level.withColumn("wrong", F.sum(F.col("n") - F.col("good")).over(Window.partitionBy("kind_no")))
    least = level.where((F.col("precision") >= PRECISION) & (F.col("wrong") > 0)).groupBy("kind_no").agg(F.min("p").alias("p")).collect()
    return Judge(trees, list(model.treeWeights), {r.kind_no: r.p for r in least})


def mark(docs: DataFrame, judge: Judge, into: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``into`` of base and spans, sorted arrays of (start, kind, stop)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base, found = (spare(docs, f"{into}_{x}") for x in ("base", "found"))
    rows = docs.withColumn(base, base_spans(whole)).withColumn(found, candidates(whole))
    every = F.array_sort(F.array_union(F.col(base), judge.added(F.col(found), F.col(base))))
    return rows.select(*docs.columns, F.struct(F.col(base).alias("base"), every.alias("spans")).alias(into))


def named(found: Column) -> Column:
    """Spans as kind:start:stop."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.transform(found, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["stop"].cast("string")))


def redacted(text: Column, found: Column) -> Column:
    """The text with each run of overlapping spans replaced by the kind of its first, in brackets."""
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")

    def join(runs: Column, s: Column) -> Column:
        last = F.element_at(runs, -1)
        wider = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        grown = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(wider))
        return F.when((F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["stop"] > s["start"]), grown).otherwise(F.concat(runs, F.array(s)))

    runs = F.aggregate(found, none, lambda a, s: join(a, s))

    def build(runs: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(runs, lambda s: s["stop"]))
        parts = F.transform(
            runs, lambda s, i: F.concat(F.substring(text, begins[i] + 1, s["start"] - begins[i]), kinds[s["kind"]])
        )
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(begins, -1) + 1, F.length(text)))

    return F.when(F.size(found) > 0, F.transform(F.array(runs), build)[0]).otherwise(text)


def query(spark, sf_dir: str) -> DataFrame:
    """Base and added spans of every document."""
    from flowguard.llm.common import documents

    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = mark(docs, fit(docs), "found")
    base, every = F.col("found.base"), F.col("found.spans")

    def count(k: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return found.select("doc_id", *[count(k) for k in range(len(KINDS))], digest_of(named(base)).alias("base_sha256"), F.array_join(named(every), ",").alias("spans"))
