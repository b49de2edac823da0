"""Personal data by base patterns and a gradient-boosted choice among further candidates.

Base spans (email, ip, card, phone) follow fixed patterns and checks and always stay.
High-recall generators propose more: digit groups, ``x@y`` words and mixed tokens, which may
overlap one another and base spans. Each candidate is described by its format and the marks around
it; boosted trees, trained on the candidates of all documents but those held out, give it a probability, and a threshold
for each kind selects. A chosen candidate that overlaps a base span or an earlier, likelier candidate is dropped.

The labels come from evidence that the trees never see: a base span, with its checks, overlaps the candidate, a word before it
names its kind (``tel``, ``token =``), or it has a known key's prefix, a local phone number's grouping or letters of
an address. So the trees learn the formats of named things and find them where nothing names them. A fifth of the
documents is held out of the fit. On all its candidates that overlap no base span, as only they can be added, each kind gets the
lowest threshold with a precision of ``PRECISION``; a kind that never reaches it adds nothing. Things that nothing
names count as wrong there, so the true precision is higher. No generator bounds the length.

All of it is row-local SQL: a text is split at the matches of a pattern, and the running lengths of
parts and matches give the positions in code points; the trees are one expression.

Defined results: null text is empty; empty text has no spans; repeated rows are handled alike; with no candidates of both
labels in the fit nothing is added; ties of probability go to the earlier, then the longer span; added columns replace
columns of their name. Patterns use possessive repeats and never backtrack over a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Base patterns: same matches as the plain ones, without backtracking.
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that every text with a match passes.
HINT = {"email": "@", "phone": "+"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Generators of candidates, in the order of their kinds behind the base kinds.
GENERATORS = {
    "number": r"(?<![0-9A-Za-z])[0-9]++(?![A-Za-z])(?:[\x20().-]{1,2}[0-9]++(?![A-Za-z]))*+",
    # up to the last bracket or quote, after a quote, or over all if a bracket or quote is right before the @
    "address": (
        r"(?:(?<![^\x20\x09-\x0D<(\[\x22])[^\x20\x09-\x0D@<>(\[\x22]++|(?<=')[^\x20\x09-\x0D@<>(\[\x22']++"
        r"|(?<![^\x20\x09-\x0D<])[^\x20\x09-\x0D@<>]++(?<=[(\[\x22]))@[^\x20\x09-\x0D@<>]++"
    ),
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{16,}+",
}
GENERATOR_HINT = {"address": "@"}
ALL_KINDS = (*KINDS, *GENERATORS)
ASSIGNED = r"(?i)(?:token|key|secret|passw(?:or)?d|pwd|auth|bearer)\s*[=:]?\s*[\x22']?$"
#: Evidence besides base spans, by kind: words before a candidate, and formats of its own.
NAMED = {
    "number": r"(?i)(?<![a-z])(?:phone|tel|telephone|mobile|cell|fax|call|ssn|social security|passport|iban|account|acct)(?:\s*(?:no|number|nr)\b)?[\s.:#=(\x22']*$",
    "address": r"(?i)(?<![a-z])(?:e-?mail|mail|mailto|contact|write to)(?:\s+(?:address|at|me|us|is))?[\s:=<(\x22']*$",
    "secret": ASSIGNED,
}
FORMED = {
    "number": r"^(?:[0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})$",
    "address": r"^[\p{L}\p{N}._%+'-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+[.,;:!?)\]\x22']*$",
    "secret": r"^(?:AKIA[0-9A-Z]{16}$|gh[pousr]_|glpat-|sk[-_]|xox[abprs]-|AIza|eyJ)",
}
#: Digits from which a group of digits is a candidate.
NUMBER_DIGITS = 7
#: Characters before a candidate that are looked at.
CONTEXT = 24
#: Precision to reach, thresholds that are tried.
PRECISION = 0.95
STEPS = [0.5 + k / 40 for k in range(20)]
SUM_BLOCK = 256

FEATURES = (
    "kind", "size", "digits", "letters", "upper", "marks", "dots", "spaces", "groups", "plus", "at", "distinct",
    "before_word", "before_colon", "before_quote", "before_digit", "before_line",
)
#: Evidence that labels candidates and is no input of the trees.
EVIDENCE = ("named", "formed")


def luhn(digits: Column) -> Column:
    """Whether a short string of digits passes the Luhn check."""
    places = F.sequence(F.lit(0), F.length(digits) - 1)
    code = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(places, F.lit(0), lambda a, i: a + F.when(i % 2 == 0, code(i)).otherwise(doubled(code(i))))
    return total % 10 == 0


def only(text: Column, kept: str) -> Column:
    return F.regexp_replace(text, f"[^{kept}]", "")


def passes(kind: str, hit: Column) -> Column:
    """The check behind a base pattern."""
    if kind == "ip":
        return hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    digits = only(hit, "0-9")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def running(lengths: Column) -> Column:
    """Sums of all elements before each; block sums keep it short for long arrays."""
    block = F.lit(SUM_BLOCK)
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / SUM_BLOCK).cast("int")),
        lambda b: total(F.slice(lengths, b * block + 1, block)),
    )
    return F.transform(
        lengths,
        lambda _, i: total(F.slice(blocks, F.lit(1), F.floor(i / SUM_BLOCK).cast("int")))
        + total(F.slice(lengths, (F.floor(i / SUM_BLOCK) * SUM_BLOCK).cast("int") + 1, i % SUM_BLOCK)),
    )


def with_matches(rows: DataFrame, name: str, pattern: str, hint: str | None) -> DataFrame:
    """Adds ``name``: array of struct<start, end, hit, before> of the matches in ``_text``."""
    there = F.col("_text").rlike(pattern)
    if hint:
        there = F.contains(F.col("_text"), F.lit(hint)) & there
    parts, hits, steps, sums = (f"{name}_{x}" for x in ("parts", "hits", "steps", "sums"))
    rows = rows.withColumn(f"{name}_there", there)
    rows = rows.withColumns({
        parts: F.when(F.col(f"{name}_there"), F.split("_text", pattern, -1)),
        hits: F.when(F.col(f"{name}_there"), F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))),
    })
    # element i: the part before match i and the match
    rows = rows.withColumn(steps, F.zip_with(F.slice(F.col(parts), F.lit(1), F.size(hits)), F.col(hits), lambda p, h: F.length(p) + F.length(h)))
    rows = rows.withColumn(sums, F.when(F.col(f"{name}_there"), running(F.col(steps))))
    spans = F.transform(
        F.col(hits),
        lambda h, i: F.struct(
            (F.element_at(F.col(sums), i + 1) + F.length(F.element_at(F.col(parts), i + 1))).alias("start"),
            (F.element_at(F.col(sums), i + 1) + F.element_at(F.col(steps), i + 1)).alias("end"),
            h.alias("hit"),
            F.right(F.element_at(F.col(parts), i + 1), F.lit(CONTEXT)).alias("before"),
        ),
    )
    empty = F.array().cast("array<struct<start: int, end: int, hit: string, before: string>>")
    rows = rows.withColumn(name, F.coalesce(spans, empty))
    return rows.drop(f"{name}_there", parts, hits, steps, sums)


def checked(matches: Column, kind: str, place: int) -> Column:
    """Spans of the matches that pass the check of their kind."""
    good = F.filter(matches, lambda s: passes(kind, s["hit"]))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end")))


def base_spans(rows: DataFrame) -> DataFrame:
    """Adds ``base``: array of struct<start, place, end>, sorted; place is the number of the kind."""
    found = []
    for place, kind in enumerate(KINDS):
        rows = with_matches(rows, f"_{kind}", BASE[kind], HINT.get(kind))
        found.append(checked(F.col(f"_{kind}"), kind, place))
    rows = rows.withColumn("base", F.array_sort(F.concat(*found)))
    return rows.drop(*[f"_{k}" for k in KINDS])


def described(place: int, span: Column) -> Column:
    """Candidate with its features and the evidence for its label."""
    hit, before, kind = span["hit"], span["before"], ALL_KINDS[place]
    values = {
        "kind": F.lit(float(place)), "size": F.length(hit), "digits": F.length(only(hit, "0-9")), "letters": F.length(only(hit, "A-Za-z")),
        "upper": F.length(only(hit, "A-Z")), "marks": F.length(only(hit, "().+/_=%-")), "dots": F.length(only(hit, ".")),
        "spaces": F.length(only(hit, " ")), "groups": F.size(F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0))),
        "plus": F.endswith(before, F.lit("+")).cast("int"), "at": F.length(only(hit, "@")),
        "distinct": F.size(F.array_distinct(F.split(hit, ""))),
        "before_word": before.rlike(r"(?i)[a-z]$").cast("int"), "before_colon": before.rlike(r"[:=]\s*[\x22']?$").cast("int"),
        "before_quote": before.rlike(r"[\x22']$").cast("int"), "before_digit": before.rlike(r"[0-9][\s.,-]*$").cast("int"),
        "before_line": before.rlike(r"(?:^|\n)[\x20\t]*$").cast("int"),
        "named": before.rlike(NAMED[kind]).cast("int"), "formed": hit.rlike(FORMED[kind]).cast("int"),
    }
    return F.struct(
        span["start"].alias("start"), F.lit(place).alias("place"), span["end"].alias("end"),
        *[F.coalesce(values[f].cast("double"), F.lit(0.0)).alias(f) for f in (*FEATURES, *EVIDENCE)],
    )


def all_described(matches: Column, place: int) -> Column:
    return F.transform(matches, lambda s: described(place, s))


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))


def candidate_spans(rows: DataFrame) -> DataFrame:
    """Adds ``candidates``: the proposals of all generators with features."""
    found = []
    for place, kind in enumerate(GENERATORS, len(KINDS)):
        rows = with_matches(rows, f"_{kind}", GENERATORS[kind], GENERATOR_HINT.get(kind))
        matches = F.col(f"_{kind}")
        if kind == "number":
            matches = F.filter(matches, lambda s: F.length(only(s["hit"], "0-9")) >= NUMBER_DIGITS)
        found.append(all_described(matches, place))
    return rows.withColumn("candidates", F.concat(*found)).drop(*[f"_{k}" for k in GENERATORS])


class Forest:
    """Boosted trees as plain tuples, (feature, threshold, left, right) or a leaf value, and a threshold per kind."""

    def __init__(self, trees: list, weights: list[float], thresholds: dict[str, float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def selects(self, place: Column, probability: Column) -> Column:
        """Whether the probability reaches the threshold of the candidate's kind; above 1 it never does."""
        wanted = F.lit(2.0)
        for kind, threshold in self.thresholds.items():
            wanted = F.when(place == ALL_KINDS.index(kind), F.lit(threshold)).otherwise(wanted)
        return probability >= wanted

    def probability(self, candidate: Column) -> Column:
        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            feature, cut, left, right = node
            return F.when(candidate[FEATURES[feature]] <= cut, walk(left)).otherwise(walk(right))

        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights):
            total = total + F.lit(weight) * walk(tree)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-2.0 * total))


def unpacked(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), unpacked(node.leftChild()), unpacked(node.rightChild())


def training_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Candidates of all documents: label, free (no base span), held (out of the fit), features."""
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # From a plain explode Spark infers a filter below it, which repeats all patterns of the candidates many times per document.
    rows = candidate_spans(base_spans(rows)).select("_id", "base", F.explode_outer("candidates").alias("c")).filter("c is not null")
    base = overlaps(F.col("c"), F.col("base"))
    label = base
    for e in EVIDENCE:
        label = label | (F.col(f"c.{e}") > 0)
    rows = rows.select("_id", label.cast("double").alias("label"), (~base).alias("free"), *[F.col(f"c.{f}").alias(f) for f in FEATURES])
    # documents without an id are not held out
    rows = rows.withColumn("held", F.coalesce(F.crc32(F.col("_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))
    return assembled(rows.withColumn("weight", F.lit(1.0)))


def assembled(rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def counted(rows: DataFrame) -> DataFrame:
    """Equal candidates as one row with their number as weight: the same fit and the same counts from far fewer rows."""
    return assembled(rows.groupBy("label", "free", "held", *FEATURES).agg(F.sum("weight").alias("weight")))


def fitted(rows: DataFrame):
    """MLlib's model of the rows in the fit; None without both labels."""
    from pyspark.ml.classification import GBTClassifier

    used = rows.filter("not held")
    seen = {r["label"] for r in used.select("label").distinct().collect()}
    model = GBTClassifier(labelCol="label", weightCol="weight", maxIter=12, maxDepth=3, seed=7)
    return model.fit(used) if len(seen) > 1 else None


def calibrated(rows: DataFrame, model) -> Forest:
    """The model's trees with the lowest threshold of each kind that keeps the precision on held-out, free candidates."""
    forest = Forest([unpacked(t._call_java("rootNode")) for t in model.trees], list(model.treeWeights), {})
    scored = rows.filter("held and free").select("kind", "label", "weight", forest.probability(F.struct(*FEATURES)).alias("p"))
    sums = scored.groupBy("kind").agg(*[x for k, t in enumerate(STEPS) for x in (
        F.sum(F.when(F.col("p") >= t, F.col("label") * F.col("weight"))).alias(f"hit{k}"), F.sum(F.when(F.col("p") >= t, F.col("weight"))).alias(f"all{k}"))])
    for row in sums.collect():  # one per kind
        good = [t for k, t in enumerate(STEPS) if row[f"all{k}"] and row[f"hit{k}"] >= PRECISION * row[f"all{k}"]]
        if good:
            forest.thresholds[ALL_KINDS[int(row["kind"])]] = good[0]
    return forest


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Forest | None:
    """Boosted trees and thresholds from the candidates of all documents."""
    rows = counted(training_rows(docs, key, text)).cache()
    model = fitted(rows)
    forest = calibrated(rows, model) if model else None
    rows.unpersist()
    return forest


def joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["place"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, forest: Forest | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the counts of base spans, base_sha256, spans (joined), found (array of spans) and personal (any span found)."""
    added = [*[f"n_{k}" for k in KINDS], "base_sha256", "spans", "found", "personal"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows = docs.select(*[docs[c].alias(f"_k{i}") for i, c in enumerate(keep)], F.coalesce(docs[text], F.lit("")).alias("_text"))
    rows = base_spans(rows)
    chosen = F.col("base")
    if forest is not None:
        rows = candidate_spans(rows)
        free = F.filter(F.col("candidates"), lambda c: ~overlaps(c, F.col("base")))
        scored = F.transform(free, lambda c: F.struct(
            (-forest.probability(c)).alias("minus"), c["start"].alias("start"), (-c["end"]).alias("last"), c["place"].alias("place"), c["end"].alias("end")))
        rows = rows.withColumn("_scored", scored)
        rows = rows.withColumn("_picked", F.filter("_scored", lambda c: forest.selects(c["place"], -c["minus"])))
        better = lambda o, c: F.struct(o["minus"], o["start"], o["last"], o["place"]) < F.struct(c["minus"], c["start"], c["last"], c["place"])
        alone = F.filter("_picked", lambda c: ~F.exists("_picked", lambda o: (o["start"] < c["end"]) & (c["start"] < o["end"]) & better(o, c)))
        more = F.transform(alone, lambda c: F.struct(c["start"].alias("start"), c["place"].alias("place"), c["end"].alias("end")))
        chosen = F.array_sort(F.concat("base", more))
    rows = rows.withColumn("found", chosen)
    count = lambda p: F.size(F.filter("base", lambda s: s["place"] == p)).cast("long")
    return rows.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *[count(p).alias(f"n_{k}") for p, k in enumerate(KINDS)],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), "found",
        (F.size("found") > 0).alias("personal"),
    )
