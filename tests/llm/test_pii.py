import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from verdictframe.llm import pii

PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for place, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            hit, digits = m.group(), re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in hit.split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), place, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def check(rows):
    for r in rows:
        want = base(r["text"] or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), r["text"][:100]
        for kind, _ in PLAIN:
            assert r[f"n_{kind}"] == want.count(kind + ":")
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


def test_base_spans_on_random_texts(docs_of):
    rng = random.Random(4)
    texts = ["".join(rng.choice("a1.@+- (2)b%é\n3_😀") for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    texts += ["x@y.z_w@q.r", "4111 1111 1111 1111 and +49 (30) 1234-5678, 1.2.3.4.5.6.7.8 255.255.255.256 0255.1.1.1"]
    check(pii.find(docs_of(list(enumerate(texts))), None).collect())


def test_very_long_runs(docs_of):
    texts = ["1" * 50_000, "+1" + " " * 20_000, "a@b" + ".c" * 30_000, "ab" * 40_000 + "@x.y", "1.2.3.4 " * 3_000, "4111111111111111 a@b.co " * 2_000]
    check(pii.find(docs_of(list(enumerate(texts))), None).collect())


@pytest.fixture(scope="module")
def forest(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_trees_add_secrets_and_keep_precision(spark, forest):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = pii.find(docs, forest).collect()
    check(rows)
    assigned = re.compile(r'token = "([0-9a-f]{40})"')
    planted = found = 0
    for r in rows:
        for m in assigned.finditer(r["text"]):
            planted += 1
            found += f"secret:{m.start(1)}:{m.end(1)}" in r["spans"].split(",")
    assert planted and found >= 0.95 * planted
    added = sum(len([s for s in r["spans"].split(",") if s.split(":")[0] in pii.GENERATORS]) for r in rows)
    assert found >= 0.8 * added


def test_expression_equals_the_model(spark):
    """The trees as SQL give the probability of MLlib's own model."""
    rows = pii.training_rows(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).cache()
    model = pii.fitted(rows)
    forest = pii.calibrated(rows, model)
    both = model.transform(rows).select("probability", forest.probability(F.struct(*pii.FEATURES)).alias("p")).collect()
    assert len(both) > 500 and max(abs(r["probability"][1] - r["p"]) for r in both) < 1e-9


def test_trees_do_not_see_the_labels(spark):
    assert not set(pii.FEATURES) & {*pii.EVIDENCE, "luhn"}
    rows = pii.training_rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    sides = rows.select("_id", "held").distinct().groupBy("_id").count().filter("count > 1")
    assert sides.count() == 0


def planted_texts(rng, count):
    """Texts with one planted thing each and texts without; (text, kind or None)."""
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    token = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    make = {
        "email": lambda: f"{word()}.{digits(2)}@{word()}.com", "ip": lambda: "10.{}.{}.7".format(rng.randint(1, 255), rng.randint(1, 255)),
        "phone": lambda: f"+1 (555) 555-{digits(4)}", "card": lambda: "4111 1111 1111 1111",
        "number": lambda: f"tel 555-{digits(3)}-{digits(4)}" if rng.random() < 0.9 else f"555-{digits(3)}-{digits(4)}",
        "address": lambda: f"{word()}é@{word()}ß.de", "secret": lambda: f'token = "{token(40)}"' if rng.random() < 0.95 else f'"{token(40)}"',
        None: lambda: rng.choice([f"build {digits(9)}", f"in {digits(4)}", word(), f"@{word()}", f"{digits(3)}.{digits(2)}"]),
    }
    kinds = list(make)
    out = []
    for k in range(count):
        kind = kinds[k % len(kinds)]
        out.append((" ".join([word() for _ in range(5)] + [make[kind]()] + [word() for _ in range(5)]), kind))
    return out


def test_precision_and_recall_of_every_kind(docs_of):
    """Fitted on some documents, judged on others; things that nothing names are found by their format."""
    rng = random.Random(12)
    planted = planted_texts(rng, 2400)
    docs = docs_of([(k, t) for k, (t, _) in enumerate(planted[:1600])])
    forest = pii.train(docs)
    rows = pii.find(docs_of([(k, t) for k, (t, _) in enumerate(planted[1600:])]), forest).collect()
    hit, there, named = {}, {}, {}
    for r in rows:
        kind = planted[1600 + r["doc_id"]][1]
        found = {x.split(":")[0] for x in r["spans"].split(",") if x}
        assert r["personal"] == bool(found)
        there[kind] = there.get(kind, 0) + 1
        hit[kind] = hit.get(kind, 0) + (kind in found)
        for f in found:
            named.setdefault(f, []).append(f == kind)
    for kind in pii.ALL_KINDS:
        assert hit[kind] >= 0.9 * there[kind], (kind, hit[kind], there[kind])
        assert sum(named[kind]) >= 0.95 * len(named[kind]), kind
    clean = [r for r in rows if planted[1600 + r["doc_id"]][1] is None]
    assert sum(r["personal"] for r in clean) <= 0.02 * len(clean)


def test_defined_results(docs_of, forest):
    rows = [(1, None), (2, ""), (3, "a@b.co"), (3, "a@b.co"), (None, "call +1 (234) 567-8901 now")]
    out = pii.find(docs_of(rows, extra=True), forest).collect()
    check(out)
    assert len(out) == 5 and all(r["base"] == "own base" for r in out)
    assert pii.find(docs_of([]), forest).count() == 0
    assert pii.train(docs_of([(1, "nothing here"), (2, None)])) is None


def test_no_python_in_the_plan(spark, forest):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = pii.find(docs, forest)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_generators_have_no_length_cap(docs_of):
    secret, number, address = "a1" * 171, "1234567890" * 4, "u" * 300 + "@" + "h" * 300
    texts = [f'token = "{secret}"', f"no {number} here", f"to {address} now", "1 2 3 4 5 6 7x 8", "(" * 30_000 + "1 " * 10_000 + "x@"]
    rows = docs_of(list(enumerate(texts))).select("doc_id", F.col("text").alias("_text"))
    out = {r["doc_id"]: [(pii.ALL_KINDS[c["place"]], texts[r["doc_id"]][c["start"] : c["end"]]) for c in r["candidates"]] for r in pii.candidate_spans(rows).collect()}
    assert [out[k] for k in range(4)] == [[("secret", secret)], [("number", number)], [("address", address)], []]


def test_local_numbers_can_be_added(docs_of):
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    local = [f"tel 555-{digits(3)}-{digits(4)} soon" for _ in range(150)]
    docs = docs_of(list(enumerate(local + [f"build {digits(9)} done" for _ in range(150)])))
    rows = pii.find(docs, pii.train(docs)).collect()
    added = [bool(re.fullmatch(r"number:4:16", r["spans"])) for r in sorted(rows, key=lambda r: r["doc_id"])]
    assert all(added[:150]) and not any(r["spans"] for r in rows if r["doc_id"] >= 150)


def test_every_candidate_counts(docs_of):
    """Trees and thresholds come from all candidates, equal ones weighted, not from some of them."""
    docs = docs_of([(k, " ".join(f"no {10**8 + 300 * k + i}" for i in range(300))) for k in range(100)])
    rows = pii.training_rows(docs)
    assert rows.count() == 30_000
    cells = pii.counted(rows)
    assert cells.count() < 3_000 and cells.agg(F.sum("weight")).first()[0] == 30_000


def test_patterns_run_once_per_document(docs_of):
    """No filter below the candidates' explode repeats the patterns that find them."""
    plan = pii.counted(pii.training_rows(docs_of([(1, "no 123456789")])))._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if re.search(r"[-\s]Filter\b", x) and "regexp_extract_all" in x]
