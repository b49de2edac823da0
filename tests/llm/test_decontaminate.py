import random

import numpy as np

from verdictframe.llm import decontaminate as dc
from verdictframe.llm.decontaminate import Index


def sentences(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


def items_and_docs(seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "btdkl" for b in "aeiou" for c in ("n", "st", "r", "")]
    items = [(k, " ".join(sentences(rng, words, rng.randint(5, 20)) for _ in range(rng.randint(1, 4)))) for k in range(60)]
    docs, truth = [], set()
    for d in range(120):
        text = [sentences(rng, words, rng.randint(8, 30)) for _ in range(rng.randint(1, 30))]
        for k in rng.sample(range(60), rng.choice([0, 0, 1, 2])):
            text.insert(rng.randint(0, len(text)), items[k][1].upper() if rng.random() < 0.3 else items[k][1])
            truth.add((d, k))
        docs.append((d, " ".join(text)))
    return items, docs, truth


def test_planted_items_are_found_and_clean_documents_stay(spark, docs_of):
    items, docs, truth = items_and_docs()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs_of(docs), bench).collect()}
    assert truth <= got
    # what else is found really holds the item's words and their order
    for d, k in got - truth:
        a, b = dc.words_of(docs[d][1]), dc.words_of(items[k][1])
        assert np.isin(dc.textops.shingles(b, 2), dc.textops.shingles(a, 2)).mean() >= dc.ORDER
    left = {r["doc_id"] for r in dc.clean(docs_of(docs, extra=True), bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in got}


def test_wand_equals_full_scoring(spark):
    items, docs, _ = items_and_docs(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    (ix,) = dc.build_index(bench)
    rng = np.random.default_rng(1)
    for _, text in docs[:40]:
        words = dc.words_of(text)
        start = int(rng.integers(0, max(1, len(words) - 64)))
        at, t = ix.lookup(words[start:start + 64])
        terms = np.unique(t)
        full = np.zeros(len(ix.item_of))
        for term in terms:
            cut = slice(ix.first[term], ix.first[term + 1])
            full[ix.docs[cut]] += ix.impact[cut]
        want = set(np.flatnonzero(full >= dc.THRESHOLD - 1e-9).tolist())
        blocks = np.unique(ix.docs // dc.BLOCK)
        assert {s for s, _ in ix.wand(terms, blocks)} == want
        # the first step keeps every block that holds a hit
        doc, passage, block = ix.survivors(at, t, np.array([0, len(words[start:start + 64])]))
        assert {s // dc.BLOCK for s in want} <= set(block[passage == 0].tolist())


def test_several_shards_give_the_same(spark, docs_of, monkeypatch):
    items, docs, _ = items_and_docs(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {(r["doc_id"], r["item_id"], round(r["score"], 9)) for r in dc.contaminated(docs_of(docs), bench).collect()}
    monkeypatch.setattr(dc, "SHARD", 20)
    assert len(dc.build_index(bench)) > 1
    assert {(r["doc_id"], r["item_id"], round(r["score"], 9)) for r in dc.contaminated(docs_of(docs), bench).collect()} == whole


def test_defined_results(spark, docs_of):
    item = "Which planet is the largest one of all the planets here? It is the fifth planet from the sun."
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "?!")], "item_id long, text string")
    rows = [(1, item), (1, item), (2, None), (3, ""), (None, "x " + item.lower()), (5, "Which planet is the largest one?"), (6, "word " * 50_000 + item)]
    got = [(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs_of(rows), bench).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (1, 1), (None, 1), (6, 1)], key=str)
    assert sorted(r["doc_id"] for r in dc.clean(docs_of(rows, extra=True), bench).collect()) == [2, 3, 5]
    assert dc.contaminated(docs_of([]), bench).count() == 0
    none = bench.limit(0)
    assert dc.contaminated(docs_of(rows), none).count() == 0 and dc.clean(docs_of(rows), none).count() == 7
    assert isinstance(dc.build_index(bench)[0], Index)


def test_items_with_changed_words_are_found(spark, docs_of):
    rng = random.Random(7)
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()
    filler = [w for r in bench for w in r["text"].split()]
    rows, truth = [], {}
    for k, (item, text) in enumerate((r["item_id"], r["text"]) for r in bench):
        words = text.split()
        for edits in (1, 2, 3):
            mine = list(words)
            for at in rng.sample(range(len(mine)), min(edits, len(mine))):
                mine[at] = f"changed{at}" + mine[at][-1] * (mine[at][-1] in ".!?")
            around = [" ".join(rng.choice(filler) for _ in range(60)) for _ in range(2)]
            truth[3 * k + edits] = item
            rows.append((3 * k + edits, f"{around[0]}. {' '.join(mine)} {around[1]}"))
    rows += [(1000 + k, " ".join(rng.choice(filler) for _ in range(200))) for k in range(100)]
    items = spark.createDataFrame([tuple(r) for r in bench], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs_of(rows), items).collect()}
    caught = sum(pair in got for pair in truth.items()) / len(truth)
    assert caught >= 0.9
    assert not [d for d, _ in got if d >= 1000]


def test_first_step_in_slices(spark, monkeypatch):
    items, docs, _ = items_and_docs(5)
    (ix,) = dc.build_index(spark.createDataFrame(items, "item_id long, text string"))
    texts = [dc.words_of(text) for _, text in docs] + [dc.words_of("")] * 2
    words, bounds = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    at, t = ix.lookup(words)
    whole = list(zip(*(c.tolist() for c in ix.survivors(at, t, bounds))))
    for size in (1, 50, 1000):
        monkeypatch.setattr(dc, "PAIRS_AT_ONCE", size)
        assert list(zip(*(c.tolist() for c in ix.survivors(at, t, bounds)))) == whole
    assert ix.survivors(at[:0], t[:0], bounds)[0].size == 0


def test_many_segments_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(3000)]
    weights = 1 / np.arange(1, 3001)
    weights /= weights.sum()
    texts = [" ".join(rng.choice(vocabulary, 32, p=weights)) for _ in range(20_000)]
    rows, items = [], []
    for k, text in enumerate(texts):
        items.append((k, k, text))
        words = np.unique(dc.words_of(text)).view(np.int64).tolist()
        rows += [{"item": k, "same": k, "part": 0, "term": w, "impact": 1 / len(words)} for w in words]
    ix = Index(rows, items)
    words = dc.words_of(" ".join(rng.choice(vocabulary, 40_000, p=weights)))
    at, t = ix.lookup(words)
    tracemalloc.start()
    doc, *_ = ix.survivors(at, t, np.array([0, len(words)]))
    assert len(doc) and tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
