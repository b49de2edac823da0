import random
import re
from collections import Counter, defaultdict

import pytest

from verdictframe.llm import source_divergence as sd


def plainly(rows, least, top):
    """The audit by its definition, over Python dictionaries."""
    rows = [tuple(v or "" for v in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)) for _, _, t in rows]
    in_docs, n = defaultdict(Counter), defaultdict(Counter)
    for (lang, source, _), w in zip(rows, words):
        in_docs[lang].update(set(w))
        n[lang, source].update(w)
    out = set()
    for lang in {r[0] for r in rows}:
        kept = [t for t, c in in_docs[lang].items() if c >= least]
        sources = {r[1] for r in rows if r[0] == lang}

        def share(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: share(n[lang, s]) for s in sources}
        q = share(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda f: (-f[1], f[0].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:limit])}
    return out


def documents(spark, rows, parts=5):
    return spark.createDataFrame(rows, "lang string, source string, text string").repartition(parts)


def made_rows(seed, count=300):
    rng = random.Random(seed)
    words = ["the", "The", "of", "élan", "ÉLAN", "naïve", "x", "日本", "end-of", "it's", "a1b", "quark", "Zeta"] + [f"w{chr(97 + k % 26)}{'z' * (k // 26)}" for k in range(60)]
    rows = []
    for _ in range(count):
        source = f"s{min(int(rng.expovariate(0.6)), 9)}"
        lean = words[int(source[1:]) * 5 :] if rng.random() < 0.5 else words
        rows.append((rng.choice(["en", "en", "fr", "de"]), source, " ".join(rng.choice(lean) for _ in range(rng.randint(0, 40)))))
    return rows + [(None, None, None), ("en", None, "the of"), ("it", "s1", "uno due"), ("it", "s2", None), rows[0], rows[0]]


@pytest.mark.parametrize("side", [256, 3])
def test_equals_brute_force(spark, side):
    rows = made_rows(1)
    got = sd.audit(documents(spark, rows), least_docs=6, top=7, side=side).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == plainly(rows, 6, 7)


def test_many_small_runs_are_merged_in_levels(spark, monkeypatch):
    rows = made_rows(2)
    blocks = []
    monkeypatch.setattr(sd, "fewer_runs", lambda runs, groups, real=sd.fewer_runs: blocks.append(groups) or real(runs, groups))
    got = sd.audit(documents(spark, rows, 40), least_docs=6, top=7, fan_in=3)
    assert {tuple(r) for r in got.collect()} == plainly(rows, 6, 7)
    assert len(blocks) >= 2


def test_full_blocks_become_runs():
    import numpy as np

    block = sd.Block(4)
    text = " ".join(made_rows(3)[k][2] for k in range(100)).encode()
    data = np.frombuffer(text, dtype=np.uint8)
    block.add_texts(data, np.array([0, len(data) // 2, len(data)]), np.array([block.group("en", "a"), block.group("en", "b")]))
    row = [r for part in block.run(7) for r in part.to_pylist()]
    keys = [(r["shard"], t) for r in row for t in r["terms"]]
    assert keys == sorted(keys) and len(keys) == len(set(keys))
    assert all(r["run"] == 7 and r["first"] == r["terms"][0] and sum(r["sizes"]) == len(r["codes"]) for r in row)
    assert not block.held and not block.names


def test_blocks_spill_and_long_texts_count_once(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(sd.textops, "PIECE", 64)
    monkeypatch.setattr(sd, "TEXT_BYTES", 64)
    import numpy as np

    texts = [r[2] for r in made_rows(4, 200) if r[2]]
    block, runs = sd.Block(1), []
    for k, text in enumerate(texts):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        block.add_texts(data, np.array([0, len(data)]), np.array([block.group("en", "ab"[k % 2])]))
        if block.full():
            runs += list(block.run(k))
    runs += list(block.run(len(texts)))
    assert len(runs) > 5
    rows = sorted((r.slice(k, 1) for r in runs for k in range(r.num_rows)), key=lambda r: r.column(2)[0].as_py())
    found = {}

    def emit(shard, taken, names):
        terms, term, code, n, docs = taken
        for k in range(len(term)):
            assert (terms[term[k]], names[code[k]][1]) not in found
            found[terms[term[k]], names[code[k]][1]] = (n[k], docs[k])
        return iter(())

    list(sd.merge(iter(rows), emit))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, docs = Counter(), Counter()
    for k, text in enumerate(texts):
        w = [(t.encode(), "ab"[k % 2]) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))]
        n.update(w)
        docs.update(set(w))
    assert found == {k: (n[k], docs[k]) for k in n}


def test_empty_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    assert sd.audit(documents(spark, [])).count() == 0
    rows = made_rows(5, 100)
    docs = documents(spark, rows).withColumns({c: F.lit("own") for c in ("term", "n", "p", "total", "shard", "run", "item")})
    assert {tuple(r) for r in sd.audit(docs, least_docs=4).collect()} == plainly(rows, 4, 50)
