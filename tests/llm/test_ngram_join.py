import random
import re

import numpy as np
import pytest

from verdictframe.llm import ngram_join, textops


def sets_of(rows, k=4):
    out = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) if x]
        out.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute(rows, percent=85, k=4):
    sets, root, links = sets_of(rows, k), list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    groups = {}
    for a in range(len(rows)):
        groups.setdefault(find(a), []).append(rows[a][0])
    return {rows[a][0]: (len(sets[a]), min(groups[find(a)]), links[a]) for a in range(len(rows))}


def corpus(seed):
    rng = random.Random(seed)
    words, rows = [f"w{i}" for i in range(300)], []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 10, 60, 200]))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "One"), (5004, "one")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [(4096, 2048), (5, 6)])
def test_against_all_pairs(docs_of, monkeypatch, parts):
    """Also with lists and blocks cut into many parts."""
    monkeypatch.setattr(ngram_join, "LIST_PART", parts[0])
    monkeypatch.setattr(ngram_join, "BLOCK_PART", parts[1])
    rows = corpus(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.jaccard_components(docs_of(rows), words=4, percent=85).collect()}
    assert got == brute(rows)


def test_other_parameters(docs_of):
    """The defaults: five words, 80 percent."""
    rows = corpus(6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.jaccard_components(docs_of(rows)).collect()}
    assert got == brute(rows, 80, 5)


def test_divide_skip_equals_all_overlaps():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = []
    for k in range(160):  # long lists, so that some are set aside
        keep = rng.random(300) > 0.03
        own = rng.integers(0, 2**63, int(rng.integers(0, 20)), dtype=np.uint64)
        sets.append(np.unique(np.concatenate([base[keep], own])))
    got = {(x, int(y)) for x, ys in ngram_join.divide_skip(sets, 85) for y in ys}
    want = set()
    for x in range(len(sets)):
        for y in range(x):
            common = len(np.intersect1d(sets[x], sets[y]))
            if 100 * common >= 85 * (len(sets[x]) + len(sets[y]) - common):
                want.add((x, y))
    assert got == want and want


def test_hot_shingles_and_one_large_group(docs_of):
    """Half of all rows share a passage, a third are copies of one text."""
    rng = random.Random(7)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, passage + " " + " ".join(f"u{k}x{j}" for j in range(60))) for k in range(120)]
    copy = " ".join(f"c{j}" for j in range(90))
    rows += [(1000 + k, copy) for k in range(80)] + [(2000 + k, copy + f" tail{rng.randrange(9)}") for k in range(20)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.jaccard_components(docs_of(rows), words=4, percent=85).collect()}
    assert got == brute(rows)


def test_defined_results(docs_of):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(7, text), (3, text), (3, text), (None, text), (9, None), (10, ""), (None, "alone here now then"), (3, "another text altogether here")]
    out = ngram_join.jaccard_components(docs_of(rows, extra=True), words=4, percent=85).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["n_links"]) for r in out) == sorted(
        [(7, 47, 3, 3), (3, 47, 3, 3), (3, 47, 3, 3), (-1, 47, 3, 3), (9, 0, 9, 0), (10, 0, 10, 0), (-1, 1, -1, 0), (3, 1, 3, 0)])
    kept = ngram_join.representatives(docs_of(rows, extra=True))
    assert kept.columns == docs_of(rows, extra=True).columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == sorted(
        [(3, text), (9, ""), (10, ""), (-1, "alone here now then"), (3, "another text altogether here")])
    assert ngram_join.jaccard_components(docs_of([])).count() == 0
    assert ngram_join.representatives(docs_of([(1, None)])).count() == 1


def test_word_hashes_do_not_depend_on_the_cut(monkeypatch):
    text = ("Some WORDS, é\tand more\x0b " * 500).encode()
    data = np.frombuffer(text, dtype=np.uint8)
    bounds = np.array([0, len(data)])
    whole = next(textops.hashed_runs(data, bounds, textops.SPACES, textops.ascii_lower))[2]
    monkeypatch.setattr(textops, "PIECE", 64)
    cut = next(textops.hashed_runs(data, bounds, textops.SPACES, textops.ascii_lower))[2]
    assert (whole == cut).all() and len(whole) == len(text.decode().split())


@pytest.mark.parametrize("percent", [30, 45])
def test_sets_of_very_unequal_size(docs_of, percent):
    """Below 50 percent linked sets may differ in size by more than a factor of two."""
    words = [f"w{k}" for k in range(9_000)]
    rows = [(1, " ".join(words[:2_050])), (2, " ".join(words[:4_200])), (3, " ".join(words[5_000:])), (4, " ".join(words[:6_500])), (5, "w1 w2")]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs_of(rows), words=2, percent=percent).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}


def test_many_texts_under_one_id(docs_of):
    texts = [" ".join(f"a{k}x{j}" for j in range(30)) for k in range(20)]
    rows = [(7, t) for t in texts] + [(7, t + " more") for t in texts[:10]] + [(None, t + " tail") for t in texts[10:]]
    got = ngram_join.jaccard_components(docs_of(rows), words=2, percent=80).collect()
    assert len(got) == 40 and sum(r["n_links"] for r in got) == 40
