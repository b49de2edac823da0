import hashlib
import random

import pytest

import corpus_pipeline
from verdictframe.llm import line_dedup, queries
from verdictframe.llm.shared import stored


def brute(rows, words):
    """Every run of that many words that occurs earlier loses its lines, by trying all runs."""
    seen, out = {}, {}
    for d, text in sorted(rows):
        lines = [(i, line, len(line.split())) for i, line in enumerate(text.split("\n")) if line.split()]
        gone = set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(x[2] for x in lines[i:j]) >= words:
                    key = tuple(x[1] for x in lines[i:j])
                    if seen.setdefault(key, (d, i)) < (d, i):
                        gone.update(range(lines[i][0], lines[j - 1][0] + 1))
        out[d] = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_runs(docs_of, seed):
    rng = random.Random(seed)
    lines = ["a", "b b", "c c c", "d", "e e", "f f f f", "", "  ", "g g"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14)))) for i in range(50)]
    rows += [(100 + i, rows[i][1]) for i in range(6)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(rows), min_words=6).collect()}
    assert got == brute(rows, 6)


def test_defined_results(docs_of):
    passage = " ".join(f"w{k}" for k in range(30))
    rows = [(1, f"one\n{passage}\nend"), (2, f"two\n{passage}"), (2, f"two\n{passage}"), (3, None), (4, ""), (5, passage), (None, "x"), (6, f"{passage}\n{passage}")]
    out = line_dedup.dedup_lines(docs_of(rows, extra=True)).collect()
    texts = sorted(((r["doc_id"] or 0, r["text"], r["lines_deleted"]) for r in out), key=str)
    assert texts == sorted([(1, f"one\n{passage}\nend", 0), (2, "two", 1), (2, "two", 1), (3, None, 0), (4, "", 0), (5, "", 1), (0, "x", 0), (6, "", 2)], key=str)
    assert all(r["d"] == "own d" and r["t"] == "own t" for r in out)
    assert line_dedup.dedup_lines(docs_of([])).count() == 0


def test_short_runs_stay(docs_of):
    rows = [(k, "a short line\nanother one") for k in range(5)]
    assert all(r["lines_deleted"] == 0 for r in line_dedup.dedup_lines(docs_of(rows)).collect())


def test_long_text(docs_of):
    line = " ".join(f"w{k}" for k in range(25))
    text = "\n".join(f"{line} {k}" for k in range(3_000))
    out = {r["doc_id"]: r["lines_deleted"] for r in line_dedup.dedup_lines(docs_of([(1, text), (2, text[: len(text) // 2])])).collect()}
    assert out[1] == 0 and out[2] >= 1_490


def test_queries_count_every_run(spark, docs_of, tmp_path):
    rng = random.Random(7)
    lines = ["a", "b b", "c c c", "d", "", " ", "a line of six words here", *(f"only {k}" for k in range(20))]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows.append((60, "b b\na"))
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows, 1)
    got = {r["doc_id"]: r["text_sha256"] for r in queries.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {d: hashlib.sha256(text.encode()).hexdigest() for d, text in want.items()}
    stage = corpus_pipeline.without_repeated_lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    left = {r["doc_id"]: r["text"] for r in stage.collect()}
    assert 60 not in left and all(text == want[d] for d, text in left.items())


def maximal_runs(rows):
    """{run: its places} of every repeated run that neither its next nor its previous line extends, by trying all runs."""
    places = {}
    texts = {d: [line for line in text.split("\n") if line.split()] for d, text in rows}
    for d, lines in texts.items():
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                places.setdefault(tuple(lines[i:j]), set()).add((d, i))

    def around(run, step):
        at = [(d, i + (len(run) if step > 0 else -1)) for d, i in places[run]]
        return [texts[d][i] if 0 <= i < len(texts[d]) else None for d, i in at]

    def extends(run, step):
        beside = around(run, step)
        return None not in beside and len(set(beside)) == 1

    return {run: at for run, at in places.items() if len(at) > 1 and not extends(run, 1) and not extends(run, -1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals_are_the_maximal_runs(docs_of, seed):
    rng = random.Random(seed)
    rows = [(i, "\n".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 12)))) for i in range(30)]
    rows += [(100 + i, rows[i][1] + "\nz\na\nb") for i in range(8)] + [(200, "\n".join("xyxyxyxxxx"))]
    first, numbers = line_dedup.repeated_lines(stored(line_dedup.line_rows(docs_of(rows), "doc_id", "text"), "lines"))
    levels = line_dedup.ranked_runs(first)
    name = {r["n"]: r["d"] for r in numbers.collect()}
    lines = {d: [x for x in text.split("\n") if x] for d, text in rows}
    found, counted = {}, {}
    for r in line_dedup.intervals(levels).collect():
        run = tuple(lines[name[r["fn"]]][r["fl"] : r["fl"] + r["size"]])
        assert tuple(lines[name[r["n"]]][r["line"] : r["line"] + r["size"]]) == run
        found.setdefault(run, set()).add((name[r["n"]], r["line"]))
        counted[run] = r["copies"]
        assert min(found[run]) >= (name[r["fn"]], r["fl"])
    want = maximal_runs(rows)
    # intervals that a line in front extends may be there, too; every maximal run is, with all its copies counted
    assert set(want) <= {run for run, at in found.items() if len(at) > 1}
    assert all(counted[run] == len(at) for run, at in want.items())
    # the doubling goes on until no run of that many lines occurs twice
    longest = max(len(run) for run in want)
    assert 1 << (len(levels) - 1) <= longest < 1 << len(levels)
    # ranks of a level have the order of its runs
    for k, level in enumerate(levels):
        ranked = {}
        for r in level.collect():
            ranked.setdefault(r["r"], set()).add(tuple(lines[name[r["n"]]][r["line"] : r["line"] + (1 << k)]))
        assert all(len(runs) == 1 for runs in ranked.values())


def test_the_registered_query_doubles_to_the_end(spark, monkeypatch):
    levels = []
    monkeypatch.setattr(line_dedup, "ranked_runs", lambda first, real=line_dedup.ranked_runs: levels.append(real(first)) or levels[-1])
    out = queries.op5_line_dedup(spark, "/root/testdata/sf0.001").collect()
    longest = max(r["longest_run"] or 0 for r in out)
    assert len(levels) == 1 and 1 << (len(levels[0]) - 1) <= longest < 1 << len(levels[0])
    assert all((r["lines_deleted"] > 0) == (r["longest_run"] is not None) and (r["run_copies"] or 2) >= 2 for r in out)
