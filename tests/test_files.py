"""Files as files: scans, snapshots and new visual outputs."""

import hashlib
import os
from datetime import datetime, timedelta

from verdictframe.session import scratch_path
from verdictframe.sources import files


def put(root, name, content, age_days=0):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(content)
    if age_days:
        then = (datetime.now() - timedelta(days=age_days)).timestamp()
        os.utime(path, (then, then))


def folder(spark, name):
    path = scratch_path(spark, name).removeprefix("file:")
    os.makedirs(path)
    return path


def test_new_files_by_kind_and_content(spark):
    root, before = folder(spark, "run"), scratch_path(spark, "before")
    put(root, "old.png", b"old")
    put(root, "empty.html", b"")
    files.write_snapshot(spark, root, before)
    put(root, "a/b/c/plot.PNG", b"\x89PNG\x00\xff")
    put(root, "a/plot copy.jpg", b"\x89PNG\x00\xff")  # same bytes: the first path stays
    put(root, "page.htm", "né".encode())
    put(root, "notes.txt", b"notes")
    put(root, "notes.md", b"notes")  # not hidden by the text file
    put(root, "old2.svg", b"old")  # contents of an old file under a new name
    put(root, "blank.json", b"")  # no content: not listed
    rows = files.visual_outputs(spark, root, before, data=True).collect()
    got = {r["path"].split(root)[-1].replace("%20", " "): (r["kind"], r["data"]) for r in rows}
    assert got == {
        "/a/b/c/plot.PNG": ("png", "iVBORwD/"), "/page.htm": ("html", "né"), "/notes.md": ("markdown", "notes"),
        "/old2.svg": ("svg", "old"),
    }
    assert {r["digest"] for r in rows if r["kind"] == "svg"} == {hashlib.sha256(b"old").hexdigest()}


def test_changes_of_listings(spark):
    root, before = folder(spark, "listing"), scratch_path(spark, "listed")
    for name in ("same.js", "grown.js", "gone.js", "touched.js"):
        put(root, name, b"1", age_days=3)
    files.write_snapshot(spark, root, before)
    put(root, "grown.js", b"123", age_days=3)
    put(root, "touched.js", b"1", age_days=1)
    put(root, "new.js", b"1")
    os.rename(os.path.join(root, "gone.js"), os.path.join(root, "gone.bin"))
    found = files.changes(files.listing(spark, root), files.snapshot(spark, before)).collect()
    assert {r["path"].rsplit("/", 1)[1]: r["change"] for r in found} == {
        "grown.js": "changed", "touched.js": "changed", "new.js": "added", "gone.js": "removed"
    }


def test_the_reader_filters_names_and_times(spark):
    root = folder(spark, "filters")
    put(root, "old.gif", b"1", age_days=9)
    put(root, "young.gif", b"2")
    put(root, "big.bin", b"3" * 1000)
    since = datetime.now() - timedelta(days=1)
    young = files.file_scan(spark, root, since=since)
    assert [r["path"].rsplit("/", 1)[1] for r in young.collect()] == ["young.gif"]
    plan = young._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(modificationTime" in plan
    scan = files.listing(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scan.split("ReadSchema")[1]


def test_an_empty_folder(spark):
    root, before = folder(spark, "none"), scratch_path(spark, "none-before")
    put(root, "only.bin", b"1")
    files.write_snapshot(spark, root, before)
    assert files.visual_outputs(spark, root, before).count() == 0
