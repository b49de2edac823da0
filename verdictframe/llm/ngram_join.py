"""Self-join of documents by the Jaccard similarity of their word n-grams.

Documents with equal sets are one class; only classes are joined. Candidates come from
prefixes: two sets of similarity s share one of their first n - ceil(s n) + 1 shingles in any
common order. The order puts shingles that are frequent in a bounded sample last, so that shared passages
enter few prefixes. An inverted list of such shingles is cut into parts and each pair
of parts is one unit of work; there the parity bitmaps of the sets bound their
difference from below, and of the pairs that could still link a spanning forest is kept,
never all pairs. Its components are the blocks within which every link lies.

Inside a block (or a pair of parts of a large one) each set runs the T-occurrence search
of DivideSkip: the longest inverted lists are set aside, the short ones are merged with counts, and what
reaches the rest of the required overlap is looked up in the long ones by binary search. That gives exact
overlaps; links are counted for every document and joined to components.

Defined results: a null or empty text has no shingles and links with nothing; with fewer than
``n`` words the whole sequence is one shingle; equal sets always link; repeated rows are documents of
their own; a null id takes part but never names a component (its component is the smallest id
among the others, else null). Sizes of lists and blocks are unbounded; only parts are bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.llm import textops
from verdictframe.llm.shared import bounded_sample, broadcast_within, components, groups, stored

#: Words of a shingle, and the smallest similarity in percent.
WORDS = 5
PERCENT = 80
#: Documents whose shingles tell which ones are frequent; steers the order only.
SAMPLE = 8_192
FREQUENT = 3
FREQUENT_AT_MOST = 500_000
#: 64-bit words of the smallest parity bitmap; larger sets have half a bit per shingle, in powers of two.
BITMAP = 16
#: Members of a part of an inverted list.
LIST_PART = 4_096
#: Sets and shingles of a part of a block.
BLOCK_PART = 2_048
BLOCK_SHINGLES = 2_000_000
#: Candidate rows (eight numbers each) that may be broadcast to the scan of the texts.
BROADCAST_ROWS = 300_000


def shingle_sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted shingle hashes) of the column ``text``."""
    data, bounds = textops.column(batch, "text")
    for first, last, hashes, rows in textops.hashed_runs(data, bounds, textops.SPACES, textops.ascii_lower):
        for k in range(last - first):
            yield first + k, textops.shingles(hashes[rows[k] : rows[k + 1]], words)


def fingerprint(sets: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    if not len(sets):
        return 0, 0
    a = np.add.reduce(textops.mix(sets))
    b = np.bitwise_xor.reduce(textops.mix(sets * np.uint64(0xD1342543DE82EF95) + np.uint64(1)))
    return int(a.view(np.int64)), int(b.view(np.int64))


def parity_bitmap(sets: np.ndarray) -> bytes:
    """Bit b: whether an odd number of shingles falls on b. Two bitmaps differ in no more bits than the sets in shingles.

    With half a bit per shingle, unrelated sets still differ in more bits than linked ones may.
    """
    size = max(BITMAP * 64, 1 << max(len(sets) // 2 - 1, 1).bit_length())
    odd = np.bincount((sets % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def frequent_shingles(docs: DataFrame, key: str, text: str, words: int) -> np.ndarray:
    """Shingles of several documents of a sample of ``SAMPLE`` rows, taken by the hash of the id."""
    chosen = F.broadcast(bounded_sample(docs.select(F.col(key).alias("k")), SAMPLE, "k").distinct())
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(chosen, "k").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, s in shingle_sets(batch, words):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["s"])

    found = texts.mapInArrow(run, "s long").groupBy("s").count().filter(F.col("count") >= FREQUENT)
    found = found.orderBy(F.desc("count"), "s").limit(FREQUENT_AT_MOST).select("s").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


def required(n: int | np.ndarray, m: int | np.ndarray, percent: int):
    """Smallest overlap of sets of n and m with the similarity: 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def profiles(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """One row per document: set size, fingerprint, prefix and bitmap."""
    frequent = frequent_shingles(docs, key, text, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, fa, fb, prefixes, maps = [], [], [], [], [], []
            for row, s in shingle_sets(batch, words):
                n = len(s)
                rows.append(row)
                sizes.append(n)
                a, b = fingerprint(s)
                fa.append(a)
                fb.append(b)
                if not n:
                    prefixes.append(np.zeros(0, dtype=np.int64))
                    maps.append(b"")
                    continue
                length = n - -(-percent * n // 100) + 1
                hot = np.zeros(n, dtype=bool)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    hot = frequent[at] == s
                cold = s[~hot][:length]
                prefixes.append(np.concatenate([cold, s[hot][: length - len(cold)]]).view(np.int64))
                maps.append(parity_bitmap(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, type=pa.int64())), batch.column(1).take(pa.array(rows, type=pa.int64())),
                 pa.array(sizes, type=pa.int64()), pa.array(fa, type=pa.int64()), pa.array(fb, type=pa.int64()),
                 pa.array(prefixes, type=pa.list_(pa.int64())), pa.array(maps, type=pa.binary())],
                names=["id", "t", "n", "fa", "fb", "prefix", "bits"],
            )

    work = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    return work.mapInArrow(run, "id long, t long, n long, fa long, fb long, prefix array<long>, bits binary")


def forest(n: np.ndarray, maps: list[bytes], part: np.ndarray | None, percent: int) -> Iterator[tuple[int, int]]:
    """Spanning forest of the pairs whose bitmaps allow a link; with ``part``, of pairs of different parts only.

    Bitmaps of one size are compared directly; a larger one is folded first. Sizes further apart than the
    similarity allows are left out.
    """
    root = np.arange(len(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    length = np.array([len(m) for m in maps])
    rows = {int(k): np.flatnonzero(length == k) for k in np.unique(length)}
    bits = {k: np.frombuffer(b"".join([maps[r] for r in at]), dtype=np.uint64).reshape(len(at), -1) for k, at in rows.items()}
    for k, at in rows.items():
        pools = [(at, bits[k], True)]
        for more in rows:
            # sizes are powers of two, so bitmaps of linked sets differ by less than twice the ratio of the sets
            if k < more <= 2 * k * 100 // percent:
                folded = np.bitwise_xor.reduce(bits[more].reshape(len(rows[more]), more // k, k // 8), axis=1)
                pools.append((rows[more], folded, False))
        for place, x in enumerate(at.tolist()):
            for others, theirs, same in pools:
                if same:
                    others, theirs = others[place + 1 :], theirs[place + 1 :]
                need = required(n[x], n[others], percent)
                near = need <= np.minimum(n[x], n[others])
                if part is not None:
                    near &= part[others] != part[x]
                near = np.flatnonzero(near)
                if not len(near):
                    continue
                apart = np.bitwise_count(theirs[near] ^ bits[k][place]).sum(axis=1, dtype=np.int64)
                for y in others[near[apart <= n[x] + n[others[near]] - 2 * need[near]]].tolist():
                    a, b = find(x), find(y)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        yield x, y


def candidate_edges(classes: DataFrame, percent: int) -> DataFrame:
    """Edges between classes that connect all pairs which may link."""
    posted = classes.select(F.explode("prefix").alias("h"), "node")
    # stored, so that the join deals out both sides anew and may split a frequent shingle
    shared = stored(posted.groupBy("h").count().filter("count > 1"), "shared")
    members = posted.join(shared, "h").join(classes.select("node", "n", "bits"), "node")
    # a list of many members is cut into parts; each pair of parts is one unit
    parts = F.ceil(F.col("count") / LIST_PART).cast("int")
    part = F.pmod(F.xxhash64("node"), parts).cast("int")
    units = members.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    units = units.select(
        "h", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "n", "bits"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in groups(batches, 3):
            if unit.num_rows < 2:
                continue
            node = unit.column("node").to_numpy()
            n = unit.column("n").to_numpy()
            i, j, part = unit.column("i")[0].as_py(), unit.column("j")[0].as_py(), unit.column("part").to_numpy()
            edges = list(forest(n, unit.column("bits").to_pylist(), part if i != j else None, percent))
            if edges:
                x, y = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], names=["a", "b"])

    dealt = units.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def divide_skip(sets: list[np.ndarray], percent: int, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(x, its partners y < x) of sorted sets by T-occurrence search with DivideSkip.

    Short inverted lists are merged with counts, the longest ones are probed by binary search.
    ``wanted[x] == wanted[y]`` leaves a pair out (both in one part).
    """
    n = np.array([len(s) for s in sets])
    tokens, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.lexsort((owner, token))
    posted = owner[order]
    first = np.searchsorted(token[order], np.arange(len(tokens) + 1))
    start = np.concatenate([[0], np.cumsum(n)])
    lengths = np.diff(first)
    for x in range(len(sets)):
        mine = token[start[x] : start[x + 1]]
        mine = mine[lengths[mine] > 1]
        least = -(-percent * int(n[x]) // 100)
        if len(mine) < least:
            continue
        mine = mine[np.argsort(lengths[mine], kind="stable")]
        longest = int(lengths[mine[-1]])
        aside = min(int(least / (0.01 * np.log2(longest + 1) + 1)), least - 1) if longest > 64 else 0
        short, long = mine[: len(mine) - aside], mine[len(mine) - aside :]
        total = int(lengths[short].sum())
        at = np.arange(total) - np.repeat(np.cumsum(lengths[short]) - lengths[short], lengths[short]) + np.repeat(first[short], lengths[short])
        count = np.bincount(posted[at], minlength=len(sets))[:x]
        found = np.flatnonzero(count >= max(least - aside, 1))
        if wanted is not None:
            found = found[wanted[found] != wanted[x]]
        need = required(int(n[x]), n[found], percent)
        found = found[need <= np.minimum(n[x], n[found])]
        hits = count[found]
        need = required(int(n[x]), n[found], percent)
        for k, t in enumerate(long):
            if not len(found):
                break
            if k % 16 == 0:  # what cannot reach its overlap any more goes
                keep = hits + (len(long) - k) >= need
                found, hits, need = found[keep], hits[keep], need[keep]
            row = posted[first[t] : first[t + 1]]
            place = np.searchsorted(row, found)
            hits = hits + (row[np.minimum(place, len(row) - 1)] == found)
        found = found[hits >= need]
        if len(found):
            yield x, found


def linked(docs: DataFrame, classes: DataFrame, blocks: DataFrame, key: str, text: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(edges that connect linked classes, number of linked documents per class)."""
    inside = classes.select("node", "id", "t", "fa", "fb", "n", "copies").join(blocks, "node")
    sizes = blocks.join(classes.select("node", "n"), "node").groupBy("label").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_PART), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts")
    )
    active = stored(inside.join(stored(sizes, "sizes"), "label"), "active")
    wanted = active.select(F.col("id").alias("_id"), F.col("t").alias("_t"), "fa", "fb", "node", "label", "parts", "copies")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))
    texts = texts.join(broadcast_within(wanted, BROADCAST_ROWS), same)
    texts = texts.select("text", "fa", "fb", "node", "label", "parts", "copies")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fa, fb = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows, found = [], []
            for row, s in shingle_sets(batch, words):
                if fingerprint(s) == (fa[row], fb[row]):  # rows of one id may differ in text
                    rows.append(row)
                    found.append(s.view(np.int64))
            at = pa.array(rows, type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(at) for c in (3, 4, 5, 6)] + [pa.array(found, type=pa.list_(pa.int64()))],
                names=["node", "label", "parts", "copies", "shingles"],
            )

    full = texts.mapInArrow(sets, "node long, label long, parts int, copies long, shingles array<long>")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    units = full.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = units.select(
        "label", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "copies", "shingles"
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in groups(batches, 3):
            node = unit.column("node").to_numpy()
            node, once = np.unique(node, return_index=True)  # repeated rows
            copies = unit.column("copies").to_numpy()[once]
            part = unit.column("part").to_numpy()[once]
            column = unit.column("shingles").combine_chunks()
            if isinstance(column, pa.ChunkedArray):
                column = pa.concat_arrays(column.chunks)
            cut, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
            i, j = unit.column("i")[0].as_py(), unit.column("j")[0].as_py()
            few = [flat[cut[k] : cut[k + 1]] for k in once.tolist()]
            links = np.zeros(len(node), dtype=np.int64)
            low = np.arange(len(node))
            edges = []

            def find(k: int) -> int:
                while low[k] != k:
                    low[k] = low[low[k]]
                    k = int(low[k])
                return k

            for x, partners in divide_skip(few, percent, part if i != j else None) if len(few) > 1 else ():
                links[x] += copies[partners].sum()
                links[partners] += copies[x]
                for y in partners.tolist():
                    a, b = find(x), find(y)
                    if a != b:
                        low[max(a, b)] = min(a, b)
                        edges.append((node[y], node[x]))
            if edges:
                a, b = np.array(edges).T
                none = pa.nulls(len(edges), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none], names=["a", "b", "links"])
            has = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[has]), pa.nulls(len(has), pa.int64()), pa.array(links[has])], names=["a", "b", "links"]
            )

    dealt = units.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
    found = stored(dealt.mapInArrow(search, "a long, b long, links long"), "links")
    edges = found.filter(F.col("links").isNull()).select("a", "b")
    counts = found.filter(F.col("links").isNotNull()).groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    return edges, counts


def _components(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """(id, t, n, component_id, component, n_links) per row; ``component`` tells components of equal id apart."""
    rows = stored(profiles(docs, key, text, words, percent), "profiles")
    classes = rows.filter("n > 0").groupBy("n", "fa", "fb").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("one"), F.count(F.lit(1)).alias("copies"),
        F.first("prefix").alias("prefix"), F.first("bits").alias("bits"),
    ).select("n", "fa", "fb", "one.id", "one.t", "copies", "prefix", "bits")
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    blocks = stored(components(candidate_edges(classes, percent), "blocks"), "blocks")
    edges, counts = linked(docs, classes, blocks, key, text, words, percent)
    labels = components(edges, "linked")
    named = classes.select("node", "n", "fa", "fb", "id", "copies").join(labels, "node", "left").join(counts, "node", "left")
    named = named.withColumn("label", F.coalesce("label", "node"))
    smallest = stored(named.groupBy("label").agg(F.min("id").alias("component_id")), "smallest")
    links = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    named = stored(named.join(smallest, "label").select("n", "fa", "fb", "component_id", F.col("label").alias("component"), links), "named")
    out = rows.select("id", "t", "n", "fa", "fb").join(named, ["n", "fa", "fb"], "left")
    return out.select(
        "id", "t", "n", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("n") == 0, F.col("t")).otherwise(F.col("component")).alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """(key, n_shingles, component_id, n_links) of every row of ``docs``; links count linked documents, copies included."""
    found = _components(docs, key, text, words, percent)
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", "n_links")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component with its columns: the one whose id names it.

    Of repeated rows of that id one stays. Documents without an id stay unless one with an id is linked to them;
    texts without words stay, once per id and text.
    """
    found = _components(docs, key, text, words, percent)
    own = F.col("id").eqNullSafe(F.col("component_id"))
    # rows of one id may hold different texts of one component: the smallest text hash stays
    keep = stored(found.filter(own).groupBy("id", "component").agg(F.min("t").alias("t")), "kept").select(
        F.col("id").alias("__id"), F.col("t").alias("__t")
    ).distinct()
    once = Window.partitionBy("__i", "__h").orderBy("__h")
    work = docs.select(*[docs[c] for c in docs.columns], F.col(key).cast("long").alias("__i"), F.xxhash64(docs[text]).alias("__h"))
    joined = work.join(keep, F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__t")), "left_semi")
    kept = joined.withColumn("__n", F.row_number().over(once)).filter((F.col("__n") == 1) | F.col("__i").isNull())
    return kept.select(*docs.columns)
