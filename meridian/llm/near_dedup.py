"""Near-duplicate detection by min-max hashing.

Each document is the set of its w-word shingles. Under one random permutation both the
smallest and the largest shingle are kept, so ``bands * rows / 2`` hash evaluations give
``bands * rows`` signature values. Documents that agree on all values of a band meet in a
bucket; candidates are compared on their full shingle sets, and links become components.

Defined results: a text that is null, empty or all white space has an empty set, links
with nothing and is a class of its own. Texts of fewer words than a shingle are one
shingle. Equal sets always link. Repeated rows of one id are one document; ids must hold
one text each (of several, one is compared). Rows with a null id are left out of classes:
their component is null and they are kept. Ties go to the smallest id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, M2, M3, Work, WordHashes, components, hashed_words, mix, pieces, spread, tidy

#: Values in a band (half of them minima, half maxima) and bands: a pair at 0.85 is missed
#: with probability (1 - 0.85^8)^48 = 2e-7, at 0.8 with 1e-4 (64 bands: 7e-6).
ROWS, BANDS = 8, 48
#: Shingles and documents of a block in the grid: what one side of a cell holds at most
#: (a document of more shingles is a block of its own).
BLOCK_SHINGLES, BLOCK_DOCS = 64_000, 128

SKETCH = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])
SETS = pa.schema([("doc", pa.int64()), ("words", pa.binary())])


def shingle_sets(texts: list, width: int, hashes: WordHashes) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    flat, counts = hashed_words(texts, hashes, lower=True)
    size = len(flat) - width + 1
    grams = flat[:0]
    if size > 0:
        grams = flat[:size].copy()
        for j in range(1, width):
            grams = ((grams ^ (grams >> np.uint64(31))) * M1) + flat[j : j + size] * M3
        grams = mix(grams)
    out, at = [], 0
    for text, n in zip(texts, counts.tolist()):
        if n >= width:
            out.append(np.unique(grams[at : at + n - width + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(text.encode("utf-8", "surrogatepass").lower().split()), seed=1)], dtype=np.uint64))
        else:
            out.append(flat[:0])
        at += n
    return out


def permutations(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    n = bands * rows // 2
    return (rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32))


def min_max(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation, side by side."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(len(a), 0xFFFFFFFF, np.uint32), np.zeros(len(a), np.uint32)
    for k in range(0, len(x), 512):
        v = x[k : k + 512, None] * a + b
        np.minimum(low, v.min(axis=0), out=low)
        np.maximum(high, v.max(axis=0), out=high)
    return np.stack([low, high], axis=1).ravel()


def sketches(width: int, rows: int, bands: int):
    a, b = permutations(bands, rows)
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * M1)

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            ids = batch.column(0)
            for start, end, texts in pieces(batch.column(1)):
                sets = shingle_sets(texts, width, hashes)
                full = [s for s in sets if len(s)]
                keys = np.zeros((0, bands), np.int64)
                if full:
                    signs = np.stack([min_max(s, a, b) for s in full]).reshape(len(full), bands, rows).astype(np.uint64)
                    k = np.broadcast_to(salt, (len(full), bands)).copy()
                    for j in range(rows):
                        k = (k ^ signs[:, :, j]) * M2
                        k ^= k >> np.uint64(29)
                    keys = mix(k).view(np.int64)
                digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else bytes(16) for s in sets]
                d = np.frombuffer(b"".join(digest), dtype=np.int64).reshape(-1, 2)
                sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
                offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(start, end - start), pa.array(sizes), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))], schema=SKETCH)

    return run


def packed_sets(width: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for start, end, texts in pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array([s.tobytes() for s in shingle_sets(texts, width, hashes)], type=pa.binary())], schema=SETS)

    return run


def confirmed(percent: int):
    """Of pairs with both sets, those whose full sets overlap enough."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=out).filter(pa.array(keep, type=pa.bool_()))

    return run


def grid_links(percent: int):
    """Compares a grid cell's open documents with its others; a link for each pair of
    classes that one document joins. Rows come sorted by cell, open documents first."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(open_: list, others: list):
        sets = [np.frombuffer(x[2], np.uint64) for x in open_]
        sizes = np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        by = np.argsort(flat, kind="stable")
        sorted_, owner = flat[by], np.repeat(np.arange(len(sets)), sizes)[by]
        links = []
        for doc, root, words in others:
            mine = np.frombuffer(words, np.uint64)
            left, right = np.searchsorted(sorted_, mine, "left"), np.searchsorted(sorted_, mine, "right")
            n = right - left
            at = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(sets))
            hit = np.flatnonzero(100 * common >= percent * (sizes + len(mine) - common))
            links += {open_[k][1]: (open_[k][0], doc) for k in hit.tolist() if open_[k][1] != root}.values()
        return links

    def run(batches):
        cell, open_, others = None, [], []

        def done():
            links = compare(open_, others) if open_ and others else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], schema=out)

        for batch in batches:
            for *key, is_open, doc, root, words in zip(*(c.to_pylist() for c in batch.columns)):
                if key != cell:
                    yield from done()
                    cell, open_, others = key, [], []
                (open_ if is_open else others).append((doc, root, words))
                if len(others) >= 1024:
                    yield from done()
                    others = []
        yield from done()

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, rows: int = ROWS, bands: int = 64) -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id, kept).

    Two documents link if 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest id reachable over links and kept marks that document.

    Exact copies join their class through the set's digest and are never paired. Buckets
    with the same members count once. A bucket's members are first compared with its
    smallest one, which puts most of a group into one class. What is then still open, the
    documents outside the largest class of a bucket of theirs, is compared with all of that
    class (once, however many buckets they share) and with the bucket's other open
    documents, where set sizes allow a link. That happens on a grid of blocks: both sides
    of a cell are bounded, so a class of any size is spread over tasks, and no pair is a
    row. The rule is the same at every size: a link is found if both documents share a
    bucket. The cost is that of open documents times the classes and buckets they meet; a
    copy of each open document goes to each block of those.
    """
    spark = docs.sparkSession
    work = Work(spark, "near-dedup")
    read = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    sketch = work.keep(read.mapInArrow(tidy(sketches(width, rows, bands)), "doc long, n long, d1 long, d2 long, bands array<long>"), "sketches")

    # Exact copies: one representative for each set.
    reps = work.keep(sketch.where("n > 0 and doc is not null").groupBy("d1", "d2").agg(F.min("doc").alias("rep"), F.min("bands").alias("bands"), F.max("n").alias("n")), "representatives")
    each = reps.select("rep", "n", F.explode("bands").alias("key"))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("centre")).where("c > 1")
    # The same join at every size: the buckets that several share grow with the input.
    members = work.keep(each.join(shared.hint("merge"), "key"), "all-buckets")
    # Of buckets with the same members one counts; members are told by two combined hashes.
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "rep")).alias(f"m{i}") for i in (0, 1)]
    different = members.groupBy("key", "centre", "c").agg(*marks).groupBy("centre", "c", "m0", "m1").agg(F.min("key").alias("key")).select("key")
    members = work.keep(members.join(different, "key").select("key", "rep", "n", "centre", "c"), "buckets")
    wanted = members.select(F.col("rep").alias("doc")).distinct()
    texts = work.keep(read.where("doc is not null").join(wanted.hint("merge"), "doc").mapInArrow(tidy(packed_sets(width)), "doc long, words binary").where("length(words) > 0").dropDuplicates(["doc"]), "sets")

    pairs = members.where("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
    a, b = (texts.select(F.col("doc").alias(x), F.col("words").alias(f"words_{x}")) for x in "ab")
    links = work.keep(pairs.join(a, "a").join(b, "b").select("a", "b", "words_a", "words_b").mapInArrow(tidy(confirmed(percent)), "a long, b long"), "links")
    classes = work.keep(components(links, work), "classes")

    # Sets whose sizes lie more than one bin apart differ too much in size to link.
    size_bin = F.floor(F.log(F.col("n").cast("double")) / max(math.log(100 / percent) * (1 + 1e-9), 1e-6)).cast("int")
    named = members.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("key", "c", "rep", "n", size_bin.alias("bin"), F.coalesce("root", "rep").alias("class"))
    named = work.keep(named, "named")
    # In a bucket of two the only pair has been compared.
    of_class = named.where("c > 2").groupBy("key", "class").agg(F.count(F.lit(1)).alias("c"))
    mains = work.keep(of_class.groupBy("key").agg(F.max_by("class", F.struct("c", -F.col("class"))).alias("main"), F.count(F.lit(1)).alias("classes")).where("classes > 1").select("key", "main"), "mains")
    # Written, so that a bucket with a third of all documents can be split when it meets its row.
    open_ = work.keep(named.join(mains, "key").where("class <> main"), "open")
    # Open documents meet a bucket's main class once, in however many buckets they met it.
    one = open_.select(F.lit(0).alias("kind"), F.col("main").alias("unit"), "rep", "class", "n", "bin").distinct()
    mains_of = one.select(F.col("unit").alias("class")).distinct()
    held = named.select("rep", "class", "n", "bin").distinct().join(mains_of, "class").select(F.lit(0).alias("kind"), F.col("class").alias("unit"), "rep", "class", "n", "bin")
    # And one another in each bucket; buckets with the same open documents count once.
    sets = open_.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("class").alias("low"), F.max("class").alias("high"), *marks).where("low <> high")
    sets = sets.groupBy("c", "m0", "m1").agg(F.min("key").alias("key")).select("key")
    other = open_.join(sets, "key").select(F.lit(1).alias("kind"), F.col("key").alias("unit"), "rep", "class", "n", "bin")
    asking, asked = work.keep(one.unionByName(other), "asking"), work.keep(held.unionByName(other), "asked")
    near = F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin")
    asking = asking.select("kind", "unit", near, "rep", "class", "n")
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_DOCS)).cast("int")
    unit = ["kind", "unit", "bin"]
    units = work.keep(asked.groupBy(*unit).agg(blocks.alias("blocks")).join(asking.groupBy(*unit).agg(blocks.alias("open_blocks")), unit), "units")
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    others = asked.join(units, unit).select(*unit, F.explode(span("open_blocks")).alias("i"), own("blocks").alias("j"), F.lit(False).alias("is_open"), "rep", "class")
    those = asking.join(units, unit).select(*unit, own("open_blocks").alias("i"), F.explode(span("blocks")).alias("j"), F.lit(True).alias("is_open"), "rep", "class")
    cells = those.unionByName(others).join(texts.withColumnRenamed("doc", "rep"), "rep").select(*unit, "i", "j", "is_open", "rep", "class", "words")
    dealt = cells.repartition(spread(spark), *unit, "i", "j").sortWithinPartitions(*unit, "i", "j", F.desc("is_open"))
    more = work.keep(dealt.mapInArrow(tidy(grid_links(percent)), "a long, b long"), "links")
    if more.head(1):
        classes = work.keep(components(links.unionByName(more), work), "classes")
    work.drop(texts, members, links, more, named, mains, open_, asked, units)
    by_set = reps.select("d1", "d2", "rep").join(classes.select(F.col("node").alias("rep"), "root"), "rep", "left").select("d1", "d2", F.coalesce("root", "rep").alias("root"))
    out = sketch.join(by_set, ["d1", "d2"], "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc"))).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
