"""Near-duplicate and repeated-passage removal against brute force."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meridian.llm import near_dedup as nd
from meridian.llm import substring_dedup as sd
from meridian.llm.common import Work, WordHashes, checkpoint_root, components

from .helpers import SCHEMA, corpus, documents, edited, prose


def words(text):
    return text.encode().split() if text else []


def brute_near(texts, width, percent):
    sets = []
    for t in texts:
        w = words(t.lower() if t and t.isascii() else t)
        w = [x.lower() for x in w]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return [(i, len(sets[i]), find(i), find(i) == i) for i in range(len(texts))]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80), (1, 50)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    texts = corpus()
    rows, bands = (8, 64) if percent > 60 else (3, 64)
    got = nd.near_duplicates(documents(spark, texts), width=width, percent=percent, rows=rows, bands=bands)
    assert sorted(map(tuple, got.collect())) == brute_near(texts, width, percent)


def test_large_group_with_open_members(spark, monkeypatch):
    """Members that differ a lot among themselves are compared on the grid of blocks."""
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 800)
    monkeypatch.setattr(nd, "BLOCK_DOCS", 7)
    base = prose(100, 5)
    texts = [base] + [edited(base, random.Random(s).choice((1, 2, 3, 5, 6, 7, 8)), s) for s in range(120)]
    want = brute_near(texts, 3, 85)
    assert len({c for _, _, c, _ in want}) > 5
    assert sorted(map(tuple, nd.near_duplicates(documents(spark, texts), width=3, percent=85, bands=48).collect())) == want


@pytest.mark.parametrize("around", [5, 3000])
def test_links_do_not_depend_on_what_else_there_is(spark, around):
    """The same planted pairs link among few and among many similar documents."""
    base = prose(100, 5).split()
    family = [" ".join(base[:60] + prose(40, 1000 + i).split()) for i in range(around)]  # alike, but not enough
    planted = [" ".join(base[:60] + prose(40, 7000 + i).split()) for i in range(6)]
    texts = [*planted, *(edited(t, k, 9 + k) for k, t in enumerate(planted)), *family]
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(documents(spark, texts), width=3, percent=85, bands=48).collect()}
    want = {i: c for i, _, c, _ in brute_near(texts[:17], 3, 85)}
    assert {i: got[i] for i in range(12)} == {i: want[i] for i in range(12)} and len(set(want.values())) > 6
    assert all(got[i] == i for i in range(12, len(texts)))


def test_near_null_ids_repeats_and_clashes(spark):
    t = prose(50, 1)
    rows = [(None, t), (None, None), (3, t), (3, t), (1, t), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n_shingles", "component_id", "kept", "doc", "rep", "key", "a", "b")})
    got = nd.near_duplicates(df, width=3, percent=85).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (-1, -1, True), (1, 1, True), (2, 2, True), (3, 1, False), (3, 1, False)]


def test_near_empty_table(spark):
    out = nd.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_min_max_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    a, b = nd.permutations(64, 8)
    errors = []
    for _ in range(30):
        common, own = rng.integers(0, 1 << 64, 300, dtype=np.uint64), rng.integers(0, 1 << 64, 200, dtype=np.uint64)
        x, y = np.concatenate([common, own[:100]]), np.concatenate([common, own[100:]])
        errors.append((nd.min_max(x, a, b) == nd.min_max(y, a, b)).mean() - 300 / 500)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_components_of_chains_and_stars(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(200, 260)] + [(7, k) for k in range(8, 60)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = sorted((k, find(k)) for k in list(root) if any(k in e and e[0] != e[1] for e in edges))
    got = components(spark.createDataFrame(edges, "a long, b long"), Work(spark, "t"))
    assert sorted(map(tuple, got.collect())) == want


def brute_cut(texts, width):
    w = [words(t) for t in texts]
    first = {}
    for d, own in enumerate(w):
        for i in range(len(own) - width + 1):
            first.setdefault(tuple(own[i : i + width]), d)
    out = []
    for d, own in enumerate(w):
        gone = set()
        for i in range(len(own) - width + 1):
            if first[tuple(own[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = [x for i, x in enumerate(own) if i not in gone]
        out.append((d, len(own), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize("width,piece", [(50, 4_000_000), (50, 500), (7, 2000), (9, 10**6)])
def test_repeats_equal_brute_force(spark, monkeypatch, width, piece):
    """Also where every task combines only a few texts before the shuffle."""
    monkeypatch.setattr(sd, "PIECE", piece)
    texts = corpus()
    df = documents(spark, texts).repartition(5)
    got = sd.remove_repeats(df, width=width).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == brute_cut(texts, width)


def test_repeats_keep_text_and_columns(spark):
    t = prose(80, 3)
    rows = [(1, t, 5, "q"), (2, "start  of it\n" + t + " end", 6, "q"), (None, t, 7, "q"), (4, None, 8, "q"), (5, "short  text", 9, "q"), (1, t, 5, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long, doc string")
    out = sd.remove_repeats(df)
    assert out.columns == ["doc_id", "text", "doc", "n_words", "n_removed", "kept_text", "kept_sha256"]
    got = {(r.doc_id, r.n_words): (r.n_removed, r.kept_text) for r in out.collect()}
    assert got == {(1, 80): (0, t), (2, 84): (80, "start of it end"), (None, 80): (0, t), (4, 0): (0, None), (5, 2): (0, "short  text")}
    assert out.count() == 6
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_rolling_hash_and_minima():
    flat = WordHashes().of([b"a", b"b", b"c"] * 30)
    h = sd.rolling(flat, 6)
    assert (h[:-3] == h[3:]).all() and len(set(h.tolist())) == 3
    x = np.random.default_rng(1).integers(0, 100, 50).astype(np.uint64)
    for width in (1, 2, 5, 8, 13):
        assert sd.least_in_runs(x, width).tolist() == [x[i : i + width].min() for i in range(51 - width)]
    assert sd.spans([(0, 5), (3, 7), (7, 9), (12, 13)]) == [(0, 9), (12, 13)]


def test_checkpoint_folder(spark):
    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return "file:///shared/folder/" if key == "spark.checkpoint.dir" else default

    assert checkpoint_root(Session) == "file:///shared/folder"
    assert checkpoint_root(spark)
    work = Work(spark, "t")
    kept = work.keep(spark.range(3), "x")
    assert kept.count() == 3
    work.drop(kept)


def cut_rows(texts, hot=()):
    """The cuts that buckets give for texts of one batch, counted outside Spark."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc", "text"])
    rows = pa.Table.from_batches(sd.windows(50, 8, np.array(sorted(hot), np.uint64))([batch])).sort_by("bucket")
    return [tuple(r.values()) for b in sd.counted(50)(rows.to_batches()) for r in b.to_pylist()]


@pytest.mark.parametrize("dealt", [False, True])
def test_copies_in_a_batch_are_one_cut_each(dealt):
    """However many minimizers a repeated passage has, and if they are all frequent ones."""
    text, passage = prose(300, 5), prose(90, 6)
    texts = [text] * 40 + [f"{prose(20, 10 + i)} {passage} {prose(20, 90 + i)}" for i in range(30)]
    hot = {int(x) for t in texts for x in sd.minimizers(WordHashes().of(words(t)), 50)} if dealt else ()
    assert sorted(cut_rows(texts, hot)) == [(d, 0, 300) for d in range(1, 40)] + [(d, 20, 110) for d in range(41, 70)]


def test_copies_of_a_text_make_no_minimizer_frequent(spark, monkeypatch):
    """They travel once for each piece, so their number is not that of different windows."""
    monkeypatch.setattr(sd, "SAMPLED", 1)
    monkeypatch.setattr(sd, "FEW", 60)
    found, hot = [], sd.hot_minimizers
    monkeypatch.setattr(sd, "hot_minimizers", lambda *a: found.append(hot(*a)) or found[-1])
    texts = [prose(300, 5)] * 200 + [prose(300, 10 + i) for i in range(200)]
    got = sd.remove_repeats(documents(spark, texts).repartition(5)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == brute_cut(texts, 50)
    assert [len(x) for x in found] == [0]
