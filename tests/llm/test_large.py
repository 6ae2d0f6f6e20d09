"""Very long texts and pages, frequent runs of words, broken archives, other tokenizers."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.llm import common, warc
from meridian.llm import html_extract as he
from meridian.llm import near_dedup as nd
from meridian.llm import packing as pk
from meridian.llm import quality_classifier as qc
from meridian.llm import queries as q
from meridian.llm import substring_dedup as sd

from .helpers import corpus, documents, edited, prose
from .test_dedup import brute_cut


@pytest.fixture
def short_segments(monkeypatch):
    """As if texts of 50 bytes were very long."""
    def patch():
        monkeypatch.setattr(common.segments, "__defaults__", (50,))
        monkeypatch.setattr(pk, "PIECE_CHARS", 50)
    return patch


def test_segments_are_whole_words():
    r = random.Random(0)
    for n in (0, 1, 10, 300):
        data = " \n".join("w" * r.randrange(1, 30) for _ in range(n)).encode() + b"  "
        for limit in (1, 7, 50, 10**6):
            parts = list(common.segments(data, limit))
            assert b"".join(parts) == data and [w for p in parts for w in p.split()] == data.split()


def test_long_texts_in_segments(short_segments):
    texts = corpus()
    hashes, known, encoder = common.WordHashes(), qc.TokenRows(), pk.Encoder(q.tokenizer_path())

    def everything():
        flat, counts = common.hashed_words(texts, hashes, lower=True)
        sets = [s.tolist() for s in nd.shingle_sets(texts, 3, hashes)]
        rows, n = qc.token_rows(texts, known)
        cuts = [sd.cut_out(t, [(1, 3), (40, 41), (60, 10**6)]) for t in texts] + [sd.cut_out(t, []) for t in texts]
        return flat.tolist(), counts.tolist(), sets, rows.tolist(), n.tolist(), cuts, [x.tolist() for x in encoder.encode(texts)]

    whole = everything()
    short_segments()
    assert everything() == whole


def test_document_vectors_in_parts(monkeypatch):
    rng = np.random.default_rng(0)
    vectors, weights = rng.normal(size=(qc.ROWS, qc.DIM)).astype(np.float32), rng.random(qc.ROWS).astype(np.float32) + 0.1
    texts = corpus()
    whole = qc.document_vectors(texts, qc.TokenRows(), vectors, weights)
    monkeypatch.setattr(qc, "TOKENS_AT_ONCE", 17)
    parts = qc.document_vectors(texts, qc.TokenRows(), vectors, weights)
    assert parts == pytest.approx(whole, abs=1e-4) and (whole[[not (t or "").strip() for t in texts]] == 0).all()


def test_wide_rows_of_nodes_in_parts(monkeypatch):
    from meridian.llm.html_pages import labelled_pages
    pages = [*labelled_pages(4, 99), "", "<p>" * 300 + "deep", "<ul>" + "<li>one two" * 500]
    whole = he.extract(pages, he.trained())
    monkeypatch.setattr(he, "NODES_AT_ONCE", 13)
    assert he.extract(pages, he.trained()) == whole


def test_decoding_is_the_most_likely_choice():
    """Against all choices in which nothing is kept below a dropped node."""
    r = random.Random(5)
    for _ in range(60):
        page = he.Page("".join(r.choice(["<div>", "<p>", "</div>", "x", "<section>", "</section>"]) for _ in range(14)))
        n = len(page.tag)
        if n > 11:
            continue
        logits, has = [r.gauss(0, 2) for _ in range(n)], [r.random() < 0.8 for _ in range(n)]
        has[0] = False

        def gain(kept):
            return sum(-np.log1p(np.exp(-z if k else z)) for z, k, h in zip(logits, kept, has) if h)

        choices = [c for c in itertools.product([False, True], repeat=n) if c[0] and all(c[page.parent[i]] or not c[i] for i in range(1, n))]
        got = he.decode(page, logits, has)
        assert tuple(got) in choices and gain(got) == pytest.approx(max(map(gain, choices)))


def test_frequent_runs_of_words_are_dealt_out(spark, monkeypatch):
    """A slogan among different texts: its windows go by their own hash, and nothing changes."""
    slogan = prose(32, 321)
    texts = [f"{prose(60, i)} {slogan} {prose(60, 500 + i)}" for i in range(60)] + [f"{prose(9, 1)} {prose(60, i)} {slogan}" for i in range(0, 60, 7)] + corpus()
    monkeypatch.setattr(sd, "SAMPLED", 1)
    found = []
    hot = sd.hot_minimizers

    def seen(*args):
        found.append(hot(*args))
        return found[-1]

    monkeypatch.setattr(sd, "hot_minimizers", seen)
    docs = documents(spark, texts).repartition(5)
    monkeypatch.setattr(sd, "FEW", 10**9)
    plain = sorted(map(tuple, sd.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))
    monkeypatch.setattr(sd, "FEW", 60)
    dealt = sorted(map(tuple, sd.remove_repeats(docs, words_a_bucket=2000).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))
    assert plain == dealt == brute_cut(texts, 50)
    assert [len(x) > 0 for x in found] == [False, True]


@pytest.mark.parametrize("damage", ["cut", "byte"])
def test_broken_records_are_errors(spark, tmp_path, damage):
    rows = [(i, f"http://x/{i}", prose(300, i)) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    (path,) = warc.write_archives(df, f"file://{tmp_path}/w")
    name = path.removeprefix("file://")
    data = bytearray(open(name, "rb").read())
    if damage == "cut":
        del data[-40:]
    else:
        starts = [at for at, _ in warc.records_of(path, 0, len(data))]
        data[(starts[3] + starts[4]) // 2] ^= 0xFF
    open(name, "wb").write(data)
    with pytest.raises(Exception, match="damaged record|truncated record"):
        warc.read_archives(spark, [path]).count()
    assert warc.read_archives(spark, [path], broken="skip").count() == 5


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer
    path = q.tokenizer_path("byte_bpe_50k.json")
    assert pk.wordwise(q.tokenizer_path()) and not pk.wordwise(path)
    tokenizer, texts = Tokenizer.from_file(path), [*corpus(), "  two  spaces\n\n", "It's ONE"]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in pk.Encoder(path).encode(texts)] == want


def test_conversations_are_packed_within_all_limits(spark, sf_dir):
    rows = q.conversations(spark, sf_dir).collect()
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert sorted(r.example_id for r in rows) == sorted(r.conv_id for r in turns.select("conv_id").distinct().collect())
    from tokenizers import Tokenizer
    tokenizer, want = Tokenizer.from_file(q.tokenizer_path()), {}
    for t in turns.collect():
        n = len(tokenizer.encode(t.text or "", add_special_tokens=False).ids) + 1
        tokens, loss = want.get(t.conv_id, (0, 0))
        want[t.conv_id] = tokens + n, loss + (n if t.role == "assistant" else 0)
    assert {r.example_id: (r.tokens, r.loss_tokens) for r in rows} == want
    of = {}
    for r in rows:
        of.setdefault(r.sequence_id, []).append(r)
    loads = [(sum(r.tokens for r in s), len(s), sum(r.loss_tokens for r in s)) for s in of.values() if not s[0].oversized]
    assert all(t <= 2048 and n <= 8 and loss <= 1024 for t, n, loss in loads)
    # Each limit, not tokens alone, closes some sequences.
    assert any(loss > 700 and t < 1500 for t, _, loss in loads)


def next_fit(items, limits):
    """The plainest packer: a new sequence whenever the next example does not fit."""
    out, left = 0, (0, 0, 0)
    for size in items:
        if any(a > b for a, b in zip(size, left)):
            out, left = out + 1, limits
        left = tuple(b - a for a, b in zip(size, left))
    return out


@pytest.mark.parametrize("limits", [(2048, 16, 2048), (2048, 4, 2048), (2048, 16, 900)])
def test_packing_beats_the_plainest_packer(limits):
    rng = np.random.default_rng(3)
    tokens = np.minimum(rng.lognormal(5.5, 0.9, 3000).astype(int) + 1, 2048)
    loss = np.minimum((tokens * rng.random(3000)).astype(int), limits[2])
    packer = pk.Packer(limits, 2048, cutting=False)
    items = [pk.Item(i, 0, int(t), int(x), int(t)) for i, (t, x) in enumerate(zip(tokens, loss))]
    out = [s for x in items for s in packer.add(x)] + list(packer.fill(0))
    plain = next_fit([(int(t), 1, int(x)) for t, x in zip(tokens, loss)], limits)
    least = max(tokens.sum() / limits[0], 3000 / limits[1], loss.sum() / limits[2])
    # A bound on segments alone leaves little to choose: every example counts alike there.
    assert len(out) < (1.0 if limits[1] == 4 else 0.9) * plain and len(out) < 1.13 * least + 1


def test_one_very_long_document(spark):
    """Two texts of some 3 MB among short ones, through every operator on texts."""
    long = prose(400_000, 8, 5000)
    texts = [long, "short text here", edited(long, 50, 1), prose(80, 2)]
    docs = documents(spark, texts)
    near = {r.doc_id: r.component_id for r in nd.near_duplicates(docs, width=5, percent=80).collect()}
    assert near == {0: 0, 1: 1, 2: 0, 3: 3}
    cut = {r.doc_id: r for r in sd.remove_repeats(docs).collect()}
    assert cut[0].n_words == 400_000 and cut[0].n_removed == 0 and cut[2].n_removed > 390_000
    packed = pk.pack_documents(docs, q.tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert all(r.n == r.m for r in packed) and max(r.n for r in packed) > 400_000
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)], "doc_id long, quality int")
    assert qc.classify(docs, labels).count() == 4
