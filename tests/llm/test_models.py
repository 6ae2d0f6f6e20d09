"""The classifier, the extractor and nearest neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.llm import ann, html_extract as he, quality_classifier as qc
from meridian.llm.html_pages import MARK, labelled_pages

from .helpers import documents, prose


def junk(n, seed):
    return " ".join(w + m for w, m in zip(prose(n, seed).split(), ["###", "***", "%%%"] * n))


def labelled(spark, n=240):
    texts = [junk(40, i) if i % 3 == 0 else prose(40, i) for i in range(n)] + [None, "", " ", prose(5000, 1)]
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1) for i in range(n)], "doc_id long, quality int")
    return documents(spark, texts), labels


def test_classifier_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    out = qc.classify(docs.withColumn("score", F.lit("old")), labels.where("doc_id % 4 <> 1"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "predicted"]
    rows = {r.doc_id: r for r in out.collect()}
    held = [i for i in range(240) if i % 4 == 1]
    assert np.mean([rows[i].predicted == (i % 3 != 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values()) and len(rows) == 244
    assert rows[240].score == rows[241].score == rows[242].score and rows[243].predicted == 1


def test_scores_do_not_depend_on_partitions(spark):
    docs, labels = labelled(spark, 60)
    a, b = (sorted((r.doc_id, round(r.score, 6)) for r in qc.classify(d, labels).collect()) for d in (docs.repartition(1), docs.repartition(9)))
    assert a == b


def test_classifier_without_labels(spark):
    docs, labels = labelled(spark, 9)
    assert {r.score for r in qc.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in qc.classify(docs, labels.where("quality = 1")).collect()} == {1.0}
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, quality int")
    assert {r.score for r in qc.classify(docs, odd).collect()} == {1.0}
    assert qc.classify(docs.limit(0), labels).count() == 0


def test_other_columns_are_no_inputs(spark):
    docs, labels = labelled(spark, 60)
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string")})
    a, b = (sorted((r.doc_id, r.score) for r in qc.classify(d, labels).collect()) for d in (docs, other))
    assert a == b


def test_word_table_counts_all_texts():
    texts = [prose(30, 1), None, "", "A a a!! 12"]
    known = qc.TokenRows()
    flat, counts = qc.token_rows(texts, known)
    assert counts.tolist()[1:3] == [0, 0] and counts.sum() == len(flat)
    assert flat[-6:].tolist()[0:2] == [qc.TokenRows.row("a"), qc.TITLE]


def test_network_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = qc.Network(x[:2000], y[:2000])
    s = net.scores(x[2000:])
    for low in (0.1, 0.3, 0.5, 0.7):
        some = (s >= low) & (s < low + 0.2)
        assert abs(s[some].mean() - y[2000:][some].mean()) < 0.12


# ---- pages


def want(source):
    page = he.Page(source)
    return [b for b in he.main_text(page, [True] * len(page.tag)).split("\n\n") if b and MARK not in b]


def test_extractor_on_pages_it_has_not_seen():
    pages = labelled_pages(150, 4242)
    got = [t.split("\n\n") if t else [] for t in he.extract(pages, he.trained())]
    truth = [want(p) for p in pages]
    assert np.mean([a == b for a, b in zip(got, truth)]) > 0.9
    wrong = sum(len(set(a) ^ set(b)) for a, b in zip(got, truth))
    assert wrong < 0.02 * sum(map(len, truth))


def test_extractor_on_the_tables_pages(spark, sf_dir):
    import html
    import re
    rows = he.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("text", F.lit(1))).collect()
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    same = 0
    for r in rows:
        inner = re.search("<article>(.*?)</article>", source[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        same += r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)
    assert same >= 0.98 * len(rows)


def test_odd_pages(spark):
    cases = [None, "", "   ", "plain text only", "<p>one", "<p", "<div class='x", "<article><p>A&amp;B &nbsp; c&#233;\n d</p><script>no</script><style>p{}</style><!-- c --></article>",
             "<html><head><title>t</title></head><body><nav><ul><li><a href=/>menu</a></li></ul></nav><article><h1>Head</h1><p>First <b>bold</b> words here, and more of them.<br>next<p>Second paragraph is here as well.</article><footer>end &copy;</footer>", "<article>" + "<p>word word word.</p>" * 3000, "<div>" * 3000 + "deep"]
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, html string").withColumn("url", F.lit(None).cast("string"))
    got = {r.page_id: r.text for r in he.extract_main_text(df).collect()}
    assert [got[i] for i in (0, 1, 2)] == ["", "", ""]
    assert got[7] == "A&B cé d" and got[8] == "Head\n\nFirst bold words here, and more of them. next\n\nSecond paragraph is here as well."
    assert got[9].count("\n\n") == 2999 and len(got) == len(cases)
    assert he.extract_main_text(df.limit(0)).count() == 0


def test_decoding_never_contradicts():
    rng = np.random.default_rng(1)
    for source in labelled_pages(20, 9):
        page = he.Page(source)
        kept = he.decode(page, rng.normal(0, 3, len(page.tag)).tolist(), [True] * len(page.tag))
        assert all(not kept[i] or page.parent[i] < 0 or kept[page.parent[i]] for i in range(len(page.tag)))


# ---- neighbours


def brute_nearest(ids, vectors, k, is_query):
    out = []
    for i in np.flatnonzero([is_query(x) for x in ids]):
        scores = vectors.astype(float) @ vectors[i].astype(float)
        best = sorted((-s, v) for s, v in zip(scores, ids) if v != ids[i])[:k]
        out.append((ids[i], [v for _, v in best], [-s for s, _ in best]))
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_recall_of_nearest(spark, scale):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    v = (centres[rng.integers(0, 40, 3000)] + 0.5 * rng.normal(size=(3000, 24))).astype(np.float32)
    v *= rng.uniform(0.3, 3, (3000, 1)).astype(np.float32) if scale else 1
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>")
    got = ann.nearest(df, lambda c: c % 100 == 0).orderBy("query_id", "rank").collect()
    hits = 0
    for q, ids, scores in brute_nearest(list(range(3000)), v, 20, lambda x: x % 100 == 0):
        own = [r for r in got if r.query_id == q]
        assert [r.rank for r in own] == list(range(1, 21))
        assert all(r.score == pytest.approx(float(v[q].astype(float) @ v[r.vec_id].astype(float)), abs=1e-9) for r in own)
        hits += len({r.vec_id for r in own} & set(ids))
    assert hits / (30 * 20) >= 0.95


def test_search_stops_early():
    """The test leaves out most of what is far, and less than half of what has no contrast."""
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(c, 0.05, (500, 16)) for c in (-3, 0, 3, 6)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert ann.searched_share(v, v[::50]) < 0.5
    centres = rng.normal(size=(200, 32))
    clumps = (centres[np.arange(6000) % 200] + 0.1 * rng.normal(size=(6000, 32))).astype(np.float32)
    clumps /= np.linalg.norm(clumps, axis=1, keepdims=True)
    assert ann.searched_share(clumps, clumps[::100]) < 0.03
    plain = rng.normal(size=(20_000, 64)).astype(np.float32)
    plain /= np.linalg.norm(plain, axis=1, keepdims=True)
    assert ann.searched_share(plain, plain[::400]) < 0.5
    assert ann.chi_square_bound(8, 0.95) == pytest.approx(15.507, abs=1e-3)


def test_cells_hold_their_places():
    rng = np.random.default_rng(6)
    places = rng.normal(size=(3000, ann.DIMS))
    places[:40] = places[0]
    cells = ann.Cells(places[::3], 12)
    at = cells.of(places)
    assert 8 <= cells.n <= 24 and set(at.tolist()) == set(range(cells.n))
    assert all((places >= cells.low[at]).all(axis=1)) and all((places <= cells.high[at]).all(axis=1))
    assert ann.Cells(places[:5], 12).n == 1 and ann.Cells(places[:0], 12).n == 1


def test_many_cells_and_a_very_common_vector(spark, monkeypatch):
    """A third of all rows are one vector; queries go only to cells that the test leaves."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16))
    v = (centres[rng.integers(0, 30, 3000)] + 0.15 * rng.normal(size=(3000, 16))).astype(np.float32)
    v[::3] = v[0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>")
    going = []
    asked = ann.asked

    def counted(cells, *rest):
        going.append(cells.n)
        return asked(cells, *rest)

    monkeypatch.setattr(ann, "asked", counted)
    got = ann.nearest(df, lambda c: c % 60 == 1, shard_rows=150).orderBy("query_id", "rank").collect()
    assert going[0] > 8
    hits = 0
    for q, ids, _ in brute_nearest(list(range(3000)), v, 20, lambda x: x % 60 == 1):
        own = [r.vec_id for r in got if r.query_id == q]
        assert len(own) == len(set(own)) == 20
        hits += len(set(own) & set(ids))
    assert hits / (50 * 20) >= 0.95


def test_an_id_with_two_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 0.0]), (1, [0.0, 5.0]), (2, [2.0, 0.1])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda c: c % 20 == 0).collect()
    # The query asks with [0, 1], which sorts first; the other rows of its own id are no candidates.
    assert sorted((r.rank, r.vec_id, round(r.score, 6)) for r in got) == [(1, 1, 5.0), (2, 2, 0.1)]


def test_ties_repeats_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(0, 60)] + [(60, [0.0, 0.0]), (61, None), (62, [nan, 1.0]), (63, [inf, 1.0]), (64, [None, 1.0]), (65, [1.0]), (66, [2.0, 1.0]), (None, [9.0, 9.0]), (5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "kind": F.lit(1), "shard": F.lit(1)})
    got = ann.nearest(df, lambda c: c % 20 == 0).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {0, 20, 40}
    assert [r.vec_id for r in got if r.query_id == 0] == [66, *range(1, 20)]
    assert [r.vec_id for r in got if r.query_id == 20] == [66, *range(0, 19)]


def test_few_candidates(spark):
    kind = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [-1.0, 0.0])], kind)
    assert [(r.rank, r.vec_id, r.score) for r in ann.nearest(few, lambda c: c % 20 == 0).orderBy("rank").collect()] == [(1, 1, 4.0), (2, 2, -1.0)]
    assert ann.nearest(few.limit(0), lambda c: c == 0).count() == 0
    assert ann.nearest(few.where("vec_id = 0"), lambda c: c == 0).count() == 0
