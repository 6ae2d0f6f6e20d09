"""The pipeline's stages against brute force, and the queries on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as cp
from meridian.llm import queries as q
from meridian.llm.common import Work

from .helpers import documents, prose
from .test_dedup import brute_near, words

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage gave, as rows."""
    work = Work(spark, "test-pipeline")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet").select(cp.COLUMNS), []
    out.append([r.asDict() for r in docs.collect()])
    for name, stage in cp.STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir), name)
        assert docs.columns == cp.COLUMNS
        out.append([r.asDict() for r in docs.collect()])
    out.append([r.asDict() for r in cp.STAGES[-1][1](spark, docs, sf_dir).collect()])
    return out


def test_names():
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "minhash_near_dedup", "substring_dedup", "mixing_sources", "packing"]
    assert "pipeline" in entry.queries() and cp.ORACLE_SQL is None


def test_classifier_rejects_junk(stages, spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[1]}
    good = [d for d, v in labels.items() if v == 1]
    assert sum(d in kept for d in good) >= 0.97 * len(good)
    assert sum(d in kept for d, v in labels.items() if v == 0) <= 0.1 * len(labels)


def test_one_of_each_group_stays(stages):
    docs = sorted(stages[1], key=lambda r: r["doc_id"])
    want = [docs[i]["doc_id"] for i, _, _, kept in brute_near([r["text"] for r in docs], 5, 80) if kept]
    assert sorted(r["doc_id"] for r in stages[2]) == want


def test_no_window_is_left_twice(stages):
    """No 50 words of a document are left that the stage's input held in an earlier one."""
    first = {}
    for r in sorted(stages[2], key=lambda r: r["doc_id"]):
        w = words(r["text"])
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), r["doc_id"])
    for r in stages[3]:
        w = words(r["text"])
        before = {r2["doc_id"]: len(words(r2["text"])) for r2 in stages[2]}[r["doc_id"]]
        if len(w) < before:
            assert r["n_chars"] == len(r["text"])
        else:
            assert all(first[tuple(w[i : i + 50])] >= r["doc_id"] for i in range(len(w) - 49))


def test_mix_and_pack(stages):
    n = lambda rows: sum(len(words(r["text"])) for r in rows)
    assert n(stages[4]) == pytest.approx(n(stages[3]), rel=0.05)
    copies = {}
    for r in stages[4]:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 3
    pieces = stages[5]
    assert {r["doc_id"] for r in pieces} == set(copies)
    for d in copies:
        own = [r for r in pieces if r["doc_id"] == d]
        assert sum(r["length"] for r in own) == own[0]["doc_tokens"] * copies[d]


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    from ..test_oracles import arrow, rows
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert rows(q.queries()[name](spark, sf_dir).toArrow()) == rows(arrow(con.sql(q.oracle_sql()[name])))


def test_every_query_runs(spark, sf_dir):
    for name, f in q.queries().items():
        if name not in q.oracle_sql():
            assert f(spark, sf_dir).count() > 0


def test_nothing_else_imports_the_subpackage():
    import pathlib
    root = pathlib.Path(entry.__file__).parent / "meridian"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()


def test_a_shared_passage_is_one_cut_a_document(spark, monkeypatch):
    """In one piece of a batch, however many runs of windows the passage has."""
    frame, made = type(spark.range(1)), []
    plain = frame.mapInArrow

    def seen(df, run, schema, *args, **kwargs):
        out = plain(df, run, schema, *args, **kwargs)
        if "cut_from" in str(schema):
            made.append(out)
        return out

    monkeypatch.setattr(frame, "mapInArrow", seen)
    passage = prose(150, 6)
    for n in (20, 40):
        docs = documents(spark, [f"{prose(20, 10 + i)} {passage} {prose(20, 90 + i)}" for i in range(n)]).coalesce(1)
        out = {r.doc_id: r.text for r in cp.cut_repeats(spark, docs, None).collect()}
        assert all(len(words(out[i])) == (190 if i == 0 else 40) for i in range(n))
        assert sorted(map(tuple, made[-1].collect())) == [(i, 20, 170) for i in range(1, n)]
