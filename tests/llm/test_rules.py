"""Quality rules, licence scan and mixing."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meridian.llm import licenses as lic
from meridian.llm.common import Work
from meridian.llm.mixing import mix_sources, source_targets
from meridian.llm.quality_rules import quality_rules

from .helpers import corpus, documents, prose

GAPS = re.compile("[^\x20\x09-\x0d]+")


def brute_rules(rows, limit=20, least=30):
    """rows: (id, text, host)"""
    hosts = Counter()
    lines = [[" ".join(GAPS.findall(line)).lower() for line in (t or "").split("\n") if GAPS.search(line)] for _, t, _ in rows]
    for host, x, _ in {(host, x, key) for (key, _, host), own in zip(rows, lines) for x in own if key is not None}:
        hosts[host, x] += 1
    out = []
    for (key, t, host), own in zip(rows, lines):
        t = t or ""
        w = GAPS.findall(t)
        tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        raw = [x for x in t.split("\n") if GAPS.search(x)]
        chars = sum(map(len, w))
        gone = sum(len(x.replace(" ", "")) for x in own if hosts[host, x] > limit)
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        out.append((key, len(w), chars, sum(c in "#*$%&|<>" for c in t), len(raw) - len(set(raw)), len(rep), failed, gone, not failed and not 100 * (chars - gone) < least * chars))
    return out


def test_rules_equal_brute_force(spark):
    boiler = "Sign up  NOW | it's free"
    texts = corpus() + [f"{boiler}\n{prose(60, 200 + i)}\n \n{boiler if i % 3 == 0 else 'x#y'}" for i in range(25)] + ["\n".join([boiler] * 40 + ["own line of this one"])] + ["a b c\na b c\n\n a b c\n" * 20]
    shared = "\n".join(prose(8, 900 + k) for k in range(12))
    texts += [f"{shared}\n{prose(10, 950 + k)}" for k in range(30)]
    rows = [(i, t, f"h{i % 2}" if i % 7 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("host", "lines", "h", "words", "row_key", "gone")})
    got = sorted(map(tuple, quality_rules(df, max_docs_per_host=5).collect()))
    assert got == brute_rules(rows, 5)
    assert any(r[7] for r in got) and any(not r[6] and not r[8] for r in got)


def test_rules_null_ids_repeats_and_empty(spark):
    """A line counts the documents that hold it, by id; rows alone count nothing."""
    t = prose(60, 1)
    rows = [(None, t, "h"), (None, t, "h"), (1, t, None), (1, t, None), (2, None, "h"), (3, t, "a"), (3, t + "\n" + prose(9, 2), "a"), (4, t, "b"), (5, t, "b"), (None, t, "b")]
    rows += [(10 + i // 2, prose(70, 500 + i) + "\nnotice", "twice") for i in range(22)]
    schema = "doc_id long, text string, source string"
    for limit in (1, 10, 11, 20):
        got = sorted(map(tuple, quality_rules(spark.createDataFrame(rows, schema), max_docs_per_host=limit).collect()), key=repr)
        assert got == sorted(brute_rules(rows, limit), key=repr)
        gone = [r[7] for r in got if r[0] and r[0] >= 10]
        assert all(g == (6 if limit < 11 else 0) for g in gone)
    assert quality_rules(spark.createDataFrame([], schema)).count() == 0


def test_rules_with_many_frequent_lines(spark, monkeypatch):
    """Where frequent lines are too many to be sent, they meet their documents in a join."""
    from meridian.llm import quality_rules as module

    texts = [f"{prose(60, i)}\ncommon words here\n" + "\n".join(f"shared {k}" for k in range(i % 7)) for i in range(40)]
    rows = [(i, t, "h") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(module, "SENT_LINES", 1)
    assert sorted(map(tuple, quality_rules(df, max_docs_per_host=5).collect())) == brute_rules(rows, 5)


def test_native_plans(spark, monkeypatch):
    """No operator of this kind has a Python worker or a join of all pairs in any of its jobs."""
    plans, keep = [], Work.keep

    def kept(work, df, name):
        plans.append(df._jdf.queryExecution().toString())
        return keep(work, df, name)

    monkeypatch.setattr(Work, "keep", kept)
    docs = documents(spark, corpus()[:9])
    for f in (quality_rules, lic.scan_licenses, mix_sources):
        plans.append(f(docs)._jdf.queryExecution().toString())
    assert len(plans) > 6
    for plan in plans:
        assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_licences_of_repeated_rows(spark):
    text = "some words\nReleased under the MIT License."
    docs = documents(spark, [text, "x"])
    got = lic.scan_licenses(docs.unionAll(docs).unionAll(docs.selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars"))).collect()
    assert sorted((r.doc_id is None, r.n_notices, r.notice_ids) for r in got) == sorted([(False, 1, "MIT"), (False, 0, "")] * 2 + [(True, 1, "MIT"), (True, 0, "")])


def test_licence_texts_in_other_forms(spark):
    mit = dict(lic.KNOWN_TEXTS)["MIT-0"] and next(t for i, t in lic.KNOWN_TEXTS if i == "MIT")
    texts = [
        "Copyright (c) 2020 Someone\n\n" + mit,
        mit.upper().replace(" ", "\n  "),
        mit.replace("sublicense", "sub-licence").replace("copyright holders", "copyright owners"),
        "© 2021 X. All rights reserved.\n" + mit + "\n\nAll rights reserved.",
        mit + " And more.",
        "Licensed under the Apache License, Version 2.0.\nsome text\nRELEASED under the MIT Licence\nreleased under the MIT license.",
        "Copyright 2020 nobody",
        None, "", " \n ",
        next(t for i, t in lic.KNOWN_TEXTS if i == "BSD-3-Clause"),
    ]
    got = {r.doc_id: r for r in lic.scan_licenses(documents(spark, texts).withColumns({c: F.lit(0) for c in ("digest", "license_id", "lines", "n")})).collect()}
    assert [got[i].license_id for i in range(5)] == ["MIT", "MIT", "MIT", "MIT", None]
    assert (got[5].n_notices, got[5].notice_ids, got[5].license_id) == (3, "Apache-2.0,MIT", None)
    assert all(got[i].digest is None and got[i].n_notices == 0 for i in (6, 7, 8, 9))
    assert got[10].license_id == "BSD-3-Clause"
    assert lic.scan_licenses(documents(spark, [])).count() == 0


def test_known_digests_are_distinct(spark):
    for entries in (lic.KNOWN_TEXTS, lic.KNOWN_NOTICES):
        known = lic.known(spark, entries).collect()
        assert len({r.digest for r in known}) == len(known) and {r.license_id for r in known} == {i for i, _ in entries}


def water(sizes, weights, cap):
    """sizes by source in order; shares by weight, the excess shared again."""
    target, open_, total = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        left = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
        share = left / sum(weights[i % len(weights)] for i in open_)
        over = {i for i in open_ if share * weights[i % len(weights)] > cap * sizes[i]}
        for i in over or open_:
            target[i] = cap * sizes[i] if over else share * weights[i % len(weights)]
        open_ = open_ - over if over else set()
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100, 100], [1000, 10, 10, 10, 5], [3, 3000, 1], [0, 50, 70], [7]])
def test_targets(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    rows = spark.createDataFrame([(n, s, 1) for n, s in zip(names, sizes)], "source string, size long, n long")
    got = {r.source: r.target for r in source_targets(rows, [1, 2, 3], 3).collect()}
    assert [got[n] for n in names] == pytest.approx(water(sizes, [1, 2, 3], 3))


def brute_rates(sizes, target, cap=3.0):
    """The tilt by bisection."""
    mean = sum(sizes) / len(sizes)
    low, high = -1e3, 1e3
    for _ in range(300):
        lam = (low + high) / 2
        got = sum(s * min(cap, math.exp(min(50, lam * s / mean))) for s in sizes)
        low, high = (lam, high) if got < target else (low, lam)
    return [min(cap, math.exp(min(50, low * s / mean))) for s in sizes]


def test_mix_meets_targets(spark):
    import random
    r = random.Random(4)
    texts = [prose(max(1, int(r.lognormvariate(3.5, 1))), i) for i in range(900)] + [None, "", "  ", prose(2500, 1)]
    sources = {i: ("hot" if i % 3 == 0 else None if i % 17 == 0 else f"s{i % 5}") for i in range(len(texts))}
    docs = documents(spark, texts, sources).withColumns({c: F.lit(1) for c in ("size", "rate", "free", "weight", "target")})
    out = mix_sources(docs).collect()
    again = mix_sources(docs.repartition(7)).collect()
    assert sorted((x.doc_id, x.taken) for x in out) == sorted((x.doc_id, x.taken) for x in again)
    assert {x.doc_id: x.size for x in out} == {i: len((t or "").split()) for i, t in enumerate(texts)}
    assert all(0 <= x.copies <= 3 and x.taken == x.copies * x.size for x in out) and len(out) == len(texts)
    order = sorted({s for s in sources.values() if s}) + [None]
    by = {s: [x for x in out if x.source == s] for s in order}
    want = water([sum(x.size for x in by[s]) for s in order], [1, 2, 3], 3)
    for s, target in zip(order, want):
        rows = by[s]
        assert rows[0].target == pytest.approx(target) and rows[0].source_size == sum(x.size for x in rows)
        assert sum(x.taken for x in rows) == pytest.approx(target, abs=max(3, 0.005 * target))
        assert [x.rate for x in rows if x.size] == pytest.approx([a for a, x in zip(brute_rates([x.size for x in rows], target), rows) if x.size], abs=1e-4)


def test_mix_odd_tables(spark):
    assert mix_sources(documents(spark, [])).count() == 0
    assert [r.taken for r in mix_sources(documents(spark, [None, "", " "])).collect()] == [0, 0, 0]
    one = mix_sources(documents(spark, ["a b c d"])).first()
    assert (one.size, one.target, one.taken) == (4, 4.0, 4)
    same = mix_sources(spark.createDataFrame([(None, "a b", "x"), (5, "a b", "x"), (5, "a b", "x")], "doc_id long, text string, source string")).collect()
    assert len(same) == 3 and sum(r.taken for r in same) in (4, 6, 8)


def test_mix_rows_that_share_an_id(spark):
    """Rows of one id, or of none, are judged by their own sizes, and keep their own columns."""
    import random
    r = random.Random(8)
    rows = [(None if i % 3 == 0 else i // 2, prose(1 + r.randrange(300), i), f"s{i % 4}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = mix_sources(df, carry=["text", "n_chars"]).collect()
    assert sorted((x.doc_id or -1, x.carried.text, x.carried.n_chars, x.source) for x in got) == sorted((d or -1, t, n, s) for d, t, s, n in rows)
    assert all(x.size == len(x.carried.text.split()) and 0 <= x.copies <= 3 and x.taken == x.copies * x.size for x in got)
    of = {}
    for x in got:
        of.setdefault((x.doc_id, x.source, x.size), set()).add(x.copies)
    assert all(len(v) == 1 for v in of.values())
    for s in {x.source for x in got}:
        own = [x for x in got if x.source == s]
        assert sum(x.taken for x in own) == pytest.approx(own[0].target, rel=0.05)  # few ids have one row and may settle a remainder
