"""Packing and WARC archives, by round trips."""

import gzip
import hashlib
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.llm import packing as pk
from meridian.llm import warc
from meridian.llm.queries import tokenizer_path

from .helpers import corpus, documents, prose


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


ODD = ["It's we'll DON'T can'tx '''s 's'", "ÀÉ ñandú Straße ŉ ſoft İstanbul ΑΣ ς", "é 日本語 12345 ½²x", "a\x1cb\x85c\xa0d", "<|endoftext|> z <|startoftext|>", "x_y ٣٤ ①", "​hi﻿", "Ÿÿ Ĳĳ ǅ ﬁ", "a\x0bb\x0cc\r\n", "\x00\x01 a\x7fb", "×÷ 5×3 ª º µ"]


def test_ids_equal_the_tokenizers(tokenizer, monkeypatch):
    texts = [t or "" for t in corpus()] + ODD
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for bound in (pk.REMEMBERED, 50):
        monkeypatch.setattr(pk, "REMEMBERED", bound)
        e = pk.Encoder(tokenizer_path())
        assert [x.tolist() for x in e.encode(texts)] == want
        assert [x.tolist() for x in e.encode(texts)] == want


def sequences(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.sequence_id].append(r)
    return {k: sorted(v, key=lambda r: r.offset) for k, v in out.items()}


@pytest.mark.parametrize("segments", [256, 4])
def test_pieces_hold_every_id_once(spark, tokenizer, segments):
    texts = corpus() + ODD + ["tiny"] * 300
    docs = documents(spark, texts).repartition(3).withColumns({c: F.lit(1) for c in ("start", "length", "offset")})
    rows = pk.pack_documents(docs, tokenizer_path(), max_segments=segments).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids[doc])
    assert set(by_doc) == set(ids)
    for own in sequences(rows).values():
        total = 0
        for r in own:
            assert r.offset == total
            total += r.length
        assert total <= 2048 and len(own) <= segments
        assert total & (total - 1) == 0  # full, or a power of two: nothing is padded


def test_packer_keeps_all_limits():
    rng = np.random.default_rng(0)
    packer = pk.Packer((100, 6, 40), 64, cutting=False)
    items = [pk.Item(i, 0, int(t), int(rng.integers(0, t + 1)), int(t)) for i, t in enumerate(rng.integers(1, 90, 500))]
    out = [s for x in items for s in packer.add(x)] + list(packer.fill(0))
    seen = sorted(x.doc for s in out for x in s)
    assert seen == list(range(500))
    for s in out:
        tokens, loss = sum(x.tokens for x in s), sum(x.loss for x in s)
        assert len(s) == 1 or (tokens <= 100 and len(s) <= 6 and loss <= 40)
    fits = [s for s in out if sum(x.loss for x in s) <= 40]
    assert len(out) < 1.25 * max(sum(x.tokens for x in items) / 100, sum(min(x.loss, 100) for x in items) / 40) and fits


def test_examples_are_packed_whole(spark):
    rows = [(i, 10 + i % 50, i % 20) for i in range(300)] + [(900, 5000, 10), (901, 10, 5000), (902, None, 3), (903, 0, 0), (None, 7, 7), (903, 0, 0)]
    df = spark.createDataFrame(rows, "id long, tokens long, loss long").coalesce(2)
    out = pk.pack_examples(df, id_col="id", tokens_col="tokens", loss_col="loss", max_tokens=128, max_segments=5, max_loss=30).collect()
    assert len(out) == len(rows)
    for own in sequences(out).values():
        tokens, loss = sum(r.tokens for r in own), sum(r.loss_tokens for r in own)
        assert len(own) <= 5 and (own[0].oversized or (tokens <= 128 and loss <= 30))
        assert [r.offset for r in own] == np.cumsum([0, *[r.tokens for r in own]])[:-1].tolist()
    assert [r.example_id for r in out if r.oversized] == [900]
    assert pk.pack_examples(df.limit(0), id_col="id", tokens_col="tokens", loss_col="loss").count() == 0
    assert pk.pack_documents(documents(spark, []), tokenizer_path()).count() == 0


def page_rows():
    big = "<p>" + prose(400, 1) + "</p>"
    rows = [(i, f"http://x/{i}", big) for i in range(0, 40)]
    rows += [(100 + i, f"http://y/{i}\r\nX: 1", f"<p>é{prose(300, 50 + i)}</p>") for i in range(30)]
    rows += [(200, "u", None), (201, "u", ""), (202, None, "small"), (203, "u", "small"), (204, "u", "a" * 999), (205, "u", "a" * 999), (206, "u", "b" * 1000), (207, "u", "b" * 1000), (208, "u", "é" * 500), (209, "u", "é" * 500)]
    rows += [(300, "u", "\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 200), (None, "u", big), (301, "u", prose(30000, 3))]
    return rows


def want_rows(rows):
    owner = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            owner[b] = max(owner.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        own = owner.get(b) if i is not None else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if own is not None and own != i else "response", own if own != i else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", [16 << 20, 900, 64])
def test_warc_round_trip(spark, split):
    rows = page_rows()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).withColumns({c: F.lit(1) for c in ("payload", "digest", "owner", "path")})
    out = warc.round_trip(df, split_bytes=split).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, out.collect()), key=repr) == want_rows(rows)


def test_every_split_owns_what_starts_in_it(tmp_path):
    path, starts = str(tmp_path / "a.warc.gz"), []
    rng = np.random.default_rng(2)
    with open(path, "wb") as out:
        for i in range(60):
            starts.append(out.tell())
            body = bytes(rng.integers(0, 256, int(rng.integers(0, 3000)), dtype=np.uint8)) + warc.MAGIC * 3 + gzip.compress(b"not a record")
            out.write(gzip.compress(warc.record(i, f"http://x/{i}", body, hashlib.sha1(body).hexdigest(), None)))
    size = os.path.getsize(path)
    for step in (1, 777, 4096, size) if size < 4000 else (333, 777, 4096, size + 9):
        found = [at for s in range(0, size, step) for at, _ in warc.records_of(path, s, s + step)]
        assert found == starts


def test_archives_are_plain_warc(spark, tmp_path):
    rows = [(1, "http://a/", "x" * 2000), (2, "http://b/", "x" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    (path,) = warc.write_archives(df, f"file://{tmp_path}/w")
    text = gzip.open(path.removeprefix("file://")).read().decode()
    assert text.count("WARC/1.1\r\n") == 2 and text.count("WARC-Type: revisit") == 1 and text.count("x" * 2000) == 1
    assert "WARC-Refers-To: <urn:x-page:2>" in text
    assert warc.round_trip(df.limit(0)).count() == 0
