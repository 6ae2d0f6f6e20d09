"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .common import table
from .html_extract import extract_main_text
from .licenses import COPYRIGHT_LINE, KNOWN_NOTICES, KNOWN_TEXTS, PUNCTUATION, SPELLINGS, full_texts, scan_licenses
from .mixing import mix_sources
from .near_dedup import BANDS, near_duplicates
from .packing import conversation_examples, pack_documents, pack_examples
from .quality_classifier import classify, held_out
from .quality_rules import quality_rules
from .substring_dedup import remove_repeats
from .warc import round_trip

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = classify(docs.select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"))))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85, bands=BANDS)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs whole conversations, of which the assistant's turns bear loss, by op7's packer:
    here the limits of segments and of loss bind too."""
    examples = conversation_examples(table(spark, sf_dir, "conversations"), tokenizer_path())
    return pack_examples(examples, id_col="id", tokens_col="tokens", loss_col="loss_tokens", max_segments=8, max_loss=1024)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann_projections": op1,
        "op2_quality_classifier": op2,
        "op3_mixing_sources": op3,
        "op4_license_scan": op4,
        "op5_minhash_near_dedup": op5,
        "op6_substring_dedup": op6,
        "op7_packing": op7,
        "op8_quality_rules": op8,
        "op9_warc": op9,
        "op10_html_extraction": op10,
        "packing_of_conversations": conversations,
    }


WORDS = "list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def long_digests() -> list[tuple[str, str]]:
    """(id, digest) of the long licences, by the rules of the canonical form in plain Python."""
    out = []
    for name, text in full_texts():
        plain = re.sub("[^a-z0-9\n\x80-\U0010ffff]+", " ", text.lower())
        for other, usual in SPELLINGS:
            plain = plain.replace(other, usual)
        lines = [x for x in (line.strip(" ") for line in plain.split("\n")) if x and not re.search(COPYRIGHT_LINE, x)]
        out.append((name, hashlib.sha256(" ".join(lines).encode()).hexdigest()))
    return sorted(set(out))


def oracle_sql() -> dict[str, str]:
    words = WORDS.format(text="coalesce(text, '')")
    lower = WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    gaps = "[\\x20\\x09-\\x0D]+"
    quoted = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    plain = f"regexp_replace(lower(coalesce(text, '')), {quoted(PUNCTUATION)}, ' ', 'g')"
    for other, usual in SPELLINGS:
        plain = f"replace({plain}, {quoted(other)}, {quoted(usual)})"
    canonical = f"list_filter(list_transform(string_split({plain}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT regexp_matches(x, {quoted(COPYRIGHT_LINE)}))"
    known = lambda entries: f"(SELECT d, min(id) AS id FROM (SELECT id, sha256(array_to_string({canonical}, ' ')) AS d FROM (VALUES {', '.join(f'({quoted(i)}, {quoted(t)})' for i, t in entries)}) v(id, text)) GROUP BY 1)"
    normal = f"trim(lower(trim(regexp_replace(line, '{gaps}', ' ', 'g'), ' ')), ' ')"
    bare = "translate({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')"
    return {
        "op4_license_scan": f"""
WITH l AS (SELECT doc_id, {canonical} AS lines FROM documents),
whole AS (SELECT doc_id, CASE WHEN len(lines) > 0 THEN sha256(array_to_string(lines, ' ')) END AS digest FROM l),
hits AS (SELECT doc_id, id FROM (SELECT doc_id, unnest(lines) AS line FROM l) JOIN {known(KNOWN_NOTICES)} k ON sha256(line) = k.d),
found AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM hits GROUP BY 1)
SELECT whole.doc_id, digest, k.id AS license_id, CAST(coalesce(n, 0) AS BIGINT) AS n_notices, coalesce(ids, '') AS notice_ids
FROM whole LEFT JOIN (SELECT d, min(id) AS id FROM (SELECT * FROM {known(KNOWN_TEXTS)} UNION ALL SELECT * FROM (VALUES {', '.join(f"('{d}', '{i}')" for i, d in long_digests())}) v(d, id)) GROUP BY 1) k ON digest = k.d LEFT JOIN found USING (doc_id)""",
        "op8_quality_rules": f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {words} AS w FROM documents),
tri AS (SELECT doc_id, i, (w[i], w[i + 1], w[i + 2]) AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT doc_id, t FROM tri GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM tri SEMI JOIN twice USING (doc_id, t), (SELECT unnest([0, 1, 2]) AS j) GROUP BY 1),
line AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM w),
full_line AS (SELECT doc_id, source, line, {normal} AS norm FROM line WHERE {bare.format(x="line")} <> ''),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_line GROUP BY 1),
common AS (SELECT source, norm FROM full_line GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 20),
gone AS (SELECT doc_id, sum(length({bare.format(x="norm")})) AS n FROM full_line f SEMI JOIN common c ON f.source IS NOT DISTINCT FROM c.source AND f.norm = c.norm GROUP BY 1),
base AS (SELECT w.doc_id, len(w.w) AS n_words, length({bare.format(x="w.text")}) AS word_chars, length(w.text) - length(translate(w.text, '#*$%&|<>', '')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS removed_chars
FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, CAST(removed_chars AS BIGINT) AS removed_chars, NOT base_failed AND NOT (100 * (word_chars - removed_chars) < 30 * word_chars) AS kept
FROM judged""",
        "op9_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
o AS (SELECT d, max(page_id) AS owner FROM p WHERE n >= 1000 GROUP BY 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN owner IS NOT NULL AND owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM p LEFT JOIN o ON p.d = o.d AND p.n >= 1000""",
        # The tables' pages mark their article by an element of that name, which holds nothing
        # else; the operator never looks at that rule.
        "op10_html_extraction": r"""
WITH a AS (SELECT page_id, url, replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '<br>', ' ') AS inner_html FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(inner_html, '</?(p|h1)>'), lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t""",
        "op5_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {lower} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
sets AS (SELECT list_sort(s) AS s, min(doc_id) AS rep, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY 1, 3),
e AS (SELECT rep, n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.rep AS a, b.rep AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * i >= 85 * (na + nb - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (SELECT rep, rep FROM sets UNION SELECT l.b, r.root FROM reach r JOIN both_ways l ON l.a = r.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(roots.root, s.doc_id) AS component_id, coalesce(roots.root, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN sets ON list_sort(s.s) = sets.s LEFT JOIN roots ON roots.node = sets.rep""",
        "op6_substring_dedup": f"""
WITH w AS (SELECT doc_id, {words} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
least_doc AS (SELECT t, min(doc_id) AS d FROM win GROUP BY 1),
hit AS (SELECT DISTINCT doc_id, i FROM win JOIN least_doc USING (t) WHERE doc_id > d),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, (SELECT unnest(range(0, 50)) AS j)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    }
