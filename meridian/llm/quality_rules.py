"""Rule-based document quality with cross-document line frequency, in SQL functions only.

Base figures come from each text alone. Lines are then normalised (white space runs to
one space, trimmed, lower case) and hashed, once; a line that occurs in more than
``max_docs_per_host`` documents of one host is boilerplate there and removed, and a
document that keeps less than ``min_kept_percent`` of its line characters is rejected.
A hot line never meets in one place: its documents are told apart by (line, id), and
their count is combined before the shuffle.

Defined results: a null text is an empty one and fails the base rule; a null host is a
host of its own; rows that share an id are one document in a line's count, and each is
judged by its own text; rows without an id are judged, but count for no line. Words are
runs of characters other than space and \\x09-\\x0D.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Work

GAPS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"


def words(text):
    """The words of a text column as an array."""
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAPS))


def base_figures(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast("array<bigint>")
    step = docs.withColumn("__text", text).withColumn("__w", words(F.col("__text")))
    step = step.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != ""))
    # Hashes of all windows of three words; nothing more is done where they all differ.
    step = step.withColumn("__tri", F.when(F.size("__w") < 3, none).otherwise(F.transform(F.slice("__w", F.lit(1), F.greatest(F.size("__w") - 2, F.lit(1))), lambda x, i: F.xxhash64(x, F.get("__w", i + 1), F.get("__w", i + 2)))))
    step = step.withColumn("__sorted", F.when(F.size(F.array_distinct("__tri")) == F.size("__tri"), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.sort_array(F.transform("__tri", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get("__sorted", j)["h"] == x["h"], F.lit(False))
    step = step.withColumn("__pos", F.sort_array(F.transform(F.filter("__sorted", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    # A window covers three words, fewer where the next repeated window starts earlier.
    covered = F.aggregate(F.transform("__pos", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("__pos", k + 1) - p, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    step = step.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.translate("__text", WHITE, "")).cast("long"),
        "n_symbols": (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": covered,
    })
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return step.withColumn("base_failed", failed).drop("__text", "__w", "__lines", "__tri", "__sorted", "__pos")


def normal_line(line):
    return F.lower(F.btrim(F.regexp_replace(line, GAPS, " "), F.lit(WHITE)))


#: Frequent lines that may be sent to every task (their hashes, 8 bytes each), and parts
#: into which the documents of one line are dealt where there are more.
SENT_LINES, LOTS = 500_000, 16
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, max_docs_per_host: int, min_kept_percent: int, with_text: bool) -> DataFrame:
    spark = docs.sparkSession
    work = Work(spark, "quality-rules")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host"))
    line_hash = lambda x: F.xxhash64(F.col("host").isNull(), F.col("host"), x)
    lines = F.transform(F.filter(F.transform(F.split("text", "\n"), normal_line), lambda x: x != ""), lambda x: F.struct(line_hash(x).alias("h"), F.length(F.translate(x, WHITE, "")).cast("long").alias("chars")))
    # The one pass over the texts. Its result is written with a number for each row, which
    # therefore stays the same however often tasks are repeated.
    rows = base_figures(slim, "text").withColumn("lines", lines).withColumn("row", F.monotonically_increasing_id())
    rows = work.keep(rows.select("row", "doc_id", *FIGURES, "lines", *(["text", "host"] if with_text else [])), "rows")
    each = rows.select("row", "doc_id", F.inline("lines"))
    seen = each.where("doc_id is not null").select("h", "doc_id").distinct()
    common = work.keep(seen.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > max_docs_per_host).select("h"), "frequent")
    if common.limit(SENT_LINES + 1).count() <= SENT_LINES:
        hits = each.join(F.broadcast(common), "h")
    else:  # a line's documents are dealt to several tasks
        hits = each.withColumn("lot", F.pmod("row", F.lit(LOTS))).join(common.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LOTS - 1).cast("long")))), ["h", "lot"])
    gone = hits.groupBy("row").agg(F.sum("chars").alias("gone"), *([F.collect_set("h").alias("gone_lines")] if with_text else []))
    out = rows.drop("lines").join(gone, "row", "left").withColumn("removed_chars", F.coalesce("gone", F.lit(0).cast("long")))
    depleted = 100 * (F.col("word_chars") - F.col("removed_chars")) < min_kept_percent * F.col("word_chars")
    columns = ["doc_id", *FIGURES, "removed_chars", (~F.col("base_failed") & ~depleted).alias("kept")]
    if with_text:
        stays = lambda x: (normal_line(x) == "") | ~F.array_contains("gone_lines", line_hash(normal_line(x)))
        cleaned = F.when(F.col("gone_lines").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), stays), "\n"))
        columns.append(F.coalesce(cleaned, F.lit("")).alias("text"))
    return out.select(*columns)


def cleaned_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs_per_host: int = 20, min_kept_percent: int = 30) -> DataFrame:
    """One row per input row: doc_id, the base figures, removed_chars, kept, and the text
    without its lines above the limit (of rejected documents too; "" for a null text).

    Other lines, blank ones among them, stay as they are and in their order.
    removed_chars counts the characters of words in lines above the limit; a document is
    depleted if fewer than ``min_kept_percent`` percent of its word_chars are left.
    """
    return judged(docs, id_col, text_col, host_col, max_docs_per_host, min_kept_percent, True)


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs_per_host: int = 20, min_kept_percent: int = 30) -> DataFrame:
    """The figures of cleaned_documents, without the texts, which are then not written either."""
    return judged(docs, id_col, text_col, host_col, max_docs_per_host, min_kept_percent, False)
