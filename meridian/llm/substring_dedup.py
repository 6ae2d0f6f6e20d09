"""Exact removal of repeated passages by Rabin-Karp hashes of every fixed-length window.

Every window of ``width`` consecutive words of a document is hashed with a rolling
polynomial. Neighbouring windows that share a minimizer (the smallest hash of the
``GRAM``-word runs inside a window) travel together as one record to the partition that
the minimizer names, so equal windows always meet. There all windows are counted, and
each one whose word sequence also starts in a document with a smaller id comes back as
part of a removal interval; overlapping intervals are merged and cut out.

Equal windows of one piece of a batch are combined before the shuffle: only the piece's
smallest document of a window travels, so a passage that a third of all documents hold sends
one record for each piece; what the other documents of the piece repeat is one interval for
each stretch of their words, whatever its minimizers. A run of words that is frequent among
different passages (a greeting, a slogan) would draw all their windows to one task as their
minimizer; such minimizers are found by counting different windows on a sample of the
documents (copies of a window count as often as they can travel, once for each piece), and
their windows are dealt by their own hash instead. The sample decides only where windows are
counted.

Windows are equal if their 64-bit hashes are: of n different windows some n^2 / 2^65 pairs
are taken for equal wrongly, one in 10^10 windows of a corpus of 10^9.

Defined results: null or empty texts have no words and stay as they are; texts shorter
than a window lose nothing; repeats inside one document only are kept; of rows with
equal ids, which must hold one text, none removes the other's words; rows with a null id take
no part and stay whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import scratch
from .common import WordHashes, hashed_words, mix, pieces, segments, spread, tidy

GRAM = 8
BASE = 0x9E3779B97F4A7C1D | 5
#: Bytes of the texts that a task combines before the shuffle (about 40 times as many at work).
PIECE = 1_000_000
#: Bytes of texts whose cut forms are held at a time.
APPLIED = 4_000_000
#: One document of so many is in the sample that finds frequent minimizers; how many windows
#: one must draw there; how many such minimizers may be sent to every task (8 bytes each).
SAMPLED, FEW, HOT = 64, 200, 50_000
#: One window in so many, by its hash, is counted in the sample's documents.
THINNED = 8
#: Marks the totals of all rows among the sample's counts.
PIECES, BYTES = 0, 1
#: Marks cuts that a batch has settled itself.
SETTLED = -1

RUNS = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary()), ("lengths", pa.binary())])
CUTS = pa.schema([("doc", pa.int64()), ("cut_from", pa.int32()), ("cut_to", pa.int32())])


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    have = 1
    step = base
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


def rolling(flat: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2^64, of all runs of ``width`` values."""
    n = len(flat) - width + 1
    if n <= 0:
        return flat[:0]
    up = powers(BASE, len(flat))
    down = powers(pow(BASE, -1, 1 << 64), n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat * up, dtype=np.uint64)])
    return mix((sums[width:] - sums[:n]) * down)


def least_in_runs(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def spans(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merges sorted half-open intervals that overlap or touch into maximal ones."""
    out: list[tuple[int, int]] = []
    for a, b in intervals:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def minimizers(flat: np.ndarray, width: int) -> np.ndarray:
    """The minimizer of each window of consecutive words."""
    return least_in_runs(rolling(flat, GRAM), width - GRAM + 1) if width > GRAM else rolling(flat, width)


def drawn(width: int):
    """(minimizer, window, sampled texts that hold it) of one window in THINNED, and of all rows
    (null, PIECES, how many they make) and (null, BYTES, size of their texts)."""

    def run(batches):
        hashes, kinds = WordHashes(), ["least", "win", "n"]
        for batch in batches:
            least, windows = [], []
            for text in (t for _, _, texts in pieces(batch.column(0)) for t in texts):
                flat, _ = hashed_words([text], hashes)
                win = rolling(flat, width)
                some = np.flatnonzero(win % np.uint64(THINNED) == 0)
                if len(some):
                    own, at = np.unique(win[some], return_index=True)
                    least.append(minimizers(flat, width)[some[at]])
                    windows.append(own)
            size = int(np.nansum(batch.column(1).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([None, None], [PIECES, BYTES], [-(-size // PIECE), size])], names=kinds)
            if least:
                own, at, count = np.unique(np.concatenate(windows), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(least)[at].view(np.int64), own.view(np.int64), count.astype(np.int64))], names=kinds)

    return run


def hot_minimizers(counts: DataFrame, width: int, windows_a_bucket: float, n_pieces: int) -> np.ndarray:
    """Minimizers that seem to draw more than half a bucket's windows, at most HOT of them,
    the most frequent first.

    Copies of one window travel once for each piece, so more of them draw no more."""
    met = F.least(F.col("n").cast("double"), F.lit(max(1.0, n_pieces / SAMPLED)))
    drawn_by = counts.where("least is not null").groupBy("least").agg((F.sum(met) * THINNED).alias("n"))
    rows = drawn_by.where(F.col("n") > max(FEW, windows_a_bucket / 2 / SAMPLED)).orderBy(F.desc("n"), "least").limit(HOT).collect()
    return np.sort(np.array([r.least for r in rows], np.int64).view(np.uint64))


def windows(width: int, buckets: int, hot: np.ndarray):
    """Records of windows that share a minimizer, and cuts that a batch can settle itself."""

    def piece(ids: np.ndarray, texts: list, hashes: WordHashes):
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        flat, counts = hashed_words([texts[i] for i in order], hashes)
        win = rolling(flat, width)
        if not len(win):
            return None
        starts = np.cumsum(counts) - counts
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), counts)[: len(win)]
        pos = (np.arange(len(win)) - starts[doc]).astype(np.int32)
        whole = np.flatnonzero(pos + width <= counts[doc])
        if not len(whole):
            return None
        least = minimizers(flat, width)[whole]
        win, doc, pos = win[whole], doc[whole], pos[whole]
        if len(hot):
            at = np.minimum(np.searchsorted(hot, least), len(hot) - 1)
            least = np.where(hot[at] == least, win, least)
        first_id = ids[doc]
        # Only a window's smallest document in this piece travels; the rest is cut by it.
        by = np.lexsort((first_id, win))
        new = np.concatenate([[True], win[by][1:] != win[by][:-1]])
        smallest = np.empty(len(win), np.int64)
        smallest[by] = first_id[by][new][np.cumsum(new) - 1]
        travels = first_id == smallest
        # A run: neighbours in one document, all cut or all travelling to one minimizer.
        edge = np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (travels[1:] != travels[:-1]) | (travels[1:] & (least[1:] != least[:-1]))])
        at = np.flatnonzero(edge)
        length = np.diff(np.concatenate([at, [len(win)]])).astype(np.int32)
        cut, held = at[~travels[at]], travels[at]
        cut_length = length[~held]
        rows = []
        if len(cut):
            rows.append((SETTLED, b"", ids[doc[cut]].tobytes(), pos[cut].tobytes(), (pos[cut] + cut_length + width - 1).astype(np.int32).tobytes()))
        at, length = at[held], length[held]
        bucket = (least[at] % np.uint64(buckets)).astype(np.int32)
        to = np.argsort(bucket, kind="stable")
        at, length, bucket = at[to], length[to], bucket[to]
        ends = np.cumsum(length)
        value = win[np.repeat(at - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(bucket) else [0]
        for b0, b1 in zip(bounds[:-1], bounds[1:]):
            some = at[b0:b1]
            rows.append((int(bucket[b0]), value[ends[b0] - length[b0] : ends[b1 - 1]].tobytes(), ids[doc[some]].tobytes(), pos[some].tobytes(), length[b0:b1].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), RUNS.types)], schema=RUNS)

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for start, end, texts in pieces(batch.column(1), PIECE):
                out = piece(ids[start:end], texts, hashes)
                if out is not None:
                    yield out

    return run


def counted(width: int):
    """Counts the windows of whole buckets; gives the intervals that repeat an earlier document."""

    def settle(rows: list) -> pa.RecordBatch:
        win = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows])
        ids = np.concatenate([np.frombuffer(r[1], np.int64) for r in rows])
        pos = np.concatenate([np.frombuffer(r[2], np.int32) for r in rows])
        length = np.concatenate([np.frombuffer(r[3], np.int32) for r in rows])
        run = np.repeat(np.arange(len(ids), dtype=np.int32), length)
        by = np.argsort(win, kind="stable")
        new = np.concatenate([[True], win[by][1:] != win[by][:-1]])
        group = np.cumsum(new) - 1
        several = np.bincount(group) > 1
        again = several[group]
        by, group = by[again], group[again]
        if not len(by):
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in CUTS.types], schema=CUTS)
        at = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
        own = ids[run[by]]
        least = np.minimum.reduceat(own, at)[np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))]
        hit = np.sort(by[own > least])
        r = run[hit]
        offset = hit - (np.cumsum(length) - length)[r]
        p = pos[r] + offset.astype(np.int32)
        if not len(hit):
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in CUTS.types], schema=CUTS)
        edge = np.concatenate([[True], (r[1:] != r[:-1]) | (hit[1:] != hit[:-1] + 1)])
        last = np.concatenate([np.flatnonzero(edge)[1:] - 1, [len(hit) - 1]])
        return pa.RecordBatch.from_arrays([pa.array(ids[r[edge]]), pa.array(p[edge], type=pa.int32()), pa.array((p[last] + width).astype(np.int32), type=pa.int32())], schema=CUTS)

    def run(batches):
        bucket, rows = None, []
        for batch in batches:
            for b, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if b == SETTLED:
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, t)) for x, t in zip(row[1:], (np.int64, np.int32, np.int32))], schema=CUTS)
                    continue
                if b != bucket and rows:
                    yield settle(rows)
                    rows = []
                bucket = b
                rows.append(row)
        if rows:
            yield settle(rows)

    return run


def cut_out(text: str | None, intervals: list[tuple[int, int]]) -> tuple[int, int, bytes | None, str]:
    """(words, removed words, kept words joined by one space or None if all, their digest)."""
    digest, kept, n, gone, first = hashlib.sha256(), [], 0, 0, True
    for part in segments(text.encode("utf-8", "surrogatepass") if text else b""):
        words = part.split()
        if intervals:
            own, at = [], 0
            for a, b in intervals:
                own += words[at : max(a - n, at)]
                at = max(at, min(b - n, len(words)))
            own += words[at:]
            n, gone, words = n + len(words), gone + len(words) - len(own), own
        else:
            n += len(words)
        if words:
            run = (b"" if first else b" ") + b" ".join(words)
            digest.update(run)
            first = False
            if intervals:
                kept.append(run)
    return n, gone, b"".join(kept) if gone else None, digest.hexdigest()


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 50, words_a_bucket: int = 1_500_000) -> DataFrame:
    """The rows with (n_words, n_removed, kept_text, kept_sha256): repeated passages are cut out.

    kept_text is the text itself where nothing is cut, else the kept words joined by one
    space; kept_sha256 is the digest of the kept words joined by one space. All other
    columns stay; input columns of those four names are replaced.
    """
    spark = docs.sparkSession
    added = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType())])
    rest = docs.drop(*(set(added.names) - {id_col, text_col}))
    read = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null")
    # One pass gives the size of all texts and the sample's minimizers.
    picked = F.when(F.pmod(F.xxhash64(F.lit("sample"), "doc"), F.lit(SAMPLED)) == 0, F.col("text")).alias("text")
    counts = read.select(picked, F.octet_length("text").cast("long").alias("n")).mapInArrow(tidy(drawn(width)), "least long, win long, n long")
    counts = scratch(counts.groupBy("least", "win").agg(F.sum("n").alias("n")), "minimizers")
    totals = {r.win: r.n for r in counts.where("least is null").collect()}
    n_pieces, chars = totals.get(PIECES, 0), totals.get(BYTES, 0)
    # About 32 MB of text, and so 48 MB of hashes, for each task that counts.
    parts = max(spread(spark), chars // 32_000_000)
    buckets = max(4 * parts, chars // 6 // words_a_bucket + 1)
    hot = hot_minimizers(counts, width, chars / 6 / buckets, n_pieces)
    runs = read.mapInArrow(tidy(windows(width, buckets, hot)), "bucket int, hashes binary, docs binary, starts binary, lengths binary")
    # Cuts settled within a batch are dealt out by what they hold, buckets by their number.
    dealt = runs.repartition(parts, F.when(F.col("bucket") >= 0, F.col("bucket").cast("long")).otherwise(F.xxhash64("docs", "starts"))).sortWithinPartitions("bucket")
    cuts = dealt.mapInArrow(tidy(counted(width)), "doc long, cut_from int, cut_to int")
    merged = cuts.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("cut_from", "cut_to"))).alias("__cuts"))
    joined = rest.join(merged, rest[id_col].cast("long") == merged["doc"], "left").drop(merged["doc"])
    schema = T.StructType(rest.schema.fields + added.fields)
    text_at = rest.columns.index(text_col)

    def apply(batches):
        for batch in batches:
            columns = batch.columns
            cuts = columns.pop().to_pylist()
            for start, end, texts in pieces(columns[text_at].cast(pa.string()), APPLIED):
                rows = []
                for text, cut in zip(texts, cuts[start:end]):
                    total, gone, kept, digest = cut_out(text, spans([(x["cut_from"], x["cut_to"]) for x in cut or ()]))
                    rows.append((total, gone, text if kept is None else kept.decode("utf-8", "surrogatepass"), digest))
                n, gone, kept, digest = zip(*rows)
                yield pa.RecordBatch.from_arrays([*(c.slice(start, end - start) for c in columns), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(digest, pa.string())], names=schema.names)

    return joined.mapInArrow(tidy(apply), schema)
