"""Document quality by random indexing and a small neural network.

Word vectors: every token (the letters of a word, its marks, its letter case, a repeat of
the token before) falls into one of ``ROWS`` hashed rows, and each row sums the sparse
ternary index vectors of its neighbours over the whole corpus. A document is the weighted
mean of its rows' vectors, and of how far they scatter. A network of two layers in numpy
scores it, and a temperature fitted on labelled rows that it was not trained on makes the
scores probabilities.

The table of word vectors has a fixed size (ROWS * DIM floats, 2 MB), so it may be sent
everywhere. Corpus counts cover all texts. The network is fitted on at most ``max_labels``
labelled documents, those of smallest hash: a bound on the driver's memory.

Defined results: null and empty texts get the score of a zero vector; without labels of
both kinds every score is the share of label 1 (0.5 without any); of several labels of
one document the mean counts, 1 on a tie; null labels or ids don't train.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import REMEMBERED_WORDS, pieces, segments, spread, tidy

#: Hashed rows of the word table (a power of two), the vectors' length and the entries
#: of an index vector that are not zero; neighbours up to REACH tokens away count.
ROWS, DIM, ENTRIES, REACH = 1 << 14, 32, 4, 2
#: Rows of the table that one record carries between tasks.
CHUNK = 1024
#: Rows that attributes of words have for themselves.
UPPER, TITLE, REPEAT, DIGIT = 0, 1, 2, 3
OWN_ROWS = 4
#: A document's inputs: mean and scatter of its vectors, shares of the own rows, neighbours'
#: likeness, length.
WIDTH = 2 * DIM + OWN_ROWS + 2
#: Tokens whose vectors are held at a time (some 500 bytes each, copies included).
TOKENS_AT_ONCE = 65_536
MAX_LABELS = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 24, 60, 0.01, 1e-4


class TokenRows(dict):
    """The rows of a white-space separated part: its letters, then its marks and case."""

    def __missing__(self, part: bytes) -> tuple[int, ...]:
        text = part.decode("utf-8", "replace")
        left = text.lstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        core = left.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        marks = text[: len(text) - len(left)], left[len(core) :]
        rows = []
        if core:
            low = core.lower()
            if core.isdigit():
                rows.append(DIGIT)
            else:
                rows.append(self.row(low))
                if len(core) > 1 and core.isupper():
                    rows.append(UPPER)
                elif core[0].isupper():
                    rows.append(TITLE)
        rows += [self.row(m) for m in marks if m]
        out = tuple(rows)
        if len(self) < REMEMBERED_WORDS:
            self[part] = out
        return out

    @staticmethod
    def row(token: str) -> int:
        return OWN_ROWS + xxhash.xxh3_64_intdigest(token) % (ROWS - OWN_ROWS)


def token_rows(texts: list, known: TokenRows) -> tuple[np.ndarray, np.ndarray]:
    """All texts' rows one after the other, and how many each text has. Texts of any length
    are taken apart in segments, so only row numbers are held of all tokens."""
    parts, counts = [], []
    for t in texts:
        n = 0
        for part in segments(t.encode("utf-8", "replace")) if t else ():
            rows = list(chain.from_iterable(map(known.__getitem__, part.split())))
            parts.append(np.array(rows, np.int32))
            n += len(rows)
        counts.append(n)
    flat, counts = np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array(counts, np.int64)
    same = np.concatenate([[False], flat[1:] == flat[:-1]])[: len(flat)]
    starts = np.cumsum(counts) - counts
    same[starts[counts > 0]] = False  # a text's first token repeats nothing
    flat[same] = REPEAT
    return flat, counts


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each row the places and signs of its index vector's entries."""
    rng = np.random.default_rng(7_919)
    places = rng.permuted(np.broadcast_to(np.arange(DIM, dtype=np.int32), (ROWS, DIM)), axis=1)[:, :ENTRIES]
    return places, rng.choice([-1.0, 1.0], (ROWS, ENTRIES))


def context_sums(batches):
    """Each task's sums of its texts' context vectors and token counts, in chunks of rows."""
    places, signs = index_vectors()
    total, known = np.zeros((ROWS, DIM + 1)), TokenRows()
    for batch in batches:
        for _, _, texts in pieces(batch.column(0)):
            flat, counts = token_rows(texts, known)
            if not len(flat):
                continue
            doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
            total[:, DIM] += np.bincount(flat, minlength=ROWS)
            for gap in range(1, REACH + 1):
                near = doc[gap:] == doc[:-gap]
                left, right = flat[:-gap][near], flat[gap:][near]
                for a, b in ((left, right), (right, left)):
                    for k in range(ENTRIES):
                        total[:, :DIM] += np.bincount(a * np.int32(DIM) + places[b, k], weights=signs[b, k], minlength=ROWS * DIM).reshape(ROWS, DIM)
    salt = TaskContext.get().partitionId()
    for k in range(0, ROWS, CHUNK):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([salt], pa.int32()), pa.array([total[k : k + CHUNK].tobytes()], pa.binary())], names=["chunk", "salt", "sums"])


def added(batches):
    """Sums the records of each chunk as they stream by; a partition holds few chunks."""
    sums: dict[int, np.ndarray] = {}
    salts: dict[int, int] = {}
    for batch in batches:
        for chunk, salt, blob in zip(*(c.to_pylist() for c in batch.columns)):
            x = np.frombuffer(blob)
            sums[chunk] = sums[chunk] + x if chunk in sums else x
            salts[chunk] = salt
    for chunk, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([salts[chunk]], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["chunk", "salt", "sums"])


def word_table(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Unit word vectors and the weight of each row, from all texts."""
    kind = "chunk int, salt int, sums binary"
    part = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(context_sums), kind)
    # Two levels: of t tasks' records for a chunk no task adds up more than about sqrt(t),
    # as there are about as many tasks as shuffle partitions on a cluster that is set up for the input.
    n = spread(docs.sparkSession)
    fan = max(8, math.isqrt(n))
    part = part.repartition(n, "chunk", F.col("salt") % fan).mapInArrow(tidy(added), kind)
    part = part.repartition(n, "chunk").mapInArrow(tidy(added), kind)
    total = np.zeros((ROWS, DIM + 1))
    for row in part.collect():  # ROWS / CHUNK records
        total[row.chunk : row.chunk + CHUNK] += np.frombuffer(bytes(row.sums)).reshape(CHUNK, DIM + 1)
    vectors, counts = total[:, :DIM], total[:, DIM]
    vectors = vectors - counts[:, None] * (vectors.sum(axis=0) / max(counts.sum(), 1))
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    share = counts / max(counts.sum(), 1)
    return vectors.astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32)


def document_vectors(texts: list, known: TokenRows, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each text the weighted mean and scatter of its rows' vectors, how often its own
    attribute rows occur, how alike neighbours are, and the logarithm of its length."""
    flat, counts = token_rows(texts, known)
    out = np.zeros((len(texts), WIDTH), np.float32)
    full = counts > 0
    if not full.any():
        return out
    owner = np.repeat(np.arange(int(full.sum())), counts[full])
    sums = np.zeros((int(full.sum()), 2 + 2 * DIM + OWN_ROWS))  # mass, likeness, own rows, vectors, squares
    for a in range(0, len(flat), TOKENS_AT_ONCE):
        rows, doc = flat[a : a + TOKENS_AT_ONCE], owner[a : a + TOKENS_AT_ONCE]
        at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        after = np.append(rows[1:], flat[a + len(rows) : a + len(rows) + 1])  # a token's next one, in its text
        alike = np.zeros(len(rows), np.float32)
        next_own = owner[a + 1 : a + 1 + len(rows)]
        same = np.flatnonzero(doc[: len(next_own)] == next_own)
        w, v = weights[rows][:, None], vectors[rows]
        alike[same] = np.einsum("ij,ij->i", vectors[after[same]], v[same])
        each = [w, alike[:, None], *((rows == r).astype(np.float32)[:, None] for r in range(OWN_ROWS)), v * w, v * v * w]
        sums[doc[at]] += np.concatenate([np.add.reduceat(x, at) for x in each], axis=1)
    mass, n = sums[:, :1], counts[full][:, None]
    mean, square = sums[:, 2 + OWN_ROWS : 2 + OWN_ROWS + DIM] / mass, sums[:, 2 + OWN_ROWS + DIM :] / mass
    out[full] = np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0)), sums[:, 2 : 2 + OWN_ROWS] / n, sums[:, 1:2] / n, np.log1p(n)], axis=1)
    return out


class Network:
    """Two layers, trained by Adam on the logistic loss, with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.constant = float(y.mean()) if len(y) else 0.5
        self.fitted = len(np.unique(y)) == 2
        if not self.fitted:
            return
        rng = np.random.default_rng(11)
        order = rng.permutation(len(y))
        held, fit = order[: max(1, len(y) // 5)], order[max(1, len(y) // 5) :]
        if len(np.unique(y[fit])) < 2:
            fit = order
        self.mean, self.std = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
        z = self.scaled(x)
        n = z.shape[1]
        self.p = [rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        first, second, step, best = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0, (np.inf, self.p)
        for _ in range(EPOCHS):
            for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
                step += 1
                h = np.tanh(z[batch] @ self.p[0] + self.p[1])
                g = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30))) - y[batch]) / len(batch)
                back = np.outer(g, self.p[2]) * (1 - h * h)
                grads = [z[batch].T @ back + DECAY * self.p[0], back.sum(axis=0), h.T @ g + DECAY * self.p[2], np.array([g.sum()])]
                for k, d in enumerate(grads):
                    first[k] = 0.9 * first[k] + 0.1 * d
                    second[k] = 0.999 * second[k] + 0.001 * d * d
                    self.p[k] = self.p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            loss = self.loss(self.logits(x[held]), y[held], 1.0)
            if loss < best[0]:
                best = (loss, [a.copy() for a in self.p])
        self.p = best[1]
        # The temperature: the best of 121 on a logarithmic scale, on rows that did not train.
        logit = self.logits(x[held])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
        self.temperature = float(grid[np.argmin([self.loss(logit, y[held], t) for t in grid])])

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.scaled(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    @staticmethod
    def loss(logit: np.ndarray, y: np.ndarray, t: float) -> float:
        s = logit / t
        return float(np.mean(np.maximum(s, 0) - s * y + np.log1p(np.exp(-np.abs(s)))))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = MAX_LABELS) -> DataFrame:
    """The rows with score and predicted added (input columns of those names are replaced).

    ``labels`` are the ones to learn from; no other column than the text is an input.
    """
    rest = docs.drop("score", "predicted")
    vectors, weights = word_table(rest, text_col)
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labels)

    def features(batches):
        known = TokenRows()
        for batch in batches:
            for start, end, texts in pieces(batch.column(1)):
                x = document_vectors(texts, known, vectors, weights)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    # At most max_labels ids, 16 bytes each: small enough to send everywhere.
    sample = rest.select(F.col(id_col).alias("label_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "label_id").dropDuplicates(["label_id"]).select("y", "text").mapInArrow(tidy(features), "y int, x binary").toArrow()
    x = np.frombuffer(b"".join(sample.column("x").to_pylist()), np.float32).reshape(-1, WIDTH).astype(float)
    y = np.array(sample.column("y").to_pylist(), float)
    order = np.lexsort((*x.T[::-1], y)) if len(y) else []
    network = Network(x[order], y[order]) if len(y) else Network(x, y)
    at = rest.columns.index(text_col)
    names = [*rest.columns, "score", "predicted"]

    def score(batches):
        known = TokenRows()
        for batch in batches:
            scores = [network.scores(document_vectors(texts, known, vectors, weights)) for _, _, texts in pieces(batch.column(at).cast(pa.string()))]
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=names)

    schema = T.StructType([*rest.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rest.mapInArrow(tidy(score), schema)
