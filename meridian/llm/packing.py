"""Vector bin packing of tokenised examples into training sequences.

An example is a vector of tokens, segments (one) and loss-bearing tokens; a sequence has
a limit for each. The dot-product heuristic fills one sequence at a time: of the examples
in the window that fit, it places the one whose vector has the largest dot product with
what the sequence has left, both in units of the limits. Where cutting is allowed, a
sequence that nothing fits any more is filled with the head of an example, and what a
task has over at its end is closed in sequences whose lengths are powers of two, which
need no padding. Every task packs its own rows, so nothing is shuffled, and a window
bounds its memory.

Defined results: a null text is an empty one and is packed as its end id alone; repeated
rows are packed each; an empty table gives no rows; null ids keep their rows. An example
that alone passes a limit and may not be cut gets a sequence of its own, marked oversized.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_CHARS, segments, tidy

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 2048, 256, 2048
#: Examples that a task chooses among.
WINDOW = 512
REMEMBERED = 500_000
#: Texts of these characters alone (ASCII and precomposed Latin letters that have a lower
#: case of one character each) are lower-cased and parted here, as the tokenizer would.
OTHERS = re.compile("[^\t\n\x0b\x0c\r -~À-ÖØ-öø-įĲ-ňŊ-ſ]")
LATIN = "a-zß-öø-įĲ-ňŊ-ſ"
PARTS = re.compile("[^ \\t\\n\\r\\x0b\\x0c]+")
ATOMS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LATIN}]+|[0-9]|[^\s0-9{LATIN}]+")


#: The steps before the vocabulary for which a text's ids are those of its words in order.
WORDWISE = {"normalizers": ["NFC", "Replace", "Lowercase"], "pattern": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}


def wordwise(path: str) -> bool:
    """Whether a tokenizer lower-cases, drops white space and parts words by WORDWISE."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    split, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    spaces = [s for s in steps if s.get("type") == "Replace"]
    return (
        [s.get("type") for s in steps] == WORDWISE["normalizers"]
        and all(s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in spaces)
        and split.get("type") == "Split" and split["pattern"] == {"Regex": WORDWISE["pattern"]} and split["behavior"] == "Removed" and split["invert"] is True
        and [(s.get("type"), s.get("add_prefix_space"), s.get("use_regex")) for s in rest] == [("ByteLevel", False, False)]
    )


class Encoder:
    """A tokenizer with a bounded memory for words.

    For tokenizers of the known kind (``wordwise``) a text's ids are those of its words in
    order. Texts in other scripts are parted at white space only, and their parts encoded
    as they stand, as are texts that may hold a special token. Any other tokenizer gets
    whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = wordwise(path)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list) -> list[np.ndarray]:
        """The ids of each text; a long one is taken apart where words end."""
        if not self.by_words:
            return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        if max((len(t) for t in texts if t), default=0) <= PIECE_CHARS:
            return self.encode_words(texts)
        return [np.concatenate([self.encode_words([part.decode("utf-8")])[0] for part in segments(t.encode("utf-8"))]) if t else np.zeros(0, "<u4") for t in texts]

    def encode_words(self, texts: list) -> list[np.ndarray]:
        odd = [bool(t) and (OTHERS.search(t) is not None or "<|" in t) for t in texts]
        words = [[] if not t else PARTS.findall(t) if o else ATOMS.findall(t.lower()) for t, o in zip(texts, odd)]
        known = self.known
        out, open_, atoms, parts = [], [], set(), set()
        for i, (own, o) in enumerate(zip(words, odd)):
            ids = list(map(known.get, own))
            try:
                out.append(b"".join(ids))
            except TypeError:  # a word without known ids
                out.append(b"")
                open_.append((i, ids))
                (parts if o else atoms).update([w for w, x in zip(own, ids) if x is None])
        fresh = self.ids_of_atoms(list(atoms)) | self.ids_of_each(list(parts - atoms))
        for i, ids in open_:
            out[i] = b"".join([fresh[w] if x is None else x for w, x in zip(words[i], ids)])
        if len(known) + len(fresh) <= REMEMBERED:  # the first words seen are the frequent ones
            known.update(fresh)
        return [np.frombuffer(x, "<u4") for x in out]

    def ids_of_each(self, words: list) -> dict[str, bytes]:
        """The ids of texts that the tokenizer may part further."""
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False))} if words else {}

    def ids_of_atoms(self, words: list) -> dict[str, bytes]:
        """The ids of words that the tokenizer doesn't part further, encoded as one text; if
        it counts other words than there are, one by one."""
        if not words:
            return {}
        line = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        # White space before a word moves no number: numbers only tell words apart.
        own = np.array(line.word_ids, np.int64)
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        if len(first) != len(words):
            return self.ids_of_each(words)
        ids, bounds = np.array(line.ids, "<u4").tobytes(), (4 * np.append(first, len(own))).tolist()
        return {w: ids[a:b] for w, a, b in zip(words, bounds, bounds[1:])}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; its memory lasts from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


@dataclass
class Item:
    doc: object
    start: int
    tokens: int
    loss: int
    total: int
    ids: np.ndarray | None = None

    def cut(self, n: int) -> tuple[Item, Item]:
        """The first n tokens and the rest; loss-bearing tokens come last in an example."""
        rest_loss = min(self.loss, self.tokens - n)
        head = Item(self.doc, self.start, n, self.loss - rest_loss, self.total, None if self.ids is None else self.ids[:n])
        return head, Item(self.doc, self.start + n, self.tokens - n, rest_loss, self.total, None if self.ids is None else self.ids[n:])


class Packer:
    def __init__(self, limits: tuple[int, int, int], window: int, cutting: bool):
        self.limits, self.window, self.cutting = np.array(limits, float), window, cutting
        self.items: list[Item] = []

    def add(self, item: Item):
        """Takes an example; yields finished sequences."""
        most = int(self.limits[0])
        if self.cutting:
            while item.tokens >= most or item.loss > self.limits[2]:
                n = min(most, item.tokens)
                if item.loss > self.limits[2]:
                    n = min(n, max(1, item.tokens - item.loss + int(self.limits[2])))
                head, item = item.cut(n)
                yield [head]
        elif item.tokens > most or item.loss > self.limits[2]:
            yield [item]
            return
        if item.tokens:
            self.items.append(item)
        if len(self.items) >= self.window:
            yield from self.fill(self.window // 2)

    def fill(self, down_to: int):
        """Closes sequences until at most ``down_to`` examples are left (0: all)."""
        while len(self.items) > down_to:
            items, size = self.items, np.array([(x.tokens, 1, x.loss) for x in self.items], float)
            scaled, free, back = size / self.limits, np.ones(len(size), bool), []
            while not back and free.sum() > down_to:
                left, chosen = self.limits.copy(), []
                while True:
                    fits = free & (size <= left).all(axis=1)
                    if not fits.any():
                        break
                    best = int(np.where(fits, scaled @ (left / self.limits), -1.0).argmax())
                    free[best] = False
                    left -= size[best]
                    chosen.append(items[best])
                # The head of another example fills what is left.
                room = int(left[0])
                if self.cutting and room and left[1] >= 1 and free.any():
                    k = int(np.where(free, size[:, 0] - size[:, 2], -1.0).argmax())
                    if items[k].tokens > room:
                        head, tail = items[k].cut(room)
                        if head.loss <= left[2]:
                            chosen.append(head)
                            items[k], size[k] = tail, (tail.tokens, 1, tail.loss)
                            scaled[k] = size[k] / self.limits
                for sequence in self.closed(chosen, not free.any(), back):
                    yield sequence
            self.items = back + [x for x, f in zip(items, free) if f]

    def closed(self, chosen: list[Item], last: bool, back: list[Item]):
        """A sequence as it is if it is full or may not be cut; else powers of two, or one
        power of two whose rest goes back to the others."""
        while self.cutting and (total := sum(x.tokens for x in chosen)) and total & (total - 1) and total < self.limits[0]:
            most, own = 1 << (total.bit_length() - 1), []
            while most:
                x = chosen.pop(0)
                if x.tokens > most:
                    x, tail = x.cut(most)
                    chosen.insert(0, tail)
                own.append(x)
                most -= x.tokens
            yield own
            if not last:
                back += chosen
                return
        if chosen:
            yield chosen


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def numbered(sequences, schema, row):
    """Batches of a task's sequences, each with an id that no other task gives."""
    part, n, rows = TaskContext.get().partitionId() << 38, 0, []
    for sequence in sequences:
        offset = 0
        for item in sequence:
            rows.append((*row(item), part + n, offset))
            offset += item.tokens
        n += 1
        if len(rows) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, window: int = WINDOW) -> DataFrame:
    """Tokenises and packs whole texts, cut freely; every token but the end id bears loss.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """

    def run(batches):
        encode = encoder(tokenizer).encode
        packer = Packer((max_tokens, max_segments, max_loss), window, cutting=True)
        end = np.array([end_id], "<u4")

        def sequences():
            for batch in batches:
                for k in range(0, len(batch), 256):
                    some = batch.slice(k, 256)
                    for doc, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist())):
                        ids = np.concatenate([ids, end])
                        yield from packer.add(Item(doc, 0, len(ids), len(ids) - 1, len(ids), ids))
            yield from packer.fill(0)

        yield from numbered(sequences(), PIECES, lambda x: (x.doc, x.start, x.tokens, zlib.crc32(x.ids.tobytes()), x.total))

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_examples(examples: DataFrame, *, id_col: str, tokens_col: str, loss_col: str, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, window: int = 4 * WINDOW) -> DataFrame:
    """Packs instruction examples, given by their counts, whole.

    One row per example: example_id, tokens, loss_tokens, oversized, sequence_id, offset.
    Null or negative counts are 0; an example without tokens gets a sequence of its own.
    """
    schema = pa.schema([("example_id", pa.int64()), ("tokens", pa.int64()), ("loss_tokens", pa.int64()), ("oversized", pa.bool_()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        packer = Packer((max_tokens, max_segments, max_loss), window, cutting=False)

        def sequences():
            for batch in batches:
                for doc, tokens, loss in zip(*(c.to_pylist() for c in batch.columns)):
                    item = Item(doc, 0, tokens, loss, tokens)
                    if tokens:
                        yield from packer.add(item)
                    else:
                        yield [item]
            yield from packer.fill(0)

        yield from numbered(sequences(), schema, lambda x: (x.doc, x.tokens, x.loss, x.tokens > max_tokens or x.loss > max_loss))

    count = lambda c: F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0)).cast("long")
    read = examples.select(F.col(id_col).cast("long").alias("example_id"), count(tokens_col).alias("tokens"), F.least(count(tokens_col), count(loss_col)).alias("loss"))
    return read.mapInArrow(run, "example_id long, tokens long, loss_tokens long, oversized boolean, sequence_id long, offset long")


def conversation_examples(turns: DataFrame, tokenizer: str, *, id_col: str = "conv_id", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """(id, tokens, loss_tokens) of conversations: every turn has its text's tokens and an
    end; those of the trained role's turns bear loss. A null text is an empty one."""

    def run(batches):
        encode = encoder(tokenizer).encode
        for batch in batches:
            texts = batch.column(2).to_pylist()
            counts = np.concatenate([np.zeros(0, np.int64)] + [[len(ids) + 1 for ids in encode(texts[k : k + 256])] for k in range(0, len(texts), 256)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts)], names=["id", "role", "n"])

    read = turns.select(F.col(id_col).cast("long").alias("id"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    counted = read.mapInArrow(run, "id long, role string, n long")
    return counted.groupBy("id").agg(F.sum("n").alias("tokens"), F.coalesce(F.sum(F.when(F.col("role") == trained, F.col("n"))), F.lit(0)).alias("loss_tokens"))
