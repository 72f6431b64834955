"""Quality classifier from weak labels.

Eight heuristic labellers vote good (1), bad (-1) or not at all (0) on each document;
most know one kind of bad text each and are silent else, and their kinds overlap.
Their accuracies are estimated without gold labels by expectation-maximisation over the
counts of vote patterns, of which there are at most 3**8 however many documents. A
pattern's posterior is the label of its documents, and on a bounded sample of them a
linear scorer over hashed word shapes, words and repeats is trained. The scorer decides:
it sees more than the labellers do, and scores texts on which none of them votes.

Counts of votes cover all documents; the sample (`sample` documents with the least hash
of doc_id and text, rows that repeat both once) only trains the scorer. Null and empty texts are rejected with score
0. A text's words all count, however long it is. Repeated rows are repeated in the result.
With an empty table, or without a good and a bad pattern, every text with words is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import U64, WHITE, buffers, hash_spans, mix, release, slices, split
from .scratch import unused

LABELLERS = ("symbols", "marked_words", "capitals", "exclaims", "repeats", "variety", "sentences", "word_length")
SIZE = 1 << 13
SAMPLE = 6000
#: A document is rejected only where the scorer is fairly certain.
THRESHOLD = 0.2

_BYTES = np.arange(256)
_IS_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_IS_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_IS_LETTER = _IS_UPPER | _IS_LOWER | (_BYTES >= 0xC0)
#: Signs that prose has seldom.
_IS_SYMBOL = np.isin(_BYTES, np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~", np.uint8))
_IS_BANG = _BYTES == ord("!")
_STOPS = np.frombuffer(b".!?", np.uint8)
_IS_END = np.isin(_BYTES, np.frombuffer(b".!?:;\"'", np.uint8))
_LOWER = _BYTES.astype(np.uint8)
_LOWER[65:91] += 32
#: Word shapes: letters, capitals and digits each as one sign, others as they are.
_SHAPE = _BYTES.astype(np.uint8)
_SHAPE[97:123] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("9")


def _per_text(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[borders[1:]] - total[borders[:-1]]


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, -1, np.where(good, 1, 0)).astype(np.int8)


class Slice:
    """The words of some texts, with what the labellers and the scorer ask of them."""

    def __init__(self, buf: np.ndarray, borders: np.ndarray) -> None:
        self.buf, self.borders = buf, borders
        self.low = _LOWER[buf]
        self.starts, self.ends = split(buf, borders, WHITE)
        self.hashes = hash_spans(self.low, self.starts, self.ends)
        self.where = np.searchsorted(self.starts, borders)
        self.n = np.diff(self.where)
        self.text = np.repeat(np.arange(len(self.n)), self.n)
        same = np.zeros(len(self.hashes), bool)
        same[1:] = (self.hashes[1:] == self.hashes[:-1]) & (self.text[1:] == self.text[:-1])
        self.same = same

    def votes(self) -> np.ndarray:
        """A row a text, a column a labeller."""
        n = np.maximum(self.n, 1)
        count = lambda table: _per_text(table[self.buf], self.borders)
        letters = np.maximum(count(_IS_LETTER), 1)
        some = self.n >= 5
        per_word = lambda flags: np.bincount(self.text, flags, len(self.n)) / n
        symbols = count(_IS_SYMBOL) / n
        marked = per_word(_IS_SYMBOL[self.buf[self.ends - 1]])
        capitals = count(_IS_UPPER) / letters
        repeats = per_word(self.same)
        bangs = count(_IS_BANG) / n
        mean = per_word(self.ends - self.starts)
        sentence = self.n / np.maximum(per_word(np.isin(self.buf[self.ends - 1], _STOPS)) * n, 1)
        # lines, by the sign before a line break or the text's end
        line_end = np.zeros(len(self.buf), bool)
        if len(self.buf):
            line_end[:-1] = self.buf[1:] == 10
            stop = self.borders[1:][np.diff(self.borders) > 0] - 1
            line_end[stop] = True
            line_end &= self.buf != 10
        lines = np.maximum(_per_text(line_end, self.borders), 1)
        ended = _per_text(line_end & _IS_END[self.buf], self.borders) / lines
        fresh = np.unique(self.text.astype(np.int64) << 32 | (self.hashes >> U64(32)).astype(np.int64)) >> 32
        variety = np.bincount(fresh, minlength=len(self.n)) / n
        never = np.zeros(len(self.n), bool)
        cols = [
            _vote(never, some & (symbols > 0.3)),
            _vote(never, some & (marked > 0.15)),
            _vote(never, some & (capitals > 0.5)),
            _vote(never, some & (bangs > 0.3)),
            _vote(never, some & (repeats > 0.2)),
            _vote((self.n >= 20) & (variety > 0.4), (self.n >= 20) & (variety < 0.12)),
            _vote((ended > 0.7) & (sentence < 60), some & (ended < 0.3)),
            _vote((mean > 3) & (mean < 9), some & ((mean < 2.5) | (mean > 14))),
        ]
        return np.stack(cols, axis=1)

    def features(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, hashed feature, weight): shares of shapes, words and repeats among the text's words."""
        shape = _SHAPE[self.buf]
        # a run of one sign counts once
        head = np.ones(len(shape), bool)
        head[1:] = shape[1:] != shape[:-1]
        head[self.starts] = True
        at = np.concatenate(([0], np.cumsum(head)))
        shapes = hash_spans(shape[head], at[self.starts], at[self.ends])
        kinds = [shapes, mix(self.hashes + U64(1)), np.where(self.same, U64(1), U64(2))]
        keys = np.concatenate([self.text.astype(np.int64) << 20 | (mix(k + U64(7 * i)) % U64(size)).astype(np.int64) for i, k in enumerate(kinds)])
        keys, n = np.unique(keys, return_counts=True)
        text = keys >> 20
        weight = np.sqrt(n / np.maximum(self.n[text], 1))
        return text, keys & 0xFFFFF, weight


def _slices(texts: pa.Array) -> Iterator[tuple[int, Slice]]:
    data, borders = buffers(texts)
    for lo, hi in slices(borders):
        yield lo, Slice(data[int(borders[lo]) : int(borders[hi])], borders[lo : hi + 1] - borders[lo])


def _code(votes: np.ndarray) -> np.ndarray:
    return ((votes.astype(np.int64) + 1) * 3 ** np.arange(votes.shape[1])).sum(axis=1)


def _decode(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


def label_model(codes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good for each pattern, accuracy of each labeller when it votes), by expectation-maximisation.

    Votes are taken as independent given the class. It starts from the majority, a bad vote counting
    three times, as most heuristics tell one kind of bad text and are silent on the others.
    """
    votes = _decode(codes)
    post = 1 / (1 + np.exp(-((votes == 1).sum(axis=1) - 3.0 * (votes == -1).sum(axis=1))))
    total = counts.sum()
    for _ in range(rounds):
        mass = np.stack([(1 - post) * counts, post * counts])
        prior = (mass.sum(axis=1) + 1) / (total + 2)
        logs = np.log(prior)[:, None] + np.zeros((2, len(codes)))
        for j in range(votes.shape[1]):
            table = np.stack([mass[:, votes[:, j] == v].sum(axis=1) for v in (-1, 0, 1)], axis=1) + 0.5
            table /= table.sum(axis=1, keepdims=True)
            logs += np.log(table)[:, votes[:, j] + 1]
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))
    right = np.array([(counts * np.where(votes[:, j] == 1, post, np.where(votes[:, j] == -1, 1 - post, 0))).sum() / max(1e-9, (counts * (votes[:, j] != 0)).sum()) for j in range(votes.shape[1])])
    return post, right


def train(rows: list[np.ndarray], cols: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray, size: int, rounds: int = 200) -> np.ndarray:
    """Weights (the last one the constant) of a logistic scorer on soft labels, by Adam; classes weigh the same."""
    row, col, val = (np.concatenate(x) for x in (rows, cols, weights))
    order = np.argsort(row, kind="stable")
    row, col, val = row[order], col[order], val[order]
    n = len(labels)
    good, bad = max(labels.sum(), 1e-6), max((1 - labels).sum(), 1e-6)
    share = labels / good + (1 - labels) / bad
    w = np.zeros(size + 1)
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, val * w[col], n) + w[-1]
        g = (1 / (1 + np.exp(-z)) - labels) * share / 2
        grad = np.append(np.bincount(col, val * g[row], size), g.sum()) + 2e-4 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(docs: DataFrame, sample: int = SAMPLE, size: int = SIZE) -> tuple[np.ndarray | None, dict[str, float]]:
    """(the scorer's weights, the labellers' accuracies); weights are None where there is nothing to tell apart."""
    texts = docs.select(F.xxhash64("doc_id", "text").alias("h"), F.col("text").cast("string").alias("text"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for _, s in _slices(batch.column(0)):
                seen += np.bincount(_code(s.votes())[s.n > 0], minlength=len(seen))
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(seen[there])], ["code", "n"])

    found = texts.select("text").mapInArrow(patterns, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toPandas()
    codes, counts = found["code"].to_numpy(np.int64), found["n"].to_numpy(np.float64)
    if not len(codes):
        return None, {}
    post, right = label_model(codes, counts)
    accuracy = dict(zip(LABELLERS, right.tolist(), strict=True))
    if post.min() > 0.5 or post.max() < 0.5:
        return None, accuracy

    # the least hashes of about `sample` rows: a threshold on the hash keeps the choice independent of the partitions
    share = min(1.0, sample / counts.sum())
    limit = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, col, val = [], [], []
            for _, s in _slices(batch.column(0)):
                text, hashed, weight = s.features(size)
                edge = np.searchsorted(text, np.arange(len(s.n) + 1))
                for i, c in enumerate(_code(s.votes()).tolist()):
                    if s.n[i]:
                        code.append(c)
                        col.append(hashed[edge[i] : edge[i + 1]].astype(np.int16).tobytes())
                        val.append(weight[edge[i] : edge[i + 1]].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(col, pa.binary()), pa.array(val, pa.binary())], ["code", "col", "val"])

    chosen = texts.where(F.col("h") <= F.lit(limit)).dropDuplicates(["h"]).select("text").mapInArrow(features, "code long, col binary, val binary").toPandas()  # about `sample` rows
    labels = np.interp(chosen["code"].to_numpy(np.float64), codes.astype(np.float64), post)
    cols = [np.frombuffer(x, np.int16).astype(np.int64) for x in chosen["col"]]
    if not cols or labels.min() > 0.5 or labels.max() < 0.5:
        return None, accuracy
    vals = [np.frombuffer(x, np.float32).astype(np.float64) for x in chosen["val"]]
    rows = [np.full(len(c), i) for i, c in enumerate(cols)]
    return train(rows, cols, vals, labels, size), accuracy


def _scored(docs: DataFrame, weights: np.ndarray | None, size: int, name: str = "__quality") -> DataFrame:
    """docs' columns and the score under a new name, in one pass and without moving a row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, s in _slices(batch.column("text")):
                if w is None:
                    own = np.ones(len(s.n))
                else:
                    text, hashed, weight = s.features(size)
                    own = 1 / (1 + np.exp(-np.clip(np.bincount(text, weight * w[hashed], len(s.n)) + w[-1], -60, 60)))
                out[lo : lo + len(s.n)] = np.where(s.n > 0, own, 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, name])
        release()

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score, f"{kinds}, `{name}` double")


def classify(docs: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, size: int = SIZE) -> DataFrame:
    """(doc_id, score, keep) for every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weights, _ = fit(own, sample, size)
    done = _scored(own, weights, size)
    return done.select("doc_id", F.col("__quality").alias("score"), (F.col("__quality") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, size: int = SIZE) -> DataFrame:
    """docs without the rejected documents; all columns stay, whatever their names."""
    weights, _ = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), sample, size)
    name = unused(docs, "__quality")
    return _scored(docs, weights, size, name).where(F.col(name) >= threshold).select(*docs.columns)
