"""Importance resampling of documents towards a target, by hashed n-grams from prefix CRCs.

A document is normalised: A-Z in lower case, words (letters, digits, and all characters
beyond ASCII) joined by one space. One scan stores the CRC register before every byte. As CRC-32 is
linear over GF(2), the register of a run of bytes is the register at its end, less the one
at its start shifted by the run's length (the shift by 2**k bytes is a matrix, kept as four
tables of 256 entries, and any length is a product of these); so every n-gram's CRC follows from two prefixes, whatever
n is, and no n-gram is built or hashed. A CRC modulo `buckets` is the feature's bucket.

Two tables of `buckets` counts, of the documents and of the target, give each bucket its
gain: floor(1000 * ln of the target's smoothed share over the documents'). A document's
weight is the floored mean of its features' gains. Gumbel noise from a hash of seed and doc_id
makes the highest scores a sample without replacement by weight. The draw is exact: scores are
whole numbers, so counts by score give the cut and each score's place, and only rows that share
a score are ordered by doc_id among themselves; nothing is sorted as a whole.

Counts reach the driver as `buckets` numbers, and scores as one row a distinct score: gains lie
between -1000 ln(S + buckets) and 1000 ln(T + buckets), noise between -3,104 and 22,874, so
under 150,000 rows whatever the input's size.

A null or empty text has no features and weight 0. A row without doc_id counts in the tables of
counts, but is never drawn, nor counted among those drawn from: score and rank are null. Rows that
repeat a doc_id and text have one score and ranks one after the other. Ties go to the smaller
doc_id. An empty table gives no rows; an empty target still gives every bucket its
smoothed share. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import NOT_ALNUM, buffers, release, slices, split
from .scratch import stage

U32 = np.uint32
_ONES = U32(0xFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Texts of so many bytes are scanned together, in so many lanes at once.
SLICE, LANES = 1 << 20, 4096


def _byte_table() -> np.ndarray:
    """The register after one byte, for each value of its lowest byte (the reflected polynomial of CRC-32)."""
    t = np.arange(256, dtype=U32)
    for _ in range(8):
        t = np.where(t & U32(1), (t >> U32(1)) ^ U32(0xEDB88320), t >> U32(1))
    return t


_STEP = _byte_table()


def _tables(columns: np.ndarray) -> np.ndarray:
    """(4, 256): a linear map of registers, given by the images of the 32 single bits, by byte of the register."""
    out = np.zeros((4, 256), U32)
    value = np.arange(256)
    for k in range(4):
        for bit in range(8):
            out[k] ^= np.where(value >> bit & 1, columns[8 * k + bit], U32(0))
    return out


def _apply(tables: np.ndarray, r: np.ndarray) -> np.ndarray:
    return tables[0][r & U32(255)] ^ tables[1][r >> U32(8) & U32(255)] ^ tables[2][r >> U32(16) & U32(255)] ^ tables[3][r >> U32(24)]


def _shifts(n: int) -> list[np.ndarray]:
    """Tables of the shifts by 1, 2, 4, .. bytes, each the square of the one before."""
    bits = U32(1) << np.arange(32, dtype=U32)
    out = [_tables(_STEP[bits & U32(255)] ^ (bits >> U32(8)))]
    while len(out) < n:
        out.append(_tables(_apply(out[-1], _apply(out[-1], bits))))
    return out


_SHIFT = _shifts(40)


def shift(r: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Registers after so many zero bytes."""
    r = r.astype(U32)
    for k in range(int(length.max(initial=0)).bit_length()):
        on = np.flatnonzero(length >> k & 1)
        r[on] = _apply(_SHIFT[k], r[on])
    return r


def running(data: np.ndarray) -> np.ndarray:
    """The register before each byte and after the last, from register 0: lanes are scanned side by side, then chained."""
    n = len(data)
    width = max(1, -(-n // LANES))
    padded = np.zeros(width * LANES, np.uint8)
    padded[:n] = data
    lanes = np.ascontiguousarray(padded.reshape(LANES, width).T)
    own = np.zeros((width + 1, LANES), U32)
    r = np.zeros(LANES, U32)
    for i in range(width):
        r = _STEP[(r ^ lanes[i]) & U32(255)] ^ (r >> U32(8))
        own[i + 1] = r
    # the register that each lane starts with, shifted on as its bytes go by, is added to the lane's own
    over = _tables(shift(U32(1) << np.arange(32, dtype=U32), np.full(32, width))).tolist()
    chain, ends = [0], own[width].tolist()
    for end in ends[:-1]:
        x = chain[-1]
        chain.append(end ^ over[0][x & 255] ^ over[1][x >> 8 & 255] ^ over[2][x >> 16 & 255] ^ over[3][x >> 24])
    first = np.array(chain, U32)
    for i in range(width):
        own[i] ^= first
        first = _STEP[first & U32(255)] ^ (first >> U32(8))
    out = np.empty(n + 1, U32)
    out[:n] = own[:width].T.ravel()[:n]
    out[n] = (own[:width].T.ravel()[n] if n < width * LANES else own[width, -1] ^ first[-1]) if n else 0
    return out


def normalise(buf: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, words before each text): the words of all texts, each with one space after it."""
    buf = _LOWER[buf]
    s, e = split(buf, borders, NOT_ALNUM)
    length = e - s
    ends = np.cumsum(length + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    keep = np.zeros(len(buf) + 1, np.int8)
    keep[s] += 1
    keep[e] -= 1
    gaps = np.ones(len(out), bool)
    gaps[ends] = False
    out[gaps] = buf[np.cumsum(keep[:-1]).astype(bool)]
    return out, ends - length, ends, np.searchsorted(s, borders)


def crcs(buf: np.ndarray, borders: np.ndarray, most: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 .. most: (CRC-32 of each run of n words, number of its text)."""
    text, s, e, where = normalise(buf, borders)
    if not len(s):
        return
    register = running(text)
    owner = np.repeat(np.arange(len(where) - 1), np.diff(where))
    for n in range(1, most + 1):
        first = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
        start, end = s[first], e[first + n - 1]
        # the run's own register starts with all ones and is inverted at its end
        yield register[end] ^ shift(register[start] ^ _ONES, end - start) ^ _ONES, owner[first]


def _features(texts: pa.Array, most: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(lo, hi, bucket of each feature, its text's number from lo on, words of each text) of bounded slices of a batch."""
    data, borders = buffers(texts)
    for lo, hi in slices(borders, SLICE):
        own = borders[lo : hi + 1] - borders[lo]
        parts = list(crcs(data[int(borders[lo]) : int(borders[hi])], own, most))
        words = np.bincount(parts[0][1], minlength=hi - lo) if parts else np.zeros(hi - lo, np.int64)
        bucket = np.concatenate([np.zeros(0, U32), *(c for c, _ in parts)]) % U32(buckets)
        yield lo, hi, bucket, np.concatenate([np.zeros(0, np.int64), *(t for _, t in parts)]), words


def counts(texts: DataFrame, most: int, buckets: int) -> np.ndarray:
    """How many features of the column text fall into each bucket; a task sends `buckets` rows at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, bucket, _, _ in _features(batch.column("text"), most, buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])
        release()

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(smoothed share in the target / smoothed share in the source)) of each bucket."""
    b = float(len(source))
    s, t = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + b) / ((x + 1.0) * (t + b)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(docs: DataFrame, gain: np.ndarray, most: int) -> DataFrame:
    """(doc_id, n_features, n_words, weight)."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            size, words, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for lo, hi, bucket, owner, n in _features(batch.column("text"), most, len(gain)):
                order = np.argsort(owner, kind="stable")  # a text's features, n by n, together
                own = np.searchsorted(owner[order], np.arange(hi - lo + 1))
                run = np.concatenate(([0], np.cumsum(gain[bucket[order]])))
                size[lo:hi], words[lo:hi] = np.diff(own), n
                weight[lo:hi] = (run[own[1:]] - run[own[:-1]]) // np.maximum(size[lo:hi], 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(words), pa.array(weight)], ["doc_id", "n_features", "n_words", "weight"])
        release()

    return docs.mapInArrow(weigh, "doc_id long, n_features long, n_words long, weight long")


def _drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """scored (doc_id, n_features, n_words, weight, score) with rank: 1, 2, .. of those drawn, null for the others."""
    spark = scored.sparkSession
    fit = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    by_score = scored.where(fit).groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect()  # a row a distinct score
    take = sum(r["n"] for r in by_score) * percent // 100
    above, cut, so_far = [], None, 0
    for r in by_score:
        if so_far >= take:
            break
        above.append((r["score"], so_far))
        cut, so_far = r["score"], so_far + r["n"]
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    inside = F.coalesce(fit & (F.col("score") >= cut), F.lit(False))
    place = F.row_number().over(Window.partitionBy("score").orderBy("doc_id")) + F.col("above")
    top = scored.where(inside).join(F.broadcast(spark.createDataFrame(above, "score long, above long")), "score")
    top = top.withColumn("rank", F.when(place <= take, place).cast("long")).drop("above")
    return top.unionByName(scored.where(~inside).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document (see the module's text).

    docs: doc_id and text. target: text. most: longest runs of words that are features. percent of the documents of at
    least `least_words` words are drawn.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gain = gains(counts(docs.select("text"), most, buckets), counts(target.select(F.col("text").cast("string").alias("text")), most, buckets))
    name = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), "utf-8"), 256)
    h = F.conv(F.substring(name, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = _weighed(docs, gain, most).withColumn("score", F.col("weight") + noise)
    return _drawn(stage(rows, "scores"), percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, **settings: int) -> DataFrame:
    """The documents that resample() draws, with all their columns, in no order; rows that share a doc_id go together if one is drawn."""
    ids = resample(docs, target, **settings).where("rank IS NOT NULL").select(F.col("doc_id").alias("id")).distinct()
    return docs.join(ids, F.col("doc_id").cast("long") == ids["id"], "left_semi")
