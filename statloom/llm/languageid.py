"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams (1 to 3 letters, with
word borders), counted over all training texts. A document is compared by the
out-of-place distance: for each of its own most frequent n-grams, how far its rank is
from that in the profile, or the profile's length where it is missing. The least
distance wins, ties to the language that sorts first.

A text that is null, empty or without letters has language `und` and score 0. Rows
with a null lang (or null text) don't train. With no training rows at all every
text is `und`. Only letters count, in lower case; all of a text counts, however long.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import buffers, slices

PROFILE = 400
_BITS = np.uint64(21)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


#: Stands for a word's border in an n-gram; no letter has this code point.
_BORDER = 1
Grams = tuple[int, int, np.ndarray, np.ndarray, np.ndarray]


def _grams(texts: pa.Array, most: int = 2 << 20) -> Iterator[Grams]:
    """(lo, hi, text of, n-gram, count) over slices lo..hi of the batch, sorted by text and n-gram.

    An n-gram packs up to three code points of 21 bits, the last one lowest.
    """
    data, borders = buffers(pc.utf8_lower(pc.fill_null(texts, "")))
    for lo, hi in slices(borders, most):
        yield from _counted(data, borders, lo, hi)


def _counted(data: np.ndarray, borders: np.ndarray, lo: int, hi: int) -> Iterator[Grams]:
    raw = data[int(borders[lo]) : int(borders[hi])]
    heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    fine = _letters()[points]
    if not fine.any():
        return
    text = np.repeat(np.arange(hi - lo), np.diff(heads[borders[lo : hi + 1] - borders[lo]]))
    # of each run of other signs the first stays, as a border
    keep = fine.copy()
    keep[1:] |= fine[:-1] & (text[1:] == text[:-1])
    text, fine, signs = text[keep], fine[keep], np.where(fine, points, _BORDER)[keep]
    alphabet = np.unique(np.concatenate(([_BORDER], signs)))
    place = np.zeros(int(alphabet[-1]) + 1, np.uint64)
    place[alphabet] = np.arange(1, len(alphabet) + 1, dtype=np.uint64)
    bits = int(len(alphabet)).bit_length()
    if 3 * bits + (hi - lo - 1).bit_length() > 64:  # one text always fits
        mid = (lo + hi) // 2
        yield from _counted(data, borders, lo, mid)
        yield from _counted(data, borders, mid, hi)
        return
    code = place[signs]
    first = np.concatenate(([True], text[1:] != text[:-1]))
    before = np.where(first, np.uint64(1), np.concatenate(([1], code[:-1])).astype(np.uint64))
    after = np.where(np.concatenate((first[1:], [True])), np.uint64(1), np.concatenate((code[1:], [1])).astype(np.uint64))
    b, own = np.uint64(bits), text.astype(np.uint64) << np.uint64(3 * bits)
    pair = before << b | code
    keys = np.concatenate(((own | code)[fine], (own | pair)[fine | (before > 1)], (own | pair << b | after)[fine]))
    keys.sort()
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    count, got = np.diff(np.concatenate((head, [len(keys)]))), keys[head]
    back = np.concatenate(([0], alphabet)).astype(np.uint64)
    mask = np.uint64((1 << bits) - 1)
    one, two, three = (back[((got >> np.uint64(i * bits)) & mask).astype(np.int64)] for i in range(3))
    yield lo, hi, (got >> np.uint64(3 * bits)).astype(np.int64), (one | two << _BITS | three << (_BITS + _BITS)).view(np.int64), count


def profiles(docs: DataFrame, train: Column, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's `size` most frequent n-grams in rank order, counted over all rows where `train` holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[np.ndarray]] = {}

        def add(lang: str, gram: np.ndarray, n: np.ndarray) -> None:
            if lang in total:
                gram, n = np.concatenate((total[lang][0], gram)), np.concatenate((total[lang][1], n))
            gram, at = np.unique(gram, return_inverse=True)
            total[lang] = [gram, np.bincount(at, n).astype(np.int64)]

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lo, _, text, gram, n in _grams(batch.column(1)):
                of = langs[lo + text]
                for lang in set(of.tolist()):
                    add(lang, gram[of == lang], n[of == lang])
        for lang, (gram, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    learn = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = learn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "gram", "rank").toPandas()  # `size` rows a language
    return {str(lang): own.sort_values("rank")["gram"].to_numpy(np.int64) for lang, own in top.groupby("lang")}


def identify(docs: DataFrame, known: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """docs' doc_id and text as (doc_id, lang_pred, score): score is 1 minus the distance as a share of the largest possible."""
    names = sorted(known)
    grams = np.unique(np.concatenate([known[x] for x in names])) if names else np.zeros(0, np.int64)
    ranks = np.full((len(names), len(grams)), -1, np.int64)
    for i, x in enumerate(names):
        ranks[i, np.searchsorted(grams, known[x])] = np.arange(len(known[x]))
    shared = docs.sparkSession.sparkContext.broadcast((names, grams, ranks))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, grams, ranks = shared.value
        for batch in batches:
            pred, score = np.array(["und"] * batch.num_rows, object), np.zeros(batch.num_rows)
            for lo, hi, text, gram, n in _grams(batch.column(1)):
                order = np.lexsort((gram, -n, text))
                text, gram = text[order], gram[order]
                start = np.searchsorted(text, np.arange(hi - lo + 1))
                rank = np.arange(len(text)) - start[text]
                top = rank < size
                text, gram, rank = text[top], gram[top], rank[top]
                asked = np.bincount(text, minlength=hi - lo)
                if not len(names):
                    continue
                at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
                there = grams[at] == gram
                far = np.empty((len(names), hi - lo))
                for i in range(len(names)):
                    own = np.where(there, ranks[i, at], -1)
                    far[i] = np.bincount(text, np.where(own >= 0, np.minimum(np.abs(own - rank), size), size), hi - lo)
                rows = np.flatnonzero(asked)
                best = far[:, rows].argmin(axis=0)
                pred[lo + rows] = np.array(names, object)[best]
                score[lo + rows] = 1 - far[best, rows] / (size * asked[rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(predict, "doc_id long, lang_pred string, score double")
