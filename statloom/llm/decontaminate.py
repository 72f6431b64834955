"""Benchmark decontamination by spaced-seed hashing.

Fixed masks of kept and ignored token positions slide over the benchmark items and
over every document; equal hashes of the kept tokens are hits, so a run of tokens is
found although single ones were replaced. Around each hit the item and the document
are laid on each other along the hit's diagonal, and the best-scoring run of aligned
tokens (1 for an equal pair, -2 for another) is the overlap. A document is
contaminated if an overlap has `need` equal tokens, or all those of a shorter item.

Tokens are runs of letters and digits, in lower case; letters of scripts without spaces
are tokens each. The benchmark is cut into blocks of bounded size; a block's hashes are
broadcast and joined with the documents' in place, one block after the other, so no
document text moves and nothing outgrows a block. Where one token repeats in a row, a run
of it in the document is laid on a run of it in the item by their starts and by their
ends, and not in every other way. Whole texts count.

A null text or item counts as empty. Items of fewer than `shortest` tokens (five) are too
common to tell anything and match nothing; with shortest=1 all items are sought. Items of
equal tokens are one, under their smallest id, and `items` is their number. Documents are
told apart by row: repeated rows give repeated results, a null doc_id is a row like others,
and a contaminated row takes no other row of its doc_id along. Empty tables give no rows.
Other columns are ignored by overlaps() and kept by decontaminate().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import U64, buffers, mix, release, slices, words
from .scratch import stage, unused

#: Kept (1) and ignored (0) positions of the fixed masks.
MASKS = ("11011011", "1110111", "1110100111", "110101100101")
#: Hits that are looked at together.
HITS = 250_000
NEED = 12
SHORTEST = 5
PENALTY = 2
RESULT = "row long, doc_id long, item_id long, items int, matched_tokens int, overlap_tokens int, overlap_start int, item_tokens int"
#: Signs that separate words beyond ASCII, and letters that are words by themselves.
_APART = r"[\p{P}\p{S}\p{Z}]"
_SINGLE = r"([\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}])"


def _seeds(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The mask's hash at each position of the token hashes h."""
    n = len(h) - len(mask) + 1
    out = np.full(max(0, n), salt, U64)
    for k, kept in enumerate(mask):
        if kept == "1" and n > 0:
            out = mix(out + h[k : k + n])
    return out


def spaced(texts: pa.Array) -> pa.Array:
    """texts with spaces for signs that separate words beyond ASCII, and around letters that are words by themselves."""
    data, borders = buffers(texts)
    rare = np.concatenate(([0], np.cumsum((data == 0xC2) | (data >= 0xE0))))
    rows = np.flatnonzero(rare[borders[1:]] > rare[borders[:-1]])
    if not len(rows):
        return texts
    some = pc.replace_substring_regex(texts.take(pa.array(rows)), _APART, " ")
    mask = np.zeros(len(texts), bool)
    mask[rows] = True
    return pc.replace_with_mask(texts, pa.array(mask), pc.replace_substring_regex(some, _SINGLE, r" \1 "))


def _bounded(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches with about `most` bytes of text each, at least a row."""
    for batch in batches:
        _, borders = buffers(batch.column("text"))
        for lo, hi in slices(borders, most):
            yield batch.slice(lo, hi - lo)


def _runs(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of one seed after the other."""
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(seed)), bool), seed[1:] != seed[:-1])))
    return start, np.diff(np.concatenate((start, [len(seed)])))


class Index:
    """Seed hashes of some benchmark items, for lookup from documents."""

    def __init__(self, items: list[tuple[int, np.ndarray, int]], masks: tuple[str, ...] = MASKS, shortest: int = SHORTEST) -> None:
        #: (smallest id, tokens, how many items these are), a row for the items of equal tokens
        self.items = [x for x in items if len(x[1]) >= max(1, shortest)]
        least = min(map(len, masks))
        short = sorted({len(h) for _, h, _ in self.items if len(h) < least})
        #: Items shorter than any mask are sought whole.
        self.masks = [*masks, *("1" * n for n in short)]
        found = []
        for m, mask in enumerate(self.masks):
            for at, (_, h, _) in enumerate(self.items):
                if m < len(masks) or len(h) == len(mask):
                    s = _seeds(h, mask, m + 1)
                    start, n = _runs(s)
                    found.append((s[start], np.full(len(start), at), start, n))
        seed, item, pos, run = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, U64), *[np.zeros(0, int)] * 3)
        order = np.argsort(seed, kind="stable")
        self.seed = seed[order]
        self.item, self.pos, self.run = (x[order].astype(np.int64) for x in (item, pos, run))
        bits = max(12, (16 * max(1, len(seed))).bit_length())
        self.shift = U64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[(self.seed >> self.shift).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (item, diagonal) pairs: the document's position minus the item's."""
        out = np.zeros(0, np.int64)  # item and diagonal in one number: a slice's diagonals have 40 bits
        shift = 1 << 39
        for m, mask in enumerate(self.masks):
            s = _seeds(h, mask, m + 1)
            at, long = _runs(s)
            some = self.filter[(s[at] >> self.shift).astype(np.int64)]
            at, long = at[some], long[some]
            lo, hi = np.searchsorted(self.seed, s[at], "left"), np.searchsorted(self.seed, s[at], "right")
            n = hi - lo
            at, long, lo, n = at[n > 0], long[n > 0], lo[n > 0], n[n > 0]
            end = np.cumsum(n)
            a = 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + HITS, "right")))
                k, first = n[a:b], lo[a:b]
                row = np.repeat(first, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                starts = np.repeat(at[a:b], k) - self.pos[row]
                ends = starts + np.repeat(long[a:b], k) - self.run[row]
                item = self.item[row]
                out = np.unique(np.concatenate((out, (item << 40) + starts + shift, (item << 40) + ends + shift)))
                a = b
        return out >> 40, (out & ((1 << 40) - 1)) - shift


def best_run(equal: np.ndarray, penalty: int = PENALTY) -> tuple[int, int]:
    """Start and end of the best-scoring run of aligned tokens; of several the longest."""
    run = np.concatenate(([0], np.cumsum(np.where(equal, 1, -penalty))))
    low = np.minimum.accumulate(run)
    end = len(equal) - int((run - low)[::-1].argmax())
    start = int((run[: end + 1] == low[end]).argmax())
    return start, end


def _items(benchmark: DataFrame, shortest: int) -> DataFrame:
    """(id, h, n): the items of equal tokens as one: smallest id, token hashes, and how many items these are."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches):
            h = [w.hashes[w.where[i] : w.where[i + 1]].tobytes() for w in words(spaced(batch.column("text"))) for i in range(w.hi - w.lo)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(h, pa.binary()), batch.column("n")], ["id", "h", "n"])

    # equal texts meet before they are hashed, equal tokens before they are sent out
    texts = benchmark.groupBy(F.col("text").cast("string").alias("text")).agg(F.min(F.col("item_id").cast("long")).alias("id"), F.count("*").alias("n"))
    own = texts.select("id", "text", "n").mapInArrow(make, "id long, h binary, n long")
    return own.where(F.length("h") >= 8 * max(1, shortest)).groupBy("h").agg(F.min("id").alias("id"), F.sum("n").alias("n"))


def _overlaps(docs: DataFrame, benchmark: DataFrame, need: int, shortest: int, block_chars: int) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    items = stage(_items(benchmark, shortest), "items")
    total = items.agg(F.sum(F.length("h"))).first()[0] or 0
    blocks = max(1, -(-total // (block_chars * 3 // 2)))  # eight bytes a token of some six letters
    key = F.pmod(F.xxhash64("h"), F.lit(blocks))
    found = []
    for b in range(blocks):
        rows = items.where(key == b).collect()  # a block's distinct items
        own = sorted(((r["id"], np.frombuffer(r["h"], U64), r["n"]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0))
        shared = spark.sparkContext.broadcast(Index(own, shortest=shortest))
        own = texts.mapInArrow(_search(shared, need), RESULT)
        if blocks > 1:  # one block's hashes at a time
            own = stage(own, "overlaps")
            shared.destroy()
        found.append(own)
    return reduce(DataFrame.unionByName, found)


def overlaps(docs: DataFrame, benchmark: DataFrame, need: int = NEED, shortest: int = SHORTEST, block_chars: int = 4_000_000) -> DataFrame:
    """A row for each document and item that overlap: the best overlap, and its place in the document's tokens.

    block_chars: about how much benchmark text is broadcast at once.
    """
    return _overlaps(docs, benchmark, need, shortest, block_chars).drop("row")


def _search(shared, need: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in _bounded(batches):
            keys, ids, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for w in words(spaced(batch.column(2))) if len(index.seed) else ():
                item, diagonal = index.hits(w.hashes)
                best: dict[tuple[int, int], tuple] = {}
                for i, shift in zip(item.tolist(), diagonal.tolist(), strict=True):
                    own = index.items[i][1]
                    # a diagonal may cross several documents of the slice: each one for itself
                    a, b = max(0, shift), min(len(w.hashes), shift + len(own))
                    for d in range(int(np.searchsorted(w.where, a, "right")) - 1, int(np.searchsorted(w.where, b, "left"))):
                        lo, hi = max(a, int(w.where[d])), min(b, int(w.where[d + 1]))
                        if hi <= lo:
                            continue
                        equal = w.hashes[lo:hi] == own[lo - shift : hi - shift]
                        s, e = best_run(equal)
                        matched = int(equal[s:e].sum())
                        if matched >= min(need, len(own)) and matched > best.get((d, i), (0,))[0]:
                            best[d, i] = (matched, e - s, lo + s - int(w.where[d]), len(own))
                out += [(keys[w.lo + d], ids[w.lo + d], index.items[i][0], index.items[i][2], *x) for (d, i), x in best.items()]
            cols = list(zip(*out, strict=True)) or [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])
        release()

    return search


def decontaminate(docs: DataFrame, benchmark: DataFrame, need: int = NEED, shortest: int = SHORTEST, block_chars: int = 4_000_000) -> DataFrame:
    """docs without the contaminated rows; all columns stay, whatever their names."""
    row = unused(docs, "__row")
    leaks = _overlaps(docs, benchmark, need, shortest, block_chars).select(F.col("row").alias(row)).distinct()
    keyed = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return keyed.join(leaks, row, "left_anti").select(*docs.columns)
