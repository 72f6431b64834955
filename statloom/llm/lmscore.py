"""Language-model scoring with a log-frequency Bloom filter.

Learning. Every task numbers the distinct n-grams of 1 to `order` tokens of about FLUSH tokens
(a flush) and sends them with their counts, packed, to the shard that their hash selects; a
shard adds up the counts. Counts are quantised (level j: at least STEPS[j - 1]) and stored
as events (n-gram, 1), ..., (n-gram, level) in the shard's part of a Bloom filter. A part
holds all n-grams of its range of hashes, at every size of the input: there are as many
shards as the input needs. The parts stay in their shards and the probes go to them: the
filter grows with the input, and a broadcast of all of it would have no bound.

Scoring. An n-gram's level is found by probing (n-gram, 1), (n-gram, 2), ... until one is
missing; the shard does so for the n-grams of every flush and sends back the levels, and
exact token counts for the base score. Each flush puts them in the places of its tokens.
P(w | context) = d(r) * r / c + (1 - m(c)) * P(w | shorter context), where r and c are the
counts of n-gram and context, d is the share of an n-gram's count that Good and Turing's
estimate leaves (tokens with a count of r + 1 for each one with a count of r), and m the mean
of d over the training tokens whose context has c's level; P(w) is the smoothed share of w.
They come from all training documents: how often each pair of levels of n-gram and context
occurs is all that the driver gathers. A text that was learned twice so scores far apart from
one that was learned once, whose long n-grams say little.

Tokens are runs of other signs than ASCII white space, with A-Z in lower case, then one
end; the end also stands before a text's first token, and longer contexts than that aren't
looked up there. A null or empty text has the end only. Held-out documents are scored and
not learned from. Repeated rows are learned from and scored each. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import U64, WHITE, mix, release, words
from .scratch import stage

END = mix(np.array([0x5EED], U64))[0]
_PAIR, _ONE = U64(0x9FB21C651E98DF25), U64(0xA24BAED4963EE407)
#: Tokens after which a task sends what it has counted.
FLUSH = 1_000_000
BITS = 12
#: Keys whose events are set at once.
CHUNK = 1 << 18


def steps() -> np.ndarray:
    """Least counts of the levels: each a fifth above the one before, and at least one."""
    out = [1]
    while out[-1] < 1 << 50:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * 1.2)))
    return np.array(out, np.int64)


STEPS = steps()
#: The count that a level stands for: the geometric middle of its range; level 0 has none.
MIDDLE = np.concatenate(([0.0], np.sqrt(STEPS[:-1] * (STEPS[1:] - 1.0)), [float(STEPS[-1])]))


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(STEPS, counts, "right")


def _add(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _planes(x: np.ndarray, width: int) -> bytes:
    """Integers as byte planes, which the shuffle's compression likes better than rows of bytes."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(raw: bytes, width: int) -> np.ndarray:
    n = len(raw) // width
    if isinstance(raw, np.ndarray):
        raw = np.ascontiguousarray(raw)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(-1)


_ZSTD = pa.Codec("zstd", compression_level=1)


def _tight(raw: bytes) -> bytes:
    """raw with its size in front, by an entropy coder, which the shuffle's own compression lacks."""
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _loose(raw: bytes) -> bytes:
    return _ZSTD.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _streams(w) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with an end after each text, text of each)."""
    n = np.diff(w.where)
    text = np.repeat(np.arange(len(n)), n + 1)
    tokens = np.full(len(text), END, U64)
    inner = np.ones(len(text), bool)
    inner[np.cumsum(n + 1) - 1] = False
    tokens[inner] = w.hashes
    return tokens, text


def pair_key(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR + tokens)


#: Bits of an n-gram's hash that are sent, beyond those that number as many n-grams as the input has.
SPARE = 8
ORDER = 3


def _grams(tokens: np.ndarray, first: np.ndarray, order: int, cut: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 2 to `order` tokens: (places that have so many before them, the end before a text included; their n-grams' hashes).

    first: the place of each text's first token. cut: low bits of a hash that are left out.
    """
    at = np.arange(len(tokens)) - np.repeat(first, np.diff(np.append(first, len(tokens))))
    before = np.concatenate(([END], tokens[:-1]))
    before[first] = END
    full = pair_key(before, tokens)
    yield np.arange(len(tokens)), full >> U64(cut)
    for k in range(3, order + 1):
        longer = np.concatenate((full[:1], full[:-1]))
        full = pair_key(longer, tokens)
        places = np.flatnonzero(at >= k - 2)
        yield places, full[places] >> U64(cut)


def _rising(x: np.ndarray, width: int) -> bytes:
    """Rising integers as byte planes of their differences."""
    return _planes(np.diff(x, prepend=U64(0)), width)


def _from_rising(raw: bytes, width: int) -> np.ndarray:
    return np.cumsum(_from_planes(raw, width), dtype=U64)


class Filter:
    """The filter's parts: a part has words of 64 bits, and an event sets or probes four bits of one word."""

    def __init__(self, data: bytes | bytearray, start: np.ndarray, size: np.ndarray) -> None:
        """data: the parts one after another, in any order; start, size: each part's place there, in words."""
        self.shards = len(size)
        self.start = start
        self.size = size.astype(U64)
        self.words = np.frombuffer(data or bytes(8), U64)

    @staticmethod
    def joined(parts: Iterable[tuple[int, bytes]], shards: int) -> tuple[bytearray, np.ndarray, np.ndarray]:
        """What a Filter is made of, from (shard, part) as they come."""
        data, start, size = bytearray(), np.zeros(shards, np.int64), np.zeros(shards, np.int64)
        for shard, part in parts:
            start[shard], size[shard] = len(data) // 8, len(part) // 8
            data += part
        return data, start, size

    def level(self, keys: np.ndarray, most: int = len(STEPS)) -> np.ndarray:
        """The highest level up to which every event of the key is there."""
        out = np.zeros(len(keys), np.int16)
        alive = np.arange(len(keys))
        shard = shard_of(keys, self.shards)
        start, size = self.start[shard], self.size[shard]
        alive = alive[size > 0]
        for j in range(1, most + 1):
            if not len(alive):
                break
            at, mask = place(keys[alive], j, size[alive])
            there = (self.words[start[alive] + at] & mask) == mask
            alive = alive[there]
            out[alive] = j
        return out


def place(keys: np.ndarray, level: int | np.ndarray, size: np.ndarray | U64) -> tuple[np.ndarray, np.ndarray]:
    """Word and bits of an event in a part of `size` words."""
    e = mix(keys + np.asarray(level).astype(U64) * _ONE)
    mask = U64(0)
    for k in range(4):
        mask = mask | U64(1) << ((e >> U64(6 * k)) & U64(63))
    return ((e >> U64(32)) * size >> U64(32)).astype(np.int64), mask


def build(keys: np.ndarray, levels: np.ndarray, bits: int = BITS) -> bytes:
    """A part that holds all events of these keys."""
    total = int(levels.sum(dtype=np.int64))
    if not total:
        return b""
    size = max(1, -(-total * bits // 64))
    out = np.zeros(size, U64)
    for a in range(0, len(keys), CHUNK):
        own, top = keys[a : a + CHUNK], levels[a : a + CHUNK]
        j = 1
        while len(own):
            at, mask = place(own, j, U64(size))
            np.bitwise_or.at(out, at, mask)
            j += 1
            more = top >= j
            own, top = own[more], top[more]
    return out.tobytes()


def _pack_docs(docs: DataFrame, shards: int, order: int, cut: int) -> DataFrame:
    """Each task's flushes, packed by shard: (shard, flush, kind, a, b, c, d).

    Kind 0: ids, training marks and lengths of a flush's texts, the ranks of its distinct tokens, and the rank at each place.
    Kind k: its distinct n-grams of k tokens of one shard, with their counts in training texts.
    """
    names = ["shard", "flush", "kind", "a", "b", "c", "d"]
    schema = "shard int, flush long, kind int, a binary, b binary, c binary, d binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        number = 0
        held: list[tuple] = []
        ids: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, ids, marks, size
            key = (part << 24) | number
            number += 1
            tokens, train, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            unique, of = np.unique(tokens, return_inverse=True)
            about = _planes(lengths, 4) + np.concatenate(marks).astype(np.uint8).tobytes()
            # frequent tokens get small numbers, whose planes are short
            rank = np.empty(len(unique), np.int64)
            rank[np.argsort(-np.bincount(of), kind="stable")] = np.arange(len(unique))
            rows = [(int(key % shards), key, 0, np.concatenate(ids).tobytes(), _tight(about), _tight(_planes(rank, 4)), _tight(_planes(rank[of], 4)))]

            def own(kind: int, grams: np.ndarray, at: np.ndarray, learn: np.ndarray) -> None:
                learned = np.bincount(at[learn], minlength=len(grams))
                edge = np.searchsorted(shard_of(grams if kind == 1 else grams << U64(cut), shards), np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(edge)).tolist():
                    some = slice(edge[s], edge[s + 1])
                    rows.append((s, key, kind, _tight(_rising(grams[some], 8)), _tight(_planes(learned[some], 4)), b"", b""))

            own(1, unique, of, train)
            for kind, (places, grams) in enumerate(_grams(tokens, np.cumsum(lengths) - lengths, order, cut), 2):
                own(kind, *np.unique(grams, return_inverse=True), train[places])
            held, ids, marks, size = [], [], [], 0
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            row_key = batch.column("row_key").to_numpy()
            learn = ~np.array(batch.column("held_out").to_pylist(), bool)
            for w in words(batch.column("text"), WHITE, "ascii"):
                tokens, text = _streams(w)
                held.append((tokens, learn[w.lo + text], np.diff(w.where) + 1))
                ids.append(row_key[w.lo : w.hi])
                marks.append(learn[w.lo : w.hi])
                size += len(tokens)
                if size >= FLUSH:
                    yield flush()
        if held:
            yield flush()
        release()

    return docs.select("row_key", "held_out", "text").mapInArrow(send, schema)


_SHARD = "kind int, flush long, shard int, a binary, b binary, c binary, d binary, n1 long, n2 long"
#: The kind of a shard's totals.
_TOTALS = 100


def _merge_shard(bits: int):
    """A function of a shard's packed counts of one kind: levels, and tokens' counts, of each flush's n-grams; and totals."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        shard, kind = int(rows[0]["shard"]), int(rows[0]["kind"])
        out: list[tuple] = []
        if kind == 0:
            out = [(0, r["flush"], shard, r["a"], r["b"], r["c"], r["d"], 0, 0) for r in rows]
        else:
            grams = [_from_rising(_loose(r["a"]), 8) for r in rows]
            keys, counts = _add(np.concatenate(grams), np.concatenate([_from_planes(_loose(r["b"]), 4).astype(np.int64) for r in rows]))
            known = counts > 0
            part = build(keys[known], level_of(counts[known]), bits)
            levels = Filter(*Filter.joined([(0, part)], 1)).level(keys).astype(np.uint8)
            for r, g in zip(rows, grams, strict=True):
                at = np.searchsorted(keys, g)
                exact = _tight(_planes(counts[at], 6)) if kind == 1 else b""
                # the flush gets its tokens back, and makes longer n-grams from them again
                out.append((kind, r["flush"], shard, _tight(levels[at].tobytes()), exact, r["a"] if kind == 1 else b"", b"", 0, 0))
            if kind == 1:
                out.append((_TOTALS, -1, shard, b"", b"", b"", b"", int(counts.sum()), int(known.sum())))
        cols = list(zip(*out, strict=True))
        kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.int64())
        del rows
        release()
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "flush", "shard", "a", "b", "c", "d", "n1", "n2"])

    return merge


_FLUSH = "ids binary, lengths binary, train binary, logs binary, known binary, levels binary, end int"


def _flush_levels(order: int, cut: int):
    def levels_of(key: tuple, table: pa.Table) -> pa.Table:
        """One flush: of each text the sum of logarithms and the known tokens, of each place the levels of its n-grams, order by order."""
        rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["shard"]))
        if rows[0]["kind"] == _TOTALS:
            sums = np.array([sum(r[c] for r in rows) for c in ("n1", "n2")], np.int64)
            return pa.table([*(pa.array([c], pa.binary()) for c in (b"", b"", b"", b"", sums.tobytes(), b"")), pa.array([-1], pa.int32())], names=[x.split()[0] for x in _FLUSH.split(", ")])
        ids, about = rows[0]["a"], _loose(rows[0]["b"])
        texts = len(ids) // 8
        lengths = _from_planes(about[: 4 * texts], 4).astype(np.int64)
        unique = np.concatenate([_from_rising(_loose(r["c"]), 8) for r in rows if r["kind"] == 1])
        of = np.argsort(_from_planes(_loose(rows[0]["c"]), 4))[_from_planes(_loose(rows[0]["d"]), 4).astype(np.int64)]
        # shards are ranges of hashes, so their answers follow one another in the order of the hashes
        answer = lambda kind: np.frombuffer(b"".join(_loose(r["a"]) for r in rows if r["kind"] == kind), np.uint8)
        counts = np.concatenate([_from_planes(_loose(r["b"]), 6) for r in rows if r["kind"] == 1]).astype(np.int64)[of]
        tokens, text, first = unique[of], np.repeat(np.arange(texts), lengths), np.cumsum(lengths) - lengths
        one = answer(1)
        end = int(one[np.searchsorted(unique, END)])
        found = [one[of]]
        for kind, (places, grams) in enumerate(_grams(tokens, first, order, cut), 2):
            own = np.zeros(len(tokens), np.uint8)
            own[places] = answer(kind)[np.unique(grams, return_inverse=True)[1]]
            # an n-gram is no more frequent than its parts
            found.append(np.minimum(own, np.minimum(found[-1], _context(found[-1], first, end if kind == 2 else 0))))
        logs = np.bincount(text, np.log10(counts + 0.5), texts)
        known = np.bincount(text, counts > 0, texts).astype(np.int64)
        cols = (ids, lengths.tobytes(), about[4 * texts :], logs.tobytes(), known.tobytes(), _tight(np.concatenate(found).tobytes()))
        release()
        return pa.table([*(pa.array([c], pa.binary()) for c in cols), pa.array([end], pa.int32())], names=[x.split()[0] for x in _FLUSH.split(", ")])

    return levels_of


def _context(levels: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """The level of what stands before each place; start at a text's first one."""
    out = np.concatenate((levels[:1], levels[:-1]))
    out[first] = start
    return out


def _opened(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[dict]:
    """The flushes of staged batches, as arrays; grams is a list of (level, context's level) for 2 to `order` tokens."""
    kinds = {"ids": np.int64, "lengths": np.int64, "train": np.uint8, "logs": np.float64, "known": np.int64}
    for batch in batches:
        for i in range(batch.num_rows):
            x = {c: np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in kinds.items()}
            levels = np.frombuffer(_loose(batch.column("levels")[i].as_py()), np.uint8).reshape(order, -1)
            first, end = np.cumsum(x["lengths"]) - x["lengths"], batch.column("end")[i].as_py()
            x["one"] = levels[0]
            x["grams"] = [(levels[k], _context(levels[k - 1], first, end if k == 1 else 0)) for k in range(1, order)]
            yield x


def score(docs: DataFrame, held_out: Column, shard_chars: int = 24 << 20, bits: int = BITS, order: int = ORDER, spare: int = SPARE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text).

    shard_chars: text whose n-grams of one order a shard holds. bits: the filter's size an event. spare: see SPARE.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), held_out.alias("held_out"))
    # rows with one key are equal rows, and so are their scores
    docs = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0]  # one number
    shards = max(1, -(-(chars or 0) // shard_chars))

    cut = max(0, 64 - spare - max(16, int(chars or 1).bit_length()))
    packed = _pack_docs(docs, shards, order, cut)
    merged = packed.groupBy("shard", "kind").applyInArrow(_merge_shard(bits), _SHARD)
    every = stage(merged.groupBy("flush").applyInArrow(_flush_levels(order, cut), _FLUSH), "lm-levels")
    totals = every.where("end < 0").select("known").collect()  # one row
    tokens, distinct = np.frombuffer(totals[0][0], np.int64).tolist() if totals else (0, 0)
    norm = math.log10(tokens + 0.5 * (distinct + 1))
    flushes = every.where("end >= 0")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((order + 1, len(MIDDLE), len(MIDDLE)), np.int64)
        for x in _opened(batches, order):
            train = np.repeat(x["train"] > 0, x["lengths"])
            for k, (own, ahead) in enumerate(x["grams"], 2):
                cells = own[train].astype(np.int64) * len(MIDDLE) + ahead[train]
                total[k] += np.bincount(cells, minlength=len(MIDDLE) ** 2).reshape(total[k].shape)
        k, own, ahead = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (k, own, ahead, total[k, own, ahead])], ["k", "own", "ahead", "n"])

    cells = flushes.mapInArrow(counted, "k long, own long, ahead long, n long").groupBy("k", "own", "ahead").agg(F.sum("n").alias("n")).toPandas()  # two levels an order
    fitted = [_fit(cells[cells["k"] == k]) for k in range(2, order + 1)]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _opened(batches, order):
            p = (MIDDLE[x["one"]] + 0.5) / 10**norm
            for (own, ahead), (left, mass) in zip(x["grams"], fitted, strict=True):
                p = left[own] * np.minimum(MIDDLE[own] / np.maximum(MIDDLE[ahead], 1), 1) + (1 - mass[ahead]) * p
            total = np.bincount(np.repeat(np.arange(len(x["lengths"])), x["lengths"]), np.log10(p), len(x["lengths"]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x["ids"], x["lengths"], x["known"], x["logs"], total)], ["row_key", "n_tokens", "n_known", "logs", "score"])

    each = flushes.mapInArrow(scored, "row_key long, n_tokens long, n_known long, logs double, score double").dropDuplicates(["row_key"])
    base_score = F.col("logs") - F.col("n_tokens") * F.lit(norm)
    return docs.select("doc_id", "held_out", "row_key").join(each, "row_key").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base_score.alias("base_score"), "score")


def _fit(cells: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(share of an n-gram's count that stays, mass of seen n-grams by level of context) from counts of (own, ahead) levels."""
    own, ahead = (cells[c].to_numpy(np.int64) for c in ("own", "ahead"))
    n = cells["n"].to_numpy(np.float64)
    of = np.bincount(own, n, len(MIDDLE))
    left = np.zeros(len(MIDDLE))
    # the first levels are single counts
    for r in range(1, 6):
        left[r] = min(max(of[r + 1] / of[r] if of[r] else 1.0, 1e-3), 0.999)
    left[1:6] = np.maximum.accumulate(left[1:6])
    left[6:] = np.maximum(left[5], 1 - 5 * (1 - left[5]) / MIDDLE[6:])
    mass = np.bincount(ahead, n * left[own], len(MIDDLE)) / np.maximum(np.bincount(ahead, n, len(MIDDLE)), 1)
    mass[0] = 0
    return left, np.clip(mass, 0, 0.999)
