"""Best-fit packing of tokenised documents into sequences of bounded length.

The plan comes from the histogram of piece lengths, which has at most `capacity`
entries however many documents there are. A configuration linear program over it
(which multisets of length classes share a sequence, and how often) is solved by
multiplicative weights: each round prices the classes by how far behind they are
and a knapsack dynamic program finds the best configuration at these prices. The
program's solution is then rounded: each configuration is filled with real lengths,
the last place by the best fit, and what is left over is packed by best fit too.
A plan is a list of patterns with counts; pieces find their place by their rank
among the pieces of equal length, so no document passes through the driver.

Nulls: a null text counts as empty (it has the end token only); a null doc_id is
kept as it is. Very long texts are cut into pieces. Repeated rows are packed once
each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import release
from .scratch import stage

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Texts of other characters than these take the tokenizer's own way, whole (U+001C to U+001F separate words for
#: Python and not for the tokenizer).
_PLAIN = re.compile("[\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-ſ‐-‧]*")
#: Words as the tokenizer's own split finds them, for plain characters.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Bytes of a worker's memories of chunks and of parts, with what an entry costs beside its text and ids; each starts
#: anew when full. A chunk or part longer than _LONG isn't remembered.
_MOST_CHUNKS, _MOST_PARTS, _ENTRY, _LONG = 160 << 20, 110 << 20, 160, 1 << 10


class CachedTokenizer:
    """Token ids as bytes (little-endian unsigned 32-bit), equal to Tokenizer.encode on every text.

    The tokenizer splits at white space and into words, digits and marks before it
    merges, so the ids of a text are those of its parts in a row. Each part is
    encoded once and remembered. Texts with rare characters or special tokens are
    encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closing = np.zeros(max(vocab.values()) + 1, bool)
        self.closing[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.split_ok = b"" not in self._parts_of(["a", "!", "7"])
        self.chunks: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.chunk_bytes = self.part_bytes = 0

    def _parts_of(self, parts: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode(" ".join(parts), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.closing[ids]) + 1
        if len(ends) != len(parts) or (len(parts) and ends[-1] != len(ids)):
            return [b""] * len(parts)
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of these chunks (lower case, without white space), remembered where they are short."""
        if self.part_bytes > _MOST_PARTS:
            self.parts, self.part_bytes = {}, 0
        cut = {c: _PARTS.findall(c) for c in new}
        miss = list({p for ps in cut.values() for p in ps if p not in self.parts})
        own: dict[str, bytes] = {}
        for k in range(0, len(miss), 4000):
            some = miss[k : k + 4000]
            for p, ids in zip(some, self._parts_of(some), strict=True):
                own[p] = ids = ids or self._whole(p)
                if len(p) <= _LONG:
                    self.parts[p] = ids
                    self.part_bytes += 2 * len(p) + len(ids) + _ENTRY
        parts = self.parts
        got = {c: b"".join([parts[p] if p in parts else own[p] for p in ps]) for c, ps in cut.items()}
        for c, ids in got.items():
            if len(c) <= _LONG:
                self.chunks[c] = ids
                self.chunk_bytes += 2 * len(c) + len(ids) + _ENTRY
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        cut: list[list[str] | None] = []
        for t in texts:
            plain = self.split_ok and _PLAIN.fullmatch(t) and "<|" not in t and unicodedata.is_normalized("NFC", t)
            cut.append(t.lower().split() if plain else None)
        if self.chunk_bytes > _MOST_CHUNKS:
            self.chunks, self.chunk_bytes = {}, 0
        known = self.chunks
        new = self.learn(list({c for x in cut if x for c in x if c not in known}))
        long = {c: ids for c, ids in new.items() if len(c) > _LONG}
        return [self._whole(t) if x is None else b"".join([known[c] if c in known else long[c] for c in x]) for t, x in zip(texts, cut, strict=True)]


_TOKENIZERS: dict[str, CachedTokenizer] = {}


def _tokenizer(path: str | None) -> CachedTokenizer:
    """One tokenizer a worker process; None: the public vocabulary file of this machine."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most `capacity` tokens of every document, without the ids themselves."""
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer_path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            for k in range(0, len(ids), 256):
                for doc, raw in zip(ids[k : k + 256], tok.encode([t or "" for t in texts[k : k + 256]]), strict=True):
                    raw += end
                    for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, PIECES)


def knapsack(prices: np.ndarray, room: int) -> list[int]:
    """The multiset of sizes 1..len(prices) within `room` of the highest total price (repeats allowed)."""
    best = np.zeros(room + 1)
    pick = np.zeros(room + 1, int)
    for c in range(1, room + 1):
        n = min(c, len(prices))
        value = best[c - n : c][::-1] + prices[:n]
        k = int(value.argmax())
        if value[k] > best[c - 1]:
            best[c], pick[c] = value[k], k + 1
        else:
            best[c], pick[c] = best[c - 1], 0
    out, c = [], room
    while c > 0:
        if pick[c]:
            out.append(int(pick[c]))
            c -= int(pick[c])
        else:
            c -= 1
    return out


def configurations(demand: np.ndarray, room: int, rounds: int = 600, rate: float = 8.0) -> list[tuple[tuple[int, ...], float]]:
    """A fractional solution of the configuration program: (sizes, how often), by multiplicative weights.

    demand[s - 1] pieces have size s. Every round adds the same mass of the configuration
    that is best at the present prices; a size's price falls as its demand is met.
    """
    sizes = np.arange(1, len(demand) + 1)
    need = demand > 0
    total = float((demand * sizes).sum()) / room
    if not need.any():
        return []
    step = total / rounds
    met = np.zeros(len(demand))
    made: dict[tuple[int, ...], float] = {}
    for t in range(rounds):
        behind = np.where(need, (t + 1) / rounds - met / np.maximum(demand, 1), 0)
        prices = np.where(need, sizes * np.exp(rate * np.clip(behind, -4, 4)), 0.0)
        prices[met >= demand] = 0
        config = tuple(sorted(knapsack(prices, room), reverse=True))
        if not config:
            break
        used, count = np.unique(config, return_counts=True)
        mass = float(min(step, ((demand - met)[used - 1] / count).min()))
        made[config] = made.get(config, 0.0) + mass
        met[used - 1] += mass * count
    return sorted(made.items(), key=lambda x: (-x[1], x[0]))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, classes: int = 256) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, how many)], number of sequences) that hold every piece of the histogram once.

    The number of patterns is bounded by the number of lengths and configurations, not by that of pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    below = list(range(capacity + 1))  # below[x]: a length at most x, or on the way to one, that still has pieces

    def largest(x: int) -> int:
        path = []
        while x > 0 and (below[x] != x or left[x] == 0):
            path.append(x)
            x = below[x] if below[x] != x else x - 1
        for p in path:
            below[p] = x
        return x

    out: list[tuple[list[tuple[int, int]], int]] = []

    def fill(slots: list[int], most: int) -> int:
        """One pattern for these slots, topped up by best fit, as often as pieces and `most` allow."""
        room, used = capacity, {}

        def take(limit: int, many: bool) -> bool:
            nonlocal room
            x = largest(limit)
            while x > 0 and used.get(x, 0) >= left[x]:
                x = largest(x - 1)
            if x <= 0:
                return False
            n = min(room // x, int(left[x]) - used.get(x, 0)) if many else 1
            used[x] = used.get(x, 0) + n
            room -= x * n
            return True

        for s in slots[:-1]:
            if room <= 0 or not take(min(s, room), False):
                break
        while room > 0 and take(room, bool(used)):
            pass
        if not used:
            return 0
        k = min(most, min(int(left[x]) // n for x, n in used.items()))
        for x, n in used.items():
            left[x] -= k * n
        out.append((sorted(used.items(), reverse=True), k))
        return k

    width = max(1, capacity // classes)
    room = capacity // width
    demand = np.zeros(room, np.int64)
    for length in range(1, capacity):
        demand[min(room, -(-length // width)) - 1] += left[length]
    for config, often in configurations(demand, room):
        todo = int(often)
        while todo > 0:
            k = fill([c * width for c in config], todo)
            if not k:
                break
            todo -= k
    while left.any():
        fill([], int(left.sum()))
    return out


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, salts: int = 128) -> DataFrame:
    """Every piece with the sequence that holds it and its offset there (see the module's text).

    salts: a length's pieces are ranked in so many groups, so one frequent length is no hot spot.
    """
    spark = docs.sparkSession
    pieces = stage(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").count().toPandas()  # at most capacity * salts rows
    counts = counts.sort_values(["length", "salt"])
    lengths, salt, n = (counts[c].to_numpy(np.int64) for c in ("length", "salt", "count"))
    totals = {int(x): int(n[lengths == x].sum()) for x in np.unique(lengths)} if len(n) < 1000 else {int(x): int(y) for x, y in enumerate(np.bincount(lengths, n).astype(np.int64)) if y}
    before = np.cumsum(n) - n
    first = np.r_[True, lengths[1:] != lengths[:-1]] if len(n) else np.zeros(0, bool)
    start_of = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(n)])) if len(n) else before

    patterns = plan(totals, capacity)
    cursor: dict[int, int] = {}
    runs, base = [], 0
    for items, k in patterns:
        offset = 0
        for length, many in items:
            at = cursor.get(length, 0)
            runs.append((length, at, k, base, offset))
            cursor[length] = at + k * many
            offset += length * many
        base += k
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((lengths * salts + salt, start_of, (table[:, 0] << 44) | table[:, 1], table))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, offsets, keys, plan_rows = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy(zero_copy_only=False)
            group = length * salts + batch.column("salt").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False) - 1 + offsets[np.searchsorted(groups, group)]
            row = plan_rows[np.searchsorted(keys, (length << 44) | rank, "right") - 1]
            j = rank - row[:, 1]
            sequence, offset = row[:, 3] + j % row[:, 2], row[:, 4] + (j // row[:, 2]) * length
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")).cast("long"))
    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
