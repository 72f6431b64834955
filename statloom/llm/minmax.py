"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct `width`-word shingles (words: what stands between
ASCII white space, A-Z in lower case; a text of fewer words is one shingle). Every
permutation gives two values, its minimum and its maximum over the set, so a signature of
2 p values takes p hash evaluations a shingle; both agree between two sets with the chance
of their Jaccard similarity, and the share of equal values has less variance than that of
2 p minima. Bands of `rows` values put sets into buckets. With 120 permutations, bands of six
values and 40 bands a pair at 0.8 shares no bucket with a chance of 5e-6.

Documents with equal sets are linked at once and one goes on for all. Buckets of the same sets
count once. In a bucket the pairs that look similar by 64 of the signature's values (from
five deviations below the threshold on) connect a candidate group; a bucket of more than
`bucket` sets is compared with its smallest set, and only what stays unconnected in
blocks of pairs. The groups are then confirmed on the whole sets: a group is cut into parts
of bounded bytes, each of which holds the group's first set too, so a group of near copies
is connected through it in one pass. In groups of several parts, sets that aren't connected by then
are compared across parts. Only edges that connect leave a task, never a group's pairs.

Result: a row a document with n_shingles (size of its set), component_id (the smallest
doc_id it is linked with, over any number of links, itself included) and kept (doc_id =
component_id).

A null or empty text, or one without words, has an empty set and no links. A row without
doc_id has no links and a null component_id and kept. Rows that repeat a doc_id count each
as a row, with different texts too. Ties don't arise, as similarities are compared as
integers. An empty table gives no rows. Other columns are ignored. Sets are told apart by
64-bit hashes: among n different sets two are taken for one with a chance of n**2 / 2**65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import U64, WHITE, mix, release, shingles, words
from .components import components, thinned
from .pathjoin import BINS, _beside, _blocks, _compare, _stars, fingerprint
from .scratch import stage

#: Most sets of a part of a group; and bytes of sets that a task holds of it.
PART_SETS, PART_BYTES = 768, 4 << 20
#: Ids that are broadcast to leave out the texts of other documents before a shuffle; beyond it all texts are shuffled.
FEW_IDS = 2_000_000
#: Buckets whose keys are broadcast; beyond it the keys of all bands are shuffled a second time.
FEW_NODES = 1_000_000
U32 = np.uint32


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and terms of n bijections on 32-bit values."""
    seeds = mix(np.arange(1, n + 1, dtype=U64) * U64(0xA24BAED4963EE407))
    return (seeds >> U64(32)).astype(U32) | U32(1), seeds.astype(U32)


def signatures(sets: list[np.ndarray], perms: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(sets, 2 x permutations): each permutation's minimum and maximum; the sets aren't empty."""
    a, b = perms
    out = np.empty((len(sets), 2 * len(a)), U32)
    if not sets:
        return out
    starts = np.cumsum([0, *(len(x) for x in sets[:-1])])
    flat = np.concatenate(sets).astype(U32)
    h = np.empty_like(flat)
    for i in range(len(a)):
        np.multiply(flat, a[i], out=h)
        h += b[i]
        out[:, 2 * i] = np.minimum.reduceat(h, starts)
        out[:, 2 * i + 1] = np.maximum.reduceat(h, starts)
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands): a 64-bit hash of each band's place and values."""
    bands = sig.shape[1] // rows
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U64)), (len(sig), bands)).copy()
    values = sig[:, : bands * rows].reshape(len(sig), bands, rows).astype(U64)
    for r in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + values[:, :, r])
    return key


def _rows(docs: DataFrame, width: int, perms: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, fp, sk, keys): fingerprint, short signature and band keys of every row's set, null where it is empty."""
    made = permutations(perms)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, fp, sk, keys = [], [], [], []
            for w in words(batch.column("text"), WHITE, "ascii"):
                sets = list(shingles(w, width))
                full = [x for x in sets if len(x)]
                sig = signatures(full, made)
                bands = iter(band_keys(sig, rows).view(np.int64))
                short = iter(sig[:, :BINS])
                for x in sets:
                    size.append(len(x))
                    fp.append(fingerprint(x) if len(x) else None)
                    sk.append(next(short).tobytes() if len(x) else None)
                    keys.append(next(bands) if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(fp, pa.int64()), pa.array(sk, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "fp", "sk", "keys"])
        release()

    return docs.mapInArrow(make, "doc_id long, n_shingles long, fp long, sk binary, keys array<long>")


def _candidates(reps: DataFrame, at_least: float, bucket: int) -> DataFrame:
    """Edges (a, b) that connect the sets that look similar in some bucket."""
    sets = reps.select("rep", "sk")
    keys = reps.select("rep", F.explode("keys").alias("node"))
    shared = keys.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high"), F.bit_xor(F.xxhash64("rep")).alias("same")).where("n > 1")
    shared = stage(shared.groupBy("n", "low", "high", "same").agg(F.min("node").alias("node")), "buckets")
    pairs = shared.where("n = 2").select("node", F.explode(F.array("low", "high")).alias("rep"))
    several = shared.where((F.col("n") > 2) & (F.col("n") <= bucket)).select("node")
    small = keys.join(F.broadcast(several) if several.count() <= FEW_NODES else several, "node").select("node", "rep").unionByName(pairs)
    found = stage(thinned(_compare(small, sets, at_least)), "found")
    wide = shared.where(F.col("n") > bucket).select("node")
    if wide.isEmpty():
        return found
    large = stage(_beside(keys, wide, "node").select("node", "rep"), "large")
    found = stage(thinned(found.unionByName(_stars(large, sets, at_least))), "found")
    rows = stage(large.join(components(found).withColumnRenamed("id", "rep"), "rep", "left").select("node", "rep", F.coalesce("root", "rep").alias("root")), "rooted")
    by_root = rows.groupBy("node", "root").agg(F.count("*").alias("k"))
    mixed = by_root.groupBy("node").agg(F.max_by("root", "k").alias("most"), F.max("k").alias("in_most"), F.sum("k").alias("n"))
    mixed = stage(mixed.where("in_most < n"), "mixed")
    return found.unionByName(_compare(_blocks(rows, mixed, bucket), sets, at_least))


def _common(sets: list[np.ndarray], some: np.ndarray) -> np.ndarray:
    """(some, sets): sizes of the intersections of the chosen sets with all."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    new = np.concatenate(([True], token[1:] != token[:-1]))
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    keep = often[column]
    owner, column = owner[keep], (np.cumsum(often) - 1)[column[keep]]
    out = np.zeros((len(some), len(sets)), np.int64)
    total = int(often.sum())
    for lo in range(0, total, 4096):
        own = slice(*np.searchsorted(column, [lo, lo + 4096]))
        m = np.zeros((len(sets), min(4096, total - lo)), np.float32)
        m[owner[own], column[own] - lo] = 1
        out += (m[some] @ m.T).astype(np.int64)  # a product is at most 4096, so exact
    return out


def connected(rep: np.ndarray, sets: list[np.ndarray], label: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Edges (rep, smaller rep) that connect what the links of these sets connect; label: groups that are connected already."""
    if len(rep) < 2:
        return []
    order = np.argsort(rep)
    rep, sets = rep[order], [sets[i] for i in order]
    size = np.array([len(x) for x in sets], np.int64)
    if label is None:
        hub = sets[0]
        both = np.array([int((hub[np.minimum(np.searchsorted(hub, x), len(hub) - 1)] == x).sum()) for x in sets])
        label = np.where(100 * both >= percent * (size + size[0] - both), rep[0], rep)
    else:
        label = label[order]
    kinds, of = np.unique(label, return_inverse=True)
    few = np.flatnonzero(of != np.bincount(of).argmax())
    low = np.full(len(kinds), np.iinfo(np.int64).max)
    np.minimum.at(low, of, rep)
    if len(few):
        both = _common(sets, few)
        linked = 100 * both >= percent * (size[few][:, None] + size[None, :] - both)
        while True:
            before = low.copy()
            seen = np.where(linked, low[of][None, :], np.iinfo(np.int64).max)
            np.minimum.at(low, of[few], seen.min(axis=1))
            reach = np.where(linked, low[of[few]][:, None], np.iinfo(np.int64).max).min(axis=0)
            np.minimum.at(low, of, reach)
            if (low == before).all():
                break
    least = low[of]
    return [(int(a), int(b)) for a, b in zip(rep, least, strict=True) if a != b]


def _confirm(docs: DataFrame, placed: DataFrame, width: int, percent: int) -> DataFrame:
    """Exact edges (a, b) inside each part; placed: (part, rep, doc, label), a set may stand in several parts; a null label: none is known."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, keep, sets, at = batch.column("rep").to_pylist(), [], [], 0
            for w in words(batch.column("text"), WHITE, "ascii"):
                for x in shingles(w, width):
                    if len(x) and fingerprint(x) == rep[at]:
                        keep.append(at)
                        sets.append(x.tobytes())
                    at += 1
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("part", "rep", "label")), pa.array(sets, pa.binary())], ["part", "rep", "label", "x"])
        release()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, {}

        def edges() -> list[tuple[int, int]]:
            labels = [y for y, _ in held.values()]
            own = None if not labels or labels[0] is None else np.array(labels, np.int64)
            return connected(np.fromiter(held, np.int64, len(held)), [np.frombuffer(x, U64) for _, x in held.values()], own, percent)

        for batch in batches:
            out = []
            for p, rep, label, x in zip(*(batch.column(c).to_pylist() for c in ("part", "rep", "label", "x")), strict=True):
                if p != part:
                    out += edges()
                    part, held = p, {}
                held[rep] = (label, x)
            yield _edges(out)
        yield _edges(edges())
        release()

    ids = placed.select(F.col("doc").alias("doc_id")).distinct()
    if ids.count() <= FEW_IDS:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    texts = docs.join(placed, docs["doc_id"] == placed["doc"]).select(F.explode("at").alias("part"), "rep", "label", "text")
    sets = texts.mapInArrow(load, "part long, rep long, label long, x binary")
    return sets.repartition("part").sortWithinPartitions("part").mapInArrow(link, "a long, b long")


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])


def _parts(count: str, total: str) -> F.Column:
    """Parts for so many sets of so many shingles in total."""
    return F.greatest(F.lit(1), F.ceil(F.col(count) / PART_SETS), F.ceil(F.col(total) * 8 / PART_BYTES)).cast("int")


def _exact(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (a, b) that connect what exact links connect; members: (rep, root, doc, size) of the candidate groups."""
    groups = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("rep").alias("hub"))
    groups = stage(groups.select("root", "hub", _parts("n", "total").alias("parts")), "groups")
    own = stage(_beside(members, groups, "root"), "members")
    place = lambda i: F.xxhash64("root", i)
    whole = F.when(F.col("rep") == F.col("hub"), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.xxhash64("root", i)))
    once = F.array(place(F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")))
    links = stage(_confirm(docs, own.select(F.coalesce(whole, once).alias("at"), "rep", "doc", F.lit(None).cast("long").alias("label")), width, percent), "links")
    several = own.where("parts > 1")
    if several.isEmpty():
        return links
    label = components(links).withColumnRenamed("id", "rep").withColumnRenamed("root", "label")
    rows = stage(several.drop("parts", "hub").join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "labelled")
    by_label = rows.groupBy("root", "label").agg(F.count("*").alias("k"), F.sum("size").alias("total"))
    mixed = by_label.groupBy("root").agg(F.max_by("label", "k").alias("most"), F.max("k").alias("ck"), F.max_by("total", "k").alias("ct"), F.sum("k").alias("n"), F.sum("total").alias("t"))
    mixed = mixed.where("ck < n").withColumn("rk", F.col("n") - F.col("ck")).withColumn("rt", F.col("t") - F.col("ct"))
    mixed = stage(mixed.select("root", "most", _parts("ck", "ct").alias("pc"), _parts("rk", "rt").alias("pr")), "mixed")
    if mixed.isEmpty():
        return links
    # the most frequent label's sets aren't compared with each other: parts of it with parts of the rest, and two parts of the rest
    both = _beside(rows, mixed, "root").withColumn("c", F.col("label") == F.col("most"))
    both = both.withColumn("p", F.pmod(F.xxhash64("rep", F.lit(1)), F.when(F.col("c"), F.col("pc")).otherwise(F.col("pr"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    block = lambda kind, i, j: F.xxhash64("root", F.lit(kind), i, j)
    across = F.when(F.col("c"), F.transform(upto(F.col("pr")), lambda j: block(0, F.col("p"), j))).otherwise(F.transform(upto(F.col("pc")), lambda i: block(0, i, F.col("p"))))
    rest = F.when(~F.col("c"), F.transform(upto(F.col("pr")), lambda j: block(1, F.least("p", j), F.greatest("p", j)))).otherwise(F.array().cast("array<long>"))
    more = _confirm(docs, both.select(F.concat(across, rest).alias("at"), "rep", "doc", "label"), width, percent)
    return links.unionByName(stage(more, "links"))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 2, perms: int = 120, rows: int = 6, bucket: int = 200, at_least: float | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row (see the module's text); links from `percent` of the union on.

    perms: permutations, with two values of the signature each. rows: values of a band. at_least: the share of equal values
    from which a pair is a candidate; by default five deviations of the estimate below the threshold.
    """
    t = percent / 100
    at_least = t - 5 * math.sqrt(t * (1 - t) / BINS) if at_least is None else at_least
    if 2 * perms < BINS:
        raise ValueError(f"at least {BINS // 2} permutations are needed")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = stage(_rows(docs, width, perms, rows), "minmax")
    named = own.where("fp IS NOT NULL AND doc_id IS NOT NULL")
    reps = named.groupBy(F.col("fp").alias("rep")).agg(F.min("doc_id").alias("doc"), F.count("*").alias("n"), F.first("n_shingles").alias("size"), F.first("sk").alias("sk"), F.first("keys").alias("keys"))
    reps = stage(reps, "reps")
    group = components(_candidates(reps.select("rep", "sk", "keys"), at_least, bucket))
    members = group.unionByName(group.select(F.col("root").alias("id"), "root").distinct()).withColumnRenamed("id", "rep")
    members = members.join(reps.select("rep", "doc", "size"), "rep")
    linked = components(_exact(docs, members, width, percent)).withColumnRenamed("id", "rep")
    linked = linked.unionByName(linked.select(F.col("root").alias("rep"), "root").distinct())
    of = linked.join(reps.select("rep", "doc"), "rep")
    least = stage(of.groupBy("root").agg(F.min("doc").alias("least")), "least")
    known = _beside(of.select("rep", "root"), least, "root").select("rep", "least")
    # only sets that are shared or linked have another smallest doc_id than the row's own
    classes = reps.select("rep", "doc", "n").join(known, "rep", "left").where("n > 1 OR least IS NOT NULL")
    classes = stage(classes.select(F.col("rep").alias("fp"), F.coalesce("least", "doc").alias("least")), "classes")
    every = own.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("fp")).alias("fp"), F.xxhash64("doc_id", "n_shingles").alias("spread"))
    found = _beside(every, classes, "fp", "left", salt="spread")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
