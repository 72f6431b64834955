"""Near-duplicate documents by a chosen-path set-similarity join.

A document is the set of its five-word shingles (words: letters and digits, lower
case; a shorter text is one shingle). Documents with equal sets form a copy class at
once. One representative a class goes on: a sketch of minimum hashes samples tokens
of its set, and in each run the sets walk down a tree in which a node splits its sets
by the token they have at a position that the path so far selects. Nodes of at most
`bucket` sets are compared by brute force and larger ones are split again. The number
of runs is the one that the target recall needs for a pair at the threshold.

Nodes that are still large after a round's splits are compared in blocks, but for pairs
that are connected already. The sets of very large ones go to a next round instead, which
splits deeper and makes the more runs that this needs; after the last round all that is
left is compared in blocks.

Pairs found so are candidates. Their connected groups are then compared exactly, on
the whole shingle sets, in blocks of bounded size; counts of links are added up and
only as many links as connect a group leave a task, so a group of n near copies costs
no n * n rows. Counting its links takes all its pairs of blocks, of up to 768 sets.

Result: a row a document with class_id (the smallest doc_id it is linked with, over
any number of links), copy_id (the smallest doc_id with an equal set) and n_links (how
many other rows are linked with it directly, copies included).

A null or empty text, or one without letters and digits, has no links and its own
class. A row without doc_id is kept, without class. Rows that repeat a doc_id count
each as a row, with different texts too. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import U64, mix, release, shingles, words
from .components import components
from .scratch import stage, unused

BINS = 64
#: Tasks that the rows of one large node are dealt to, rows of a table (of some numbers, or with sketches) that is broadcast,
#: splits between two looks at the sketches, and sets of a block.
SALTS, FEW, FEW_SKETCHES, LEVELS, BLOCK_SETS = 32, 100_000, 10_000, 3, 768
#: A node of so many buckets isn't split further: its pairs of blocks are compared, so a set is copied so many times at most.
SPAN = 16
_EDGES = np.arange(BINS + 1, dtype=U64) << U64(58)
#: Where an empty bin borrows its value: for each bin the order in which the others are asked.
_BORROW = np.argsort(mix(np.arange(1, BINS * BINS + 1, dtype=U64)).reshape(BINS, BINS), axis=1)


def fingerprint(x: np.ndarray) -> int:
    """A 64-bit hash of a set, given as sorted distinct hashes."""
    one = np.array([len(x)], U64)
    return int(mix(mix(x).sum(dtype=U64, keepdims=True) + mix(one)).view(np.int64)[0])


def sketch(x: np.ndarray) -> np.ndarray:
    """One minimum hash (32 bits) for each of BINS ranges of hash values; an empty range borrows another's."""
    at = np.searchsorted(x, _EDGES[:-1])
    full = np.concatenate((at[1:], [len(x)])) > at
    got = ((x[np.minimum(at, len(x) - 1)] >> U64(26)) & U64(0xFFFFFFFF)).astype(np.uint32)
    if not full.all():
        empty = np.flatnonzero(~full)
        order = _BORROW[empty]
        lender = order[np.arange(len(empty)), full[order].argmax(axis=1)]
        got[empty] = got[lender] ^ (empty.astype(np.uint32) * np.uint32(0x9E3779B9))
    return got


def runs_for(recall: float, threshold: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met with this chance, `depth` splits deep."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(row, doc_id, fp, sk, size): fingerprint, sketch and size of every row's set; null where there are no words."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, sk, size = [], [], []
            for w in words(batch.column("text")):
                for x in shingles(w, width):
                    fp.append(fingerprint(x) if len(x) else None)
                    sk.append(sketch(x).tobytes() if len(x) else None)
                    size.append(len(x) or None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(fp, pa.int64()), pa.array(sk, pa.binary()), pa.array(size, pa.int64())], ["row", "doc_id", "fp", "sk", "size"])
        release()

    return docs.mapInArrow(make, "row long, doc_id long, fp long, sk binary, size long")


_RISE = U64(0x9E3779B97F4A7C15)


def _start(run: np.ndarray) -> np.ndarray:
    return mix(run.astype(U64) + U64(1))


def _next(sk: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The child node of each sketch: a node's key selects the sampled token that splits its sets."""
    at = (key >> U64(40)).astype(np.int64) % BINS
    return mix(key + _RISE * (sk[np.arange(len(sk)), at].astype(U64) + U64(1)))


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BINS)


def _down(df: DataFrame, levels: int, runs: range | None = None) -> DataFrame:
    """(rep, k0, ..): the next nodes of every set's paths; df is (rep, sk), a row a set, or (rep, node, sk), a row a path."""
    names = [f"k{i}" for i in range(levels)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sk = _sketches(batch.column("sk"))
            for run in runs if runs is not None else (None,):
                key = batch.column("node").to_numpy().view(U64) if run is None else np.repeat(_start(np.array([run])), len(sk))
                cols = []
                for _ in names:
                    key = _next(sk, key)
                    cols.append(pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("rep"), *cols], ["rep", *names])

    return df.mapInArrow(walk, "rep long, " + ", ".join(f"{k} long" for k in names))


def _salt(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _beside(rows: DataFrame, nodes: DataFrame, by: str, how: str = "inner", salt: str = "rep") -> DataFrame:
    """rows joined with nodes (a written table, a row a value of `by`), however many rows share one value.

    A small table of nodes is broadcast; a larger one is copied to SALTS salts, so that a node's rows are dealt to several tasks.
    """
    if nodes.count() <= FEW:
        return rows.join(F.broadcast(nodes), by, how)
    spread = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return _salt(rows, salt).join(spread.hint("merge"), [by, "salt"], how).drop("salt")


def _split(sets: DataFrame, runs: range, depth: int, bucket: int) -> tuple[list[DataFrame], DataFrame]:
    """(small, large): (node, rep) of the nodes that `depth` splits or fewer made small, a table a split; and of those still large."""
    names = [f"k{i}" for i in range(min(depth, LEVELS))]
    live = stage(_down(sets, len(names), runs), "paths")
    small: list[DataFrame] = []
    for d in range(depth):
        name = names[d % LEVELS]
        if d and d % LEVELS == 0:
            last = names[-1]
            live = stage(_down(live.select("rep", F.col(last).alias("node")).join(sets, "rep"), len(names)), "paths")
        heavy = stage(live.groupBy(name).agg(F.count("*").alias("size")).where(F.col("size") > bucket).select(name, F.lit(True).alias("heavy")), "heavy")
        tagged = _beside(live, heavy, name, "left")
        # at most `bucket` sets a node are left here
        own = tagged.where("heavy IS NULL").groupBy(F.col(name).alias("node")).agg(F.collect_list("rep").alias("reps")).where("size(reps) > 1")
        small.append(own.select("node", F.explode("reps").alias("rep")))
        live = stage(tagged.where("heavy").drop("heavy"), "paths")
        if live.isEmpty():
            break
    return small, live.select(F.col(names[d % LEVELS]).alias("node"), "rep")


def _pairs(node: np.ndarray, rep: np.ndarray, side: np.ndarray | None, sk: np.ndarray, at_least: float) -> list[tuple[int, int]]:
    """Edges that connect the similar sets of each node (rows sorted by node); with sides, those between two sides only."""
    parent = np.arange(len(rep))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for step in range(1, len(rep)):
        left = np.flatnonzero(node[:-step] == node[step:])
        if not len(left):
            break
        if side is not None:
            left = left[side[left] != side[left + step]]
        for at in range(0, len(left), 1 << 16):
            i = left[at : at + (1 << 16)]
            alike = (sk[i] == sk[i + step]).mean(axis=1) >= at_least
            for x in i[alike].tolist():
                a, b = top(x), top(x + step)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((int(rep[x]), int(rep[x + step])))
    return out


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])


def _compare(nodes: DataFrame, sets: DataFrame, at_least: float) -> DataFrame:
    """Edges (a, b) that connect the sets that look similar in some node of (node, rep), or (node, side, rep) with sides."""
    sided = "side" in nodes.columns
    own = ["node", "rep", *(["side"] if sided else []), "sk"]

    def edges(batch: pa.RecordBatch) -> pa.RecordBatch:
        side = batch.column("side").to_numpy() if sided else None
        return _edges(_pairs(batch.column("node").to_numpy(), batch.column("rep").to_numpy(), side, _sketches(batch.column("sk")), at_least))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0] if batch.num_rows else rest
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            cut = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
            if cut:
                yield edges(batch.slice(0, cut))
            rest = batch.slice(cut)
        if rest is not None:
            yield edges(rest)
        release()

    return nodes.join(sets, "rep").select(*own).repartition("node").sortWithinPartitions("node").mapInArrow(compare, "a long, b long")


def _stars(large: DataFrame, sets: DataFrame, at_least: float) -> DataFrame:
    """Edges from the sets of large nodes to the node's smallest set, where they look similar to it."""
    pivot = large.groupBy("node").agg(F.min("rep").alias("pivot")).join(sets.select(F.col("rep").alias("pivot"), F.col("sk").alias("own")), "pivot")
    pivot = stage(pivot, "pivots")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (_sketches(batch.column("sk")) == _sketches(batch.column("own"))).mean(axis=1) >= at_least
                yield batch.select(["rep", "pivot"]).filter(pa.array(near)).rename_columns(["a", "b"])

    rows = large.join(sets, "rep")
    if pivot.count() <= FEW_SKETCHES:
        rows = rows.join(F.broadcast(pivot), "node")
    else:
        rows = _salt(rows, "rep").join(pivot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), ["node", "salt"])
    return rows.where("rep <> pivot").select("rep", "pivot", "sk", "own").mapInArrow(alike, "a long, b long")


def _blocks(rows: DataFrame, nodes: DataFrame, bucket: int) -> DataFrame:
    """(node, side, rep): pairs of parts of about `bucket` sets, which hold every pair of sets of one node and different roots.

    rows: (node, rep, root). nodes: (node, most, in_most, n): a node's most frequent root, its sets, and all sets. The sets
    of that root aren't compared with each other, so where nearly all are of it the others alone are copied.
    """
    own = _beside(rows, nodes, "node").withColumn("c", F.col("root") == F.col("most"))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / bucket)).cast("int")
    of = lambda p: F.pmod(F.xxhash64("rep", F.lit(1)), p).cast("int")
    own = own.withColumn("pc", parts(F.col("in_most"))).withColumn("pr", parts(F.col("n") - F.col("in_most")))
    own = own.withColumn("p", F.when(F.col("c"), of(F.col("pc"))).otherwise(of(F.col("pr"))))
    # blocks of parts of the frequent root with parts of the rest, and of two parts of the rest
    across = F.when(F.col("c"), F.transform(F.sequence(F.lit(0), F.col("pr") - 1), lambda j: F.struct(F.lit(0).alias("kind"), F.col("p").alias("i"), j.alias("j"))))
    across = across.otherwise(F.transform(F.sequence(F.lit(0), F.col("pc") - 1), lambda i: F.struct(F.lit(0).alias("kind"), i.alias("i"), F.col("p").alias("j"))))
    rest = F.when(~F.col("c"), F.transform(F.sequence(F.lit(0), F.col("pr") - 1), lambda j: F.struct(F.lit(1).alias("kind"), F.least("p", j).alias("i"), F.greatest("p", j).alias("j"))))
    every = own.withColumn("x", F.explode(F.concat(across, F.coalesce(rest, F.array().cast("array<struct<kind:int,i:int,j:int>>")))))
    return every.select(F.xxhash64("node", "x.kind", "x.i", "x.j").alias("node"), F.col("root").alias("side"), "rep")


def _candidates(sets: DataFrame, recall: float, threshold: float, depths: Sequence[int], bucket: int, at_least: float) -> DataFrame:
    """Edges (a, b) that connect the sets that look similar in some node.

    A round splits up to `depths[r]` times, in as many runs as a pair at the threshold needs at that depth. Nodes that are
    still large then, and whose sets aren't all connected with each other by what was found, are compared in blocks; the
    sets of those of more than SPAN buckets make up the next round instead, but for the last one.
    """
    miss = (1 - recall) / len(depths)
    found, run = None, 0
    left = sets
    for r, depth in enumerate(depths):
        runs = runs_for(1 - miss, threshold, depth)
        small, large = _split(left, range(run, run + runs), depth, bucket)
        run += runs
        for nodes in small:
            edges = _compare(nodes, left, at_least)
            found = edges if found is None else found.unionByName(edges)
        if large.isEmpty():
            return found
        found = stage(found.unionByName(_stars(large, left, at_least)), "found")
        group = components(found)
        rows = stage(large.join(group.withColumnRenamed("id", "rep"), "rep", "left").select("node", "rep", F.coalesce("root", "rep").alias("root")), "rooted")
        by_root = rows.groupBy("node", "root").agg(F.count("*").alias("k"))
        nodes = by_root.groupBy("node").agg(F.max_by("root", "k").alias("most"), F.max("k").alias("in_most"), F.sum("k").alias("n"))
        nodes = stage(nodes.where("in_most < n"), "mixed")
        last = r == len(depths) - 1
        found = found.unionByName(_compare(_blocks(rows, nodes if last else nodes.where(F.col("n") <= SPAN * bucket), bucket), left, at_least))
        wide = nodes.where(F.col("n") > SPAN * bucket).select("node")
        if last or wide.isEmpty():
            return found
        left = stage(left.join(_beside(rows, stage(wide, "wide"), "node").select("rep").distinct(), "rep", "left_semi"), "crowd")
    return found


def _exact(docs: DataFrame, members: DataFrame, width: int, threshold: float, block_bytes: int) -> DataFrame:
    """(rep, links, low): direct links of each member, weighted by copies, and a smaller member it is connected with."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, keep, sets = batch.column("rep").to_pylist(), [], []
            at = 0
            for w in words(batch.column("text")):
                for x in shingles(w, width):
                    if len(x) and fingerprint(x) == fp[at]:
                        keep.append(at)
                        sets.append(x.tobytes())
                    at += 1
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("root", "part", "parts", "rep", "n")), pa.array(sets, pa.binary())], ["root", "part", "parts", "rep", "n", "x"])

    # a block holds a bounded number of bytes and of sets, so a group of n sets is copied n / sets-a-block times
    most = F.greatest(F.ceil(F.sum("size") * 8 / block_bytes), F.ceil(F.count("*") / BLOCK_SETS)).cast("int")
    parts = stage(members.groupBy("root").agg(most.alias("parts")), "parts")
    placed = _beside(members, parts, "root").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    sets = docs.join(placed, docs["doc_id"] == placed["doc"]).select("root", "part", "parts", "rep", "n", "text").mapInArrow(load, "root long, part int, parts int, rep long, n long, x binary")
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.select("root", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "rep", "n", "x")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("root", "lo", "hi", "part", "rep", "n", "x")]
            out = []
            for root, lo, hi, part, rep, n, x in zip(*cols, strict=True):
                if (root, lo, hi) != key:
                    out += _linked(key, rows, threshold)
                    key, rows = (root, lo, hi), []
                rows.append((part, rep, n, x))
            yield _links(out)
        yield _links(_linked(key, rows, threshold))
        release()

    return pairs.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(count, "rep long, links long, low long")


def _links(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["rep", "links", "low"])


def _linked(key: tuple | None, rows: list[tuple], threshold: float) -> list[tuple[int, int, int]]:
    """Links within one block (lo = hi), or between two blocks."""
    rows = list({r[1]: r for r in rows}.values())
    if key is None or len(rows) < 2:
        return []
    sets = [np.frombuffer(r[3], U64) for r in rows]
    part, n = np.array([r[0] for r in rows]), np.array([r[2] for r in rows], np.int64)
    rep = np.array([r[1] for r in rows], np.int64)
    size = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(np.concatenate(sets), kind="stable")
    token = np.concatenate(sets)[order]
    owner = owner[order]
    new = np.concatenate(([True], token[1:] != token[:-1]))
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    keep = often[column]
    owner, column = owner[keep], (np.cumsum(often) - 1)[column[keep]]
    # between two blocks only the pairs across count
    rows_of = [np.arange(len(sets))] * 2 if key[1] == key[2] else [np.flatnonzero(part == p) for p in (key[1], key[2])]
    left, right = rows_of
    common = np.zeros((len(left), len(right)), np.float32)
    total = int(often.sum())
    for a in range(0, total, 4096):
        own = slice(*np.searchsorted(column, [a, a + 4096]))
        m = np.zeros((len(sets), min(4096, total - a)), np.float32)
        m[owner[own], column[own] - a] = 1
        common += m[left] @ m[right].T
    across = common >= threshold * (size[left][:, None] + size[right][None, :] - common) - 1e-6
    if key[1] == key[2]:
        np.fill_diagonal(across, False)
        linked = across
    else:
        linked = np.zeros((len(sets), len(sets)), bool)
        linked[np.ix_(left, right)] = across
        linked[np.ix_(right, left)] = across.T
    links = linked.astype(np.int64) @ n
    # the smallest member each one is connected with inside these blocks
    label = rep.copy()
    while True:
        seen = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        after = np.minimum(label, seen)
        if (after == label).all():
            break
        label = after
    rows_out = np.flatnonzero(links)
    return [(int(rep[i]), int(links[i]), int(label[i])) for i in rows_out]


def _classes(docs: DataFrame, threshold: float, width: int, recall: float, depths: Sequence[int], bucket: int, block_bytes: int, at_least: float | None) -> DataFrame:
    """(row, doc_id, class_id, copy_id, n_links, set) for every row; row is a hash of id and text, set names the class."""
    at_least = threshold - 3.8 * math.sqrt(threshold * (1 - threshold) / BINS) if at_least is None else at_least
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = stage(_sets(docs.withColumn("row", F.xxhash64("doc_id", "text")), width), "sets")
    # the search knows a set by its fingerprint, as a doc_id may stand for several
    named = own.where("fp IS NOT NULL AND doc_id IS NOT NULL")
    reps = stage(named.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n"), F.first("sk").alias("sk"), F.first("size").alias("size")), "reps")
    found = _candidates(reps.select(F.col("fp").alias("rep"), "sk"), recall, threshold, depths, bucket, at_least)
    group = components(found)
    members = group.unionByName(group.select(F.col("root").alias("id"), "root").distinct())
    members = members.join(reps.select(F.col("fp").alias("id"), "n", "doc", "size"), "id").withColumnRenamed("id", "rep")
    exact = stage(_exact(docs, members, width, threshold, block_bytes), "links")
    links = exact.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = components(exact.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    linked = linked.unionByName(linked.select(F.col("root").alias("id"), "root").distinct()).join(reps.select(F.col("fp").alias("id"), "doc"), "id")
    least = stage(linked.groupBy("root").agg(F.min("doc").alias("least")), "least")
    named_class = _beside(linked.select("id", "root"), least, "root", salt="id").select(F.col("id").alias("fp"), "root", "least")
    # a set that no other row has and none is linked with tells nothing beyond its own row
    known = reps.select("fp", "doc", "n").join(links.withColumnRenamed("rep", "fp"), "fp", "left").join(named_class, "fp", "left")
    known = stage(known.where("n > 1 OR links IS NOT NULL OR least IS NOT NULL"), "known")
    result = _beside(own.select("row", "doc_id", F.when(F.col("doc_id").isNotNull(), F.col("fp")).alias("fp")), known, "fp", "left", salt="row")
    others = F.coalesce(F.col("n") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    return result.select("row", "doc_id", F.coalesce("least", "doc", "doc_id").alias("class_id"), F.coalesce("doc", "doc_id").alias("copy_id"), others.cast("long").alias("n_links"), F.coalesce("root", "fp").alias("set"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.999, depths: Sequence[int] = (3, 6, 9), bucket: int = 200, block_bytes: int = 4 << 20, at_least: float | None = None) -> DataFrame:
    """(doc_id, class_id, copy_id, n_links) for every row (see the module's text).

    depths: splits of the first round and of each further one. at_least: the share of equal sketch values from which a pair
    is a candidate; by default 3.8 deviations of the sketch's estimate below the threshold, which one pair in 10,000 misses.
    """
    return _classes(docs, threshold, width, recall, depths, bucket, block_bytes, at_least).select("doc_id", "class_id", "copy_id", "n_links")


def one_of_each(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.999, depths: Sequence[int] = (3, 6, 9), bucket: int = 200, block_bytes: int = 4 << 20, at_least: float | None = None) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id, and of rows that share it that of the smallest hash.

    Rows without doc_id or without words belong to no class and stay. Rows are told apart by id and text, so different
    texts under one id are different rows. All columns stay.
    """
    rows = _classes(docs, threshold, width, recall, depths, bucket, block_bytes, at_least).where("set IS NOT NULL")
    row, keep = unused(docs, "__row"), unused(docs, "__keep")
    first = rows.groupBy("set").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    chosen = first.select(F.col("first.row").alias(row), F.lit(True).alias(keep))
    every = rows.select(F.col("row").alias(row)).distinct().join(chosen, row, "left").withColumn(keep, F.coalesce(keep, F.lit(False)))
    keyed = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))).join(every, row, "left")
    return keyed.where(F.col(keep)).dropDuplicates([row]).unionByName(keyed.where(F.col(keep).isNull())).select(*docs.columns)
