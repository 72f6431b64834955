"""Centroid clustering, min-max near duplicates and importance resampling, against brute force, SQL and odd input."""

import hashlib
import math
import os
import random
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statloom.llm import centroids, minmax, resample
from statloom.llm.bytewords import buffers

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from test_oracle import DATA, TABLES, close  # noqa: E402
from test_oracle import rows as ordered  # noqa: E402

SCHEMA = "doc_id long, text string, rep long, score long, n long, root string, node string, rank string, spread long, least long, vec_id long"


def docs(spark, rows):
    """rows: (doc_id, text); further columns have names that the operators use inside."""
    return spark.createDataFrame([(d, t, 1, 2, 3, "a", "b", "c", 4, 5, 6) for d, t in rows], SCHEMA)


def prose(seed, n, vocab=3000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "Ünïcödé ✓ text."), (4, "Ünïcödé ✓ text."), (4, "another text of this id"), (None, "no id at all here"), (None, None), (5, "x" * 2_000_000), (6, "one"), (16, "ONE"), (7, "!!! ###"), (8, prose(8, 200_000))]


# ---- clustering


def brute_clusters(rows, k=8, rounds=10):
    """(cluster, distance) by full distances in Python's integers; rows: (vec_id, vector)."""
    v = [[math.floor(1024 * x) for x in e] for _, e in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"3:{rows[i][0]}".encode()).hexdigest(), list(rows[i][1])))
    c = [list(v[i]) for i in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda: [min(range(len(c)), key=lambda j: (far(x, c[j]), j)) for x in v]
    for _ in range(rounds):
        at = near()
        for j in range(len(c)):
            own = [x for x, a in zip(v, at, strict=True) if a == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    at = near()
    return at, [far(x, c[a]) for x, a in zip(v, at, strict=True)], c


@pytest.mark.parametrize("scale", [0.3, 1e-3, 3e7])
def test_nearest_equals_full_distances(scale):
    r = np.random.default_rng(5)
    v = np.floor(r.normal(size=(500, 64)) * scale * 1024).astype(np.int64)
    c = np.concatenate([v[:40], v[:3]])  # repeated centroids and exact hits
    at, far = centroids.nearest(v, c)
    full = ((v[:, None, :].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
    want = [min(range(len(c)), key=lambda j: (row[j], j)) for row in full]
    assert at.tolist() == want and [int(x) for x in far] == [int(row[j]) for row, j in zip(full, want, strict=True)]


def test_clusters_equal_brute_force_with_ties_and_repeats(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([-0.5, 0.0, 0.001, 0.25]) for _ in range(64)]) for i in range(60)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (900, rows[3][1]), (None, rows[4][1])]
    odd = [(901, None), (902, [0.1] * 63), (903, [0.1] * 63 + [None]), (904, [0.1] * 63 + [math.nan]), (905, [math.inf] * 64), (906, [])]
    table = spark.createDataFrame([(i, e, 9, "x") for i, e in rows + odd], "vec_id long, embedding array<float>, cluster int, v string")
    exact = [(i, [float(np.float32(x)) for x in e]) for i, e in rows]
    at, far, c = brute_clusters(exact)
    out = centroids.cluster(table).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(((x["vec_id"], x["cluster"], x["distance"]) for x in out), key=key) == sorted(zip([i for i, _ in rows], at, far, strict=True), key=key)
    for x in out:
        assert x["cluster_inertia"] == sum(f for a, f in zip(at, far, strict=True) if a == x["cluster"]) and x["inertia"] == sum(far)
        assert x["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[x["cluster"]])).encode()).hexdigest()


def test_clusters_of_few_huge_or_no_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    few = centroids.cluster(spark.createDataFrame([(i, [float(i)] * 64) for i in range(3)], kind)).collect()
    assert sorted(x["cluster"] for x in few) == [0, 1, 2] and {x["inertia"] for x in few} == {0}
    huge = centroids.cluster(spark.createDataFrame([(i, [s * 1e30] * 64) for i, s in enumerate((1, -1, 1))], kind), k=1).collect()
    assert len(huge) == 3 and all(x["distance"] == 2**63 - 1 for x in huge)
    assert centroids.cluster(spark.createDataFrame([], kind)).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, None)], kind)).count() == 0


# ---- near duplicates


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} or ({tuple(w)} if w else set())


def brute_duplicates(rows):
    sets = [shingle_set(t) for _, t in rows]
    low = [d for d, _ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while True:
        before = list(low)
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
        if low == before:
            return [(d, len(s), c, None if d is None else d == c) for (d, _), s, c in zip(rows, sets, low, strict=True)]


def same(df, want):
    got = sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)
    assert got == sorted(want, key=repr)


def changed(text, n, seed):
    r, w = random.Random(seed), text.split()
    for k in range(n):
        w[r.randrange(len(w))] = f"new{seed}x{k}"
    return " ".join(w)


def test_near_duplicates_equal_brute_force(spark):
    rows = list(ODD)
    for g in range(12):
        base = prose(100 + g, 60 + 40 * g)
        rows += [(1000 + 50 * g + i, changed(base, r, 77 * g + i)) for i, r in enumerate([0, 0, 1, 2, 3, 4, 5, 7, 9, 12, 16, 20, 25, 30] * 2)]
    random.Random(1).shuffle(rows)
    same(minmax.near_duplicates(docs(spark, rows)), brute_duplicates(rows))


def test_groups_of_many_parts_and_large_buckets(spark, monkeypatch):
    # chains of copies of copies, cut into parts of few sets, in buckets that are compared in blocks
    monkeypatch.setattr(minmax, "PART_SETS", 7)
    rows, text = [], prose(3, 150)
    for i in range(90):
        text = changed(text, 4, 1000 + i)
        rows.append((500 - i, text))
    rows += [(600 + i, changed(text, i % 16, 5000 + i)) for i in range(60)]
    want = brute_duplicates(rows)
    same(minmax.near_duplicates(docs(spark, rows), bucket=5), want)
    assert len({c for _, _, c, _ in want}) > 1
    crowd = prose(9, 190)  # all alike, few linked
    rows = [(i, crowd + " " + prose(700 + i, 30)) for i in range(60)]
    same(minmax.near_duplicates(docs(spark, rows), bucket=5), brute_duplicates(rows))


def test_threshold_is_exact(spark):
    # 8 of 10 shingles shared is a link, 79 of 99 is none
    a = [f"s{i}" for i in range(200)]
    rows = [(1, " ".join(a[:10])), (2, " ".join(a[:9] + ["z"])), (11, " ".join(a[:180])), (12, " ".join(a[:160] + [f"t{i}" for i in range(20)]))]
    want = brute_duplicates(rows)
    same(minmax.near_duplicates(docs(spark, rows)), want)
    assert [c for _, _, c, _ in want][:2] == [1, 1]


@pytest.mark.parametrize("chunk", [1 << 20, 40])
def test_components_of_thinned_edges(spark, monkeypatch, chunk):
    from statloom.llm import components as c

    monkeypatch.setattr(c, "CHUNK", chunk)
    r = random.Random(5)
    rows = [(r.randrange(900) * 7919 % 2003 - 1000, r.randrange(900) * 7919 % 2003 - 1000) for _ in range(500)] + [(5000 + k, 5001 + k) for k in range(60)] + [(9000, 9000 + k) for k in range(1, 80)] * 2 + [(1, 1), (9999, 9999), (None, 4), (4, None)]
    root = {x: x for e in rows for x in e if x is not None}
    for _ in range(len(root)):
        before = dict(root)
        for a, b in rows:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    edges = spark.createDataFrame(rows, "a long, b long").repartition(6)
    assert {x["id"]: x["root"] for x in c.components(edges).collect()} == {k: v for k, v in root.items() if k != v}
    assert c.components(edges.where("a = b")).isEmpty()


def test_dense_groups_are_thinned_where_they_lie(spark):
    from statloom.llm.components import forest, thinned

    n = 120
    edges = spark.range(n).selectExpr("id AS a").crossJoin(spark.range(n).selectExpr("id AS b")).where("a > b").repartition(3)
    kept = thinned(edges)
    assert kept.count() <= 3 * (n - 1) < edges.count() / 10 and kept.where("a <= b").isEmpty()
    a, b = forest(np.array([3, 5, 9]), np.array([9, 3, 7]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(5, 3), (7, 3), (9, 3)]


def test_near_duplicates_of_no_rows(spark):
    assert minmax.near_duplicates(docs(spark, [])).count() == 0
    same(minmax.near_duplicates(docs(spark, [(1, None), (2, "")])), [(1, 0, 1, True), (2, 0, 2, True)])
    with pytest.raises(ValueError):
        minmax.near_duplicates(docs(spark, []), perms=8)


def test_minimum_and_maximum_estimate_the_similarity():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 2**63, 4000).astype(np.uint64)) for _ in range(2)]
    both = [np.sort(np.concatenate([sets[0], x])) for x in (sets[1][:1000], sets[1][3000:])]  # 4000 of 6000 shared
    sig = minmax.signatures(both, minmax.permutations(400))
    assert abs((sig[0] == sig[1]).mean() - 4000 / 6000) < 0.05
    h = (both[0].astype(np.uint32) * minmax.permutations(3)[0][2] + minmax.permutations(3)[1][2]).astype(np.uint32)
    assert (sig[0, 4], sig[0, 5]) == (h.min(), h.max())


# ---- resampling


def test_prefix_crcs_equal_zlib():
    texts = ["Hello the World wide", "", None, "Ünï x y z 123-foo", prose(4, 30_000), "a", "y" * 300_000 + " b"]
    data, borders = buffers(pa.array(texts))
    for n, (got, owner) in enumerate(resample.crcs(data, borders, 3), 1):
        want = []
        for i, t in enumerate(texts):
            w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
            want += [(zlib.crc32(b" ".join(w[j : j + n])), i) for j in range(len(w) - n + 1)]
        assert list(zip(got.tolist(), owner.tolist(), strict=True)) == want


def brute_resample(rows, target, most):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    source, aim = [features(t) for _, t in rows], [features(t) for t in target]
    s, t = np.bincount([b for _, f in source for b in f], minlength=10_000), np.bincount([b for _, f in aim for b in f], minlength=10_000)
    gain = [math.floor(1000 * math.log(float((y + 1) * (s.sum() + 10_000)) / float((x + 1) * (t.sum() + 10_000)))) for x, y in zip(s.tolist(), t.tolist(), strict=True)]
    out = []
    for (d, _), (n, f) in zip(rows, source, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = None if d is None else int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((x for x in out if x[5] >= 20 and x[0] is not None), key=lambda x: (-x[3], x[0]))
    for i, x in enumerate(fit[: 10 * len(fit) // 100], 1):
        x[4] = i
    return [tuple(x[:5]) for x in out]


@pytest.mark.parametrize("most", [1, 3])
def test_resampling_equals_brute_force(spark, most):
    rows = ODD + [(100 + i, prose(i, 10 + i, 400 + 10 * (i % 7))) for i in range(120)] + [(130, prose(30, 40, 430))] * 2
    target = [prose(900 + i, 60, 80) for i in range(9)] + [None, ""]
    aim = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, bucket int")
    out = resample.resample(docs(spark, rows), aim, most=most)
    got = sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert got == sorted(brute_resample(rows, target, most), key=repr)
    ids = {r[0] for r in got if r[4] is not None}
    kept = resample.drawn(docs(spark, rows), aim, most=most)
    assert {r["doc_id"] for r in kept.collect()} == ids and kept.columns == docs(spark, []).columns


def test_resampling_of_empty_tables(spark):
    aim = spark.createDataFrame([], "text string")
    assert resample.resample(docs(spark, []), aim).count() == 0
    out = resample.resample(docs(spark, ODD), aim)
    assert out.count() == len(ODD) and out.where("rank IS NOT NULL").count() == 0


# ---- the queries against their SQL


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from statloom.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name in ORACLE_SQL:
        got, want = QUERIES[name](spark, DATA), con.execute(ORACLE_SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(names)
        a, b = ordered(got.columns, got.collect()), ordered(names, want.fetchall())
        assert len(a) == len(b) > 0 and all(close(p, q) for x, y in zip(a, b, strict=True) for p, q in zip(x, y, strict=True)), name


# ---- columns of any name


def test_stages_keep_columns_of_any_name(spark):
    from statloom.llm import decontaminate, pathjoin, quality, secrets

    text = prose(5, 60)
    kind = "doc_id long, text string, __row string, __quality string, __keep string, __found string, __ROW_ int, row string, fp string"
    rows = [(i, t, "mine", "q", "k", "f", 7, "r", "p") for i, t in enumerate([text, text, None, "", f'token = "{"a1b2c3d4e5" * 4}" ' + prose(6, 40)])]
    table = spark.createDataFrame(rows, kind)
    bench = spark.createDataFrame([(1, prose(9, 30))] * 3 + [(None, prose(9, 30).upper()), (2, None)], "item_id long, text string")
    for left, n in ((quality.keep_good(table, threshold=0.0), 5), (pathjoin.one_of_each(table), 4), (decontaminate.decontaminate(table, bench), 5), (secrets.redact(table), 5)):
        got = left.collect()
        assert left.columns == table.columns and len(got) == n
        assert {tuple(r)[2:] for r in got} == {("mine", "q", "k", "f", 7, "r", "p")}


def test_a_repeated_benchmark_item_is_one(spark):
    from statloom.llm import decontaminate

    bench = spark.createDataFrame([(i, prose(9, 30)) for i in range(3, 40)] + [(None, prose(9, 30).upper())], "item_id long, text string")
    out = decontaminate.overlaps(docs(spark, [(1, prose(1, 50) + " " + prose(9, 30))]), bench, block_chars=1).collect()
    assert [(r["doc_id"], r["item_id"], r["items"], r["matched_tokens"]) for r in out] == [(1, 3, 38, 30)]


# ---- language profiles and the language model's filter


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_languages_equal_brute_force(spark):
    import unicodedata
    from collections import Counter

    from statloom.llm import languageid

    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows += [(9001, "  ...Ünïcödé — two  words!", None), (9002, "12 34 !!", "en"), (9003, None, "de"), (9004, "a", None), (None, "no id here", "en")]
    table = spark.createDataFrame([(d, t, x, 1) for d, t, x in rows], "doc_id long, text string, lang string, rank int")

    def grams(text):
        signs = []
        for ch in (text or "").lower():
            if unicodedata.category(ch)[0] == "L":
                signs.append(ord(ch))
            elif not signs or signs[-1] != 1 or len(signs) == 0:
                signs.append(1)
        if not any(s != 1 for s in signs):
            return Counter()
        out = Counter()
        for i, s in enumerate(signs):
            before, after = signs[i - 1] if i else 1, signs[i + 1] if i + 1 < len(signs) else 1
            if s != 1:
                out[s] += 1
                out[before << 42 | s << 21 | after] += 1
            if s != 1 or before != 1:
                out[before << 21 | s] += 1
        return out

    top = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: languageid.PROFILE]]
    total = {}
    for d, t, lang in rows:
        if d is not None and d % 5 != 0 and lang is not None and t is not None:
            total.setdefault(lang, Counter()).update(grams(t))
    known = {lang: {g: i for i, g in enumerate(top(c))} for lang, c in total.items() if c}
    want = []
    for d, t, _ in rows:
        own = top(grams(t))
        far = {lang: sum(min(abs(p[g] - i), languageid.PROFILE) if g in p else languageid.PROFILE for i, g in enumerate(own)) for lang, p in known.items()}
        best = min(sorted(far), key=far.get)
        want.append((d, best, round(1 - far[best] / (languageid.PROFILE * len(own)), 9)) if own else (d, "und", 0.0))
    made = languageid.profiles(table, F.col("doc_id") % 5 != 0)
    got = [(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in languageid.identify(table, made).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_the_shipped_filter_errs_little(spark):
    from statloom.llm import lmscore

    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    held = F.col("doc_id") % 5 == 1
    exact = {r["doc_id"]: r for r in lmscore.score(table, held, bits=4000, spare=40).collect()}  # so many bits that errors don't count
    off = [(r["held_out"], (r["score"] - exact[r["doc_id"]]["score"]) / r["n_tokens"]) for r in lmscore.score(table, held).collect()]
    for held_out, mean, worst in ((True, 0.03, 0.3), (False, 0.01, 0.1)):
        own = [abs(x) for h, x in off if h == held_out]
        print(held_out, np.mean(own), max(own))
        assert np.mean(own) < mean and max(own) < worst


def test_the_template_decides_where_no_name_tells():
    from statloom.llm import htmltext

    page = lambda i: f"<html><body><div class=x1><p>Home News Contact and all about us</p></div><div class=x2><p>Story {i} {prose(i, 7)}</p><p>More {prose(50 + i, 4)}</p></div><div class=x3><p>Imprint and all rights of this house reserved</p></div></body></html>"
    pages = [page(i) for i in range(9)]
    want = [f"Story {i} {prose(i, 7)} More {prose(50 + i, 4)}" for i in range(9)]
    assert htmltext.extract(pages) == want
    alone = [" ".join(htmltext.main_blocks(htmltext.parse(p), set(), set())) for p in pages]
    assert all(a != w for a, w in zip(alone, want, strict=True))
