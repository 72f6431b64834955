"""WARC archives, page text, exact top-k and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from statloom.llm import htmltext, topk, warc


def test_warc_round_trip(spark):
    big = "<p>" + "ü" * 200 + "</p>"
    rows = [(5, "http://a/1", big, 1), (3, "http://a/2", big, 1), (9, None, big, 1), (1, "u", None, 1), (2, "u", "", 1), (4, "x y", "short", 1), (6, "v", "short", 1), (7, "w", "y" * 3_000_000 + "\r\n\r\n", 1), (3, "http://a/2", big, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    index = warc.write_archives(pages)
    out = {r["page_id"]: r for r in warc.read_records(index).collect()}
    assert index.count() == len(rows) and len(out) == len({r[0] for r in rows})
    for page_id, _, html, _ in rows:
        raw = (html or "").encode()
        got = out[page_id]
        assert (got["payload_bytes"], got["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (got["record_type"], got["refers_to"]) == (("revisit", 3) if page_id in (5, 9) else ("response", None))
        assert got["record_type"] == "revisit" or bytes(got["payload"]) == raw
    odd = spark.createDataFrame([(None, "u", big), (None, "u", "z" * 500), (4, "u", big), (None, None, None)], "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_records(warc.write_archives(odd)).collect()), key=repr)
    assert got == sorted([(None, "revisit", 4, len(big.encode())), (None, "response", None, 500), (4, "response", None, len(big.encode())), (None, "response", None, 0)], key=repr)
    some = index.where("page_id = 7").first()
    path = some["file"].removeprefix("file://")
    with open(path, "rb") as f:
        f.seek(some["offset"])
        head, block = warc.parse_record(zlib.decompress(f.read(some["length"]), 31))
    assert head["warc-type"] == "response" and len(block) == 3_000_004
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<header><a href="/">Site name</a></header><nav><ul><li><a>Home</a></li><li>News {i}</li></ul></nav><div class="ad-box">Buy {w}</div>
<div id="{wrap}"><{tag}><h1>Title {i}</h1><p>First <b>bo</b>ld &amp; caf&eacute;&nbsp;{i}<br>line<p>Second {w}<ul><li>item {i}</li></ul></{close}></div>
<aside>Side {w}</aside><form><label>Mail</label></form><div class="comments"><p>Reader {i} says {w}</p></div><div role="alert">Note {i}</div><footer>&copy; Site</footer><!-- c --></body></html>"""


def page(i, tag="article", wrap="page"):
    return PAGE.format(i=i, w=f"word{i * 7}", tag=tag, close=tag.split()[0], wrap=wrap)


@pytest.mark.parametrize("tag", ["article", "main", "div class=story", "section"])
def test_main_text(spark, tag):
    rows = [(i, f"http://h{i % 2}.org/{i}", page(i, tag), "x") for i in range(24)]
    odd = [(100, None, None, "x"), (101, "::", "", "x"), (102, "http://h0.org/z", "just text &lt;3", "x"), (103, "http://one.net/", "<article><p>Only<p>page</article><p>out", "x"), (0, "http://h0.org/0", page(0, tag), "x")]
    table = spark.createDataFrame(rows + odd, "page_id long, url string, html string, host string")
    out = {r["page_id"]: r for r in htmltext.main_text(table, group=7).collect()}
    assert len(out) == len(rows) + 4
    for i, _, _, _ in rows:
        assert out[i]["text"] == f"Title {i} First bold & café {i} line Second word{i * 7} item {i}"
    assert out[0]["n_chars"] == len(out[0]["text"])
    assert (out[100]["text"], out[101]["text"], out[102]["text"], out[103]["text"]) == ("", "", "just text <3", "Only page")
    assert htmltext.main_text(table.limit(0)).count() == 0


def test_template_words_are_no_text():
    made = [f"<div><span>Posted by the editors today</span><div><p>Story {i} about thing{i} and more words {i * 3}</p><p>End {i}x</p></div></div>" for i in range(12)]
    assert htmltext.extract(made)[3] == "Story 3 about thing3 and more words 9 End 3x"


@pytest.mark.parametrize("tag", ["article", "main"])
def test_template_decides_inside_the_article(tag):
    line = "Sign up for the news and the offers"
    made = [f"<div class='sidebar-wrap'><{tag}><h1>Title {i}</h1><p>The story {i} and the end</p><p>{line}</p><div class='side-by-side'>Both {i}</div><ul><li>Read more</ul><div class=share-links>Send {i}</div></{tag}></div><div class=comments><article>Reader {i}</article></div>" for i in range(12)]
    assert htmltext.extract(made)[3] == "Title 3 The story 3 and the end Both 3"
    # few pages have no template
    assert htmltext.extract(made[:2])[1] == f"Title 1 The story 1 and the end {line} Both 1 Read more"


def brute_top(rows, k):
    """A query is an id with its vector: rows that repeat both ask once, and are a candidate each."""
    fine = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {(q, tuple(a)): (q, a) for q, a in fine}.values():
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in fine if c != q and len(a) == len(b))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


def test_top_k_is_exact(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=16).astype(np.float32)]) for i in range(700)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(300, rows[300][1]), (400, rows[9][1])]  # a repeated query row, and a second vector of an id
    rows += [(2000, None), (2100, []), (2200, [1.0, None]), (2300, [float("nan")] * 16), (2400, [float("inf")] * 16), (None, rows[0][1]), (2500, [1.0, 2.0]), (2501, [3.0, -1.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    vectors = topk.quantised(table)
    for nodes, block in ((4, 16 << 20), (3, 400)):
        found = topk.top_k(vectors.where("vec_id % 100 = 0"), vectors, nodes=nodes, block_bytes=block)
        assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in found.collect()) == brute_top(rows, 10)
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_top_k_with_large_components(spark):
    rows = [(100 * i, [float(np.float32(x)) for x in (1e5 + i, -1.2e6 + 13 * i, 7e5)]) for i in range(5)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted((x["query_id"], x["rank"], x["vec_id"]) for x in topk.top_k(vectors, vectors, k=3).collect())
    assert got == [x[:3] for x in brute_top(rows, 3)]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(2)
    prose = lambda s, n: " ".join(random.Random(s).choices([f"wo{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600)], k=n))
    text = lambda s: ". ".join(prose(s * 10 + k, 12).capitalize() for k in range(8)) + "."
    item = " ".join(f"bench{i}" for i in range(30))
    key = "".join(r.choices("0123456789abcdef", k=40))
    rows = [(i, text(i)) for i in range(100)]
    rows += [(200, text(7)), (201, text(8) + " extra"), (202, text(300) + " " + item), (203, text(301) + f' token = "{key}" ' + text(302) + " 1234567890123456 ")]
    rows += [(400 + i, x) for i in range(8) for x in (f"SPAM{i}!! " * 40, " | ".join(prose(i, 60).split()))]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    left = []
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, d)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{d}/{len(left)}")
        docs = spark.read.parquet(f"{d}/{len(left)}")
        left.append({x["doc_id"] for x in docs.select("doc_id").collect()})
    clean = set(range(100)) | {203}
    assert clean <= left[0] and not [x for x in left[0] if x >= 400]
    assert left[1] == left[0] - {200, 201}
    assert left[2] == left[1] - {202}
    assert left[3] == left[2]
    last = docs.where("doc_id = 203").first()
    assert key not in last["text"] and "[SECRET]" in last["text"] and last["n_chars"] == len(last["text"])
    packed = corpus_pipeline.run(spark, d)
    assert {x["doc_id"] for x in packed.select("doc_id").collect()} == left[3]
