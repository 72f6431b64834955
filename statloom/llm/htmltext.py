"""Main text of web pages, by deducing the template of each host's pages.

Pages of one host are compared in groups of bounded size (a large host's pages are dealt
to several groups, and every page takes part in one). Within a group, tokens are words
and tags, each with the path of open elements it stands under. Tokens with one vector of
occurrences over the pages form an equivalence class; classes that are frequent and large
and keep one order on every page are valid, and they nest: a class that occurs several
times a page must lie inside one slot of the class above. The valid classes are the
template. The words of a block that most pages repeat whole are told from the same words
elsewhere by their place in it. What is left between the template's tokens are the slots,
on every page, and a page's main text is the text of all slots inside its article: the
`article` or `main` element where there is one, else the smallest element that holds most
of the page's slot text. An article that its host's pages share whole is template, and its
text is empty.

Elements that say themselves that they are menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles or reader comments (by tag, role, or a whole word of class
or id) hold no main text even where their words change from page to page. An `article` or
`main` inside an element with such a class or id isn't part of it, unless that is the name
of reader comments, which are often articles themselves.

White space inside a block becomes one space; blocks are joined in page order by one
space; character references are decoded. A null or empty html gives an empty text; a null
or odd URL belongs to the host "". A host with few different pages has no word template.
Repeated rows give repeated results. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stage

GROUP = 200
#: Pages with different slot text that a word must occur on before it can be template, and tokens of a class.
SUPPORT, LARGE = 5, 3
#: Bytes of html in a group, unless one page has more; tasks that a large host's pages are dealt to while they get a group.
GROUP_BYTES, SALTS = 16 << 20, 32

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|textarea|title|iframe|select)\b[^>]*?(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line of text; every other tag begins or ends a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_BOILER_TAGS = frozenset("nav footer aside form button dialog menu head input fieldset datalist".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Names, as class or id, of parts beside the article; those of reader comments; and what may stand with either in one word.
_NAMES = "nav|navbar|navigation|menus?|topbar|toolbar|masthead|sitehead|header|footer|sidebar|side|aside|rail|widgets?|ads?|adverts?|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|share|sharing|social|related|recommended|recommendations|breadcrumbs?|pagination|pager|newsletter|subscribe|subscription|signup|login|search|form|copyright|legal|skip|toc|tags"
_COMMENTS = "comments?|commentlist|disqus|discussion|replies|respond|reactions"
_LAYOUT = "site|page|main|global|top|bottom|left|right|box|bar|list|links?|buttons?|icons?|wrap|wrapper|container|block|area|section|unit|slot|inner|outer|primary|secondary|to|content|posts?|articles?|[0-9]+"
_BOILER_NAMES = re.compile(rf"(?:(?:{_LAYOUT})[_-]+)*(?P<name>{_NAMES}|{_COMMENTS})(?:[_-]+(?:{_LAYOUT}|{_NAMES}|{_COMMENTS}))*", re.IGNORECASE)
_COMMENT_NAMES = re.compile(_COMMENTS, re.IGNORECASE)
_NEVER_BY_NAME = frozenset("html body main article p h1 h2 h3 h4 h5 h6 em strong b i".split())
#: A new one of these ends an open one.
_SELF_ENDING = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


@dataclass
class Block:
    """Text between two block borders, and the elements it stands in."""

    path: tuple[str, ...]
    text: str
    boiler: bool
    article: bool


class _Open:
    __slots__ = ("article", "boiler", "by_name", "name", "tag")

    def __init__(self, tag: str, name: str, boiler: bool, article: bool, by_name: bool = False) -> None:
        """by_name: a class or id that an article inside doesn't inherit is all that makes it boiler."""
        self.tag, self.name, self.boiler, self.article, self.by_name = tag, name, boiler, article, by_name


def _element(tag: str, raw: str, parent: _Open) -> _Open:
    attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)} if raw.strip() else {}
    role = attrs.get("role", "").lower()
    begins = tag in ("article", "main") or role in ("main", "article")
    article = parent.article or begins
    own = " ".join((attrs.get("class", ""), attrs.get("id", "")))
    inherited = parent.boiler and not (begins and parent.by_name)
    marked = tag in _BOILER_TAGS or role in _BOILER_ROLES or (tag == "header" and not article)
    marked = marked or "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    boiler, by_name = inherited or marked, inherited and parent.by_name and not marked
    if own.strip() and tag not in _NEVER_BY_NAME and role not in ("main", "article") and (by_name or not boiler):
        named = [m["name"].lower() for m in map(_BOILER_NAMES.fullmatch, own.split()) if m]
        named = [x for x in named if not (article and x in ("header", "tags", "side", "toc", "legal"))]
        if named:
            boiler, by_name = True, not any(_COMMENT_NAMES.fullmatch(x) for x in named)
    name = tag + "".join(f".{x}" for x in sorted(attrs.get("class", "").split()))
    return _Open(tag, name, boiler, article, by_name)


def parse(page: str) -> list[Block]:
    """The blocks of a page in order; tags need not be closed or nested well."""
    top = _Open("", "", False, False)
    stack, out, text = [top], [], []

    def flush() -> None:
        joined = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if joined:
            last = stack[-1]
            blocks = tuple(x.name for x in stack[1:] if x.tag not in _INLINE)
            out.append(Block(blocks, joined, last.boiler, last.article))

    def pop(at: int) -> None:
        if any(x.tag not in _INLINE or x.boiler != stack[at - 1].boiler for x in stack[at:]):
            flush()
        del stack[at:]

    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            text.append(m["text"])
            continue
        if m["tag"] is None:
            if m["raw"]:
                text.append(" ")
            continue
        tag = m["tag"].lower()
        if m["close"]:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if at:
                pop(at)
            elif tag not in _INLINE:
                flush()
        elif tag in _VOID:
            if tag == "br":
                text.append(" ")
            elif tag not in _INLINE:
                flush()
        else:
            ends = _SELF_ENDING.get(tag, ()) or (("p",) if tag in _ENDS_P else ())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    pop(i)
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "div", "section", "article", "body") and tag not in ("p",):
                    break
            made = _element(tag, m["attrs"] or "", stack[-1])
            if tag not in _INLINE or made.boiler != stack[-1].boiler:
                flush()
            if not (m["attrs"] or "").rstrip().endswith("/"):
                stack.append(made)
    flush()
    return out


def _tokens(b: Block, repeated: set) -> list[tuple[tuple[str, ...], str]]:
    """A block's tokens; the first, with an empty word, is its own border, a tag token."""
    if (b.path, b.text) in repeated:
        role = (*b.path, "=" + b.text)
        return [(role, ""), *((role, f"{k} {word}") for k, word in enumerate(b.text.split()))]
    return [(b.path, ""), *((b.path, word) for word in b.text.split())]


def repeated_blocks(pages: list[list[Block]], support: int = SUPPORT) -> set[tuple[tuple[str, ...], str]]:
    """The (path, text) of blocks that at least `support` and half of the pages have."""
    seen = Counter(x for blocks in pages for x in {(b.path, b.text) for b in blocks})
    return {x for x, n in seen.items() if n >= max(support, (len(pages) + 1) // 2)}


def template_words(pages: list[list[Block]], support: int = SUPPORT, large: int = LARGE, repeated: set | None = None) -> set[tuple[tuple[str, ...], str]]:
    """The (path, word) tokens of the valid equivalence classes of these pages."""
    if len(pages) < support:
        return set()
    where: dict[tuple[tuple[str, ...], str], dict[int, list[int]]] = defaultdict(dict)
    for p, blocks in enumerate(pages):
        at = 0
        for b in blocks:
            for token in _tokens(b, repeated or set()):
                where[token].setdefault(p, []).append(at)
                at += 1
    least = max(support, (len(pages) + 1) // 2)
    classes: dict[tuple, list[tuple[tuple[str, ...], str]]] = defaultdict(list)
    for token, seen in where.items():
        if len(seen) >= least:
            classes[tuple((p, len(x)) for p, x in seen.items())].append(token)
    valid: list[tuple[tuple, list[tuple[tuple[str, ...], str]]]] = []
    for vector, tokens in classes.items():
        ordered = _ordered(tokens, vector, where)
        if len(ordered) >= large:
            valid.append((vector, ordered))
    # widest support first: a class nests in a slot of those before it, or it is none of the template
    valid.sort(key=lambda x: (-len(x[0]), sum(n for _, n in x[0])))
    kept: list[list[tuple[tuple[str, ...], str]]] = []
    for vector, tokens in valid:
        if all(_nested(tokens, above, vector, where) for above in kept):
            kept.append(tokens)
    return {t for tokens in kept for t in tokens if t[1]}


def _ordered(tokens: list, vector: tuple, where: dict) -> list:
    """Those tokens of a class that follow each other in one order, round after round, on every page."""
    first = vector[0][0]
    tokens = sorted(tokens, key=lambda t: where[t][first][0])
    for p, n in vector:
        spots = sorted((where[t][p][k], i) for i, t in enumerate(tokens) for k in range(n))
        order = [i for _, i in spots]
        if order != list(range(len(tokens))) * n:
            # drop the tokens that stand elsewhere in the first round, and see whether the rest agree
            rank = {i: r for r, i in enumerate(dict.fromkeys(order))}
            tokens = _rising(tokens, [rank[i] for i in range(len(tokens))])
            spots = sorted((where[t][p][k], i) for i, t in enumerate(tokens) for k in range(n))
            if [i for _, i in spots] != list(range(len(tokens))) * n:
                return []
    return tokens


def _rising(items: list, rank: list[int]) -> list:
    """A longest subsequence of items whose ranks rise."""
    best: list[int] = []
    back: list[int] = [-1] * len(items)
    for i, r in enumerate(rank):
        lo, hi = 0, len(best)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if rank[best[mid]] < r else (lo, mid)
        back[i] = best[lo - 1] if lo else -1
        best[lo : lo + 1] = [i]
    out, i = [], best[-1] if best else -1
    while i >= 0:
        out.append(items[i])
        i = back[i]
    return out[::-1]


def _nested(tokens: list, above: list, vector: tuple, where: dict) -> bool:
    """Whether each occurrence of the class lies inside one slot of the class above, on every page that has both."""
    for p, n in vector:
        if p not in where[above[0]]:
            continue
        edges = sorted(x for t in above for x in where[t].get(p, ()))
        for k in range(n):
            lo, hi = where[tokens[0]][p][k], where[tokens[-1]][p][k]
            if sum(lo < e < hi for e in edges) and not all(lo < e < hi for e in edges):
                return False
    return True


def main_blocks(blocks: list[Block], template: set, repeated: set | None = None) -> list[str]:
    """The texts of the slots inside the article."""
    slots = [b for b in blocks if not b.boiler and any(t not in template for t in _tokens(b, repeated or set())[1:])]
    if any(b.article and not b.boiler for b in blocks):
        return [b.text for b in slots if b.article]
    depth = 0
    while slots:
        weight: dict[tuple[str, ...], int] = defaultdict(int)
        for b in slots:
            if len(b.path) > depth + 1:  # an element with blocks of its own below
                weight[b.path[: depth + 1]] += len(b.text)
        best = max(weight, key=weight.get, default=None)
        if best is None or weight[best] < 0.8 * sum(len(b.text) for b in slots):
            break
        slots, depth = [b for b in slots if b.path[: depth + 1] == best], depth + 1
    return [b.text for b in slots]


def extract(pages: list[str]) -> list[str]:
    """Main texts of a group of pages of one host."""
    parsed = [parse(p) for p in pages]
    different = {tuple(b.text for b in x if not b.boiler): x for x in parsed}
    repeated = repeated_blocks(list(different.values()))
    template = template_words(list(different.values()), repeated=repeated)
    return [" ".join(main_blocks(x, template, repeated)) for x in parsed]


def _group(key: tuple, table: pa.Table) -> pa.Table:
    texts = extract(table.column("html").to_pylist())
    return pa.table([table.column("page_id"), table.column("url"), pa.chunked_array([pa.array(texts, pa.string())]), pa.chunked_array([pa.array([len(t) for t in texts], pa.int64())])], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, group: int = GROUP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""
    host = F.coalesce(F.regexp_extract(F.lower(F.col("url").cast("string")), r"^[a-z][a-z0-9+.-]*://([^/?#]+)", 1), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    parts = F.greatest(F.ceil(F.count("*") / group), F.ceil(F.sum(F.octet_length("html")) / group_bytes)).cast("int")
    # a name and a number a large host, written first: Spark broadcasts them where they are few, and else deals a host's pages by salt
    large = stage(own.groupBy("host").agg(parts.alias("parts")).where("parts > 1"), "hosts")
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(large, ["host", "salt"], "left")
    own = own.withColumn("part", F.pmod(F.xxhash64("page_id", "url", F.lit(1)), F.coalesce("parts", F.lit(1))))
    return own.select("page_id", "url", "html", "host", "part").groupBy("host", "part").applyInArrow(_group, "page_id long, url string, text string, n_chars long")
