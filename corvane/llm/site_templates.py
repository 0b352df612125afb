"""Main text of web pages, with site template removal.

Every block element's subtree in the whole body of a page, menus and footers included, is hashed by its tag and text,
lists of links outside the article by their tags alone, and Spark counts on how many pages of a host each hash occurs; pages with the same article count once. Subtrees that
recur across many pages of their host are deleted: outside the article from `min_share` of the pages on, inside it
from `article_share` on, so that what articles happen to share stays. What does not recur word for word, as a menu
that varies from page to page or a reader's comment, goes by its tag, role or class. A named article is only a hint: a
header outside its sections is the site's, and what is inline in its paragraphs goes or stays with them. What remains
is cut into blocks.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import join_hot, written

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
EVENT = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

#: Element names of HTML, fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title math canvas object xmp noembed".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr tbody figcaption".split()) | INLINE
FRAME = frozenset(("html", "body"))
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "option": {"select", "datalist"}}
#: What is no article text, by tag, role, and the words of class and id: fixed values.
DROP_TAGS = RAW | frozenset("head nav aside footer form button select input menu dialog option fieldset datalist audio video map".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form note".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner banners cookie cookies consent gdpr notice notices alert popup modal overlay"
    " nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead topbar toolbar"
    " comment comments disqus respond replies reply share sharing social related recommended newsletter subscribe signup login widget widgets pagination pager skip".split()
)
SIDE, OWN = frozenset(("header", "side")), frozenset(("article", "post", "entry", "title"))
#: Words that beside those leave a class's meaning as it is: fixed values.
BESIDE = frozenset("site page top bottom left right box boxes wrapper wrap container block bar list area section inner outer item items link links button buttons panel unit slot zone row group holder message msg policy thread form text icon icons main js desktop mobile".split())


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


#: Where an element of a page that names its article is: in none of its sections, in a section, in the article, in a
#: paragraph or heading of the article.
OUTSIDE, SECTION, ARTICLE, PARAGRAPH = range(4)


class Ends:
    """Where tags end: at the next > outside quotes. The quotes and > of a page are gone through once, from its end, so
    that tags without an end, or with odd quotes, cost no more than others."""

    def __init__(self, page: str):
        found = list(EVENT.finditer(page))
        self.at = [m.start() for m in found]
        plain, double, single = -1, -1, -1  # the end, seen from outside quotes and from inside each kind
        self.end = [-1] * (len(found) + 1)
        for i in range(len(found) - 1, -1, -1):
            c = found[i].group()
            if c == ">":
                plain = self.at[i]
            elif c == '"':
                plain, double = double, plain
            else:
                plain, single = single, plain
            self.end[i] = plain

    def after(self, start: int) -> int:
        """The end of the tag whose name ends at start, or -1."""
        return self.end[bisect_left(self.at, start)]


def tokens(page: str) -> Iterator[tuple[str, str | None, str | bool]]:
    """(text, None, False), (raw attributes, name, False) of a start tag, or ("", name, True) of an end tag. A < that
    begins no tag is text. The place to go on from may be sent back."""
    ends, at, n = Ends(page), 0, len(page)
    last, cdata = page.rfind(">"), True
    while at < n:
        lt = page.find("<", at)
        if lt != at:
            yield page[at : lt if lt >= 0 else n], None, False
            if lt < 0:
                return
        at = lt + 1
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if cdata and page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            cdata = end >= 0
            if cdata:
                yield page[lt + 9 : end], None, False
                at = end + 3
                continue
        m = NAME.match(page, lt) if lt < last else None
        end = ends.after(m.end()) if m else page.find(">", lt) if lt < last and page[lt + 1 : lt + 2] in ("!", "?") else -1
        if end < 0:
            yield "<", None, False
            continue
        at = end + 1
        if m:
            to = yield "" if m[1] else page[m.end() : end], m[2].lower(), bool(m[1])
            if to:
                end = re.compile(rf"</{re.escape(to)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
                yield "", None, False


def parse(page: str) -> Node:
    """A tolerant tree, in time linear in the page: missing end tags are supplied, stray ones passed over."""
    stack = [Node("#root", {})]
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a name

    def close(i: int) -> None:
        for x in stack[i:]:
            places[x.tag].pop()
        del stack[i:]

    def last(names) -> int:
        return max((places[x][-1] for x in names if places[x]), default=0)

    each = tokens(page)
    for raw, tag, ending in each:
        if tag is None:
            if raw:
                stack[-1].kids.append(raw)
            continue
        if ending:
            if places[tag]:
                close(places[tag][-1])
            continue
        attrs = {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(raw)} if raw.strip(" /\n\t\r") else {}
        if tag in CLOSES_P and places["p"]:
            close(places["p"][-1])
        if tag in CLOSES and last(CLOSES[tag]) > last(FENCES[tag]):
            close(last(CLOSES[tag]))
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in VOID or raw.endswith("/") and tag in RAW:
            continue
        if tag in RAW:
            each.send(tag)
            continue
        places[tag].append(len(stack))
        stack.append(node)
    return stack[0]


def _words(token: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())


def _tells(token: str, of: frozenset[str]) -> bool:
    """Whether a class or id says so by all its words: cookie-notice and adBox do, share-price does not."""
    words = _words(token)
    return any(w in of for w in words) and all(w in of or w in BESIDE for w in words)


def _side(names: str) -> bool:
    return any(_tells(x, SIDE) for x in names.split()) and not OWN & set(_words(names))


def dropped(node: Node, at: int = 0) -> bool:
    """Whether an element goes by its tag, role or class. Paragraphs of an article, and what is inline there, do not go by
    their class: what it names is what they tell of."""
    a = node.attrs
    if node.tag in FRAME:
        return False
    if node.tag in DROP_TAGS or a.get("role", "").lower() in DROP_ROLES:
        return True
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if at >= ARTICLE and node.tag in PLAIN:
        return False
    names = f"{a.get('class', '')} {a.get('id', '')}"
    return any(_tells(x, DROP_WORDS) for x in names.split()) or node.tag not in PLAIN and _side(names)


#: Share of an element's characters in links from which it is a list of links.
LINKS = 0.8


def subtree_hashes(root: Node) -> tuple[dict[int, int], dict[int, int]]:
    """By id(element), the hash of its subtree: tag, class and the texts and hashes of what is in it. For lists of links
    also a hash of tags and classes alone, repeated neighbours as one, since menus vary in their texts."""
    out: dict[int, int] = {}
    shape: dict[int, int] = {}
    chars: dict[int, tuple[int, int]] = {}  # all, and those in links
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, ready = todo.pop()
        if not ready:
            todo.append((node, True))
            todo += [(k, False) for k in node.kids if not isinstance(k, str)]
            continue
        name = [node.tag, node.attrs.get("class", "")]
        parts, forms, n, linked = [], [], 0, 0
        for k in node.kids:
            if isinstance(k, str):
                text = " ".join(k.split())
                n += len(text)
                parts.append(text)
            else:
                parts.append(str(out[id(k)]))
                if not forms or forms[-1] != shape[id(k)]:
                    forms.append(shape[id(k)])
                n, linked = n + chars[id(k)][0], linked + chars[id(k)][1]
        chars[id(node)] = n, n if node.tag == "a" else linked
        out[id(node)] = xxhash.xxh3_64_intdigest("\x00".join(x for x in name + parts if x)) - 2**63
        shape[id(node)] = xxhash.xxh3_64_intdigest("\x01".join(map(str, name + forms))) - 2**63
    return out, {k: shape[k] for k, (n, linked) in chars.items() if n and linked >= LINKS * n}


def _names_article(x: Node) -> bool:
    return x.tag in ("article", "main") or x.attrs.get("role") in ("article", "main") or "articlebody" in x.attrs.get("itemprop", "").lower()


def _named(root: Node) -> bool:
    """Whether a page names its article."""
    todo = [(root, OUTSIDE)]
    while todo:
        node, at = todo.pop()
        if dropped(node, at):
            continue
        if _names_article(node):
            return True
        todo += [(k, _within(at, node)) for k in node.kids if not isinstance(k, str)]
    return False


def _within(at: int, x: Node) -> int:
    """Where what is in x is."""
    if at >= ARTICLE:
        return PARAGRAPH if x.tag in PLAIN and x.tag not in INLINE else at
    return ARTICLE if _names_article(x) else SECTION if x.tag == "section" else at


#: Tells hashes of subtrees inside an article from those outside.
INSIDE = 0x5BD1E995


def _counted(x: Node, at: int, parent: Node) -> bool:
    """Whether a subtree may go by its count: what is inline goes or stays with its paragraph."""
    return bool(x.kids) and not (x.tag in INLINE and (at == PARAGRAPH or parent.tag in PLAIN)) and x.tag not in FRAME


def _key(x: Node, at: int, named: bool, hashes: tuple[dict[int, int], dict[int, int]]) -> int:
    """What a subtree is counted by: outside the article of a page that names one, lists of links by their shape."""
    text, links = hashes
    if at >= ARTICLE:
        return text[id(x)] ^ INSIDE
    return links[id(x)] if named and id(x) in links else text[id(x)]


def templates(page: str) -> tuple[int, set[int], set[int]]:
    """A digest of a page's article, or of all of it without one, and hashes of its subtrees outside and inside the
    article that a template could hold: those with text. What holds an article is none."""
    root = parse(page)
    hashes = subtree_hashes(root)
    holds: set[int] = set()  # ids of elements that hold or name an article
    named: list[int] = []
    path: list[tuple[Node, Node, int, bool, bool]] = [(root, root, OUTSIDE, False, False)]
    while path:
        x, parent, at, gone, done = path.pop()
        if done:
            if id(x) in holds:
                holds.add(id(parent))
            continue
        gone = gone or dropped(x, at)
        path.append((x, parent, at, gone, True))
        if _names_article(x) and not gone:
            named.append(hashes[0][id(x)])
            holds.add(id(x))
        path += [(k, x, _within(at, x), gone, False) for k in x.kids if not isinstance(k, str)]
    out: tuple[set[int], set[int]] = (set(), set())
    todo = [(k, OUTSIDE, root) for k in root.kids if not isinstance(k, str)]
    while todo:
        x, at, parent = todo.pop()
        if x.tag == "head":
            continue
        if id(x) not in holds and _counted(x, at, parent):
            out[at >= ARTICLE].add(_key(x, at, bool(named), hashes))
        inner = _within(at, x)
        todo += [(k, inner, x) for k in x.kids if not isinstance(k, str)]
    return xxhash.xxh3_64_intdigest(repr(named or hashes[0][id(root)])) - 2**63, *out


def main_text(page: str, recurring: frozenset[int] = frozenset()) -> str:
    """Blocks of the page's text, each with white space made single spaces, joined by an empty line."""
    root = parse(page)
    named = _named(root)
    hashes = subtree_hashes(root) if recurring else None
    blocks: list[str] = []
    now: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(now)).split())
        now.clear()
        if text:
            blocks.append(text)

    todo: list = [(k, OUTSIDE, root) for k in reversed(root.kids)]
    while todo:
        x, at, parent = todo.pop()
        if isinstance(x, str):
            now.append(x)
            continue
        if x is None:
            end()
            continue
        often = hashes is not None and _counted(x, at, parent) and _key(x, at, named, hashes) in recurring
        if often or dropped(x, at) or named and at == OUTSIDE and x.tag == "header":
            if x.tag not in INLINE and x.tag not in RAW:
                end()
            continue
        inner, kids = _within(at, x), x.kids
        if x.tag in INLINE:
            if x.tag == "br":
                now.append(" ")
        else:
            end()
            todo.append((None, at, x))
            if x.tag == "header":
                kids = [k for k in kids if not isinstance(k, str) and re.fullmatch("h[1-6]|hgroup|div", k.tag)]
        todo += [(k, inner, x) for k in reversed(kids)]
    end()
    return "\n\n".join(blocks)


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"


def extract(pages: DataFrame, min_pages: int = 5, min_share: float = 0.1, article_share: float = 0.5) -> DataFrame:
    """page_id, url, text of every row of pages.

    Null html is an empty page. A subtree recurs if at least min_pages pages of its host with different articles, and
    min_share of them (article_share inside an article), have it; pages whose url has no host, or is null, share an
    empty one. Rows that repeat a page_id, or have none, are returned one by one. Other columns are ignored.
    """
    p = pages.select("page_id", "url", "html", F.xxhash64("url", "html").alias("key"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [templates(h or "") for h in b.column(2).to_pylist()]
            sets = [pa.array([sorted(x[i]) for x in found], pa.list_(pa.int64())) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in found], pa.int64()), *sets], ["key", "host", "digest", "outside", "inside"])

    own = p.select("key", F.xxhash64(F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit("")))).alias("host"), "html")
    own = own.mapInArrow(hashed, "key long, host long, digest long, outside array<long>, inside array<long>")
    own = written(own.withColumn("uid", F.monotonically_increasing_id()), "subtrees")
    first = own.groupBy("host", "digest").agg(F.min("uid").alias("uid"))
    size = written(first.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    hashes = lambda df: df.select("key", "host", F.explode(F.array_union("outside", "inside")).alias("hash"))
    kinds = own.join(first.select("uid"), "uid", "left_semi")
    told = kinds.select("host", "digest", F.explode("outside").alias("hash"), F.lit(min_share).alias("share")).unionByName(kinds.select("host", "digest", F.explode("inside").alias("hash"), F.lit(article_share).alias("share")))
    often = told.groupBy("host", "hash", "share").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = written(join_hot(often, size, ["host"], n="pages").where(F.col("n") >= F.col("share") * F.col("pages")).select("host", "hash", "n"), "often")
    gone = join_hot(hashes(own), often, ["host", "hash"]).groupBy("key").agg(F.collect_set("hash").alias("gone"))
    joined = p.join(gone.hint("shuffle_hash"), "key", "left").select("page_id", "url", "html", "gone")

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [main_text(h or "", frozenset(g or ())) for h, g in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(text, f"page_id {dict(p.dtypes)['page_id']}, url string, text string")
