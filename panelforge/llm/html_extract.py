"""Main text of web pages by consensus paths of their host.

1. A page's containers (article, main, section, div, body, table cells) are scored: characters of text outside links, less
   the characters of what looks like a menu, advert or other surrounding.  The page votes for the path of its best container.
2. Spark counts the votes by host and generalised path (tags with their classes, digits masked).  Paths with a twentieth of a
   host's votes (so twenty at most) stay, by falling votes.
3. Every page is read again: its text is that of its containers on the first of its host's paths that it has with text in it;
   a page with none of them, or without a host, takes its own best container.

Votes combine before they are shuffled, so a large host is no hot key.  The paths of the hosts are broadcast where their measured size is
small, else joined in salted blocks.

Text: scripts, styles, comments of the markup, menus, headers and footers of the page, sidebars, notices, adverts, forms and reader
comments go (by tag, role, or a word of class or id; a list of links only is a menu); character references are decoded; a block is what
stands between starts and ends of block tags, its white space (``br`` and cell borders too) becomes one space; blocks without text go.
A surrounding that holds an article or main tag is none.  A header inside an article, or whose parent holds paragraphs itself, is part of the text.

Defined results: null html, or none with text, gives an empty text; broken markup is read as far as it goes (open tags
end where their parent does, an open comment or script reaches to the end of the page); repeated pages are rows of their own;
a null url has no host; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._stage import staged, table

SHARE = 20  # a path stays with one vote in so many
SMALL = 16 << 20  # characters of host paths up to which they are broadcast
SALT = 16

# Tags of HTML by their part in a page, and words that name a page's surroundings.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
CELL = frozenset(["td", "th"])
HOLDER = frozenset(["article", "body", "div", "main", "section", "td"])
PROPER = frozenset(["article", "main"])
APART = frozenset("aside button dialog footer form head menu nav noscript object select template iframe svg canvas audio video map datalist".split())
RAW = frozenset("script style title textarea xmp noframes".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts alert advertisement advertisements advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr "
    "login masthead menu modal nav navbar navigation newsletter notice notices pager pagination paging popup promo promoted promotion recommended related respond replies search "
    "share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription toast toolbar topbar trending widget widgets".split()
)
HEADERS = frozenset("header siteheader globalheader mainheader topheader".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select", "datalist"}}

KNOWN = BLOCK | CELL | APART | RAW | {"a", "br"}
ONCE, LISTS, ONLY_P, NOT_P = frozenset(["html", "body"]), frozenset(["ul", "ol", "dl", "table", "div", "p"]), frozenset(["p"]), BLOCK - {"p"}

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+|[^>]*+))>|<[!?/][^>]*>?|<(?=[a-zA-Z])[^>]*\Z""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z]+|[A-Z](?:[a-z]+|[A-Z]*(?![a-z]))")
_DIGITS = re.compile(r"\d+")


class Node:
    """An element that bounds blocks; ``path`` is bounded, however deep the page."""

    __slots__ = ("tag", "up", "path", "apart", "head", "proper", "plain", "linked", "links", "parts", "depth", "texts")

    def __init__(self, tag: str, up: Node | None, step: str, apart: bool, head: bool = False):
        self.tag, self.up, self.apart, self.head = tag, up, apart, head
        path = f"{up.path}/{step}" if up else step
        self.path = path if len(path) <= 400 else "#" + hashlib.blake2b(path.encode(), digest_size=16).hexdigest()
        self.proper = tag in PROPER
        self.parts: list = []  # text pieces (None: a break) and elements in order
        self.plain = self.linked = self.links = 0  # characters outside and inside links (later: or apart), number of links
        self.depth = up.depth + 1 if up else 0
        self.texts = False  # has paragraphs as children


def _step(tag: str, attrs: dict[str, str]) -> str:
    names = sorted({_DIGITS.sub("#", c) for c in attrs.get("class", "").lower().split()})
    step = ".".join([tag, *names])
    return step if len(step) <= 120 else tag + "." + hashlib.blake2b(step.encode(), digest_size=8).hexdigest()


def _apart(tag: str, attrs: dict[str, str]) -> bool:
    """Does an element name itself as a page's surrounding?"""
    if tag in APART:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    if attrs.get("role", "").lower() in ROLES:
        return True
    for value in (attrs.get("class", ""), attrs.get("id", "")):
        for name in value.split():
            words = [w.lower() for w in _WORD.findall(name)]
            if words[:1] not in (["has"], ["with"], ["no"]) and any(w in WORDS for w in words):
                return True
    return False


def _head(tag: str, attrs: dict[str, str]) -> bool:
    """Is an element a header, of the page or of an article?"""
    if tag == "header" or not attrs:
        return tag == "header"
    return tag in ("div", "section") and any("".join(_WORD.findall(n)).lower() in HEADERS for n in (attrs.get("class", "") + " " + attrs.get("id", "")).split())


def parse(page: str) -> list[Node]:
    """The block elements of a page in page order, with their text; the first one is the page itself."""
    root = here = Node("", None, "", False)
    nodes, opened = [root], Counter()
    link, at, size = False, 0, len(page)

    def leave(to: Node) -> Node:
        at = here
        while at is not to:
            opened[at.tag] -= 1
            at = at.up
        return to

    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            _text(here, page[at : m.start()], link)
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag not in KNOWN:
            continue
        if m[1]:
            if tag == "a":
                link = False
            elif opened[tag]:
                up = here
                while up.tag != tag:
                    up = up.up
                here, link = leave(up.up), False
            elif tag == "p":
                here.parts.append(None)
        elif tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else size
        elif tag == "a":
            link = True
            here.links += 1
        elif tag == "br":
            here.parts.append(" ")
        elif tag == "hr":
            here.parts.append(None)
        elif not (tag in ONCE and opened[tag]):
            attrs = {k.lower(): references.unescape(a or b or c) for k, a, b, c in _ATTR.findall(m[3])} if "=" in m[3] else {}
            if tag in BLOCK and opened["p"]:
                here = leave(_ended(here, ONLY_P, NOT_P))
            if tag in CLOSES:
                here = leave(_ended(here, CLOSES[tag], FENCE[tag]))
            node = Node(tag, here, _step(tag, attrs), _apart(tag, attrs), _head(tag, attrs))
            here.parts.append(node)
            here.texts |= tag == "p"
            nodes.append(node)
            if not (m[3].endswith("/") and tag not in BLOCK):
                opened[tag] += 1
                here, link = node, False
    if at < size:
        _text(here, page[at:], link)
    return nodes


def _text(here: Node, raw: str, link: bool) -> None:
    if "&" in raw:
        raw = references.unescape(raw)
    here.parts.append(raw)
    many = len("".join(raw.split()))
    if link:
        here.linked += many
    else:
        here.plain += many


def _ended(here: Node, tags, fence) -> Node:
    """Where the page goes on once the innermost open element of ``tags`` ends; unchanged if one of ``fence`` is open inside it."""
    at = here
    while at.up is not None and at.tag not in tags:
        if at.tag in fence or at.tag in CELL:
            return here
        at = at.up
    return at.up or here


def _beside_text(n: Node) -> bool:
    """Does the parent hold paragraphs itself, so that the header is that of a text?"""
    return n.up.texts and n.up.tag not in ("", "html", "body")


def measure(nodes: list[Node]) -> None:
    """Settles what is apart, then sums ``plain`` and ``linked`` (in links or apart) over every element."""
    words = [(n.plain, n.linked) for n in nodes]
    for n in reversed(nodes):  # children come before their parents
        if n.apart and n.proper and n.tag not in ("head", "noscript", "template"):
            n.apart = False
        if n.tag in LISTS and n.links >= 3 and not n.plain and not n.proper:
            n.apart = True
        up = n.up
        if up is not None:
            up.proper |= n.proper
            if not n.apart:
                up.links, up.plain = up.links + n.links, up.plain + n.plain
    inside = {}
    for n in nodes:
        inside[id(n)] = n.tag in PROPER or (n.up is not None and inside[id(n.up)])
        n.apart = n.apart or (n.up is not None and n.up.apart) or (n.head and not n.proper and not inside[id(n)] and not _beside_text(n))
    for n, (plain, linked) in zip(nodes, words, strict=True):
        n.proper = inside[id(n)]
        n.plain, n.linked = (0, plain + linked) if n.apart else (plain, linked)
    for n in reversed(nodes[1:]):
        n.up.plain, n.up.linked = n.up.plain + n.plain, n.up.linked + n.linked


def holders(page: str) -> dict[str, list[Node]]:
    """Containers with text outside the surroundings by path; ``proper`` says whether one is an article or inside one."""
    nodes = parse(page)
    measure(nodes)
    out: dict[str, list[Node]] = {}
    for n in nodes:
        if n.tag in HOLDER and not n.apart and n.plain:
            out.setdefault(n.path, []).append(n)
    return out or ({"": nodes[:1]} if nodes[0].plain else {})


def best(found: dict[str, list[Node]]) -> str | None:
    """Path with the best score: inside article tags if they hold a quarter of the text; of equal ones an article, then the deepest."""
    whole = max((sum(n.plain for n in ns) for ns in found.values()), default=0)
    proper = [p for p, ns in found.items() if ns[0].proper]
    if proper and 4 * max(sum(n.plain for n in found[p]) for p in proper) < whole:
        proper = []
    score = lambda p: (sum(n.plain - n.linked for n in found[p]), found[p][0].tag in PROPER, found[p][0].depth, p)
    return max(proper or found, key=score, default=None)


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks of the containers in page order."""
    out: list[str] = []
    now: list[str] = []

    def close() -> None:
        line = " ".join("".join(now).split())
        if line:
            out.append(line)
        now.clear()

    for n in nodes:
        todo = [(n.tag, iter(n.parts))]
        while todo:
            for piece in todo[-1][1]:
                if type(piece) is str:
                    now.append(piece)
                elif piece is None:
                    close()
                else:
                    now.append(" ") if piece.tag in CELL else close()
                    if not piece.apart:
                        todo.append((piece.tag, iter(piece.parts)))
                        break
            else:
                now.append(" ") if todo.pop()[0] in CELL else close()
        close()
    return out


def extract(page: str, paths: list[str]) -> tuple[str, str | None]:
    """(text, path): by the first of ``paths`` that the page has, else by its own best container."""
    found = holders(page)
    path = next((p for p in paths if p in found), None)
    path = best(found) if path is None else path
    return ("\n".join(blocks(found[path])) if path is not None else ""), path


def host(url) -> F.Column:
    """Lower-case host of a web address without user and port; null where there is none."""
    h = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(h != "", h)


def _vote(batches):
    for b in batches:
        paths = [best(holders(p)) if p else None for p in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string())], ["host", "path"])


def host_paths(pages: DataFrame, share: int = SHARE) -> DataFrame:
    """pages(url, html) -> host, paths: a host's paths with at least one vote in ``share``, by falling votes."""
    votes = pages.select(host(F.col("url")).alias("host"), "html").where("host is not null").mapInArrow(_vote, "host string, path string")
    votes = votes.where("path is not null").groupBy("host", "path").agg(F.count("*").alias("votes"))
    votes = staged(votes)
    total = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    kept = votes.join(total, "host").where(F.col("votes") * share >= F.col("total"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path")))
    out = staged(kept.groupBy("host").agg(ranked.alias("r")).select("host", F.col("r.path").alias("paths")), done=(votes,))
    return out


def _read(batches):
    for b in batches:
        got = [extract(p or "", h or []) for p, h in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        text = pa.array([g[0] for g in got], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text, pa.array([len(g[0]) for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string())], ["page_id", "url", "text", "n_chars", "path"])


def main_text(pages: DataFrame, share: int = SHARE) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars, path."""
    paths = host_paths(pages, share)
    size = paths.agg(F.sum(F.length("host") + F.length(F.array_join("paths", "")) + 16)).first()[0] or 0
    p = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    if size <= SMALL:
        p = p.join(F.broadcast(paths), "host", "left")
    else:
        salted = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALT)).cast("int")).join(salted, ["host", "salt"], "left")
    return p.select("page_id", "url", "html", "paths").mapInArrow(_read, "page_id long, url string, text string, n_chars long, path string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
