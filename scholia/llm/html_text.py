"""Main-text extraction from web pages by consensus of host paths.

Pass one parses every page and scores its containers by the text of their blocks
less link text. What stands in elements for navigation, or named like something
beside an article, counts less; such names weigh and do not decide. Every
container votes for its path, tags from the root down with their classes, digits
generalised, with the cube of its share of the page's best score; every region
reports a hash of its text. Spark adds both up by host, each different page
counted once however many copies it has:

* main paths, with their share of the host's votes;
* stock: texts that stand at the same path of most of the host's different pages
  (STOCK_SHARE of them, and STOCK_PAGES), and classed paths four in five of whose
  texts are such. What a few pages share, copies and quotations, is no stock.

Pass two parses the pages again. A page's article stands at the path with the
largest product of squared share and score on this page, so that a path that the host's
pages agree on beats a longer thread of comments, while a page of another kind
has its own. Stock is no article, unless nothing else on the page comes near it:
a page whose best container is stock and whose next one has less than KEEP of its
score keeps it whole. Text is every block of that container in page order:
character references decoded, white space turned into one space, blocks joined by
a line feed. What holds the chosen container is never left out, whatever its name.
Inside, these are: the host's stock; elements for navigation, footers, asides
without a quotation, forms, scripts and hidden parts; nested articles (readers'
comments by the markup's definition); boxes and adverts by name; and threads.

A name decides alone only if it says nothing else (sidebar, comments-area, ad-box).
A name with other words in it (ad-hoc, notice-of-death), and words that articles
use too (menu, commercial, discussion, related), need a second sign: mostly links,
a form, or a thread. A thread is neighbours of one kind that each have an author
and prose of their own, an author and a time, or a time and a way to reply; a
list of books or of times is none. Of the article's own header its headings and
paragraphs stay, bylines go.

Defined results: null or blank html gives an empty text; pages without a valid
url share one nameless host; hosts of fewer than three different pages have no
stock; repeated rows are pages of their own in the result; a page of any length
is read whole, elements nested deeper than DEPTH stand side by side; broken
markup is read as browsers do, unclosed elements ending where their parent does;
an empty table gives no rows; other columns, whatever their names, are not
looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.session import cut

#: Share of a host's votes that a main path needs.
SHARE = 0.02
#: Different pages that a stock text needs at least, as a number and as a share of the host's.
STOCK_PAGES, STOCK_SHARE = 3, 0.6
#: The share of a path's texts that makes the path stock.
PATH_SHARE = 0.8
#: Share of the best container's score that another one needs where the best is stock.
KEEP = 0.2
#: What a page's own best path counts for at least.
OWN = 0.05
#: Most rules (main paths and stock texts) of all hosts that are sent to every task; beyond it, a shuffle join by path.
BROADCAST_PATHS = 200_000
#: Elements nested deeper than this stand side by side, as in browsers.
DEPTH = 200

# Element names of the markup language and words of class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes noembed iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSE_P = BLOCKS - frozenset("html head body tbody td tfoot th thead tr caption".split())
CONTAINERS = frozenset("article body div main section td blockquote center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is never read.
UNREAD = frozenset("script style noscript template iframe button select textarea input svg canvas object embed audio video head title".split())
#: Elements beside an article, and roles that say the same.
BESIDE = frozenset("nav footer aside form menu dialog".split())
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert".split())
#: Elements that are judged by their names, and votes' regions.
BOXES = frozenset("div section article ul ol dl table aside header footer form nav main figure td".split())
# Names of adverts, of what stands beside an article, and those that articles use too.
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted commercial".split())
BESIDE_WORDS = frozenset(
    "nav navigation navbar menu menubar breadcrumb breadcrumbs footer sidebar widget share sharing subscribe newsletter signup login cookie cookies"
    " consent gdpr notice notices popup modal masthead comment comments disqus pagination pager toolbar".split()
)
DOUBTFUL_WORDS = frozenset(
    "aside related recommended social announcement disclaimer alert overlay banner reply replies respond responses discussion feedback user users"
    " visitor visitors reader readers guest posts opinions thread forum".split()
)
#: Of the first two, those that need a second sign even by themselves.
AMBIGUOUS_WORDS = frozenset("menu consent commercial promotion promoted".split())
#: Words that say nothing of what an element holds, so that a name of these and one of the above says no more than that.
PLAIN_WORDS = frozenset(
    "box boxes wrapper wrap container block blocks list lists item items area section region inner outer left right top bottom center middle bar row col column columns panel slot unit zone"
    " module group header head title body main site page post posts entry article content story global primary secondary button buttons link links icon icons form msg message text small"
    " large big mini my the is u c l m s xs sm md lg xl widget user users reader readers visitor visitors banner social feed view node block field id js".split()
)
#: In a name with one of these, the rest says what a page has or lacks, not what the element is.
STATE_WORDS = frozenset("no not without with has have is open closed enabled disabled".split())
# What items of threads have: an author, a time, a way to answer.
AUTHOR_WORDS = frozenset("author user username avatar byline".split())
TIME_WORDS = frozenset("date time timestamp posted".split())
TALK_WORDS = frozenset("reply permalink likes votes".split())
BYLINE_WORDS = AUTHOR_WORDS | TIME_WORDS | TALK_WORDS | {"meta"}
HEADER_WORDS = frozenset(["header"])
GOOD_WORDS = frozenset("article content entry post story text main body".split())
#: An element that opens closes these open ones, up to the listed bounds.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")


class Node:
    """An element; measure() fills in text and link characters below it and the hash of its text."""

    __slots__ = ("tag", "attributes", "parent", "children", "depth", "size", "links", "mark", "path")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.size = self.links = 0
        self.mark, self.path = b"", ""

    def within(self) -> Iterator[Node]:
        """Every element below, in page order, but for what is not read."""
        stack = [self]
        while stack:
            here = stack.pop()
            if here is not self:
                yield here
            stack += [c for c in reversed(here.children) if isinstance(c, Node) and c.tag not in UNREAD]

    def has(self, tags: frozenset[str]) -> bool:
        return any(isinstance(c, Node) and (c.tag in tags or c.has(tags)) for c in self.children)


def parse(html: str) -> Node:
    """The element tree of a page."""
    root = at = Node("#root", {}, None)
    place, size, last = 0, len(html), html.rfind(">")
    while place < size:
        found = _TOKEN.search(html, place) if place <= last else None
        if found is None:
            at.children.append(html[place:])
            break
        if found.start() > place:
            at.children.append(html[place : found.start()])
        place = found.end()
        closing, name, rest = found[1], found[2], found[3]
        if name is None:
            closing, name, rest = found[4], found[5], found[6]
            if name is None:
                continue
        name = name.lower()
        if closing:
            up = at
            while up.parent is not None and up.tag != name:
                up = up.parent
            if up.parent is not None:
                at = up.parent
            continue
        if name in CLOSE_P:
            at = _close(at, _P, _P_BOUNDS)
        if name in CLOSES:
            at = _close(at, *CLOSES[name])
        attributes = {m[0].lower(): entities.unescape(m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(rest)} if rest else {}
        node = Node(name, attributes, at)
        at.children.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, place)
            place = end.end() if end else size
        elif name not in VOID and node.depth < DEPTH:
            at = node
    return root


_P, _P_BOUNDS = frozenset(["p"]), frozenset("td th caption button object table article section div blockquote li".split())


def _close(at: Node, tags: frozenset[str], bounds: frozenset[str]) -> Node:
    up = at
    while up.parent is not None and up.tag not in bounds:
        if up.tag in tags:
            return up.parent
        up = up.parent
    return at


def words_in(node: Node) -> set[str]:
    """Words of an element's classes and id, but for names of states."""
    found: set[str] = set()
    for name in f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}".split():
        words = {w.lower() for w in _WORD.findall(name)}
        if STATE_WORDS.isdisjoint(words):
            found |= words
    return found


def step_of(node: Node) -> str:
    if "class" not in node.attributes:
        return node.tag
    classes = sorted({_DIGITS.sub("#", c) for c in node.attributes["class"].split()})
    return ".".join([node.tag, *classes])


def measure(root: Node) -> None:
    """Sizes, links, marks and paths of all elements, from the leaves up."""
    order = [root]
    for node in root.within():
        node.path = f"{node.parent.path}>{step_of(node)}" if node.parent.parent else step_of(node)
        order.append(node)
    for node in reversed(order):
        parts = []
        for child in node.children:
            if isinstance(child, Node):
                if child.tag not in UNREAD:
                    node.size += child.size
                    node.links += child.size if child.tag == "a" else child.links
                    parts.append(child.mark)
            elif text := " ".join(child.split()):
                node.size += len(text)
                parts.append(text.encode())
        if node.size:
            node.mark = xxhash.xxh3_64_digest(b" ".join(parts))


def is_hidden(node: Node) -> bool:
    attributes = node.attributes
    return bool(attributes) and ("hidden" in attributes or attributes.get("aria-hidden") == "true" or ("style" in attributes and re.search(r"display\s*:\s*none", attributes["style"]) is not None))


def is_thread(node: Node, doubtful: bool = False) -> bool:
    """Whether an element, or the one list in it, has neighbours of one kind that are what someone said.

    Each has an author and prose, or an author or a way to answer and a time. In
    an element of a doubtful name each has any of these, or begins with a name.
    """
    tops = [node, *[c for c in node.children if isinstance(c, Node) and c.tag in BOXES]]
    for top in tops:
        kinds: dict[str, int] = {}
        for child in top.children:
            if isinstance(child, Node) and child.tag in _ITEMS and _is_said(child, doubtful):
                step = step_of(child)
                kinds[step] = kinds.get(step, 0) + 1
        if any(n > 1 for n in kinds.values()):
            return True
    return False


def _is_said(item: Node, doubtful: bool) -> bool:
    author = time = talk = named = prose = False
    for n in item.within():
        words = words_in(n) if n.attributes else set()
        author = author or not AUTHOR_WORDS.isdisjoint(words)
        time = time or n.tag == "time" or not TIME_WORDS.isdisjoint(words)
        talk = talk or not TALK_WORDS.isdisjoint(words)
        named = named or n.tag == "cite"
        prose = prose or n.tag == "p" or (n.tag == "div" and n.size > n.links)
    if (author and prose) or (time and (author or talk or named)):
        return True
    first = next((c for c in item.children if isinstance(c, Node) or c.strip()), None)
    return doubtful and (author or time or talk or named or (isinstance(first, Node) and first.tag in _NAMES and 0 < first.size <= 40 and first.size < item.size))


_ITEMS = frozenset("div li article section dd tr p".split())
_NAMES = frozenset("b strong cite a h4 h5 h6".split())
_QUOTES = frozenset("blockquote q".split())


def names_of(node: Node) -> tuple[bool, bool]:
    """Whether a class or id names an advert or something beside an article: and nothing else, or among other words."""
    alone = among = False
    for name in f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}".split():
        words = {w.lower() for w in _WORD.findall(name)}
        told = words & (ADVERT_WORDS | BESIDE_WORDS)
        if told and STATE_WORDS.isdisjoint(words):
            sure = told - AMBIGUOUS_WORDS and not words - told - PLAIN_WORDS - DOUBTFUL_WORDS
            alone, among = alone or bool(sure), True
    return alone, among


def has_sign(node: Node) -> bool:
    """What speaks for a name that may mean something else: mostly links, or a form."""
    return 2 * node.links > node.size or any(n.tag == "form" for n in node.within())


def is_beside(node: Node) -> bool:
    """Whether an element inside an article is no part of it, from what it is and holds."""
    if is_hidden(node) or node.attributes.get("role", "").lower() in BESIDE_ROLES:
        return True
    alone, among = names_of(node) if node.attributes else (False, False)
    if node.tag in BESIDE:
        # A quotation pulled out of the text is no sidebar.
        quoted = node.tag == "aside" and not among and (node.has(_QUOTES) or not {"quote", "pullquote"}.isdisjoint(words_in(node)))
        return not quoted
    if node.tag == "article":
        up = node.parent
        while up is not None and up.tag != "article":
            up = up.parent
        if up is not None:
            return True
    if alone and (node.tag in BOXES or not ADVERT_WORDS.isdisjoint(words_in(node))):
        return True
    if node.tag not in BOXES:
        return among and has_sign(node)
    doubts = len(words_in(node) & DOUBTFUL_WORDS) if node.attributes else 0
    if doubts > 1:
        return True
    doubtful = among or doubts == 1
    return (doubtful and has_sign(node)) or (node.tag != "table" and is_thread(node, doubtful))


def is_header(node: Node) -> bool:
    return node.tag == "header" or (node.tag in BOXES and bool(node.attributes) and not HEADER_WORDS.isdisjoint(words_in(node)))


class Blocks:
    """Text blocks below a container, in page order; `chosen` and what holds it stay whatever they are."""

    def __init__(self, top: Node, chosen: Node, stock: dict[str, set[int]] | None = None):
        self.blocks: list[str] = []
        self.stock = stock or {}
        self.safe: set[int] = set()
        up: Node | None = chosen
        while up is not None:
            self.safe.add(id(up))
            up = up.parent
        self._text: list[str] = []
        self._walk(top, False)
        self._flush()

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append(text)
            self._text = []

    def _dropped(self, node: Node) -> bool:
        if node.tag in UNREAD:
            return True
        if id(node) in self.safe:
            return False
        return is_stock(node, self.stock) or is_beside(node)

    def _walk(self, node: Node, header: bool) -> None:
        for child in node.children:
            if isinstance(child, str):
                if not header:
                    self._text.append(entities.unescape(child) if "&" in child else child)
            elif child.tag == "br":
                self._text.append(" ")
            elif not self._dropped(child):
                spoken = child.tag in _SPOKEN and not (child.tag == "p" and child.attributes and not BYLINE_WORDS.isdisjoint(words_in(child)))
                inside = (header and not spoken) or (id(child) not in self.safe and is_header(child))
                if child.tag in BLOCKS:
                    self._flush()
                    self._walk(child, inside)
                    self._flush()
                else:
                    self._walk(child, inside)

    def text(self) -> str:
        return "\n".join(self.blocks)


#: Stands for every text of a path.
ANY = 0
_SPOKEN = HEADINGS | {"p"}


def signed(mark: bytes) -> int:
    return int.from_bytes(mark, "big", signed=True)


def _weight(node: Node) -> float:
    """What the text below an element counts for, beside that of its neighbours."""
    weight = 1.0
    if node.tag in BESIDE or is_hidden(node) or node.attributes.get("role", "").lower() in BESIDE_ROLES:
        weight = 0.5 if node.tag == "form" else 0.1
    if node.attributes and node.tag in BOXES:
        words = words_in(node)
        if not (ADVERT_WORDS | BESIDE_WORDS).isdisjoint(words):
            weight *= 0.2
        elif not DOUBTFUL_WORDS.isdisjoint(words):
            weight *= 0.6
    return weight * (0.5 if node.tag == "header" else 1.0)


def is_stock(node: Node, stock: dict[str, set[int]]) -> bool:
    known = stock.get(node.path)
    return known is not None and (ANY in known or signed(node.mark) in known)


def scores(root: Node, stock: dict[str, set[int]] | None = None) -> list[tuple[float, Node]]:
    """Scored containers of a measured page, best first; stock counts for nothing."""
    found: dict[int, list] = {}

    def add(owner: Node, size: int, links: int, weight: float) -> None:
        worth, share, node = weight * max(0, size - 2 * links), 1.0, owner
        while node is not None and share > 0.2 and worth > 0:
            if node.tag in CONTAINERS or node.parent is None:
                found.setdefault(id(node), [node, 0.0])[1] += share * worth
                share /= 2
            node = node.parent

    stack = [(root, 1.0, False)]
    while stack:
        node, weight, inside = stack.pop()
        size = links = 0
        for child in node.children:
            if isinstance(child, str):
                size += len(" ".join(child.split()))
            elif child.tag in UNREAD or (stock and is_stock(child, stock)):
                continue
            elif child.tag in BLOCKS:
                # An article in an article is a reader's comment by the markup's definition.
                nested = inside and child.tag == "article"
                stack.append((child, weight * _weight(child) * (0.3 if nested else 1.0), inside or child.tag == "article"))
            else:
                size += child.size
                links += child.size if child.tag == "a" else child.links
                # Blocks inside an inline element are its own.
        if size:
            add(node, size, links, weight)

    def good(node: Node) -> float:
        return 1.5 if node.tag in ("article", "main") else 1.25 if not GOOD_WORDS.isdisjoint(words_in(node)) else 1.0

    return sorted(((score * good(node), node) for node, score in found.values()), key=lambda x: -x[0])


def widened(node: Node) -> Node:
    """The outermost article around a container, else the main element, else the wrapper that adds its heading and little else."""
    up, article, main = node, None, None
    while up is not None:
        article, main = (up, main) if up.tag == "article" else (article, main or up) if up.tag == "main" else (article, main)
        up = up.parent
    if article is not None or main is not None:
        return article if article is not None else main
    size = len(Blocks(node, node).text())
    while not node.has(_H1) and node.parent is not None and (node.parent.tag in CONTAINERS or node.parent.parent is None) and node.parent.has(_H1) and len(Blocks(node.parent, node).text()) <= 1.5 * size:
        node = node.parent
    return node


_H1 = frozenset(["h1"])


def read(html: str | None) -> Node | None:
    """A measured page; None if it has no text."""
    if not html or not html.strip():
        return None
    root = parse(html)
    measure(root)
    return root if root.size else None


def votes(html: str | None) -> list[tuple[str, int, float]]:
    """(path, hash of the text, score from 0 to 1) of a page's regions; the page itself has the empty path."""
    root = read(html)
    if root is None:
        return []
    ranked = scores(root)
    best = ranked[0][0] if ranked else 0.0
    shares = {id(node): (score / best) ** 3 for score, node in ranked} if best > 0 else {}
    regions = [n for n in root.within() if n.size and (n.tag in BOXES or n.tag in CONTAINERS or ("class" in n.attributes and n.tag in BLOCKS))]
    return [("", signed(root.mark), 0.0), *[(n.path, signed(n.mark), shares.get(id(n), 0.0)) for n in regions]]


def extract(html: str | None, main: dict[str, float] | None = None, stock: dict[str, set[int]] | None = None) -> str:
    """The main text of a page, with its host's main paths (shares) and stock (hashes of texts by path)."""
    root = read(html)
    if root is None:
        return ""
    main, stock = main or {}, stock or {}
    every = scores(root)
    if not every:
        return Blocks(root, root).text()
    ranked = scores(root, stock) if stock else every
    if not ranked or ranked[0][0] < KEEP * every[0][0]:
        # All that the page says, wherever else it is said.
        ranked, stock = every, {}
    own = ranked[0][1]
    chosen = max(ranked, key=lambda x: x[0] * max(main.get(x[1].path, 0.0), OWN if x[1] is own else 0.0) ** 2)[1]
    # Neighbours of the same classes that hold as much are parts of one article.
    worth = {id(node): score for score, node in ranked}
    while "class" in chosen.attributes and chosen.parent is not None and any(
        isinstance(c, Node) and c is not chosen and c.path == chosen.path and 2 * worth.get(id(c), 0.0) >= worth.get(id(chosen), 0.0) for c in chosen.parent.children
    ):
        chosen = chosen.parent
    return Blocks(widened(chosen), chosen, stock).text()


def host_rules(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, text, share: a main path with its share, or a stock text at a path (its hash, 0 for every text); a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                few = batch.slice(low, 256)
                found = [votes(x.as_py()) for x in few.column("html")]
                at = pa.array([i for i, v in enumerate(found) for _ in v], pa.int32())
                rows = [(*r, v[0][1]) for v in found for r in v]
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.float64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([few.column("host").take(at), *columns], ["host", "path", "text", "score", "page"])

    source = pages.select(host_of(url_col).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))
    # Scores are whole thousandths, so that sums do not depend on the order; copies of a page count once.
    found = source.mapInArrow(run, "host string, path string, text long, score double, page long").withColumn("score", F.round(1000 * F.col("score")).cast("long"))
    each = found.groupBy("host", "path", "text", "page").agg(F.max("score").alias("score"))
    texts = cut(each.groupBy("host", "path", "text").agg(F.count("*").alias("pages"), F.sum("score").alias("score")))
    hosts = texts.where("path = ''").groupBy("host").agg(F.count("*").alias("all"))
    # A row for a host; joined by size like any other table.
    least = F.greatest(F.lit(STOCK_PAGES), F.ceil(F.lit(STOCK_SHARE) * F.col("all")))
    texts = texts.where("path <> ''").join(hosts, "host").withColumn("stock", F.col("pages") >= least)
    classed = F.contains(F.substring_index("path", ">", -1), F.lit("."))
    paths = texts.groupBy("host", "path").agg(
        F.first("all").alias("all"), F.sum("pages").alias("total"), F.sum(F.when(F.col("stock"), F.col("pages")).otherwise(0)).alias("repeated"), F.sum(F.when(F.col("stock"), 0).otherwise(F.col("score"))).alias("score")
    ).withColumn("stock", classed & (F.col("repeated") >= STOCK_PAGES) & (F.col("repeated") >= PATH_SHARE * F.col("total"))).withColumn("share", F.col("score") / (1000 * F.col("all")))
    none = F.lit(None)
    main = paths.where((F.col("share") >= SHARE) & ~F.col("stock")).select("host", "path", none.cast("long").alias("text"), "share")
    whole = paths.where("stock").select("host", "path", F.lit(ANY).cast("long").alias("text"), none.cast("double").alias("share"))
    return texts.where("stock").select("host", "path", "text", none.cast("double").alias("share")).unionByName(whole).unionByName(main)


def host_of(url_col: str) -> F.Column:
    return F.lower(F.coalesce(F.try_parse_url(F.col(f"`{url_col}`").cast("string"), F.lit("HOST")), F.lit("")))


def _gathered(rules: list[tuple]) -> dict[str, tuple[dict[str, float], dict[str, set[int]]]]:
    """Main paths and stock by host, from (host, path, text, share)."""
    found: dict[str, tuple[dict[str, float], dict[str, set[int]]]] = {}
    for host, path, text, share in rules:
        main, stock = found.setdefault(host, ({}, {}))
        if share is not None:
            main[path] = share
        else:
            stock.setdefault(path, set()).add(text)
    return found


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text.

    Up to BROADCAST_PATHS rules of all hosts are sent to every task once. More of
    them meet the pages' own regions in a join, so that a page gets the rules of
    its regions and no others.
    """
    rules = cut(host_rules(pages, url_col, html_col))
    few = rules.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS
    source = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"), host_of(url_col).alias("host"))
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("text", T.StringType())])
    if few:
        sent = pages.sparkSession.sparkContext.broadcast(_gathered([tuple(r) for r in rules.collect()]))  # BROADCAST_PATHS rows at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [extract(html.as_py(), *sent.value.get(host, ({}, {}))) for host, html in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], [id_col, "url", "text"])

        return source.mapInArrow(run, schema)

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, key, html in zip(*(batch.column(n) for n in ("host", "key", "html")), strict=True):
                own = sorted({(path, text) for path, text, _ in votes(html.as_py()) if path})
                yield pa.RecordBatch.from_arrays([pa.array([host.as_py()] * len(own)), pa.array([key.as_py()] * len(own), pa.int64()), pa.array([p for p, _ in own], pa.string()), pa.array([t for _, t in own], pa.int64())], ["host", "key", "path", "own"])

    # Pages of one text have the same regions.
    keyed = source.withColumn("key", F.xxhash64("html"))
    asked = keyed.select("host", "key", "html").mapInArrow(regions, "host string, key long, path string, own long").distinct()
    for_path = rules.where(F.col("share").isNotNull() | (F.col("text") == ANY))
    for_text = rules.where(F.col("share").isNull() & (F.col("text") != ANY))
    met = asked.select("host", "key", "path").distinct().join(for_path, ["host", "path"]).select("host", "key", "path", "text", "share")
    met = met.unionByName(asked.join(for_text.withColumnRenamed("text", "own"), ["host", "path", "own"]).select("host", "key", "path", F.col("own").alias("text"), "share"))
    told = met.groupBy("host", "key").agg(F.collect_list(F.struct("path", "text", "share")).alias("rules"))  # of a page's regions
    joined = keyed.join(told, ["host", "key"], "left").select("id", "url", "html", "host", "rules")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, rows in zip(batch.column("html"), batch.column("rules"), strict=True):
                found = _gathered([("", r["path"], r["text"], r["share"]) for r in rows.as_py() or []])
                texts.append(extract(html.as_py(), *found.get("", ({}, {}))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], [id_col, "url", "text"])

    return joined.mapInArrow(judged, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.withColumn("n_chars", F.length("text").cast("long"))


def brute_force(pages: list[tuple]) -> dict:
    """Text by page from (id, host, html): hosts' votes counted page by page in plain dictionaries; for tests."""
    out = {}
    for host in {h for _, h, _ in pages}:
        own = [(page, html) for page, h, html in pages if h == host]
        different = {v[0][1]: v for _, html in own if (v := votes(html))}
        counts: dict[tuple, int] = {}
        points: dict[tuple, int] = {}
        for found in different.values():
            best: dict[tuple, int] = {}
            for path, text, score in found[1:]:
                best[path, text] = max(best.get((path, text), 0), int(1000 * score + 0.5))
            for key, score in best.items():
                counts[key] = counts.get(key, 0) + 1
                points[key] = points.get(key, 0) + score
        least = max(STOCK_PAGES, -(-len(different) * STOCK_SHARE // 1))
        stock: dict[str, set[int]] = {}
        main: dict[str, float] = {}
        for path in {p for p, _ in counts}:
            texts = {t: n for (p, t), n in counts.items() if p == path}
            repeated = {t for t, n in texts.items() if n >= least}
            stock[path] = set(repeated)
            if "." in path.rsplit(">", 1)[-1] and (total := sum(texts[t] for t in repeated)) >= max(STOCK_PAGES, PATH_SHARE * sum(texts.values())):
                stock[path].add(ANY)
            share = sum(points[path, t] for t in texts if t not in repeated) / (1000 * len(different))
            if share >= SHARE and ANY not in stock[path]:
                main[path] = share
        for page, html in own:
            out[page] = extract(html, main, stock)
    return out
