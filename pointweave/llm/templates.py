"""Main text of web pages by removal of site templates.

A page is parsed into a tree, every element's subtree is hashed, and Spark
counts per host on how many different pages a subtree occurs; pages with the same
text (copies, re-crawls, mirrors) are one page. Subtrees that recur across
many pages of their host are template and are deleted; inside an article only
containers (never a paragraph, a heading or the bulk of the article) can be.
Then elements that are furniture by their name, role, class or id go, and the
blocks that are left, of the article where the page has one, are the text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import folded, unfolded
from pointweave.llm.urls import split_url
from pointweave.session import cut

#: a subtree is template when it occurs on at least so many different pages of its host, whatever the host's size
MIN_PAGES = 4

# Element names as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption head html legend optgroup option tbody td tfoot th thead tr".split())
SIBLING = {  # an opening tag ends an open element of these names
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
SCOPE = frozenset("html body table ul ol dl div section article main aside nav header footer form td th blockquote".split())
#: inside an article only these can be template: what authors write twice (a paragraph, a heading) stays
CONTAINERS = frozenset("div section ul ol dl table details figure hgroup".split())
# Elements that hold no prose, and elements that are page furniture by their meaning.
SILENT = frozenset("head script style noscript template iframe object embed svg canvas audio video map button select textarea input title xmp noembed noframes".split())
FURNITURE = SILENT | frozenset("nav footer aside form menu dialog label fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
#: a class or id is furniture when it is one of the subjects, alone or in a compound with other subjects and the words beside them
SUBJECTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar navigation sidebar footer masthead "
    "breadcrumb breadcrumbs cookies cookie consent gdpr notice notices popup modal newsletter subscribe subscription share sharing sharebar social related "
    "recommended recommendations comment comments disqus replies respond login signup widget widgets toolbar pagination pager skip".split()
)
BESIDE = frozenset(
    "site page main top bottom left right primary secondary global block box list wrapper wrap container area section bar item items posts articles link links "
    "unit slot buttons icons text message messages form thread inner outer mobile sticky header content body meta author".split()
)
#: boxes; on other elements (a section, a heading) a single word as id only names the place
BOXES = frozenset("div ul ol dl table figure details".split())
#: only outside an article; inside, such elements hold its title
HEADS = frozenset("header siteheader".split())
#: articles and sections of readers
READERS = frozenset("comment comments reply replies respond disqus".split())
PIECES = re.compile(r"[-_]+")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:![^>]*|\?[^>]*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.DOTALL
)
#: one attribute, whatever its name: name="value", name='value', name=value or the bare name; only a quote right after = begins a quoted value
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Element:
    __slots__ = ("name", "attrs", "children", "key", "letters", "prose")

    def __init__(self, name: str, attrs: str = ""):
        self.name, self.attrs, self.children, self.key, self.letters, self.prose = name, attrs, [], 0, 0, 0


def parse(source: str) -> Element:
    """The element tree; text children are strings with character references decoded. Unclosed elements end with their parent."""
    root = Element("#page")
    open_: list[Element] = [root]
    at = 0
    while True:
        found = TOKEN.search(source, at)
        text = source[at : found.start() if found else len(source)]
        if text:
            open_[-1].children.append(entities.unescape(text))
        if not found:
            return root
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if found[1]:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].name == name:
                    del open_[i:]
                    break
                if open_[i].name in SCOPE and name not in SCOPE and name not in ("html", "body"):
                    break  # a stray end tag doesn't leave its container
            continue
        if name in CLOSES_P or name in SIBLING:
            ends = SIBLING.get(name, set())
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].name in ends or (open_[i].name == "p" and name in CLOSES_P):
                    del open_[i:]
                    if not ends:
                        break
                elif open_[i].name in SCOPE:
                    break
        element = Element(name, found[3] or "")
        open_[-1].children.append(element)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.IGNORECASE).search(source, at)
            body, at = (source[at : close.start()], close.end()) if close else (source[at:], len(source))
            element.children.append(body)
        elif name not in VOID and not element.attrs.endswith("/"):
            open_.append(element)


def hash_tree(root: Element) -> None:
    """Gives every element a 64-bit key of its name, attributes, text and children, and the length of its text, from the leaves up."""
    order, stack = [], [root]
    while stack:
        element = stack.pop()
        order.append(element)
        stack += [c for c in element.children if not isinstance(c, str)]
    for element in reversed(order):
        h = blake2b(f"{element.name}\x00{' '.join(element.attrs.split())}".encode("utf-8", "surrogatepass"), digest_size=8)
        for child in element.children:
            h.update(b"\x01" + " ".join(child.split()).encode("utf-8", "surrogatepass") if isinstance(child, str) else b"\x02" + child.key.to_bytes(8, "little", signed=True))
        element.key = int.from_bytes(h.digest(), "little", signed=True)
        element.letters = sum(len(c) if isinstance(c, str) else c.letters for c in element.children)


@lru_cache(maxsize=20_000)
def marks(attrs: str) -> tuple[bool, bool, bool, bool, bool]:
    """What attributes say: hidden; furniture by role, class or id; furniture by an id of one word; a header; something of readers."""
    hidden = furniture = named = head = readers = False
    for name, *values in ATTRIBUTE.findall(attrs):
        value, name = "".join(values).lower(), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
        elif name == "role":
            furniture |= value in ROLES
        elif name in ("class", "id"):
            for token in value.split():
                pieces = [p for p in PIECES.split(token) if p]
                if token == "side-bar" or (all(p in SUBJECTS or p in BESIDE for p in pieces) and any(p in SUBJECTS for p in pieces)):
                    furniture |= name == "class" or len(pieces) > 1
                    named = True
                head |= token in HEADS or (pieces[-1:] == ["header"] and all(p in BESIDE for p in pieces))
                readers |= bool(pieces) and READERS.issuperset(pieces[:1]) and all(p in READERS or p in BESIDE for p in pieces)
        elif name == "itemprop":
            readers |= value == "comment"
    return hidden, furniture, named, head, readers


class Page:
    """A parsed page and what on it is main text.

    ``body`` is the article with most letters (main, where no article is; the
    page itself, where neither is). Articles of readers count only where no
    other is. A class, id or role never removes the body, what contains it, or
    an element with more than two thirds of the page's letters; neither does being a
    form. Inside the body an article with under half of its letters goes: it is
    another text, or a reader's.
    """

    def __init__(self, root: Element):
        self.root = root
        parent: dict[int, Element] = {}
        order, stack = [], [root]
        while stack:
            element = stack.pop()
            order.append(element)
            inner = [c for c in element.children if not isinstance(c, str)]
            parent.update((id(c), element) for c in inner)
            stack += inner
        for element in reversed(order):
            element.prose = sum(len(c.strip()) if isinstance(c, str) else c.prose for c in element.children)
            if element.name in FURNITURE and element.name != "form":
                element.prose = 0
        self.bulk = root.prose * 2 / 3
        self.kept: set[int] = set()
        self.body = at = self._choose()
        self.found = self.body is not root
        while at is not None:
            self.kept.add(id(at))
            at = parent.get(id(at))

    def _choose(self) -> Element:
        best: dict[str, Element] = {}
        stack = [(self.root, False)]
        while stack:
            element, readers = stack.pop()
            theirs = bool(element.attrs) and marks(element.attrs)[4]
            readers = (readers or theirs) and element.prose <= self.bulk
            if element.name in ("article", "main") and not readers and element.prose > (best[element.name].prose if element.name in best else 0):
                best[element.name] = element
            for child in reversed(element.children):
                if not isinstance(child, str) and not self._gone(child, False):
                    stack.append((child, readers))
        return best.get("article") or best.get("main") or self.root

    def _gone(self, element: Element, inside: bool) -> bool:
        name = element.name
        if id(element) in self.kept or name in ("html", "body"):
            return False
        if name in FURNITURE and not (name == "form" and element.prose > self.bulk):
            return True
        if name == "header" and not inside:
            return True
        if not element.attrs or name == "main":
            return False
        hidden, furniture, named, head, readers = marks(element.attrs)
        if hidden or (readers and inside):
            return True
        labelled = readers or (name != "article" and (furniture or (named and name in BOXES) or (head and not inside)))
        return labelled and element.prose <= self.bulk

    def skips(self, element: Element) -> bool:
        """Whether an element inside the body is furniture."""
        if self.found and element.name == "article" and element is not self.body and element.prose * 2 < self.body.prose:
            return True
        return self._gone(element, self.found)


def candidate_keys(page: Page) -> set[int]:
    """Keys of the elements that may be template: any outside the body, containers inside."""
    keys, stack = set(), [(page.root, False)]
    while stack:
        element, within = stack.pop()
        within_or_body = within or (page.found and element is page.body)
        if element.name in CONTAINERS or not (within_or_body or element is page.root or element.name in ("html", "body")):
            keys.add(element.key)
        stack += [(c, within_or_body) for c in element.children if not isinstance(c, str)]
    return keys


def _removable(item: Element, page: Page) -> bool:
    """Whether ``item`` goes where it is template: anything on a page without article or main, else containers under half of the body."""
    return not page.found or (item.name in CONTAINERS and item.letters < page.body.letters / 2)


def removable_keys(page: Page) -> set[int]:
    """Keys of the elements whose being template changes this page's text; the tree must be hashed."""
    keys, stack = set(), [page.body]
    while stack:
        item = stack.pop()
        if not page.skips(item):
            if _removable(item, page):
                keys.add(item.key)
            stack += [c for c in item.children if not isinstance(c, str)]
    return keys


def main_text(page: Page, template: set[int] = frozenset()) -> str:
    """The blocks that are left, in page order, one per line; with ``template`` the tree must be hashed."""
    blocks: list[list[str]] = [[]]
    # depth-first without recursion: a None on the stack ends a block
    stack: list = [page.body]
    while stack:
        item = stack.pop()
        if item is None:
            blocks.append([])
        elif isinstance(item, str):
            blocks[-1].append(item)
        elif item.name == "br":
            blocks[-1].append(" ")
        elif page.skips(item):
            continue
        elif item.key in template and _removable(item, page):
            continue
        else:
            block = item.name in BLOCK
            if block:
                blocks.append([])
                stack.append(None)
            stack += reversed(item.children)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def page_key(page: Page) -> int:
    """A 64-bit key of the page's text before any template is removed: pages are different when it is."""
    return int.from_bytes(blake2b(main_text(page).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _site(url_col: str, html_col: str) -> list[Column]:
    """Host, html and a key of the html; two pages of a host with one key share their list of templates, which changes neither text."""
    source = F.coalesce(html_col, F.lit(""))
    return [split_url(url_col)[0].alias("_host"), source.alias("_html"), F.xxhash64(source).alias("_page")]


def page_templates(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(_host, _page, _template): for the pages that hold removable template subtrees, the keys of these; a written table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, pages, texts, keys, asked = [], [], [], [], []
            for host, source, number in zip(*(batch.column(i).to_pylist() for i in range(3))):
                root = parse(source)
                hash_tree(root)
                page = Page(root)
                own = candidate_keys(page)
                removable = removable_keys(page)
                hosts += [host] * len(own)
                pages += [number] * len(own)
                texts += [page_key(page)] * len(own)
                keys += own
                asked += [k in removable for k in own]
            longs = [pa.array(x, pa.int64()) for x in (pages, texts, keys)]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *longs, pa.array(asked, pa.bool_())], names=["_host", "_page", "_text", "_key", "_asked"])

    pages = df.select(*_site(url_col, html_col)).where("_host <> ''")
    subtrees = cut(pages.mapInArrow(run, "_host string, _page bigint, _text bigint, _key bigint, _asked boolean"), "subtrees")
    often = cut(subtrees.groupBy("_host", "_key").agg(F.count_distinct("_text").alias("_n")).where(f"_n >= {MIN_PAGES}").select("_host", "_key"), "often")
    # by page, so a list holds no more than the page's own elements
    found = subtrees.where("_asked").select("_host", "_page", "_key").join(often, ["_host", "_key"], "left_semi")
    return cut(found.groupBy("_host", "_page").agg(F.collect_set("_key").alias("_template")), "templates")


def extract(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``df`` without its html, plus ``text`` and ``n_chars`` (code points).

    A subtree is template when it occurs on MIN_PAGES different pages of its
    host. A null html counts as empty and has an empty text. Pages without a
    host have no template of their own, only furniture is removed. Pages are
    read twice, and shuffled whole where the lists of template keys by page
    outgrow Spark's broadcast size. Columns named text or n_chars give way.
    """
    kept = [c for c in df.columns if c not in ("text", "n_chars", html_col)]
    templates = page_templates(df, url_col, html_col)
    joined = folded(df, *_site(url_col, html_col), columns=kept).join(templates, ["_host", "_page"], "left").select("row", "_html", "_template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, template in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                root = parse(source)
                if template:
                    hash_tree(root)
                texts.append(main_text(Page(root), set(template or ())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"]
            )

    schema = joined.select("row").schema.add("text", "string").add("n_chars", "long")
    return joined.mapInArrow(run, schema).select(*unfolded(kept), "text", "n_chars")
