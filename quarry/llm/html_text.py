"""HTML extraction with site template removal.

A page is read into elements, in one pass that is linear in its length. Every block-level element that holds text gets hashes of its subtree:
- an exact one, of tag, class and id, text, and the hashes of its children;
- a shape, of tag, class, id, role and the shapes of its children, runs of equal ones once, without any text. Only elements that a shape can tell
  from prose have one: those whose text is links by half or more, and, outside the article of a page that has one, those
  with a class, id or role of their own or a tag of page furniture such as ``nav`` or ``footer``.
Spark counts, for each host, on how many distinct pages a hash occurs, where pages of equal content are one page. Hashes on ``MIN_PAGES`` of them
or more, and on a share of the host's distinct pages, are templates of that host: ``MIN_SHARE`` for exact subtrees outside ``article`` and ``main``,
``MIN_CONTENT_SHARE`` for shapes and for exact subtrees inside, where a passage that many articles quote is content, as is one of over
``MAX_TEMPLATE_CHARS``. The blocks of templates are deleted. ``html``, ``body``, the article and whatever holds it are never templates.

Of what is left the blocks of the best content remain: those inside ``article``, else ``main``, else ``body``; articles in a ``main`` that has as much text outside them are a part of it.
Deleted as well, also on hosts of too few pages to count, are elements that HTML itself names as no content (``DROPPED_TAGS``, some roles, hidden ones), articles of readers' comments, forms unless they
wrap parts of the page (``PAGE_PARTS``), and containers whose class or id is, as a whole, the name of page furniture (``comments``, ``site-footer`` or ``ad-slot``, but not ``has-comments`` or ``ad-free``).
Inside an article or ``main`` the names that its subject may have as well (``AMBIGUOUS``) do not count. A ``head`` that is not closed ends before the first thing that cannot stand in it.

Blocks are the texts between block-level tags; ``br`` is white space. Character references are decoded, white space becomes one
space, blocks are joined by one line feed, and nothing is cut.

Scale: pages are parsed once; hashes and blocks leave in the same pass and are written. The hashes are counted as narrow rows with partial
aggregation by (host, hash, content), so a hot host spreads over its subtrees and pages. A template needs a share of its host's pages, so a host has
no more templates than ``1 / MIN_SHARE`` times the elements of a page; the list of a host goes to its pages by a
broadcast up to ``BROADCAST_TEMPLATES`` templates in all, beyond that by a shuffle of each page's own templates.

Cases: null html is empty and gives an empty text; very long pages are parsed as any other, whole; unclosed markup is closed at the end of the page; a tag
that is cut off by the end of the page is dropped; repeated rows are extracted each, and count as one page; a null url belongs to the host ``''``; an empty table gives an
empty table; other columns are not looked at.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, tidy

MIN_PAGES = 10
MIN_SHARE = 0.1  # of the host's distinct pages
MIN_CONTENT_SHARE = 0.5  # the same for shapes and for subtrees inside article or main
MAX_TEMPLATE_CHARS = 1000  # of text; longer subtrees inside article or main are prose
BROADCAST_TEMPLATES = 500_000

# quotes open a value only after "="; nothing here gives back what it has taken, so a match is linear
TAG = re.compile(r"""</?+([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)", re.I) for tag in RAW}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
}
#: a start tag closes these open elements, up to the given containers
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
P_LIMITS = BLOCKS - {"p"}
P_ENDERS = BLOCKS - {"body", "caption", "html", "legend", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: no content wherever they stand; what is in them is no text of the page
MUTE_TAGS = {"button", "canvas", "datalist", "embed", "head", "iframe", "input", "math", "noscript", "object", "script", "select", "style", "svg", "template", "textarea", "title"}
#: furniture by their meaning in HTML
FURNITURE_TAGS = {"aside", "dialog", "fieldset", "footer", "form", "menu", "nav", "search"}
DROPPED_TAGS = MUTE_TAGS | FURNITURE_TAGS - {"form"}
#: what may stand in a head; anything else, or text, begins the body
HEAD_TAGS = {"base", "basefont", "bgsound", "head", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
#: a form around one of these is a wrapper of the page, not a form to fill in
PAGE_PARTS = {"article", "footer", "h1", "header", "main", "nav"}
DROPPED_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "menu", "navigation", "search"}
#: the whole of one class or id, with an optional word for the place before it or for the kind of box after it
COMMENTS = r"comments?|commentlist|disqus"
PLAIN = r"ads?|adbox|adsense|advert|adverts|advertisement|breadcrumbs?|consent|cookies?|footer|gdpr|modal|nav|navbar|navigation|newsletter|pager|pagination|popup|promo|promotion|share|sharing|sidebar|social|subscribe|topbar"
#: words that an article may also use for what it is about: a restaurant's menu, the sponsors of a bill
AMBIGUOUS = r"banner|masthead|menu|recommended|related|replies|sponsors?|sponsored|widget"


def _names(words: str) -> re.Pattern:
    return re.compile(
        rf"(?:(?:site|page|main|top|bottom|left|right|global|primary|secondary|js|post|article|user|reader)[-_]?)?(?:{words})"
        r"(?:[-_](?:area|banner|bar|block|body|box|buttons|container|inner|item|left|links|list|menu|notice|overlay|popup|right|section|slot|thread|unit|widget|wrapper|[0-9]+))?"
    )


FURNITURE, IN_CONTENT, COMMENT = _names(f"{COMMENTS}|{PLAIN}|{AMBIGUOUS}"), _names(f"{COMMENTS}|{PLAIN}"), _names(COMMENTS)
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "header", "figure", "details", "center"}
NEVER = {"html", "body", "main", "article"}
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?+""")
CONTENT_RANK = {"article": 2, "main": 1}
#: what the two lowest bits of a hash tell
OUTSIDE, INSIDE, SHAPE = 0, 1, 2
DROPPED = -1  # rank of a block that is deleted whatever the counts say


class Element:
    __slots__ = ("tag", "name", "parent", "mute", "dropped", "content", "holds", "chars", "link_chars", "exact", "shape", "digest", "figure", "owner", "number", "form", "wraps", "in_main")

    def __init__(self, tag: str, name: str, parent: Element | None, dropped: bool, content: int):
        self.tag, self.name, self.parent, self.dropped, self.content = tag, name, parent, dropped, content
        self.mute = tag in MUTE_TAGS or (parent is not None and parent.mute)
        self.holds = tag in NEVER or (parent is not None and content != parent.content)  # is content or holds it, and so is no template
        self.chars = self.link_chars = self.digest = self.figure = 0
        self.exact, self.shape = [f"{tag} {name}".encode("utf-8", "surrogatepass")], []
        self.owner: Element | None = None  # the innermost counted element around it, itself included
        self.number = -1
        self.form: Element | None = self if tag == "form" else parent.form if parent is not None else None
        self.in_main = False
        self.wraps = False  # of a form: whether parts of the page stand in it

    def rank(self) -> int:
        """Of a block in this element, once the page is read."""
        return DROPPED if self.dropped or (self.form is not None and not self.form.wraps) else self.content

    def close(self) -> None:
        head = self.exact[0]
        self.digest = xxhash.xxh64_intdigest(b"\0".join(self.exact))
        self.figure = xxhash.xxh64_intdigest(head + b"".join(self.shape))
        self.exact = self.shape = None
        parent = self.parent
        if parent is not None:
            parent.exact.append(self.digest.to_bytes(8, "big"))
            own = self.figure.to_bytes(8, "big")
            if not parent.shape or parent.shape[-1] != own:
                parent.shape.append(own)
            parent.chars += self.chars
            parent.link_chars += self.chars if self.tag == "a" else self.link_chars
            if self.holds and self.tag not in ("html", "body"):
                parent.holds = True

    def keys(self, has_content: bool) -> list[int]:
        """The hashes under which this element is counted, as signed 64-bit numbers whose lowest bits tell their kind."""
        if self.holds or not self.chars or self.tag not in BLOCKS or (self.content and self.chars > MAX_TEMPLATE_CHARS):
            return []
        out = [(self.digest, INSIDE if self.content else OUTSIDE)]
        furniture = has_content and not self.content and (bool(self.name) or self.tag in FURNITURE_TAGS)
        if furniture or 2 * self.link_chars >= self.chars:
            out.append((self.figure, SHAPE))
        return [((d & ~3 | kind) ^ 1 << 63) - (1 << 63) for d, kind in out]


def _attributes(source: str) -> dict[str, str]:
    return {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(source)} if source.strip(" /") else {}


def _is_dropped(tag: str, attributes: dict[str, str], content: int) -> bool:
    if tag == "menu" and content:  # a list of what the text is about, as any other
        return False
    if tag in DROPPED_TAGS or (tag == "header" and not content):  # within an article a header is content
        return True
    if tag in ("html", "body") or not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in DROPPED_ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return True
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    if tag == "article":  # of a reader
        return attributes.get("itemprop", "").lower() == "comment" or attributes.get("itemtype", "").endswith("/Comment") or any(map(COMMENT.fullmatch, names))
    return tag in CONTAINERS and any(map((IN_CONTENT if content else FURNITURE).fullmatch, names))


class Page:
    """The elements of a page in the order of their start tags, and its blocks as (text, content rank, innermost element)."""

    def __init__(self, html: str):
        self.root = Element("html", "", None, False, 0)
        self.stack, self.elements, self.found, self.text = [self.root], [self.root], [], []
        self.open = Counter()
        self._read(html)
        self.blocks = [(text, top.rank(), top) for text, top in self.found]
        # of a main part with articles in it, the articles are the content if most of its text is theirs; else they are a part of it
        size = Counter()
        for text, rank, top in self.blocks:
            size[rank, top.in_main] += len(text)
        if size[1, True] >= size[2, True] > 0 and not size[2, False]:
            self.blocks = [(text, min(rank, 1), top) for text, rank, top in self.blocks]

    def _flush(self) -> None:
        if self.text:
            words = " ".join("".join(self.text).split())
            self.text.clear()
            if words:
                self.found.append((words, self.stack[-1]))

    def _pop(self, upto: int) -> None:
        while len(self.stack) > upto:
            element = self.stack.pop()
            self.open[element.tag] -= 1
            element.close()

    def _say(self, raw: str) -> None:
        value = unescape(raw) if "&" in raw else raw
        words = " ".join(value.split())
        if words and self.stack[-1].tag == "head":
            self._pop(len(self.stack) - 1)
        top = self.stack[-1]
        if words:
            top.exact.append(words.encode("utf-8", "surrogatepass"))
            top.chars += len(words)
        if not top.mute:
            self.text.append(value)

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                self._say(html[at:])
                break
            after = html[lt + 1 : lt + 3]
            letter = after[1:2] if after[:1] == "/" else after[:1]
            if after[:1] in ("!", "?"):
                if lt > at:
                    self._say(html[at:lt])
                comment = html.startswith("<!--", lt)
                end = html.find("-->", lt + 4) if comment else html.find(">", lt)
                if end < 0:
                    break
                at = end + (3 if comment else 1)
                continue
            if not (letter.isascii() and letter.isalpha()):  # no tag: the sign itself
                self._say(html[at : lt + 1])
                at = lt + 1
                continue
            if lt > at:
                self._say(html[at:lt])
            m = TAG.match(html, lt)
            if m is None:  # no end up to the end of the page
                break
            at = m.end()
            if after[0] == "/":
                self._end(m[1].lower())
            else:
                at = self._start(m[1].lower(), m[2], html, at)
        self._flush()
        self._pop(1)

    def _end(self, tag: str) -> None:
        if self.open[tag] > 0:
            k = len(self.stack) - 1
            while self.stack[k].tag != tag:
                k -= 1
            if any(e.tag in BLOCKS for e in self.stack[k:]):
                self._flush()
            self._pop(k)
        elif tag in BLOCKS:
            self._flush()

    def _close_open(self, ends: set[str], limits: set[str]) -> None:
        if any(self.open[t] > 0 for t in ends):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in ends:
                    self._pop(k)
                    return
                if self.stack[k].tag in limits:
                    return

    def _start(self, tag: str, source: str, html: str, at: int) -> int:
        if tag == "html":
            return at
        stack = self.stack
        if stack[-1].tag == "head" and tag not in HEAD_TAGS:
            self._pop(len(stack) - 1)
        if tag in BLOCKS:
            self._flush()
        elif tag == "br" and not stack[-1].mute:
            self.text.append(" ")
        if tag in P_ENDERS:
            self._close_open({"p"}, P_LIMITS)
        if tag in CLOSES:
            self._close_open(*CLOSES[tag])
        if tag in VOID:
            return at
        attributes = _attributes(source)
        top = stack[-1]
        dropped = top.dropped or _is_dropped(tag, attributes, top.content)
        content = top.content
        if not dropped:
            content = max(content, CONTENT_RANK.get(tag, 0), CONTENT_RANK["main"] if attributes.get("role") == "main" else 0)
        name = " ".join(filter(None, (attributes.get(k, "") for k in ("class", "id", "role"))))
        element = Element(tag, name, top, dropped, content)
        element.in_main = top.in_main or (not dropped and (tag == "main" or attributes.get("role") == "main"))
        if tag in PAGE_PARTS and element.form is not None:
            element.form.wraps = True
        if tag in RAW:
            end = RAW_ENDS[tag].search(html, at)
            element.exact.append(html[at : end.start() if end else len(html)].encode("utf-8", "surrogatepass"))
            element.close()
            return (html.find(">", end.end()) + 1 or len(html)) if end else len(html)
        stack.append(element)
        self.open[tag] += 1
        self.elements.append(element)
        return at

    def content(self) -> list[str]:
        """The blocks of the page's content, templates included."""
        rank = max((0, *(r for _, r, _ in self.blocks)))
        return [text for text, r, _ in self.blocks if r == rank]

    def packed(self) -> tuple[int, list[list[int]], list[tuple[str, int, int]]]:
        """A hash of the content; the counted elements as [number of the counted element around it or -1, hashes]; the blocks as (text, rank, counted element or -1)."""
        has_content = any(r > 0 for _, r, _ in self.blocks)
        counted = []
        for element in self.elements:
            above = element.parent.owner if element.parent is not None else None
            if keys := element.keys(has_content):
                element.number, element.owner = len(counted), element
                counted.append([-1 if above is None else above.number, *keys])
            else:
                element.owner = above
        blocks = [(text, rank, -1 if e.owner is None else e.owner.number) for text, rank, e in self.blocks]
        content = xxhash.xxh64_intdigest("\n".join(self.content()).encode("utf-8", "surrogatepass"))
        return (content ^ 1 << 63) - (1 << 63), counted, blocks


def kept_blocks(counted: list[list[int]], blocks: list[tuple[str, int, int]], templates: set[int]) -> tuple[list[str], int]:
    """The texts of the blocks of best rank that stand in no template, and the number of blocks that do."""
    gone = []
    for around, *keys in counted:
        gone.append((around >= 0 and gone[around]) or not templates.isdisjoint(keys))
    left = [(text, rank) for text, rank, owner in blocks if owner < 0 or not gone[owner]]
    # also where templates are all of an article, what stands beside it is no content
    best = max((0, *(rank for _, rank, _ in blocks)))
    return [text for text, rank in left if rank == best], len(blocks) - len(left)


def host_of(url: F.Column) -> F.Column:
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(authority)


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, content (hash of the page's content), keys (distinct hashes of its counted elements) and blob (elements and blocks) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, keys, blobs = [], [], []
            for html in batch.column(3):
                page, counted, blocks = Page(html.as_py() or "").packed()
                content.append(page)
                keys.append(sorted({k for _, *own in counted for k in own}))
                blobs.append(json.dumps([counted, blocks], ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(content, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(blobs, pa.binary())],
                names=["page_id", "url", "host", "content", "keys", "blob"],
            )

    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(tidy(run), "page_id long, url string, host string, content long, keys array<long>, blob binary")


def templates(read: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, content_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """(host, key, n_pages) of the hashes that recur on many distinct pages of a host, and on a share of them."""
    # a null key stands for the page itself
    rows = read.select("host", "content", F.explode(F.concat("keys", F.array(F.lit(None).cast("long")))).alias("key"))
    counts = materialise(rows.groupBy("host", "key").agg(F.count_distinct("content").alias("n_pages")).where(F.col("n_pages") >= min_pages))
    hosts = counts.where("key is null").select("host", F.col("n_pages").alias("of_host"))
    share = F.when(F.col("key").bitwiseAND(3) == OUTSIDE, min_share).otherwise(content_share)
    return counts.where("key is not null").join(hosts, "host").where(F.col("n_pages") >= share * F.col("of_host")).select("host", "key", "n_pages")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars and n_template_blocks (blocks deleted as templates) for every row of ``pages`` (page_id, url, html)."""
    read = materialise(read_pages(pages).withColumn("row_no", F.monotonically_increasing_id()))
    found = materialise(templates(read, min_pages).select("host", "key"))
    if found.count() <= BROADCAST_TEMPLATES:
        of_host = found.groupBy("host").agg(F.collect_set("key").alias("gone"))
        joined = read.join(F.broadcast(of_host), "host", "left")
    else:
        own = read.select("row_no", "host", F.explode("keys").alias("key")).join(found, ["host", "key"], "left_semi").groupBy("row_no").agg(F.collect_set("key").alias("gone"))
        joined = read.join(own, "row_no", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for blob, gone in zip(batch.column(2), batch.column(3), strict=True):
                text, n = kept_blocks(*json.loads(blob.as_py()), set(gone.as_py() or ()))
                texts.append("\n".join(text))
                removed.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(removed, pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_template_blocks"],
            )

    return joined.select("page_id", "url", "blob", "gone").mapInArrow(tidy(finish), "page_id long, url string, text string, n_chars long, n_template_blocks long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
