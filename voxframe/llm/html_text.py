"""Main text of web pages by a site style tree: same-host pages are merged and branches that say little are cut."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxframe.llm.common import small_side, stored

# fixed values
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.DOTALL)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|aria-label|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset(
    "head nav footer aside form label script style noscript template iframe object svg canvas button select option textarea dialog menu audio video map".split()
)
#: Elements that end an open element of the same kind.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_NAMES = (
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|contentinfo|complementary|"
    r"cookies?|consent|notice|alert|popup|modal|overlay|newsletter|subscribe|share|sharing|social|related|recommend\w*|comments?|commentlist|"
    r"disqus|respond|replies|widget|pagination|pager|login|signup|search|toolbar|skip|copyright|disclaimer"
)
#: Outside the marked article: a name anywhere between dashes puts a branch behind the others.
HINT = re.compile(rf"(?:^|[\s_-])(?:{_NAMES}|(?:site|page|global)(?:footer|nav|menu|sidebar))(?:$|[\s_-])", re.IGNORECASE)
#: Within the article: a whole class of a container that is such a name, with what says where or how it stands.
BOILERPLATE = re.compile(
    rf"(?:(?:site|page|post|article|entry|global|main|top|bottom|inline)[_-])?(?:{_NAMES}|teaser|read-more)"
    r"(?:[_-](?:box|bar|list|block|section|widget|area|links?|buttons?|icons?|container|wrapper|wrap|inner|form|posts?|articles?|stories|items?|module|slot|unit|banner|signup|\d+))*",
    re.IGNORECASE,
)
#: Readers' comments, by class or id.
COMMENTS = re.compile(r"(?:(?:reader|user|post|article)[_-])?(?:comments?|comment[_-]?(?:list|section|area|thread|body|\d+)|disqus\w*|respond|repl(?:y|ies))", re.IGNORECASE)
CONTAINERS = frozenset("div section article ul ol dl details figure table center".split())
#: Class tokens that tell how a page is laid out, not what an element is.
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without|hide|show)[-_]\S*", re.IGNORECASE)
HEADER = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar|site-head)(?:$|[\s_-])", re.IGNORECASE)

#: Elements whose inline parts are words of a sentence.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption caption address".split())

#: How far a branch is dropped: by a name that stands for boilerplate, or by its kind.
NAMED, GONE = 1, 2
#: Weight of content against presentation, importance under which a branch is cut, and pages a host needs for it.
CONTENT_WEIGHT, LEAST_IMPORTANCE, LEAST_PAGES = 0.9, 0.2, 8
#: Share of a host's pages that must show a text at one place outside the marked article for it to be cut.
SHARE = 0.5


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Page:
    """Blocks of a page in order: (style path, text, number of the article or 0, within a branch named as boilerplate, all of it links), and the child sequences of its elements outside articles.

    Outside the marked article a name does not drop a branch: its text is taken if the page has
    no other, and an article within it if it holds more than what is named as nothing. Within
    it only containers are dropped, and only for a class that as a whole is such a name.
    """

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[int, str, int, bool, bool]] = []
        self.sequences: list[tuple[int, int]] = []
        # of each open element: tag, path, labels of its children, how far dropped, article, that within a named branch
        self.stack: list[tuple[str, int, list[str], int, int, bool]] = [("", 0, [], 0, 0, False)]
        self.held: list[str] = []
        self.unlinked = False
        #: of each article: the one around it or 0, and if it is a whole main part
        self.articles: list[tuple[int, bool]] = [(0, False)]
        at = 0
        scan = TOKEN.search
        while found := scan(source, at):
            if found.start() > at:
                self.text(source[at : found.start()])
            at = found.end()
            name = found[2]
            if not name:
                continue
            tag = name.lower()
            if found[1]:
                self.close(tag)
                continue
            self.open(tag, found[3])
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.IGNORECASE).search(source, at)
                at = end.start() if end else len(source)
        self.text(source[at:])
        self.flush()
        while len(self.stack) > 1:
            self.pop()

    def text(self, raw: str) -> None:
        if self.stack[-1][3] < GONE:
            self.held.append(raw)
            if not self.unlinked and not raw.isspace():
                self.unlinked = all(x[0] != "a" for x in self.stack)

    def flush(self) -> None:
        if self.held:
            text = " ".join(entities.unescape("".join(self.held)).split())
            linked = not self.unlinked
            self.held, self.unlinked = [], False
            if text:
                # inline elements that are still open are not part of the block's place
                level = next(x for x in reversed(self.stack) if x[0] not in INLINE)
                self.blocks.append((level[1], text, level[4], level[3] == NAMED or level[5], linked))

    def pop(self) -> None:
        tag, path, children, dropped, article, _ = self.stack.pop()
        if children and not dropped and not article:
            self.sequences.append((path, _hash(" ".join(children))))

    def open(self, tag: str, attributes: str) -> None:
        if tag in ("br", "wbr"):
            self.text(" ")
            return
        if tag not in INLINE:
            self.flush()
            # a paragraph ends where a block begins; list items and cells end at their next
            if self.stack[-1][0] != "p":
                ends = SIBLINGS.get(tag, ())
                if ends and self.stack[-1][0] in ends:
                    self.pop()
            while any(x[0] == "p" for x in self.stack[1:]) and tag != "img":
                self.pop()
        if tag in VOID:
            return
        marks, hidden, names = [], False, {}
        if attributes:
            for key, a, b, c in ATTRIBUTE.findall(attributes):
                value, key = a or b or c, key.lower()
                hidden |= key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and bool(re.search(r"display\s*:\s*none", value)))
                if key in ("class", "id", "role"):
                    marks.append(value)
                names[key] = value
        _, above, children, dropped, article, named = self.stack[-1]
        label = f"{tag}.{marks[0]}" if marks else tag
        children.append(label)
        main = tag in ("article", "main") or "main" in marks
        own = 0
        if tag in DROPPED or hidden or (tag == "header" and not article and not main):
            own = GONE
        elif article:
            own = GONE if self.boilerplate(tag, names) else 0
        elif main:
            named |= tag == "article" and any(BOILERPLATE.fullmatch(x) or COMMENTS.fullmatch(x) for x in names.get("class", "").split())
        elif tag not in ("body", "html"):
            hints = [LAYOUT.sub("", names[k]) for k in ("class", "id", "role", "aria-label") if k in names]
            if any(HINT.search(h) or HEADER.search(h) for h in hints):
                own = GONE if tag in INLINE else NAMED
        dropped = max(dropped, own)
        if main and not article and dropped == NAMED:
            dropped, named = 0, True
        if main and (not article or (self.articles[article][1] and tag == "article")) and dropped < GONE:
            self.articles.append((article, tag != "article"))
            article = len(self.articles) - 1
        if tag in INLINE:
            self.stack.append((tag, above, children, dropped, article, named))
        else:
            self.stack.append((tag, _hash(f"{above}/{label}"), [], dropped, article, named))

    def boilerplate(self, tag: str, names: dict[str, str]) -> bool:
        """Whether an element within the article is none of its text."""
        classes = names.get("class", "").split()
        if any(COMMENTS.fullmatch(x) for x in [*classes, names.get("id", "")]):
            return tag in CONTAINERS or tag in INLINE
        if tag in INLINE and any(x[0] in PROSE for x in self.stack):
            return False  # a word of a sentence
        if tag not in CONTAINERS and tag not in INLINE:
            return False
        said = [*classes, names.get("role", ""), *names.get("aria-label", "").split()[:1]]
        return any(BOILERPLATE.fullmatch(x) for x in said)

    def close(self, tag: str) -> None:
        if tag in ("br", "p") and not any(x[0] == tag for x in self.stack):
            self.flush()
            return
        if not any(x[0] == tag for x in self.stack[1:]):
            return
        if tag not in INLINE:
            self.flush()
        elif any(x[0] not in INLINE and x[0] != tag for x in self.stack[len(self.stack) - self.stack[::-1].index(next(x for x in reversed(self.stack) if x[0] == tag)) :]):
            return  # an inline end tag does not close the blocks that began inside
        while self.stack[-1][0] != tag:
            self.pop()
        self.pop()

    def main(self) -> list[tuple[int, str, int, bool, bool]]:
        """The blocks of the largest marked article; without one, those outside named branches that are not links alone; else the rest.

        A main part with one article in it is that article, with what stands around it there.
        """
        whole = {}
        for number, (around, _) in enumerate(self.articles):
            alone = around and sum(x[0] == around for x in self.articles) == 1
            whole[number] = around if alone else number
        found: dict[tuple[int, bool], list] = {}
        for b in self.blocks:
            found.setdefault((whole[b[2]], b[3]), []).append(b)
        size = lambda blocks: sum(len(b[1]) for b in blocks)
        largest = lambda named: max((found[k] for k in found if k[0] and k[1] == named), key=size, default=[])
        if article := largest(False):
            return article
        plain = found.get((0, False), [])
        plain = [b for b in plain if not b[4]] or plain
        return max(largest(True), plain, key=size) or found.get((0, True), [])


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page the distinct (path, content) and (path, child sequence) nodes outside articles, and a hash of all its blocks."""
    kind = pa.list_(pa.struct([("path", pa.int64()), ("what", pa.int64()), ("content", pa.bool_())]))
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            nodes, whole = [], []
            for source in part.column("html"):
                page = Page(source.as_py())
                own = {(b[0], _hash(b[1]), True) for b in page.blocks if not b[2]} | {(p, s, False) for p, s in page.sequences}
                nodes.append([{"path": p, "what": w, "content": c} for p, w, c in sorted(own)])
                whole.append(_hash("\n".join(b[1] for b in page.main())))
            yield pa.RecordBatch.from_arrays([part.column("host"), pa.array(whole, pa.int64()), pa.array(nodes, kind)], ["host", "page", "nodes"])


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, what): branches to cut; what is null for a path as a whole, else the content to cut there.

    Over the m distinct pages of a host that have a node, the entropy of its contents (how
    evenly each text is spread over the pages) and of its child sequences give its importance:
    1 for a node whose text differs from page to page, 0 for one that is the same everywhere.
    A branch is cut if its importance is low and its texts stand on half of the pages each, in
    the mean; a single text that half of them show at one place is cut alone. These shares do
    not fall with m. Nothing of a marked article is in the tree: it is never cut for being
    repeated.
    """
    merged = pages.mapInArrow(_merge, "host string, page long, nodes array<struct<path:long,what:long,content:boolean>>")
    # copies of a page, of which a host may have very many, count once
    once = merged.groupBy("host", "page").agg(F.min("nodes").alias("nodes"))
    each = once.select("host", F.explode("nodes").alias("node")).groupBy("host", "node.path", "node.what", "node.content").agg(F.count(F.lit(1)).alias("n"))
    each = stored(each, "nodes")
    n, content = F.col("n"), F.col("content")
    paths = each.groupBy("host", "path").agg(
        F.sum(F.when(content, n)).alias("texts"),
        F.sum(F.when(content, n * F.log(n.cast("double")))).alias("text_spread"),
        F.sum(F.when(content, n.cast("double") * n)).alias("text_pages"),
        F.sum(F.when(~content, n)).alias("shapes"),
        F.sum(F.when(~content, n * F.log(n.cast("double")))).alias("shape_spread"),
    )
    sizes = once.groupBy("host").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= LEAST_PAGES)
    m = F.log(F.col("m").cast("double"))
    text_importance = 1 - F.col("text_spread") / F.col("texts") / m
    shape_importance = F.when(F.col("shapes") > 0, 1 - F.col("shape_spread") / F.col("shapes") / m).otherwise(0.0)
    branches = (
        paths.where("texts > 0")
        .join(sizes, "host")
        .where(CONTENT_WEIGHT * text_importance + (1 - CONTENT_WEIGHT) * shape_importance < LEAST_IMPORTANCE)
        .where(F.col("text_pages") / F.col("texts") >= SHARE * F.col("m"))
        .select("host", "path", F.lit(None).cast("long").alias("what"))
    )
    texts = each.where(content).join(sizes, "host").where(n >= SHARE * F.col("m")).select("host", "path", "what")
    return branches.unionByName(texts)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = []
            for source, cut in zip(part.column("html"), part.column("cut").to_pylist()):
                gone = {(x["path"], x["what"]) for x in cut or []}
                blocks = Page(source.as_py()).main()
                if gone:
                    blocks = [b for b in blocks if b[2] or ((b[0], None) not in gone and (b[0], _hash(b[1])) not in gone)]
                texts.append("\n\n".join(b[1] for b in blocks))
            keep = [c for c in part.schema.names if c not in ("html", "cut", "host")]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])


def html_extraction(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    The text is the article without menus, headers, footers, sidebars, notices, adverts,
    forms, scripts, styles, markup and comments: blocks joined by two line breaks, white space
    in a block turned into one space, character references decoded. Elements that are
    boilerplate by their kind go first, and within the article containers whose class as a
    whole is a name of boilerplate; outside it a name only puts a branch behind the others, so
    an article within it is found. Of several marked articles the largest is taken. On a page
    without one, those branches go that the host's style tree shows to say little. Null html is
    empty and gives an empty text; so does a page without text. Broken markup is read as far as it goes. A null or relative url belongs to the host
    "". Repeated rows are each returned; further columns are ignored.

    A host may hold a third of all pages: its statistics are counts that combine before the
    shuffle, and what is cut is one row per host, bounded by the styles the host uses.
    """
    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), host_of(F.col(url)).alias("host"))
    cuts = stored(style_tree(named.select("host", "html")).groupBy("host").agg(F.collect_set(F.struct("path", "what")).alias("cut")), "style-cuts")
    schema = StructType([named.schema["page_id"], named.schema["url"]]).add("text", "string")
    return named.join(small_side(cuts, 10_000), "host", "left").mapInArrow(_extract, schema).withColumn("n_chars", F.char_length("text").cast("long"))
