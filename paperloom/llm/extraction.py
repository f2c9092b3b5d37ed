"""HTML main-text extraction with a site style tree.

The pages of a host are merged into one tree: a node is a path of tags and
classes from the root, known by a 64-bit key. A first pass over the pages writes
digests of each node, no text: the sequence of its children (its presentation)
and its own text (its content). Spark counts on how many different pages each is
seen, and from that come two entropies of a node, both 0 to 1:

- content: 1 - sum(k ln k) / (n ln m), for contents that are on k of the m pages
  that have the node, n contents in all: 0 if all pages say the same, 1 if each
  says something of its own;
- presentation: the entropy of the sequences of children over the m pages, in
  units of ln m: 0 if the node looks the same on each page.

The importance of a block of text is the importance of its content times that of
its presentation. Names (tags, classes) are a prior of presentation: within a
branch that says it is an article it is 1, within one that says it is noise 0.25,
else 0.5 and half of the greatest presentation entropy of the nodes above. Both
entropies are drawn to what is assumed without pages by PRIOR_PAGES pages. A
branch that looks like noise but holds most of a page's text, or an article, is
left to the entropies, but for readers' comments, which are noise wherever there
is other text of note. A content that most pages of a node share has a low
content entropy of its own. A second pass cuts the branches of low importance.

What the second pass needs are the entropies of nodes that two pages or more
have: MOST_TOLD of them at most are broadcast; more of them go to the pages by
host, with SALTS salts, so that a large host is many tasks.

Defined results: null or empty html gives an empty text. Broken markup (tags or
quotes left open, a page cut off) is read as far as it goes. Pages of any length
are read whole; repeated rows are each extracted on their own, and copies of a
page on a host count once in the tree. A url without a host counts as a host of
its own. A page whose blocks are all of low importance keeps those that no name
calls noise. No rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import materialize, table

#: Elements whose text is never content (raw ones hold no markup), those that end a block, those without an end tag.
RAW = {"script", "style", "textarea", "title"}
SKIPPED = RAW | {"noscript", "template", "svg", "iframe", "object", "select", "button"}
NOISE_TAGS = {"nav", "footer", "header", "aside", "form", "menu", "dialog"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Words of class, id and role that say that a branch is no content.
NOISE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|comments?|disqus|respond|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|cookies?|consent|gdpr|notice|notification|newsletter|subscribe|signup|login|popup|modal|share|sharing|social|related|recommended|widget|toolbar|pagination|pager|search|skip-link)(?:$|[\s_-])"
)
#: Classes and ids of readers' comments, whose branch is noise however much they say.
COMMENTS = re.compile(
    r"(?:^|\s)(?!(?:has|no|with|allow|open)[_-])(?:[\w-]*[_-])?(?:comments?|commentlist|disqus\w*|respond|replies)(?:[_-](?:list|area|section|thread|body|content|wrapper|container|box|block|form|text|\d+))*(?=$|\s)"
)
#: Characters outside of comments that are enough to be what the page is about.
OF_NOTE = 80
#: A quoted value that holds what looks like a tag is a quote that was left open: then the tag ends at the next >.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?:(?P<attrs>(?:[^\"'>]++|\"(?:[^\"<]|<(?![a-zA-Z/]))*+\"|'(?:[^'<]|<(?![a-zA-Z/]))*+')*+)>|(?P<open>[^>]*)(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
UNSEEN = re.compile(r"(?:^|\s)hidden(?=[\s/=]|$)", re.I)
#: What ends an element that is skipped, and whose end tag was left out: none of these is within one.
SURE_BLOCK = r"<(?:article|main|section|nav|footer|header|aside|body|h[1-6]|p|table|ul|ol|form)[\s>]"

#: Pages at which what is seen counts as much as what is assumed; importance below which a branch is cut.
PRIOR_PAGES = 4.0
LEAST_IMPORTANCE = 0.3
#: On a page that marks its article, the importance below which a branch beside it is cut.
LEAST_BESIDE = 0.6
PLAIN, NOISE, CONTENT, COMMENT = 0, 1, 2, 3
#: Pages of a node from which on a content that most of them share is looked up by itself.
LEAST_SHARED = 8
NOISE_FACTOR, PLAIN_FACTOR = 0.25, 0.5
#: Nodes whose entropies are broadcast at most (16 bytes each); copies of the entropies of a host beyond.
MOST_TOLD = 250_000
SALTS = 32

#: Keys of nodes by (key above, label), in a Python worker.
_keys: dict[tuple[int, str], int] = {}


def _hash(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def node_key(above: int, label: str) -> int:
    """The 64-bit key of a node below another; the root of a host is a node below 0 whose label is the host."""
    key = _keys.get((above, label))
    if key is None:
        if len(_keys) > 20_000:
            _keys.clear()
        _keys[above, label] = key = _hash(above.to_bytes(8, "little", signed=True) + label.encode("utf-8", "surrogatepass"))
    return key


def _style(tag: str, attrs: str) -> tuple[str, int]:
    """The label of a node in the style tree, and what its names say."""
    said = " ".join([(a or b or c).lower() for _, a, b, c in ATTRIBUTE.findall(attrs)]) if "=" in attrs else ""
    label = tag + ("." + ".".join(sorted(re.sub(r"\d+", "0", said).split())) if said else "")
    if tag not in ("html", "body"):
        if said and COMMENTS.search(said):
            return label, COMMENT
        if tag in NOISE_TAGS or said and NOISE_NAMES.search(said) or _unseen(attrs):
            return label, NOISE
    return label, CONTENT if tag in ("article", "main") or said and "article" in said.split() else PLAIN


def _unseen(attrs: str) -> bool:
    """Whether an element's attributes say that it is not shown."""
    return "display" in attrs and re.search(r"display\s*:\s*none", attrs, re.I) is not None or "hidden" in attrs.lower() and UNSEEN.search(QUOTED.sub("", attrs)) is not None


def content_key(node: int, value: int) -> int:
    """What a content of a node is known by among the entropies."""
    return _hash(node.to_bytes(8, "little", signed=True) + value.to_bytes(8, "little", signed=True))


@dataclass
class Page:
    """The tree of a page. Of a node: its key, the node above, what its names say, whether an article is in it, its children's labels."""

    key: list[int]
    above: list[int] = field(default_factory=lambda: [-1])
    says: list[int] = field(default_factory=lambda: [PLAIN])
    holds: list[bool] = field(default_factory=lambda: [False])
    children: list[list[str]] = field(default_factory=lambda: [[]])
    counts: list[bool] = field(default_factory=lambda: [False])  # html and body look alike for all that is on a page
    blocks: list[tuple[int, str]] = field(default_factory=list)  # node, text; in page order

    def add(self, above: int, tag: str, label: str, says: int) -> int:
        i = len(self.key)
        self.children[above].append(label)
        for column, value in zip((self.key, self.above, self.says, self.holds, self.children, self.counts), (node_key(self.key[above], label), above, says, False, [], tag not in ("html", "body"))):
            column.append(value)
        if tag in ("article", "main"):
            while i >= 0 and not self.holds[i]:
                self.holds[i], i = True, self.above[i]
        return len(self.key) - 1

    def settled(self) -> list[int]:
        """PLAIN, NOISE or CONTENT for each node. One that looks like noise but holds most of the page's text, or an article, is plain.

        Comments are noise even then, unless there is no text of note besides.
        """
        size, noisy = [0] * len(self.key), [False] * len(self.key)
        for i in range(1, len(size)):
            noisy[i] = noisy[self.above[i]] or self.says[i] in (NOISE, COMMENT)
        for i, said in self.blocks:
            size[i] += len(said)
        free = sum(n for n, x in zip(size, noisy) if not x)
        for i in range(len(size) - 1, 0, -1):
            size[self.above[i]] += size[i]
        out, opened = [PLAIN], [True]  # within a branch that is not opened, an article is as likely a teaser
        for i in range(1, len(size)):
            above, says, most = self.above[i], self.says[i], 2 * size[i] > size[0]
            if says == COMMENT and (free >= OF_NOTE or out[above] == NOISE):
                out.append(NOISE)
                opened.append(False)
            elif says in (NOISE, COMMENT):
                out.append(PLAIN if (most or self.holds[i]) and out[above] != NOISE else NOISE)
                opened.append(opened[above] and most)
            else:
                out.append(says if says == CONTENT and out[above] == PLAIN and opened[above] else out[above])
                opened.append(opened[above])
        return out


def parse_page(page: str | None, host: str = "") -> Page:
    page = page or ""
    tree = Page([node_key(0, host)])
    stack: list[tuple[str, int]] = []  # tag, node
    places: dict[str, list[int]] = {}  # of a tag in the stack
    open_blocks: list[int] = []  # places of blocks in the stack
    ends: dict[str, re.Match | None] = {}  # the next end tag of an element that is skipped

    def push(tag: str, node: int) -> None:
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            open_blocks.append(len(stack))
        stack.append((tag, node))

    def cut(to: int) -> None:
        while len(stack) > to:
            tag, _ = stack.pop()
            places[tag].pop()
            if tag in BLOCKS:
                open_blocks.pop()

    def end_of(tag: str, after: int) -> re.Match | None:
        if tag not in ends or ends[tag] is not None and ends[tag].start() < after:
            ends[tag] = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, after)
        return ends[tag]

    text: list[str] = []

    def flush() -> None:
        if text:
            said = " ".join("".join(text).split())
            text.clear()
            if said:
                at = stack[-1][1] if stack else 0
                tree.children[at].append("#")
                tree.blocks.append((at, said))

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            said = page[at : m.start()]
            text.append(entities.unescape(said) if "&" in said else said)
        at = m.end()
        tag = m["tag"]
        if not tag:
            if m["cdata"]:
                text.append(m["cdata"])
            continue
        tag, attrs = tag.lower(), m["attrs"] if m["attrs"] is not None else m["open"]
        if tag in SKIPPED:
            if not m["end"] and not attrs.rstrip().endswith("/"):
                end = end_of(tag, at)
                if end and tag in ("button", "select") and (sure := re.compile(SURE_BLOCK, re.I).search(page, at, end.start())):
                    at = sure.start()
                elif end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = len(page)
            continue
        if tag == "br":
            text.append(" ")
        elif m["end"]:
            if tag in BLOCKS:
                flush()
            if places.get(tag) and (tag in BLOCKS or not open_blocks or open_blocks[-1] < places[tag][-1]):
                cut(places[tag][-1])
        else:
            if tag in BLOCKS:
                flush()
                # A paragraph, or an item, ends where the next begins; inline elements left open end with it.
                while stack and (stack[-1][0] not in BLOCKS or stack[-1][0] == "p" or stack[-1][0] == tag in ("li", "dt", "dd", "tr", "td", "th")):
                    cut(len(stack) - 1)
            if tag not in VOID and not attrs.rstrip().endswith("/"):
                label, says = _style(tag, attrs)
                above = stack[-1][1] if stack else 0
                push(tag, tree.add(above, tag, label, says) if tag in BLOCKS or says != PLAIN else above)
    if at < len(page):
        text.append(entities.unescape(page[at:]))
    flush()
    return tree


def digests(tree: Page) -> list[tuple[int, int, int]]:
    """(node, kind, value) of a page: kind 0 is how a node looks (all its places on the page together), kind 1 a content."""
    looks: dict[int, list[str]] = {}
    for key, children in zip(tree.key, tree.children):
        looks.setdefault(key, []).append(">".join(children))
    out = [(key, 0, _hash("|".join(x).encode("utf-8", "surrogatepass"))) for key, x in looks.items()]
    return out + list(dict.fromkeys([(tree.key[i], 1, _hash(said.encode("utf-8", "surrogatepass"))) for i, said in tree.blocks]))


class Entropies:
    """content and presentation entropy of nodes, looked up by key; without pages to tell, 1 and 0."""

    def __init__(self, node: np.ndarray, content: np.ndarray, look: np.ndarray):
        by = np.argsort(node)
        self.node, self.content, self.look = node[by], content[by].astype(np.float32), look[by].astype(np.float32)

    def of(self, keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        asked = np.array(keys, np.int64)
        if not len(self.node):
            return np.ones(len(asked)), np.zeros(len(asked))
        at = np.minimum(np.searchsorted(self.node, asked), len(self.node) - 1)
        known = self.node[at] == asked
        return np.where(known, self.content[at], 1.0), np.where(known, self.look[at], 0.0)


def importance(tree: Page, entropies: Entropies) -> tuple[list[int], list[float]]:
    """For each block what its branch is settled to be, and its importance."""
    settled = tree.settled()
    content, look = entropies.of(tree.key)
    above = [0.0]
    for i in range(1, len(tree.key)):
        own = float(look[i]) if tree.counts[i] else 0.0
        above.append(max(own, above[tree.above[i]]))
    factor = {NOISE: lambda i: NOISE_FACTOR, PLAIN: lambda i: PLAIN_FACTOR + (1 - PLAIN_FACTOR) * above[i], CONTENT: lambda i: 1.0}
    # What most pages say in the same place counts by itself, also beside texts that are each page's own.
    own, _ = entropies.of([content_key(tree.key[i], _hash(said.encode("utf-8", "surrogatepass"))) for i, said in tree.blocks])
    return [settled[i] for i, _ in tree.blocks], [min(float(content[i]), float(c)) * factor[settled[i]](i) for (i, _), c in zip(tree.blocks, own)]


def kept_blocks(tree: Page, entropies: Entropies) -> list[str]:
    """The texts of the blocks that are not cut, in page order."""
    kinds, weights = importance(tree, entropies)
    size = lambda chosen: sum(len(tree.blocks[b][1]) for b in chosen)
    article = [b for b, k in enumerate(kinds) if k == CONTENT]
    high = [b for b in article if weights[b] >= LEAST_IMPORTANCE]
    if 2 * size(high) < size(article):  # the text of an article may be on many pages
        high = article
    plain = [b for b, k in enumerate(kinds) if k == PLAIN]
    beside = [b for b in plain if weights[b] >= LEAST_IMPORTANCE]
    # An article is a strong prior: beside it a branch must say more, unless that is more text than the article.
    if article and size(article) >= size(beside):
        beside = [b for b in plain if weights[b] >= LEAST_BESIDE]
    chosen = sorted(high + beside) or plain
    return [tree.blocks[b][1] for b in chosen]


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit(""))), url, F.lit(""))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (host, page, html) to the digests (host, page, node, kind, value)."""
    names = ("host", "page", "node", "kind", "value")
    for batch in batches:
        rows: list[tuple] = []
        for host, page, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            tree = parse_page(said.as_py(), host)
            rows += [(tree.key[0], page, *d) for d in digests(tree)]
        yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.int32() if n == "kind" else pa.int64()) for i, n in enumerate(names)})


def node_contents(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, node, kind, value, k): on how many different pages of a host a node looks like this (kind 0), or says this (kind 1).

    The keys of all groups hold a digest, so a large host is spread over tasks. Written, since it is read more than once
    and pages are not to be parsed anew.
    """
    told = pages.select(host_of(F.col(url)).alias("host"), F.xxhash64(F.col(html)).alias("page"), F.col(html).alias("html"))
    once = told.mapInArrow(_described, "host long, page long, node long, kind int, value long").distinct()
    return materialize(once.groupBy("host", "node", "kind", "value").agg(F.count("*").alias("k")), "contents")


def _drawn(x: Column, to: float) -> Column:
    return (F.col("m") * F.greatest(F.lit(0.0), x) + PRIOR_PAGES * to) / (F.col("m") + PRIOR_PAGES)


def _counted(values: DataFrame) -> DataFrame:
    """(host, node, m, n, kl0, kl1) of each node that two different pages of a host or more have: a row for each node and task is shuffled."""
    kl = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("k") * F.log(F.col("k").cast("double")))).alias(f"kl{kind}")
    return values.groupBy("host", "node").agg(F.sum(F.when(F.col("kind") == 0, F.col("k"))).alias("m"), F.sum(F.when(F.col("kind") == 1, F.col("k"))).alias("n"), kl(0), kl(1)).where("m > 1")


def _nodes(values: DataFrame) -> DataFrame:
    content = F.when(F.col("n") > 0, 1 - F.col("kl1") / (F.col("n") * F.log(F.col("m").cast("double")))).otherwise(1.0)
    look = 1 - F.col("kl0") / (F.col("m") * F.log(F.col("m").cast("double")))
    return _counted(values).select("host", "node", F.col("m").alias("pages"), _drawn(content, 1).alias("content"), _drawn(look, 0).alias("look"))


def style_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, node, pages, content, look): the entropies of each node that two different pages of a host or more have."""
    return _nodes(node_contents(pages, url, html))


def shared_contents(values: DataFrame) -> DataFrame:
    """As rows of ``style_tree``, by ``content_key``: the contents that most pages of a node share; fewer than twice a node's blocks a page."""
    large = _counted(values.where(f"kind = 0 or k >= {LEAST_SHARED} / 2")).where(f"m >= {LEAST_SHARED}").select("host", "node", "m")
    often = values.where(f"kind = 1 and k >= {LEAST_SHARED} / 2").join(large, ["host", "node"]).where("2 * k > m")
    key = F.udf(content_key, "long")
    content = 1 - F.log(F.col("k").cast("double")) / F.log(F.col("m").cast("double"))
    return often.select("host", key("node", "value").alias("node"), F.col("m").alias("pages"), _drawn(content, 1).alias("content"), F.lit(0.0).alias("look"))


def _texts(batch: pa.RecordBatch, host: int, html: int, entropies: Entropies) -> tuple[list[str], list[int]]:
    out, cut = [], []
    for name, said in zip(batch.column(host).to_pylist(), batch.column(html)):
        tree = parse_page(said.as_py(), name)
        kept = kept_blocks(tree, entropies)
        out.append("\n".join(kept))
        cut.append(len(tree.blocks) - len(kept))
    return out, cut


def extract_main_text(pages: DataFrame, ident: str = "page_id", url: str = "url", html: str = "html", most_told: int = MOST_TOLD) -> DataFrame:
    """(page_id, url, host, text, n_cut): the main text of each page, and how many blocks were cut."""
    spark = pages.sparkSession
    values = node_contents(pages, url, html)
    tree = materialize(_nodes(values).unionByName(shared_contents(values)), "style-tree")
    rows = pages.select(F.col(ident).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    schema = f"page_id {dict(rows.dtypes)['page_id']}, url string, host string, text string, n_cut int"
    given = lambda some, texts, cut: pa.RecordBatch.from_arrays([*(some.column(i) for i in range(3)), pa.array(texts, pa.string()), pa.array(cut, pa.int32())], names=["page_id", "url", "host", "text", "n_cut"])

    if tree.count() <= most_told:
        pdf = tree.select("node", "content", "look").toPandas()
        shared = spark.sparkContext.broadcast(Entropies(pdf["node"].to_numpy(np.int64), pdf["content"].to_numpy(float), pdf["look"].to_numpy(float)))

        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield given(batch, *_texts(batch, 2, 3, shared.value))

        return rows.mapInArrow(extract, schema)

    @F.udf("long")
    def root(host):  # noqa: ANN001, ANN202
        return node_key(0, host)

    # Entropies of a host come first, then its pages; a host is cut by salts.
    hosts = rows.withColumn("at", root("host")).withColumn("salt", F.pmod(F.xxhash64("html", "page_id", "url"), F.lit(SALTS)).cast("int"))
    told = tree.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(F.col("host").alias("at"), "salt", "node", "content", "look")
    met = hosts.unionByName(told, allowMissingColumns=True).repartition("at", "salt").sortWithinPartitions("at", "salt", F.col("node").asc_nulls_last())
    met = met.select("page_id", "url", "host", "html", "at", "salt", "node", "content", "look")

    def extract_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, entropies = None, [], None
        for batch in batches:
            at, node = [tuple(x) for x in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], batch.column(6).to_pylist()
            content, look = batch.column(7).to_pylist(), batch.column(8).to_pylist()
            first = 0
            while first < len(at):
                last = first
                while last < len(at) and at[last] == at[first] and (node[last] is None) == (node[first] is None):
                    last += 1
                if at[first] != place:
                    place, held, entropies = at[first], [], None
                if node[first] is not None:
                    held += zip(node[first:last], content[first:last], look[first:last])
                else:
                    if entropies is None:
                        known = np.array(held, [("node", np.int64), ("content", float), ("look", float)])
                        entropies = Entropies(known["node"], known["content"], known["look"])
                    some = batch.slice(first, last - first)
                    yield given(some, *_texts(some, 2, 3, entropies))
                first = last

    return met.mapInArrow(extract_sorted, schema)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op4_html_extraction": op4_html_extraction}
ORACLES: dict[str, str] = {}
