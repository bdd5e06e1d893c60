"""Main text of HTML pages by a site style tree.

All pages of a host are merged into one tree of element nodes (the path of tags and classes from the root). Under each node
stand its presentations (the sequences of child elements that pages show there), its contents (text blocks) and, where
marks speak against it, the words of these. With m pages that show a node:

* the entropy of its l presentations to base l is its presentation importance (to base m it would vanish on large sites);
* content that k of the m pages repeat has importance 1 - log_m(k); where words are known, the mean over them counts if
  it is less, so an advert of recurring words loses although its text is new on every page;
* the composite importance is (1 - DAMPING ** l) times the presentation's plus DAMPING ** l times that of what is below, from
  the block's own element (over its content) to the branch around it.

A branch whose presentation never changes and whose contents repeat is a template; one that each page fills in its own
way is content. So blocks of importance up to ``low`` go and those from ``high`` on stay, and with its blocks a branch.
Marks on the page break ties, which are all other blocks and those of nodes on one page: a tie goes if a class name
speaks against it. They also bound the tree where entropy can't tell: repeated blocks of an ``article`` or ``main`` stay; a
branch that a class name marks stays only if its own presentations vary, not for what is around it (a box within an
article doesn't share that article's variety), and not at all if the name is a noise word or begins with one, since
adverts and teasers vary as much as articles do. Outside articles an id counts as a class name does; inside them it is a
heading's anchor. Names that deny a noise word (no-sidebar, ad-free) don't mark.
What HTML itself names as menu, header, footer, sidebar, notice, advert, form or script, what is hidden, and comment
sections are noise that the tree cannot overrule. An ``article`` inside an element that only class names mark is content
unless it is part of another article.

``restore`` (on): a page of which every block would go is taken for a copy, or for one that its marks misname, and keeps the
blocks that no mark speaks against; if there are none, those that only part of a name speaks against.

Scale: pages are parsed once, within the scan; features are counted per host, node and feature with map-side combining.
Blocks meet the tree as hashes, without their texts; contents that no other page repeats leave before that join. Back to
the pages go only the blocks on which tree and marks differ.

Edge cases: a null or empty page has an empty text. Repeated rows get a row each. A url without a host is a host
of its own. Unclosed and stray tags, unclosed comments and very deep nesting are read in linear time. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import let
from tessella.llm.common import bounded_broadcast, settle, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>|</?[A-Za-z][^<>]*+>",
    re.S,
)
ATTR = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
MARKS = frozenset("class id role style hidden aria-hidden".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
NOISE_TAGS = frozenset(
    "aside audio button canvas dialog footer form iframe map menu nav noscript object select svg template video".split()
)
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising alert announcement banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disclaimer disqus feedback footer form gdpr legal login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification pager pagination popup promo promoted promotion recommended related replies reply respond responses search share "
    "sharing sidebar signup skip skyscraper social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
#: Noise words whose elements hold articles that are noise too.
REPLIES = frozenset("comment comments commentlist disqus replies reply respond responses".split())
CONTENT = frozenset(["article", "main"])
#: Elements that an end tag of an inner kind doesn't reach beyond.
SCOPE = frozenset("article aside body div footer form header html main nav section table td th".split())
LISTS = frozenset(["ul", "ol", "dl"])
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SPACE = re.compile(r"[\W_]+")
#: Words of a class name that deny the noise word after or before them.
DENIES_NEXT, DENIES_LAST = frozenset("hide no not without".split()), frozenset(["free", "less"])
#: Marks: within articles, none, a noise word in a class name, a class name that is or begins with one.
ARTICLE, PLAIN, PART, WHOLE = 1, 0, -1, -2
#: Importance up to which a block goes and from which it stays; what each presentation of a node leaves to what is below it;
#: importance that presentations alone must make up to overrule a mark.
LOW, HIGH, DAMPING, VARIED = 0.3, 0.6, 0.9, 0.4
#: Pages with such blocks up to which they are broadcast.
BROADCAST = 200_000


def _hash(*parts: object) -> int:
    value = xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "replace"))
    return value - (1 << 64) if value >> 63 else value


class _Element:
    """An open element: its tag, node, presentation so far, and what it makes of its text."""

    __slots__ = ("tag", "node", "style", "noise", "mark", "branch", "replies", "frame")

    def __init__(self, tag: str, node: int, noise: bool, mark: int, branch: int, replies: bool, frame: bool) -> None:
        self.tag, self.node, self.noise, self.mark, self.replies, self.frame = tag, node, noise, mark, replies, frame
        #: The node that the mark is of, 0 without one.
        self.branch = branch
        self.style = 0


def name_mark(name: str) -> int:
    """PLAIN, PART or WHOLE for a class name or id."""
    parts = [w for w in SPACE.split(name) if w]
    found = PLAIN
    for i, w in enumerate(parts):
        if w in NOISE_WORDS and (i == 0 or parts[i - 1] not in DENIES_NEXT) and (i + 1 == len(parts) or parts[i + 1] not in DENIES_LAST):
            found = min(found, WHOLE if i == 0 else PART)
    return found


class _Page:
    """Blocks of a page: (text, node, node around it or 0, mark)."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[str, int, int, int]] = []
        self.styles: set[tuple[int, int]] = set()
        self.text: list[str] = []
        self.open = [_Element("", 0, False, PLAIN, 0, False, True)]
        self.count: Counter[str] = Counter()
        self.noise = 0
        self.read(source)
        while len(self.open) > 1:
            self.pop()
        self.flush()
        self.styles.add((0, self.open[0].style))

    def flush(self) -> None:
        if self.text:
            block = " ".join(html.unescape("".join(self.text)).split())
            self.text = []
            if block:
                own = self.open[-1]
                around = self.open[-2] if len(self.open) > 1 else own
                outer = own.branch if own.branch else 0 if around.frame else around.node
                self.blocks.append((block, own.node, outer if outer != own.node else 0, own.mark))

    def write(self, text: str) -> None:
        if not self.noise:
            self.text.append(text)

    def pop(self) -> None:
        e = self.open[-1]
        if e.tag not in INLINE:
            self.flush()
        self.open.pop()
        self.count[e.tag] -= 1
        if not self.noise:
            self.styles.add((e.node, e.style))
        self.noise -= e.noise

    def close(self, tag: str, scope: frozenset[str]) -> None:
        """Pop up to the innermost open ``tag`` unless an element of ``scope`` stands before it."""
        if self.count[tag] <= 0:
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                while len(self.open) > at:
                    self.pop()
                return
            if self.open[at].tag in scope:
                return

    def start(self, tag: str, attrs: str) -> None:
        names: list[str] = []
        noise, kinds = tag in NOISE_TAGS, ""
        within = self.count["article"] > 0
        if attrs:
            for name, *values in ATTR.findall(attrs):
                if (name := name.lower()) not in MARKS:
                    continue
                value = next((v for v in values if v), "").lower()
                if name == "class":
                    names += value.split()
                    kinds += "." + value
                elif name == "id":
                    names += value.split() if not within else []
                elif name == "role":
                    noise |= value in NOISE_ROLES
                elif name == "style":
                    noise |= "display:none" in value.replace(" ", "")
                elif name == "hidden" or value == "true":
                    noise = True
        words = {w for n in names for w in SPACE.split(n)}
        named = min(map(name_mark, names), default=PLAIN)
        frame = tag in ("html", "body")
        article = tag in CONTENT and not {"comment", "comments", "reply", "ad"} & words
        if frame or article:
            noise = False
        noise |= tag == "header" and self.count["article"] + self.count["main"] <= 0
        marked = not frame and not article and named < PLAIN
        if tag in INLINE and not noise and not marked:
            return
        if tag not in INLINE:
            self.flush()
            self.close("p", SCOPE)
            for sibling in CLOSES.get(tag, ()):
                self.close(sibling, SCOPE - {"td", "th"} | LISTS)
            if tag in CONTENT:
                for at, x in enumerate(self.open):
                    if x.noise and x.tag in ("nav", "header", "form", "noscript"):  # left open
                        while len(self.open) > at:
                            self.pop()
                        break
        parent = self.open[-1]
        signature = tag + kinds
        parent.style = _hash(parent.style, signature)
        node = _hash(parent.node, signature)
        mark, branch, replies = parent.mark, parent.branch, parent.replies
        if marked:
            if named < mark:
                mark, branch = named, node
            replies |= within or tag in CONTENT or not REPLIES.isdisjoint(words)
            noise |= not REPLIES.isdisjoint(names)
        elif article and not replies:
            mark, branch = ARTICLE, 0
        self.open.append(_Element(tag, node, noise, mark, branch, replies, frame))
        self.count[tag] += 1
        self.noise += noise

    def read(self, source: str) -> None:
        at = 0
        while m := TOKEN.search(source, at):
            if m.start() > at:
                self.write(source[at : m.start()])
            at = m.end()
            if not (tag := m["tag"]):
                if m[0].startswith("<![CDATA["):
                    self.write(html.escape(m[0][9:].removesuffix("]]>")))
                continue
            tag = tag.lower()
            if m["end"]:
                if tag == "br":
                    self.write(" ")
                elif tag not in INLINE:
                    self.flush()
                    self.close(tag, frozenset() if tag in SCOPE else SCOPE - {"td", "th"} if tag in CLOSES else SCOPE)
                else:
                    self.close(tag, SCOPE)
            elif tag in RAW:
                if end := re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(source, at):
                    at = end.end()
                else:
                    at = len(source)
            elif tag in VOID:
                if tag == "hr":
                    self.flush()
                else:
                    self.write(" " if tag in ("br", "img") else "")
            else:
                self.start(tag, m["attrs"])
        if at < len(source):
            self.write(source[at:])


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", url or "", re.I)
    return m[1].lower() if m else url or ""


PART_KIND = pa.struct([("text", pa.string()), ("node", pa.int64()), ("around", pa.int64()), ("block", pa.int64()), ("mark", pa.int32()), ("words", pa.list_(pa.int64()))])
FEATURE_KIND = pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("feature", pa.int64())])
PARSED = "host string, parts array<struct<text:string,node:long,around:long,block:long,mark:int,words:array<long>>>, features array<struct<node:long,kind:int,feature:long>>"
#: Kinds of features: the node is there, a presentation of it, a content, a word of marked contents.
THERE, PRESENTATION, CONTENTS, WORD = range(4)


def _words(text: str) -> list[int]:
    return [_hash(w) for w in sorted({w for w in SPACE.split(text.lower()) if w})]


def _parse_page(source: str | None) -> tuple[list[dict], list[dict]]:
    page = _Page(source or "")
    parts = [{"text": t, "node": n, "around": a, "block": _hash(t), "mark": p, "words": _words(t) if p < PLAIN else None} for t, n, a, p in page.blocks]
    seen = {p[k] for p in parts for k in ("node", "around")}
    found = dict.fromkeys((n, THERE, 0) for n in seen) | dict.fromkeys((n, PRESENTATION, s) for n, s in page.styles if n in seen)
    found |= dict.fromkeys((p["node"], CONTENTS, p["block"]) for p in parts) | dict.fromkeys((p["node"], WORD, w) for p in parts for w in p["words"] or ())
    return parts, [{"node": n, "kind": k, "feature": f} for n, k, f in found]


def parse(pages: DataFrame) -> DataFrame:
    """page_id, url and key of each page, its host, its blocks that nothing rules out, and the features of their nodes."""
    keyed = pages.select("page_id", "url", F.xxhash64("page_id", "url", "html").alias("key"), "html")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, key long, " + PARSED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                found = [_parse_page(h) for h in b.column(3).to_pylist()]
                hosts = pa.array([host_of(u) for u in b.column(1).to_pylist()], pa.string())
                columns = [*b.columns[:3], hosts, pa.array([p for p, _ in found], pa.list_(PART_KIND)), pa.array([f for _, f in found], pa.list_(FEATURE_KIND))]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "key", "host", "parts", "features"])

    return keyed.mapInArrow(run, schema)


def tree(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hosts' trees, as far as two pages or more show them: nodes (host, node, m, presentation, weight) and contents and
    words (host, node, kind, feature, n). ``weight`` is the share of the presentation in the node's importance."""
    counts = settle(features.groupBy("host", "node", "kind", "feature").agg(F.count("*").alias("n")), "page-features")
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0))
    nodes = counts.filter(F.col("kind") <= PRESENTATION).groupBy("host", "node").agg(
        of(THERE, F.col("n")).alias("m"), of(PRESENTATION, F.col("n")).alias("shown"),
        of(PRESENTATION, F.col("n") * F.log("n")).alias("weighted"), of(PRESENTATION, F.lit(1)).alias("ways"),
    )
    entropy = F.least((F.log("shown") - F.col("weighted") / F.col("shown")) / F.log("ways"), F.lit(1.0))
    presentation = F.when(F.col("ways") > 1, entropy).otherwise(0.0)
    several = nodes.filter("m > 1").select("host", "node", "m", presentation.alias("presentation"), (1 - F.pow(F.lit(DAMPING), "ways")).alias("weight"))
    return several, counts.filter((F.col("kind") > PRESENTATION) & (F.col("n") > 1)).select("host", "node", "kind", "feature", "n")


def importance(parsed: DataFrame) -> DataFrame:
    """Rows (key, node, around, block, mark, importance, varied) of the blocks whose node several pages of the host show.

    ``varied`` is what presentations make up of the importance."""
    nodes, shared = tree(parsed.select("host", F.explode("features").alias("f")).select("host", "f.*"))
    blocks = parsed.select("key", "host", F.explode("parts").alias("p")).select("key", "host", "p.*").drop("text")
    place = ["key", "host", "node", "around", "block", "mark"]
    outer = nodes.select("host", F.col("node").alias("around"), (F.col("presentation") * F.col("weight")).alias("outer"), F.col("weight").alias("outer_weight"))
    words = blocks.filter("words is not null").select("key", "host", "node", "block", F.explode("words").alias("feature")).distinct()
    words = words.join(shared.filter(F.col("kind") == WORD).drop("kind"), ["host", "node", "feature"], "left")
    words = words.groupBy("key", "node", "block").agg(F.avg(F.log(F.coalesce("n", F.lit(1)))).alias("word_log"))
    contents = shared.filter(F.col("kind") == CONTENTS).select("host", "node", F.col("feature").alias("block"), "n")
    known = (
        blocks.select(*place)
        .join(nodes, ["host", "node"])
        .join(outer.filter("around <> 0"), ["host", "around"], "left")
        .join(contents, ["host", "node", "block"], "left")
    )
    marked = known.filter(F.col("mark") < PLAIN).join(words, ["key", "node", "block"], "left")
    every = known.filter(F.col("mark") >= PLAIN).withColumn("word_log", F.lit(None).cast("double")).unionByName(marked)
    repeated = F.greatest(F.log(F.coalesce("n", F.lit(1))), F.coalesce("word_log", F.lit(0.0)))
    content = 1 - repeated / F.log("m")
    inner = F.col("presentation") * F.col("weight")
    own = inner + (1 - F.col("weight")) * content
    whole = F.coalesce(F.col("outer") + (1 - F.col("outer_weight")) * own, own)
    return every.select("key", "node", "around", "block", "mark", whole.alias("importance"), F.greatest(inner, F.coalesce("outer", F.lit(0.0))).alias("varied"))


def verdict(mark: Column, importance: Column, varied: Column, low: float, high: float) -> Column:
    """Whether the tree keeps a block: NULL if it leaves that to the marks."""
    stays = ((mark >= PLAIN) & (importance >= high)) | ((mark == PART) & (varied >= VARIED))
    return F.when((importance <= low) & (mark < ARTICLE), False).when(stays, True)


def main_text(pages: DataFrame, low: float = LOW, high: float = HIGH, restore: bool = True) -> DataFrame:
    """page_id, url and text of each page (columns page_id, url, html)."""
    parsed = settle(parse(pages), "page-blocks")
    # Only blocks of which the tree thinks otherwise than the marks are brought back to their pages.
    turned = importance(parsed).filter(verdict(F.col("mark"), F.col("importance"), F.col("varied"), low, high) != (F.col("mark") >= PLAIN))
    place = lambda p: F.struct(*[p(c).alias(c) for c in ("node", "around", "block", "mark")])
    turned = settle(turned.groupBy(F.col("key").alias("turned_key")).agg(F.collect_set(place(F.col)).alias("turned")), "page-turned")
    joined = lambda parts: F.array_join(F.transform(parts, lambda p: p["text"]), "\n")
    from_mark = lambda least: F.filter("parts", lambda p: p["mark"] >= least)
    other = lambda p: F.coalesce(F.array_contains("turned", place(lambda c: p[c])), F.lit(False))
    kept = F.filter("parts", lambda p: (p["mark"] >= PLAIN) != other(p))
    restored = let(from_mark(PLAIN), lambda k: F.when(F.size(k) > 0, joined(k)).otherwise(joined(from_mark(PART))))
    text = let(kept, lambda k: F.when((F.size(k) > 0) | F.lit(not restore), joined(k)).otherwise(restored))
    pages_of = parsed.join(bounded_broadcast(turned, BROADCAST), F.col("key") == F.col("turned_key"), "left")
    return pages_of.select("page_id", "url", text.alias("text"))


def op1_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
