from tessella.llm.op1_style_tree import host_of, main_text, parse
from pyspark.sql import functions as F
from collections import Counter
from html.parser import HTMLParser

KIND = "page_id long, url string, html string"


def read(spark, rows, **kw):
    frame = spark.createDataFrame([(i, f"http://{h}/p{i}", t) for i, (h, t) in enumerate(rows)], KIND)
    return {r["page_id"]: r["text"] for r in main_text(frame, **kw).collect()}


def test_presentation(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar">
    <header><h1>Site</h1></header><nav><a href=x>Menu</a></nav><div class="ad-box ad">Buy</div><div id=cookie>Notice</div><!-- <p>no</p> -->
    <article class="post"><header><h1>Title &amp; more</h1></header><p><b>First&nbsp;line<br>second  line<p>Next &#x41;<ul><li>a<li>b</ul>
    <form><p>Sign up</p></form><div class="comments"><p>Reader says</p></div><table><tr><td>c1<td>c2</table><p hidden>h</p><p style="display: none">n</p>
    tail</article><aside>Side</aside><section class="comments"><article class="comment"><p>More readers</p></article></section>
    <footer>&copy; foot</footer></body></html>"""
    got = read(spark, [("a", page), ("a", None), ("a", ""), ("a", "plain < text &lt;b&gt;"), ("a", "<p>one<script>x"), ("a", "<p>one<!-- x"), ("a", "<b>" * 50_000 + "deep" + "<div>" * 3000 + "er")])
    assert got[0] == "Title & more\nFirst line second line\nNext A\na\nb\nc1\nc2\ntail"
    assert got[1] == got[2] == ""
    assert got[3] == "plain < text <b>"
    assert got[4] == got[5] == "one"
    assert got[6] == "deep\ner"


def plain_importance(pages, node_of):
    """Entropies by hand for pages given as lists of (node, block)."""
    import math

    m = {n: sum(any(b[0] == n for b in p) for p in pages) for p in pages for n, _ in p}
    k = {b: sum(b in p for p in pages) for p in pages for b in p}
    return {b: 0.9 * (1 - math.log(k[b]) / math.log(m[b[0]])) for b in k}


def test_style_tree_prunes_repeated_branches(spark):
    pages = [f"<div class=top><p>Welcome to us</p><p>Since {i % 2} years</p></div><div class=text><p>Story number {i} is long</p><p>It ends {i}</p></div>" for i in range(40)]
    got = read(spark, [("h", p) for p in pages] + [("other", pages[0]), ("h", pages[3])])
    want = plain_importance([[("top", "Welcome"), ("top", f"Since {i % 2}"), ("text", i)] for i in range(40)], None)
    assert want["top", "Welcome"] < 0.3 and want["top", "Since 0"] < 0.3 and want["text", 1] > 0.3
    assert all(got[i] == f"Story number {i} is long\nIt ends {i}" for i in range(40))
    assert got[40] == "Welcome to us\nSince 0 years\nStory number 0 is long\nIt ends 0"
    assert got[41] == got[3]


def test_articles_and_copies_stay(spark):
    same = "<article><p>One article on every page</p></article>"
    got = read(spark, [("h", same)] * 30 + [("g", "<div><p>copied page</p></div>")] * 30)
    assert set(got.values()) == {"One article on every page", "copied page"}


def test_keys(spark):
    assert host_of("https://u@Ab.c:80/x") == "ab.c:80" and host_of(None) == "" and host_of("x") == "x"
    empty = spark.createDataFrame([], KIND)
    assert main_text(empty).collect() == []
    rows = spark.createDataFrame([(None, None, "<p>a</p>")] * 2, KIND).withColumn("host", F.lit("x")).withColumn("parts", F.lit(1))
    assert [tuple(r) for r in main_text(rows).collect()] == [(None, None, "a")] * 2
    assert parse(rows).count() == 2


def test_values_are_no_attributes(spark):
    page = """<article><p title="the hidden cost" data-x='a hidden b'>Words <a href="/hidden-gems">of</a> <a href=/wiki/hidden>this</a> <a alt=' class="ad" '>page</a>
    <i data-hidden>stay</i></p><p hidden>no</p><p class=x hidden="">no</p><p HIDDEN=hidden>no</p><p aria-hidden = "true">no</p></article>"""
    assert read(spark, [("a", page)])[0] == "Words of this page stay"


def test_articles_in_wrappers_stay(spark):
    post = "<article><p>Story</p><div class=related><article>Teaser</article></div><div class=share>Send</div></article>"
    wrappers = ['<div class="layout has-sidebar">', "<div id=content-share>", "<div class=ad-free><div class='widget widget-content'>", "<main><div class=has-sidebar>"]
    got = read(spark, [("h", f"{w}<p>Side</p>{post}<p>Side</p></div></div><p>Rest {i}</p>") for i, w in enumerate(wrappers)])
    assert got == {i: f"Story\nRest {i}" for i in range(4)}
    noise = ["<div class=comments>", "<section id=replies><div class=widget>", "<div hidden class=has-sidebar>", "<aside class=ad>"]
    assert set(read(spark, [("g", f"{w}{post}") for w in noise]).values()) == {""}


def plain_scores(pages):
    """Importance by plain loops: (page, node, around, block, mark) to (importance, varied), for pages (host, html)."""
    import math

    from tessella.llm.op1_style_tree import _parse_page

    parsed = [(h, *_parse_page(t)) for h, t in pages]
    shown = {}
    for h, _, features in parsed:
        for f in features:
            shown.setdefault((h, f["node"], f["kind"]), Counter())[f["feature"]] += 1

    def presentation(host, node):
        """Presentation importance times its share, and the share."""
        m, seen = shown[host, node, 0][0], shown.get((host, node, 1), {})
        whole = sum(seen.values())
        if m < 2:
            return None
        entropy = min(-sum(n / whole * math.log(n / whole, len(seen)) for n in seen.values()), 1.0) if len(seen) > 1 else 0.0
        share = 1 - 0.9 ** len(seen)
        return entropy * share, share

    found = {}
    for i, (h, parts, _) in enumerate(parsed):
        for p in parts:
            m = shown[h, p["node"], 0][0]
            if m < 2:
                continue
            content = 1 - math.log(shown[h, p["node"], 2][p["block"]], m)
            if p["mark"] < 0 and p["words"]:
                content = min(content, 1 - sum(math.log(shown[h, p["node"], 3][w], m) for w in p["words"]) / len(p["words"]))
            inner, share = presentation(h, p["node"])
            score, varied = inner + (1 - share) * content, inner
            if p["around"] and (outer := presentation(h, p["around"])):
                score, varied = outer[0] + (1 - outer[1]) * score, max(varied, outer[0])
            found[i, p["node"], p["around"], p["block"], p["mark"]] = score, varied
    return parsed, found


def test_importance_equals_plain_loops(spark):
    import math

    import duckdb

    from tessella.llm.op1_style_tree import importance

    pages = [("h", f"<div class=top><p>Welcome</p><p>Since {i % 2}</p></div><article>{'<p>More</p>' * (i % 5)}<p>Story {i % 17}</p></article><div class='box promo'>Buy {i}</div>") for i in range(40)]
    pages += [("h", f"<div class='teaser-box-promo'>{''.join(f'<p>Line {j} of {i}</p>' for j in range(i % 7 + 1))}</div><div class=promo>Buy {i % 3} now</div>") for i in range(40)]
    pages += [("g", f"<div><ul>{'<li>x</li>' * (i % 3)}</ul><section>{i}</section></div>") for i in range(7)] + [("one", "<p>alone</p>"), ("g", None)]
    pages += [(host_of(u), t) for u, t in duckdb.sql("select url, html from '/root/testdata/sf0.001/pages.parquet'").fetchall()]
    parsed, want = plain_scores(pages)
    frame = spark.createDataFrame([(i, f"http://{h}/p{i}", t) for i, (h, t) in enumerate(pages)], KIND)
    made = parse(frame)
    place = {r["key"]: r["page_id"] for r in made.select("key", "page_id").collect()}
    got = {(place[r["key"]], r["node"], r["around"], r["block"], r["mark"]): (r["importance"], r["varied"]) for r in importance(made).collect()}
    assert set(got) == set(want)
    assert all(math.isclose(v[k], want[key][k], rel_tol=1e-9, abs_tol=1e-12) for key, v in got.items() for k in (0, 1))
    # The tree decides where it can; marks break ties and bound it.
    text, decided = read(spark, pages), Counter()
    for i, (_, parts, _) in enumerate(parsed):
        kept = []
        for p in parts:
            score, varied = want.get((i, p["node"], p["around"], p["block"], p["mark"]), (0.5, 0.0))
            by_tree = False if score <= 0.3 and p["mark"] < 1 else True if (score >= 0.6 if p["mark"] >= 0 else p["mark"] == -1 and varied >= 0.4) else None
            kept.append(p["mark"] >= 0 if by_tree is None else by_tree)
            decided[p["mark"] >= 0, by_tree] += 1
        left = [p["text"] for p, k in zip(parts, kept) if k] or [p["text"] for p in parts if p["mark"] >= 0] or [p["text"] for p in parts if p["mark"] >= -1]
        assert text[i] == "\n".join(left)
    assert min(decided[k] for k in ((True, True), (True, False), (False, True), (False, False), (False, None))) >= 10, decided


def test_adverts_within_articles_go(spark):
    """Boxes that class names mark within articles go from every page, however their words change."""
    boxes = ["<div class=ad>Buy {i} {w}</div>", "<div class='ad-slot'><p>Offer {w}</p></div>", "<ul class='share-buttons'><li>Send {i}</ul>", "<div class=related>{teasers}</div>", "<p>Text <span hidden>secret {i}</span>goes on {i}</p>"]
    pages = []
    for i in range(40):
        filled = "".join(b.format(i=i, w=f"w{i * 7 % 13} v{i}", teasers="".join(f"<p>Teaser {i} {j}</p>" for j in range(i % 5 + 1))) for b in boxes)
        pages.append(f"<article><h1>Title {i}</h1>{''.join(f'<p>Story {i} {j}</p>' for j in range(i % 6 + 1))}{filled}<p>End {i}</p></article>")
    got = read(spark, [("h", p) for p in pages] + [("alone", pages[0])])
    want = ["\n".join([f"Title {i}", *(f"Story {i} {j}" for j in range(i % 6 + 1)), f"Text goes on {i}", f"End {i}"]) for i in range(40)]
    assert [got[i] for i in range(40)] == want and got[40] == want[0]


def test_compound_names_keep_the_text(spark):
    names = ["article-body promo-free", "no-sidebar", "with-comments", "post-body-widget", "ad-free", "layout-banner-less"]
    got = read(spark, [(f"host{n}", f'<div class="{c}"><p>main text</p></div>') for n, c in enumerate(names)] + [("x", "<div class=ad><p>Buy</p></div>")])
    assert [got[i] for i in range(len(names))] == ["main text"] * len(names) and got[len(names)] == ""
    # A page of which something else stays gives up what part of a name speaks against; other pages' variety brings it back.
    page = '<div class="post-body-widget">{}</div><p>Plain {}</p>'
    lone = read(spark, [("a", page.format("<p>one</p>", 1))])
    assert lone[0] == "Plain 1"
    many = read(spark, [("a", page.format("".join(f"<p>line {i} {j}</p>" for j in range(i % 9 + 1)), i)) for i in range(60)])
    assert many[10] == "line 10 0\nline 10 1\nPlain 10"


class _PlainReader(HTMLParser):
    """Blocks of articles by the standard library's reader, for well-formed pages without clutter inside articles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.inside = [], [], 0

    def cut(self):
        if (block := " ".join("".join(self.text).split())) and self.inside:
            self.blocks.append(block)
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
        elif tag not in ("b", "i", "a", "em", "span"):
            self.cut()
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a", "em", "span"):
            self.cut()
        self.inside -= tag == "article"

    def handle_data(self, data):
        self.text.append(data)


def test_parser_against_the_standard_library(spark):
    import duckdb

    rows = duckdb.sql("select page_id, url, html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    want = {}
    for page_id, _, source in rows:
        reader = _PlainReader()
        reader.feed(source or "")
        reader.close()
        want[page_id] = "\n".join(reader.blocks)
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, KIND)).collect()}
    assert sum(bool(t) for t in want.values()) > 200 and got == want


def test_tree_overrules_class_names(spark):
    """A varied part that only a compound class name marks is content; a fixed one with the same words is not."""
    varied = [f"<div class='story-widget'>{''.join(f'<p>Line {j} of {i}</p>' for j in range(i % 7 + 1))}</div><div class='box-widget'><p>Deal {i % 2}</p></div>" for i in range(60)]
    got = read(spark, [("h", v) for v in varied])
    assert got[9] == "Line 0 of 9\nLine 1 of 9\nLine 2 of 9" and got[0] == "Line 0 of 0"


def test_headings_are_no_marks(spark):
    page = '<article><h2 id="search">Search trees</h2><p>body</p><section id="comment-syntax"><p>How to comment</p></section></article><div id="search">Find</div><div id=replies>Me too</div>'
    assert read(spark, [("a", page)])[0] == "Search trees\nbody\nHow to comment"


def test_restoring_is_a_choice(spark):
    pages = [("g", "<div><p>copied page</p></div><div class=ad>Buy</div>")] * 30
    assert set(read(spark, pages).values()) == {"copied page"} and set(read(spark, pages, restore=False).values()) == {""}
