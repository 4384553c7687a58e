import random
import re
import time

from hitflow.llm import registry
from hitflow.llm.main_text import brute_region, extract, fit_weights, parse, region, scores
from hitflow.llm.main_text import main_text as run

PAGE = """<!DOCTYPE html><html><head><title>Title words here</title><style>p{margin:0}</style><script>var t="</p><p>not text";</script></head><body class="x">
<header><a href="/">Site name here</a></header><nav><ul><li><a href="/a">Menu one</a></li><li><a>Menu two</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site and more.</div><!-- <p>hidden</p> -->
<%s><h1>The &lt;main&gt; title</h1><p>First  paragraph with <b>bold</b> and&nbsp;<a href="/x">a link</a> in&#32;it.<br>More of it.<p>Second
paragraph, unclosed.<div class="ad-box">Buy now buy now buy</div><form><label>Name</label><input name="q"><button>Send</button></form>
<ul><li>Item one of the list<li>Item two</ul><div id="comments"><p>I am a reader and I liked this</p></div></%s>
<aside class="sidebar"><p>Other stories you may like to read today</p></aside><footer>&copy; 2020 site &middot; all rights</footer></body></html>"""
WANT = "The <main> title\n\nFirst paragraph with bold and a link in it. More of it.\n\nSecond paragraph, unclosed.\n\nItem one of the list\n\nItem two"


def test_article_without_surroundings():
    for name in ("article", "main", "div"):
        assert extract(PAGE % (name, name), {}) == WANT


def test_region_has_the_highest_sum():
    rng = random.Random(7)
    for _ in range(60):
        source = "".join(rng.choice(["<p>", "</p>", "<nav>", "</nav>", "<a>", "</a>", "one two ", "x ", "<div class=ad>", "</div>", "<h1>"]) for _ in range(25))
        score = scores(parse(source), {})
        first, last = region(score)
        assert abs(sum(score[first:last]) - brute_region(score)) < 1e-9


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "<p"), (4, "plain text only &amp; more"), (None, "<p>a</p>"), (5, "<nav>x</nav>"), (5, "<p>" + "word " * 100000), (6, "<p>cut &am"), (7, "İ<script>x</SCRIPT><p>after İ</p>")]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("page_id", "html", "'u' as url", "1 as text", "2 as k0")
    got = [(r.page_id, r.text) for r in run(df, {}).collect()]
    assert got[:6] == [(1, ""), (2, ""), (3, ""), (4, "plain text only & more"), (None, "a"), (5, "")]
    assert len(got[6][1]) == 499999 and got[7][1] == "cut &am" and got[8][1].endswith("after İ")
    assert run(df.where("false"), {}).collect() == [] and fit_weights(df.where("false")) == {}


def test_query_finds_the_marked_article(spark, sf):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = registry.op6_main_text(spark, sf).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    for r in got:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b)))).strip() for b in re.split(r"</?(?:h1|p)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b), r.page_id


def test_wrappers_do_not_switch_the_article_off():
    inner = "<article><h1>A title</h1><p>Some words that all stay here.</p></article>"
    want = "A title\n\nSome words that all stay here."
    wrappers = ['style="overflow:hidden"', 'data-class="x hidden"', 'class="overflow-hidden"', 'class="content has-sidebar"', 'class="no-comments"', 'class="with-nav"', 'class="sidebar-left"', 'class="lg:hidden"']
    for own in wrappers:
        assert extract(f"<body><div {own}>{inner}</div></body>", {}) == want, own
        assert extract(f"<body><div {own}>{inner.replace('article', 'div')}</div></body>", {}) == want, own
    for name in ("article", "main", "div"):
        assert extract(f"<body><form action=x><nav>Menu</nav>{inner.replace('article', name)}<select><option>No</select></form></body>", {}) == want, name


def test_marked_elements_beside_the_article_stay_off():
    page = '<body><%s><h1>A title</h1><p>Words of the article.</p></%s><div%s>%s</div></body>'
    other = "<article class=comment-body><p>" + "reader words " * 50 + "</p></article>"
    for own in (' id="comments"', ' class="site-footer"', " hidden", ' class="visually-hidden"', " class=cookie-notice"):
        for name in ("article", "main", "div"):
            assert extract(page % (name, name, own, other if name != "div" else "<p>" + "reader words " * 50), {}) == "A title\n\nWords of the article.", (own, name)


def test_the_last_block_is_whole():
    assert extract('<body><p>Read <a href="/r">the full report</a></p></body>', {}) == "Read the full report"
    assert extract('<body><p>One two three four. <a href="/r">see here</a> end</p><nav>Menu</nav></body>', {}) == "One two three four. see here end"


def test_long_excluded_parts_do_not_cut_the_lead():
    lead, rest = "<h1>A title</h1><p>" + "lead " * 20 + "</p>", "<p>" + "rest " * 60 + "</p>"
    want = "A title\n\n" + ("lead " * 20).strip() + "\n\n" + ("rest " * 60).strip()
    for off in ("<select>" + "<option>one of the choices</option>" * 200 + "</select>", "<aside><ul>" + "<li><p>beside the text</p>" * 200 + "</ul></aside>", "<nav>" + "<a href=x>some entry</a> " * 400 + "</nav>"):
        assert extract(f"<body><div>{lead}{off}{rest}</div></body>", {}) == want, off[:8]


def test_only_true_class_and_id_marks_count():
    for inner in ('<p data-id="share-1">Words of it.</p>', '<p title="the id=menu thing">Words of it.</p>', '<section id="notice-of-appeal"><p>Words of it.</p></section>', '<h2 id="share-prices">Words of it.</h2>'):
        assert extract(f"<body><article><h1>A title</h1>{inner}<p>The end.</p></article></body>", {}) == "A title\n\nWords of it.\n\nThe end.", inner
    for inner in ('<p aria-hidden="true">not shown</p>', '<div style="color:red; display: none">not shown</div>', '<div id="ad-slot-3">buy</div>', '<section id=comments>reader</section>', '<div class="article-comments"><p>reader</div>'):
        assert extract(f"<body><article><h1>A title</h1>{inner}<p>The end.</p></article></body>", {}) == "A title\n\nThe end.", inner
    for wrapper in ("layout has-sidebar", "post no-comments"):
        assert extract(f'<div class="{wrapper}"><article><p>All of it stays.</p></article></div>', {}) == "All of it stays."
    assert extract("<p>Words in this one <a>and a final link text</a></p>", {}) == "Words in this one and a final link text"
    assert extract("<article><p>See the next <b>bold</b> <a>and a final link text here</a></p></article>", {}) == "See the next bold and a final link text here"


def _neutral(rng, marked):
    """A page without any telling tag or class: the places q1, q3, q4 and q6 surround the article in q5."""
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(n))
    text = [say(rng.randrange(8, 40)) for _ in range(rng.randrange(2, 6))]
    name = "article" if marked else "div"
    page = f'<body><div class=q1><a>{say(2)}</a><a>{say(1)}</a></div><div class=q3><p>{say(30)}</p><p>{say(12)}</p></div><{name} class=q5><h2>{say(3)}</h2>'
    page = page.replace("<h2>", f"<h2>Own {say(1)} ")
    title = re.search(r"<h2>(.*?)</h2>", page)[1]
    return page + "".join(f"<p>{t}</p>" for t in text) + f"</{name}><div class=q4><p>{say(25)}</p></div><div class=q6>{say(20)}</div></body>", "\n\n".join([title, *text])


def test_the_region_decides_where_no_list_does(spark):
    rng = random.Random(3)
    pages = [_neutral(rng, i % 4 == 0) for i in range(80)]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(pages)], "page_id long, html string")
    weights = fit_weights(df)
    got = {r.page_id: r.text for r in run(df, weights, keep=()).collect()}
    for i, (source, want) in enumerate(pages):
        page = parse(source)
        listed = " ".join(t for t, o in zip(page.texts, page.owner) if page.elements[o].on)
        assert len(listed.split()) > len(want.split()) + 80  # the lists leave all of the surroundings
        assert got[i] == want, i


def test_time_grows_with_the_length_alone():
    for piece, n in (("<b>x ", 200_000), ("<b>x</i>", 100_000), ("<li>x", 100_000), ('<p title="', 100_001), ("<a ", 100_000), ("<div class=a><p>x", 50_000), ("<!--", 100_000)):
        began = time.monotonic()
        extract("<article>" + piece * n, {})
        assert time.monotonic() - began < 12, piece
    began = time.monotonic()
    assert len(extract("<p>" + "<b>x " * 80_000 + "</b>" * 80_000, {})) == 159_999
    assert time.monotonic() - began < 8


def test_marks_of_page_builders_and_of_compound_names():
    text = " ".join(["word"] * 60)
    built = f'<body><div class="elementor-widget"><p>{text} one</p></div><div class="elementor-widget"><p>{text} two</p></div></body>'
    assert extract(built, {}) == f"{text} one\n\n{text} two"
    titled = f'<body><div class="site-nav"><a>Home</a></div><div class="widget wp"><h1>A title</h1></div><div class="widget wp"><p>{text}</p></div></body>'
    assert extract(titled, {}) == f"A title\n\n{text}"
    for own in ("class", "id"):
        for name in ("social-history", "share-price", "notice-of-appeal", "menu-engineering", "comment-analysis"):
            page = f'<body><article><h1>A title</h1><p {own}="{name}">The social history of towns.</p><p>The end.</p></article></body>'
            assert extract(page, {}) == "A title\n\nThe social history of towns.\n\nThe end.", (own, name)
        for name in ("share-buttons", "newsletter-signup", "related-posts", "site-footer", "cookie-banner", "comment-list", "sidebar-right", "social-icons", "widget-area", "post-comments"):
            page = f'<body><article><h1>A title</h1><div {own}="{name}">Other words here</div><p>The end.</p></article></body>'
            assert extract(page, {}) == "A title\n\nThe end.", (own, name)


def test_a_table_of_contents_does_not_cut_the_lead():
    contents = "<ul>" + "".join(f'<li><a href="#s{i}">Section number {i} of it</a></li>' for i in range(8)) + "</ul>"
    body = "".join(f"<p>{' '.join(['body'] * 40)} {i}</p>" for i in range(3))
    for name in ("article", "main", "div"):
        got = extract(f"<body><nav><a>Menu</a></nav><{name}><h1>The title</h1><p>A lead of just seven words here.</p>{contents}{body}</{name}><footer>End</footer></body>", {})
        assert got.startswith("The title\n\nA lead of just seven words here.\n\nSection number 0 of it") and got.endswith("body 2"), name


def test_neutral_names_leave_the_given_articles_as_they_are(spark, sf):
    """The given pages with every telling tag and class made neutral, but for the article's own tag on every fourth: the
    region alone finds the same texts that the marks give."""
    pages = [r.html for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet").orderBy("page_id").collect()]
    names = {"nav": "q1", "footer": "q2", "article": "q5"}
    want, plain = [extract(p, {}) for p in pages], []
    for i, p in enumerate(pages):
        p = p.replace('<div class="ad">', '<div class="q3">')
        for tag, own in names.items():
            if tag != "article" or i % 4:
                p = p.replace(f"<{tag}>", f'<div class="{own}">').replace(f"</{tag}>", "</div>")
            else:
                p = p.replace("<article>", '<article class="q5">')
        plain.append(p)
    df = spark.createDataFrame(list(enumerate(plain)), "page_id long, html string")
    got = {r.page_id: r.text for r in run(df, fit_weights(df), keep=()).collect()}
    everything = [" ".join(t for t, o in zip(q.texts, q.owner) if q.elements[o].on).split() for q in map(parse, plain)]
    assert all(len(everything[i]) > len(want[i].split()) + 5 for i in range(len(plain)))  # without the region the surroundings would stay
    assert [i for i in range(len(plain)) if got[i] != want[i]] == []
