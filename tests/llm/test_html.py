import random
import time
from html import escape

from flowharbor.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="sidebar"><p>Popular stories of the week that are long enough to count</p></div>
<{box}><h2>Title &amp; more</h2><p>First  <b>bold</b>\n text that is long enough to be a paragraph of its own.<p>Second<br>line &lt;x&gt; &#233;
<ul><li>one<li>two</ul><form><input value="x">Search</form><div class="ad">Buy now</div><section class="comments"><p>reader: {long}</p></section></{end}>
<footer>&copy; us</footer></body></html>"""
LONG = "I have so very much to say about this that it is longer than the article itself " * 5
WANT = "Title & more\nFirst bold text that is long enough to be a paragraph of its own.\nSecond line <x> é\none\ntwo"


def page(box):
    return PAGE.format(box=box, end=box.split()[0], long=LONG)


def test_containers_of_many_kinds(spark):
    rows = [(i, f"http://h{i}.example/a", page(box)) for i, box in enumerate(["article", "main", 'div class="post-body c12"', 'div id="content"', "section"])]
    rows += [(10, "http://x.example/", None), (11, None, ""), (12, "http://x.example/", "plain &amp; simple"), (13, "http://x.example/", "<p>cut <b>off &lt;<a hre"), (14, "no url", "<script>x"), (10, "http://x.example/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as main_text")
    got = {r.page_id: r.main_text for r in html.main_text(df).collect()}
    assert all(got[i] == WANT for i in range(5)), got
    assert got[10] == got[11] == got[14] == "" and got[12] == "plain & simple" and got[13].startswith("cut off <")
    assert html.main_text(df).count() == len(rows) and html.main_text(df.limit(0)).count() == 0


def test_host_votes_settle_the_path(spark):
    body = "<p>words of the article that run on for a while and then some more of it</p>"
    usual = f'<html><body><div class="story">{body * 3}</div><div class="extra"><p>short</p></div></body></html>'
    odd = f'<html><body><div class="story">{body}</div><div class="extra">{body * 6}</div></body></html>'
    rows = [(i, "https://News.example:80/x", usual) for i in range(6)] + [(9, "http://news.example/y?z", odd)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.main_text for r in html.main_text(df).collect()}
    assert got[9].count("\n") == 0 and got[0].count("\n") == 2


LEAD, CLOSE = "A lead that says in short what the long text below says at length.", "A closing line."
BODY = "<p>A paragraph of the long text, with words enough to count as one of its own.</p>" * 12


def test_blocks_beside_the_longest_container_stay():
    source = f'<body><div class="links"><a href="/">a link to elsewhere</a></div><div class="content"><h1>Title</h1><p>{LEAD}</p><div class="body">{BODY}</div><p>{CLOSE}</p></div></body>'
    lines = html.extract(source, html.ballot(source)[0]).split("\n")
    assert lines[:2] == ["Title", LEAD] and lines[-1] == CLOSE and len(lines) == 15
    beside = f'<body><div class="content"><p><a href="/">Only a link to elsewhere</a></p><div class="body">{BODY}</div></div></body>'
    assert len(html.extract(beside, html.ballot(beside)[0]).split("\n")) == 12


def test_class_words_of_wrappers_skip_no_page():
    comments = '<div id="comments" class="comments-area"><article class="comment"><p>' + "what a reader says " * 20 + "</p></article></div>"
    for name in ("layout-with-sidebar", "has-comments", "page-no-nav", "sidebar"):
        for box, end in (("article", "article"), ('div class="text"', "div")):
            if name == "sidebar" and end == "div":
                continue
            extra = comments if end == "article" else '<div class="comments"><p>' + "what a reader says " * 90 + "</p></div>"
            source = f'<body><div class="{name}"><div class="sidebar"><p>Popular stories of the week</p></div><{box}><p>{LEAD}</p>{BODY}</{end}>{extra}</div></body>'
            lines = html.extract(source, html.ballot(source)[0]).split("\n")
            assert lines[0] == LEAD and len(lines) == 13, (name, box, lines)


def test_words_in_class_names_alone_drop_no_article_text():
    for name in ("share-price", "side-effects", "search-results-explained"):
        source = f'<body><article><p>{LEAD}</p><section class="{name}"><p>{CLOSE}</p></section>{BODY}</article></body>'
        assert html.extract(source, html.ballot(source)[0]).split("\n")[:2] == [LEAD, CLOSE]
    for name in ("comment-list", "ad-slot", "post-comments", "related"):
        source = f'<body><article><p>{LEAD}</p><section class="{name}"><p>{CLOSE}</p></section>{BODY}</article></body>'
        assert CLOSE not in html.extract(source, html.ballot(source)[0])
    links = f'<body><article><p>{LEAD}</p><div class="more-related-here"><a href="/">{CLOSE}</a></div>{BODY}</article></body>'
    assert CLOSE not in html.extract(links, html.ballot(links)[0])


def test_quotes_open_only_behind_an_equals_sign():
    for attribute in ("data-x=it's", "data-x='a>b'", 'data-x="a>b"', "it's", 'x"y', "data-x= \"it's > that\"", "data-x='", 'title="'):
        source = f"<article><p>one</p><p {attribute}>two</p><p>three</p></article>"
        assert html.extract(source, html.ballot(source)[0]) == "one\ntwo\nthree", attribute


def test_generated_pages_give_back_their_articles(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghié&<'\"", k=rng.randint(1, 9)))
    rows, want = [], {}
    for i in range(300):
        blocks = [" ".join(word() for _ in range(rng.randint(3, 60))) for _ in range(rng.randint(1, 12))]
        box = rng.choice(["article", "main", 'div class="text"'])
        tag = lambda: rng.choice(["p", "h2", "p class='lead'", "blockquote", "div data-x=it's", "p title=\"a > b\""])
        inner = "".join(f"<{t}>{rng.choice(['', ' ', chr(10)])}{escape(b).replace(' ', rng.choice([' ', '  ', chr(10)]))}</{t.split()[0]}>" for b in blocks for t in [tag()])
        noise = [f"<nav><a href='/'>{escape(word())}</a></nav>", f"<div class='sidebar'><a href='/x'>{escape(word())}</a></div>", f"<footer>{escape(word())}</footer>", "<script>if (a < b) '</p>'</script>", "<!-- <p>no</p> -->"]
        rng.shuffle(noise)
        rows.append((i, f"http://h{i % 7}.example/{i}", f"<html><body>{''.join(noise[:3])}<{box}>{inner}{noise[3]}</{box.split()[0]}>{noise[4]}</body></html>"))
        want[i] = "\n".join(blocks)
    rows.append((1000, "http://h0.example/long", "<article>" + "<p>very long</p>" * 60_000 + "</article>"))
    want[1000] = "\n".join(["very long"] * 60_000)
    got = {r.page_id: r.main_text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_broken_and_deep_nesting_costs_in_proportion():
    started = time.process_time()
    assert html.extract("<div>" * 100_000 + "text", None) == "text"
    assert html.extract("<div><span>" * 30_000 + "text" + "</b></i>" * 30_000, None) == "text"
    words = "word " * 100
    assert html.extract("<div class=comment>says</div>" * 20_000 + f"<article><p>{words}</article>", None) == words.strip()
    html.extract("<svg>x" * 20_000 + f"<p>{words}", None)
    html.extract("<b>" * 10_000 + "</i>" * 10_000 + "<h1>x" * 5_000, None)
    assert time.process_time() - started < 20


def test_a_form_around_the_page_is_no_boilerplate():
    article = "The article has many words. " * 20
    assert html.extract(f"<body><form id=aspnetForm><div class=content>{article}</div></form></body>", None) == article.strip()
    assert html.extract(f"<body><form><nav>Menu</nav><div class=sidebar>{'Side words. ' * 9}</div><div>{article}</div></form></body>", None) == article.strip()
    assert html.extract(f"<body><article>{article}<form>Leave a reply {'label ' * 60}</form></article></body>", None) == article.strip()
    assert html.extract("<body><form><label>Search</label></form></body>", None) == ""
