import random
import re
import time
from html import unescape

from foldstone.llm.html_text import best, extract, main_text, parse

from .conftest import prose


def text(html):
    return extract(parse(html))


BODY = "The first paragraph of the article is long enough to count.", "The second one says &amp; means more."
PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a href="/">Home page of the site with many words</a></ul></nav>
<div class="cookie-notice">We use cookies on this very long notice, please accept all of them now.</div><div class="{c}"><h1>Head
 line</h1><p>{a}<p>{b}<br>more</div><div id="comments"><p>A reader says something long about the article here.</p></div><script>var x = "</p><p>no";</script><footer>end</footer></body></html>"""


def test_article_without_furniture():
    want = f"Head line\n\n{BODY[0]}\n\nThe second one says & means more. more"
    for c in ("post-12", "content", "x y"):
        assert text(PAGE.format(c=c, a=BODY[0], b=BODY[1])) == want
    a, b = (parse(PAGE.format(c=c, a=BODY[0], b=BODY[1])) for c in ("post-12", "post-3"))
    assert a.tags[best(a)] == "div" and a.paths[best(a)] == b.paths[best(b)]


def test_whole_articles():
    long = "A long section goes on about things. " * 20
    assert text(f"<body><article><h1>Title</h1><p>Lead.</p><section><p>{long}</p></section><section><p>End.</p></section></article></body>") == f"Title\n\nLead.\n\n{long.strip()}\n\nEnd."
    page = f'<body><div class="content"><div class="intro"><p>An intro of one sentence.</p></div><div class="body"><p>{long}</p></div><div class="outro"><p>That was the whole of it.</p></div></div><div class="box"><p>Elsewhere, other things are told.</p></div></body>'
    assert text(page) == f"An intro of one sentence.\n\n{long.strip()}\n\nThat was the whole of it."
    assert text(f'<body><div id="a"><h1>Head</h1><div class="x"><p>{long}</p></div></div></body>') == f"Head\n\n{long.strip()}"
    assert text(f'<article><p>{long}</p><div class="social-studies"><p>Pupils learn.</p></div><div class="share-box">Share</div><div class="user-comments"><p>So true.</p></div></article>') == f"{long.strip()}\n\nPupils learn."


def test_deep_pages_take_linear_time():
    for tag in ("div", "span", "section"):
        began = time.time()
        assert text(f"<{tag}>" * 20_000 + "<p>the text" + f"</{tag}>" * 20_000) == "the text"
        assert time.time() - began < 4
    assert text("<article>" + "<p>word one" * 20_000) == "\n\n".join(["word one"] * 20_000)


def test_doubtful_names_go_by_the_host_s_votes(spark):
    """One name holds a text of its own on each page, another the same on all; equal pages don't count twice."""
    page = lambda i: f'<article><h1>Head {i}</h1><p>Text {i} is long enough to be one.</p><div class="social-studies"><p>Lesson {i} is about {i} things.</p></div><div class="promo-spring"><p>Buy one, get one free this spring.</p></div></article>'
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(6)] + [(9 + i, "http://h.example/0", page(0)) for i in range(20)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, _, html in rows:
        i = 0 if k >= 9 else k
        assert got[k] == f"Head {i}\n\nText {i} is long enough to be one.\n\nLesson {i} is about {i} things."


def test_two_templates_of_one_host(spark):
    long = "Here the article tells a long story. " * 9
    rows = [(i, "http://t/", f'<body><div class="old"><p>{long}{i}</p></div><div class="teaser"><p>See also this.</p></div></body>') for i in range(5)]
    rows += [(i, "http://t/", f'<body><div class="teaser"><p>See also this.</p></div><div class="new"><p>{long}{i}</p></div></body>') for i in range(5, 9)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{long}{i}" for i in range(9)}


def test_generated_pages(spark):
    """Articles of known blocks among furniture, in several templates of several hosts."""
    r, rows, want = random.Random(7), [], {}
    shells = ["<article>{}</article>", '<main><div class="story">{}</div></main>', '<div id="wrap"><div class="entry-{n}">{}</div></div>', '<div class="post"><section>{}</section></div>']
    for i in range(120):
        host = r.randrange(4)
        blocks = [prose(r, r.randint(2, 60)) + "." for _ in range(r.randint(2, 7))]
        made = "".join(r.choice((f"<p>{b}</p>", f"<p>{b}", f"<blockquote><p>{b}</p></blockquote>", f"<h2>{b}</h2>", f"<ul><li>{b}</ul>", f"<p><b>{b}</b></p>")) for b in blocks)
        junk = [f'<nav><a href="/">{prose(r, 4)}</a></nav>', f'<div class="ad-slot"><p>{prose(r, 30)}.</p></div>', f'<aside><p>{prose(r, 20)}.</p></aside>', f"<!-- {prose(r, 5)} -->", f'<div id="comments"><div class="comment"><p>{prose(r, 40)}.</p></div></div>', f"<script>var x = '<p>{prose(r, 3)}</p>';</script>", f"<form><input value='x'>{prose(r, 9)}</form>"]
        r.shuffle(junk)
        rows.append((i, f"https://h{host}.example/{i}", f"<html><body>{''.join(junk[:3])}{shells[host].replace('{n}', str(i)).format(made)}{''.join(junk[3:])}<footer>{prose(r, 12)}.</footer></body></html>"))
        want[i] = "\n\n".join(blocks)
    got = {x.page_id: x.text for x in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_articles_of_the_sample_pages(spark):
    """What stands between the tags of each page's only article, read by plain patterns."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {x.page_id: x.text for x in main_text(table).collect()}
    for row in table.collect():
        inner = re.search(r"<article>(.*?)</article>", row.html or "", re.S)
        blocks = [" ".join(unescape(re.sub(r"<br\s*/?>", " ", b)).split()) for b in re.split(r"</?(?:p|h\d|ul|ol|li|div|section|blockquote)\b[^>]*>", re.sub(r"</?(?:b|i|a|em|strong|span)\b[^>]*>", "", inner[1]))] if inner else []
        assert got[row.page_id] == "\n\n".join(b for b in blocks if b), row.page_id


def test_broken_markup():
    assert text("<article><p><b>one<br><p>two &lt;x&gt; &#233;&nbsp;z<p>") == "one\n\ntwo <x> é z"
    assert text("<article><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e</table></article>tail") == "a\n\nb\n\nc\n\nd\n\ne"
    assert text("<div><p>open <i>never closed</div><p>x <!-- no --> y") in ("open never closed", "open never closed\n\nx y")
    assert text("<article><p title=it's>one</p><p title='a>b' alt=\"c>d\">two</p><p class=\"x>three</p><p>four's") == "one\n\ntwo\n\nthree\n\nfour's"
    assert text("plain text only") == "plain text only"
    assert text("a < b <article><p title='<p>'>in 1 < 2 side</p></article>") == "in 1 < 2 side"
    assert text("<script>never ended <p>x") == text(None) == text("") == text("<") .strip("<") == ""


def test_host_agrees_on_a_path(spark):
    long = "word " * 60
    page = lambda main, side: f'<body><div class="main"><p>{main}</p></div><div class="box"><p>{side}</p></div></body>'
    rows = [(i, "http://H.example/p", page(long, "aside")) for i in range(5)] + [(5, "http://h.example/q", page("short text", long)), (6, "http://other/", page("short text", long)), (7, None, None), (7, None, None), (8, "x", "<nav>only</nav>")]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, id string, host int")
    got = sorted((r.page_id, r.text, r.n_chars, r.url) for r in main_text(table).collect())
    want = {5: "short text", 6: long.strip(), 7: "", 8: ""} | {i: long.strip() for i in range(5)}
    assert got == sorted((i, want[i], len(want[i]), u) for i, u, _ in rows)
    assert main_text(table.where("false")).count() == 0


def test_many_pages_of_one_host(spark):
    table = spark.createDataFrame([(i, "http://one/" + str(i), PAGE.format(c=f"post-{i}", a=BODY[0] + str(i), b=BODY[1])) for i in range(60)], "page_id long, url string, html string")
    assert all(r.text == f"Head line\n\n{BODY[0]}{r.page_id}\n\nThe second one says & means more. more" for r in main_text(table).collect())
