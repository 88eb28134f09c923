"""Main text of hand-made pages and of the page table."""

import html as H
import re

from quizloom.llm import html_text as X

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<nav><ul><li>menu</li></ul></nav><header>top</header><div class="ad">buy</div><aside>side</aside><div id="cookie-notice">we</div>
<article class="no-comments"><h1>Title &amp; more</h1><p><b>One.<br><p>Two
  lines&nbsp;here &lt;x&gt;</p><div class="share">share</div><ul><li>a<li>b</ul><form>name <input></form>
<table><tr><td>c1<td>c2</table><p>caf&eacute; &#8364;<p hidden>gone</p><!-- no --></article>
<section class="comments"><article class="x"><p>reader</p></article></section><footer>&copy; x</footer>"""


def test_one_page(spark):
    rows = [(1, "http://h.example/a", PAGE)]
    out = X.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).first()
    assert out.text.split("\n\n") == ["Title & more", "One.", "Two lines here <x>", "a", "b", "c1", "c2", "café €"]
    assert out.n_chars == len(out.text)


def _plain(i, copies=1):
    return f"<body><div class=box>Sign up here</div><div class=body><p>Text {i} of its own</p><p>Often said</p></div><div>Bye</div>"


def test_style_tree_removes_what_a_site_repeats(spark):
    rows = [(i, f"https://u@S.example:8/{i}", _plain(i)) for i in range(20)]
    rows += [(100 + i, "https://lone.example/", _plain(7)) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in X.main_text(df).collect()}
    assert all(got[i] == f"Text {i} of its own\n\nOften said" for i in range(20))
    # copies of one page say nothing about what is important
    assert all(got[100 + i].startswith("Sign up here\n\nText 7") for i in range(30))


def test_a_long_notice_on_all_pages_leaves(spark):
    notice = "This site is for information only and nobody answers for what it says. " * 5
    page = "<body><div class=x>{}</div><div class=body><p>Text {} of its own</p></div><div class=y>Bye</div>"
    rows = [(i, f"http://big.example/{i}", page.format(notice, i)) for i in range(12)]
    rows += [(100 + i, f"http://small.example/{i}", page.format(notice, i)) for i in range(7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in X.main_text(df).collect()}
    assert all(got[i] == f"Text {i} of its own" for i in range(12))
    # too few different pages to judge
    assert all(got[100 + i] == f"{notice.strip()}\n\nText {i} of its own\n\nBye" for i in range(7))


def test_region_by_share_of_text():
    said = lambda html: [b[1] for b in X.blocks_of(html)]
    story = "<h1>Head</h1><p>The story itself</p>"
    card = "<article class=\"related\"><p>A teaser card that is rather long, longer than the story</p></article>"
    short = "<article class=\"related\"><p>A teaser</p></article>"
    for page in (f"<main>{story}</main>{card}", f"<main>{story}{short}</main>", f"<div>{story}</div>{short}", f"<main>{story}{card}{short}</main>", f"<article>{story}{card}</article>", f"<article>{story}</article>{card}", f"<div>{story}</div>{card}{card}"):
        assert said(page) == ["Head", "The story itself"]
    # a teaser without a telling class does not hide the story
    assert said(f"<div>{story}</div><article>Read on</article>") == ["Head", "The story itself", "Read on"]
    assert said("<main>Skip</main><div>The story itself</div>") == ["Skip", "The story itself"]
    assert said(f"<main><p>Lead</p><article>{story}</article></main>") == ["Lead", "Head", "The story itself"]
    # short texts outside leave; an article of main text stays whatever its class
    assert said(f"<div>Out</div><article>{story}</article><div>side</div>") == ["Head", "The story itself"]
    assert said(f"<div>Out</div><article class=share>{story}</article>") == ["Head", "The story itself"]
    assert said("<article class=share>a</article><article class=comments>b</article>") == ["a", "b"]


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (None, "x", "plain <b>bold"), (3, "http://h", "<p>a<p"), (3, "http://h", "<p>a<p"), (4, "http://h", "<div>" * 3000 + "deep"),
            (5, "http://h", "<p>" + "word " * 100_000), (6, "http://h", "</p></div><li>x</ul>y<td>z"), (7, "http://h", "<nav>only")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, nodes string")
    got = X.main_text(df).collect()
    assert sorted(r.text[:20] for r in got if r.page_id not in (5,)) == sorted(["", "", "plain bold", "a", "a", "deep", "xy\n\nz", ""])
    assert [r.n_chars for r in got if r.page_id == 5] == [499_999]
    assert X.main_text(df.limit(0)).count() == 0


def test_page_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in X.main_text(df).collect()}
    for r in df.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = [" ".join(H.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n\n".join(b for b in want if b)
