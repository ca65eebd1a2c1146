"""Main text of pages that name, link and close things in every way."""

import re
from collections import Counter

import pytest

from tessaly.llm import html_blocks
from tessaly.llm.html_labelled import TEMPLATES, Writer, labelled_pages

NEIGHBOURS = {"words_before", "links_before", "words_after", "links_after"}
BODY = "<h1>T</h1><p>Body text of the page</p>"
PAGES = {
    "wrapper called after a side bar": (f'<div class="layout sidebar-right"><article>{BODY}</article><div class="sidebar"><p>Side text</p></div></div>', ["T", "Body text of the page"]),
    "wrapper called after a menu": (f'<div class="main-wrapper with-nav"><main>{BODY}</main></div>', ["T", "Body text of the page"]),
    "form around the page": (f'<form id="aspnetForm"><article>{BODY}</article></form>', ["T", "Body text of the page"]),
    "article in an aside": (f'<aside><article><p>Teaser of four words</p></article></aside><article>{BODY}<p>It goes on for a while.</p></article>', ["T", "Body text of the page", "It goes on for a while."]),
    "stray quotation mark": ('<article><a href="x"">one</a><p>Lost paragraph</p><p class="b">kept</p></article>', ["Lost paragraph", "kept"]),
    "apostrophe in a value": ("<article><p title=it's>first one</p><p>second one</p><p>don't</p></article>", ["first one", "second one", "don't"]),
    "quotation that never ends": ('<article><p title="abc>first one</p><p>second one</p></article>', ["first one", "second one"]),
    "names inside other values": ('<article><p title="the hidden role of class">one here</p><p data-id="comments">two here</p><p data-role="menu">three here</p></article>', ["one here", "two here", "three here"]),
    "sign inside a value": ('<article><p title="a > b">one here</p><p alt=\'<p>\'>two here</p></article>', ["one here", "two here"]),
    "linked blocks": (f'<article>{BODY}</article><a href><h3>Teaser</h3><p>long teaser of another page that has words</p></a><a href="/x"><div>More</div></a>', ["T", "Body text of the page"]),
    "anchors are no links": ('<article><a name="top"><h1>T</h1><p>Body text of the page</p><p>More</p></article>', ["T", "Body text of the page", "More"]),
    "link that is never closed": ('<article><p><a href="/x">See</a> here</p><p>Read <a href="/y">on</p><p>Plain text here</p></article>', ["See here", "Read on", "Plain text here"]),
    "subjects": ('<article><h1>T</h1><p class="share-price">Price up</p><div class="search-and-rescue">Boats went out</div><p class="response">They said no</p></article>', ["T", "Price up", "Boats went out", "They said no"]),
    "comments as articles": (f'<article>{BODY}</article><section id="comments"><h3>2 Comments</h3><article class="comment"><p>I read it</p></article><article class="comment"><p>Me too</p></article></section>', ["T", "Body text of the page"]),
    "comments in code": ('<article><p>Body text</p><pre>x = 1 <span class="comment"># one</span></pre></article>', ["Body text", "x = 1 # one"]),
    "hidden": ('<article><p>Body text</p><p hidden>no</p><div style="display: none">no</div><p>a<span aria-hidden="true">x</span>b</p></article>', ["Body text", "ab"]),
    "not shown": ('<article><script>"</p>"</script><style>p{}</style><p>Body &amp; text&nbsp;here<!-- no --><!-->.</p><noscript>no</noscript></article>', ["Body & text here."]),
    "notices": (f'<div class="cookie-notice">We use cookies here</div><div class="banner">Buy</div><article>{BODY}<div class="ad">Buy shoes</div></article><form><p>Your address</p></form>', ["T", "Body text of the page"]),
    "slashes and broken tags": ("<article/><p/>one here<br/>two<p>three here</p/></article ><", ["one here two", "three here"]),
}


@pytest.fixture(scope="module")
def found(spark):
    def run(pages):
        frame = spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string").selectExpr("page_id", "'u' as url", "html", "1 as blocks", "'x' as text")
        return {r["page_id"]: r["text"].split("\n\n") if r["text"] else [] for r in html_blocks.main_text(frame).collect()}

    return run


def test_pages(found):
    results = found([page for page, _ in PAGES.values()])
    assert {name: results[k] for k, name in enumerate(PAGES)} == {name: texts for name, (_, texts) in PAGES.items()}


def test_attributes():
    read = lambda tag: html_blocks.attributes_at(tag, 0)
    assert read(' a=1 b="2>" c=\'3\' d e = 5 A=9>x') == ({"a": "1", "b": "2>", "c": "3", "d": "", "e": "5"}, 30)
    assert read(' href="x"">y') == ({"href": "x", '"': ""}, 11) and read("") == ({}, 0) and read(' a="&amp;" /') == ({"a": "&"}, 12)
    assert read(" ==x>") [1] == 5 and read(' a="never ends') == ({"a": '"never', "ends": ""}, 14)


def test_the_tree_asks_for_neighbours(spark):
    tree = html_blocks.fit_tree(spark)
    asked = {html_blocks.FEATURES[int(k)] for k in re.findall(r"feature (\d+)", tree)}
    assert len(asked & NEIGHBOURS) >= 2 and {"words", "links"} <= asked
    assert len(labelled_pages()) >= 100 and len({p for p in labelled_pages()}) == len(labelled_pages())


def test_fresh_pages_of_the_templates(found):
    pages = [TEMPLATES[k % len(TEMPLATES)](Writer(k)) for k in range(5000, 5000 + 10 * len(TEMPLATES))]
    kept, wrong, lost, total = found(pages), 0, 0, 0
    for k, page in enumerate(pages):
        blocks = [b["text"] for b in html_blocks.page_blocks(page)]
        wanted, had = Counter(b for b in blocks if b.startswith("+")), Counter(kept[k])
        total, wrong, lost = total + len(blocks), wrong + (had - wanted).total(), lost + (wanted - had).total()
    assert wrong + lost <= total * 0.02


def test_unmarked_pages_need_their_neighbours(found):
    """Equal short blocks: one between paragraphs, the others in a menu and at the foot."""
    long = "The river rose over the old wall in the night and the people of the town walked up the hill to wait for the light of the day"
    link = lambda t: f'<p><a href="/{t}">{t}</a></p>'
    page = f"{link('Home')}<p>A quiet place</p>{link('News')}{link('Contact')}<h1>Water</h1><p>{long}</p><p>A quiet place</p><p>{long}</p>{link('Imprint')}{link('Legal')}<p>A quiet place</p>"
    assert found([page])[0] == ["Water", long, "A quiet place", long]
