"""HTML extraction against brute force on generated sites, with the odd pages that it must bear."""

import random
import time
from collections import defaultdict

import pytest

from quarry.llm import html_text
from tests.llm.test_operators import prose

PAGE = "page_id long, url string, html string"


def text_of(html):
    return "\n".join(html_text.Page(html).content())


def test_blocks():
    assert text_of("<html><body><div id=cookie-notice>no</div><div>Hello <b>wor</b>ld &lt;3<br>x<table><tr><td>a<td>b</table>t</div><form>f</form>3 < 4 <p>tail <a href=\"") == "Hello world <3 x\na\nb\nt\n3 < 4\ntail"
    assert text_of("<main><h2>T</h2><ul><li>a<li>b</ul><section class='comments'><article>no</article></section></main><aside>z") == "T\na\nb"
    assert text_of("<nav>m</nav><article><header><h1>T</h1></header><p><b>x.<br><p>y&nbsp;&amp;\n z</p><script>var t='</p>';</script><style>p{}</style></article><footer>f</footer>") == "T\nx.\ny & z"
    assert text_of("") == "" and text_of("<!-- a --><!DOCTYPE html>plain") == "plain" and text_of("<article>cut &am") == "cut &am"
    assert text_of("<div hidden>n</div><div style='display: none'>n</div><p>y</p>") == "y"
    assert text_of("<p title='a > b'>x</p><p title=5\">y</p><p =\"a>z") == "x\ny\nz"


def test_names_that_only_hold_a_word_of_furniture_stay():
    assert text_of("<article><div class='post has-comments'><p>Body text</p></div></article>") == "Body text"
    assert text_of("<article>a <span class='ad-free'>b</span><p id='reply-to-critics'>c</p><p class='ad'>d</p></article>") == "a b\nc\nd"
    assert text_of("<article><div class='ad-slot'>no</div><p>x</p><div id='comments'>no</div></article><div class='site-footer'>no</div>") == "x"


def test_legal_pages_lose_no_text():
    assert text_of("<head><title>T</title><p>Hello body text</p>") == "Hello body text" and text_of("<head><meta x>Bare text") == "Bare text"
    assert text_of("<html><head><title>T</title><link rel=x><script>var a</script><body><p>b") == "b"
    assert text_of("<form><article><p>In a form</p></article></form>") == "In a form"
    assert text_of("<body><form id=aspnetForm><nav>m</nav><h1>T</h1><p>Wrapped page</p><div><input><button>b</button></div><footer>f</footer></form>") == "T\nWrapped page"
    assert text_of("<p>x</p><form><p>Your mail</p><label>Name</label></form>") == "x"
    assert text_of("<main><p>Main text</p><article>teaser</article></main>") == "Main text\nteaser"
    assert text_of("<main><p>By me</p><article>A long article of many words</article></main>") == "A long article of many words"


def test_comments_and_hidden_articles_go():
    assert text_of("<article><p>Story</p><article class='comment'>nice</article></article>") == "Story"
    assert text_of("<article><p>Story</p></article><article class='user-comment' id=c1>nice</article><article itemprop=comment>x</article>") == "Story"
    assert text_of("<article hidden>old</article><article aria-hidden=true>o</article><main style='display:none'>z</main><article>new</article>") == "new"


def test_an_article_may_be_about_furniture():
    for inside in ("<div class='banner'>x</div>", "<section id='related'>x</section>", "<section id='sponsors'>x</section>", "<table class='menu'><tr><td>x</table>", "<menu><li>x</menu>"):
        assert text_of(f"<article><p>a</p>{inside}</article>") == "a\nx"
        assert text_of(f"<p>a</p>{inside}") == "a"


@pytest.mark.parametrize("html", [
    "<" + "a" * 8_000_000, "<a " * 1_000_000, '<a href="' * 500_000, "<a b='<" * 500_000, "<!--" + "-" * 4_000_000, "&" * 2_000_000, "<script>" + "<" * 4_000_000, "<b>" * 100_000 + "</i>" * 100_000,
    "<p><b>" + "<div></div>" * 100_000, "<div>" * 100_000 + "x", "<li>x" * 100_000,
], ids=lambda h: h[:8])
def test_long_pages_take_linear_time(html):
    began = time.time()
    html_text.Page(html).packed()
    assert time.time() - began < 20


def test_a_long_page_is_kept_whole(spark):
    words = prose(9, 200_000)
    table = spark.createDataFrame([(1, "http://long.example/", f"<article><p>{words}</p></article>")], PAGE)
    assert html_text.extract(table).first().text == words


def test_site_templates_go_only_where_they_recur(spark):
    badge = "<div class='x'>Read our <i>guide</i></div>"
    rows = [(k, f"http://h.example/{k}", f"<body>{badge}<p>page {k} {prose(k, 8)}</p></body>") for k in range(12)]
    rows += [(50, "http://other.example/", f"<body>{badge}<p>alone</p></body>"), (51, None, None), (52, "http://h.example/q", "<article><div class='x'>Read our <i>guide</i></div><p>in an article</p></article>"), (52, "http://h.example/q", "")]
    table = spark.createDataFrame([(*r, "t", "u") for r in rows], PAGE + ", text string, row_no string")
    out = html_text.extract(table).collect()
    got = {r.page_id: r.text for r in out if r.text}
    assert len(out) == len(rows) and all(got[k] == f"page {k} {prose(k, 8)}" for k in range(12))
    assert got[50] == "Read our guide\nalone" and got[52] == "Read our guide\nin an article"
    assert all(r.n_chars == len(r.text) for r in out)
    assert html_text.extract(table.limit(0)).count() == 0


def test_shapes_tell_furniture_whose_text_varies(spark):
    links = lambda k: "".join(f"<li><a href='/{prose(k + n, 1)}'>{prose(k + n, 1)}</a></li>" for n in range(2 + k % 4))
    page = lambda k, main: f"<body><div class='zq'>{prose(50 * k, 6)}</div><ul>{links(k)}</ul>{main}</body>"
    rows = [(k, f"http://a.example/{k}", page(k, f"<article><div class='lead'>{prose(k, 9)}</div></article>")) for k in range(20)]
    rows += [(100 + k, f"http://b.example/{k}", page(k, f"<div class='lead'>{prose(k, 9)}</div>")) for k in range(20)]
    got = {r.page_id: (r.text, r.n_template_blocks) for r in html_text.extract(spark.createDataFrame(rows, PAGE)).collect()}
    for k in range(20):
        assert got[k] == (prose(k, 9), 3 + k % 4)  # the box and the links
        # without an article only link lists can be told from prose by their shape
        assert got[100 + k] == (f"{prose(50 * k, 6)}\n{prose(k, 9)}", 2 + k % 4)


def test_copies_of_a_page_are_one_page(spark):
    page = f"<body><div><h1>copied</h1><p>{prose(700, 30)}</p></div></body>"
    rows = [(k, f"http://copies.example/{k}", page) for k in range(14)]
    out = html_text.extract(spark.createDataFrame(rows, PAGE)).collect()
    assert len(out) == 14 and {(r.text, r.n_template_blocks) for r in out} == {(f"copied\n{prose(700, 30)}", 0)}


def test_templates_need_a_share_of_a_large_host(spark):
    rows = [(k, f"http://large.example/{k}", f"<body><div>menu of all</div>{'<p>said on a few</p>' if k < 12 else ''}<p>page {k}</p></body>") for k in range(150)]
    got = {r.page_id: (r.text, r.n_template_blocks) for r in html_text.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == {k: (f"said on a few\npage {k}" if k < 12 else f"page {k}", 1) for k in range(150)}


@pytest.mark.parametrize("tag", ["article", "main", "div role=main"])
def test_templates_inside_the_content(spark, tag):
    quote = prose(701, 300)  # long prose stays
    page = lambda k: f"<body><div><{tag}><div><h1>page {k}</h1><p>Sign up <b>today</b></p>{'<p>quoted by some</p>' if k < 12 else ''}<p>{quote}</p></div><p>{prose(k, 8)}</p></{tag.split()[0]}></div></body>"
    rows = [(k, f"http://inside.example/{k}", page(k)) for k in range(30)] + [(40, "http://outside.example/", page(40))]
    got = {r.page_id: (r.text, r.n_template_blocks) for r in html_text.extract(spark.createDataFrame(rows, PAGE)).collect()}
    want = {k: ("\n".join([f"page {k}", *(["quoted by some"] if k < 12 else []), quote, prose(k, 8)]), 1) for k in range(30)}
    assert got == want | {40: (f"page 40\nSign up today\n{quote}\n{prose(40, 8)}", 0)}


def tree(r, depth):
    """(class, parts): a div whose parts are texts, each in a paragraph, or further trees."""
    parts = [tree(r, depth - 1) if depth and r.random() < 0.5 else f"t{r.randint(0, 9)}" for _ in range(r.randint(1, 3))]
    return f"c{r.randint(0, 2)}", parts


def rendered(node):
    return f"<p>{node}</p>" if isinstance(node, str) else f"<div class={node[0]}>" + "".join(map(rendered, node[1])) + "</div>"


def nodes(node):
    yield node
    if not isinstance(node, str):
        for part in node[1]:
            yield from nodes(part)


def leaves(node):
    return [node] if isinstance(node, str) else [x for part in node[1] for x in leaves(part)]


@pytest.mark.parametrize("broadcast", [html_text.BROADCAST_TEMPLATES, 0])
def test_counts_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(html_text, "BROADCAST_TEMPLATES", broadcast)
    r = random.Random(17)
    pages = [(k, f"h{k % 3}.example", [tree(r, 2) for _ in range(3)] + [f"own {k}"]) for k in range(120)]
    distinct, seen = defaultdict(set), defaultdict(set)
    for _, host, parts in pages:
        content = tuple(x for p in parts for x in leaves(p))
        distinct[host].add(content)
        for p in parts:
            for node in nodes(p):
                seen[host, str(node)].add(content)
    gone = {key for key, where in seen.items() if len(where) >= 10 and len(where) >= 0.1 * len(distinct[key[0]])}

    def left(node, host):
        return [] if (host, str(node)) in gone else [node] if isinstance(node, str) else [x for part in node[1] for x in left(part, host)]

    want = {k: "\n".join(x for p in parts for x in left(p, host)) for k, host, parts in pages}
    rows = [(k, f"http://{host}/{k}", "<body>" + "".join(map(rendered, parts)) + "</body>") for k, host, parts in pages]
    assert {x.page_id: x.text for x in html_text.extract(spark.createDataFrame(rows, PAGE)).collect()} == want
    assert gone and any(want[k] != "\n".join(x for p in parts for x in leaves(p)) for k, _, parts in pages)
