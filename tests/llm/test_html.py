import re
from html import unescape

from stripgrid.llm.html import SAMPLE_PAGES, blocks, induce, main_text, match, parse, tree
from stripgrid.llm.queries import op6_main_text


def plain(html):
    """The article of the given pages, read with regular expressions."""
    inner = re.search(r"<article>(.*?)</article>", html or "", re.S)
    parts = re.split(r"</?(?:p|h1|br|ul|li|div)[^>]*>", re.sub(r"<!--.*?-->", "", inner[1] if inner else ""))
    return " ".join(x for x in (" ".join(unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts) if x)


def test_query_matches_the_articles(spark, folder):
    pages = {x["page_id"]: x for x in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    found = op6_main_text(spark, folder).collect()
    assert len(found) == len(pages)
    for x in found:
        assert x["url"] == pages[x["page_id"]]["url"] and x["n_chars"] == len(x["text"])
        assert x["text"] == plain(pages[x["page_id"]]["html"])


def test_tree_matching():
    a, b = tree("<body><div><p>x</p></div><section><p>y</p></section></body>"), tree("<body><section><p>z</p></section></body>")
    size, pairs = match(a, b)
    assert size == 4 and [x.tag for x, _ in pairs][:2] == ["html", "body"]


PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><header class="top">Site</header>
<div id="side-menu"><a href="/">Home</a></div><div class="page"><div class="story"><h2>{title}</h2><p>Read &amp; tell:&nbsp;{body}</p>
<p>Written by our editors.</p><script>var a="</p>";</script></div><div class="user-comments"><p>First!</p></div></div>
<form><input value="x">Search</form><div class="cookie-notice">We use cookies</div><footer>Imprint</footer></body></html>"""


def test_wrapper_without_article_elements(spark):
    rows = [(i, f"http://host.example/{i}", PAGE.format(title=f"Title {i}", body=" ".join(f"w{i}x{j}" for j in range(80)))) for i in range(20)]
    found = {x["page_id"]: x["text"] for x in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(20):  # the byline is constant over the host, so it is template
        assert found[i] == f"Title {i} Read & tell: " + " ".join(f"w{i}x{j}" for j in range(80))


def test_copies_keep_their_text():
    page = PAGE.format(title="Same", body=" ".join(f"w{j}" for j in range(80)))
    assert '"fixed": []' in induce([page] * SAMPLE_PAGES)


def test_tolerant_parsing():
    assert blocks(parse("<p>a<b>b<br>c<p>d&lt;e</b><ul><li>f<li>g</ul>")) == ["ab c", "d<e", "f", "g"]
    assert blocks(parse("x</div></p>y<!-- no --><script>z</script> &copy;")) == ["xy ©"]


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "nonsense", ""), (2, "http://a/", "<p>" * 3000 + "deep"), (3, "http://a/", "plain &amp; simple")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as wrapper", "3 as text")
    found = main_text(frame).collect()
    assert sorted(x["text"] for x in found) == ["", "", "", "deep", "plain & simple"]
    assert main_text(frame.where("false")).count() == 0


def nested(depth, inner, tag="div"):
    return f"<{tag}>" * depth + inner + f"</{tag}>" * depth


def test_deep_containers(spark):
    """Time must not double with each level, and Python's stack must not end the page."""
    body = "".join(f"<p>Part {i} of a long and quiet story.</p>" for i in range(5))
    want = " ".join(f"Part {i} of a long and quiet story." for i in range(5))
    rows = [(d, f"http://deep{d}.example/{k}", f"<html><body>{nested(d, body.replace('quiet', f'quiet {k}'))}</body></html>") for d in (20, 60, 3000) for k in range(3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {(r.page_id, r.url[-1]): r.text for r in main_text(frame).collect()}
    assert found == {(d, str(k)): want.replace("quiet", f"quiet {k}") for d in (20, 60, 3000) for k in range(3)}


def test_each_slot_is_built_once():
    page = "<body>" + nested(40, "<div class=x><p>one</p></div><div class=x><p>two</p></div><section>three</section>") + "</body>"
    slots, waiting = [], [tree(page)]
    while waiting:
        slots.append(waiting.pop())
        waiting += slots[-1].children
    assert len({id(x) for x in slots}) == len(slots) == 1 + 1 + 40 + 2 + 1
    assert [len(x.nodes) for x in slots if x.key == "div x"] == [2]


def test_matching_of_deep_trees_counts_their_nodes():
    a, b = (tree(nested(2000, f"<p>{word}</p>")) for word in ("one", "two"))
    score, pairs = match(a, b)
    assert score == len(pairs) == 2002
