import math
import time

import pytest

from gridloom.llm.html_extraction import _count, _densities, extract_main_text, main_text, parse

ARTICLE = "<h1>Title &amp; more</h1><p>First paragraph, long enough to be text &eacute;.</p><p>Second\n  paragraph with <a href='/x'>a link</a> and <b>bold</b>.<br>next</p>"
WANT = "Title & more\nFirst paragraph, long enough to be text é.\nSecond paragraph with a link and bold. next"


def page(body, head="<title>t</title><style>p{}</style><script>var a='</p>'</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_boilerplate_goes():
    around = "<nav><ul><li><a href='/a'>A</a></li></ul></nav><!-- c --><div class='ad top'>Buy this now, it is long advert text</div>"
    after = "<aside>Related things</aside><div id=\"comments\"><p>A reader comment of some length that is here</p></div><form><input><p>x</p></form><footer>&copy; someone</footer>"
    assert main_text(page(f"{around}<article>{ARTICLE}</article>{after}")) == WANT
    assert main_text(page(f"{around}<div>{ARTICLE}</div>{after}")) == WANT
    assert main_text(page(f"<header><h2>Site</h2></header>{around}<main>{ARTICLE}</main>{after}")) == WANT


def test_broken_markup():
    assert main_text(page("<article><h1>T</h1><p><b>one<br><p>two <i>x</p><p>three</article>")) == "T\none\ntwo x\nthree"
    assert main_text("<p>only text") == "only text"
    assert main_text("plain & simple < 3") == "plain & simple < 3"
    assert main_text("<article><p>a</p><script>if (a < b) document.write('<p>no</p>')") == "a"
    assert main_text("<div><p title='a > b'>kept</p></div><!-- open") == "kept"


def test_one_long_paragraph_does_not_hide_its_siblings():
    body = "<div><p>short one</p><p>" + "long text " * 300 + "</p><p>short two</p></div>"
    assert main_text(page(body)).split("\n")[0] == "short one" and main_text(page(body)).endswith("short two")


def test_a_class_word_does_not_cut_the_main_text():
    ad = "<div class='ad'>Buy this now</div><div class='widget'><p>Opening hours of the shop</p></div>"
    for wrap in ("div class='layout has-sidebar'", "div class='elementor-widget'", "div id='social-article'", "section class='related-work'", "div role='alert'"):
        end = wrap.split()[0]
        assert main_text(page(f"{ad}<{wrap}><article>{ARTICLE}</article></{end}>")) == WANT
        assert main_text(page(f"{ad}<{wrap}><main>{ARTICLE}</main></{end}>")) == WANT
        assert main_text(page(f"{ad}<{wrap}>{ARTICLE}</{end}>")) == WANT
        assert main_text(page(f"<div class='widget'>{ad}<{wrap}><div>{ARTICLE}</div></{end}></div>")) == WANT


def test_marked_text_beside_an_article():
    teaser = "<article><h2>Next</h2><p>More</p></article>"
    assert WANT.split("\n")[1] in main_text(page(f"<div class='has-sidebar'>{ARTICLE}<p>End.</p></div>{teaser}"))
    advert = "<div class='ad'>An advert that is longer than the article</div>"
    assert main_text(page(f"{advert}<article><h1>T</h1><p><b>Short<br></article>")) == "T\nShort"


def test_reader_comments_stay_cut():
    said = "".join(f"<article class='comment-body'><p>A reader comment of some length, number {k}, that is here</p></article>" for k in range(9))
    assert main_text(page(f"<div class='has-sidebar'><article>{ARTICLE}</article><div id='comments'>{said}</div></div>")) == WANT
    assert main_text(page(f"<main>{ARTICLE}<div id='comments'>{said}</div></main>")) == WANT
    assert main_text(page(f"<div class='widget' hidden><article>{ARTICLE}</article></div><p>left</p>")) == "left"


def test_edge_rows(spark):
    rows = [(1, "u", None, "own"), (2, None, "", "own"), (3, "u", "<nav>x</nav>", "own"), (3, "u", "<nav>x</nav>", "own"), (None, "u", page(ARTICLE), "own"), (4, "u", page(f"<article>{'<p>word</p>' * 20000}</article>"), "own"), (5, "u", "<div>" * 5000 + "deep", "own")]
    out = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r["page_id"], r["n_chars"]) for r in out] == [(1, 0), (2, 0), (3, 0), (3, 0), (None, len(WANT)), (4, 20000 * 5 - 1), (5, 4)]
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


HOSTILE = {
    "quotes": '<a ' + '"x" ' * 50_000,
    "open quotes": "<a x='> \"" * 50_000,
    "no ends": "<x" * 100_000,
    "values": '<a x="> "' * 50_000,
    "odd quotes": '<a ">' * 100_001,
    "nested": "<div>" * 100_000,
    "spans": "<span><article>" + "<div>" * 30_000 + "</span>" * 30_000,
    "items": "<ul><li>" + "<b>" * 30_000 + "<li>x" * 30_000,
    "spaces": "<a" + " " * 200_000 + "class",
    "comments": "<!--" * 100_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_are_read_in_linear_time(name):
    began = time.process_time()
    assert main_text("<p>hello</p>" + HOSTILE[name]).startswith("hello")
    assert time.process_time() - began < 5


def test_quotes_and_tags_without_an_end():
    assert main_text("<p title=\"a > b\">kept</p><p x='1' y=\"2\">two</p>") == "kept\ntwo"
    assert main_text('<p title=5" tall">kept</p>') == "kept"
    assert main_text('<p>one</p><p class="x>two</p>') == "one\ntwo"  # the quote is never closed
    assert main_text('<p>one</p><p class="x>two</p><p class="y">three</p>') == "one\nthree"  # it closes in the next tag
    assert main_text("<p>one</p><p class=x") == "one"


def test_densities_by_definition():
    body = f"<div><p>{'word ' * 30}</p><p>{'more ' * 20}<a href='/'>a link</a></p></div><ul><li><a href='/x'>one</a></li><li><a>two</a> and</li></ul>"
    root = parse(f"<html><body>{body}</body></html>")
    order = _count(root)
    found = next(n for n in order if n.name == "body")

    def below(node):
        return [x for kid in node.kids for x in (kid, *below(kid))]

    def chars(node):
        return sum(len("".join(p.split())) for p in node.parts if isinstance(p, str)) + sum(chars(k) for k in node.kids)

    def links(node):
        return [x for x in (node, *below(node)) if x.name == "a"]

    _densities(order, found)
    all_links, all_chars = sum(map(chars, links(found))), chars(found)
    for node in order:
        c, t = chars(node), max(1, len(below(node)))
        lc, lt = sum(map(chars, links(node))), len([x for x in links(node) if x is not node])
        assert (node.chars, node.total, node.link_chars, node.link_tags) == (c, len(below(node)), lc, lt)
        base = math.log(c / max(1, c - lc) * lc + all_links / all_chars * c + math.e)
        ratio = c / max(1, lc) * t / max(1, lt)
        want = 0.0 if not c or ratio <= 1 else c / t * (math.log(ratio) / math.log(base) if base > 1 else 1.0)
        assert math.isclose(node.density, want)


PARAGRAPH = "word and more text, with sense. " * 16
THREE, ONE = f"<p>{PARAGRAPH}</p>" * 3, f"<p>{PARAGRAPH}</p>"
LINES = "\n".join([PARAGRAPH.strip()] * 3)


@pytest.mark.parametrize("html", [
    f'<body><article data-title="The hidden life of trees">{THREE}</article></body>',
    f'<body><div class="w-full hidden lg:block">{THREE}</div></body>',
    f'<body><div style="font-display: none">{THREE}</div></body>',
    f'<body><div title="display: none; class=ad">{THREE}</div></body>',
    f'<body><form id="aspnetForm"><main><article>{THREE}</article></main></form></body>',
    f"<body><form><div>{THREE}</div></form><div>short foot</div></body>",
    f"<body><dialog open><div>{THREE}</div></dialog></body>",
    f"<body><article>{THREE}</article><aside><article>{ONE}</article></aside></body>",
    f"<body><div>{THREE}</div><form><p>write to us and leave your name, please</p></form></body>",
    f"<body><div hidden>{ONE}</div><div style='color:red; DISPLAY : NONE'>{ONE}</div><div>{THREE}</div></body>",
])
def test_wrappers_and_hidden_elements(html):
    assert main_text(html) == LINES


def test_a_text_split_over_siblings_is_whole():
    parts = f"<div>{THREE}</div><div class=ad>buy this now</div><div>{ONE * 2}</div>"
    want = "\n".join(["Head", LINES, *[PARAGRAPH.strip()] * 2])
    assert main_text(f"<body><nav>menu</nav><div id=a><h1>Head</h1>{parts}</div><div class=links><a href=/>one</a> <a href=/>two</a></div></body>") == want
    links = f"<div>{'<a href=/>another page of ours</a> ' * 40}</div>"
    assert main_text(f"<body><div>{THREE}</div>{links}<div>a short line</div></body>") == LINES


def test_first_of_several_attributes_and_hostile_ones():
    assert main_text('<body><div class=x class="ad">kept</div></body>') == "kept"
    began = time.process_time()
    assert main_text("<p>hello</p><a " + "x=\"'" * 50_000 + ">").startswith("hello")
    assert main_text("<p>hello</p><a " + "x='\"=" * 50_000 + ">").startswith("hello")
    assert time.process_time() - began < 5
