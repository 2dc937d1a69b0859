"""Main text of pages: odd markup, wrappers, and pages on which only density tells the text from the rest."""

import time

import pytest

from hearthgrid.llm import html_text

LONG = "This is a paragraph of running text that goes on for a good while, so that it has many characters for its one tag."
MORE = "Here the story goes on, and nothing in it is a link, a label or a button; it is simply more of what was said before."
#: No article or main element and no telling class: teasers, labels and the story.
PLAIN = (
    "<html><body><div><div><a href=1>First thing to look at today</a></div><div><a href=2>Second thing to look at today</a></div><div><a href=3>Third thing to look at</a></div></div>"
    f"<div><div><p>{LONG}</p><p>{MORE}</p><p>{LONG}</p></div></div>"
    "<div><span>Up</span> <span>Down</span> <span>Left</span> <span>Right</span> <span>12</span> <span>13</span> <span>14</span></div></body></html>"
)


def test_density_tells_the_story_from_teasers_and_labels(monkeypatch):
    want = f"{LONG} {MORE} {LONG}"
    assert html_text.extract(PLAIN) == want
    monkeypatch.setattr(html_text, "density", lambda n, ratio: 1.0 if n.chars else 0.0)
    assert html_text.extract(PLAIN) != want


def test_the_densest_of_two_columns_is_taken_with_its_head():
    column = "".join(f"<div><a href={i}>Teaser number {i} for another page</a> <span>new</span></div>" for i in range(9))
    page = f"<body><div>{column}</div><div><h2>The head</h2><div><p>{LONG}</p><p>{MORE}</p></div></div></body>"
    assert html_text.extract(page) == f"The head {LONG} {MORE}"


@pytest.mark.parametrize(
    "open_, shut",
    [
        ("<div class='layout with-sidebar'>", "</div>"),
        ("<div class='no-sidebar content'>", "</div>"),
        ("<div id='page-header-wrap'>", "</div>"),
        ("<form action=x>", "</form>"),
    ],
)
def test_a_class_word_alone_removes_no_wrapper(open_, shut):
    side = "<div class=sidebar><p>Aside words</p></div>"
    assert html_text.extract(f"<body>{open_}<article><p>{LONG}</p></article>{side}{shut}") == LONG
    assert html_text.extract(f"<body><nav><a href=x>Menu</a></nav>{open_}<div><p>{LONG}</p><p>{MORE}</p></div>{side}{shut}") == f"{LONG} {MORE}"


def test_odd_markup():
    assert html_text.extract("<p class='it's'>Hello there, some text</p><p>I don't mind</p><p>third</p>") == "Hello there, some text I don't mind third"
    assert html_text.extract('<p>one</p><p title="x>second') == "one"  # the tag never ends
    assert html_text.extract("foo<img src=x>bar") == "foobar"
    assert html_text.extract("<nav class=x/>Menu</nav>text") == "text"
    assert html_text.extract("a < b &amp; 3<4 <!-- not > here --> c") == "a < b & 3<4 c"
    assert html_text.extract("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>") == "a b 1 2 3"
    assert html_text.extract("<p>a</b></i></div>b</p>c") == "ab c"
    assert html_text.extract("<SCRIPT>var a='</p>'</script ><p hidden>no</p><p style='display : none'>no</p><p>yes") == "yes"


@pytest.mark.parametrize("part", ['<a "', "<div>", "<b><i>", "<li><b>", "<!--", "<script>", "</x>", "<p><a href=x>t</a>", "<p a=b c='d' e>", "&amp;&"])
def test_a_megabyte_of_anything_is_read_in_linear_time(part):
    began = time.perf_counter()
    html_text.extract(part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 20


def test_odd_rows(spark):
    rows = [(None, None, None, "x"), (1, "u", "", "x"), (2, "u", f"<p>{LONG}", "x"), (2, "u", f"<p>{LONG}", "x"), (3, None, "  \n", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_text.extract_main_text(df).collect()), key=repr)
    assert got == sorted([(None, None, "", 0), (1, "u", "", 0), (2, "u", LONG, len(LONG)), (2, "u", LONG, len(LONG)), (3, None, "", 0)], key=repr)
    assert html_text.extract_main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [10, 600, 30_000])
def test_boilerplate_is_left_out_at_any_depth(depth):
    words = "Plain words of a long story that somebody wrote about the sea. " * 20
    page = "<body>" + "<div>" * depth + f"<nav>MENU LINKS HERE</nav><article><header>HEAD</header><p>{words}</p></article>" + "</div>" * depth + "<footer>FOOT</footer></body>"
    assert html_text.extract(page) == words.strip()


def test_end_tags_cost_no_walk_up_the_tree():
    page = "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000 + "text"
    began = time.perf_counter()
    assert html_text.extract(page) == "text"
    assert time.perf_counter() - began < 20
