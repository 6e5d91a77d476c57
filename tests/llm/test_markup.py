"""Pages with broken mark-up, read by HTML's own rules, and pages that are deep or long."""

import time
from html.parser import HTMLParser
from random import Random

import pytest

from lakejobs.llm import htmltext


def texts(page):
    return [b.text for b in htmltext.blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>one</p><a title='it's'>link</a><p>two</p><p>don't</p>", ["one", "link", "two", "don't"]),
        ('<p class="a" b">Kept text</p>', ["Kept text"]),
        ("<p>one<!-- c --!>two</p><p>three</p>", ["onetwo", "three"]),
        ("<p>a<!-->b<!--->c</p><!-- x <p>d</p>", ["abc"]),
        ("<p>a</p><!doctype x><?php y ?></ z><p>b</></p>", ["a", "b"]),
        ("<p a = 'x>y' >s</p><p a='>'b=\">\">t</p><p =>u</p><p ==y>v</p><p a=>w</p>", ["s", "t", "u", "v", "w"]),
        ("<a href=/x/>b</a><b/>c</b><p>d<svg width=1 />e</p><p>f", ["bc", "d", "e", "f"]),
        ("a < b <3 </3> <p>c</p", ["a < b <3", "c"]),
        ("<p>a<script>x</scripty></script>b</p><iframe><p>c</iframe>", ["a", "b", "<p>c"]),
        ("<p>a</p><p b='c>d</p><p>e</p>", ["a"]),  # the quote never ends
        ("<DIV CLASS=X>a</DIV ><Br\n/>b", ["a", "b"]),
    ],
)
def test_broken_markup(page, want):
    assert texts(page) == want


def test_attributes_tell_words():
    assert htmltext.attribute_words("""title="class='not'" CLASS='Side-bar x' id=main"2 role data-class=no""") == ("side", "bar", "x", "main")
    (block,) = htmltext.blocks('<div class="nav" x"y><i id=q>t')
    assert block.path == (("div", ("nav",)), ("i", ("q",)))


def test_characters_are_those_of_the_standard_parser():
    """Text between random tags, whose attributes hold quotes and signs: no character is lost or added."""

    class All(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.found = []

        def handle_data(self, data):
            self.found.append(data)

    r = Random(4)
    attributes = ["", ' a="b>c"', " a='d\"e'", " a=f/g", " a", ' a="&lt;" b=\'\'', "\n\tclass = 'x y'", " data-x=1 /"]
    for _ in range(300):
        page = ""
        for k in range(r.randrange(1, 30)):
            page += r.choice(["<div{0}>", "<p{0}>", "</p>", "<li{0}>", "</div>", "<b{0}>", "</b>", "<td{0}>", "</ul>", "<!-- {0} -->", "<br{0}>", "<section{0}>", "<a{0}>"]).format(r.choice(attributes))
            page += r.choice([f"w{k}.", "&amp;", f"x{k} y", "é🎉", "'", '"', ""])
        plain = All()
        plain.feed(page)
        plain.close()
        squeeze = lambda t: "".join(t.split())
        assert squeeze("".join(texts(page))) == squeeze("".join(plain.found)), page


@pytest.mark.parametrize(
    "page",
    [
        "<div>x" * 100_000, "<div>" * 100_000 + "</span>" * 100_000 + "x", "<p><div>" + "<b>" * 100_000 + "<hr>x" * 20_000, "<table>" + "<span>" * 50_000 + "<td>x" * 50_000,
        "<a b='" * 100_000, "<!--" * 100_000, "<" * 200_000, "<ul>" + "<li>x" * 100_000, "<head><template>" + "<div>" * 100_000 + "x", "".join(f"<div class=c{i % 7}x{'abc' * (i % 9)}>x" for i in range(50_000)),
    ],
    ids=lambda p: f"{p[:6]}{len(p)}",
)
def test_deep_and_long_pages_take_linear_time(page):
    began = time.process_time()
    found = htmltext.blocks(page)
    htmltext.observations(found, htmltext._Slots())
    assert time.process_time() - began < 5


def test_training_ends_when_it_is_flat():
    slots = htmltext._Slots()
    data = [(htmltext.observations(f, slots), y) for f, y in htmltext.seed_labels()[:80]]
    short, long = htmltext.fit(data, epochs=60, flat=0.05), htmltext.fit(data, epochs=60, flat=0.0)
    assert abs(short.emit).sum() < abs(long.emit).sum()
    good = lambda m: sum(m.decode(x) == y for x, y in data)
    assert good(short) >= 0.95 * len(data)
