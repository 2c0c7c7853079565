import random
from html.parser import HTMLParser

from broadsheet.dims import BODY_DIV_CLASSES
from broadsheet.functions.html import html_text

LONG = "word " * 300


def text(apply, pages, limit=1000):
    return apply(lambda c: html_text(c, limit), pages)


def test_containers_in_order_of_preference(apply):
    article = f"<body><p>top</p><article><h1>T</h1>{LONG}</article></body>"
    div = f'<body>x<div class="a article-body b"><p>{LONG}</p>end</div>y</body>'
    unquoted = f"<body><div id=1 class=zn-body-text>{LONG}</div>y</body>"
    other_class = f"<body>x<div class='my-article-body'>{LONG}</div></body>"
    body = f"<html><head><title>no</title></head><body>x<p>{LONG}</body></html>"
    short_article = f"<body>{LONG}<article>short</article></body>"
    got = text(apply, [article, div, unquoted, other_class, body, short_article])
    words = LONG.strip()
    assert got == [
        f"T\n{words}", f"{words}\nend", words, f"x\n{words}", f"x\n{words}", f"{words}\nshort",
    ]


def test_limit_is_strict_and_does_not_count_joints(apply):
    exact = "<body><article>" + "<b>ab</b>" * 500 + "</article></body>"
    more = "<body><article>" + "<b>ab</b>" * 500 + "c</article></body>"
    assert text(apply, [exact])[0] == ""
    assert text(apply, [more])[0].split("\n")[-1] == "c"


def test_nothing_to_take(apply):
    assert text(apply, ["", None, f"<p>{LONG}</p>", "<body>short</body>"]) == [""] * 4


def test_nested_containers_and_unclosed_ones(apply):
    pages = [
        "<body><div class='l-container'>a<div>b<div>c</div></div>d</div>e</body>",
        "<body><article>a<article>b</article>c</article>d</body>",
        "<body><article>a<div>b</body>",
        "<body>a<p>b",
    ]
    assert text(apply, pages, 0) == ["a\nb\nc\nd", "a\nb\nc", "a\nb", "a\nb"]


def test_unseen_parts_and_tags(apply):
    pages = [
        "<body>a<script>if (x < 1) { '<article>' }</script>b<style>p{}</style>c"
        "<noscript>d</noscript>e<!-- <article>f</article> -->g</body>",
        "<body><a title='x > y' href=\"a>b\">link</a> 1 < 2 <br/>z</body>",
        "<body><articles>not an article</articles></body>",
        "<BODY><ARTICLE>Up</ARTICLE></BODY>",
        "<body>a<template><p>t</p></template>b<script>never closed </body>",
    ]
    assert text(apply, pages, 0) == [
        "a\nb\nc\ne\ng", "link\n1 < 2\nz", "not an article", "Up", "a\nb",
    ]


def test_entities(apply):
    page = (
        "<body>&lt;b&gt; &amp;amp; caf&eacute; &#233;&#xE9; &quot;q&quot; &nope; A&B &#150; "
        "&#x96; &#1114112; &copy 2 &middot;</body>"
    )
    assert text(apply, [page], 0) == [
        "<b> &amp; café éé \"q\" &nope A&B – – � © 2 ·"
    ]


def test_broken_markup_ends(apply):
    page = "<body><p class=\"" + "a='b' " * 5000 + "text"
    assert text(apply, [page], 0)[0].endswith("text")


def test_entities_decoys_and_ruby(apply):
    cases = [
        ("<body><p>it&apos;s&comma; &NotEqualTilde;x</p></body>", "it's, \u2242\u0338x"),
        ("<div data-x=\" class='article-body'\">no</div><body>yes</body>", "yes"),
        ("<body><ruby>A<rp>(</rp><rt>b</rt><rp>)</rp></ruby>C<ruby>D<rt>e</ruby></body>", "A\nC\nD"),
        ("<div id='a>b' class='x article-body'>in</div><p>out</p>", "in"),
    ]
    got = apply(lambda html: html_text(html, 0), [html for html, _ in cases])
    assert got == [found for _, found in cases]


class ByStack(HTMLParser):
    """Text pieces of each container, read with the standard library's tag scanner."""

    EMPTY = {"br", "img", "hr", "input", "meta", "link"}

    def __init__(self):
        super().__init__()
        self.open, self.found, self.serial = [], {}, 0

    def handle_starttag(self, tag, attrs):
        self.serial += 1
        css = (dict(attrs).get("class") or "").split()
        for kind in [tag] if tag in ("article", "body") else [c for c in BODY_DIV_CLASSES if tag == "div" and c in css]:
            if kind not in self.found:
                self.found[kind] = (self.serial, [])
        if tag not in self.EMPTY:
            self.open.append((tag, self.serial))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self.EMPTY:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag in [name for name, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        for serial, pieces in self.found.values():
            if any(serial == s for _, s in self.open) and data.strip():
                pieces.append(data.strip())


def by_stack(page, limit):
    parser = ByStack()
    parser.feed(page)
    parser.close()
    for kind in ("article", *BODY_DIV_CLASSES, "body"):
        pieces = parser.found.get(kind, (0, []))[1]
        if len("".join(pieces)) > limit:
            return "\n".join(pieces)
    return ""


def test_misnested_markup(apply):
    cases = [
        ("<body><section><article>a</section>b</article>c</body>", "a"),
        ("<div><article>a<p>b<div>c</p>d</div>e</article>", "a\nb\nc\nd"),
        ("<body><article>a<div>b</article>c</div></body>", "a\nb"),
        ("<body><article>a</p></span>b</article></body>", "a\nb"),
        ("<body>a<article/>b<div class=article-body />c</body>d", "a\nb\nc"),
        ("<body><div class='article-body'>a<div/>b<br>c<img src=x/>d</div>e</body>", "a\nb\nc\nd"),
        ("<body><a title='<article>x'>y</a><article>z</article></body>", "z"),
        ("<body><p>a<p/>b</p>c<I class=x>d</i >e<b>f<c</b></p>g</body>", "a\nb\nc\nd\ne\nf\ng"),
        ("<p><body>a<div title=\"<b>\" class='x'></b>b</div>c<p/>d</p>e</p>f</body>", "a\nb\nc\nd"),
        ("<body>a</body>b<p>c</p>", "a"),
        ("<body><div class='Article-Body'>A</div>b<div class='article-body'>B</div></body>", "B"),
    ]
    assert text(apply, [page for page, _ in cases], 0) == [found for _, found in cases]
    assert [by_stack(page, 0) for page, _ in cases] == [found for _, found in cases]


def test_random_markup_against_a_parser(apply):
    rng = random.Random(7)
    tags = ["<body>", "</body>", "<article>", "</article>", "<div>", "<div class='x article-body'>", "<DIV CLASS=\"l-container\n z\">",
            "</div>", "</DIV>", "<p>", "</p>", "<p/>", "<br>", "<br/>", "</br>", "<div/>", "<section id=a>", "</section>", "<div class=zn-body-text>",
            "<div title=\"class='article-body'\">", "<img src=b alt='</div>'>", "<article/>", "<section data-x=y/>",
            "<b>k</b>", "<i title='>'> l </I>", "<b/>m</b>"]
    pages = ["".join(rng.choice(tags) + rng.choice(["", " ", f"w{i} "]) for i in range(rng.randint(1, 60))) for _ in range(400)]
    for limit in (0, 20):
        assert text(apply, pages, limit) == [by_stack(page, limit) for page in pages]


def test_many_unclosed_elements(apply):
    page = "<body>" + "<p>x" * 20000 + "</body>y"
    assert text(apply, [page], 0) == ["\n".join("x" * 20000)]
