import html
import re

import pytest

from textloom.llm.html_extract import extract, extract_text

LOREM = "A plain sentence, with a comma and some more words in it. Another one follows; it is as long as that."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='<p>x</p>';</script></head><body>{body}</body></html>"


def test_sections_are_left_out():
    body = f"""<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/b>News, today</a></ul></nav>
<div class="cookie-notice">We use cookies, as all do. Accept them, please.</div>
<div id=content><h2>Title &amp; more</h2><p>{LOREM}<p>One.<p><b>{LOREM}</b>  &nbsp; x&lt;y<br>z <i>i</i>j<ul><li>{LOREM}<li>{LOREM}</ul></div>
<div class="sidebar"><p>{LOREM}</p></div><aside>{LOREM}</aside><section id="comments"><p>{LOREM} I agree, truly.</p></section>
<form><p>{LOREM}</p></form><noscript>{LOREM}</noscript><!-- {LOREM} --><footer><p>{LOREM}</p>&copy; 2020</footer>"""
    assert extract(page(body)) == "\n".join(["Title & more", LOREM, "One.", LOREM + " x<y z ij", LOREM, LOREM])


def test_paths_decide_without_marks():
    links = "".join(f"<p><a href=/{i}>Word {i}</a></p>" for i in range(30))
    body = f"<table><tr><td>{links}<td><div><h1>Head</h1>{''.join(f'<p>{LOREM}</p>' for _ in range(4))}</div></table><div>Short</div>"
    assert extract(page(body)) == "\n".join(["Head"] + [LOREM] * 4)


PARAGRAPH = ("One of the sentences, that make up a paragraph, ends here. " * 6).strip()
ITEMS = [f"{n} cups of fine flour" for n in "one two three four five six seven eight".split()]
TABLE = "<table><tr><th>Year<th>Place<tr><td>1920<td>Third<tr><td>1924<td>First</table>"
FIGURE = "<figure><img src=x.png><figcaption>The mill by night</figcaption></figure>"
SHORT = f"<ul>{''.join(f'<li>{i}' for i in ITEMS)}</ul>{TABLE}<dl><dt>Rye<dd>A grain</dl>{FIGURE}"
SHORT_TEXTS = [*ITEMS, "Year", "Place", "1920", "Third", "1924", "First", "Rye", "A grain", "The mill by night"]


@pytest.mark.parametrize("element", ["article", "main", "div role=main", "div itemprop=articleBody", "div id=text"])
def test_short_blocks_of_the_article_stay(element):
    body = f"<nav><ul><li><a href=/>Home</a></ul></nav><{element}><h1>Bread</h1>{f'<p>{PARAGRAPH}</p>' * 10}{SHORT}</{element.split()[0]}><ul><li><a href=/a>More of it</a><li><a href=/b>Other pages</a></ul><div>Short</div>"
    assert extract(page(body)) == "\n".join(["Bread", *[PARAGRAPH] * 10, *SHORT_TEXTS])


def test_what_lies_beside_an_article_in_main_is_judged():
    links = "".join(f"<li><a href=/{i}>Word {i}</a>" for i in range(10))
    body = f"<main><article><p>{PARAGRAPH}</p><ul><li>{ITEMS[0]}</ul></article><ul>{links}</ul></main>"
    assert extract(page(body)) == f"{PARAGRAPH}\n{ITEMS[0]}"


ROUND = f"""<header><h1>Site</h1></header><div class="sidebar"><p>{LOREM}</p></div>{{}}<section id=comments><article class=comment><p>{LOREM} I agree.</p></article></section>
<div class="newsletter"><form><p>{LOREM}</p></form></div><footer><p>{LOREM}</p></footer>"""


@pytest.mark.parametrize("wrapper", ["div id=page class='has-sidebar'", "div class=comments-open", "div class=header-fixed", "section class=layout-widget", "form id=aspnetForm", "div id=page"])
@pytest.mark.parametrize("element", ["article", "main", "div role=main", "div id=text"])
def test_names_of_wrappers_do_not_bar_the_page(wrapper, element):
    inner = f"<{element}><h1>Bread</h1>{f'<p>{PARAGRAPH}</p>' * 3}<div class=share>Share, please.</div></{element.split()[0]}>"
    body = f"<a href=#text>Skip to the text</a><{wrapper}>{ROUND.format(inner)}</{wrapper.split()[0]}>"
    got = extract(page(body)).split("\n")
    assert got[-4:] == ["Bread", *[PARAGRAPH] * 3] and set(got[:-4]) <= {"Skip to the text"}


def test_barred_sections_stay_barred_beside_content():
    section = f"<section id=comments><article><p>{LOREM}</p></article></section><div class=related><main><p>{LOREM}</p></main></div>"
    for element in ("article", "main", "div"):
        assert extract(page(f"<{element}><p>{PARAGRAPH}</p></{element}>{section}")) == PARAGRAPH
    assert extract(page(f"<div style='display:none'><article>{LOREM}</article></div><aside><article>{LOREM}</article></aside>")) == ""
    assert extract(page("<div class=breadcrumbs><a href=/>Home</a> <a href=/b>News</a></div>")) == ""


@pytest.mark.parametrize("text", [None, "", "   ", "<p></p>", "<script>x", "<!-- x", "<nav>a</nav>"])
def test_nothing(text):
    assert extract(text) == ""


def test_odd_markup():
    assert extract("just text") == "just text"
    assert extract("a < b and <p>c") == "a < b and\nc"
    assert extract("</div></p>x<b>y") == "xy"
    long = "<p>" + "word, " * 50_000
    assert extract(long) == ("word, " * 50_000).strip()
    assert extract("<div>" * 3000 + LOREM) == LOREM


def test_pages_of_known_form(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in extract_text(pages).collect():
        inner = re.search(r"(?s)<article>(.*)</article>", raw[r.page_id])[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>|<br>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_null_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, None, 5), (1, None, None, 5), (None, "u", "<p>t", 6)], "page_id long, url string, html string, text int")
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract_text(df).collect()), key=repr) == sorted([(1, None, "", 0), (1, None, "", 0), (None, "u", "t", 1)], key=repr)
    assert extract_text(df.limit(0)).count() == 0


def test_only_whole_attributes_are_names():
    for attributes in ('data-id="comment-5"', "title='class=sidebar'", "data-class=advert", 'aria-label="id=footer"'):
        assert extract(page(f"<div {attributes}><p>{PARAGRAPH}</p></div><div class=sidebar>{LOREM}</div>")) == PARAGRAPH


def test_unclosed_tags_and_quotes():
    assert extract('<p>one <b title="x>two</b> three</p>') == "one two three"
    assert extract("<p>one</p><a href='x") == "one\n<a href='x"
    assert extract("<div><!x <p>one</p>") == "one"
    assert extract("<script>var a = '<p>'; if (a < b) {}</SCRIPT ><p>one") == "one"
    assert extract("<svg/><p>one</p><svg><text>two</text></svg>") == "one"


@pytest.mark.parametrize("part", ["<div>", "<div class=ad>", "<a ", '<a "', '<a "x>" ', "<p><li>", "<ul><li>", "<!x ", "<!--", "<b x='", "</div ", "<script>"])
def test_time_follows_the_length(part):
    import time

    took = []
    for n in (5_000, 20_000):
        began = time.process_time()
        extract(part * n + f"<p>{PARAGRAPH}</p>")
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5, took


def plain(page_text):
    """The same text by explicit sets and lists, for pages of divs and paragraphs with classes."""
    import math

    tree = re.findall(r"<(/?)(div|p)(?: class=([a-z]+))?>([^<]*)", page_text)
    stack, rows = [], []
    for close, name, kind, text in tree:
        if close:
            stack.pop()
        else:
            stack.append(name + (f".{kind}" if kind else ""))
        if text.strip():
            rows.append((tuple(stack), text.strip()))
    bars = [sum(x.endswith((".sidebar", ".ad")) for x in path) for path, _ in rows]
    total = sum(len(t) for _, t in rows)
    home = min(d for d in set(bars) if sum(len(t) for b, (_, t) in zip(bars, rows) if b == d) > 0.02 * total)
    assert home == 0
    own, lengths = {}, {}
    for path in {p for p, _ in rows}:
        texts = [t for p, t in rows if p == path]
        marks = sum(len(re.findall("[,.;:!?]", t)) for t in texts)
        lengths[path] = sum(map(len, texts))
        own[path] = math.log1p(lengths[path] / len(texts)) * (0.25 + math.log1p(marks / len(texts)))
    fused = {}
    for path in own:
        mates = [p for p in own if p[:-1] == path[:-1]]
        near = sum(own[p] * lengths[p] for p in mates) / sum(lengths[p] for p in mates)
        fused[path] = (0.4 * own[path] + 0.6 * near) * 0.1 ** sum(x.endswith((".sidebar", ".ad")) for x in path)
    unnamed = [p for p in own if not any(x.endswith((".sidebar", ".ad")) for x in p)]
    mean = max(sum(fused[p] * lengths[p] for p in some) / sum(lengths[p] for p in some) for some in (own, unnamed))
    return "\n".join(t for p, t in rows if fused[p] >= 0.25 * mean)


@pytest.mark.parametrize("seed", range(30))
def test_against_brute_force(seed):
    import random

    r = random.Random(seed)

    def section(depth):
        out = []
        for _ in range(r.randint(1, 4)):
            kind = r.choice(["", "", " class=sidebar", " class=ad", " class=story", " class=x"])
            if depth < 3 and r.random() < 0.5:
                out.append(f"<div{kind}>{section(depth + 1)}</div>")
            else:
                out.append(f"<p{kind}>" + " ".join(r.choice(["word", "words,", "end."]) for _ in range(r.choice([1, 4, 60]))) + "</p>")
        return "".join(out)

    text = f"<div>{section(0)}<p>{LOREM * 4}</p></div>"
    assert extract(text) == plain(text)


SENTENCE = "The committee met on Tuesday, and it approved the plan; members, however, asked for changes. "


@pytest.mark.parametrize("attribute,shown", [
    ('data-title="the hidden world"', True), ('aria-label="the hidden cost"', True), ('data-note="display:none"', True), ('title="hidden"', True), ('aria-hidden="false"', True), ('style="color: red"', True), ('data-style="display:none"', True),
    ("hidden", False), ('hidden=""', False), ("aria-hidden=true", False), ('style="color:red; display : none"', False), ('style="VISIBILITY:hidden"', False),
])
def test_only_attributes_that_hide_hide(attribute, shown):
    body = f"<p>{SENTENCE * 3}</p>" * 3
    want = "\n".join([" ".join([SENTENCE.strip()] * 3)] * 3)
    assert extract(f"<html><body><div {attribute}>{body}</div></body></html>") == (want if shown else "")
    inside = extract(f"<article>{body}<p {attribute}>A gem, found.</p></article>")
    assert inside == want + "\nA gem, found." * shown


@pytest.mark.parametrize("times", [2, 5, 20])
@pytest.mark.parametrize("page", [
    "<body><div>%s</div><div class=comments>%s</div></body>", "<body><article>%s</article><div id='comments'>%s</div></body>", "<body><div class=post>%s<div class='comment-list'><ol>%s</ol></div></div></body>", "<body><main>%s</main><section class='remarks'>%s</section></body>",
])
def test_comments_longer_than_the_article_go(page, times):
    article = [f"{SENTENCE * 2}{k}" for k in range(4)]
    size = sum(map(len, article))
    comments = [f"I agree, really: this is a good point, thank you! {k}" for k in range(times * size // 50)]
    assert sum(map(len, comments)) > (times - 0.2) * size
    assert extract(page % ("".join(f"<p>{t}</p>" for t in article), "".join(f"<p>{t}</p>" for t in comments))) == "\n".join(article)
