import random
import re
import time
from collections import Counter

import pytest

from contactloom.llm import html_extract
from contactloom.llm.html_extract import Page, extract

SCHEMA = "page_id long, url string, html string"


def host(url):
    return re.split("[/?#]", (url or "").partition("://")[2])[0].lower()


def plain_text(subtree):
    """A subtree as nested tuples of tag and texts: what the hash stands for, without hashing."""
    parts = [subtree.tag]
    for x in subtree.children:
        if isinstance(x, str):
            parts.extend([" ".join(x.split())] if x.split() else [])
        elif x.size:
            parts.append(plain_text(x))
    return tuple(parts)


def brute(rows):
    """Texts of all pages, with templates counted in dictionaries of whole subtrees."""
    seen, pages = set(), []
    for _, url, html in rows:
        page, site = Page(html), host(url)
        pages.append((page, site))
        if html:
            seen.add((site, None, True, page.outside()))
            for x, _, inside in page.candidates():
                seen.add((site, plain_text(x), inside, page.outside(x) if inside else tuple(page.said)))
    n = Counter(row[:3] for row in seen)
    total = Counter()
    for (_, subtree, inside), k in n.items():
        if inside:
            total[subtree] += k
    out = {}
    for (page_id, _, _), (page, site) in zip(rows, pages, strict=True):
        template = set()
        for x, h, inside in page.candidates():
            key = site, plain_text(x), inside
            often = n[key] >= 3 and (not inside or (n[key] >= 0.5 * n[site, None, True] and n[key] * 2 > total[key[1]]))
            if often:
                template.add((h, inside))
        out[page_id] = "\n".join(page.blocks(template))
    return out


def made(seed, n=120):
    rng = random.Random(seed)
    words = lambda k: " ".join(f"w{rng.randrange(500)}" for _ in range(k))
    menus = [f"<ul>{''.join(f'<li><a href=/{k}>{words(1)}</a>' for k in range(3))}</ul>" for _ in range(4)]
    notices, passages, rows = [f"<p>{words(4)}</p>" for _ in range(4)], [f"<p>{words(20)}</p>" for _ in range(3)], []
    for k in range(n):
        h = rng.randrange(4)
        body = [f"<p>{words(rng.randrange(3, 30))}</p>" for _ in range(rng.randrange(1, 5))]
        if rng.random() < 0.4:
            body.insert(0, rng.choice(passages))
        if rng.random() < 0.8:
            body.insert(rng.randrange(len(body) + 1), notices[h])
        kind = rng.choice(["article", "div", "main"])
        if rng.random() < 0.2 and rows:
            rows.append((k, rows[-1][1], rows[-1][2]))
            continue
        rows.append((k, f"http://H{h}.org/{k}", f"<body><div>{menus[h]}</div><{kind}>{''.join(body)}</{kind}><div><span>{words(2) if rng.random() < 0.5 else 'end ' + str(h)}</span></div>"))
    return [*rows, (n, None, None), (n + 1, "x", ""), (n + 2, "http://h0.org", "<p>only</p>")]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_texts_equal_a_brute_force_version(spark, limit):
    rows = made(5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert {r.page_id: r.text for r in html_extract.main_text(df, max_broadcast=limit).collect()} == want
    alone = {page_id: extract(html) for page_id, _, html in rows}
    assert sum(alone[k] != want[k] for k in want) > 60  # the counts decide, not the tags


def test_a_part_seen_on_many_pages_goes_without_any_tag_or_class_that_names_it(spark):
    rng = random.Random(2)
    words = lambda k: " ".join(f"w{rng.randrange(9000)}" for _ in range(k))
    rows, want = [], {}
    for k in range(20):
        text = [words(15), words(25)]
        rows.append((k, "http://a.org/", f"<body><div><b>Our site</b> since 1999</div><div><p>{text[0]}<p>{text[1]}</div><div>Call {7 + k % 2}</div>"))
        want[k] = "\n".join(text)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.page_id: r.text for r in html_extract.main_text(df).collect()} == want


def test_several_articles_and_words_that_only_look_like_parts():
    assert extract("<article><p>one</article><div>x</div><article>two</article>") == "one\ntwo"
    assert extract('<article><div class="side-effects">kept</div><div class="related-work">too</div></article>') == "kept\ntoo"
    assert extract('<article>a</article><article class="comment">b</article>') == "a"
    assert extract('<body><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul><div class="cookieConsent cookie-notice">c</div><p>text</p>') == "text"
    assert extract('<div><ul><li><a>x</a><li>y<li><a>z</a></ul><p>text</p></div>') == "x\ny\nz\ntext"


def test_quotes_that_never_close_and_quotes_with_brackets():
    assert extract('<p class="x>Hello</p><p>World</p>') == "Hello\nWorld"
    assert extract('<p title="a > b">x</p><p title=\'<p>\'>y</p>') == "x\ny"
    assert extract("<p>it's <b>\"so\"</b> <i x=1>") == "it's \"so\""


@pytest.mark.parametrize(
    "html",
    [
        '<a title="x ' * 20_000, "<a title='x \">" * 20_000, "<div>" * 20_000 + "</span>" * 20_000 + "x", "<div>ab" * 20_000, "<b><article>" + "</b>" * 40_000,
        "<ul>" + "<li>x" * 20_000, "<table>" + "<tr><td>x" * 15_000, "<p>a<b>" * 15_000, "<!--" * 50_000, "<script>" * 50_000, "< " * 100_000, "<p>" + "word " * 200_000,
    ],
)
def test_long_and_broken_pages_take_time_in_proportion(html):
    seconds = []
    for part in (html[: len(html) // 4], html):
        start = time.process_time()
        page = Page(part)
        for x, _, _ in page.candidates():
            page.outside(x)
        page.blocks()
        seconds.append(time.process_time() - start)
    assert seconds[1] < 8 * seconds[0] + 0.5
