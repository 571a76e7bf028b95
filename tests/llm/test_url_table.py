import random
import re

import numpy as np
import pytest

from contactloom.llm import url_filter


def test_the_table_names_no_host_of_the_test_tables():
    hosts = {url_filter.split_url(u)[0] for u, _ in url_filter.labelled_urls()}
    copied = {"ththre", "therin", "tionsh", "ththan", "theron", "thernd", "spam-farm", "cheap-pills", "adult-x", "example"}
    assert not copied & {part for h in hosts for part in h.split(".")}


def logit(weights, bias, url):
    found = url_filter.features(*url_filter.split_url(url))
    return weights[found].sum() / np.sqrt(max(len(found), 1)) + bias


def test_hosts_held_out_by_host_are_rarely_blocked_wrongly():
    """Every other host of a word is left out with the word's urls; of those hosts, half of the name is known."""
    urls = url_filter.labelled_urls()
    hosts = sorted({url_filter.split_url(u)[0] for u, _ in urls})
    held = set(random.Random(1).sample(hosts, len(hosts) // 5))
    weights, bias = url_filter.train([u for u in urls if url_filter.split_url(u[0])[0] not in held])
    rate = {
        label: np.mean([logit(weights, bias, u) > 0 for u, y in urls if y == label and url_filter.split_url(u)[0] in held]) for label in (0, 1)
    }
    assert rate[0] < 0.05 and rate[1] > 0.8, rate


def test_words_that_no_row_has_say_little():
    weights, bias = url_filter.train(url_filter.labelled_urls(url_filter.UNWANTED[::2], url_filter.ORDINARY[::2]))
    rows = url_filter.labelled_urls(url_filter.UNWANTED[1::2], url_filter.ORDINARY[1::2])
    rate = {label: np.mean([logit(weights, bias, u) > 0 for u, y in rows if y == label]) for label in (0, 1)}
    assert rate[0] < 0.1 and rate[1] > rate[0], rate


def brute(url, weights, bias):
    """Host, path, rule and verdict from the contract's words, one url at a time."""
    i = (url or "").find("://")
    host, path = "", ""
    if i >= 0:
        rest = url[i + 3 :]
        k = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:k])
        path = re.split("[?#]", rest[k:], maxsplit=1)[0]
    best = None
    for h, p, v in url_filter.RULES:
        if (host == h or host[-len(h) - 1 :] == "." + h) and path[: len(p)] == p and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    if best:
        return host, path, best[0], best[1]
    grams = {f"{k}{t[i:i + n]}" for k, t in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in (3, 4, 5) for i in range(len(t) - n + 1)}
    columns = {__import__("zlib").crc32(g.encode("utf-8", "replace")) % (1 << url_filter.BITS) for g in grams}
    z = sum(weights[c] for c in columns) / len(columns) ** 0.5 + bias if columns and (host or path) else -1e9
    return host, path, None, "block" if z >= 0 else "allow"


def test_every_url_is_judged_as_by_brute_force(spark):
    rng = random.Random(3)
    part = lambda: rng.choice(["example.com", "www.example.com", "a.net", "net", "com", "x.org", "FREE-bets.org", "Casino.info", "ünï.de", ""])
    tail = lambda: rng.choice(["", "/", "/en/", "/en/x", "/es/", "/fr/a/b", "/EN/", "?q=/en/", "#/es/", "/x?y#z", "/é\n"])
    urls = [rng.choice(["http://", "https://", "://", "", "a://b://"]) + part() + tail() for _ in range(800)]
    urls += [None, "", "nothing", "http://", "http://" + "casino-" * 30_000 + "win.org/", "http://x.org/" + "a/" * 50_000]
    urls += urls[:50]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    weights, bias = url_filter.train(url_filter.labelled_urls())
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert found == {k: brute(u, weights, bias) for k, u in enumerate(urls)}
    assert {r.verdict for r in url_filter.judge(df.where("url IS NULL OR url = 'nothing'")).collect()} == {"allow"}


def test_too_large_a_table_is_an_error():
    with pytest.raises(ValueError):
        url_filter.train([("http://a.org/", 0)] * (url_filter.MAX_ROWS + 1))
