import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from contactloom.llm import chat_format, graph, html_extract, piece_tokenizer, simhash_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pieces_equal_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=piece_tokenizer.MODEL)
    rng = random.Random(5)
    letters = list("abcdefghinorst   \n.,0é漢ing the")
    texts = [None, "", " ", "Hello  world\n a", "\tab", "▁x y▁▁z", "<s> hi </s>", "a\x00b", "a\r\nb", "😀 漢字", "=" * 70, "a" * 3000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    texts += [library.decode([rng.randrange(3, 32000) for _ in range(12)]) for _ in range(300)]
    texts += ["very long text " * 20_000, "same", "same"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = piece_tokenizer.encode_and_check(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.ids == library.encode(text) and r.n_tokens == len(r.ids) and r.round_trip
    decoded = piece_tokenizer.decode(piece_tokenizer.encode(df).drop("text"))
    assert {r.doc_id: r.text for r in decoded.collect()} == {k: (t or "").replace("▁", " ") for k, t in enumerate(texts)}
    assert piece_tokenizer.encode(df.limit(0)).count() == 0


def test_caches_may_overflow(monkeypatch):
    with open(piece_tokenizer.MODEL, "rb") as f:
        vocab = piece_tokenizer.Vocabulary(f.read())
    words = ["the cat sat", "on a mat", "and the dog ran off", "quickly over there", "then home again"]
    want = [x.tolist() for x in vocab.encode(words)]
    monkeypatch.setattr(piece_tokenizer, "CACHE", 1)
    monkeypatch.setattr(piece_tokenizer, "PAIRS", 3)
    monkeypatch.setattr(piece_tokenizer, "CHUNK", 5)
    assert [vocab.encode([w])[0].tolist() for w in words] == want


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words)] if len(words) < 4 else [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_rows():
    rng, rows = random.Random(9), []
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        rows.append((10 * k, " ".join(words)))
        for c in range(1, 4):
            changed = list(words)
            changed[rng.randrange(300)] = "Changed"
            rows.append((10 * k + c, "\t".join(changed)))
    return rows + [(990, None), (991, " "), (992, "Ab"), (993, "aB  "), (994, "a b c d"), (0, rows[0][1]), (None, "lonely one"), (995, "long " * 50_000)]


def test_simhash_agrees_with_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    prints = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = sorted(((i is None, i or 0), p, (least.get(find(k)) is None, least.get(find(k)) or 0)) for k, ((i, _), p) in enumerate(zip(rows, prints)))
    found = simhash_dedup.decide(df).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.fp % 2**64, (r.component_id is None, r.component_id or 0)) for r in found) == want
    kept = simhash_dedup.keep_one(df)
    assert kept.columns == df.columns
    roots = {find(k) for k in range(len(rows))}
    assert kept.count() == len(roots)
    assert simhash_dedup.decide(df.limit(0)).count() == 0


def test_one_row_of_every_component_stays_whatever_its_id(spark):
    rng = random.Random(21)
    text = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(60))
    nulls, shared, copied = [text() for _ in range(3)], [text() for _ in range(2)], text()
    rows = [(None, t) for t in nulls] + [(7, t) for t in shared]
    # id 5 is a near copy of id 3 and also the id of an unrelated text; null ids lose against 3.
    rows += [(3, copied), (5, copied + "  "), (5, text()), (None, copied.upper()), (9, "same row"), (9, "same row")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    kept = sorted((str(r.doc_id), r.text) for r in simhash_dedup.keep_one(df).collect())
    assert kept == sorted((str(i), t) for i, t in [*rows[:6], rows[7], rows[9]])


@pytest.mark.parametrize(("prefix", "chunk"), [(8, 4_000_000), (9, 2000), (12, 500)])
def test_balls_meet_for_all_near_fingerprints(monkeypatch, prefix, chunk):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(simhash_dedup, "CHUNK", chunk)
    rng = random.Random(prefix)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(6):
            x = base
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << bit
            prints.add(x)
    every = np.array(sorted(prints), dtype=np.uint64)
    batch = pa.RecordBatch.from_arrays([pa.array(every.view(np.int64))], ["fp"])
    sent = list(simhash_dedup._send(prefix)([batch]))
    links = [(a % 2**64, b % 2**64) for r in simhash_dedup._receive(prefix)(sent) for a, b in zip(r.column("a").to_pylist(), r.column("b").to_pylist())]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)

    def components(pairs):
        parent = {p: p for p in prints}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return {p: find(p) for p in prints}

    assert components(links) == components([(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4])


def test_components_of_chains_and_stars(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(300, 299), (5, 5)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {found[k] for k in range(41)} == {0} and {found[k] for k in range(100, 160)} == {100} and found[300] == 299
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


CONVERSATIONS = "conv_id long, turn long, role string, text string, extra string"


def test_conversations_read_back(spark):
    rng = random.Random(4)
    parts = ["### ", "</turn>", "\\", "\\h", "<", "/turn>", "a", "é\n", "#", ":", " "]
    rows = [(c, t, rng.choice(["user", "assistant", "sy:st\nem", None]), rng.choice([None, "", "".join(rng.choice(parts) for _ in range(9))]), "x") for c in range(60) for t in range(c % 7)]
    rows += [(None, 0, "user", "x", "y"), (70, None, "assistant", "n", None), (71, 1, "user", "b", ""), (71, 1, "user", "a", ""), (71, 1, "user", "a", ""), (72, 0, "assistant", "t " * 50_000, "")]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    turns = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(c, []).append((role or "", text or ""))
    formatted = chat_format.format_conversations(df).cache()
    for r in formatted.collect():
        assert chat_format.parse(r.formatted) == turns[r.conv_id]
        assert r.rewritten_at is None and [tuple(x) for x in r.turn_spans][-1][1] == len(r.formatted)
    for r in chat_format.digests(formatted).collect():
        said = turns[r.conv_id]
        loss = "".join(t for role, t in said if role == "assistant")
        assert r.n_turns == len(said) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert formatted.count() == len(turns)
    assert chat_format.digests(chat_format.format_conversations(df.limit(0))).count() == 0


def test_rewriting_templates_are_detected():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert chat_format.render(turns)[3] is None
    assert chat_format.render(turns, lambda t: f"{len(t)}:" + chat_format.template(t))[3] == 0
    assert chat_format.render(turns, lambda t: ("*" if len(t) > 2 else "-") + chat_format.template(t))[3] == 2


PAGE = """<html><body><header>Top</header><div id="cookie-banner">We use cookies</div><nav>menu</nav>
<main><article><h1>T &amp; x</h1><p>One <a href=x>two</a>
 three<p>Four<div class="share">share</div><ul><li>a<li>b</ul><form>f<input name=a></form><aside>side</aside>
<table><tr><td>1<td>2</table><section class="comments"><p>c1</p></section></article></main><script>var x = "<p>";</script><footer>&copy;</footer>"""


def test_extraction_of_one_page():
    assert html_extract.extract(PAGE) == "T & x\nOne two three\nFour\na\nb\n1\n2"
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<p> </p>") == ""
    assert html_extract.extract("<div>plain <b>x</b>y</div>tail &lt;p&gt;&eacute;") == "plain xy\ntail <p>é"
    assert html_extract.extract("<p>cut off &am") == "cut off &am"
    assert html_extract.extract("<p>a</p><foo") == "a" and html_extract.extract("1 < 2") == "1 < 2"
    assert html_extract.extract("<div>" * 5000 + "deep") == "deep"


def site(spark):
    rows = []
    for k in range(30):
        extra = "<div class='x1'>Bread and crumbs of this site</div><div><span>Call us now</span></div>"
        shared = "<p>" + "a long passage that several documents of the site share " * 4 + "</p>"
        rows.append((k, f"http://h{k % 2}.org/{k}", f"<body>{extra}<article><h1>Title {k // 4}</h1><p>Text number {k // 4} of the page.</p>{shared}</article></body>", "x"))
        rows.append((100 + k, f"http://plain.org/{k}", f"<body>{extra}<div><p>Body number {k} has its own words.</p></div><div>Footer words</div></body>", "x"))
    rows += [(900, None, None, None), (901, "http://h0.org/", "", "x"), (902, "nothing", "<p>alone</p>", "x"), (902, "nothing", "<p>alone</p>", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string")


@pytest.mark.parametrize("limit", [500_000, 0])
def test_templates_of_a_site_are_removed(spark, limit):
    pages = site(spark)
    found = html_extract.main_text(pages, max_broadcast=limit).collect()
    assert len(found) == pages.count()
    for r in found:
        if r.page_id < 100:
            assert r.text.split("\n")[:2] == [f"Title {r.page_id // 4}", f"Text number {r.page_id // 4} of the page."]
            assert r.text.count("several documents") == 4
        elif r.page_id < 900:
            assert r.text == f"Body number {r.page_id - 100} has its own words."
        else:
            assert r.text == {900: "", 901: "", 902: "alone"}[r.page_id]
        assert r.n_chars == len(r.text)
    assert html_extract.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [500_000, 0])
def test_what_recurs_on_a_host_goes_inside_articles_too(spark, limit):
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    notice, table = "<p>Read our other pages</p>", "<table><tr><td>Call us</td></tr></table>"
    passage, copied = words(12), [words(60), words(12)]
    rows, want = [], {}
    for k in range(12):
        own = [words(30), words(20)] + ([passage] if k < 4 else [])
        rows.append((k, f"http://a.org/{k}", f"<article><h1>{own[0]}</h1>{notice}{table}" + "".join(f"<p>{t}</p>" for t in own[1:]) + "</article>"))
        want[k] = "\n".join(own)
    for k in range(12, 17):  # near copies of one article fill this host
        last = words(3)
        rows.append((k, f"http://b.org/{k}", "<main>" + "".join(f"<p>{t}</p>" for t in [*copied, last]) + "</main>"))
        want[k] = "\n".join([*copied, last])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.main_text(df, max_broadcast=limit).collect()} == want


def test_copies_of_one_page_are_no_template(spark):
    page = "<body><div><p>The same words on every page, which are an article all the same.</p></div></body>"
    df = spark.createDataFrame([(k, f"http://a.org/{k}", page) for k in range(20)], "page_id long, url string, html string")
    assert {r.n_chars > 0 for r in html_extract.main_text(df).collect()} == {True}


def test_extra_columns_are_carried(spark):
    df = site(spark).withColumn("n_chars", F.lit("x")).withColumn("more", F.lit(1))
    found = html_extract.main_text(df)
    assert dict(found.dtypes)["n_chars"] == "bigint" and found.where("more = 1").count() == df.count()
