"""URL filter: explicit rules, else logistic regression on hashed character n-grams.

The classifier is trained on the driver from a small labelled URL table (by default
the one below, at most ``MAX_ROWS`` rows; more are an error) on hashed 3- to 5-grams of
host and path, kept apart by a prefix.  Rules decide before it: a rule holds for its host
and all subdomains if the path starts with the rule's; the longest wins.

The default table is made of general English words of unwanted and of ordinary sites, put
into common layouts.  Most urls are ordinary, so unwanted rows weigh ``PRIOR`` of all, and a url that
resembles neither kind is allowed.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.
Path: from there up to ``?``, ``#`` or the end.

Defined cases: a null url and one without ``://`` have an empty host and path, fit no
rule, show no n-gram of a name, and are allowed (score 0); urls of any length are judged
whole; equal urls get equal verdicts; extra columns are carried and replaced where an
output column has their name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import without
from contactloom.shipping import ship

#: (host, path, verdict); the query's fixed rules.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
BITS = 14
MAX_ROWS = 5000
ORDERS = (3, 4, 5)
#: Share of unwanted urls that the fit assumes.
PRIOR = 0.2

# General words of unwanted and of ordinary sites.
UNWANTED = (
    "adult ads banner bet betting bets bingo bonus bride cams cash casino cheap clickbait clicks counterfeit crack dating deals debt diet "
    "drugs erotic escort fake followers forex free gambling giveaway hack hookup jackpot keygen loans lottery lucky malware meds "
    "millionaire miracle naked nude offers payday phishing pills pirate poker popup porn prize promo replica scam serial sex slots spam "
    "steroids sweepstakes torrent track tracker viagra virus warez webcam win winner xxx"
).split()
ORDINARY = (
    "academy airport archive art astronomy atlas bakery bank biology blog books bridge bulletin camera castle chemistry choir church city "
    "clinic climate club coffee college cooking council court culture dentist design dictionary education encyclopedia energy "
    "engineering family farm festival film football forest forum foundation garden geography gallery government grammar guide harbour health "
    "history hospital house insurance institute island journal journey kitchen laboratory language law library magazine maps market "
    "mathematics medicine memorial mountain museum music nature news observatory orchestra painting park physics pictures poetry police "
    "post press radio railway recipes research review river road school science sea software sport station stories student studio "
    "teacher theatre times town trail travel university valley village water weather winter woman wood world writing youth"
).split()
_LAYOUTS = [
    ("http://{}.org", "/page/{}"),
    ("https://www.{}.com", "/articles/{}.html"),
    ("https://{}.net", "/category/{}/"),
    ("http://m.{}.info", "/view?id={}"),
    ("https://blog.{}.co.uk", "/{}#top"),
]


def labelled_urls(unwanted=UNWANTED, ordinary=ORDINARY) -> list[tuple[str, int]]:
    """(url, 1 for block) rows: pairs of words of a kind as a host, and single words as a path's first part."""
    rows = []
    for label, names in ((1, unwanted), (0, ordinary)):
        for i, word in enumerate(names):
            for j, (host, path) in enumerate(_LAYOUTS):
                other = names[(i * 7 + j * 13 + 5) % len(names)]
                name = [word, f"{word}-{other}", f"{other}{word}", f"{word}{other}", f"the-{word}"][j]
                rows.append((host.format(name) + path.format(17 + 37 * i + 101 * j), label))
    return rows


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of one url, as the columns have them (for the training table)."""
    rest = (url or "").partition("://")[2]
    cut = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lower, slash + path


def features(host: str, path: str) -> list[int]:
    """Distinct hashed n-grams of host and path."""
    found = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in ORDERS:
            for i in range(len(text) - n + 1):
                found.add(zlib.crc32(f"{kind}{text[i : i + n]}".encode("utf-8", "replace")) & ((1 << BITS) - 1))
    return sorted(found)


def _sparse(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of length-normalised n-gram vectors."""
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    column = np.fromiter((c for r in rows for c in r), dtype=np.int64, count=int(sizes.sum()))
    return row, column, 1 / np.sqrt(np.maximum(sizes, 1))[row]


def train(urls: list[tuple[str, int]], epochs: int = 400, rate: float = 3.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient steps; memory in proportion to the n-grams of the table."""
    if len(urls) > MAX_ROWS:
        raise ValueError(f"the labelled table may have {MAX_ROWS} rows")
    row, column, value = _sparse([features(*split_url(u)) for u, _ in urls])
    y = np.array([label for _, label in urls], dtype=float)
    weight = np.where(y == 1, PRIOR / max(y.mean(), 1e-9), (1 - PRIOR) / max(1 - y.mean(), 1e-9)) if 0 < y.sum() < len(y) else np.ones(len(y))
    w, b = np.zeros(1 << BITS), 0.0
    for _ in range(epochs if len(y) else 0):
        d = weight * (1 / (1 + np.exp(-(np.bincount(row, weights=value * w[column], minlength=len(y)) + b))) - y)
        w -= rate * (np.bincount(column, weights=value * d[row], minlength=len(w)) / len(y) * 10 + decay * w)
        b -= rate / 4 * float(d.mean())
    return w, b


def scorer(weights: np.ndarray, bias: float):
    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        for key in zip(host, path, strict=True):
            if key not in known:
                found = features(*key) if key != ("", "") else []
                z = float(weights[found].sum()) / np.sqrt(max(len(found), 1)) + bias
                known[key] = float(1 / (1 + np.exp(-np.clip(z, -30, 30)))) if found else 0.0
        return pd.Series([known[k] for k in zip(host, path, strict=True)])

    return score


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest fitting rule, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # later, longer ones overrule
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules=RULES, urls: list[tuple[str, int]] | None = None, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, score and verdict."""
    weights, bias = train(labelled_urls() if urls is None else urls)
    df = ship(pages).select(
        *without(pages, {"host", "path", "rule", "score", "verdict"}),
        host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
    )
    df = df.withColumn("score", scorer(weights, bias)("host", "path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_score = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return df.withColumns({"rule": rule, "verdict": F.coalesce(verdict, by_score)})


def query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "score", "verdict")
