"""URL filters, hard negatives and spelling variants: SQL and brute force, odd inputs."""

import os
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoforge.llm import hard_negatives, queries, spelling, url_filter
from chronoforge.llm.url_filter import ALLOW, BLOCK, Listed

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", ["op11_url_filter", "op12_hard_negatives", "op13_spelling_variants"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got = queries.queries()[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert want and plain(got.collect()) == plain(want)


# -- URL filters

URLS = [
    ("https://WWW.Example.com/en/x?a=1#t", "www.example.com", "/en/x", "www.example.com/en/", ALLOW), ("http://example.com/en/", "example.com", "/en/", "example.com/en/", BLOCK),
    ("http://a.b.example.com/en/1", "a.b.example.com", "/en/1", "example.com/en/", BLOCK), ("http://badexample.com/en/", "badexample.com", "/en/", "com/", ALLOW),
    ("http://example.com/EN/", "example.com", "/EN/", "com/", ALLOW), ("x://net/es/", "net", "/es/", "net/es/", BLOCK), ("http://a.net/fr/?q", "a.net", "/fr/", "net/fr/", BLOCK),
    ("http://example.com", "example.com", "", None, ALLOW), ("http://example.com?x=/en/", "example.com", "", None, ALLOW), ("http://ÄB.net#/es/", "Äb.net", "", None, ALLOW),
    ("://", "", "", None, ALLOW), ("no scheme", "", "", None, ALLOW), ("", "", "", None, ALLOW), (None, "", "", None, ALLOW), ("a://b://c/d", "b:", "//c/d", None, ALLOW),
    ("http://long.org/" + "a/" * 50_000, "long.org", "/" + "a/" * 50_000, None, ALLOW),
]


def test_url_rules_on_odd_urls(spark):
    pages = spark.createDataFrame([(k if k % 5 else None, u, "x", 1) for k, (u, *_) in enumerate(URLS * 2)], "page_id long, url string, verdict string, tokens int").repartition(3)
    got = url_filter.judged(pages, url_filter.RULES, [], ALLOW)
    assert plain(got.collect()) == plain((k if k % 5 else None, *rest) for k, (_, *rest) in enumerate(URLS * 2))
    assert url_filter.judged(pages.limit(0), url_filter.RULES, [], ALLOW).count() == 0


def labelled(spark, n=600):
    """example.org is poor under /ads/, good elsewhere; /ads/ is good on other hosts; odd rows beside them."""
    rows = []
    for k in range(n):
        host, part = ["example.org", "other.org", "third.net"][k % 3], ["ads", "news"][k // 3 % 2]
        poor = (host, part) == ("example.org", "ads") and k % 25 != 0
        rows.append((k, f"https://{host}/{part}/{k}?ref={k}", BLOCK if poor else ALLOW))
    return [*rows, (None, None, ALLOW), (n, "nothing", None), (n + 1, "", BLOCK)]


def tokens_of(url):
    if "://" not in (url or ""):
        return set()
    scheme, rest = url.split("://", 1)
    host, path, query = re.fullmatch(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?", rest).groups()
    number = lambda x: re.sub("[0-9]+", "#", x)
    return {f"s:{scheme}", *(f"h:{x}" for x in number(host).split(".") if x), *(f"p:{x}" for x in number(path).split("/") if x), *(f"q:{number(x.split('=')[0])}" for x in (query or "").split("&") if x)}


def test_mined_url_rules_against_brute_force(spark):
    rows = labelled(spark)
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string").repartition(4)
    mined, default = url_filter.mine(pages.select("page_id", url_filter.tokens(F.coalesce("url", F.lit(""))).alias("tokens"), "verdict"))
    told = [(tokens_of(u), v) for _, u, v in rows if v]
    of, of_verdict = Counter(), Counter()
    for tokens, v in told:
        for size in (1, 2, 3):
            for c in combinations(sorted(tokens), size):
                of[c] += 1
                of_verdict[c, v] += 1
    strong = {k: n / of[k[0]] for k, n in of_verdict.items() if n >= url_filter.SUPPORT * len(told) and n / of[k[0]] >= url_filter.CONFIDENCE}
    want = {k for k, c in strong.items() if not any(strong.get((p, k[1]), 0) >= c for size in (1, 2) for p in combinations(k[0], size) if len(p) < len(k[0]))}
    assert {(r.tokens, r.verdict) for r in mined} == want and default == ALLOW
    assert (("h:example", "p:ads"), BLOCK) in want
    got = {r.page_id: r.verdict for r in url_filter.judged(pages, [Listed(ALLOW, "third.net", "/")], mined, default).collect() if r.page_id is not None}
    assert got[0] == got[6] == BLOCK and got[3] == got[1] == got[7] == ALLOW and got[601] == ALLOW


def test_url_rules_without_labels_and_on_one_hot_url(spark):
    none = spark.createDataFrame([], "page_id long, tokens array<string>, verdict string")
    assert url_filter.mine(none) == ([], ALLOW)
    hot = spark.createDataFrame([(k, "http://h.org/" + "/".join(f"s{chr(97 + x)}" for x in range(24)), BLOCK) for k in range(50)], "page_id long, url string, verdict string")
    rules, default = url_filter.mine(hot.select("page_id", url_filter.tokens(F.col("url")).alias("tokens"), "verdict"))
    assert default == BLOCK and len(rules) == url_filter.ITEMS and all(len(r.tokens) == 1 for r in rules)


# -- hard negatives


def negatives_brute_force(rows):
    """rows: (vec_id, vector, label) that take part, with numbers for ties."""
    data = [(i, [int(np.floor(x * 256.0)) for x in v], (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for i, v, lab in rows]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    last, out = 1 << 63, []
    for k, (i, v, lab) in enumerate(data):
        if i is None or i % 100:
            continue
        others = sorted((-score(v, w), last if j is None else j, n) for n, (j, w, _) in enumerate(data) if n != k)
        label = {n: data[n][2] for _, _, n in others}
        for s, j, _ in [o for o in others if label[o[2]] == lab][:5]:
            some = [o for o in others if label[o[2]] != lab and 80 * -s <= 100 * -o[0] <= 100 * -s][:5]
            out += [(i, None if j == last else j, r + 1, None if x == last else x, -s, -t) for r, (t, x, _) in enumerate(some)]
    return out


@pytest.mark.parametrize("bucket", [8, 1024])
def test_hard_negatives_against_brute_force(spark, monkeypatch, bucket):
    for name, value in (("BUCKET", bucket), ("LEAST_BLOCK", 40), ("ANCHORS_A_BLOCK", 2), ("ROWS_A_BLOCK", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(4, 6))
    rows = [(k * 5, [float(x) for x in (centre[k % 4] + rng.normal(size=6) * 0.3) * rng.choice([0.1, 1, 3])], k % 4) for k in range(200)]
    rows += [rows[40], rows[20], (None, rows[20][1], 0), (None, rows[20][1], 1), (2000, [0.0] * 6, 1), (2100, [], 2), (2200, [1.5], 3), (1001, [900_000.5] * 6, 1)]
    rows += [(3000 + k, rows[20][1], 8) for k in range(30)] + [(4000 + k, rows[20][1], k % 2) for k in range(12)]  # many ties
    odd = [(100, None, 1), (200, rows[0][1], None), (300, [1.0, None], 1), (400, [float("nan")], 1), (500, [float("inf")], 1)]
    schema = "vec_id long, embedding array<double>, label int, n long, x string"
    table = spark.createDataFrame([(*r, 7, "y") for r in rows + odd], schema).repartition(3)
    want = negatives_brute_force(rows)
    assert len(want) > 100 and plain(hard_negatives.mine(table).collect()) == plain(want)
    assert hard_negatives.mine(table.limit(0)).count() == 0
    assert hard_negatives.mine(table.filter("vec_id = 400 OR vec_id = 5")).count() == 0


def test_hard_negative_pruning_leaves_rows_out(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 16)) * rng.uniform(0.2, 2, 4000)[:, None]
    whole = np.floor(x * 256).astype(np.int64)
    rows = hard_negatives.Rows(whole, np.arange(4000), np.arange(4000), np.zeros(4000, int))
    q = rows.x[7]
    true, size = np.sort(rows.x @ q)[-20], float(np.sqrt((q**2).sum()))
    got = [rows.candidates(q, size, b, float(true)) for b in rows.buckets]
    some = np.concatenate([g for g in got if g is not None])
    assert set(np.flatnonzero(rows.x @ q >= true)) <= set(some) and len(some) < 2000 and got[-1] is None


# -- spelling


def variants_brute_force(rows):
    total = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            total[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in total.items() if len(w) >= 7 and k >= 2}
    near = defaultdict(set)
    for a in n:
        near[a] |= {a[:k] + a[k + 1 :] for k in range(len(a))} & n.keys()
        for b in near[a]:
            near[b] = near[b] | {a}
    for a, b in combinations(n, 2):
        if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1:
            near[a] = near[a] | {b}
            near[b] = near[b] | {a}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def texts():
    """Words of one prefix and of one suffix, chains of forms, long runs, odd letters."""
    rng = np.random.default_rng(9)
    stems = ["interna", "internal", "internals", "externals", "recordé", "recordß", "recordÉ", "a" * 3000, "a" * 3001, "ab" * 8, "aab" + "ab" * 6]
    words = stems + ["prefix" + "".join(rng.choice(list("abc"), 3)) for _ in range(60)] + ["".join(rng.choice(list("abc"), 3)) + "suffixes" for _ in range(60)]
    rows = [(k, " ".join([*rng.choice(words, 60), "INTERNAL", "x1y", "résumésé,", "RésuméSé"])) for k in range(60)]
    rows += [(1000, "chainword " * 400), (1001, "chainwort " * 40), (1002, "chainwurt " * 4), (1003, "chainwurd chainwurd"), (1004, "chainwort1chainword")]
    return [*rows, (None, "chainword interna"), (None, None), (5, ""), (1000, "chainword " * 400)]


@pytest.mark.parametrize("letters", [300, spelling.LETTERS])
def test_spelling_variants_against_brute_force(spark, monkeypatch, letters):
    monkeypatch.setattr(spelling, "LETTERS", letters)
    monkeypatch.setattr(spelling, "COUNTED", 50)
    docs = spark.createDataFrame([(i, t, 1, "y", "z") for i, t in texts()], "doc_id long, text string, n int, word string, form string").repartition(3)
    want = variants_brute_force(texts())
    assert max(r[4] for r in want) > 10 and any(r[1] and r[1] != r[2] for r in want)
    assert plain(spelling.variants(docs).collect()) == plain(want)
    assert spelling.variants(docs.limit(0)).count() == 0
