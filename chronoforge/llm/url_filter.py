"""URL filters: a list of host and path rules, and for all other URLs rules that FP-growth mines from labelled ones.

* The list: a rule names a host and a start of the path; it fits that host and all its subdomains; the longest wins.
* Tokens of a URL: scheme, labels of the host, segments of the path, keys of the query, the fragment; runs of digits
  become ``#``. The same native expression serves mining and matching.
* Mining: Spark's FP-growth over labelled rows, each with its verdict as one more item. Of the frequent itemsets that
  hold a verdict, those of at most ``LONGEST`` tokens are rules ``tokens -> verdict``; rules below ``CONFIDENCE`` go, and so
  do those that a rule with a part of their tokens equals or beats. At most ``MOST_RULES`` rules stay, the best ones.
* Matching: an inverted index from tokens to rules; a rule is met when all its tokens are. The rule of highest confidence,
  then support, then fewest tokens, then tokens in order speaks; without one, the more frequent verdict of the labelled rows does.

Learns from about ``LABELLED`` labelled rows at most (smallest hashes of the page id), and of each from its ``ITEMS`` most
frequent tokens, so that neither the rows nor the itemsets of one pass the driver or a task without a bound. Matching
knows no such bounds: every URL is judged by all its tokens.

Cases: a null URL or one without ``://`` has no host, no path and no token, and gets the default verdict; a rule's path ``/``
does not fit an empty path; a null label is not learned from, and a page labelled twice counts twice; without labelled rows
all is allowed; a null page_id is judged like any other; repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from itertools import combinations
from typing import NamedTuple

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoforge.llm.common import temporary, written

ALLOW, BLOCK = "allow", "block"
SUPPORT, CONFIDENCE, LONGEST = 0.01, 0.6, 3
LABELLED, ITEMS, MOST_RULES = 200_000, 12, 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a verdict is called among the items.
VERDICT = "verdict:"


class Listed(NamedTuple):
    """A rule of the list."""

    verdict: str
    host: str
    path: str


class Mined(NamedTuple):
    """A mined rule; count: labelled rows with all its tokens and its verdict."""

    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    count: int


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*(/[^?#]*)", 1)


def listed(host: Column, path: Column, rules: Iterable[Listed]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host) + len(r.path)):  # the longest stands outermost
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL, an array; empty where it has no ``://``."""
    rest = _rest(url)
    plain = lambda c: F.regexp_replace(c, "[0-9]+", "#")
    parts = lambda c, by, kind: F.transform(F.filter(F.split(c, by), lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    scheme = F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)
    asked = F.regexp_replace(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), "=[^&]*", "")
    fragment = F.regexp_extract(rest, "#([\\s\\S]*)$", 1)
    every = F.concat(
        F.array(F.concat(F.lit("s:"), scheme)), parts(plain(host_of(url)), r"\.", "h:"), parts(plain(path_of(url)), "/", "p:"), parts(plain(asked), "&", "q:"), parts(plain(fragment), "\0", "f:")
    )
    return F.when(F.locate("://", url) > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _sampled(labelled: DataFrame) -> DataFrame:
    """All rows while they are few; else those of the smallest hashes."""
    rate = LABELLED / max(1, labelled.count())
    if rate >= 1:
        return labelled
    return labelled.filter(F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") < int(rate * (1 << 32)))


def mine(labelled: DataFrame) -> tuple[list[Mined], str]:
    """(rules, the best first; default verdict) of labelled(page_id, tokens, verdict)."""
    with temporary(labelled.sparkSession):
        rows = written(_sampled(labelled.filter(F.col("verdict").isNotNull())).withColumn("row", F.monotonically_increasing_id()), "url-labelled")
        votes = {r.verdict: r["count"] for r in rows.groupBy("verdict").count().collect()}  # two at most
        if not votes:
            return [], ALLOW
        default = BLOCK if votes.get(BLOCK, 0) > votes.get(ALLOW, 0) else ALLOW
        single = rows.select("row", F.explode("tokens").alias("token"))
        common = single.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SUPPORT * sum(votes.values()))
        met = single.join(common, "token").groupBy("row").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "token"))).alias("met"))
        items = rows.select("row", "verdict").join(met, "row", "left").select(
            F.array_append(F.coalesce(F.slice("met.token", 1, ITEMS), F.array().cast("array<string>")), F.concat(F.lit(VERDICT), "verdict")).alias("items")
        )
        sets = FPGrowth(itemsCol="items", minSupport=SUPPORT, minConfidence=CONFIDENCE).fit(written(items, "url-items")).freqItemsets
        sets = sets.select(F.sort_array(F.filter("items", lambda x: ~x.startswith(VERDICT))).alias("tokens"), F.try_element_at(F.filter("items", lambda x: x.startswith(VERDICT)), F.lit(1)).alias("said"), "freq")
        sets = written(sets.filter(F.size("tokens").between(1, LONGEST)), "url-itemsets")
        every = sets.filter("said IS NULL").select("tokens", F.col("freq").alias("of"))
        rules = sets.filter("said IS NOT NULL").join(every, "tokens").withColumn("confidence", F.col("freq") / F.col("of")).filter(F.col("confidence") >= CONFIDENCE)
        best = rules.orderBy(F.desc("confidence"), F.desc("freq"), F.size("tokens"), "tokens", "said").limit(MOST_RULES)
        found = [Mined(tuple(r.tokens), r.said.removeprefix(VERDICT), r.confidence, r.freq) for r in best.collect()]
    by_name = {(r.tokens, r.verdict): r.confidence for r in found}
    parts = lambda r: (p for k in range(1, len(r.tokens)) for p in combinations(r.tokens, k))
    return [r for r in found if not any(by_name.get((p, r.verdict), 0.0) >= r.confidence for p in parts(r))], default


class Index:
    """Rules by token. One counter a rule and URL; a rule is met when it counts all its tokens."""

    def __init__(self, rules: list[Mined], default: str):
        self.sizes, self.verdicts, self.default = [len(r.tokens) for r in rules], [r.verdict for r in rules], default
        self.of: dict[str, list[int]] = defaultdict(list)
        for k, r in enumerate(rules):
            for t in r.tokens:
                self.of[t].append(k)

    def verdict(self, tokens: Iterable[str]) -> str:
        seen: dict[int, int] = defaultdict(int)
        best = len(self.sizes)
        for t in tokens:
            for k in self.of.get(t, ()):
                if k >= best:
                    break  # rules stand best first
                seen[k] += 1
                if seen[k] == self.sizes[k]:
                    best = k
        return self.verdicts[best] if best < len(self.sizes) else self.default


def judged(pages: DataFrame, rules: list[Listed], mined: list[Mined], default: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule, verdict of pages(page_id, url)."""
    index = Index(mined, default)

    @F.pandas_udf("string")
    def by_index(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else index.verdict(r) for r in rows], dtype=object)

    url = F.coalesce(F.col("url"), F.lit(""))
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), tokens(url).alias("tokens"))
    name, verdict = listed(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("said"), "tokens")
    rest = by_index(F.when(F.col("said").isNull(), F.col("tokens")))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", rest).alias("verdict"))


#: The list of the query.
RULES = [Listed(ALLOW, "com", "/"), Listed(BLOCK, "example.com", "/en/"), Listed(ALLOW, "www.example.com", "/en/"), Listed(BLOCK, "net", "/es/"), Listed(BLOCK, "net", "/fr/")]


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, tokens, verdict: a URL that ends in a number stands for the document of that id; poor or toxic ones are to be blocked."""
    url = F.coalesce(F.col("url"), F.lit(""))
    named = F.regexp_extract(path_of(url), "/([0-9]{1,18})([.][A-Za-z]+)?/?$", 1).try_cast("long")
    poor = (F.col("quality") == 0) | (F.col("toxic") == 1)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc"), F.when(poor, BLOCK).when(~poor, ALLOW).alias("verdict")).dropna()
    return pages.select("page_id", named.alias("doc"), tokens(url).alias("tokens")).join(marks, "doc").select("page_id", "tokens", "verdict")


_REST = "CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END"
_LIST = [(r.verdict, r.host, r.path) for r in sorted(RULES, key=lambda r: -len(r.host) - len(r.path))]
_FITS = [(v, h + p, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))") for v, h, p in _LIST]
_ORDER = "confidence DESC, n DESC, len(t), t, verdict"
#: Counts sets of up to LONGEST tokens by joins, where the query grows FP-trees.
ORACLE_SQL = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, row_number() OVER () AS row FROM pages),
r AS (SELECT *, {_REST} AS rest FROM u),
p AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM r),
q AS (SELECT *, [['s:' || translate(split_part(url, '://', 1), '{UPPER}', '{LOWER}')],
  ['h:' || x FOR x IN string_split(regexp_replace(host, '[0-9]+', '#', 'g'), '.') IF x != ''],
  ['p:' || x FOR x IN string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/') IF x != ''],
  ['q:' || x FOR x IN string_split(regexp_replace(regexp_replace(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '=[^&]*', '', 'g'), '[0-9]+', '#', 'g'), '&') IF x != ''],
  ['f:' || x FOR x IN [regexp_replace(regexp_extract(rest, '#((?s:.*))$', 1), '[0-9]+', '#', 'g')] IF x != '']] AS kinds FROM p),
t AS (SELECT *, CASE WHEN position('://' IN url) > 0 THEN list_distinct(flatten(kinds)) ELSE [] END AS tokens FROM q),
l AS (SELECT t.*, verdict, row_number() OVER () AS k FROM t
  JOIN (SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 'block' WHEN NOT (quality = 0 OR toxic = 1) THEN 'allow' END AS verdict FROM labels) AS m
  ON doc_id = TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})([.][A-Za-z]+)?/?$', 1) AS BIGINT) WHERE verdict IS NOT NULL),
h AS (SELECT * FROM l WHERE ('0x' || md5(page_id::VARCHAR)[1:8])::BIGINT < {LABELLED} / greatest(1, (SELECT count(*) FROM l)) * 4294967296),
s AS (SELECT k, verdict, unnest(tokens) AS token FROM h),
c AS (SELECT token, count(*) AS n FROM s GROUP BY token HAVING count(*) >= {SUPPORT}::DOUBLE * (SELECT count(*) FROM h)),
i AS (SELECT k, verdict, token FROM s JOIN c USING (token) QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, token) <= {ITEMS}),
g AS (SELECT k, verdict, [token] AS t FROM i
  UNION ALL SELECT k, a.verdict, [a.token, b.token] FROM i AS a JOIN i AS b USING (k) WHERE a.token < b.token
  UNION ALL SELECT k, a.verdict, [a.token, b.token, d.token] FROM i AS a JOIN i AS b USING (k) JOIN i AS d USING (k) WHERE a.token < b.token AND b.token < d.token),
o AS (SELECT t, count(*) AS n FROM g GROUP BY t),
f AS (SELECT g.t, g.verdict, count(*) AS n, count(*) / any_value(o.n) AS confidence FROM g JOIN o USING (t) GROUP BY g.t, g.verdict
  HAVING count(*) >= ceil({SUPPORT}::DOUBLE * (SELECT count(*) FROM h)) AND count(*) / any_value(o.n) >= {CONFIDENCE}),
b AS (SELECT * FROM f ORDER BY {_ORDER} LIMIT {MOST_RULES}),
w AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM b AS z WHERE z.verdict = b.verdict AND len(z.t) < len(b.t) AND list_has_all(b.t, z.t) AND z.confidence >= b.confidence)),
d AS (SELECT CASE WHEN count_if(verdict = 'block') > count_if(verdict = 'allow') THEN 'block' ELSE 'allow' END AS verdict FROM h),
v AS (SELECT row, verdict FROM (SELECT t.row, w.verdict, w.t, w.n, w.confidence FROM t, w WHERE list_has_all(t.tokens, w.t)) QUALIFY row_number() OVER (PARTITION BY row ORDER BY {_ORDER}) = 1)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {fits} THEN '{name}'" for _, name, fits in _FITS)} END AS rule,
  CASE {" ".join(f"WHEN {fits} THEN '{verdict}'" for verdict, _, fits in _FITS)} ELSE coalesce((SELECT verdict FROM v WHERE v.row = t.row), (SELECT verdict FROM d)) END AS verdict
FROM t
"""
