"""URL verdicts from rules and, where none fits, from two character models.

A variable-order Markov model of the accepted URLs and one of the rejected
URLs (Witten-Bell smoothing, each order backing off to the shorter one) give an
URL two likelihoods; the length-normalised log difference is compared with a
calibrated threshold.  Labels come from the rules themselves.

Everything is DataFrame code.  With back-off written additively,

    log P(c | h) = log 1/256 + sum over the suffixes g of h, also the empty one, of
                   [g seen] * log T(g) / (n(g) + T(g))  +  [gc seen] * d(gc),
    d(gc) = log P(c | g) - log T(g) / (n(g) + T(g)) - log P(c | g without its first character),

an URL's log likelihood is a plain sum of weights of the strings it contains.
So scoring is one join of exploded strings with a weight table and one sum an
URL, reduced in the task that read the URL before anything is shuffled.

The models are fitted on all labelled URLs but a fifth (by hash), which
calibrates the threshold.  Only the longest strings are counted from the URLs,
one a character; the shorter ones are sums of theirs.  The weight table grows
with the corpus; it is broadcast only when its counted rows allow, else the join
is an ordinary one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read, written

#: (host, path, verdict); a rule fits its host, all subdomains and paths that start with its path.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
ORDER = 4
#: Characters of an URL whose strings stand in one row at a time.
STRETCH = 1000
#: Rows of the largest weight table that is broadcast, some 60 bytes each.
BROADCAST_ROWS = 1_500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an URL; both empty for null or without `://`."""
    text = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.regexp_extract(text, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, else null."""
    fitting = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    return F.array_max(F.array(*fitting)) if fitting else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def _stretches(url: Column, order: int, size: int = STRETCH) -> Column:
    """The URL between `order` start marks and an end mark, in stretches of `size` characters after `order` characters of context."""
    marked = F.concat(F.lit("\x02" * order), F.coalesce(url, F.lit("")), F.lit("\x03"))
    starts = F.sequence(F.lit(0), F.length(marked) - order - 1, F.lit(size))
    return F.transform(starts, lambda at: F.filter(F.split(F.substring(marked, at + 1, F.lit(size + order)), ""), lambda c: c != ""))


def _strings(order: int, least: int, shift: int) -> Column:
    """Of column `chars`, a stretch: for every position after its context the strings of least..order characters that end `shift` before its end."""
    return F.flatten(
        F.transform(
            F.sequence(F.lit(order + 1), F.size("chars")),
            lambda i: F.array(*[F.array_join(F.slice("chars", i - k, F.lit(k + 1 - shift)), "") for k in range(least, order + 1)]),
        )
    )


def fit(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, weight) of labelled urls (url, sign): strings seen ("+" before) and contexts seen ("-" before).

    The row with the empty key has the weight that each character adds.
    """
    spark = urls.sparkSession
    chars = urls.select("sign", F.explode(_stretches(F.col("url"), order)).alias("chars"))
    longest = chars.select("sign", F.explode(_strings(order, order, 0)).alias("gram")).groupBy("sign", "gram").agg(F.count("*").alias("n"))
    ends = F.explode(F.transform(F.sequence(F.lit(0), F.lit(order)), lambda k: F.struct(k.alias("k"), F.substring("gram", order + 1 - k, k + 1).alias("gram"))))
    grams = longest.select("sign", ends.alias("x"), "n").groupBy("sign", F.col("x.k").alias("k"), F.col("x.gram").alias("gram")).agg(F.sum("n").alias("n"))
    grams = written(spark, grams.withColumn("context", F.expr("left(gram, k)")), "grams")
    rows = grams.count()
    contexts = written(spark, grams.groupBy("sign", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")), "contexts", rows)
    lower, seen = None, []
    for k in range(order + 1):
        here = grams.where(F.col("k") == k).join(contexts, ["sign", "context"]).withColumn("shorter", F.substring("gram", 2, k + 1))
        if lower is None:
            here = here.withColumn("p_lower", F.lit(1 / 256))
        else:
            here = here.join(lower, ["sign", "shorter"])
        here = here.withColumn("p", (F.col("n") + F.col("kinds") * F.col("p_lower")) / (F.col("total") + F.col("kinds")))
        back = F.log(F.col("kinds") / (F.col("total") + F.col("kinds")))
        here = written(spark, here.select("sign", "gram", "p", (F.log("p") - back - F.log("p_lower")).alias("w")), "order", rows)
        seen.append(here.select("sign", F.concat(F.lit("+"), "gram").alias("key"), "w"))
        lower = here.select("sign", F.col("gram").alias("shorter"), F.col("p").alias("p_lower"))
    back = contexts.select("sign", F.when(F.col("context") == "", "").otherwise(F.concat(F.lit("-"), "context")).alias("key"), F.log(F.col("kinds") / (F.col("total") + F.col("kinds"))).alias("w"))
    return reduce(DataFrame.unionByName, [*seen, back]).groupBy("key").agg(F.sum(F.col("sign") * F.col("w")).alias("weight"))


def score(urls: DataFrame, weights: DataFrame, keep: list[str], order: int = ORDER, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The kept columns and `score`: log-likelihood difference a character."""
    weights = weights.select(F.col("key").alias("_key"), F.col("weight").alias("_weight"))
    if weights.count() <= broadcast_rows:
        weights = F.broadcast(weights)
    rows = urls.withColumn("_row", F.monotonically_increasing_id()).withColumn("chars", F.explode(_stretches(F.col("url"), order)))
    plus = F.transform(_strings(order, 0, 0), lambda g: F.concat(F.lit("+"), g))
    minus = F.transform(_strings(order, 1, 1), lambda g: F.concat(F.lit("-"), g))
    each = F.transform(F.sequence(F.lit(order + 1), F.size("chars")), lambda i: F.lit(""))
    found = rows.select("_row", *keep, F.explode(F.concat(plus, minus, each)).alias("_key"))
    one = F.count_if(F.col("_key") == "")  # each character adds the empty key once
    summed = found.join(weights, "_key", "left").groupBy("_row").agg(*[F.first(c).alias(c) for c in keep], one.alias("_n"), F.sum("_weight").alias("_sum"))
    return summed.select(*keep, (F.coalesce("_sum", F.lit(0.0)) / F.col("_n")).alias("score"))


def filter_urls(pages: DataFrame, rules=RULES, url: str = "url", key: str = "page_id", order: int = ORDER) -> DataFrame:
    """(key, host, path, rule, verdict, score) of each row.

    A rule's verdict stands; other URLs are judged by the models (score above
    the threshold: allow).  Null URLs count as empty.  Without labelled URLs of
    both verdicts there is nothing to compare, and all others are allowed.
    Rows that repeat and null keys pass through; of rules of equal length that fit
    the last in the order of their text is taken.  Columns of other names take
    no part.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules)).select("key", "url", "host", "path", "best.rule", "best.verdict")
    labelled = rows.where(F.col("verdict").isNotNull()).select("url", F.when(F.col("verdict") == "allow", 1).otherwise(-1).alias("sign")).distinct()
    labelled = written(spark, labelled, "urls", pages.count())
    held = F.conv(F.substring(F.md5(F.col("url").cast("binary")), 1, 8), 16, 10).cast("long") % 5 == 0
    weights = written(spark, fit(labelled.where(~held), order), "weights")
    sides = score(labelled.where(held), weights, ["sign"], order).groupBy("sign").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("dev")).collect()
    found = {r["sign"]: (r["mean"], r["dev"] + 1e-9) for r in sides}  # two rows
    threshold = (found[1][0] * found[-1][1] + found[-1][0] * found[1][1]) / (found[1][1] + found[-1][1]) if len(found) == 2 else float("-inf")
    columns = ["key", "host", "path", "rule"]
    others = score(rows.where(F.col("rule").isNull()), weights, columns, order)
    others = others.withColumn("verdict", F.when(F.col("score") > threshold, "allow").otherwise("block"))
    ruled = rows.where(F.col("rule").isNotNull()).select(*columns, "verdict", F.lit(None).cast("double").alias("score"))
    return ruled.unionByName(others.select(*columns, "verdict", "score")).withColumnRenamed("key", key)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url; scores to 6 places."""
    return filter_urls(read(spark, sf_dir, "pages")).withColumn("score", F.round("score", 6))


def _op5_sql(order: int = ORDER) -> str:
    """The same by plain recursion over the orders at each character."""
    fits = " UNION ALL ".join(f"SELECT {len(h) + len(p)} AS size, '{h + p}' AS rule, '{v}' AS verdict, '{h}' AS h, '{p}' AS p" for h, p, v in RULES)
    text = f"""WITH parts AS (
  SELECT row_number() OVER () AS id, page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT id, page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), ruled AS MATERIALIZED (
  SELECT t.*, b.rule, b.verdict FROM hosts t LEFT JOIN (
    SELECT id, r.rule, r.verdict, row_number() OVER (PARTITION BY id ORDER BY size DESC, r.rule DESC, r.verdict DESC) AS place FROM hosts JOIN ({fits}) r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)
  ) b ON b.id = t.id AND b.place = 1
), urls AS MATERIALIZED (
  SELECT url, CASE verdict WHEN 'allow' THEN 1 ELSE -1 END AS sign, CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % 5 = 0 AS held FROM (SELECT DISTINCT url, verdict FROM ruled WHERE verdict IS NOT NULL)
), marked AS (
  SELECT url, sign, held, repeat(chr(2), {order}) || url || chr(3) AS m FROM urls
), grams AS MATERIALIZED (
  SELECT sign, k, substr(m, p - k, k + 1) AS g, substr(m, p - k, k) AS h, count(*) AS n FROM (SELECT sign, m, unnest(range({order + 1}, length(m) + 1)) AS p FROM marked WHERE NOT held) t, range({order + 1}) o(k) GROUP BY 1, 2, 3, 4
), contexts AS MATERIALIZED (
  SELECT sign, k, h, sum(n) AS total, count(*) AS kinds FROM grams GROUP BY 1, 2, 3
), judged AS (
  SELECT url, sign AS side, 'held' AS what FROM urls WHERE held UNION SELECT DISTINCT url, 0, 'other' FROM ruled WHERE rule IS NULL
), places AS (
  SELECT url, side, what, m, s.sign, unnest(range({order + 1}, length(m) + 1)) AS p FROM (SELECT *, repeat(chr(2), {order}) || url || chr(3) AS m FROM judged) j, (VALUES (1), (-1)) s(sign)
), q0 AS (SELECT *, CAST(1.0 / 256 AS DOUBLE) AS pr FROM places)"""
    for k in range(order + 1):
        text += f""", q{k + 1} AS (
  SELECT q.url, q.side, q.what, q.m, q.sign, q.p, CASE WHEN c.total IS NULL THEN q.pr ELSE (coalesce(g.n, 0) + c.kinds * q.pr) / (c.total + c.kinds) END AS pr
  FROM q{k} q LEFT JOIN contexts c ON c.sign = q.sign AND c.k = {k} AND c.h = substr(q.m, q.p - {k}, {k}) LEFT JOIN grams g ON g.sign = q.sign AND g.k = {k} AND g.g = substr(q.m, q.p - {k}, {k + 1}))"""
    return text + f""", scored AS MATERIALIZED (
  SELECT url, side, what, sum(sign * ln(pr)) / count(DISTINCT p) AS score FROM q{order + 1} GROUP BY 1, 2, 3
), sides AS (
  SELECT side, avg(score) AS m, stddev_pop(score) + 1e-9 AS d FROM scored WHERE what = 'held' GROUP BY 1
), cut AS (
  SELECT coalesce((a.m * b.d + b.m * a.d) / (a.d + b.d), -CAST('inf' AS DOUBLE)) AS threshold FROM (SELECT 1) LEFT JOIN sides a ON a.side = 1 LEFT JOIN sides b ON b.side = -1
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN verdict WHEN s.score > threshold THEN 'allow' ELSE 'block' END AS verdict, CASE WHEN rule IS NULL THEN round(s.score, 6) END AS score
FROM ruled r LEFT JOIN scored s ON s.url = r.url AND s.what = 'other' AND r.rule IS NULL, cut
"""


OP5_SQL = _op5_sql()
