"""URL filters (native): host and path rules, then a path-template tree per host.

Urls that no rule decides go by their template.  Inside every segment digits become {n};
urls are then counted per (host, segments), with the allow and block verdicts that the rules
gave as labels.  The tree is grown level by level on these counts: below a node a segment stays
itself if it is frequent there, and all others become the wildcard; segments whose
labelled shares don't differ significantly become one branch; the counts are added up
again, so that the table shrinks from level to level.  A template is rejected where its
smoothed share of allowed urls is below one half; one without evidence is allowed.

Only DataFrame functions are used.  Counts combine map-side, a node keeps at most
``1 / MIN_SHARE`` segments as branches, and a host with a third of all urls is a
row per distinct remaining path, never a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

ALLOW, BLOCK = "allow", "block"
#: (verdict, host, path)
RULES = ((ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"), (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/"))
MIN_COUNT, MIN_SHARE = 5, 1 / 64   # a segment is a branch of its own from these on
DEPTH = 8                          # segments of a template; those beyond it are one wildcard
Z2 = 3.84                          # squared normal quantile of a two-sided test at 5 %
MARKS = r"[*{}|]"                  # a segment with a template's own characters becomes {x}


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_first(rules) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1], r[2], r[0]))


def ruled(host: Column, path: Column, rules, value) -> Column:
    """``value(rule)`` of the longest fitting rule, else null."""
    out = F.lit(None).cast("string")
    for rule in reversed(longest_first(rules)):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """Non-empty segments with digits as {n}; at most DEPTH, and one wildcard for all beyond."""
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")
    head = F.transform(F.slice(parts, 1, DEPTH), lambda s: F.when(s.rlike(MARKS), F.lit("{x}")).otherwise(F.regexp_replace(s, "[0-9]+", "{n}")))
    return F.when(F.size(parts) > DEPTH, F.concat(head, F.array(F.lit("**")))).otherwise(head)


def branches(children: DataFrame, nodes: DataFrame) -> DataFrame:
    """(host, template, segment, branch): frequent segments of every node, similar ones under one name."""
    node = ["host", "template"]
    frequent = children.join(nodes.select(*node, F.col("n").alias("total")), node).where(
        (F.col("n") >= MIN_COUNT) & (F.col("n") >= F.col("total") * MIN_SHARE))
    share = (F.col("good") + 1) / (F.col("labelled") + 2)
    order = Window.partitionBy(*node).orderBy("share", "segment")     # at most 1 / MIN_SHARE rows
    n1, g1, n2, g2 = (F.col(c).cast("double") for c in ("labelled", "good", "n2", "g2"))
    good, size = g1 + g2, n1 + n2
    # two-proportion test without divisions: (g1 n2 - g2 n1)^2 (n1 + n2) against z^2 n1 n2 g (n - g)
    gap = g1 * n2 - g2 * n1
    alike = F.when((n1 == 0) | (n2 == 0), n1 + n2 == 0).otherwise(gap * gap * size <= Z2 * n1 * n2 * good * (size - good))
    named = (frequent.withColumn("share", share).withColumn("n2", F.lag("labelled").over(order)).withColumn("g2", F.lag("good").over(order))
             .withColumn("cluster", F.sum(F.when(F.col("n2").isNull() | alike, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    members = F.array_join(F.array_sort(F.collect_list("segment").over(Window.partitionBy(*node, "cluster"))), "|")
    return named.select(*node, "segment", members.alias("branch"))


def templates(urls: DataFrame) -> DataFrame:
    """(host, segments, template, share) of the distinct (host, segments) of labelled urls (host, segments, good)."""
    node = ["host", "template"]
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "good")]
    counts = urls.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    whole = materialise(counts, "url-counts")
    named = whole.withColumn("template", F.lit(""))     # every distinct path with its template so far
    deepest = whole.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(deepest):
        here = F.col("segments")[level]
        open_ = named.where(F.size("segments") > level).select(*node, here.alias("segment"), "n", "labelled", "good")
        children = materialise(open_.groupBy(*node, "segment").agg(*sums), "url-children")
        kept = materialise(branches(children, children.groupBy(*node).agg(F.sum("n").alias("n"))), "url-branches")
        named = materialise(named.withColumn("segment", F.get("segments", F.lit(level))).join(kept, [*node, "segment"], "left").withColumn(
            "template", F.when(F.col("segment").isNull(), F.col("template")).otherwise(
                F.concat("template", F.lit("/"), F.coalesce("branch", F.lit("*"))))).drop("segment", "branch"), "url-templates")
    purity = named.groupBy(*node).agg(*sums).select(*node, ((F.col("good") + 1) / (F.col("labelled") + 2)).alias("share"))
    return named.select("host", "segments", "template").join(purity, node)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per input row: ``id``, ``host``, ``path``, ``rule`` (host and path of the longest fitting rule,
    or null), ``template``, ``share`` (its smoothed share of allowed urls) and ``verdict``.

    A rule (verdict, host, path) fits its host and all subdomains where the path begins with the rule's.

    Edge cases: a null url and one without '://' have an empty host and path, fit no rule and are judged as
    the template of the empty host; of equally long rules the one of the longer host wins; repeated
    urls count each and get the same verdict; a very long path is one template of DEPTH segments and a
    wildcard, its rule is found on the whole path; a null id stays null; a clashing extra column
    is ignored; an empty table gives no rows.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.select("*", ruled(F.col("host"), F.col("path"), rules, lambda r: r[1] + r[2]).alias("rule"),
                       ruled(F.col("host"), F.col("path"), rules, lambda r: r[0]).alias("ruling"), segments(F.col("path")).alias("segments"))
    found = templates(rows.select("host", "segments", (F.col("ruling") == ALLOW).cast("long").alias("good")))
    by_method = F.when(F.col("share") < 0.5, BLOCK).otherwise(ALLOW)
    return rows.join(found, ["host", "segments"]).select(
        "id", "host", "path", "rule", F.concat("host", "template").alias("template"), "share", F.coalesce("ruling", by_method).alias("verdict"))


def _sql_string(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rules_sql(value) -> str:
    cases = " ".join(f"WHEN (host = {_sql_string(r[1])} OR ends_with(host, {_sql_string('.' + r[1])})) AND starts_with(path, {_sql_string(r[2])}) "
                     f"THEN {_sql_string(value(r))}" for r in longest_first(RULES))
    return f"CASE {cases} END"


def _level_sql(k: int) -> str:
    """CTEs of one level of the tree: children, branches and the templates one segment longer."""
    return f"""k{k} AS (
  SELECT host, template, segments[{k + 1}] AS segment, sum(n) AS n, sum(labelled) AS labelled, sum(good) AS good
  FROM t{k} WHERE len(segments) > {k} GROUP BY ALL
), q{k} AS (
  SELECT *, (good + 1) / (labelled + 2)::DOUBLE AS share FROM (SELECT *, sum(n) OVER (PARTITION BY host, template) AS total FROM k{k})
  WHERE n >= {MIN_COUNT} AND n >= total * {MIN_SHARE}
), l{k} AS (
  SELECT *, labelled::DOUBLE AS n1, good::DOUBLE AS g1, lag(labelled::DOUBLE) OVER w AS n2, lag(good::DOUBLE) OVER w AS g2
  FROM q{k} WINDOW w AS (PARTITION BY host, template ORDER BY share, segment)
), c{k} AS (
  SELECT *, sum(CASE WHEN n2 IS NULL OR CASE WHEN n1 = 0 OR n2 = 0 THEN n1 + n2 = 0
      ELSE (g1 * n2 - g2 * n1) * (g1 * n2 - g2 * n1) * (n1 + n2) <= {Z2}::DOUBLE * n1 * n2 * (g1 + g2) * (n1 + n2 - (g1 + g2)) END THEN 0 ELSE 1 END)
      OVER (PARTITION BY host, template ORDER BY share, segment ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster
  FROM l{k}
), b{k} AS (
  SELECT host, template, segment, array_to_string(list_sort(list(segment) OVER (PARTITION BY host, template, cluster)), '|') AS branch FROM c{k}
), t{k + 1} AS (
  SELECT t.host, t.segments, t.n, t.labelled, t.good,
         CASE WHEN len(t.segments) > {k} THEN t.template || '/' || coalesce(b.branch, '*') ELSE t.template END AS template
  FROM t{k} t LEFT JOIN b{k} b ON b.host = t.host AND b.template = t.template AND b.segment = t.segments[{k + 1}]
)"""


SQL = f"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), p AS (
  SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM u
), r AS (
  SELECT page_id, host, path, {_rules_sql(lambda r: r[1] + r[2])} AS rule, {_rules_sql(lambda r: r[0])} AS ruling,
         list_concat(list_transform(parts[1:{DEPTH}], lambda s: CASE WHEN regexp_matches(s, '{MARKS}') THEN '{{x}}'
                     ELSE regexp_replace(s, '[0-9]+', '{{n}}', 'g') END), CASE WHEN len(parts) > {DEPTH} THEN ['**'] ELSE [] END) AS segments
  FROM p
), t0 AS (
  SELECT host, segments, count(*) AS n, count(ruling) AS labelled, count(*) FILTER (WHERE ruling = '{ALLOW}') AS good, '' AS template
  FROM r GROUP BY host, segments
), {", ".join(_level_sql(k) for k in range(DEPTH + 1))}, s AS (
  SELECT host, template, (sum(good) + 1) / (sum(labelled) + 2)::DOUBLE AS share FROM t{DEPTH + 1} GROUP BY host, template
)
SELECT r.page_id, r.host, r.path, r.rule, r.host || t.template AS template, s.share,
       coalesce(r.ruling, CASE WHEN s.share < 0.5 THEN '{BLOCK}' ELSE '{ALLOW}' END) AS verdict
FROM r JOIN t{DEPTH + 1} t ON t.host = r.host AND t.segments = r.segments JOIN s ON s.host = t.host AND s.template = t.template
"""
