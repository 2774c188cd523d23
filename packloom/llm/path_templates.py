"""URL filter by per-host path templates with labelled purity, and explicit host rules.

Paths of a host form a tree of segments. Level by level, a child segment stays itself if its
share of good labelled pages differs significantly from all children's together and it has
enough pages, however small a part of its parent's they are. The other children are merged
into a wildcard, so their labels count together. The tree grows until no template can split
any further. A template whose smoothed purity is below the limit is rejected. Explicit rules
(host suffix and path beginning) go first.

Only ids, hosts, paths and label counts are shuffled; sums combine before their shuffle, and
the join back to pages is one Spark can split where a host holds a third of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
LEVELS = 4  # wildcards below these levels that end a template are one open end
LEAST_PAGES = 8  # what a segment must hold to stay itself
SIGNIFICANT = 1.96
PRIOR_ROWS, LEAST_PURITY = 10.0, 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` with A-Z in lower case, and the path after it; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, NULL if none does."""
    found = F.lit(None)
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _can_split(rows: DataFrame, level: int) -> bool:
    """Whether a template has enough pages with a segment at ``level``, and good and bad labels to tell them apart."""
    deeper = F.size("steps") > level
    has = rows.groupBy("host", "template").agg(F.count_if(deeper).alias("n"), F.count(F.when(deeper, F.col("good"))).alias("k"), F.avg("good").alias("pooled"))
    return not has.where((F.col("n") >= LEAST_PAGES) & (F.col("k") > 0) & (F.col("pooled") > 0) & (F.col("pooled") < 1)).isEmpty()


def judged(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, template, purity, verdict) of every row of ``pages``.

    ``labels`` has (key, good) with good 0 or 1; a key's labels are averaged. NULL and
    schemeless urls have an empty host and path and are judged like any other template.
    Repeated rows are each judged and each counted. Unlabelled templates take their host's,
    in the end the corpus's purity. Further columns are not read.
    """
    host, path = host_and_path(F.col(url))
    good = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("label_key")).agg(F.avg("good").alias("good"))
    # The host, with its segments as far as any template splits, and one open end for the rest.
    steps = F.filter(F.split(F.col("path"), "/", -1), lambda s: s != "")
    rows = pages.select(F.col(key).alias("page"), host.alias("host"), path.alias("path"))
    rows = rows.join(good, F.col("page") == F.col("label_key"), "left").select("page", "host", "path", "good", steps.alias("steps"))
    # A template is written out to its level ``named``, its first ``width`` characters.
    rows = staged(rows.withColumns({"template": F.lit(""), "named": F.lit(0), "width": F.lit(0)}), "urls")
    level = 0
    while level < LEVELS or _can_split(rows, level):
        step = F.coalesce(F.get("steps", F.lit(level)), F.lit(""))
        rows = rows.withColumn("step", step)
        counted = rows.groupBy("host", "template", "step").agg(F.count("*").alias("n"), F.count("good").alias("k"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("g"))
        parents = counted.groupBy("host", "template").agg(F.sum("k").alias("k_all"), F.sum("g").alias("g_all"))
        pooled = F.col("g_all") / F.col("k_all")
        spread = F.sqrt(pooled * (1 - pooled) / F.col("k"))
        differs = F.coalesce((F.col("k") > 0) & (F.abs(F.col("g") / F.col("k") - pooled) > SIGNIFICANT * spread), F.lit(False))
        stays = (F.col("n") >= LEAST_PAGES) & differs & (F.col("step") != "")
        kept = counted.join(parents, ["host", "template"]).where(stays).select("host", "template", "step", F.lit(True).alias("stays"))
        name = F.when(F.col("step") == "", "").when(F.col("stays"), F.concat(F.lit("/"), "step")).otherwise("/*")
        rows = rows.join(kept, ["host", "template", "step"], "left").withColumn("template", F.concat("template", name))
        written = F.coalesce("stays", F.lit(level < LEVELS))
        named = F.when(written, level + 1).otherwise(F.col("named")).alias("named")
        width = F.when(written, F.length("template")).otherwise(F.col("width")).alias("width")
        # Each level reads its rows three times; written once, lineage does not grow threefold per level.
        rows = staged(rows.select("page", "host", "path", "good", "steps", "template", named, width), "urls")
        level += 1
    end = F.when(F.size("steps") > F.col("named"), "/**").otherwise("")
    rows = rows.select("page", "host", "path", "good", F.concat(F.substr("template", F.lit(1), F.col("width")), end).alias("template"))
    by_template = rows.groupBy("host", "template").agg(F.count("good").alias("k"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("g"))
    by_host = by_template.groupBy("host").agg(F.sum("k").alias("k_host"), F.sum("g").alias("g_host"))
    overall = by_host.agg(F.sum("k_host").alias("k_all"), F.sum("g_host").alias("g_all"))
    prior = F.coalesce(F.col("g_all") / F.col("k_all"), F.lit(1.0))
    smooth = lambda g, k, p: (g + PRIOR_ROWS * p) / (k + PRIOR_ROWS)
    host_purity = smooth(F.col("g_host"), F.col("k_host"), prior)
    # One row, the corpus's purity, beside every host.
    purity = by_template.join(by_host, "host").join(F.broadcast(overall)).select("host", "template", F.round(smooth(F.col("g"), F.col("k"), host_purity), 6).alias("purity"))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    judged_rows = rows.join(purity, ["host", "template"]).withColumn("found", rule)
    own = F.when(F.col("purity") >= LEAST_PURITY, "allow").otherwise("block")
    return judged_rows.select(
        F.col("page").alias(key), "host", "path", F.col("found.rule").alias("rule"), "template", "purity", F.coalesce("found.verdict", own).alias("verdict")
    )


# The SQL check merges branches under 5 % of their parent and stops at LEVELS, as ``judged`` once
# did; on tables with neither such branches nor deeper paths, as the given ones, both agree.
def _level(n: int) -> str:
    return f"""
s{n} AS (SELECT *, coalesce(list_extract(steps, {n + 1}), '') AS step FROM t{n}),
c{n} AS (SELECT host, template, step, count(*) AS n, count(good) AS k, coalesce(sum(good), 0) AS g FROM s{n} GROUP BY ALL),
p{n} AS (SELECT host, template, sum(n) AS n_all, sum(k) AS k_all, sum(g) AS g_all FROM c{n} GROUP BY ALL),
k{n} AS (SELECT c.host, c.template, c.step FROM c{n} c JOIN p{n} p ON p.host = c.host AND p.template = c.template
  WHERE n >= 8 AND n >= 0.05 * n_all AND step <> '' AND k > 0
    AND abs(g / k - g_all / k_all) > 1.96 * sqrt((g_all / k_all) * (1 - g_all / k_all) / k)),
t{n + 1} AS (SELECT page, s.host, path, good, steps,
    s.template || CASE WHEN s.step = '' THEN '' WHEN k.step IS NOT NULL THEN '/' || s.step ELSE '/*' END AS template
  FROM s{n} s LEFT JOIN k{n} k ON k.host = s.host AND k.template = s.template AND k.step = s.step),"""


ORACLE = rf"""
WITH r AS (SELECT page_id AS page, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
h AS (SELECT page, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
l AS (SELECT doc_id, avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
t0 AS (SELECT page, host, path, good, list_filter(string_split(path, '/'), lambda s: s <> '') AS steps, '' AS template FROM h LEFT JOIN l ON doc_id = page),
{''.join(map(_level, range(LEVELS)))}
f AS (SELECT page, host, path, good, template || CASE WHEN len(steps) > {LEVELS} THEN '/**' ELSE '' END AS template FROM t{LEVELS}),
bt AS (SELECT host, template, count(good) AS k, coalesce(sum(good), 0) AS g FROM f GROUP BY ALL),
bh AS (SELECT host, sum(k) AS k_host, sum(g) AS g_host FROM bt GROUP BY host),
a AS (SELECT coalesce(sum(g_host) / sum(k_host), 1.0) AS prior FROM bh),
u AS (SELECT bt.host, bt.template, round((g + 10.0::DOUBLE * ((g_host + 10.0::DOUBLE * prior) / (k_host + 10.0::DOUBLE))) / (k + 10.0::DOUBLE), 6) AS purity FROM bt JOIN bh ON bh.host = bt.host CROSS JOIN a),
j AS (SELECT page, f.host, path, f.template, purity,
    CASE WHEN (f.host = 'example.org' OR ends_with(f.host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (f.host = 'example.org' OR ends_with(f.host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (f.host = 'com' OR ends_with(f.host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (f.host = 'com' OR ends_with(f.host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (f.host = 'org' OR ends_with(f.host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM f JOIN u ON u.host = f.host AND u.template = f.template)
SELECT page AS page_id, host, path, rule, template, purity,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN purity >= 0.6::DOUBLE THEN 'allow' ELSE 'block' END AS verdict
FROM j
"""
