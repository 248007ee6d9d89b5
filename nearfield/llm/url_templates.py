"""Operator 8: URL filter by rules and a path-template tree, in DataFrame functions only.

A url's host and path are judged by the longest rule that fits them (a rule's host covers its subdomains, its path
is a prefix).  The urls that rules decide are the labels from which the method judges the others:

* Generalising: each host has a tree of path templates.  A segment that holds a digit becomes ``*``; what follows the first
  MAX_DEPTH segments is one ``**``.  A branch is variable if fewer than RARE of its host's pages, or less than one in SHARE of them,
  lie in it; variable branches with one parent become one wildcard for each kind of labels that they hold (none, allowed,
  blocked, both), so that none lends its labels to another.
* Merging: from the root down, siblings that hold labels are put in the order of their share of blocked urls, and neighbours whose shares
  don't differ by two standard errors become one branch, with their counts added up and their children together.
* Verdict: a url is judged by the deepest node on its path that holds labels, its host's root included.  It is blocked if
  (blocked + 1) / (labelled + 2) of that node is at least PURITY and at least half of the node's urls are labelled:
  a node whose urls mostly have no label says too little about them.  Otherwise it is allowed.

All statistics are sums with partial sums before each shuffle.  A host keeps at most SHARE branches of one depth besides wildcards, so
that its tree, which one task merges, is small however many pages the host has.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged like any other; repeated
rows count and return once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm.rows import column
from nearfield.llm.shared_store import written

MAX_DEPTH, RARE, SHARE, PURITY = 4, 3, 512, 0.8

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(pages: DataFrame, url: Column) -> DataFrame:
    """pages with the columns host and path."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    split = pages.withColumn("__url", url).withColumn("__rest", rest).withColumn("__host", raw)
    path = F.regexp_extract(F.expr("substring(__rest, length(__host) + 1)"), r"^[^?#]*", 0)
    return split.withColumn("host", F.translate("__host", _UPPER, _LOWER)).withColumn("path", path).drop("__url", "__rest", "__host")


def rule_of(rules=RULES) -> Column:
    """The longest fitting rule as struct<rule, verdict>, or null."""
    fits = None
    for verdict, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        holds = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        value = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(holds, value) if fits is None else fits.when(holds, value)
    return fits if fits is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _templates(shapes: DataFrame) -> DataFrame:
    """shapes(host, segments, pages, n, b) with template: their segments with variable ones as wildcards."""
    hosts = shapes.groupBy("host").agg(F.sum("pages").alias("host_pages"))
    each = shapes.withColumn("place", F.explode(F.expr("sequence(1, size(segments))"))).withColumn("prefix", F.expr("concat_ws('/', slice(segments, 1, place))"))
    counts = each.groupBy("host", "place", "prefix").agg(F.sum("pages").alias("in"), F.sum("n").alias("labels"), F.sum("b").alias("blocks"))
    kind = "CASE WHEN labels = 0 THEN '~' WHEN blocks = 0 THEN '~+' WHEN blocks = labels THEN '~-' ELSE '~?' END"
    variable = f"segments[place - 1] NOT IN ('*', '**') AND in < greatest({RARE}, host_pages / {SHARE})"
    named = each.join(counts, ["host", "place", "prefix"]).join(hosts, "host")
    named = named.select("host", "segments", "place", F.expr(f"if({variable}, {kind}, segments[place - 1])").alias("name"))
    template = F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"])
    return shapes.join(named.groupBy("host", "segments").agg(template.alias("template")), ["host", "segments"])


def _merged(templates: DataFrame) -> DataFrame:
    """(host, template, rejected) of templates(host, template, pages, n, b)."""
    host = Window.partitionBy("host")
    tree = templates.repartition("host").withColumns({"t": F.lit(""), "jp": F.sum("pages").over(host), "jn": F.sum("n").over(host), "jb": F.sum("b").over(host)})
    for place in range(MAX_DEPTH + 1):
        node = Window.partitionBy("host", "t", "s")
        tree = tree.withColumn("s", F.get("template", F.lit(place))).withColumn("nn", F.sum("n").over(node).cast("double")).withColumn("nb", F.sum("b").over(node).cast("double"))
        tree = tree.withColumn("labelled", F.expr("s IS NOT NULL AND nn > 0"))
        order = Window.partitionBy("host", "t", "labelled").orderBy(F.expr("if(nn > 0, nb / nn, 0D)"), "s")
        tree = tree.withColumn("pn", F.lag("nn").over(order)).withColumn("pb", F.lag("nb").over(order))
        differ = "(nb * pn - pb * nn) * (nb * pn - pb * nn) * (nn + pn) > 4 * (nb + pb) * (nn + pn - nb - pb) * nn * pn"
        tree = tree.withColumn("class", F.sum(F.expr(f"int(coalesce({differ}, false))")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        alike = Window.partitionBy("host", "t", "labelled", "class")
        sums = {name: F.when(F.col("labelled"), F.sum(own).over(alike)).otherwise(F.col(name)) for name, own in (("jp", "pages"), ("jn", "n"), ("jb", "b"))}
        step = F.when(F.col("labelled"), F.min("s").over(alike)).otherwise(F.col("s"))
        tree = tree.withColumns({**sums, "step": step}).withColumn("t", F.expr("if(step IS NULL, t, concat(t, '/', step))"))
        tree = tree.select("host", "template", "pages", "n", "b", "t", "jp", "jn", "jb")
    return tree.select("host", "template", F.expr(f"(jb + 1) / (jn + 2) >= {PURITY}D AND 2 * jn >= jp").alias("rejected"))


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", learnt: Column | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages, and the tree's own verdict (by_tree, null where it isn't asked).

    learnt says which rows' labels the tree may learn from, by default all; it is then asked about all other rows."""
    learnt = F.lit(True) if learnt is None else learnt
    judged = pages.select(column(pages, id_col).alias("page_id"), column(pages, url_col).cast("string").alias("url"), learnt.alias("learnt"))
    judged = split_url(judged, F.col("url")).withColumn("r", rule_of(rules))
    judged = judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("by_rule"), F.when(F.col("learnt"), F.col("r.verdict")).alias("label"))
    judged = judged.withColumn("segments", F.split(F.expr("substring(path, 2)"), "/"))
    judged = judged.withColumn("segments", F.expr(f"if(size(segments) > {MAX_DEPTH}, concat(slice(segments, 1, {MAX_DEPTH}), array('**')), segments)"))
    judged = judged.withColumn("segments", F.expr("transform(segments, s -> if(s rlike '[0-9]', '*', s))"))
    # one row for each different path of a host, with its pages and labels
    shapes = written(judged.groupBy("host", "segments").agg(F.count("*").alias("pages"), F.count("label").alias("n"), F.count_if(F.col("label") == "block").alias("b")), "url-shapes")
    shapes = written(_templates(shapes), "url-templates")
    trees = _merged(shapes.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("pages", "n", "b"))))
    rejected = shapes.join(trees.where("rejected"), ["host", "template"]).select("host", "segments", "rejected")
    result = judged.join(rejected, ["host", "segments"], "left")
    by_tree = F.when(F.col("label").isNull(), F.when(F.col("rejected"), "block").otherwise("allow"))
    return result.select(F.col("page_id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", by_tree).alias("verdict"), by_tree.alias("by_tree"))


def op8_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("by_tree")


_FITS = "\n".join(f"            WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))

_LEVELS = "\n".join(
    f"""a{i} AS (SELECT *, s IS NOT NULL AND nn > 0 AS labelled FROM (SELECT *, sum(n) OVER w::DOUBLE AS nn, sum(b) OVER w::DOUBLE AS nb FROM (SELECT *, template[{i}] AS s FROM t{i - 1}) WINDOW w AS (PARTITION BY host, t, s))),
b{i} AS (SELECT *, lag(nn) OVER w AS pn, lag(nb) OVER w AS pb FROM a{i} WINDOW w AS (PARTITION BY host, t, labelled ORDER BY CASE WHEN nn > 0 THEN nb / nn ELSE 0 END, s NULLS FIRST)),
d{i} AS (SELECT *, sum(CASE WHEN (nb * pn - pb * nn) * (nb * pn - pb * nn) * (nn + pn) > 4 * (nb + pb) * (nn + pn - nb - pb) * nn * pn THEN 1 ELSE 0 END)
      OVER (PARTITION BY host, t, labelled ORDER BY CASE WHEN nn > 0 THEN nb / nn ELSE 0 END, s NULLS FIRST ROWS UNBOUNDED PRECEDING) AS class FROM b{i}),
t{i} AS (SELECT host, template, pages, n, b, CASE WHEN s IS NULL THEN t ELSE t || '/' || CASE WHEN labelled THEN min(s) OVER w ELSE s END END AS t,
      CASE WHEN labelled THEN sum(pages) OVER w ELSE jp END AS jp, CASE WHEN labelled THEN sum(n) OVER w ELSE jn END AS jn, CASE WHEN labelled THEN sum(b) OVER w ELSE jb END AS jb
      FROM d{i} WINDOW w AS (PARTITION BY host, t, labelled, class)),"""
    for i in range(1, MAX_DEPTH + 2)
)

ORACLE = rf"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
u AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
f AS (SELECT *, CASE
{_FITS}
       END AS fit FROM u),
s AS (SELECT page_id, host, path, split_part(fit, ' ', 2) AS rule, split_part(fit, ' ', 1) AS by_rule, string_split(substr(path, 2), '/') AS raw FROM f),
j AS (SELECT *, list_transform(CASE WHEN len(raw) > {MAX_DEPTH} THEN list_concat(raw[1:{MAX_DEPTH}], ['**']) ELSE raw END, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END) AS segments FROM s),
c0 AS (SELECT host, segments, count(*) AS pages, count(by_rule) AS n, count(*) FILTER (by_rule = 'block') AS b FROM j GROUP BY ALL),
h0 AS (SELECT host, sum(pages) AS host_pages FROM c0 GROUP BY host),
e0 AS (SELECT *, array_to_string(segments[1:place], '/') AS prefix FROM (SELECT *, unnest(range(1, len(segments) + 1)) AS place FROM c0)),
n0 AS (SELECT host, place, prefix, sum(pages) AS inside, sum(n) AS labels, sum(b) AS blocks FROM e0 GROUP BY ALL),
g AS (SELECT host, segments, any_value(pages) AS pages, any_value(n) AS n, any_value(b) AS b, list(CASE WHEN segments[place] NOT IN ('*', '**') AND inside < greatest({RARE}, host_pages / {SHARE})
      THEN CASE WHEN labels = 0 THEN '~' WHEN blocks = 0 THEN '~+' WHEN blocks = labels THEN '~-' ELSE '~?' END ELSE segments[place] END ORDER BY place) AS template
      FROM e0 JOIN n0 USING (host, place, prefix) JOIN h0 USING (host) GROUP BY host, segments),
t0 AS (SELECT *, '' AS t, sum(pages) OVER h AS jp, sum(n) OVER h AS jn, sum(b) OVER h AS jb FROM
      (SELECT host, template, sum(pages) AS pages, sum(n) AS n, sum(b) AS b FROM g GROUP BY host, template) WINDOW h AS (PARTITION BY host)),
{_LEVELS}
v AS (SELECT host, template, (jb + 1) / (jn + 2) >= {PURITY} AND 2 * jn >= jp AS rejected FROM t{MAX_DEPTH + 1})
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN g USING (host, segments) JOIN v USING (host, template)
"""

QUERIES = {"op8_url_templates": op8_url_templates}
ORACLES = {"op8_url_templates": ORACLE}
