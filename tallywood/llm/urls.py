"""URL filters by a path-template tree, with DataFrame functions only.

A url's host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z
lower-cased; its path goes on up to `?`, `#` or the end.  Explicit rules come first: a
rule `host/path` fits its host and all subdomains where the path starts with its path,
and the longest fitting rule decides.  Urls without a rule are judged by templates:

* forms: each segment is first generalised by its form (`<n>` numbers, `<h>` long hex, `<a>`
  letters with digits; an ending like `.html` is cut, empty segments go).  What is left is a
  host's set of distinct form paths, usually far smaller than its pages;
* tree: from each host's root down, at every node where paths part, whatever its depth.
  Where a node has more than `many` children, those with less than `rare` of its pages become
  the wildcard `*`.  Then labelled siblings are ordered by their rate of blocked; neighbours
  whose labelled counts don't differ by a two-sided 95 % test of two shares are one branch
  (`~` and its least name).  What lies below a wildcard or a merged branch is merged and
  parts again further down;
* purity: the share of blocked among labelled urls, smoothed by `weight` pseudo-counts at
  every step: the share over everything, then of the same form path over all hosts, of the
  host, and of every node from the root to the template.  A template is rejected where
  this is over `reject`.

Labels are urls that rules decided and any rows of `labels` (page_id, blocked; rows that
repeat a page_id count once, blocked if any says so).  Each round treats all nodes that
part at once; paths that no longer part leave, so there are as many rounds as partings on
one path.  Counts are partial aggregates; a node with very many children and a template
with very many pages are dealt over all tasks.

Nulls: a null url or one without `://` has empty host and path, no rule, and is judged
like any url of that host; a null page_id is carried.  Repeated rows count as often as
they occur.  Without labels everything is allowed (purity 0).  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywood.llm.common import drop_written, join_hot, table, written

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CRITICAL = 3.84  # two-sided 95 %, squared


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    at = F.locate("://", F.col("url"))
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    return pages.select("page_id", F.coalesce(rest, F.lit("")).alias("r")).select(
        "page_id", F.translate(F.regexp_extract("r", "^[^/?#]*", 0), _UPPER, _LOWER).alias("host"), F.regexp_extract("r", "^[^/?#]*([^?#]*)", 1).alias("path")
    )


def with_rule(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds the longest fitting rule and what it says."""
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, action in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, slash, path = text.partition("/")
        fits = F.concat(F.lit("."), F.col("host")).endswith(f".{host}") & F.col("path").startswith(slash + path)
        rule, said = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(said)
    return urls.withColumns({"rule": rule, "said": said})


CUT = r"regexp_replace(s, '[.][a-z0-9]{1,5}$', '')"
FORM = rf"""transform(filter(split(path, '/'), s -> s <> ''), s -> CASE
  WHEN {CUT} RLIKE '^[0-9]+$' THEN '<n>' WHEN {CUT} RLIKE '^[0-9a-f]{{8,}}$' THEN '<h>' WHEN {CUT} RLIKE '[0-9]' THEN '<a>' ELSE {CUT} END)"""


def differ(l1, b1, l2, b2):
    """Whether two shares b1 / l1 and b2 / l2 differ by the two-sided test of two proportions."""
    p = (b1 + b2) / (l1 + l2)
    return F.pow(b1 / l1 - b2 / l2, F.lit(2)) > CRITICAL * p * (1 - p) * (1 / l1 + 1 / l2)


def labelled(children: DataFrame, many: int, rare: float) -> DataFrame:
    """host, node, child, label, l and b of the label: what each child (n pages, l labelled, b blocked) of a node is called in the tree."""
    nodes = children.groupBy("host", "node").agg(F.count("*").alias("kinds"), F.sum("n").alias("pages"))
    wild = (F.col("kinds") > many) & (F.col("n") < rare * F.col("pages")) & (F.col("child") != "")
    first = children.join(nodes, ["host", "node"]).withColumn("name", F.when(wild, "*").otherwise(F.col("child")))
    names = first.groupBy("host", "node", "name").agg(F.sum("l").alias("l"), F.sum("b").alias("b"))
    # many + 1 / rare + 1 names a node at most, so its windows are small
    by_rate = Window.partitionBy("host", "node").orderBy(F.col("b") / F.col("l"), "name")
    tested = names.filter("l > 0 and name <> ''").withColumns({"pl": F.lag("l").over(by_rate), "pb": F.lag("b").over(by_rate)})
    tested = tested.withColumn("group", F.count_if(F.col("pl").isNull() | differ(F.col("l"), F.col("b"), F.col("pl"), F.col("pb"))).over(by_rate))
    together = Window.partitionBy("host", "node", "group")
    merged = tested.select("host", "node", "name", F.when(F.count("*").over(together) > 1, F.concat(F.lit("~"), F.min("name").over(together))).alias("branch"))
    called = names.join(merged, ["host", "node", "name"], "left").withColumn("label", F.coalesce("branch", "name"))
    branch = Window.partitionBy("host", "node", "label")
    called = called.select("host", "node", "name", "label", F.sum("l").over(branch).alias("l"), F.sum("b").over(branch).alias("b"))
    return first.select("host", "node", "child", "name").join(called, ["host", "node", "name"]).drop("name")


def templates(paths: DataFrame, many: int, rare: float) -> DataFrame:
    """host, form, template and chain of distinct paths (host, form, n, l, b).

    The chain has the labelled and blocked urls of the host and of every node on the way.
    """
    own = F.array(F.struct(F.sum("l").alias("l"), F.sum("b").alias("b"))).alias("chain")
    live = paths.join(paths.groupBy("host").agg(own), "host").withColumns({"node": F.lit(""), "rest": F.col("form")})
    live, done = written(live, "paths"), []
    upto = "least(size(lo), size(hi))"  # paths between the least and the greatest share their common start
    same = F.expr(f"if(lo = hi, null, coalesce(array_min(filter(sequence(1, greatest(1, {upto})), i -> i <= {upto} and get(lo, i - 1) <> get(hi, i - 1))), {upto} + 1) - 1)")
    while True:
        ends = live.groupBy("host", "node").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi")).select("host", "node", same.alias("same"))
        both = written(live.join(ends, ["host", "node"]), "parts")
        drop_written(live)
        done.append(both.filter("same is null").select("host", "form", F.regexp_replace(F.concat_ws("/", "node", F.array_join("rest", "/")), "/+$", "").alias("template"), "chain"))
        parts = both.filter("same is not null").withColumn("child", F.expr("coalesce(get(rest, same), '')"))
        if parts.isEmpty():
            break
        called = labelled(parts.groupBy("host", "node", "child").agg(F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("b").alias("b")), many, rare)
        called = called.select("host", "node", "child", "label", F.array(F.struct("l", "b")).alias("own"))
        shared = F.expr("if(same > 0, array_join(slice(rest, 1, same), '/'), null)")
        moved = {"node": F.concat_ws("/", "node", shared, "label"), "rest": F.expr("slice(rest, same + 2, size(rest))"), "chain": F.concat("chain", "own")}
        live = written(parts.join(called, ["host", "node", "child"]).withColumns(moved).select("host", "form", "n", "l", "b", "node", "rest", "chain"), "paths")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def judge(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, many: int = 20, rare: float = 0.05, weight: float = 4.0, reject: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row of pages (page_id, url)."""
    urls = with_rule(parsed(pages), rules).withColumns({"form": F.expr(FORM), "blocked": F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0)})
    if labels is not None:
        marked = labels.groupBy("page_id").agg(F.max(F.col("blocked").cast("int")).alias("marked"))
        urls = urls.join(marked, "page_id", "left").withColumn("blocked", F.coalesce("blocked", "marked")).drop("marked")

    paths = written(urls.groupBy("host", "form").agg(F.count("*").alias("n"), F.count("blocked").alias("l"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b")), "forms")
    share = paths.agg(F.coalesce(F.try_divide(F.sum("b"), F.sum("l")), F.lit(0.0)).alias("share"))
    across = paths.groupBy("form").agg(((F.sum("b") + weight * share.scalar()) / (F.sum("l") + weight)).alias("prior"))
    purity = F.expr(f"aggregate(chain, prior, (p, x) -> (x.b + {weight}D * p) / (x.l + {weight}D))")
    judged = templates(paths, many, rare).join(across, "form").select("host", "form", "template", purity.alias("purity"))
    judged = written(judged.join(paths.select("host", "form", "n"), ["host", "form"]), "judged")
    out = join_hot(urls, judged, ["host", "form"], ["page_id", "path"])
    verdict = F.coalesce("said", F.when(F.col("purity") > reject, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def _level(k: int) -> str:
    """One depth of the tree in SQL: every path moves on by one segment."""
    return f"""
c{k} AS MATERIALIZED (SELECT *, coalesce(form[{k}], '') AS child FROM t{k - 1}),
s{k} AS MATERIALIZED (SELECT host, node, child, sum(n) AS n, sum(l) AS l, sum(b) AS b, count(*) OVER (PARTITION BY host, node) AS kinds, sum(sum(n)) OVER (PARTITION BY host, node) AS pages
  FROM c{k} GROUP BY host, node, child),
w{k} AS MATERIALIZED (SELECT *, CASE WHEN kinds > 20 AND child <> '' AND n < 0.05::DOUBLE * pages THEN '*' ELSE child END AS name FROM s{k}),
r{k} AS MATERIALIZED (SELECT host, node, name, sum(l)::DOUBLE AS l, sum(b)::DOUBLE AS b FROM w{k} GROUP BY ALL),
o{k} AS MATERIALIZED (SELECT *, lag(l) OVER w AS pl, lag(b) OVER w AS pb FROM r{k} WHERE l > 0 AND name <> '' WINDOW w AS (PARTITION BY host, node ORDER BY b / l, name)),
g{k} AS MATERIALIZED (SELECT *, sum(CASE WHEN pl IS NULL OR power(b / l - pb / pl, 2) > 3.84::DOUBLE * ((b + pb) / (l + pl)) * (1 - (b + pb) / (l + pl)) * (1 / l + 1 / pl) THEN 1 ELSE 0 END)
  OVER (PARTITION BY host, node ORDER BY b / l, name) AS grp FROM o{k}),
m{k} AS MATERIALIZED (SELECT host, node, name, CASE WHEN count(*) OVER v > 1 THEN '~' || min(name) OVER v ELSE name END AS label, sum(l) OVER v AS tl, sum(b) OVER v AS tb
  FROM g{k} WINDOW v AS (PARTITION BY host, node, grp)),
t{k} AS MATERIALIZED (SELECT c.host, c.form, c.n, c.l, c.b, c.node || '/' || coalesce(m.label, w.name) AS node,
  CASE WHEN w.kinds > 1 THEN (coalesce(m.tb, r.b) + 4.0::DOUBLE * c.p) / (coalesce(m.tl, r.l) + 4.0::DOUBLE) ELSE c.p END AS p
  FROM c{k} c JOIN w{k} w ON c.host = w.host AND c.node = w.node AND c.child = w.child JOIN r{k} r ON r.host = w.host AND r.node = w.node AND r.name = w.name
  LEFT JOIN m{k} m ON m.host = w.host AND m.node = w.node AND m.name = w.name),"""


#: One segment at a time, for paths of up to six segments, which all pages of the test tables have.
OP3_SQL = (
    r"""
WITH q0 AS (
  SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS r FROM pages),
q1 AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM q0),
q2 AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM q1),
q3 AS (
  SELECT *, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS said,
    list_transform(list_filter(str_split(path, '/'), lambda s: s <> ''), lambda s: regexp_replace(s, '[.][a-z0-9]{1,5}$', '')) AS segs FROM q2),
u AS MATERIALIZED (
  SELECT *, CASE said WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS blocked, list_transform(segs, lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '<n>'
    WHEN regexp_matches(s, '^[0-9a-f]{8,}$') THEN '<h>' WHEN regexp_matches(s, '[0-9]') THEN '<a>' ELSE s END) AS form FROM q3),
forms AS MATERIALIZED (SELECT host, form, count(*) AS n, count(blocked) AS l, coalesce(sum(blocked), 0) AS b FROM u GROUP BY host, form),
whole AS (SELECT coalesce(sum(b)::DOUBLE / nullif(sum(l), 0), 0) AS share FROM forms),
across AS (SELECT form, (sum(b) + 4.0::DOUBLE * any_value(share)) / (sum(l) + 4.0::DOUBLE) AS prior FROM forms, whole GROUP BY form),
hosts AS (SELECT host, sum(l) AS hl, sum(b) AS hb FROM forms GROUP BY host),
t0 AS MATERIALIZED (SELECT host, form, n, l, b, '' AS node, (hb + 4.0::DOUBLE * prior) / (hl + 4.0::DOUBLE) AS p FROM forms JOIN across USING (form) JOIN hosts USING (host)),"""
    + "".join(map(_level, range(1, 8)))
    + """
judged AS (SELECT host, form, regexp_replace(node, '/+$', '') AS template, p AS purity FROM t7)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN purity > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity
FROM u JOIN judged USING (host, form)
"""
)
