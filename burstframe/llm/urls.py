"""URL filters by a tree of path templates for each host.

A URL's path is cut into segments, all of which are levels of the tree. Numbers
and identifiers become wildcards at once ('*', or '*.ext' where an extension follows). Then, level by
level from the host, a node with more than ``FAN`` literal children turns those with fewer than
``FEW`` pages into '*'. Then, from the deepest level up, sibling branches (equal but for one literal segment)
whose labelled share of good pages doesn't differ significantly from that of all of them merge into '+'; those without labels
join them only if no sibling differs. A template is rejected if its smoothed purity is below ``PURITY``: the share of good among
its labelled pages drawn towards its host's, which is drawn towards the whole table's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: DEPTH is the SQL's: it has one segment '**' for what lies below.
DEPTH, FAN, FEW = 4, 20, 5
Z, PRIOR_WEIGHT, PURITY = 1.96, 4.0, 0.5

_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://"
_VARIABLE = r"^([0-9]+|[0-9a-fA-F-]{16,}|[A-Za-z]*[0-9]{4,}[A-Za-z0-9-]*)$"
_WITH_END = r"^[0-9]+(\.[A-Za-z0-9]{1,5})$"


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(url, _URL + r"([^/?#]*)", 1), r":[0-9]+$", ""))


def segments(url: Column) -> Column:
    """The path's segments with wildcards for numbers and identifiers."""
    parts = F.filter(F.split(F.regexp_extract(url, _URL + r"[^/?#]*([^?#]*)", 1), "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(_VARIABLE), F.lit("*")).when(s.rlike(_WITH_END), F.concat(F.lit("*"), F.regexp_extract(s, _WITH_END, 1))).otherwise(s))


def _literal(s: Column) -> Column:
    return s.isNotNull() & ~s.startswith("*") & (s != "+")


def _next(tree: DataFrame, last: int | None, fan: int | None = None) -> int | None:
    """The next level at which anything is to be done: with ``fan`` the first below ``last`` with a node of more literal children, else
    the last above it with branches that differ there alone. Levels that don't branch, as most of a very long path, cost nothing.

    Sums of segments' hashes stand for the rest of a path; that they collide could only name a level at which nothing is done then.
    """
    h = F.pmod(F.xxhash64("p", "s"), F.lit(1 << 31))
    # The path is hashed before it is taken apart, else every segment's row would carry all of it.
    whole = tree.select("host", F.xxhash64("host", "raw").alias("id"), F.size("segs").alias("n"), "segs")
    segs = whole.select("host", "id", "n", F.posexplode("segs").alias("p", "s")).withColumn("h", h)
    path = Window.partitionBy("host", "id", "n")
    if fan is not None:
        above = F.coalesce(F.sum("h").over(path.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        nodes = segs.withColumn("rest", above).where(_literal(F.col("s")) & (F.col("p") >= last)).select("host", "p", "rest", "s").distinct()
        return nodes.groupBy("host", "p", "rest").agg(F.count("*").alias("k")).where(F.col("k") > fan).agg(F.min("p") + 1).first()[0]
    rest = F.sum("h").over(path) - F.col("h")
    here = segs.withColumn("rest", rest).where(_literal(F.col("s")) & (F.lit(True) if last is None else F.col("p") < last - 1))
    return here.groupBy("host", "n", "p", "rest").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a <> b").agg(F.max("p") + 1).first()[0]


def templates(pages: DataFrame, labels: DataFrame, fan: int = FAN, few: int = FEW) -> DataFrame:
    """(host, raw, template, n, good, labelled): every distinct path of a host after the first wildcards, and its template."""
    good = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("__id")).agg(F.min("quality").cast("int").alias("q"))
    parsed = pages.where("url IS NOT NULL").select(F.col("page_id").cast("bigint").alias("__page"), host(F.col("url")).alias("host"), segments(F.col("url")).alias("raw"))
    tree = parsed.join(good, parsed["__page"] == good["__id"], "left").groupBy("host", "raw").agg(F.count("*").alias("n"), F.sum(F.when(F.col("q") == 1, 1).otherwise(0)).alias("good"), F.count("q").alias("labelled")).withColumn("segs", F.col("raw"))
    tree = cut(tree)
    d = 0
    while (d := _next(tree, d, fan)) is not None:
        at = F.try_element_at("segs", F.lit(d))
        node = tree.where(_literal(at)).select("host", F.slice("segs", 1, d - 1).alias("up"), at.alias("child"), "n").groupBy("host", "up", "child").agg(F.sum("n").alias("n"))
        wide = node.groupBy("host", "up").agg(F.count("*").alias("fan")).where(F.col("fan") > fan)
        rare = node.where(F.col("n") < few).join(wide, ["host", "up"]).select(F.col("host").alias("r_host"), F.col("up").alias("r_up"), F.col("child").alias("r_child"))
        joined = tree.join(rare, (tree["host"] == rare["r_host"]) & (F.slice("segs", 1, d - 1) == rare["r_up"]) & (at == rare["r_child"]), "left")
        tree = cut(joined.withColumn("segs", F.when(F.col("r_host").isNotNull(), _replaced(d, "*")).otherwise(F.col("segs"))).select(*tree.columns))
    d = None
    while (d := _next(tree, d)) is not None:
        at = F.try_element_at("segs", F.lit(d))
        branch = tree.where(_literal(at)).select("host", _replaced(d, "").alias("rest"), at.alias("child"), "good", "labelled").groupBy("host", "rest", "child").agg(F.sum("good").alias("g"), F.sum("labelled").alias("l"))
        w = Window.partitionBy("host", "rest")
        pooled = branch.withColumns({"kids": F.count("*").over(w), "share": F.sum("g").over(w) / F.nullif(F.sum("l").over(w), F.lit(0))})
        differs = F.coalesce((F.col("l") > 0) & (F.col("share") > 0) & (F.col("share") < 1) & (F.abs(F.col("g") / F.nullif(F.col("l"), F.lit(0)) - F.col("share")) > Z * F.sqrt(F.col("share") * (1 - F.col("share")) / F.nullif(F.col("l"), F.lit(0)))), F.lit(False))
        marked = pooled.withColumn("differs", differs).withColumn("some", F.max("differs").over(w))
        merge = marked.where((F.col("kids") > 1) & F.when(F.col("l") > 0, ~F.col("differs")).otherwise(~F.col("some"))).select(F.col("host").alias("m_host"), F.col("rest").alias("m_rest"), F.col("child").alias("m_child"))
        joined = tree.join(merge, (tree["host"] == merge["m_host"]) & (_replaced(d, "") == merge["m_rest"]) & (at == merge["m_child"]), "left")
        tree = cut(joined.withColumn("segs", F.when(F.col("m_host").isNotNull(), _replaced(d, "+")).otherwise(F.col("segs"))).select(*tree.columns))
    return tree.select("host", "raw", F.concat(F.lit("/"), F.array_join("segs", "/")).alias("template"), "n", "good", "labelled")


def _replaced(d: int, by: str) -> Column:
    return F.concat(F.slice("segs", 1, d - 1), F.array(F.lit(by)), F.slice("segs", F.lit(d + 1), F.greatest(F.size("segs"), F.lit(1))))


def judged(tree: DataFrame) -> DataFrame:
    """(host, template, n_pages, purity): every template's smoothed purity."""
    sums = tree.groupBy("host", "template").agg(F.sum("n").alias("n_pages"), F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
    prior = tree.agg(F.coalesce((F.sum("good") + 1.0) / (F.sum("labelled") + 2.0), F.lit(0.5)).alias("prior"))
    drawn = lambda good, labelled, to: (F.col(good) + PRIOR_WEIGHT * F.col(to)) / (F.col(labelled) + PRIOR_WEIGHT)
    # The prior is one row, so broadcasting it doesn't grow with the table.
    hosts = sums.groupBy("host").agg(F.sum("good").alias("h_good"), F.sum("labelled").alias("h_labelled")).crossJoin(F.broadcast(prior)).select("host", drawn("h_good", "h_labelled", "prior").alias("h_purity"))
    return sums.join(hosts, "host").select("host", "template", "n_pages", drawn("good", "labelled", "h_purity").alias("purity"))


def filtered(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, host, template, purity, keep) for every row of ``pages``.

    A page's label is the quality of the document of its id (the least, if there are several). A null
    URL has null host and template, the purity 0 and isn't kept; one that is no URL has the host ''.
    Rows that repeat are judged each; a null page_id is carried; a path may have any number of segments, and equal shares
    merge. Only page_id and url are read, whatever other columns there are; an empty table gives no row.
    """
    tree = templates(pages, labels)
    verdict = tree.join(judged(tree), ["host", "template"]).select("host", "raw", "template", F.round("purity", 9).alias("purity"))
    rows = pages.select(F.col("page_id").cast("bigint"), host(F.col("url")).alias("host"), segments(F.col("url")).alias("raw"))
    out = rows.join(verdict, ["host", "raw"], "left")
    return out.select("page_id", "host", "template", F.coalesce("purity", F.lit(0.0)).alias("purity"), (F.coalesce("purity", F.lit(0.0)) >= PURITY).alias("keep"))


def oracle(depth: int = DEPTH, fan: int = FAN, few: int = FEW) -> str:
    literal = lambda d: f"(len(segs) >= {d} AND NOT starts_with(segs[{d}], '*') AND segs[{d}] <> '+')"
    put = lambda d, by: f"list_concat(list_concat(segs[1:{d - 1}], ['{by}']), segs[{d + 1}:])"
    steps = [f"""parsed AS MATERIALIZED (SELECT page_id, lower(regexp_replace(regexp_extract(url, '{_URL}([^/?#]*)', 1), ':[0-9]+$', '')) AS host,
        list_transform(list_filter(string_split(regexp_extract(url, '{_URL}[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> ''),
          lambda s: CASE WHEN regexp_matches(s, '{_VARIABLE}') THEN '*' WHEN regexp_matches(s, '{_WITH_END}') THEN '*' || regexp_extract(s, '{_WITH_END}', 1) ELSE s END) AS p
        FROM pages WHERE url IS NOT NULL)""",
        f"cut AS MATERIALIZED (SELECT page_id, host, CASE WHEN len(p) > {depth} THEN list_concat(p[1:{depth}], ['**']) ELSE p END AS raw FROM parsed)",
        "q AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id)",
        "t0 AS MATERIALIZED (SELECT host, raw, raw AS segs, count(*) AS n, count(*) FILTER (q = 1) AS good, count(q) AS labelled FROM cut LEFT JOIN q ON page_id = doc_id GROUP BY host, raw)"]
    k = 0
    for d in range(1, depth + 1):
        steps += [
            f"node{d} AS MATERIALIZED (SELECT host, segs[1:{d - 1}] AS up, segs[{d}] AS child, sum(n) AS n FROM t{k} WHERE {literal(d)} GROUP BY ALL)",
            f"rare{d} AS MATERIALIZED (SELECT host, up, child FROM node{d} JOIN (SELECT host, up FROM node{d} GROUP BY ALL HAVING count(*) > {fan}) USING (host, up) WHERE n < {few})",
            f"t{k + 1} AS MATERIALIZED (SELECT t.host, raw, CASE WHEN r.host IS NOT NULL THEN {put(d, '*')} ELSE segs END AS segs, n, good, labelled FROM t{k} t LEFT JOIN rare{d} r ON t.host = r.host AND segs[1:{d - 1}] = up AND len(segs) >= {d} AND segs[{d}] = child)",
        ]
        k += 1
    for d in range(depth, 0, -1):
        steps += [
            f"branch{d} AS MATERIALIZED (SELECT host, {put(d, '')} AS rest, segs[{d}] AS child, sum(good) AS g, sum(labelled) AS l FROM t{k} WHERE {literal(d)} GROUP BY ALL)",
            f"pooled{d} AS (SELECT *, count(*) OVER w AS kids, sum(g) OVER w / nullif(sum(l) OVER w, 0) AS share FROM branch{d} WINDOW w AS (PARTITION BY host, rest))",
            f"marked{d} AS (SELECT *, bool_or(differs) OVER (PARTITION BY host, rest) AS any_differs FROM (SELECT *, coalesce(l > 0 AND share > 0 AND share < 1 AND abs(g / nullif(l, 0) - share) > {Z} * sqrt(share * (1 - share) / nullif(l, 0)), false) AS differs FROM pooled{d}))",
            f"merge{d} AS MATERIALIZED (SELECT host, rest, child FROM marked{d} WHERE kids > 1 AND NOT CASE WHEN l > 0 THEN differs ELSE any_differs END)",
            f"t{k + 1} AS MATERIALIZED (SELECT t.host, raw, CASE WHEN m.host IS NOT NULL THEN {put(d, '+')} ELSE segs END AS segs, n, good, labelled FROM t{k} t LEFT JOIN merge{d} m ON t.host = m.host AND len(segs) >= {d} AND {put(d, '')} = rest AND segs[{d}] = child)",
        ]
        k += 1
    steps += [
        f"tree AS MATERIALIZED (SELECT host, raw, '/' || array_to_string(segs, '/') AS template, good, labelled FROM t{k})",
        "prior AS (SELECT (sum(good) + 1.0) / (sum(labelled) + 2.0) AS prior FROM tree)",
        f"hosts AS (SELECT host, (sum(good)::DOUBLE + {PRIOR_WEIGHT} * any_value(prior)::DOUBLE) / (sum(labelled)::DOUBLE + {PRIOR_WEIGHT}) AS h FROM tree, prior GROUP BY host)",
        f"judged AS (SELECT host, template, round((sum(good)::DOUBLE + {PRIOR_WEIGHT} * any_value(h)::DOUBLE) / (sum(labelled)::DOUBLE + {PRIOR_WEIGHT}), 9) AS purity FROM tree JOIN hosts USING (host) GROUP BY host, template)",
    ]
    return "WITH " + ",\n".join(steps) + f"""
    SELECT page_id, host, template, purity, purity >= {PURITY} AS keep FROM cut JOIN tree USING (host, raw) JOIN judged USING (host, template)
    UNION ALL SELECT page_id, NULL, NULL, 0.0, false FROM pages WHERE url IS NULL"""
