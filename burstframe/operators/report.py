"""Reports of a run: counters, nested groups as JSON, an HTML page, and the log of progress."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counters(groups: DataFrame, burst_picks: DataFrame, plan: DataFrame, composition_picks: DataFrame | None = None) -> DataFrame:
    """One row: photo_count, burst_count, composition_count, picked_count, rejected_count.

    Without compositions a burst that has no score counts as picked, and an unscored photo of a scored
    burst counts neither way.
    """
    base = groups.agg(F.count("*").alias("photo_count"), F.count_distinct("group_id").alias("burst_count"))
    if composition_picks is not None and not composition_picks.isEmpty():
        counts = plan.agg(F.count_if(F.col("verdict") == "picked").alias("picked_count"), F.count_if(F.col("verdict") == "rejected").alias("rejected_count"))
        made = composition_picks.agg(F.count_distinct("composition_id").alias("composition_count"))
    else:
        judged = burst_picks.groupBy("group_id").agg(F.count_if(F.col("verdict") == "kept").alias("kept"), F.count_if(F.col("verdict") == "rejected").alias("out"))
        sizes = groups.groupBy("group_id").agg(F.count("*").alias("n")).join(judged, "group_id", "left")
        counts = sizes.agg(F.coalesce(F.sum(F.coalesce("kept", "n")), F.lit(0)).alias("picked_count"), F.coalesce(F.sum(F.coalesce("out", F.lit(0))), F.lit(0)).alias("rejected_count"))
        made = counts.select(F.lit(0).cast("bigint").alias("composition_count"))
    # Each side is one row.
    return base.crossJoin(made).crossJoin(counts)


def nested(groups: DataFrame, picks: DataFrame, group: str = "group_id") -> DataFrame:
    """(group, report): a JSON object for each group, its photos by rank; the unscored have neither rank nor score, and come last."""
    known = picks.select(group, "photo_id", "rank", "verdict", F.round("value", 9).alias("value"))
    rows = groups.select(group, "photo_id").join(known, [group, "photo_id"], "left")
    one = F.struct("photo_id", F.coalesce("verdict", F.lit("unscored")).alias("verdict"), "rank", "value")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("rank", F.lit(2**31 - 1)).alias("r"), F.col("photo_id").alias("p"), one.alias("one")))), lambda x: x["one"])
    return rows.groupBy(group).agg(listed.alias("photos")).select(group, F.to_json(F.struct(F.col(group).alias("id"), "photos")).alias("report"))


def page(reports: DataFrame, title: str = "Cull report", header: dict | None = None, compositions: DataFrame | None = None) -> str:
    """A self-contained HTML page of all nested reports, by id, with a run's figures above and its compositions below.
    The driver holds the page; for runs too large for one, ``write_page`` writes it in parts."""
    import json

    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    parts += [f"<p>{html.escape(k)}: {html.escape(str(v))}" for k, v in (header or {}).items()]
    for name, some in (("", reports), ("<h1>Compositions</h1>", compositions)):
        if some is None:
            continue
        parts.append(name)
        for row in some.orderBy(some.columns[0]).toLocalIterator():
            one = json.loads(row["report"])
            cells = "".join(f"<li class={p['verdict']}>{p['photo_id']} {p['verdict']}" + (f" #{p['rank']} {p['value']:.3f}" if "rank" in p else "") for p in one["photos"])
            parts.append(f"<h2>{html.escape(str(one['id']))}</h2><ol>{cells}</ol>")
    return "\n".join(parts)


def write_page(reports: DataFrame, path: str) -> None:
    """All groups as HTML text files below ``path``, in order of id from file to file; no machine holds them all."""
    one = F.from_json("report", "id bigint, photos array<struct<photo_id:bigint,verdict:string,rank:int,value:double>>")
    cell = lambda p: F.concat(F.lit("<li class="), p["verdict"], F.lit(">"), p["photo_id"].cast("string"), F.lit(" "), p["verdict"], F.coalesce(F.concat(F.lit(" #"), p["rank"].cast("string"), F.lit(" "), F.format_number(p["value"], 3)), F.lit("")))
    text = F.concat(F.lit("<h2>"), F.col("one.id").cast("string"), F.lit("</h2><ol>"), F.array_join(F.transform("one.photos", cell), ""), F.lit("</ol>"))
    reports.orderBy(reports.columns[0]).select(one.alias("one")).select(text.alias("value")).write.text(path)


def snapshot(log: DataFrame) -> DataFrame:
    """(run_id, seq, kind, stage, done) that a late follower of each run is sent: every stage and finish, the last tick of every stage, and done.

    ``log`` has run_id, seq, kind (stage, tick, finish, done), stage and done. A tick counts for its own stage.
    """
    w = Window.partitionBy("run_id", "kind", "stage").orderBy(F.col("seq").desc())
    last = log.withColumn("__n", F.row_number().over(w))
    return last.where((F.col("kind") != "tick") | (F.col("__n") == 1)).select("run_id", "seq", "kind", "stage", "done")
