"""Line dedup by site-relative frequency, in DataFrame operations only.

A line, without the blanks at its ends, is boilerplate on a host if the share of the
host's pages that contain it exceeds `ratio`. All boilerplate lines go, from all texts of
the host. Every row is a page, copies included; with `copies_once` equal texts of a host
count as one page. A line on a single page is repeated nowhere and is never boilerplate,
nor are blank lines: `least_pages` (2) says so for hosts of fewer than 1 / ratio pages.

Lines are counted with map-side sums; what is exchanged is one row for each host, line
hash and task. A host has under (distinct lines of a page, on average) / ratio boilerplate
lines, so their hashes fit in one array for each host, and texts never cross the network
unless the table of these arrays is too large to broadcast; then the join by host is
split by AQE where a host is large. Very long texts are split like others, in the row.

Null hosts are one host (""). Null text stays null and counts as an empty page; an empty
text stays empty. Repeated rows and equal ids are pages of their own, cleaned row by row.
A line at the ratio exactly stays. An empty table gives no rows. Other columns pass
through unchanged, save that n_lines and n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, load

RATIO, LEAST_PAGES = 0.08, 2
BLANKS = " \t\r"


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit(BLANKS)))


def _host(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def boilerplate(df: DataFrame, host_col: str, text_col: str, ratio: float, least_pages: int, copies_once: bool = False) -> DataFrame:
    """_host and _lines, the sorted hashes of its boilerplate lines."""
    pages = df.select(_host(host_col).alias("_host"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    count = F.count("*")
    if copies_once:
        pages, count = pages.withColumn("page", F.xxhash64("t", F.length("t"))), F.count_distinct("page")
    totals = pages.groupBy("_host").agg(count.alias("pages"))
    lines = F.explode(F.array_distinct(F.transform(F.split("t", "\n"), _key))).alias("line")
    counts = pages.select("_host", *(["page"] if copies_once else []), lines).groupBy("_host", "line").agg(count.alias("n"))
    often = counts.where((F.col("line") != F.xxhash64(F.lit(""))) & (F.col("n") >= least_pages))
    often = often.join(totals, "_host").where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return often.groupBy("_host").agg(F.sort_array(F.collect_list("line")).alias("_lines"))


def drop_boilerplate(
    df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, copies_once: bool = False
) -> DataFrame:
    """df with cleaned texts and n_lines, n_dropped."""
    scratch = Scratch(df.sparkSession, "lines")
    found = scratch.hint(scratch.table(boilerplate(df, host_col, text_col, ratio, least_pages, copies_once)))
    columns = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    others = [F.col(f"`{c}`") for c in columns if c != text_col] or [F.lit(0)]
    rows = df.select(F.struct(*others).alias("row"), F.col(f"`{text_col}`").alias("t"), _host(host_col).alias("_host"))
    rows = rows.join(found, "_host", "left").withColumn("split", F.split("t", "\n"))
    clean = F.filter("split", lambda x: ~F.array_contains("_lines", _key(x)))
    rows = rows.withColumn("left", F.when(F.col("_lines").isNull(), F.col("split")).otherwise(clean))
    rows = rows.withColumn("n", F.size("split") - F.size("left"))
    text = F.when(F.col("n") > 0, F.array_join("left", "\n")).otherwise(F.col("t"))
    return rows.select(
        *[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in columns],
        F.coalesce(F.size("split"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_dropped"),
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_boilerplate(load(spark, sf_dir, "documents").select("doc_id", "source", "text"))


#: Written from the method: pages that contain a line over all pages of the host.
ORACLE = f"""
WITH l AS (
  SELECT DISTINCT rowid AS r, coalesce(source, '') AS host, trim(unnest(string_split(coalesce(text, ''), chr(10))), chr(32) ||
  chr(9) || chr(13)) AS line
  FROM (SELECT row_number() OVER () AS rowid, source, text FROM documents)),
f AS (SELECT host, line, count(*) AS n FROM l WHERE line <> '' GROUP BY host, line),
t AS (SELECT coalesce(source, '') AS host, count(*) AS pages FROM documents GROUP BY 1),
b AS (SELECT host, list(line) AS lines FROM f JOIN t USING (host) WHERE n > {RATIO}::DOUBLE * pages AND n >= {LEAST_PAGES} GROUP BY host),
k AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS s,
         list_filter(s, lambda x: NOT list_contains(coalesce(b.lines, []), trim(x, chr(32) || chr(9) || chr(13)))) AS kept
  FROM documents LEFT JOIN b ON coalesce(documents.source, '') = b.host)
SELECT doc_id, source, CASE WHEN len(kept) < len(s) THEN array_to_string(kept, chr(10)) ELSE text END AS text,
       CAST(coalesce(len(s), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(s) - len(kept), 0) AS BIGINT) AS n_dropped
FROM k
"""
