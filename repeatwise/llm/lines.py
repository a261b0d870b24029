"""Site-relative line frequency: lines that much of a site repeats are boilerplate.

Pages are grouped by host. A line's frequency is the number of the host's pages that hold
it, divided by the number of all pages of the host; lines over `ratio` that at least
`min_pages` pages hold are dropped from every page of that host. Lines are what "\\n"
separates and are compared without surrounding blanks; blank lines are never dropped.

A page counts once however often it repeats a line; equal rows are pages of their own. Null
hosts are one host. A null text stays null and an empty one empty, and both count as pages.

Only built-in functions run. Lines are counted per (host, 128-bit hash) with partial sums
before the shuffle, so a host or a line with a third of all pages sends one row from each
task. A host has at most (lines of an average page) / ratio lines over the ratio, so its
list is small. The lists are written and measured: up to `BROADCAST_BYTES` for all hosts
together they are broadcast, and the pages aren't shuffled at all; beyond that both meet in a
join on host, whose skewed side Spark splits. Both give the same rows. An empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatwise.llm.work import fresh, stored

#: Bytes of boilerplate hashes that are broadcast.
BROADCAST_BYTES = 32 << 20
HASH_BYTES = 16


def _hash(line: Column) -> Column:
    line = F.trim(line)
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"))


def boilerplate(pages: DataFrame, text: str, host: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, n_pages, lines): the hashes of the lines over the ratio, for every host that has any."""
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda x: F.trim(x) != "")
    rows = pages.select(
        F.col(host).alias("host"),
        F.explode_outer(F.array_distinct(F.transform(lines, _hash))).alias("line"),
        F.lit(0).alias("page"))
    # A row without a line for each page gives the total in the same shuffle.
    totals = pages.select(F.col(host).alias("host"), F.lit(None).cast("struct<a: long, b: long>").alias("line"),
                          F.lit(1).alias("page"))
    counted = rows.where("line IS NOT NULL").union(totals).groupBy("host", "line") \
        .agg(F.count("*").alias("n"), F.max("page").alias("page"))
    total = counted.where("page = 1").select(F.col("host").alias("h"), F.col("n").alias("n_pages"))
    return counted.where((F.col("page") == 0) & (F.col("n") >= min_pages)) \
        .join(total, F.col("host").eqNullSafe(F.col("h"))) \
        .where(F.col("n") > F.lit(ratio) * F.col("n_pages")) \
        .groupBy("host", "n_pages").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(pages: DataFrame, text: str = "text", host: str = "source",
                     ratio: float = 0.1, min_pages: int = 5, n_lines: str | None = None,
                     n_dropped: str | None = None) -> DataFrame:
    """`pages` with boilerplate lines taken out of `text`, in the order of columns it had.

    `n_lines` and `n_dropped` name further columns: the lines a page had, and lost.
    """
    found = boilerplate(pages, text, host, ratio, min_pages)
    own, lines, before, after = (fresh(pages, x) for x in ("_host", "_boilerplate", "_before", "_after"))
    found = stored(found.select(F.col("host").alias(own), F.col("lines").alias(lines)), "boilerplate")
    size = found.agg(F.sum(F.size(lines) * HASH_BYTES + F.coalesce(F.octet_length(own), F.lit(0)))).first()[0]
    if (size or 0) <= BROADCAST_BYTES:
        found = F.broadcast(found)
    joined = pages.join(found, pages[host].eqNullSafe(found[own]), "left") \
        .withColumn(before, F.split(F.col(text), "\n", -1)) \
        .withColumn(after, F.when(F.col(lines).isNull(), F.col(before)).otherwise(F.filter(
            before, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(lines), _hash(x)))))
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    more = {}
    if n_lines:
        more[n_lines] = count(before)
    if n_dropped:
        more[n_dropped] = count(before) - count(after)
    kept = [F.array_join(after, "\n").alias(c) if c == text else F.col(c) for c in pages.columns]
    return joined.select(*kept, *(v.alias(k) for k, v in more.items()))


#: DuckDB: the same rows from the view {docs}, which has doc_id, text and source.
SQL = """
lined AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM {docs}),
totals AS (SELECT source, count(*) AS n_pages FROM lined GROUP BY source),
often AS (
  SELECT l.source, l.line FROM (
    SELECT source, unnest(list_distinct(list_filter(list_transform(ls, lambda x: trim(x, ' ')), lambda x: x <> ''))) AS line
    FROM lined) l
  JOIN totals t ON t.source IS NOT DISTINCT FROM l.source
  GROUP BY l.source, l.line, t.n_pages
  HAVING count(*) >= {min_pages} AND count(*) > {ratio} * t.n_pages),
per_source AS (SELECT source, list(line) AS gone FROM often GROUP BY source),
cleaned AS (
  SELECT d.doc_id, d.source, d.ls,
         list_filter(d.ls, lambda x: trim(x, ' ') = '' OR NOT list_contains(coalesce(o.gone, []), trim(x, ' '))) AS rest
  FROM lined d LEFT JOIN per_source o ON o.source IS NOT DISTINCT FROM d.source)
"""
