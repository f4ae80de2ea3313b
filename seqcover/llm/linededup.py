"""Line dedup by site-relative frequency, with DataFrame functions only.

A site is the value of a host column (null is a site of its own). For each site, the share of its pages that contain a
line is the pages with the line divided by all pages of the site; a line whose share is over RATIO (a share of just
RATIO isn't) is boilerplate of that site, and every occurrence of it on that site goes. A line of a single page repeats
nothing and stays, so that a site of one page keeps its text. Lines are split at line feeds and compared as they are, in
texts of any length; blank ones (nothing but white space) are never counted and always stay. Repeated rows count as
pages of their own. A null text is a page without lines and stays null; no rows give no rows.

Only digests of lines are shuffled, counted before the shuffle, so a site with a third of all pages or a line on all
of them is spread over the tasks. A site has at most (mean lines a page) / RATIO boilerplate lines; they travel as one
array for each site, broadcast if their bytes are at most BROADCAST_BYTES and else joined by site, where Spark splits
large sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RATIO = 0.05
BROADCAST_BYTES = 32 << 20


def _blank(line: Column) -> Column:
    return F.length(F.regexp_replace(line, r"\s+", "")) == 0


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO) -> DataFrame:
    """_host and the digests of its boilerplate lines, for each site that has any."""
    site = docs.select(F.col(host).alias("_host"), "text")
    lines = F.filter(F.array_distinct(F.split("text", "\n", -1)), lambda x: ~_blank(x))
    # one row of the site itself (no digest) beside one for each distinct line of a page
    marked = site.select("_host", F.explode(F.concat(F.array(F.lit(None).cast("binary")), F.coalesce(F.transform(lines, _digest), F.array().cast("array<binary>")))).alias("_line"))
    counts = marked.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("n")).where(F.col("_line").isNull() | (F.col("n") > 1))
    totals = counts.where("_line is null").select(F.col("_host").alias("_site"), F.col("n").alias("total"))
    over = counts.where("_line is not null").join(totals, F.col("_host").eqNullSafe(F.col("_site"))).where(F.col("n") > F.lit(ratio) * F.col("total"))
    return over.groupBy("_host").agg(F.sort_array(F.collect_list("_line")).alias("_common"))


def _cleaned(docs: DataFrame, host: str, ratio: float) -> DataFrame:
    """docs, then the lines before and those removed, under unused names."""
    site, lines_, kept_, n_, gone_ = (common.unused(c, docs.columns) for c in ("_site", "_common", "_kept", "_n_lines", "_n_removed"))
    found = common.stored(boilerplate(docs.select(F.col(host).alias("_host"), "text"), "_host", ratio), "boilerplate")
    size = found.agg(F.sum(16 * F.size("_common") + F.coalesce(F.octet_length(F.col("_host").cast("string")), F.lit(0)))).first()[0]
    side = found.select(F.col("_host").alias(site), F.col("_common").alias(lines_))
    lines = F.split("text", "\n", -1)
    kept = F.when(F.col(lines_).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col(lines_), _digest(x))))
    joined = docs.join(F.broadcast(side) if (size or 0) <= BROADCAST_BYTES else side, F.col(host).eqNullSafe(F.col(site)), "left").withColumn(kept_, kept)
    text = F.when(F.col("text").isNotNull(), F.array_join(kept_, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_removed = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines) - F.size(kept_)).cast("long")
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], n_lines.alias(n_), n_removed.alias(gone_))


def cleaned(docs: DataFrame, host: str = "source", ratio: float = RATIO) -> DataFrame:
    """docs with text rid of boilerplate lines, n_lines before and n_removed; these take the place of columns of the same names."""
    out = _cleaned(docs, host, ratio)
    before, gone = out.columns[-2:]
    return out.drop("n_lines", "n_removed").withColumnsRenamed({before: "n_lines", gone: "n_removed"})


def clean(docs: DataFrame, host: str = "source", ratio: float = RATIO) -> DataFrame:
    """docs, with the same columns and rows, whose text has lost its boilerplate lines."""
    return _cleaned(docs, host, ratio).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return cleaned(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


ORACLE = r"""
WITH pages AS (SELECT row_number() OVER () AS row_id, doc_id, source, text FROM documents),
l AS (SELECT row_id, source, k, line, regexp_replace(line, '\s+', '', 'g') = '' AS blank
      FROM (SELECT row_id, source, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS line
            FROM (SELECT row_id, source, string_split(text, chr(10)) AS ls FROM pages WHERE text IS NOT NULL))),
totals AS (SELECT source, count(*) AS total FROM pages GROUP BY source),
common AS (SELECT x.source, x.line FROM (SELECT DISTINCT row_id, source, line FROM l WHERE NOT blank) x JOIN totals ON x.source IS NOT DISTINCT FROM totals.source
           GROUP BY x.source, x.line, total HAVING count(*) > 1 AND count(*) > 0.05::DOUBLE * total),
marked AS (SELECT l.*, common.line IS NOT NULL AS gone FROM l LEFT JOIN common ON l.source IS NOT DISTINCT FROM common.source AND l.line = common.line),
made AS (SELECT row_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM marked GROUP BY row_id)
SELECT doc_id, source, made.text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed FROM pages LEFT JOIN made USING (row_id)
"""
