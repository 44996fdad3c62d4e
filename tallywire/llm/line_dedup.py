"""Remove boilerplate lines: lines that stand on many different sites.

Each line hash has a HyperLogLog sketch of its sites; sketches merge as partial aggregates, so a line on a third of all
documents costs one small row a task. Sketches settle lines far from the threshold. Lines near it are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sketch of 2^12 registers has a relative error of 1.6 %; estimates within this share of the threshold are counted exactly.
LG_K, NEAR = 12, 0.25
SPACE = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _has_word(line: Column) -> Column:
    return F.length(F.translate(line, SPACE, "")) > 0


def _hash(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(docs: DataFrame, min_sites: int, site: str = "source", text: str = "text") -> DataFrame:
    """(line_hash) of every line with a word that stands on `min_sites` different sites or more. Rows without a site count
    for none."""
    distinct = F.array_distinct(F.filter(lines_of(F.col(text)), _has_word))
    lines = docs.select(F.col(site).cast("string").alias("site"), F.explode(distinct).alias("line")).select("site", _hash(F.col("line")).alias("line_hash"))
    spread = lines.groupBy("line_hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    far = spread.where(F.col("sites") > min_sites * (1 + NEAR)).select("line_hash")
    near = spread.where(F.col("sites").between(min_sites * (1 - NEAR), min_sites * (1 + NEAR))).select("line_hash")
    exact = lines.join(near, "line_hash", "left_semi").distinct().groupBy("line_hash").agg(F.count("site").alias("sites"))
    return far.union(exact.where(F.col("sites") >= min_sites).select("line_hash"))


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, key: str = "doc_id", site: str = "source", text: str = "text") -> DataFrame:
    """One row per document: its columns in the struct `doc`, kept_text, n_lines and n_removed (lines with a word).

    Blank lines stay. A line counts once for a document's site, however often it stands there, and all its copies go if it
    is boilerplate. A null text stays null; a text of boilerplate only becomes empty or blank; documents are never
    dropped; repeated or null keys are safe, since removal depends on the line alone; an empty table gives no rows.
    """
    bad = boilerplate(docs, min_sites, site, text)
    found = docs.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.filter(lines_of(F.col(text)), _has_word))).alias("line"))
    found = found.select("key", _hash(F.col("line")).alias("line_hash")).join(bad, "line_hash", "left_semi")
    gone = found.groupBy("key").agg(F.collect_set("line_hash").alias("gone"))  # at most the lines of one document
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.col(key).alias("id"), F.col(text).alias("body"))
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("key")), "left")
    stays = lambda x: ~F.coalesce(F.array_contains(F.col("gone"), _hash(x)), F.lit(False)) | ~_has_word(x)
    lines = lines_of(F.col("body"))
    kept = F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    return joined.select(
        "doc",
        kept.alias("kept_text"),
        F.size(F.filter(lines, _has_word)).cast("bigint").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size(F.filter(lines, lambda x: ~stays(x)))).cast("bigint").alias("n_removed"),
    )
