"""Line dedup by distinct-site spread, in DataFrame functions only.

A line (without outer spaces; empty ones never count) is boilerplate if it occurs on at least ``min_sites``
different sites. Each line's hash gets a HyperLogLog sketch of its sites; sketches are made before the
shuffle and merged by the aggregation, so a line that is everywhere costs one sketch for each task. Lines whose
estimate is within ``BAND`` of the threshold, six standard errors of the sketch, get an exact distinct count
instead. Boilerplate lines are then removed from each document by position.

Lines are told apart by 128 bits of hash. A line with many occurrences is never gathered: it is broadcast with the
few others like it. Defined results: null text is empty; a null site counts as a site of its own; a document that
consists of boilerplate alone becomes empty; repeated rows each get a row; rows with null doc_id are treated like
others (told apart by their text); columns named n_lines and n_removed are replaced, others kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize
from quillgraph.operators.skew import join_frequent

MIN_SITES = 5
LG_K = 12
BAND = 0.1


def _lines(documents: DataFrame, site: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id"), F.xxhash64(text).alias("of"), F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("-")).alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    line = F.trim("line")
    return rows.where(line != "").select("doc_id", "of", "site", "pos", F.xxhash64(line).alias("h"), F.xxhash64(F.lit("second"), line).alias("g"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, g, n) of the lines (h, g, site) that occur on ``min_sites`` sites or more, with their number of occurrences; materialised."""
    spread = lines.groupBy("h", "g").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), F.count(F.lit(1)).alias("n"))
    wide = materialize(spread.where(F.col("sites") >= min_sites * (1 - BAND)))
    near = wide.where(F.col("sites") <= min_sites * (1 + BAND)).select("h", "g", "n")
    # near the threshold a line has few sites: what is shuffled are its distinct ones, found before the shuffle
    sites = _occurrences(lines, near).select("h", "g", "site").distinct()
    exact = sites.groupBy("h", "g").agg(F.count(F.lit(1)).alias("exact")).where(F.col("exact") >= min_sites).select("h", "g")
    return materialize(wide.where(F.col("sites") > min_sites * (1 + BAND)).select("h", "g", "n").unionByName(near.join(exact, ["h", "g"])))


def _occurrences(lines: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows of ``lines`` whose line is ``listed`` (h, g, n); lines with many occurrences are not gathered."""
    key = F.struct("h", "g").alias("line")
    return join_frequent(lines.select("*", key), listed.select(key, "n"), "line", "n", lines.count()).drop("line")


def dedup_lines(documents: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``documents`` with boilerplate lines taken out of ``text``, and (n_lines, n_removed), which replace columns of these names."""
    lines = materialize(_lines(documents, site))
    common = boilerplate(lines, min_sites)
    marked = _occurrences(lines, common).groupBy("doc_id", "of").agg(F.collect_set("pos").alias("gone"))
    marked = marked.select(F.col("doc_id").alias("__qg_id"), F.col("of").alias("__qg_of"), F.col("gone").alias("__qg_gone"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = documents.join(marked, documents["doc_id"].eqNullSafe(F.col("__qg_id")) & (F.xxhash64(text) == F.col("__qg_of")), "left")
    split = joined.withColumn("__qg_parts", F.split(text, "\n"))
    # positions are subtracted as sets, then looked up: linear in the lines
    stays = F.array_except(F.sequence(F.lit(0), F.size("__qg_parts") - 1), F.col("__qg_gone"))
    kept = F.transform(stays, lambda i: F.get("__qg_parts", i))
    out = split.withColumns(
        {
            "text": F.when(F.col("__qg_gone").isNull(), text).otherwise(F.array_join(kept, "\n")),
            "n_lines": F.size("__qg_parts").cast("long"),
            "n_removed": F.when(F.col("__qg_gone").isNull(), 0).otherwise(F.size("__qg_gone")).cast("long"),
        }
    )
    return out.drop("__qg_id", "__qg_of", "__qg_gone", "__qg_parts")
