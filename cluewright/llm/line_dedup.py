"""Line dedup: drop lines whose normalised form stands in many documents.

Lines are exploded as 16-byte hashes, each once per document, counted with a
partial aggregate before the shuffle, and the hashes over the threshold are
joined back, by broadcast while they are few. Texts themselves move once, to meet the positions to drop. Every
step is a DataFrame operation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, digest, load, scratch, stored, text_of, without

MIN_DOCUMENTS, MIN_LENGTH = 10, 1
#: Keys of common lines, of 16 bytes each, that are broadcast at most.
BROADCAST_KEYS = 500_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _matched(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """lines whose h is among keys, a table. Few keys are broadcast; beyond, the join shuffles and adaptive execution splits hot keys."""
    few = keys.count() <= BROADCAST_KEYS
    return lines.join(F.broadcast(keys) if few else keys, "h", "left_semi")


def line_dedup(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_length: int = MIN_LENGTH, copies_once: bool = False) -> DataFrame:
    """docs with their lines of common keys dropped, and n_lines, n_dropped.

    A key is the line without white space at its ends and with A-Z lower-cased.
    Keys of at least min_length code points that stand in at least
    min_documents rows lose all their lines. Each row counts as one document,
    so repeated rows and ids count each time; with copies_once, equal texts
    are one document, so that copies alone never empty each other. A null or
    empty text is one empty line and comes back empty. Columns named n_lines or
    n_dropped are replaced, others kept. An empty table gives an empty result.
    Texts of any length are taken whole.
    """
    docs = without(docs, ["n_lines", "n_dropped", "__text", "__drop", "__lines"])
    texts = docs.select(text_of().alias("t"))
    keys = F.transform(F.split("t", "\n"), line_key)
    hashed = F.transform(keys, lambda k: F.when(F.char_length(k) >= min_length, digest(k)))
    with scratch(docs.sparkSession):
        own = texts.select(digest(F.col("t")).alias("__text"), F.array_distinct(hashed).alias("hs"))
        own = own.dropDuplicates(["__text"]) if copies_once else own  # hashes move, not texts, and copies are one row before they do
        found = own.select(F.explode("hs").alias("h")).where(F.col("h").isNotNull())
        common = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_documents).select("h")
        common = stored(common, "common-lines", result=True)
    # Positions depend on the text alone: one copy of equal texts looks them up.
    lines = texts.select(digest(F.col("t")).alias("__text"), F.posexplode(hashed).alias("i", "h")).where(F.col("h").isNotNull())
    drops = _matched(lines, common).select("__text", "i").distinct().groupBy("__text").agg(F.collect_list("i").alias("__drop"))
    # The runs of lines between dropped ones; cutting runs takes time in proportion to the lines.
    ends = F.array_sort("__drop")
    runs = F.zip_with(F.array_prepend(ends, F.lit(-1)), F.array_append(ends, F.size("__lines")), lambda a, b: F.slice("__lines", a + 2, b - a - 1))
    # Lines are split before the join, so that no run splits the text again.
    out = docs.withColumn("__text", digest(text_of())).withColumn("__lines", F.split(text_of(), "\n")).drop("text").join(drops, "__text", "left")
    text = F.array_join(F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(F.flatten(runs)), "\n")
    return out.select(
        *[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT rid, doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
        FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
common AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10),
marked AS (SELECT l.rid, l.doc_id, l.i, l.line, c.k IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.k = c.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""
