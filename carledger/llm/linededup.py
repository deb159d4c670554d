"""Repeated passages: overlapping windows of three lines.

Consecutive lines that hold a word form windows of three, one from each line
on. Windows are hashed (128 bits) and grouped over the whole corpus; the
first occurrence, by (doc_id, line), stays, and all lines that later
occurrences cover are removed, overlapping windows merged. Every removed
line thus has an equal line that stays. Lines without a word are in no
window and stay.

A window that many documents share is reduced by map-side minima, and the
join that marks its later occurrences is one whose large partitions Spark
splits. Only one document's own lines ever meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carledger.llm.common import stage

WINDOW = 3
HAS_WORD = r"[^\x20\x09-\x0D]"


def _windows(text: Column) -> Column:
    """array<struct<a, b, at: array of line numbers>> of a text's windows."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.when(x.rlike(HAS_WORD), F.struct(
        i.alias("at"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))))
    full = F.filter(lines, lambda x: x.isNotNull())

    def windows(f: Column) -> Column:
        part = lambda i, k: F.get(f, i + k)
        first = F.slice(F.sequence(F.lit(0), F.size(f)), F.lit(1), F.greatest(F.size(f) - (WINDOW - 1), F.lit(0)))
        return F.transform(first, lambda i: F.struct(
            F.xxhash64(*[part(i, k)["a"] for k in range(WINDOW)]).alias("a"),
            F.xxhash64(F.lit(2), *[part(i, k)["b"] for k in range(WINDOW)]).alias("b"),
            F.array(*[part(i, k)["at"] for k in range(WINDOW)]).alias("at")))
    # The lines are computed once, as the only element of an array.
    return F.flatten(F.transform(F.array(full), windows))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", count: str = "n_removed") -> DataFrame:
    """``docs`` with repeated passages removed from ``text`` and a column
    ``count``, the number of lines removed (it replaces a column of that
    name). Null, empty and short texts (under three lines with a word) stay
    as they are. Rows with equal id and text count as one document and get
    the same result; rows with equal id and other texts are ordered by a hash
    of the text; a null id comes last. A very long text is read whole, in one
    task; an empty table gives an empty one."""
    key = F.struct(F.coalesce(F.col(doc_id).cast("long"), F.lit(2 ** 63 - 1)), F.xxhash64(doc_id, text))
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), key.alias("key"))
    found = (rows.select("key", F.explode(_windows(F.col("text"))).alias("w"))
             .select("key", F.col("w.a").alias("a"), F.col("w.b").alias("b"), F.col("w.at").alias("at")))
    place = F.struct("key", F.get("at", F.lit(0)).alias("line"))
    # min and max of all occurrences tell whether there are two of them.
    again = stage(found.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                  .filter("first <> last").select("a", "b", "first"), "repeats")
    later = found.join(again, ["a", "b"]).filter(place != F.col("first"))
    gone = (later.select("key", F.explode("at").alias("line")).groupBy("key")
            .agg(F.collect_set("line").alias("gone")).withColumnRenamed("key", "of"))
    lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    joined = rows.join(gone, rows["key"] == gone["of"], "left").withColumn("lines", F.when(F.col("gone").isNotNull(), lines))
    cleaned = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    out = joined.select("row", cleaned.alias("new"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n"))
    names = [c for c in docs.columns if c != count]
    return out.select(*[F.col("new").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in names],
                      F.col("n").alias(count))


def cleaned(docs: DataFrame) -> DataFrame:
    """Per document: the text that stays and the number of removed lines."""
    return remove_repeats(docs.select("doc_id", "text"))


def drop_repeats(docs: DataFrame, length: str | None = None) -> DataFrame:
    """``docs`` with repeated passages removed; a document of which no word
    is left was all repeats, and goes. ``length``: a column that is set to
    the new length of a changed text."""
    n = "n_removed"
    while n in docs.columns:
        n += "_"
    rows = remove_repeats(docs, count=n)
    left = F.coalesce(F.col("text").rlike(HAS_WORD), F.lit(False))
    rows = rows.filter((F.col(n) == 0) | left)
    if length in docs.columns:
        kind = docs.schema[length].dataType
        rows = rows.withColumn(length, F.when(F.col(n) == 0, F.col(length)).otherwise(F.length("text").cast(kind)))
    return rows.select(*docs.columns)


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
full_lines AS (
  SELECT doc_id, pos, line FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
windows AS (
  SELECT doc_id, pos AS p0, lead(pos, 1) OVER w AS p1, lead(pos, 2) OVER w AS p2,
         line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS body
  FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, p0) AS k FROM windows WHERE p2 IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, unnest([p0, p1, p2]) AS pos FROM ranked WHERE k > 1),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
  WHERE g.pos IS NULL GROUP BY l.doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN c.n IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN counts c USING (doc_id)
"""
