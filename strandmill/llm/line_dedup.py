"""Line dedup over range-partitioned line hashes, with DataFrame functions only.

Lines become narrow rows of hashes. They are range-partitioned by the hash of their key with a secondary sort by document
and position, so that one pass over each range streams a key's occurrences: its documents are counted and its first
occurrence is known as the rows go by. What goes back to a document is no text but a bitmap of the lines that it keeps,
compressed: 64 lines a word, and only words that lose a line.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, table

#: ASCII white space, which the key of a line doesn't have at its ends.
BLANKS = " \t\n\v\f\r"
#: Keys that the sketch of frequent keys tracks: it can't miss one that has more than 1 / (0.75 * TRACKED) of all lines.
TRACKED = 10_000
KEY, DOC = ["_a", "_b"], ["_id", "_t", "_u"]


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z in lower case; other letters stay as they are."""
    ends = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(ends) == F.char_length(ends)  # there `lower` changes A-Z alone, and is faster
    return F.when(ascii_only, F.lower(ends)).otherwise(F.translate(ends, string.ascii_uppercase, string.ascii_lowercase))


def identified(docs: DataFrame) -> DataFrame:
    """text (null as empty) with what identifies a document: doc_id and 96 bits of its text's hashes. Rows equal in both are
    told apart by nobody, have the same lines and lose the same lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_t"), F.shiftright(F.xxhash64(F.lit(1), text), 32).cast("int").alias("_u"), text.alias("_text"))


def hashed_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """A narrow row for each line whose key has at least min_chars code points: 128 bits of its key, document and position."""
    lines = identified(docs).select(*DOC, F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    keyed = lines.select(*DOC, "_pos", line_key(F.col("_line")).alias("_key")).where(F.char_length("_key") >= min_chars)
    return keyed.select(F.xxhash64("_key").alias("_a"), F.xxhash64(F.lit(1), "_key").alias("_b"), *DOC, "_pos")


def hot_keys(lines: DataFrame) -> DataFrame:
    """(_a) of keys with more lines than a quarter of a range's share: TRACKED at most, by a sketch over all lines."""
    found = lines.agg(F.expr(f"approx_top_k(_a, {TRACKED}, {TRACKED})").alias("top"), F.count("*").alias("_n"))
    return found.select("_n", F.inline("top")).where(F.col("count") * (4 * partitions(lines.sparkSession)) > F.col("_n")).select(F.col("item").alias("_a"))


def occurrences(lines: DataFrame) -> DataFrame:
    """Adds `_docs`, the number of documents (rows of the table) that have the line's key, and `_first`, whether this is the
    key's first line in order of document and position.

    Rows of one key stream through one range, but for hot keys: their documents are counted by pre-aggregated rows of
    (key, document, position), which no task holds for a whole key, and their results, TRACKED at most, are broadcast.
    """
    spark = lines.sparkSession
    hot = materialize(hot_keys(lines), "line-hot")
    few = F.broadcast(hot)
    dealt = lines.join(few, "_a", "left_anti").repartitionByRange(partitions(spark), *KEY)
    by_key = Window.partitionBy(*KEY)
    in_order, in_document = by_key.orderBy(*DOC, "_pos"), Window.partitionBy(*KEY, *DOC).orderBy("_pos")
    opens = (F.col("_pos") == F.first("_pos").over(in_document)).cast("int")  # once for each of equal documents
    streamed = dealt.withColumn("_opens", opens).withColumn("_docs", F.sum("_opens").over(by_key)).withColumn("_first", F.rank().over(in_order) == 1)
    cold = streamed.select(*KEY, *DOC, "_pos", "_docs", "_first")
    if not hot.limit(1).count():
        return cold
    mine = lines.join(few, "_a", "left_semi")
    places = mine.groupBy(*KEY, *DOC, "_pos").agg(F.count("*").alias("_times"))
    each = places.groupBy(*KEY, *DOC).agg(F.max("_times").alias("_times"), F.min("_pos").alias("_pos"))
    totals = each.groupBy(*KEY).agg(F.sum("_times").alias("_docs"), F.min(F.struct(*DOC, "_pos")).alias("_least"))
    least = F.struct(*DOC, "_pos").eqNullSafe(F.col("_least"))
    return cold.unionByName(mine.join(F.broadcast(totals), KEY).select(*KEY, *DOC, "_pos", "_docs", least.alias("_first")))


def keep_bitmaps(docs: DataFrame, at_least: int = 10, min_chars: int = 1, later_only: bool = False) -> DataFrame:
    """(_id, _t, _u, n_dropped, keep) of each document that loses lines: keys found in `at_least` documents lose all their
    lines, or, with later_only, all but their first. keep: an array with a 64-bit word for each 64 lines up to the last
    word that loses a line, lowest bit first; null stands for a word that keeps all."""
    marked = occurrences(materialize(hashed_lines(docs, min_chars), "line-hashes")).where(F.col("_docs") >= at_least)
    if later_only:
        marked = marked.where(~F.col("_first"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_pos") % 64)
    words = marked.groupBy(*DOC, F.shiftright("_pos", 6).alias("_word")).agg(F.bit_and(F.bitwise_not(bit)).alias("_keep"))
    found = words.groupBy(*DOC).agg(F.map_from_entries(F.collect_list(F.struct("_word", "_keep"))).alias("_of"), F.max("_word").alias("_last"), F.sum(64 - F.bit_count("_keep")).alias("n_dropped"))
    return found.select(*DOC, "n_dropped", F.transform(F.sequence(F.lit(0), F.col("_last")), lambda w: F.try_element_at(F.col("_of"), w)).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines whose bits are set, joined by newlines; a null bitmap keeps all."""
    word = lambda i: F.coalesce(F.try_element_at(keep, F.shiftright(i, 6) + 1), F.lit(-1).cast("long"))
    stays = lambda _, i: F.call_function("shiftright", word(i), i % 64).bitwiseAND(F.lit(1)) == 1
    return F.when(keep.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n", -1), stays), "\n"))


def dedup_lines(docs: DataFrame, at_least: int = 10, min_chars: int = 1, later_only: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of each row.

    Null and empty texts have one empty line, whose key is too short to be dropped (min_chars of 1 or more). Rows of the
    table are documents, so repeated rows count each, null doc_ids too. A key's first line (later_only) is that of the
    smallest doc_id, null first, then by the text's hash and position; equal rows all keep it. Very long texts are split
    within one row. An empty table gives no rows; other columns, whatever their names, are not read.
    """
    bitmaps = keep_bitmaps(docs, at_least, min_chars, later_only)
    mine = [c + "2" for c in DOC]
    whole = identified(docs).join(bitmaps.select(*[F.col(c).alias(m) for c, m in zip(DOC, mine)], "n_dropped", "keep"), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_t") == F.col("_t2")) & (F.col("_u") == F.col("_u2")), "left")
    n_lines = F.octet_length("_text") - F.octet_length(F.replace(F.col("_text"), F.lit("\n"), F.lit(""))) + 1
    return whole.select(F.col("_id").alias("doc_id"), n_lines.cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept_text(F.col("_text"), F.col("keep")).alias("kept"))


def op13_lines(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
with texts as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
lines as (select r, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from texts),
keyed as (
  select r, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines),
frequent as (select k from keyed where length(k) >= 1 group by k having count(distinct r) >= 10),
kept as (
  select r, count(*) as n_lines, count_if(f.k is not null) as n_dropped,
         coalesce(string_agg(case when f.k is null then line end, chr(10) order by pos), '') as kept
  from keyed left join frequent f on keyed.k = f.k group by r)
select doc_id, n_lines::bigint as n_lines, n_dropped::bigint as n_dropped, sha256(kept) as kept_sha256 from texts join kept using (r)
"""
