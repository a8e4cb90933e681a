"""Lines that many documents share: all but the first document's are dropped.

Lines are exploded with their positions, and only a digest of what a line
says travels, not the line. A line's documents are counted by digest and salt
first and then by digest, so that a line that stands in a third of all
documents is dealt to many tasks, on the way there and on the way back. The
positions to drop meet the texts again by document, and what lies between them
is joined.

Only DataFrame functions are used.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import text_digest, written

BLANK = " \t\n\x0b\x0c\r"
#: What one digest's documents are dealt to.
SALTS = 64


def line_key(line: Column) -> Column:
    """What a line says: A-Z in lower case, without white space at both ends."""
    return F.translate(F.btrim(line, F.lit(BLANK)), ascii_uppercase, ascii_lowercase)


def shared_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """(digest, salt, first_doc) of digests that stand in ``least_docs`` documents or more, for each salt that they have.

    ``lines`` are (doc_id, digest, salt); a null id is a document too, the last in order.
    """
    once = lines.select("digest", "salt", "doc_id").distinct()
    parts = once.groupBy("digest", "salt").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))
    whole = parts.groupBy("digest").agg(F.sum("docs").alias("docs"), F.min("first_doc").alias("first_doc"))
    return parts.select("digest", "salt").join(whole.where(F.col("docs") >= least_docs).drop("docs"), "digest")


def dropped_positions(texts: DataFrame, least_docs: int, least_chars: int) -> DataFrame:
    """(doc_id, text_digest, dropped): positions from 0, ascending, of a text's lines that go; texts that lose none are not listed."""
    place = F.posexplode(F.split("text", "\n")).alias("at", "line")
    keys = texts.select("doc_id", "text_digest", place).select("doc_id", "text_digest", "at", line_key(F.col("line")).alias("key"))
    lines = keys.where(F.length("key") >= least_chars).select(
        "doc_id", "text_digest", "at", text_digest(F.col("key")).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
    )
    lines = written(lines)  # splitting all texts costs more than three scans of their lines' digests
    found = lines.join(shared_lines(lines, least_docs), ["digest", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    # Not more of them come together than the lines of one text.
    return found.groupBy("doc_id", "text_digest").agg(F.array_sort(F.collect_set("at")).alias("dropped"))


def without(lines: Column, dropped: Column) -> Column:
    """The lines but for those at the positions ``dropped``, in time proportional to both."""
    first, last = F.array_prepend(dropped, F.lit(-1)), F.array_append(dropped, F.size(lines))
    between = lambda own: F.flatten(F.zip_with(first, last, lambda a, b: F.slice(own, a + 2, b - a - 1)))
    return F.transform(F.array(lines), between)[0]  # bound to a name, the lines are split once and not for each gap


def dedup_lines(
    docs: DataFrame, least_docs: int = 2, least_chars: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(row, doc_id, text, n_lines, n_dropped): each row of ``docs`` as a struct, with what is left of its text.

    Lines of a text end at line feeds. Lines whose key has ``least_chars`` code
    points at least, and that ``least_docs`` documents or more hold, go
    everywhere but in the document of the smallest id that holds them, which
    keeps all of them.

    A null or empty text is one empty line, and so is a text that loses all
    lines. A null id is one document, the last in order. Repeated rows, and
    rows that share an id, are one document with several texts, each of which
    stays a row. Columns of any name stay in ``row``; an empty table gives an
    empty result.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    texts = docs.select(row, F.col(id_col).cast("long").alias("doc_id"), text).withColumn("text_digest", text_digest(F.col("text")))
    gone = dropped_positions(texts.drop("row"), least_docs, least_chars).select(
        F.col("doc_id").alias("gone_id"), F.col("text_digest").alias("gone_digest"), "dropped"
    )
    own = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_digest") == F.col("gone_digest"))
    joined = texts.join(gone, own, "left")
    lines = F.split("text", "\n")
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(without(lines, F.col("dropped")), "\n"))
    return joined.select(
        "row",
        "doc_id",
        kept.alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def line_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row; edge cases as in :func:`dedup_lines`."""
    kept = F.sha2(F.col("text").cast("binary"), 256)
    return dedup_lines(docs, **options).select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))
