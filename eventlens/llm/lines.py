"""Line de-duplication: lines that many documents share stay in one document only.

Normalised lines are exploded and hashed, distinct documents are counted per hash, and what is over
the threshold is dropped; each text is put together again by line position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from eventlens.llm.common import ASCII_SPACE, ascii_lower, cut, free_name, text_digest

MIN_CHARS = 40
MIN_DOCS = 5


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def shared_lines(exploded: DataFrame, min_docs: int) -> DataFrame:
    """``key, keep``: keys of at least ``min_docs`` distinct documents and the largest id of those.

    Two map-side combined aggregations, the first by (key, document), so a line that stands in a
    third of all documents is counted in many tasks.
    """
    per_doc = exploded.groupBy("key", "id").agg(F.lit(1).alias("one"))
    counted = per_doc.groupBy("key").agg(
        F.count(F.lit(1)).alias("docs"), F.max("id").alias("keep")
    )
    return counted.where(F.col("docs") >= min_docs).select("key", "keep")


def dedupe_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    report: bool = False,
) -> DataFrame:
    """Drop lines whose key is at least ``min_chars`` long and stands in ``min_docs`` documents or
    more, except in the document with the largest id. All columns stay; the text is replaced by the
    kept lines joined by newlines. With ``report`` two columns follow: the number of lines before
    and of dropped lines.

    A null or empty text has one empty line and stays as it is. Rows with the same id are one
    document. A null id counts as one document and is smaller than any other. Equal rows are
    treated alike, each on its own. An empty table gives an empty table. Lines that are kept keep
    their place, so a text never changes but for dropped lines.
    """
    mark, dropped = free_name(docs.columns, "mark"), free_name(docs.columns, "dropped")
    marked = docs.withColumn(mark, text_digest(F.col(id_col), F.col(text_col)))
    exploded = (
        marked.select(
            F.col(mark).alias("mark"),
            F.col(id_col).alias("id"),
            F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"),
        )
        .withColumn("line", line_key(F.col("line")))
        .where(F.char_length("line") >= min_chars)
        .select("mark", "id", "pos", F.unhex(F.md5("line")).alias("key"))
    )
    # Written once, so that both sides of the join are plain exchanges and a hot key can be split.
    often = cut(shared_lines(exploded, min_docs))
    gone = (
        exploded.join(often, "key")
        .where(~F.col("id").eqNullSafe(F.col("keep")))
        .groupBy("mark")
        .agg(F.collect_set("pos").alias("positions"))
        .select(F.col("mark").alias(mark), F.array_sort("positions").alias(dropped))
    )
    joined = marked.join(gone, mark, "left")
    # Runs of kept lines between dropped positions: linear in the number of lines.
    bounds = F.concat(F.array(F.lit(-1)), F.col(dropped), F.array(F.size(lines_of(F.col(text_col)))))
    kept = F.transform(
        F.array(F.struct(lines_of(F.col(text_col)).alias("lines"), bounds.alias("bounds"))),
        lambda one: F.array_join(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(1), F.size(one["bounds"]) - 1),
                    lambda i: F.slice(
                        one["lines"],
                        F.element_at(one["bounds"], i) + 2,
                        F.element_at(one["bounds"], i + 1) - F.element_at(one["bounds"], i) - 1,
                    ),
                )
            ),
            "\n",
        ),
    )[0]
    text = F.when(F.col(dropped).isNull(), F.col(text_col)).otherwise(kept)
    columns = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if report:
        columns += [
            F.size(lines_of(F.col(text_col))).cast("long").alias(free_name(docs.columns, "n_lines")),
            F.coalesce(F.size(F.col(dropped)), F.lit(0)).cast("long").alias(free_name(docs.columns, "n_dropped")),
        ]
    return joined.select(*columns)
