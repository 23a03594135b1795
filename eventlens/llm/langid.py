"""Language identification by compression.

A text is encoded with one raw-content zstandard dictionary per language; the language whose
dictionary gives the smallest output wins, and a narrow margin is reported as not accepted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from eventlens.llm.common import cut, free_name

#: Bounds of the training sample: pieces per language, characters of a piece, bytes of a dictionary.
PIECES = 96
PIECE_CHARS = 1500
DICT_BYTES = 112_640
#: Languages whose dictionaries are held at once; more are taken in further passes.
GROUP = 200
LEVEL = 6
#: Share of the smallest size by which the next must be larger for a decision to be accepted.
MIN_MARGIN = 0.01
UNKNOWN = "und"

_NOT_WORDS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-cased words of letters, one space between them.

    What counts as a word character but is no letter by its category, such as a fraction, a Roman
    number or a number in a circle, parts words too.
    """
    words = _NOT_WORDS.sub(" ", text.lower()).strip()
    if words.isascii() or words.replace(" ", "").isalpha():
        return words
    return " ".join("".join(c if c.isalpha() else " " for c in words).split())


def dictionaries(
    labelled: DataFrame, text_col: str, lang_col: str, order: Column, pieces: int = PIECES, after: str | None = None
) -> dict[str, bytes]:
    """Raw content of the first ``GROUP`` languages ``after`` one, from a bounded sample, the same on
    every run.

    Of each language the ``pieces`` texts with the smallest hash are taken, of each a piece of at
    most ``PIECE_CHARS`` characters from its middle. The rank keeps the first rows of each
    partition before the shuffle, so a language with most of the rows is no hot task.
    """
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "size", "text"))
    size = F.char_length(text_col)
    start = F.greatest(F.lit(1), (size / 2).cast("int") - PIECE_CHARS // 2)
    usable = labelled.where(F.col(lang_col).isNotNull() & (size > 0))
    if after is not None:
        usable = usable.where(F.col(lang_col) > after)
    names = [r[0] for r in usable.select(lang_col).distinct().orderBy(lang_col).limit(GROUP).collect()]
    rows = (
        usable.where(F.col(lang_col).isin(names))
        .select(
            F.col(lang_col).alias("lang"),
            F.xxhash64(order).alias("h"),
            size.alias("size"),
            F.substring(F.col(text_col), start, F.lit(PIECE_CHARS)).alias("text"),
        )
        .withColumn("rank", rank)
        .where(F.col("rank") <= pieces)
        .select("lang", "rank", "text")
    )
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in rows.collect():
        parts.setdefault(r["lang"], []).append((r["rank"], r["text"]))
    return {
        lang: letters("\n".join(t for _, t in sorted(found, reverse=True))).encode()[-DICT_BYTES:]
        for lang, found in sorted(parts.items())
    }


class Classifier:
    """Sizes of texts under each language's dictionary."""

    def __init__(self, contents: dict[str, bytes]):
        self.encoders = []
        for lang, content in contents.items():
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(LEVEL)
            self.encoders.append((lang, zstandard.ZstdCompressor(
                LEVEL, dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False
            )))

    def sizes(self, text: str | None) -> list[tuple[int, str]]:
        """The two smallest sizes with their languages, ties in order of name; none without letters."""
        data = letters(text or "").encode("utf-8", "replace")
        return sorted((len(encoder.compress(data)), lang) for lang, encoder in self.encoders)[:2] if data else []


def identify(
    docs: DataFrame, labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", order: Column | None = None
) -> tuple[DataFrame, str]:
    """``docs`` with a struct of ``lang``, ``score`` and ``accepted``, and the column's name.

    ``labelled`` has the texts and languages to learn from, any number of languages: beyond ``GROUP``
    there is one pass for each group, and the two smallest sizes are carried along. The score is the
    margin of the smallest size to the next one as a share of that, doubled and cut at 1. Ties go to
    the first language in order of name and are not accepted.

    Null, empty and letterless texts get ``und`` with score 0; so does every text if nothing was
    learned. Rows are judged one by one by their text alone, which is taken whole whatever its
    length, so repeated rows agree; an empty table gives an empty table, and other columns stay.
    """
    context = docs.sparkSession.sparkContext
    key = F.col(text_col) if order is None else order
    name = free_name(docs.columns, "language")
    kind = "struct<lang:string,best:int,second:int>"
    out = docs.withColumn(name, F.lit(None).cast(kind))
    at, after = docs.columns.index(text_col), None
    while contents := dictionaries(labelled, text_col, lang_col, key, after=after):
        shared, before = context.broadcast(contents), after
        after = max(contents)

        def batches(it: Iterator[pa.RecordBatch], shared=shared, carried=before is not None) -> Iterator[pa.RecordBatch]:
            classify = Classifier({lang: x for lang, x in shared.value.items() if x})
            for batch in it:
                rows = []
                for text, held in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                    known = held.as_py() if carried else None
                    found = classify.sizes(text.as_py())
                    if known:  # sorting is stable: earlier languages first
                        found = sorted(
                            [(known["best"], known["lang"]), *([(known["second"], "")] if known["second"] is not None else []), *found],
                            key=lambda x: x[0],
                        )
                    rows.append({"lang": found[0][1], "best": found[0][0], "second": found[1][0] if len(found) > 1 else None} if found else None)
                column = pa.array(rows, batch.schema.field(batch.num_columns - 1).type)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], schema=batch.schema)

        out = out.mapInArrow(batches, out.schema)
        if len(contents) < GROUP:
            break
        out = cut(out)
    size = F.col(name)
    margin = F.coalesce((size["second"] - size["best"]) / size["second"], F.lit(1.0))
    judged = F.when(
        size.isNotNull(),
        F.struct(size["lang"].alias("lang"), F.least(F.lit(1.0), 2 * margin).alias("score"), (margin >= MIN_MARGIN).alias("accepted")),
    ).otherwise(F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted")))
    return out.withColumn(name, judged), name
