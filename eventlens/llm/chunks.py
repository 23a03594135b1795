"""Substring de-duplication by content-defined chunks.

A gear hash rolls over the bytes of a text and cuts where it has a certain pattern, so cuts depend
on the last ``WINDOW`` bytes alone and the same passage gives the same chunks wherever it stands,
whatever was inserted before it. From every chunk on, as many chunks as a passage needs form a
passage, which is compared by one digest: what is removed stands elsewhere as a whole, and not in
pieces here and there. Every passage stays where it stands first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from eventlens.llm.common import clean_shuffles, cut, free_name, text_digest

#: Bytes that a cut depends on; one cut in 2**MASK_BITS bytes on average.
WINDOW = 16
MASK_BITS = 4
#: Chunks are at least so many bytes (a nearer cut is passed over) and never more than MAX.
MIN_CHUNK, MAX_CHUNK = 8, 512
#: A passage is the shortest run of whole chunks with this many bytes.
MIN_PASSAGE = 160
#: Bytes that are hashed at once: bounds the memory of a very long text.
BLOCK = 1 << 20

_GEAR = np.random.default_rng(20260101).integers(0, 1 << 32, 256, dtype=np.uint32)


def candidates(data: np.ndarray) -> np.ndarray:
    """Places after which the gear hash of the last ``WINDOW`` bytes asks for a cut."""
    out = []
    for k in range(0, len(data), BLOCK):
        start = max(0, k - WINDOW + 1)
        part = data[start : k + BLOCK]
        h, span = _GEAR[part], 1
        while span < WINDOW:  # hash of 2n bytes from two hashes of n bytes
            older = np.zeros_like(h)
            older[span:] = h[:-span] if span < len(h) else 0
            h = h + (older << np.uint32(span))
            span *= 2
        low = WINDOW - MASK_BITS
        hits = np.flatnonzero((h >> np.uint32(low)) & np.uint32((1 << MASK_BITS) - 1) == 0)
        out.append(hits[hits >= k - start] + start + 1)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a text."""
    ends, last = [], 0
    for at in [*candidates(np.frombuffer(data, np.uint8)).tolist(), len(data)]:
        while at - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if at - last >= MIN_CHUNK or (at == len(data) and at > last):
            ends.append(at)
            last = at
    return ends


def passages(ends: list[int], min_bytes: int) -> list[tuple[int, int]]:
    """Byte ranges of the passages of a text: from each chunk on, as long as there is enough text."""
    stop = np.array(ends, np.int64)
    start = np.concatenate(([0], stop[:-1])) if len(stop) else stop
    last = np.searchsorted(stop, start + min_bytes)
    n = int((last < len(stop)).sum())
    return list(zip(start[:n].tolist(), stop[last[:n]].tolist()))


def digests(data: bytes, min_bytes: int) -> np.ndarray:
    """Signed 64-bit digests of the passages of a text."""
    places = passages(cuts(data), min_bytes)
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(data[a:b]) for a, b in places), np.uint64, len(places)).view(np.int64)


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, overlapping and touching ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _passages(marked: DataFrame, mark: str, id_col: str, text_col: str, min_bytes: int) -> DataFrame:
    """``mark, id, pos, digest`` of every passage."""
    id_type = marked.schema[id_col].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            own = [digests(text.as_py() or b"", min_bytes) for text in batch.column(2)]
            sizes = [len(x) for x in own]
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            pos = np.concatenate([np.arange(n) for n in sizes] or [[]])
            columns = [
                batch.column(0).take(at), batch.column(1).take(at),
                pa.array(pos, pa.int32()), pa.array(np.concatenate(own) if own else [], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["mark", "id", "pos", "digest"])

    source = marked.select(
        F.col(mark).alias("mark"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")
    )
    return source.mapInArrow(batches, f"mark long, id {id_type}, pos int, digest long")


def dedupe_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_bytes: int = MIN_PASSAGE,
    report: bool = False,
) -> DataFrame:
    """Cut passages out of the texts that stand elsewhere before: in a document with a smaller id,
    or earlier in the same text. All columns stay; ``report`` adds ``n_chunks``, ``n_repeated``
    (passages that stand elsewhere too, first places included), ``n_removed`` (bytes) and ``shared``
    (true if a passage is repeated, first places included).

    A passage is the shortest run of chunks of at least ``min_bytes`` bytes; passages overlap, and
    every byte that goes lies in one that stands elsewhere as a whole. Null and empty texts have no
    passage and stay; a text of any length is taken whole. A null id comes after every other. Rows that share an id
    are ordered by a digest of their text; rows equal in both are one text and are treated alike.
    A text that is a copy of another one loses its passages: at most what lies beside them is left.
    An empty table gives an empty table. Cuts never part a character: a range is narrowed to whole
    characters.
    """
    mark, found = free_name(docs.columns, "mark"), free_name(docs.columns, "chunks")
    whole = text_digest(F.col(id_col), F.col(text_col))
    marked = docs.withColumn(mark, F.xxhash64(whole))
    pieces = _passages(marked, mark, id_col, text_col, min_bytes)
    place = F.struct(F.col("id").isNull().alias("missing"), "id", "mark", "pos")
    # Minimum and maximum place say whether a passage stands twice; both are combined in the map tasks.
    with clean_shuffles(docs.sparkSession):
        twice = cut(
            pieces.groupBy("digest")
            .agg(F.min(place).alias("first"), F.max(place).alias("last"))
            .where(F.col("first") != F.col("last"))
            .select("digest", "first.mark", "first.pos")
            .toDF("digest", "first_mark", "first_pos")
        )
    hits = (
        pieces.select("mark", "pos", "digest")
        .join(twice, "digest")
        .groupBy("mark")
        .agg(
            F.collect_set(
                F.struct("pos", ((F.col("mark") != F.col("first_mark")) | (F.col("pos") != F.col("first_pos"))).alias("later"))
            ).alias(found)
        )
        .withColumnRenamed("mark", mark)
    )
    joined = marked.join(hits, mark, "left")
    names = {n: free_name(docs.columns, n) for n in ("n_chunks", "n_repeated", "n_removed", "shared")}
    columns = [*docs.columns, *names.values()]
    out = joined.select(
        *docs.columns,
        *[F.lit(None).cast("boolean" if n == "shared" else "long").alias(a) for n, a in names.items()],
        F.col(found),
    )
    at = docs.columns.index(text_col)
    schema = out.drop(found).schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts, counts = [], []
            for text, hit in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                value, own = text.as_py(), hit.as_py() or []
                data = (value or "").encode()
                ends = cuts(data)
                places = passages(ends, min_bytes) if own else []
                # Equal rows share their passages, of which only one is the first.
                later = {h["pos"] for h in own if h["later"]}
                gone = united([places[k] for k in sorted(later)])
                texts.append(_without(data, gone) if gone else value)
                counts.append((len(ends), len({h["pos"] for h in own}), sum(b - a for a, b in gone), bool(own)))
            n_chunks, n_repeated, n_removed, shared = zip(*counts) if counts else ((),) * 4
            arrays = list(batch.columns[: len(docs_columns)])
            arrays[at] = pa.array(texts, batch.column(at).type)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            arrays += [pa.array(v, k) for v, k in zip((n_chunks, n_repeated, n_removed, shared), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, list(columns))

    docs_columns = docs.columns
    done = out.mapInArrow(batches, schema)
    return done if report else done.select(*docs.columns)


def _without(data: bytes, gone: list[tuple[int, int]]) -> str:
    """The text without these byte ranges, each narrowed to whole characters."""
    kept, last = [], 0
    for a, b in gone:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(data[last:a])
        last = b
    return b"".join([*kept, data[last:]]).decode()
