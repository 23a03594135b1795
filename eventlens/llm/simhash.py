"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared in tiles by numpy exclusive-or and bit counts. Which tiles meet is decided
in two steps, both without loss inside the radius for ``block_tables``:

* fingerprints that agree on the bits of a table are laid in one tile (with b blocks and radius r
  two fingerprints within the radius agree on b - r whole blocks, so the tables of all such choices
  cover every pair);
* inside, rows are ordered by population count, and parts whose counts differ by more than the
  radius are skipped, since every differing bit changes the count by one.

Tiles with more rows than ``TILE`` are cut by population count and hash, and only pairs of cuts
whose counts can be within the radius meet, each pair in a task of its own. Of the pairs within the
radius a tile gives a spanning forest, close pairs first: at most one pair per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from eventlens.llm.common import cut, free_name, text_digest
from eventlens.llm.components import components

#: Rows of a tile; a task holds two tiles at most.
TILE = 16384
#: Tiles of up to so many rows are compared together, row against shifted row.
SMALL = 48
#: Rows of a block of the comparison inside a tile: bounds its memory.
BLOCK = 128
#: Shingles that are counted at once: bounds the memory of a very long text.
CHUNK = 1 << 14
SEED = 42
#: Odd multipliers of a 64-bit mixing step, for words after the first.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingle_hashes(text: bytes | None, width: int, distinct: bool) -> np.ndarray:
    """XXH64 of the word shingles of a text; A-Z lower-cased, words split at ASCII white space."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n
    )
    return np.unique(hashes) if distinct else hashes


def _word(hashes: np.ndarray, i: int) -> np.ndarray:
    if i == 0:
        return hashes
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * i) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """Bits that more than half of the hashes have, as big-endian 64-bit words; zero without any."""
    out = b""
    for i in range(words):
        ones = np.zeros(64, np.int64)
        for k in range(0, len(hashes), CHUNK):
            part = _word(hashes[k : k + CHUNK], i).astype(">u8")
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
            for j in range(0, len(bits), 255):  # sums of 255 rows fit a byte
                ones += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
        out += np.packbits((2 * ones > len(hashes)).astype(np.uint8)).tobytes()
    return out


def fingerprints(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    width: int,
    words: int = 1,
    distinct: bool = False,
) -> DataFrame:
    """``id, digest, fp`` per row: a digest of id and text, and ``8 * words`` bytes of fingerprint.

    A null text has no shingles: zero bits.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, digest binary, fp binary"

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = [fingerprint(shingle_hashes(t.as_py(), width, distinct), words) for t in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(fps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "fp"])

    return docs.select(
        F.col(id_col).alias("id"),
        text_digest(F.col(id_col), F.col(text_col)).alias("digest"),
        F.col(text_col).cast("binary").alias("text"),
    ).mapInArrow(batches, schema)


def block_tables(bits: int, radius: int, blocks: int) -> list[np.ndarray]:
    """Bit positions of tables that cover every pair within the radius: all but ``radius`` blocks."""
    parts = np.array_split(np.arange(bits), blocks)
    return [np.concatenate(c) for c in combinations(parts, blocks - radius)]


def _matrix(fps: pa.Array, words: int) -> np.ndarray:
    data = b"".join(fps.to_pylist())
    return np.frombuffer(data, ">u8").reshape(-1, words).astype(np.uint64)


def _keyed(fps: DataFrame, tables: list[np.ndarray], words: int) -> DataFrame:
    """``bucket, pop, fp``: one row per table; the bucket holds table number and the table's bits."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fp = batch.column(0)
            bits = np.unpackbits(np.frombuffer(b"".join(fp.to_pylist()), np.uint8).reshape(len(fp), -1), axis=1)
            pop = pa.array(bits.sum(axis=1, dtype=np.int32))
            for t, chosen in enumerate(tables):
                key = bits[:, chosen].astype(np.int64) @ (1 << np.arange(len(chosen), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key * len(tables) + t), pop, fp], ["bucket", "pop", "fp"])

    return fps.select("fp").mapInArrow(batches, "bucket long, pop int, fp binary")


class Forest:
    """Pairs of rows that connect what all pairs given so far connect, one per row at most."""

    def __init__(self, rows: int):
        self.label = np.arange(rows)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Rows a[i] and b[i] are tied; earlier pairs are preferred."""
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            a, b, high, low = a[apart], b[apart], np.maximum(x, y)[apart], np.minimum(x, y)[apart]
            if not len(a):
                break
            roots, first = np.unique(high, return_index=True)
            self.pairs.append((a[first], b[first]))
            label[roots] = low[first]
            while (flat := label[label]).tobytes() != label.tobytes():
                label = flat
        self.label = label

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.pairs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = zip(*self.pairs)
        return np.concatenate(a), np.concatenate(b)


def steps_of(radius: int) -> list[int]:
    """Growing radii up to ``radius``, so that close pairs come first."""
    return sorted({max(1, radius // 4), radius // 2, 3 * radius // 4, radius}) if radius >= 8 else [radius]


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits; words come last."""
    out = np.bitwise_count(x[..., 0] ^ y[..., 0]).astype(np.uint16)
    for w in range(1, x.shape[-1]):
        out += np.bitwise_count(x[..., w] ^ y[..., w])
    return out


def link_tile(rows: np.ndarray, other: np.ndarray | None, radius: int) -> Forest:
    """Links of the rows of a tile, or between two tiles, numbered one after the other."""
    forest = Forest(len(rows) + (0 if other is None else len(other)))
    pop = np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
    order = np.argsort(pop, kind="stable")
    right, shift = (rows, 0) if other is None else (other, len(rows))
    right_pop = pop if other is None else np.bitwise_count(other).sum(axis=1, dtype=np.int64)
    right_order = np.argsort(right_pop, kind="stable")
    right_sorted = right_pop[right_order]
    for step in steps_of(radius):
        for i in range(0, len(rows), BLOCK):
            mine = order[i : i + BLOCK]
            # Counts differ by more than the step outside of this range.
            low = i if other is None else np.searchsorted(right_sorted, pop[mine[0]] - step, "left")
            high = np.searchsorted(right_sorted, pop[mine[-1]] + step, "right")
            for j in range(low, high, TILE):
                theirs = right_order[j : min(j + TILE, high)]
                near = _distance(rows[mine][:, None, :], right[theirs][None, :, :]) <= step
                a, b = np.nonzero(near)
                forest.add(mine[a], theirs[b] + shift)
    return forest


def _link_small(rows: np.ndarray, group: np.ndarray, sizes: np.ndarray, radius: int) -> Forest:
    """Links of many small tiles at once; ``group`` is sorted."""
    forest, found = Forest(len(rows)), []
    for shift in range(1, int(sizes.max(initial=1))):
        same = np.flatnonzero(group[shift:] == group[:-shift])
        apart = _distance(rows[same], rows[same + shift])
        near = apart <= radius
        found.append((apart[near], same[near], same[near] + shift))
    if found:
        apart, a, b = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(apart, kind="stable")
        apart, a, b = apart[order], a[order], b[order]
        for step in steps_of(radius):
            forest.add(a[apart <= step], b[apart <= step])
    return forest


def _edges(fp: np.ndarray, forest: Forest) -> pa.RecordBatch:
    a, b = forest.edges()
    pick = lambda at: pa.array([fp[i] for i in at], pa.binary())
    return pa.RecordBatch.from_arrays([pick(a), pick(b)], ["a", "b"])


def _linker(words: int, radius: int):
    def tiles(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole tiles, ordered by bucket and part."""
        if not table.num_rows:
            return
        table = table.combine_chunks()
        fp = np.array(table["fp"].to_pylist(), object)
        rows = _matrix(table["fp"].chunk(0), words)
        bucket, part = table["bucket"].to_numpy(), np.array(table["part"].to_pylist(), object)
        first = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])))
        start = np.flatnonzero(first)
        sizes = np.diff(np.append(start, len(rows)))
        group = np.cumsum(first)
        small = (sizes <= SMALL) & (part[start] == "")
        at = np.flatnonzero(np.repeat(small, sizes))
        if len(at):
            yield _edges(fp[at], _link_small(rows[at], group[at], sizes[small], radius))
        side = table["side"].to_numpy()
        for k in np.flatnonzero(~small):
            own = slice(start[k], start[k] + sizes[k])
            left = np.flatnonzero(side[own] == 0) + start[k]
            right = np.flatnonzero(side[own] == 1) + start[k]
            if len(right):
                if len(left):
                    at = np.concatenate((left, right))
                    yield _edges(fp[at], link_tile(rows[left], rows[right], radius))
            elif part[start[k]] == "" or part[start[k]].startswith("="):
                yield _edges(fp[own], link_tile(rows[own], None, radius))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in it:
            if not batch.num_rows:
                continue
            last = (batch.column(0)[-1].as_py(), batch.column(1)[-1].as_py())
            bucket, part = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            n = batch.num_rows
            while n and (bucket[n - 1], part[n - 1]) == last:
                n -= 1
            if n or (held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != last):
                yield from tiles(pa.Table.from_batches([*held, batch.slice(0, n)]))
                held = []
            held.append(batch.slice(n))
        if held:
            yield from tiles(pa.Table.from_batches(held))

    return batches


def links(fps: DataFrame, radius: int, tables: list[np.ndarray], words: int = 1, tile: int = TILE) -> DataFrame:
    """``a, b``: pairs within the radius that connect what all such pairs connect; ``fps`` has
    distinct ``fp`` rows."""
    keyed = _keyed(fps, tables, words)
    band = F.floor(F.col("pop") / (radius + 1)).cast("int")
    cells = keyed.groupBy("bucket", band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    hot = cut(
        cells.groupBy("bucket")
        .agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("band", "n"))).alias("cells"))
        .where(F.col("n") > tile)
        .select("bucket", "cells")
    )
    # A tile of a cell for each ``tile`` rows; a row goes to its own tile and to those that its
    # tile meets: of the same band and of the next ones up and down.
    splits = f"cast(ceil(c.n / {tile}) as int)"
    mine = F.expr(
        "element_at(filter(cells, c -> c.band = own), 1)"
    )
    spread = (
        keyed.join(F.broadcast(hot) if hot.count() <= 10_000 else hot, "bucket", "left")
        .withColumn("own", band)
        .withColumn(
            "split",
            F.when(F.col("cells").isNotNull(), F.pmod(F.xxhash64("fp"), F.ceil(mine["n"] / tile)).cast("int")),
        )
        .withColumn(
            "meet",
            F.expr(
                "if(cells is null, array(named_struct('part', '', 'side', 0)),"
                " flatten(transform(filter(cells, c -> abs(c.band - own) <= 1), c ->"
                f" transform(sequence(0, {splits} - 1), s ->"
                " if(c.band = own and s = split,"
                " named_struct('part', concat('=', own, '.', split), 'side', 0),"
                " if(c.band < own or (c.band = own and s < split),"
                " named_struct('part', concat(c.band, '.', s, '-', own, '.', split), 'side', 1),"
                " named_struct('part', concat(own, '.', split, '-', c.band, '.', s), 'side', 0)))))))"
            ),
        )
        .select("bucket", F.explode("meet").alias("m"), "fp")
        .select("bucket", F.col("m.part").alias("part"), F.col("m.side").alias("side"), "fp")
    )
    return (
        spread.repartition("bucket", "part")
        .sortWithinPartitions("bucket", "part")
        .mapInArrow(_linker(words, radius), "a binary, b binary")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    radius: int = 3,
    words: int = 1,
    distinct: bool = False,
    tables: list[np.ndarray] | None = None,
    tile: int = TILE,
) -> DataFrame:
    """``id, digest, fp, grp, component`` per row: the component is the smallest id that links
    reach, the row's own included, and ``grp`` a fingerprint that names the group.

    Null and empty texts have fingerprint zero and link like any other. Equal rows and copies share
    a fingerprint, which is compared once. A row with a null id belongs to a group; its id never
    names one, so a group of nulls alone has a null component. An empty table gives an empty table.
    """
    tables = tables or block_tables(64 * words, radius, radius + 2)
    marked = cut(fingerprints(docs, id_col, text_col, width, words, distinct))
    classes = cut(marked.groupBy("fp").agg(F.min("id").alias("least"), F.min("digest").alias("digest")))
    pairs = links(classes.select("fp"), radius, tables, words, tile)
    groups = components(pairs)
    linked = classes.join(groups.select(F.col("id").alias("fp"), F.col("component").alias("grp")), "fp")
    smallest = linked.groupBy("grp").agg(F.min("least").alias("smallest"))
    named = linked.join(smallest, "grp").select("fp", "grp", "smallest")
    # Written once, so that both sides of the last join are plain exchanges and a fingerprint that
    # very many rows share can be split.
    least = cut(
        classes.join(named, "fp", "left").select(
            "fp",
            F.coalesce("grp", "fp").alias("grp"),
            F.coalesce("smallest", "least").alias("component"),
        )
    )
    return marked.join(least, "fp").select("id", "digest", "fp", "grp", "component")


def keep_one(
    docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each group of ``near_duplicates(docs)``: that with the smallest id.

    Null ids come last; of rows that share the id that with the smallest digest stays, and of rows
    that are equal in id and text any one.
    """
    groups = cut(groups.select("id", "digest", "grp"))
    order = F.struct(F.col("id").isNull().alias("missing"), "id", "digest")
    chosen = groups.groupBy("grp").agg(F.min(order).alias("first")).select("first.digest")
    repeated = groups.groupBy("digest").count().where("count > 1").select("digest", F.lit(True).alias("again"))
    mark = free_name(docs.columns, "mark")
    chosen = cut(chosen.join(repeated, "digest", "left").withColumnRenamed("digest", mark))
    marked = docs.withColumn(mark, text_digest(F.col(id_col), F.col(text_col)))
    once = marked.join(chosen.where(F.col("again").isNull()), mark, "left_semi")
    several = marked.join(chosen.where(F.col("again")), mark, "left_semi").dropDuplicates([mark])
    return once.unionByName(several).drop(mark)
