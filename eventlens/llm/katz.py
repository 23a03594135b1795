"""A Katz backoff model of word pairs, and the log probability of every text under it.

Probabilities follow one recursion per token: a pair seen in training has its Good-Turing discounted
relative frequency; any other pair has the backoff weight of its context times the probability of
the word alone; a word not seen has the mass that discounting leaves, as one unknown word. The
weights are computed from what the pairs of a context leave, so all probabilities after a context
sum to one.

Words are 64-bit digests (pairs two of them). Tasks read texts in chunks and pack the pairs of a
chunk by context bucket: distinct pairs, and for each the documents where it stands. One task per
bucket then has all pairs of its contexts, counts those of training documents, and answers with one
sum per document. Contexts with much of the corpus are dealt over all buckets by their pairs; their
sums are gathered beforehand. Counts of frequent words are broadcast, those of the others come to
the buckets that hold them as a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventlens.llm.common import clean_shuffles, cut

#: Counts up to this one are discounted.
DISCOUNTED = 5
#: A chunk ends at so many tokens or documents; a document is never split.
CHUNK_TOKENS, CHUNK_DOCS = 2_000_000, 16_000
#: Bytes of text per context bucket.
BUCKET_BYTES = 12_000_000
#: A word is frequent with one of so many training tokens, so at most so many words are broadcast.
FREQUENT = 4_000_000
#: A context with more than this share of a bucket's tokens is dealt over all buckets; there are at
#: most ``buckets / HOT`` of them.
HOT = 0.25

#: Digests of words held by a task at a time.
_HELD_WORDS = 400_000
_SALT = np.uint64(0x9E3779B97F4A7C15)


class _Digests(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _HELD_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


#: No word holds a space.
END, START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" end", b" start"))


def tokens(text: str | None, digests: _Digests) -> np.ndarray:
    """Digests of the words in lower-case A-Z, split at ASCII white space, and of the end."""
    words = (text or "").encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(digests.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


@dataclass
class Chunk:
    """Tokens of some documents one after the other."""

    name: str
    ids: pa.Array
    learn: np.ndarray
    lengths: np.ndarray
    words: np.ndarray

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    @property
    def contexts(self) -> np.ndarray:
        before = np.empty_like(self.words)
        before[1:] = self.words[:-1]
        before[np.concatenate(([0], np.cumsum(self.lengths)[:-1]))] = START
        return before


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Chunks of batches ``id, text, learn``."""
    digests, held, ids, learn, n, size = _Digests(), [], [], [], 0, 0
    part = TaskContext.get().partitionId() if TaskContext.get() else 0

    def made() -> Chunk:
        return Chunk(f"{part}-{n}", pa.concat_arrays(ids), np.array(learn, bool), np.array([len(t) for t in held]), np.concatenate(held))

    for batch in batches:
        for k, (text, take) in enumerate(zip(batch.column(1), batch.column(2))):
            held.append(tokens(text.as_py(), digests))
            ids.append(batch.column(0).slice(k, 1))
            learn.append(take.as_py())
            size += len(held[-1])
            if size >= CHUNK_TOKENS or len(held) == CHUNK_DOCS:
                yield made()
                held, ids, learn, n, size = [], [], [], n + 1, 0
    if held:
        yield made()


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _buckets(context: np.ndarray, word: np.ndarray, buckets: int, hot: np.ndarray) -> np.ndarray:
    mixed = context
    if len(hot):
        mixed = np.where(_listed(context, hot), (context ^ (word * _SALT)) * _SALT, context)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def _find(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted keys, and whether the value is there."""
    if not len(keys):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return at, keys[at] == values


def _listed(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return _find(values, keys)[1]


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing factors of counts 0 to ``DISCOUNTED``, from the number of kinds with count 1, 2, ...

    The largest range of counts is taken for which every factor is above 0 and below 1; without any,
    half an occurrence is taken off each count up to ``DISCOUNTED``.
    """
    for k in range(min(DISCOUNTED, len(n) - 1), 0, -1):
        if min(n[: k + 1]) <= 0:
            continue
        rest = (k + 1) * n[k] / n[0]
        d = [((r + 1) * n[r] / (r * n[r - 1]) - rest) / (1 - rest) if rest != 1 else 0.0 for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return np.array([1.0, *d, *[1.0] * (DISCOUNTED - k)])
    return np.array([1.0, *[1 - 0.5 / r for r in range(1, DISCOUNTED + 1)]])


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= DISCOUNTED, d[np.minimum(counts, DISCOUNTED)], 1.0)


@dataclass
class Words:
    """What every task knows of single words."""

    total: int
    kinds: int
    factors: np.ndarray
    left: float  # what discounting leaves to words not seen
    over: int  # added to the denominator where nothing is left otherwise
    frequent: np.ndarray
    counts: np.ndarray

    def count(self, words: np.ndarray, rare: np.ndarray, rare_counts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for keys, counts in ((self.frequent, self.counts), (rare, rare_counts)):
            at, there = _find(words, keys)
            out[there] = counts[at[there]]
        return out

    def probability(self, counts: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(counts))
        return np.where(counts > 0, discounted(counts, self.factors) / (self.total + self.over), self.left)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.kinds + 1)))


def _read(docs: DataFrame, make, schema: str) -> DataFrame:
    """``make`` on each chunk of the frame ``id, text, learn``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            yield from make(chunk)

    return docs.mapInArrow(run, schema)


def count_words(docs: DataFrame) -> DataFrame:
    """``w, c`` of the learning documents, checkpointed."""

    def count(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        w, n = np.unique(chunk.words, return_counts=True)
        yield pa.RecordBatch.from_arrays([_signed(w), pa.array(n)], ["w", "n"])

    counted = _read(docs.where("learn"), count, "w bigint, n bigint")
    return cut(counted.groupBy("w").agg(F.sum("n").alias("c")))


def word_model(counted: DataFrame) -> Words:
    ranks = [F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, DISCOUNTED + 2)]
    row = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("kinds"), *ranks).first()
    d = discounts(list(row[2:]))
    gone = sum((1 - d[r]) * r * row[f"n{r}"] for r in range(1, DISCOUNTED + 1))
    over = 0 if gone > 0 else 1
    left = (gone or 1) / (row.total + over) if row.total else 1.0
    least = max(1, -(-row.total // FREQUENT))
    frequent = counted.where(F.col("c") >= least).toArrow()
    keys = frequent.column("w").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return Words(row.total, row.kinds, d, float(left), over, keys[order], frequent.column("c").to_numpy()[order])


def rare_words(docs: DataFrame, counted: DataFrame, model, buckets: int, hot: np.ndarray) -> DataFrame:
    """``b, w, c``: the words that are not broadcast, once for each bucket where they stand."""

    def place(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        rare = ~_listed(chunk.words, model.value.frequent)
        w = chunk.words[rare]
        b = _buckets(chunk.contexts[rare], w, buckets, hot)
        order = np.lexsort((b, w))
        w, b = w[order], b[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (b[1:] != b[:-1])
        yield pa.RecordBatch.from_arrays([_signed(w[new]), pa.array(b[new])], ["w", "b"])

    placed = _read(docs, place, "w bigint, b int").repartition("w").dropDuplicates(["w", "b"])
    return cut(placed.join(counted, "w").select("b", "w", "c"))


_PAIRS = "b int, chunk string, hs array<bigint>, hn array<int>, ws array<bigint>, wn array<int>, docs array<smallint>"


def _lists(values: np.ndarray, ends: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values, kind))


def pairs(docs: DataFrame, buckets: int, hot: np.ndarray, postings: bool) -> DataFrame:
    """The distinct pairs of each chunk and bucket: contexts ``hs`` with their numbers of words ``hn``,
    words ``ws`` with their numbers of places ``wn``, and with ``postings`` the document of each
    place (twice its number in the chunk, and one more if it is learnt from). The first row of a
    chunk then lists its documents."""
    known = docs.schema["id"].dataType.simpleString()
    schema = _PAIRS + f", ids array<{known}>, learn array<boolean>, sizes array<int>"

    def pack(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        h, w = chunk.contexts, chunk.words
        order = np.argsort(w, kind="stable")
        order = order[np.argsort(h[order], kind="stable")]
        b = _buckets(h[order], w[order], buckets, hot)
        by = np.argsort(b.astype(np.uint16) if buckets < 2**16 else b, kind="stable")
        order, b = order[by], b[by]
        h, w = h[order], w[order]
        here = np.ones(len(w) + 1, bool)
        here[1:-1] = b[1:] != b[:-1]
        context = here.copy()
        context[1:-1] |= h[1:] != h[:-1]
        pair = context.copy()
        pair[1:-1] |= w[1:] != w[:-1]
        at_pair, at_context, at_row = (np.flatnonzero(x) for x in (pair, context, here))
        row_pairs = np.searchsorted(at_pair, at_row[1:])
        row_contexts = np.searchsorted(at_context, at_row[1:])
        context_pairs = np.diff(np.searchsorted(at_pair, at_context))
        rows = len(at_row) - 1
        marks = (chunk.docs * 2 + np.repeat(chunk.learn, chunk.lengths))[order]
        heads = [chunk.ids, pa.array(chunk.learn), pa.array(chunk.lengths, pa.int32())]
        offsets = pa.array([0, *[len(chunk.lengths)] * rows], pa.int32())
        columns = [
            pa.array(b[at_row[:-1]], pa.int32()), pa.array([chunk.name] * rows),
            _lists(h[at_context[:-1]].view(np.int64), row_contexts, pa.int64()),
            _lists(context_pairs, row_contexts, pa.int32()),
            _lists(w[at_pair[:-1]].view(np.int64), row_pairs, pa.int64()),
            _lists(np.diff(at_pair), row_pairs, pa.int32()),
            _lists(marks.astype(np.int16), at_row[1:], pa.int16()) if postings else pa.nulls(rows, pa.list_(pa.int16())),
            *[pa.ListArray.from_arrays(offsets, x) for x in heads],
        ]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return _read(docs, pack, schema)


class Bucket:
    """All pairs of a bucket, merged over chunks."""

    def __init__(self, table: pa.Table, rare: pa.Table, model: Words):
        def flat(name: str) -> np.ndarray:
            return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)

        h = np.repeat(flat("hs").view(np.uint64), flat("hn"))
        w = flat("ws").view(np.uint64)
        self.places = flat("wn")
        order = np.lexsort((w, h))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])
        self.of = np.empty(len(order), np.int64)  # the merged pair of each listed one
        self.of[order] = np.cumsum(new) - 1
        self.h, self.w = h[order][new], w[order][new]
        first = np.ones(len(self.h), bool)
        first[1:] = self.h[1:] != self.h[:-1]
        self.context = np.cumsum(first) - 1
        self.contexts = self.h[first]
        keys = rare.column("w").to_numpy().view(np.uint64)
        by = np.argsort(keys)
        self.counts = model.count(self.w, keys[by], rare.column("c").to_numpy()[by])
        self.alone = model.probability(self.counts)

    def per_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, values, len(self.contexts))


@dataclass
class Pairs:
    """Factors of pair counts, and the hot contexts: digest, count, discounted mass, mass of their words alone."""

    factors: np.ndarray
    hot: np.ndarray
    total: np.ndarray
    gone: np.ndarray
    seen: np.ndarray


def _tally(table: pa.Table, rare: pa.Table, model: Words, hot: np.ndarray) -> pa.Table:
    bucket = Bucket(table, rare, model)
    n = np.bincount(bucket.of, bucket.places).astype(np.int64)
    ranks = [np.count_nonzero(n == r) for r in range(1, DISCOUNTED + 2)]
    rows = [(0, False, ranks, 0, 0.0)]
    total, seen = bucket.per_context(n), bucket.per_context(bucket.alone)
    each = [bucket.per_context(n == r) for r in range(1, DISCOUNTED + 2)]
    for k in np.flatnonzero(_listed(bucket.contexts, hot)):
        rows.append((int(bucket.contexts[k].view(np.int64)), True, [int(x[k]) for x in each], int(total[k]), float(seen[k])))
    return pa.table(
        {"h": [r[0] for r in rows], "hot": [r[1] for r in rows], "n": pa.array([[int(x) for x in r[2]] for r in rows], pa.list_(pa.int64())),
         "total": [r[3] for r in rows], "seen": [r[4] for r in rows]}
    )


def pair_model(docs: DataFrame, rare: DataFrame, model, buckets: int, hot: np.ndarray) -> Pairs:
    def tally(table: pa.Table, others: pa.Table) -> pa.Table:
        return _tally(table, others, model.value, hot) if table.num_rows else _NO_TALLY

    learnt = pairs(docs.where("learn"), buckets, hot, False).select("b", "hs", "hn", "ws", "wn")
    told = learnt.groupBy("b").cogroup(rare.groupBy("b")).applyInArrow(
        tally, "h bigint, hot boolean, n array<bigint>, total bigint, seen double"
    )
    ranks = F.array(*[F.sum(F.get("n", F.lit(k))) for k in range(DISCOUNTED + 1)])
    rows = told.groupBy("hot", "h").agg(ranks.alias("n"), F.sum("total").alias("total"), F.sum("seen").alias("seen")).collect()
    whole = next((list(r.n) for r in rows if not r.hot), [0] * (DISCOUNTED + 1))
    d = discounts(whole)
    many = sorted(((r.h % 2**64, r) for r in rows if r.hot), key=lambda x: x[0])
    gone = [sum((1 - d[k]) * k * r.n[k - 1] for k in range(1, DISCOUNTED + 1)) for _, r in many]
    return Pairs(
        d, np.array([h for h, _ in many], np.uint64), np.array([r.total for _, r in many], float),
        np.array(gone, float), np.array([r.seen for _, r in many], float),
    )


_NO_TALLY = pa.table({
    "h": pa.array([], pa.int64()), "hot": pa.array([], pa.bool_()), "n": pa.array([], pa.list_(pa.int64())),
    "total": pa.array([], pa.int64()), "seen": pa.array([], pa.float64()),
})


def pair_probabilities(bucket: Bucket, n: np.ndarray, model: Words, known: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each pair of the bucket, and the backoff weight of each context; ``n``: training counts."""
    is_hot, seen = _listed(bucket.contexts, known.hot), n > 0
    total = bucket.per_context(n)
    mass = discounted(n, known.factors)
    gone = bucket.per_context(n - mass)
    words = bucket.per_context(np.where(seen, bucket.alone, 0.0))
    at = _find(bucket.contexts[is_hot], known.hot)[0]
    total[is_hot], gone[is_hot], words[is_hot] = known.total[at], known.gone[at], known.seen[at]
    # Where no count is low enough to be discounted, one more place is left to what was not seen.
    over = np.where((gone <= 0) & (total > 0), 1.0, 0.0)
    whole = total + over
    rest = np.maximum(1 - words, model.left)  # the unknown word is never seen in a context
    weight = np.where(total > 0, (gone + over) / np.where(total > 0, whole, 1) / rest, 1.0)
    direct = mass / np.maximum(whole, 1)[bucket.context]
    return np.where(seen, direct, weight[bucket.context] * bucket.alone), weight


def _answer(table: pa.Table, rare: pa.Table, model: Words, known: Pairs) -> pa.Table:
    bucket = Bucket(table, rare, model)
    marks = table.column("docs").combine_chunks().flatten().to_numpy()
    listed = np.repeat(np.arange(len(bucket.places)), bucket.places)
    n = np.bincount(bucket.of[listed], marks & 1, len(bucket.h)).astype(np.int64)
    score = np.log10(pair_probabilities(bucket, n, model, known)[0])[bucket.of]
    base, there = model.base(bucket.counts)[bucket.of], (bucket.counts > 0)[bucket.of]
    ends = np.cumsum(pa.compute.list_value_length(table.column("docs")).to_numpy())
    # Of the documents of a chunk only those with a token in this bucket, so that the answers grow
    # with the tokens however many buckets there are.
    doc, sums = [], ([], [], [])
    for a, b in zip(np.concatenate(([0], ends[:-1])), ends):
        docs, at = marks[a:b] >> 1, listed[a:b]
        doc.append(np.flatnonzero(np.bincount(docs)))
        for out, values in zip(sums, (score, base, there)):
            out.append(np.bincount(docs, values[at])[doc[-1]])
    ends = pa.array(np.cumsum([0, *map(len, doc)]), pa.int32())
    columns = {"doc": np.concatenate(doc).astype(np.int16), **{c: np.concatenate(x) for c, x in zip(("score", "base", "known"), sums)}}
    lists = {c: pa.ListArray.from_arrays(ends, pa.array(x)) for c, x in columns.items()}
    return pa.table({"chunk": table.column("chunk"), **lists, **{c: table.column(c) for c in ("ids", "learn", "sizes")}})


def log_probabilities(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``<doc_id>, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``learn`` says which rows are learnt from (null: yes); ``held_out`` is its opposite. ``score`` is
    the log10 probability of all tokens of the text, the end included; ``base_score`` that of an
    add-one-half model of single words. A null or empty text has one token, the end. Ids may be
    null or repeated: each row has its own result. Texts of any length are taken whole. Without any
    row to learn from every probability is 1; an empty table gives no row. Other columns are not
    read. Counts of pairs that tie need no order.

    The documents must be read from a table, so that a task that runs again sees the same rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).alias("id"), F.col(text).alias("text"), F.coalesce(learn, F.lit(True)).alias("learn")
    )
    with clean_shuffles(spark):
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(1, -(-size // BUCKET_BYTES))
        counted = count_words(rows)
        words = word_model(counted)
        hot = words.frequent[words.counts > HOT * words.total / buckets] if buckets > 1 else np.empty(0, np.uint64)
        model = spark.sparkContext.broadcast(words)
        rare = rare_words(rows, counted, model, buckets, hot)
        known = pair_model(rows, rare, model, buckets, hot)
    kind = docs.schema[doc_id].dataType.simpleString()
    lists = f"ids array<{kind}>, learn array<boolean>, sizes array<int>"

    def answer(table: pa.Table, others: pa.Table) -> pa.Table:
        return _answer(table, others, model.value, known) if table.num_rows else no_answer

    answers = f"chunk string, doc array<smallint>, score array<double>, base array<double>, known array<double>, {lists}"
    no_answer = pa.Table.from_batches([], _arrow_schema(spark, answers))
    total = words.total

    def gather(table: pa.Table) -> pa.Table:
        heads = table.filter(pa.compute.greater(pa.compute.list_value_length(table.column("sizes")), 0)).slice(0, 1)
        n = len(heads.column("sizes")[0])
        out = {"id": heads.column("ids").combine_chunks().flatten()}
        out["held_out"] = pa.compute.invert(heads.column("learn").combine_chunks().flatten())
        out["n_tokens"] = heads.column("sizes").combine_chunks().flatten().cast(pa.int64())
        sums = {}
        for c in ("known", "base", "score"):
            sums[c] = np.zeros(n)
            for docs, part in zip(table.column("doc"), table.column(c)):
                sums[c][docs.values.to_numpy()] += part.values.to_numpy()
        out["n_known"] = pa.array(np.rint(sums["known"]).astype(np.int64))
        out["train_tokens"] = pa.array(np.full(n, total, np.int64))
        return pa.table({**out, "base_score": pa.array(sums["base"]), "score": pa.array(sums["score"])})

    met = pairs(rows, buckets, hot, True).groupBy("b").cogroup(rare.groupBy("b")).applyInArrow(answer, answers)
    result = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return met.groupBy("chunk").applyInArrow(gather, result).withColumnRenamed("id", doc_id)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
