"""One query for each operator of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventlens.llm import (
    chunks, decontaminate, katz, langid, lines, mixing, negatives, quality, secrets, simhash, toxicity, urls, variants,
)
from eventlens.llm.common import held_out, table

#: Production parameters of the mixture: shares of all characters; other sources share the rest.
MIX_WEIGHTS = {"src0": 0.15, "src1": 0.10, "src2": 0.10, "src3": 0.05}
MIX_EPOCHS = 1.0


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.hex("fp")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_EPOCHS)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.coalesce(held_out(F.col("doc_id"), 5), F.lit(0))
    scored, name = toxicity.score(docs, toxicity.train(docs.where(fold != 0), table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (fold == 0).alias("held_out"),
        F.col(name).alias("score"),
        (F.col(name) >= 0.5).cast("int").alias("predicted"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunks.dedupe_passages(docs, report=True)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col(name)

    def text(kept):
        parts = F.transform(
            kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        )
        return F.concat_ws(",", parts)

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in secrets.KINDS[:3]],
        F.sha2(text(F.filter(spans, lambda s: s["kind"] != "literal")), 256).alias("base_sha256"),
        text(spans).alias("spans"),
        count("literal"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, m = F.col("text"), F.col("m")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.standard_rules(m, text)
    judged, verdict, _ = quality.cascade(docs, rules, prepare=lambda d: d.withColumn("m", quality.metrics(text)))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    failed = (m["n_words"] < quality.MIN_WORDS) | (
        100 * m["n_repeat_words"] > quality.MAX_REPEAT_PERCENT * m["n_words"]
    )
    return judged.select(
        "doc_id",
        *[m[c].alias(c) for c in counts],
        failed.alias("base_failed"),
        F.col(verdict).isNull().alias("kept"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found, name = decontaminate.find_contamination(docs, items)
    hit = F.col(name)
    return found.select(
        "doc_id",
        hit["n_words"].alias("n_words"),
        hit["n_hit"].alias("n_hit"),
        F.size(hit["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(hit["items"])), 256).alias("items_sha256"),
        (hit["n_hit"] > 0).alias("contaminated"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedupe_lines(table(spark, sf_dir, "documents"), report=True)
    return kept.select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.coalesce(held_out(F.col("doc_id"), 3), F.lit(0))
    learned = docs.where(fold != 1)
    found, name = langid.identify(docs.drop("lang"), learned, order=F.col("doc_id"))
    return found.select(
        "doc_id",
        (fold == 1).alias("held_out"),
        F.col(name)["lang"].alias("lang_pred"),
        F.col(name)["score"].alias("score"),
        F.col(name)["accepted"].alias("accepted"),
    )


def op11_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return katz.log_probabilities(docs, held_out(F.col("doc_id"), 5) != 1)


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(negatives.usable(F.col("label"), F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    prepared = rows.select(
        F.col("vec_id").alias("id"), label.alias("label"), negatives.quantised(F.col("embedding")).alias("vec")
    )
    return negatives.hard_negatives(prepared, F.col("id") % 100 == 0)


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.corpus_words(table(spark, sf_dir, "documents")))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(sql: str) -> str:
    return f"translate({sql}, '{_UPPER}', '{_LOWER}')"


def _mixing_sql() -> str:
    named = ", ".join(f"('{s}', {w})" for s, w in MIX_WEIGHTS.items())
    rest = 1.0 - sum(MIX_WEIGHTS.values())
    names = ", ".join(f"'{s}'" for s in MIX_WEIGHTS)
    return f"""
WITH RECURSIVE grouped AS (
    SELECT *, CASE WHEN source IN ({names}) THEN source ELSE '' END AS g,
           length(coalesce(text, '')) AS chars
    FROM documents),
target(g, w) AS (VALUES {named}, ('', {rest!r})),
rate AS (
    SELECT g, {MIX_EPOCHS!r} * w * (SELECT sum(chars) FROM grouped) / sum(chars) AS mean
    FROM grouped JOIN target USING (g) GROUP BY g, w HAVING sum(chars) > 0),
part AS (SELECT g, mean, CAST(ceil(mean / {mixing.PART!r}) AS INT) AS parts FROM rate WHERE mean > 0),
step AS (
    SELECT g, parts, mean / parts AS m, 0 AS k, exp(-mean / parts) AS p, exp(-mean / parts) AS total FROM part
    UNION ALL
    SELECT g, parts, m, k + 1, p * m / (k + 1), total + p * m / (k + 1) FROM step
    WHERE k < 200 AND total < 1 - pow(2, -{mixing.BITS})),
curve AS (
    SELECT g, parts, list(total ORDER BY k) AS steps FROM step
    WHERE total < 1 - pow(2, -{mixing.BITS}) GROUP BY g, parts),
draw AS (
    SELECT d.*, unnest(range(0, parts)) AS i, steps FROM grouped d JOIN curve USING (g)),
counted AS (
    SELECT doc_id, text, lang, source, n_chars,
           sum(len(list_filter(steps, lambda t: t <= CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '~')
               || ':' || i), 1, {mixing.BITS // 4}) AS BIGINT) / pow(2, {mixing.BITS})))) AS n
    FROM draw GROUP BY ALL),
dealt AS (SELECT *, CAST(unnest(range(0, CAST(n AS BIGINT))) AS INT) AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, copy,
       md5('mix:order:' || coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || copy) AS shuffle_key
FROM dealt
"""


_LINES_SQL = f"""
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (
    SELECT *, {_lower("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
    FROM line),
often AS (
    SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= {lines.MIN_CHARS}
    GROUP BY key HAVING count(DISTINCT doc_id) >= {lines.MIN_DOCS}),
flagged AS (
    SELECT k.*, (o.keep IS NOT NULL AND o.keep <> k.doc_id) AS gone FROM keyed k LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""


_SPACE = "[\\x20\\x09-\\x0D]"
_QUALITY_SQL = f"""
WITH base AS (
    SELECT doc_id, coalesce(text, '') AS text,
           list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda w: w <> '') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)),
                       lambda l: length(regexp_replace(l, '{_SPACE}+', '', 'g')) > 0) AS lines
    FROM documents),
window_at AS (
    SELECT doc_id, unnest(range(1, len(words) - 1)) AS p, words FROM base WHERE len(words) >= 3),
shingle AS (
    SELECT doc_id, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS s FROM window_at),
again AS (
    SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS n FROM shingle) WHERE n > 1),
covered AS (
    SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM again)
    GROUP BY doc_id),
m AS (
    SELECT doc_id, words, lines, text, CAST(len(words) AS BIGINT) AS n_words,
           length(regexp_replace(text, '{_SPACE}+', '', 'g')) AS word_chars,
           length(text) - length(translate(text, '{quality.SYMBOLS}', '')) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           coalesce(c.n, 0) AS n_repeat_words,
           len(list_filter(words, lambda w: regexp_matches(w, '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]'))) AS letters,
           len(list_filter(lines, lambda l: regexp_matches(l, '^[ \\t]*[-*•]'))) AS items
    FROM base LEFT JOIN covered c USING (doc_id)),
v AS (
    SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed
    FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words
            OR (n_dup_lines >= {quality.MIN_SAME_LINES} AND 10 * n_dup_lines > 3 * len(lines)) OR 10 * letters < 7 * n_words OR 10 * items > 9 * len(lines)) AS kept
FROM v
"""

_LEAKS_SQL = f"""
WITH item AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_lower("coalesce(text, '')")},
           '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), {decontaminate.WINDOW}) AS n FROM item WHERE len(w) > 0),
windows AS (
    SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS key
    FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
doc AS (
    SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
    FROM documents),
cut AS (
    SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS key
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM doc, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)),
found AS (SELECT doc_id, i, c.n, item FROM cut c JOIN windows USING (key) WHERE c.n = windows.n),
hit AS (
    SELECT doc_id, count(DISTINCT q) AS n_hit FROM (
        SELECT doc_id, unnest(range(i, i + n)) AS q FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def llm_oracles() -> dict[str, str]:
    return {"op2_mixing": _mixing_sql(), "op7_quality": _QUALITY_SQL,
            "op8_decontamination": _LEAKS_SQL, "op9_line_dedup": _LINES_SQL}
