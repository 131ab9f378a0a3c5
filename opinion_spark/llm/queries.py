"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinion_spark.llm import decontamination, fim, html_text, jaccard, language_model, lexical_search, line_dedup, minhash, packing, pii, quality, sharding, token_counts
from opinion_spark.session import reach_workers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary of the packing query, wherever the public tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(_table(spark, sf_dir, "documents"))


def piece_path() -> str:
    """The vocabulary of the counting query."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), piece_path)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


def op6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))

    def of(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    base = of(*pii.BASE_KINDS)
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(_table(spark, sf_dir, "documents"), unit="line", digests=True)


def _reached(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose local Python workers can import this package."""
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reach_workers(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {query.__name__: _reached(query) for query in (
    op1_packing, op2_line_dedup, op3_token_counts, op4_jaccard, op5_html, op6_scores, op7_decontamination, op8_pii, op9_quality, op10_sharding,
    op11_minhash, op12_search, op13_fim,
)}

_WORDS_7 = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_WORDS = r"coalesce(regexp_extract_all({text}, '[^\x20\x09-\x0D]+'), [])"

_WORDS_12 = r"coalesce(regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"



def _components(n: int) -> str:
    """Components of documents by the Jaccard similarity of their ``n``-word shingles, as the table ``found``."""
    return f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + least({n}, len(w)) - 1], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n}, 0) + 2)) AS k FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
r(doc_id, seen) AS (SELECT a, a FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen),
found AS (
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
  FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id)"""


ORACLE: dict[str, str] = {
    "op4_jaccard": _components(5) + """
SELECT doc_id, n_shingles, component_id FROM found""",
    "op9_quality": f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format(text="text")} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS MATERIALIZED (
  SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, gram) AS times
  FROM (SELECT doc_id, k, array_to_string(w[k:k + 2], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) > 2))),
p AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS i FROM g WHERE times > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
         len(lines) AS n_lines, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS letter_words,
         len(regexp_extract_all(t, '\\p{{Lu}}')) AS upper_, len(regexp_extract_all(t, '\\p{{L}}')) AS letters
  FROM d LEFT JOIN p ON p.doc_id = d.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_symbols <= 10 * n_words AND word_chars BETWEEN 3 * n_words AND 10 * n_words AND 100 * n_dup_lines <= 50 * n_lines
       AND 100 * letter_words >= 80 * n_words AND 100 * upper_ <= 40 * letters AS kept
FROM f""",
    "op7_decontamination": f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce({_WORDS_7.format(text="text")}, []) AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, coalesce({_WORDS_7.format(text="text")}, []) AS w FROM benchmark),
q AS MATERIALIZED (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM b WHERE len(w) > 0)),
g AS MATERIALIZED (
  SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM q))),
m AS MATERIALIZED (SELECT doc_id, item_id, k, g.size FROM g JOIN q ON g.gram = q.gram AND g.size = q.size),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id""",
    "op11_minhash": _components(4) + """
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM found""",
    "op12_search": f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS_12.format(text="text")} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d),
f AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
t AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM f, s GROUP BY term, docs),
m AS (SELECT doc_id, 25 + (75 * len(w) * docs) // words AS m FROM d, s WHERE len(w) > 0),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_WORDS_12.format(text="text")}) AS term FROM benchmark) GROUP BY ALL),
c AS (
  SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM c WHERE score > 0 QUALIFY rank <= 10""",
    "op13_fim": """
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units, sha256('7:' || doc_id) AS h FROM documents),
c AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS y,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT *, array_to_string(units[1:least(x, y)], '') AS prefix, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS middle,
         array_to_string(units[greatest(x, y) + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p""",
}
