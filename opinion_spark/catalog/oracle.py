"""The registered queries in SQL, as a check of their results.

Written against the table definitions alone, with plain joins and windows
over whole tables; nothing here is used by the library.
"""

from __future__ import annotations

from opinion_spark.catalog.queries import RAW_LABELS
from opinion_spark.constants import CLASS_NAMES, CLASSES, MODEL_NAMES
from opinion_spark.functions.stop_words import CLOUD, FEATURE
from opinion_spark.functions.text import ALL_DIGITS, CLOUD_TOKEN, FEATURE_TOKEN
from opinion_spark.operators.lexicon import ABUSE
from opinion_spark.sources.reviews import NULL_TOKENS


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def listing(values) -> str:
    return ", ".join(map(text, values))


def name_of(label: str) -> str:
    return f"CASE {label} " + " ".join(f"WHEN {c} THEN {text(n)}" for c, n in CLASS_NAMES.items()) + " END"


REVIEWS = """
WITH unlabelled AS (
  SELECT d.doc_id, d.text AS review_text, split_part(d.text, chr(10), 1) AS review_title, d.lang AS country,
         CAST(CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 1 + l.quality
                   WHEN l.quality = 0 THEN 3 ELSE 4 + (d.n_chars % 2) END AS DOUBLE) AS numeric_rating
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
reviews AS (
  SELECT *, CAST(CASE WHEN numeric_rating <= 2 THEN -1 WHEN numeric_rating = 3 THEN 0 ELSE 1 END AS INTEGER) AS label
  FROM unlabelled),
rated AS (SELECT * FROM reviews WHERE numeric_rating IS NOT NULL)
"""


def split_of(ratio: float) -> str:
    return REVIEWS + f"""
, sizes AS (SELECT label, count(*) AS n FROM rated GROUP BY label)
, totals AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(ceil(CAST({ratio} AS DOUBLE) * sum(n)) AS BIGINT) AS n_test FROM sizes)
, quotas AS (SELECT label, n, total, n_test, (n * (total - n_test)) // total AS low, (n * (total - n_test)) % total AS rest FROM sizes, totals)
, shares AS (
  SELECT label, n - low - CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= (total - n_test) - sum(low) OVER () THEN 1 ELSE 0 END AS take
  FROM quotas)
, split AS (
  SELECT r.*, row_number() OVER (PARTITION BY r.label ORDER BY md5(concat(r.doc_id, '-42'))) <= s.take AS is_test
  FROM rated r JOIN shares s ON r.label = s.label)
"""


SPLIT = split_of(0.2)

TOKENS = f"list_filter(regexp_extract_all(lower(review_text), '{FEATURE_TOKEN}'), lambda w: w NOT IN ({listing(FEATURE)}))"

FEATURES = SPLIT + f"""
, tokens AS (SELECT doc_id, label, is_test, {TOKENS} AS tokens FROM split)
, words AS (SELECT doc_id, is_test, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i FROM tokens)
, neighbours AS (SELECT doc_id, is_test, w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM words)
, terms AS (
  SELECT doc_id, is_test, w AS term FROM words
  UNION ALL SELECT doc_id, is_test, w || ' ' || v FROM neighbours WHERE v IS NOT NULL)
, tf AS (SELECT doc_id, is_test, term, count(*) AS tf FROM terms GROUP BY ALL)
, train_size AS (SELECT count(*) AS n FROM split WHERE NOT is_test)
, frequent AS (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf FROM tf WHERE NOT is_test GROUP BY term
  HAVING count(*) >= 3 AND count(*) <= CAST(0.9 AS DOUBLE) * (SELECT n FROM train_size)
  ORDER BY total_tf DESC, term LIMIT 15000)
, vocabulary AS (
  SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_index, df, total_tf,
         ln(CAST(1 + (SELECT n FROM train_size) AS DOUBLE) / (1 + df)) + 1 AS idf
  FROM frequent)
, raw AS (SELECT doc_id, is_test, term, tf, tf * idf AS w FROM tf JOIN vocabulary USING (term))
, weights AS (SELECT doc_id, is_test, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)
"""

BAYES = FEATURES + """
, class_docs AS (SELECT label, count(*) AS n FROM split WHERE NOT is_test GROUP BY label)
, cells AS (
  SELECT s.label, w.term, sum(w.weight) AS weight FROM weights w JOIN split s ON s.doc_id = w.doc_id
  WHERE NOT w.is_test GROUP BY s.label, w.term)
, grid AS (
  SELECT c.label, v.term, coalesce(x.weight, 0) AS weight,
         ln(CAST(c.n AS DOUBLE) / (SELECT n FROM train_size)) AS log_prior
  FROM class_docs c CROSS JOIN vocabulary v LEFT JOIN cells x ON x.label = c.label AND x.term = v.term)
, theta AS (
  SELECT label, term, log_prior,
         ln((weight + 1) / (sum(weight) OVER (PARTITION BY label) + count(*) OVER (PARTITION BY label))) AS log_theta
  FROM grid)
, priors AS (SELECT DISTINCT label, log_prior FROM theta)
, parts AS (
  SELECT w.doc_id, t.label, sum(w.weight * t.log_theta) AS part
  FROM weights w JOIN theta t ON t.term = w.term WHERE w.is_test GROUP BY w.doc_id, t.label)
, scores AS (
  SELECT s.doc_id, s.label, p.label AS candidate, p.log_prior + coalesce(x.part, 0) AS score
  FROM split s CROSS JOIN priors p LEFT JOIN parts x ON x.doc_id = s.doc_id AND x.label = p.label WHERE s.is_test)
, predicted AS (
  SELECT doc_id, label, candidate AS prediction, score FROM scores
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, candidate) = 1)
"""

# The same without a limit on the vocabulary.
LIMITED = "ORDER BY total_tf DESC, term LIMIT 15000"
ALL_FEATURES, ALL_BAYES = FEATURES.replace(LIMITED, ""), BAYES.replace(LIMITED, "")

# The fitted model on every text, rated or not.
BAYES_ON_ALL = BAYES + f"""
, all_tokens AS (SELECT doc_id, {TOKENS} AS tokens FROM unlabelled)
, all_words AS (SELECT doc_id, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i FROM all_tokens)
, all_neighbours AS (SELECT doc_id, w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM all_words)
, all_terms AS (
  SELECT doc_id, w AS term FROM all_words UNION ALL SELECT doc_id, w || ' ' || v FROM all_neighbours WHERE v IS NOT NULL)
, all_raw AS (SELECT doc_id, term, count(*) * any_value(idf) AS w FROM all_terms JOIN vocabulary USING (term) GROUP BY doc_id, term)
, all_weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM all_raw)
, all_parts AS (
  SELECT w.doc_id, t.label, sum(w.weight * t.log_theta) AS part FROM all_weights w JOIN theta t ON t.term = w.term GROUP BY w.doc_id, t.label)
, all_scores AS (
  SELECT u.doc_id, p.label AS prediction, p.log_prior + coalesce(x.part, 0) AS score
  FROM unlabelled u CROSS JOIN priors p LEFT JOIN all_parts x ON x.doc_id = u.doc_id AND x.label = p.label)
SELECT doc_id, prediction FROM all_scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, prediction) = 1
"""


def lexicon(source: str, limit: int | None) -> str:
    seen = "review_text" if limit is None else f"substr(review_text, 1, {limit})"
    return f"""
, counted AS (
  SELECT *, length({seen}) AS seen_chars,
         len(list_filter(regexp_extract_all(lower({seen}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ({listing(ABUSE)}))) AS hits
  FROM {source} WHERE review_text IS NOT NULL)
, labelled AS (
  SELECT *, CASE WHEN hits >= 2 THEN '1 star' WHEN hits = 1 THEN '2 stars' WHEN seen_chars < 500 THEN '3 stars' ELSE '5 stars' END AS hf_label,
         round(1 - 1 / (2.0::DOUBLE + hits), 6) AS hf_score
  FROM counted)
, scored AS (
  SELECT *, CAST(CASE hf_label WHEN '3 stars' THEN 0 WHEN '5 stars' THEN 1 ELSE -1 END AS INTEGER) AS hf_mapped, 'lexicon' AS model
  FROM labelled)
"""


SAMPLE = """
, wanted AS (SELECT least(500, count(*)) AS size, least(500, count(*)) // count(DISTINCT label) AS quota FROM rated)
, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat(doc_id, '-42'))) AS place FROM rated)
, sample AS (
  SELECT *, CAST(row_number() OVER (ORDER BY md5(concat(doc_id, '-42-order'))) - 1 AS BIGINT) AS eval_id
  FROM ranked WHERE place <= (SELECT quota FROM wanted))
"""

EVALUATION = REVIEWS + SAMPLE + lexicon("sample", None)
SCORED_TEXTS = REVIEWS + lexicon("unlabelled", None) + "SELECT doc_id, hf_label, hf_score, hf_mapped, model FROM scored"


def report(prefix: str, source: str, label: str, prediction: str, extra: str = "") -> str:
    classes = ", ".join(f"({c}, {text(CLASS_NAMES[c])})" for c in CLASSES)
    inside = ", ".join(map(str, CLASSES))
    return prefix + f"""
, judged AS (SELECT {label} AS y, {prediction} AS p FROM {source})
, listed(c, class) AS (VALUES {classes})
, tallies AS (
  SELECT c, class, count_if(y = c AND p = c) AS tp, count_if(p = c) AS predicted, count_if(y = c) AS support
  FROM listed, judged GROUP BY c, class)
, scores_ AS (
  SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted::DOUBLE END AS precision,
         CASE WHEN support = 0 THEN 0 ELSE tp / support::DOUBLE END AS recall
  FROM tallies)
, full_ AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1_score FROM scores_)
, outside AS (SELECT count(*) AS n FROM judged WHERE y NOT IN ({inside}) OR p NOT IN ({inside}))
, micro AS (SELECT sum(tp) / sum(predicted)::DOUBLE AS precision, sum(tp) / sum(support)::DOUBLE AS recall, sum(support) AS support FROM full_)
, every AS (
  SELECT class, precision, recall, f1_score, support FROM full_
  UNION ALL SELECT CASE WHEN (SELECT n FROM outside) > 0 THEN 'micro avg' ELSE 'accuracy' END, precision, recall,
                   2 * precision * recall / (precision + recall), support FROM micro
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) FROM full_
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1_score * support) / sum(support), sum(support) FROM full_)
SELECT {extra}class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
       CAST(support AS BIGINT) AS support FROM every
"""


def matrix(prefix: str, source: str, label: str, prediction: str, extra: str = "") -> str:
    grid = ", ".join(f"({a}, {p})" for a in CLASSES for p in CLASSES)
    return prefix + f"""
, cells_(actual, predicted) AS (VALUES {grid})
SELECT {extra}c.actual, c.predicted, count(s.{label}) AS n
FROM cells_ c LEFT JOIN {source} s ON s.{label} = c.actual AND s.{prediction} = c.predicted GROUP BY c.actual, c.predicted
"""


def fold(out: str, source: str) -> str:
    return f"""
, {out}_s AS MATERIALIZED (SELECT spelling, n, lower(spelling) AS word, right(lower(spelling), 1) = 's' AND right(lower(spelling), 2) <> 'ss' AS plural FROM {source})
, {out}_w AS MATERIALIZED (SELECT DISTINCT word FROM {out}_s)
, {out}_m AS MATERIALIZED (
  SELECT s.*, plural AND w.word IS NOT NULL AS merged FROM {out}_s s LEFT JOIN {out}_w w ON w.word = left(s.word, length(s.word) - 1))
, {out}_f AS (
  SELECT CASE WHEN merged THEN left(word, length(word) - 1) ELSE word END AS word,
         CASE WHEN merged THEN left(spelling, length(spelling) - 1) ELSE spelling END AS form, sum(n) AS n
  FROM {out}_m GROUP BY ALL)
, {out} AS MATERIALIZED (SELECT word, first(form ORDER BY n DESC, form) AS term, CAST(sum(n) AS BIGINT) AS n FROM {out}_f GROUP BY word)
"""


def cloud(source: str) -> str:
    token, digits = CLOUD_TOKEN.replace("'", "''"), ALL_DIGITS
    return REVIEWS + f"""
, spelled AS MATERIALIZED (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(review_text, '{token}'),
           lambda w: CASE WHEN lower(right(w, 2)) = '''s' THEN left(w, length(w) - 2) ELSE w END),
           lambda w: NOT regexp_matches(w, '{digits}')) AS words
  FROM {source})
, flat AS MATERIALIZED (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM spelled)
, stops(w) AS (SELECT unnest([{listing(CLOUD)}]))
, next_to AS (SELECT w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM flat)
, single_counts AS MATERIALIZED (SELECT f.w AS spelling, count(*) AS n FROM flat f LEFT JOIN stops s ON lower(f.w) = s.w WHERE s.w IS NULL GROUP BY f.w)
, pair_counts AS MATERIALIZED (
  SELECT n.w || ' ' || n.v AS spelling, count(*) AS n FROM next_to n LEFT JOIN stops a ON lower(n.w) = a.w LEFT JOIN stops b ON lower(n.v) = b.w
  WHERE n.v IS NOT NULL AND a.w IS NULL AND b.w IS NULL GROUP BY 1)
, total AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM single_counts)
""" + fold("single", "single_counts") + fold("pair", "pair_counts") + """
, standard AS MATERIALIZED (
  SELECT DISTINCT m.word, s.term, s.n FROM single_m m
  JOIN single s ON s.word = CASE WHEN m.merged THEN left(m.word, length(m.word) - 1) ELSE m.word END)
, matched AS MATERIALIZED (
  SELECT p.term AS pair, a.term AS word1, b.term AS word2, p.n, a.n AS c1, b.n AS c2, (SELECT n FROM total) AS total
  FROM pair p JOIN standard a ON a.word = split_part(p.word, ' ', 1) JOIN standard b ON b.word = split_part(p.word, ' ', 2))
, shares AS (
  SELECT *, c2 / total AS p0, n / c1::DOUBLE AS p1, CASE WHEN total > c1 THEN (c2 - n) / (total - c1) END AS p2 FROM matched)
, likely AS (
  SELECT *, CASE WHEN total <= c1 OR total <= c2 THEN 0 ELSE -2 * (
      n * ln(greatest(p0, 1e-10)) + (c1 - n) * ln(greatest(1 - p0, 1e-10))
    + (c2 - n) * ln(greatest(p0, 1e-10)) + (total - c1 - c2 + n) * ln(greatest(1 - p0, 1e-10))
    - n * ln(greatest(p1, 1e-10)) - (c1 - n) * ln(greatest(1 - p1, 1e-10))
    - (c2 - n) * ln(greatest(p2, 1e-10)) - (total - c1 - c2 + n) * ln(greatest(1 - p2, 1e-10))) END AS score
  FROM shares)
, found AS (SELECT * FROM likely WHERE score > 30)
"""


def word_freq(label: int) -> str:
    return cloud(f"(SELECT * FROM reviews WHERE label = {label})") + """
, changes AS (
  SELECT term, n FROM single
  UNION ALL SELECT pair, n FROM found UNION ALL SELECT word1, -n FROM found UNION ALL SELECT word2, -n FROM found)
, best AS (SELECT term, CAST(sum(n) AS BIGINT) AS n FROM changes GROUP BY term HAVING sum(n) > 0 ORDER BY n DESC, term LIMIT 200)
SELECT term, n, round(n / max(n) OVER ()::DOUBLE, 6) AS relative FROM best
"""


def histogram(prefix: str, source: str, column: str) -> str:
    return prefix + f"""
, vals AS (SELECT CAST({column} AS DOUBLE) AS x FROM {source} WHERE {column} IS NOT NULL)
, ends AS (SELECT min(x) - CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0 END AS lo, max(x) + CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0 END AS hi FROM vals)
, bins AS (
  SELECT CAST(i AS INTEGER) AS bin, lo + (i - 1) * ((hi - lo) / 5) AS a, CASE WHEN i = 5 THEN hi ELSE lo + i * ((hi - lo) / 5) END AS b
  FROM ends, range(1, 6) t(i))
SELECT bin, round(a, 6) AS bin_start, round(b, 6) AS bin_end, count(x) AS n
FROM bins LEFT JOIN vals ON x >= a AND (x < b OR (bin = 5 AND x <= b)) GROUP BY bin, a, b
"""


def nullable(column: str) -> str:
    return f"CASE WHEN {column} IN ({listing(NULL_TOKENS)}) THEN NULL ELSE {column} END AS {column}"


# Naive Bayes and the word-list rule, the latter twice, on the same test rows.
CANDIDATES = BAYES + lexicon("(SELECT * FROM split WHERE is_test)", None).replace(", labelled AS", ", listed_ AS").replace("FROM labelled", "FROM listed_").replace(", scored AS", ", judged_list AS") + """
, candidates AS (
  SELECT 'Naive Bayes' AS model, avg((label = prediction)::INTEGER) AS accuracy, 0 AS model_order FROM predicted
  UNION ALL SELECT n.name, avg((label = hf_mapped)::INTEGER), n.place FROM judged_list, (VALUES ('Word list', 1), ('Word list again', 2)) n(name, place)
  GROUP BY n.name, n.place)
"""

POSITIONAL = REVIEWS + lexicon("rated", None) + """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS eval_id, doc_id, label, hf_label, hf_score, hf_mapped FROM scored"""

ORACLE: dict[str, str] = {
    "csv_roundtrip": REVIEWS + f"""
SELECT doc_id, {nullable('review_text')}, {nullable('review_title')}, numeric_rating, label, {nullable('country')} FROM reviews""",
    "csv_ingested": REVIEWS + f"""
SELECT doc_id, {nullable('review_text')}, {nullable('review_title')}, numeric_rating, label, {nullable('country')}, 1 AS times_parsed FROM reviews""",
    "csv_parallel": """
WITH wrapped AS (SELECT doc_id, '"' || chr(10) || ',"' || replace(text, ' ', '"') || chr(10) || '"",' AS t, lang FROM documents)
SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5, lang AS country FROM wrapped""",
    "role_resolution": """
SELECT 'text' AS role, 'Full Review Text' AS column_name, count(text) AS filled FROM documents
UNION ALL SELECT 'title', 'Review Summary', count(split_part(text, chr(10), 1)) FROM documents
UNION ALL SELECT 'country', 'Buyer Country', count(lang) FROM documents""",
    "rating_to_label": REVIEWS + """
SELECT doc_id, numeric_rating, label, CASE WHEN numeric_rating IS NOT NULL THEN label END AS label_or_null,
       CAST(CASE WHEN numeric_rating - 0.5 <= 2 THEN -1 WHEN numeric_rating - 0.5 = 3 THEN 0 ELSE 1 END AS INTEGER) AS label_half_lower
FROM reviews""",
    "complete_cases": REVIEWS + "SELECT doc_id, label, length(review_text) AS n_chars FROM rated WHERE review_text IS NOT NULL",
    "text_cast": """
SELECT doc_id, CAST(quality AS VARCHAR) AS review_text, toxic AS label FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL""",
    "truncate_text": """
SELECT doc_id, length(text) AS n_chars, least(length(text), 2000) AS n_seen, md5(text) AS full_md5, md5(left(text, 2000)) AS seen_md5
FROM documents""",
    "normalize_label": f"""
WITH raws AS (SELECT event_id, ([{listing(RAW_LABELS)}])[event_id % {len(RAW_LABELS)} + 1] AS raw FROM events),
marks AS (SELECT *, lower(trim(raw)) AS m FROM raws)
SELECT event_id, raw, CAST(CASE
  WHEN m IS NULL THEN 0
  WHEN m LIKE '%neg%' OR m LIKE '%-1%' THEN -1
  WHEN m LIKE '%neu%' OR m LIKE '%0%' THEN 0
  WHEN m LIKE '%pos%' OR m LIKE '%+1%' THEN 1
  WHEN m NOT LIKE '%star%' THEN 0
  WHEN m LIKE '%1%' OR m LIKE '%2%' THEN -1
  WHEN m LIKE '%3%' THEN 0
  WHEN m LIKE '%4%' OR m LIKE '%5%' THEN 1
  ELSE 0 END AS INTEGER) AS mapped
FROM marks""",
    "model_short_name": f"""
WITH named AS (SELECT ([{listing(MODEL_NAMES)}])[doc_id % {len(MODEL_NAMES)} + 1] AS model FROM documents)
SELECT model, split_part(model, '/', -1) AS short, left(split_part(model, '/', -1), 25) AS short_25, count(*) AS n FROM named GROUP BY model""",
    "label_names": REVIEWS + f"SELECT label, {name_of('label')} AS sentiment, count(*) AS n FROM reviews GROUP BY label",
    "text_previews": "SELECT doc_id, left(text, 200) || '...' AS preview FROM documents",
    "round_half_even": "SELECT l_linenumber, round(sum(round_even(l_quantity / 8, 2)), 2) AS total FROM lineitem GROUP BY l_linenumber",
    "display_ties": """
WITH v AS (SELECT DISTINCT (l_orderkey % 20000 + l_linenumber * 3125) / 20000.0::DOUBLE AS x FROM lineitem)
SELECT x, format('{:.4f}', x) AS x_4, format('{:.3f}', x) AS x_3, format('{:.2f}%', 100 * x) AS x_percent, format('{:.2f}', -x / 3) AS third FROM v""",
    "review_count": "SELECT count(*) AS n_reviews FROM documents",
    "sentiment_counts": REVIEWS + """
SELECT count(*) AS total, CAST(count_if(label = 1) AS BIGINT) AS positive, CAST(count_if(label = 0) AS BIGINT) AS neutral,
       CAST(count_if(label = -1) AS BIGINT) AS negative FROM reviews""",
    "label_distribution": REVIEWS + "SELECT label, count(*) AS n FROM reviews WHERE label IS NOT NULL GROUP BY label",
    "rating_histogram": histogram(REVIEWS, "unlabelled", "numeric_rating"),
    "value_histogram": histogram("WITH source AS (SELECT * FROM events)", "source", "value"),
    "top_countries": """
SELECT lang AS "Pays", count(*) AS "Nombre" FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY 2 DESC, 1 LIMIT 10""",
    "top_nations": """
SELECT n_name AS "Pays", count(*) AS "Nombre" FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE n_name IS NOT NULL GROUP BY n_name ORDER BY 2 DESC, 1 LIMIT 10""",
    "class_guard": REVIEWS + "SELECT count(DISTINCT label) AS n_classes, count(DISTINCT label) >= 2 AS enough FROM rated",
    "dataset_preview": REVIEWS + """
SELECT doc_id, review_text, review_title, country, numeric_rating, label FROM reviews ORDER BY doc_id LIMIT 30""",
    "cleaned_dataset": REVIEWS + "SELECT review_text, review_title, numeric_rating, label, country FROM reviews",
    "word_freq_pos": word_freq(1),
    "word_freq_neg": word_freq(-1),
    "word_collocations": cloud("unlabelled") + """
SELECT pair, word1, word2, n, c1, c2, round(score, 4) AS score FROM found""",
    "stratified_split": SPLIT + "SELECT doc_id, label, is_test FROM split",
    "split_by_order": """
WITH sizes AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)
, totals AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(ceil(CAST(0.4 AS DOUBLE) * sum(n)) AS BIGINT) AS n_test FROM sizes)
, quotas AS (SELECT l_orderkey, n, total, n_test, (n * (total - n_test)) // total AS low, (n * (total - n_test)) % total AS rest FROM sizes, totals)
, shares AS (
  SELECT l_orderkey, n - low - CASE WHEN row_number() OVER (ORDER BY rest DESC, l_orderkey) <= (total - n_test) - sum(low) OVER () THEN 1 ELSE 0 END AS take
  FROM quotas)
SELECT l.l_orderkey, l_linenumber,
       row_number() OVER (PARTITION BY l.l_orderkey ORDER BY md5(concat(l.l_orderkey, '-', l_linenumber, '-42'))) <= take AS is_test
FROM lineitem l JOIN shares s ON l.l_orderkey = s.l_orderkey""",
    "hash_split": "SELECT doc_id, md5(concat(doc_id, '-42')) < '400000000000000' AS is_test FROM documents",
    "split_sizes": split_of(0.35) + """
SELECT count(*) FILTER (NOT is_test) AS train_size, count(*) FILTER (is_test) AS test_size,
       65.0::DOUBLE AS train_percent, 35.0::DOUBLE AS test_percent FROM split""",
    "stratified_sample": REVIEWS + SAMPLE + "SELECT eval_id, doc_id, label FROM sample",
    "random_sample": """
WITH ranked AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat(doc_id, '-42'))) AS place FROM documents)
SELECT CAST(row_number() OVER (ORDER BY md5(concat(doc_id, '-42-order'))) - 1 AS BIGINT) AS eval_id, doc_id
FROM ranked WHERE place <= 500""",
    "tfidf_tokens": REVIEWS + f"""
, t AS (SELECT doc_id, {TOKENS} AS tokens FROM unlabelled)
SELECT doc_id, len(tokens) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM t""",
    "tfidf_ngrams": REVIEWS + f"""
, t AS (SELECT doc_id, {TOKENS} AS tokens FROM unlabelled)
, g AS (
  SELECT doc_id, list_concat(tokens, list_transform(generate_series(1, len(tokens) - 1), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS terms
  FROM t)
SELECT doc_id, len(terms) AS n_terms, array_to_string(terms, '|') AS terms FROM g""",
    "tfidf_vocabulary": FEATURES + "SELECT term, term_index, df, total_tf FROM vocabulary",
    "tfidf_idf": FEATURES + "SELECT term, round(idf, 6) AS idf FROM vocabulary",
    "tfidf_weights": FEATURES + "SELECT doc_id, term, tf, round(weight, 6) AS weight FROM weights WHERE NOT is_test",
    "tfidf_weights_test": FEATURES + "SELECT doc_id, term, tf, round(weight, 6) AS weight FROM weights WHERE is_test",
    "tfidf_all_terms": ALL_FEATURES + "SELECT term, CAST(term_index AS BIGINT) AS term_index, df, total_tf, round(idf, 6) AS idf FROM vocabulary",
    "tfidf_all_weights": ALL_FEATURES + "SELECT doc_id, term, tf, round(weight, 6) AS weight FROM weights WHERE is_test",
    "nb_table_parameters": ALL_BAYES + "SELECT label, term, round(log_theta, 6) AS log_theta, round(log_prior, 6) AS log_prior FROM theta",
    "nb_table_predictions": ALL_BAYES + "SELECT doc_id, label, prediction, round(score, 6) AS score FROM predicted",
    "class_weights": REVIEWS + """
SELECT label, count(*) AS n,
       round((SELECT count(*) FROM rated)::DOUBLE / ((SELECT count(DISTINCT label) FROM rated) * count(*)), 6) AS weight
FROM rated GROUP BY label""",
    "nb_parameters": BAYES + "SELECT label, term, round(log_theta, 6) AS log_theta, round(log_prior, 6) AS log_prior FROM theta",
    "nb_predictions": BAYES + "SELECT doc_id, label, prediction, round(score, 6) AS score FROM predicted",
    "nb_report": report(BAYES, "predicted", "label", "prediction", "'Naive Bayes' AS model, "),
    "nb_confusion": matrix(BAYES, "predicted", "label", "prediction", "'Naive Bayes' AS model, "),
    "best_nb_model": BAYES + """
SELECT 'Naive Bayes' AS model, round(avg((label = prediction)::INTEGER), 6) AS accuracy,
       format('{:.4f}', avg((label = prediction)::INTEGER)) AS accuracy_text FROM predicted""",
    "lr_optimality": FEATURES + """
SELECT label, 1.0::DOUBLE AS mass_ratio, count(*) AS n_train, (SELECT CAST(count(*) AS INTEGER) FROM vocabulary) AS n_terms, true AS sums_to_zero
FROM split WHERE NOT is_test GROUP BY label""",
    "model_summary": SPLIT + """
, two(model, model_order) AS (VALUES ('Logistic Regression', 0), ('Naive Bayes', 1))
SELECT model, count(*) FILTER (NOT is_test) AS train_size, count(*) FILTER (is_test) AS test_size, 80.0::DOUBLE AS train_percent,
       20.0::DOUBLE AS test_percent, true AS has_accuracy, true AS is_timed, NULL AS error, model_order
FROM split, two GROUP BY model, model_order""",
    "model_comparison": CANDIDATES + """
SELECT model, round(accuracy, 6) AS accuracy, format('{:.3f}', accuracy) AS accuracy_text, model_order FROM candidates""",
    "best_model": CANDIDATES + """
, ranked_ AS (
  SELECT 'all' AS among, *, row_number() OVER (ORDER BY accuracy DESC, model_order) AS place FROM candidates
  UNION ALL SELECT 'equals', *, row_number() OVER (ORDER BY accuracy DESC, model_order) FROM candidates WHERE model_order > 0)
SELECT among, model, round(accuracy, 6) AS accuracy, format('{:.4f}', accuracy) AS accuracy_text FROM ranked_ WHERE place = 1""",
    "model_roundtrip": BAYES_ON_ALL,
    "score_batch": SCORED_TEXTS,
    "score_whole_text": REVIEWS + lexicon("unlabelled", None) + "SELECT doc_id, hf_label, hf_score, hf_mapped, model FROM scored",
    "score_cut_text": REVIEWS + lexicon("unlabelled", 2000) + "SELECT doc_id, hf_label, hf_score, hf_mapped, model FROM scored",
    "score_stream": SCORED_TEXTS,
    "eval_merged": EVALUATION + "SELECT eval_id, review_text, label, hf_label, hf_score, hf_mapped FROM scored",
    "eval_positional": POSITIONAL,
    "eval_positional_files": POSITIONAL,
    "snapshot_versions": REVIEWS + lexicon("rated", None) + """
SELECT label, count(*) AS n, 100::BIGINT AS sample_size FROM scored WHERE label = hf_mapped GROUP BY label
UNION ALL SELECT label, count(*), 200 FROM scored GROUP BY label
UNION ALL SELECT NULL, 0, 300""",
    "eval_snapshot": EVALUATION + """
SELECT eval_id, label, hf_mapped, model, (SELECT size FROM wanted) AS sample_size, 'review_text' AS text_column FROM scored""",
    "eval_metrics": report(EVALUATION, "scored", "label", "hf_mapped"),
    "prediction_distribution": EVALUATION + f"""
, shown(prediction) AS (VALUES (-1), (0), (1))
SELECT prediction, {name_of('prediction')} AS sentiment, count(hf_mapped) AS n,
       round(count(hf_mapped) / (SELECT size FROM wanted)::DOUBLE, 6) AS share
FROM shown LEFT JOIN scored ON hf_mapped = prediction GROUP BY prediction""",
    "error_examples": EVALUATION + f"""
SELECT eval_id, left(review_text, 200) || '...' AS preview, {name_of('label')} AS actual_name, {name_of('hf_mapped')} AS predicted_name
FROM scored WHERE label <> hf_mapped ORDER BY eval_id LIMIT 10""",
    "formatted_summary": report(REVIEWS + lexicon("rated", None), "scored", "label", "hf_mapped").replace(
        "SELECT class, round", """, numbers AS (
  SELECT (SELECT avg((y = p)::INTEGER) FROM judged) AS accuracy,
         max(f1_score) FILTER (class = 'macro avg') AS macro_f1, max(precision) FILTER (class = 'macro avg') AS macro_precision FROM every)
, old AS (SELECT class, round""") + """)
SELECT round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(macro_precision, 6) AS macro_precision,
       format('{:.4f}', accuracy) AS accuracy_4, format('{:.3f}', accuracy) AS accuracy_3,
       format('{:.2f}%', 100 * accuracy) AS accuracy_percent, format('{:.2f}%', 100 * macro_f1) AS macro_f1_percent,
       format('{:.1f}%', 100 * macro_precision) AS macro_precision_percent
FROM numbers""",
    "formatted_report": report(REVIEWS + lexicon("rated", None), "scored", "label", "hf_mapped").replace("SELECT class, round(precision, 6) AS precision", """, old AS (
SELECT class, precision AS p0, recall AS r0, f1_score AS f0, round(precision, 6) AS precision""") + """)
SELECT class, format('{:.3f}', p0) AS precision, format('{:.3f}', r0) AS recall, format('{:.3f}', f0) AS f1_score,
       format('{:.3f}', support::DOUBLE) AS support, format('{:,}', support) AS rows FROM old""",
    "alignment_check": REVIEWS + lexicon("rated", None) + """
SELECT (SELECT count(*) FROM rated) AS n_rows, count(hf_label) AS n_predictions, count(hf_mapped) AS n_merged,
       count(hf_label) = (SELECT count(*) FROM rated) AND count(hf_mapped) = count(hf_label) AS aligned FROM scored""",
    "accuracy": REVIEWS + lexicon("rated", None) + """
SELECT round(avg((label = hf_mapped)::INTEGER), 6) AS accuracy, count(*) AS n FROM scored""",
    "classification_report": report(REVIEWS + lexicon("rated", None), "scored", "label", "hf_mapped"),
    "star_report": report(REVIEWS, "(SELECT CAST(numeric_rating - 3 AS INTEGER) AS stars, label FROM rated)", "stars", "label"),
    "confusion_matrix": matrix(REVIEWS + lexicon("rated", None), "scored", "label", "hf_mapped"),
}
