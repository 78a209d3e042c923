"""The subpackage's queries, as (spark, sf_dir) -> DataFrame with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import exact_dedup, lm_scoring, mixing, ngram_join, packing, page_diff, substring_dedup, suffix_dedup, topk, toxicity
from textloom.llm._tables import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scores(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=100).withColumn("distance", F.round("distance", 6))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(table(spark, sf_dir, "documents")).select("doc_id", "keep_id")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_classes(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.main_text(table(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_repeats(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lm_scoring, op2_mixing, op3_topk, op4_toxicity, op5_substring_dedup, op6_exact_dedup, op7_ngram_join, op8_html_extraction, op9_suffix_dedup, op10_packing)
}

_WORDS = r"""
    words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
              FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"""
_GRAMS = _WORDS + """,
    sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g
             FROM words WHERE len(w) > 0)"""


_REPEATS = _WORDS + """,
    texts AS (SELECT DISTINCT doc_id, w FROM words WHERE len(w) >= 50),
    known AS (SELECT w, count(*) AS n, row_number() OVER () AS k FROM words WHERE len(w) >= 50 GROUP BY w),
    windows AS (SELECT k, s, md5(array_to_string(w[s + 1:s + 50], ' ')) AS h FROM known, unnest(range(0, len(w) - 49)) u(s)),
    hits AS (SELECT k, s, s - row_number() OVER (PARTITION BY k ORDER BY s) AS g FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
    stretches AS (SELECT k, min(s) AS a, max(s) + 50 AS z FROM hits GROUP BY k, g)"""


def _filled(name: str, rows: str, group: str, key: str) -> str:
    """CTEs that give each child of rows (group, key, room, share, t) its part of the group's t: by share, but no more
    than its room, which goes to the others. Children are full in the order of room by share, up to the first that isn't."""
    by = f"PARTITION BY {group} ORDER BY room / share, {key}"
    return f"""
    {name}_a AS (SELECT *, row_number() OVER ({by}) AS r, least(t, sum(room) OVER (PARTITION BY {group})) - coalesce(sum(room) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                      sum(share) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares FROM {rows}),
    {name}_b AS (SELECT *, min(CASE WHEN rest * share / shares < room THEN r END) OVER (PARTITION BY {group}) AS m FROM {name}_a),
    {name} AS (SELECT *, CASE WHEN m IS NULL OR r < m THEN room ELSE share * max(CASE WHEN r = m THEN rest / shares END) OVER (PARTITION BY {group}) END AS given FROM {name}_b)"""


_MIXING = f"""
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS number,
                      coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::BIGINT AS n_tokens FROM documents WHERE doc_id IS NOT NULL),
    docs AS (SELECT doc_id, CASE WHEN number = '' THEN 'other' ELSE 'domain' || (number::BIGINT % 4) END AS domain, lang, source, n_tokens FROM t),
    leaf AS (SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS size FROM docs GROUP BY ALL),
    domains AS (SELECT 1 AS one, domain, 4 * sum(size) AS room, CASE domain WHEN 'domain0' THEN 4.0 WHEN 'domain1' THEN 3.0 WHEN 'domain2' THEN 2.0 ELSE 1.0 END::DOUBLE AS share,
                       (SELECT 0.5::DOUBLE * sum(size) FROM leaf) AS t FROM leaf GROUP BY domain),
    {_filled("d", "domains", "one", "domain")},
    langs AS (SELECT l.domain, l.lang, 4 * sum(l.size) AS room, CASE l.lang WHEN 'en' THEN 5.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 ELSE 1.0 END::DOUBLE AS share, any_value(d.given) AS t
              FROM leaf l JOIN d USING (domain) GROUP BY l.domain, l.lang),
    {_filled("g", "langs", "domain", "lang")},
    sources AS (SELECT l.domain, l.lang, l.source, l.size, 4 * l.size AS room, 1.0::DOUBLE AS share, g.given AS t FROM leaf l JOIN g USING (domain, lang)),
    {_filled("s", "sources", "domain, lang", "source")},
    goals AS (SELECT domain, lang, source, least(4, floor(given / size))::INT AS whole, given - least(4, floor(given / size)) * size AS rest FROM s WHERE size > 0),
    keyed AS (SELECT d.*, g.whole, g.rest, md5('7|' || g.whole || '|' || d.doc_id) AS k FROM docs d JOIN goals g USING (domain, lang, source)),
    runs AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) AS run FROM keyed),
    cuts AS (SELECT *, coalesce(min(CASE WHEN run >= rest THEN k END) OVER (PARTITION BY domain, lang, source), 'g') AS cut FROM runs)
    SELECT doc_id, domain, lang, source, unnest(range(whole))::INT AS epoch, n_tokens FROM keyed
    UNION ALL SELECT doc_id, domain, lang, source, whole, n_tokens FROM cuts WHERE whole < 4 AND rest > 1e-6 AND k <= cut"""

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": _MIXING,
    "op3_topk": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
        p AS (SELECT a.vec_id, b.vec_id AS neighbour_id, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour_id) AS rank FROM p)
        SELECT vec_id, rank::INT AS rank, neighbour_id, round(d, 6) AS distance FROM r WHERE rank <= 10""",
    "op7_ngram_join": rf"""
        WITH RECURSIVE {_GRAMS},
        points AS (SELECT row_number() OVER () AS k, g, min(doc_id) AS doc_id, len(g) AS n, count(DISTINCT doc_id) AS times FROM sets GROUP BY g),
        each AS (SELECT k, n, unnest(g) AS x FROM points),
        pairs AS (SELECT a.k AS a, b.k AS b, a.n AS na, b.n AS nb, count(*) AS i FROM each a JOIN each b ON a.x = b.x AND a.k <> b.k GROUP BY ALL),
        links AS (SELECT a, b FROM pairs WHERE i::DOUBLE / (na + nb - i)::DOUBLE >= 0.4),
        reach AS (SELECT k AS a, k AS b FROM points UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        tops AS (SELECT r.a AS k, min(p.doc_id) AS class_id FROM reach r JOIN points p ON p.k = r.b GROUP BY r.a),
        degree AS (SELECT l.a AS k, sum(p.times) AS n FROM links l JOIN points p ON p.k = l.b GROUP BY l.a)
        SELECT DISTINCT s.doc_id, t.class_id, (coalesce(d.n, 0) + p.times - 1)::BIGINT AS n_links
        FROM sets s JOIN points p ON s.g = p.g JOIN tops t ON t.k = p.k LEFT JOIN degree d ON d.k = p.k
        UNION ALL
        SELECT DISTINCT doc_id, doc_id, 0::BIGINT FROM documents
        WHERE doc_id IS NOT NULL AND NOT coalesce(regexp_matches(text, '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]'), false)""",
    "op5_substring_dedup": f"""
        WITH {_REPEATS},
        lengths AS (SELECT (50 * 2 ** i)::BIGINT AS n50 FROM range(0, 20) r(i)),
        longer AS (SELECT k, a, z, n50, md5(array_to_string(w[s + 1:s + n50], ' ')) AS h FROM stretches JOIN known USING (k), lengths, unnest(range(a, z - n50 + 1)) u(s) WHERE z - a >= n50),
        twice AS (SELECT n50, h FROM longer GROUP BY n50, h HAVING count(*) > 1),
        best AS (SELECT k, a, z, max(n50) AS longest FROM longer JOIN twice USING (n50, h) GROUP BY k, a, z)
        SELECT doc_id, 0::INT AS start_word, len(w)::INT AS end_word, len(w)::INT AS longest FROM texts JOIN known USING (w) WHERE n > 1
        UNION ALL
        SELECT doc_id, a::INT, z::INT, longest::INT FROM texts JOIN known USING (w) JOIN best USING (k) WHERE n = 1""",
    "op9_suffix_dedup": f"""
        WITH {_REPEATS}
        SELECT doc_id, 0::INT AS start_word, len(w)::INT AS end_word FROM texts JOIN known USING (w) WHERE n > 1
        UNION ALL
        SELECT doc_id, a::INT, z::INT FROM texts JOIN known USING (w) JOIN stretches USING (k) WHERE n = 1""",
    "op6_exact_dedup": """
        SELECT d.doc_id, k.keep_id FROM documents d
        JOIN (SELECT text, min(doc_id) AS keep_id, count(*) AS n FROM documents WHERE doc_id IS NOT NULL GROUP BY text) k
          ON d.text IS NOT DISTINCT FROM k.text
        WHERE d.doc_id > k.keep_id""",
}
