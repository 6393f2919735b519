"""Registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from . import (
    bpe, collocations, embedding_dedup, fingerprints, jaccard_join, line_dedup, lm_score, mixing, quality, secrets, spelling,
    suffix_dedup, wrappers,
)

Query = Callable[[SparkSession, str], DataFrame]


def over(table: str, run: Callable[[SparkSession, DataFrame], DataFrame]) -> Query:
    """A query that applies an operator to one whole table."""
    return lambda spark, sf_dir: run(tune(spark), spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def op2_quality_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality.digest(spark, docs, labels)


OP1_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key),
flags AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(o.owner <> k.doc_id, false) AS gone
  FROM keyed k LEFT JOIN owners o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flags GROUP BY doc_id
"""

OP8_SQL = """
WITH sizes AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS chars FROM documents GROUP BY source),
means AS (
  SELECT source, CASE WHEN chars > 0 THEN sqrt(chars) / sum(sqrt(chars)) OVER () * sum(chars) OVER () / chars ELSE 0 END AS mean
  FROM sizes),
terms AS (SELECT source, mean, unnest(range(0, CAST(floor(mean + sqrt(mean) * 12 + 25) AS BIGINT) + 1)) AS k FROM means),
probs AS (SELECT source, mean, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS p FROM terms WHERE mean > 0),
cdf AS (SELECT source, mean, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS below FROM probs),
draws AS (
  SELECT *, CAST(CAST('0x' || substr(md5('mix-1|' || doc_id || '|1'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u
  FROM documents),
drawn AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, any_value(c.mean) AS mean, count(*) FILTER (c.below <= d.u) AS copies
  FROM draws d JOIN cdf c ON d.source = c.source GROUP BY ALL),
rows AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM drawn WHERE copies > 0)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, round(mean, 6) AS mean,
  CAST(CAST('0x' || substr(md5('mix-1|order|' || doc_id || '|' || copy), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS position
FROM rows
"""


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
runs AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
  FROM worded, range(1, 6) AS sizes(m) WHERE len(w) >= m),
often AS (SELECT lang, m, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
phrases AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM often WHERE m > 1),
halves AS (
  SELECT lang, m, phrase, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : m], ' ') AS tail
  FROM phrases, range(1, 5) AS cuts(k) WHERE k < m),
scored AS (
  SELECT h.lang, h.phrase, h.a, h.k, x.f AS l, y.f AS r, t.n,
         CAST(CAST(1000 AS HUGEINT) * h.a * t.n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM halves h JOIN often x ON x.lang = h.lang AND x.phrase = h.head
  JOIN often y ON y.lang = h.lang AND y.phrase = h.tail JOIN totals t ON t.lang = h.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_runs AS (
  SELECT lang, a, unnest(list_transform(range(1, m - s + 2), lambda i: array_to_string(w[i : i + s - 1], ' '))) AS phrase
  FROM phrases, range(2, 5) AS sizes(s) WHERE s < m),
longer AS (SELECT lang, phrase, max(a) AS f FROM inner_runs GROUP BY ALL),
kept AS (
  SELECT c.* FROM lowest c LEFT JOIN longer o ON o.lang = c.lang AND o.phrase = c.phrase
  WHERE o.f IS NULL OR 100 * o.f < 100 * c.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": over("documents", line_dedup.digest),
        "op2_quality_sample": op2_quality_sample,
        "op3_embedding_dedup": over("embeddings", embedding_dedup.digest),
        "op4_jaccard_join": over("documents", jaccard_join.digest),
        "op5_fingerprints": over("documents", fingerprints.digest),
        "op6_bpe": over("documents", bpe.digest),
        "op7_secret_scan": over("documents", secrets.digest),
        "op8_mix_sources": over("documents", mixing.digest),
        "op9_lm_score": over("documents", lm_score.digest),
        "op10_suffix_dedup": over("documents", suffix_dedup.digest),
        "op11_main_text": over("pages", wrappers.digest),
        "op12_collocations": over("documents", collocations.digest),
        "op13_spelling_variants": over("documents", spelling.digest),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op8_mix_sources": OP8_SQL, "op12_collocations": OP12_SQL}
