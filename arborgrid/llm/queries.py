"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import op8_decontaminate
from .html_text import op2_html_text
from .line_dedup import op4_line_dedup
from .lm_scoring import op6_lm_scoring
from .mixing import op1_mixing
from .ngram_join import op5_ngram_join
from .quality import op3_quality
from .sharding import op9_sharding
from .token_counts import op10_token_counts
from .warc import op7_warc


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1's result that follow from the table without the sampling keys."""
    return op1_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's counts and base rules, without the fitted score."""
    return op3_quality(spark, sf_dir).drop("score", "kept")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6's counts and base score, without the model's score."""
    return op6_lm_scoring(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 6))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_html_text": op2_html_text,
    "op3_quality": op3_quality,
    "op4_line_dedup": op4_line_dedup,
    "op5_ngram_join": op5_ngram_join,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_warc": op7_warc,
    "op8_decontaminate": op8_decontaminate,
    "op9_sharding": op9_sharding,
    "op10_token_counts": op10_token_counts,
    "mixing_targets": mixing_targets,
    "quality_counts": quality_counts,
    "lm_base": lm_base,
}

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(coalesce(text, ''), '{_WORD}')"
_WORDS_LOWER = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}')"
#: crc32 of a text of ASCII characters: each byte is taken up, then shifted out bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(doc_id::VARCHAR, '')])), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END), 4294967295::BIGINT)"

ORACLES = {
    "mixing_targets": f"""WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents),
 s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM d GROUP BY source),
 r AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
 o AS (SELECT *, cap / weight AS fill, coalesce(sum(cap) OVER w, 0) AS cap_before, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weight_left FROM r WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 l AS (SELECT *, (total - cap_before) / weight_left AS level FROM o), m AS (SELECT coalesce(arg_min(level, fill) FILTER (level <= fill), 'infinity'::DOUBLE) AS level FROM l)
 SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, least(cap, m.level * weight) AS target FROM d JOIN l ON l.source IS NOT DISTINCT FROM d.source, m""",
    "quality_counts": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
 g AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM d, range(1, len(w) - 1) t(i)),
 twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
 n AS (SELECT r, count(DISTINCT i + k) AS covered FROM twice, range(3) o(k) GROUP BY r),
 f AS (SELECT d.*, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
 q AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(covered, 0) AS n_repeat_words FROM f LEFT JOIN n USING (r))
 SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q""",
    "op5_ngram_join": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS_LOWER} AS w FROM documents),
 g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] END AS gram FROM d, range(1, greatest(len(w) - 3, 1) + 1) t(i) WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
 pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
 half AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
 link AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
 reach(a, b) AS (SELECT a, a FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
 least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_of ON least_of.a = d.doc_id""",
    "lm_base": f"""WITH d AS (SELECT doc_id, {_CRC} % 5 = 1 AS held_out, list_append({_WORDS_LOWER}, ' ') AS t FROM documents),
 w AS (SELECT doc_id, held_out, unnest(t) AS token FROM d), c AS (SELECT token, count(*) AS c FROM w WHERE NOT held_out GROUP BY token),
 s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
 SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 6) AS base_score
 FROM w LEFT JOIN c USING (token), s GROUP BY doc_id, held_out""",
    "op7_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), s AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
 o AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS original FROM s)
 SELECT page_id, payload_bytes, payload_digest, CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN original <> page_id THEN original END AS refers_to FROM o""",
}
