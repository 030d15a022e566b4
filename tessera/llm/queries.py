"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontaminate import leaks
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.language_id import identify
from tessera.llm.license_scan import scan
from tessera.llm.mixture import rates
from tessera.llm.near_dedup import near_dedup
from tessera.llm.quality import sample
from tessera.llm.quote_threads import threads
from tessera.llm.substring_dedup import substring_dedup
from tessera.llm.token_output import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("hits")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op5_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads(table(spark, sf_dir, "conversations"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(table(spark, sf_dir, "documents")).selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), threshold=0.85, n=3)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(
        table(spark, sf_dir, "documents"),
        table(spark, sf_dir, "labels"),
    ).selectExpr("id AS doc_id", "n_grams", "log_weight", "key", "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_license_scan,
        op2_exact_dedup,
        op3_substring_dedup,
        op4_token_output,
        op5_quote_threads,
        op6_decontamination,
        op7_mixture,
        op8_near_dedup,
        op9_language_id,
        op10_quality,
        pipeline,
    )
    return {f.__name__: f for f in named}


OP2 = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP5 = r"""
WITH RECURSIVE messages AS (
  SELECT conv_id, turn, row_number() OVER () AS message, string_split(text, chr(10)) AS lines FROM conversations
),
lines AS (
  SELECT conv_id, turn, message, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM messages
),
parsed AS (
  SELECT conv_id, turn, message, pos,
         length(regexp_replace(regexp_extract(line, '^[ \t]*((>[ \t]?)*)', 1), '[ \t]', '', 'g')) AS level,
         trim(regexp_replace(lower(regexp_replace(line, '^[ \t]*((>[ \t]?)*)', '')), '[ \t\r]+', ' ', 'g')) AS content,
         regexp_matches(line, '^(On|Le|Am|El) .* (wrote|écrit|schrieb|escribió) ?:[ \t\r]*$') AS said
  FROM lines
),
placed AS (
  SELECT *, pos - row_number() OVER (PARTITION BY message, level ORDER BY pos) AS run
  FROM parsed WHERE content <> '' AND NOT said
),
used AS (
  SELECT conv_id, turn, level, content FROM placed
  UNION ALL
  SELECT conv_id, turn, level, string_agg(content, ' ' ORDER BY pos) FROM placed
  GROUP BY conv_id, turn, message, level, run HAVING count(*) > 1
),
originals AS (SELECT conv_id, content, min(turn) AS original FROM used WHERE level = 0 GROUP BY ALL),
votes AS (
  SELECT u.conv_id, u.turn, u.level, o.original, count(*) AS n
  FROM used u JOIN originals o USING (conv_id, content)
  WHERE u.level > 0 AND o.original < u.turn GROUP BY ALL
),
best AS (
  SELECT conv_id, turn, original FROM votes
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, original DESC) = 1
),
places AS (SELECT DISTINCT conv_id, turn FROM conversations),
links AS (
  SELECT p.conv_id, p.turn, coalesce(b.original, q.turn) AS parent_turn, b.original IS NOT NULL AS by_quote
  FROM places p LEFT JOIN best b USING (conv_id, turn)
  LEFT JOIN places q ON q.conv_id = p.conv_id AND q.turn = p.turn - 1
),
reached AS (
  SELECT conv_id, turn, turn AS root_turn, 0::BIGINT AS depth, [turn] AS path FROM links WHERE parent_turn IS NULL
  UNION ALL
  SELECT l.conv_id, l.turn, r.root_turn, r.depth + 1, list_append(r.path, l.turn)
  FROM links l JOIN reached r ON l.conv_id = r.conv_id AND l.parent_turn = r.turn
),
walked AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS position FROM reached),
bodies AS (
  SELECT conv_id, turn, role,
         regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^[ \t]*>')
           AND NOT regexp_matches(x, '^(On|Le|Am|El) .* (wrote|écrit|schrieb|escribió) ?:[ \t\r]*$')), chr(10)), '^\s+|\s+$', '', 'g') AS body,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[ \t]*>')))::BIGINT AS n_quoted,
         list_max(list_transform(string_split(text, chr(10)), lambda x: length(regexp_replace(regexp_extract(x, '^[ \t]*((>[ \t]?)*)', 1), '[ \t]', '', 'g'))))::BIGINT AS quote_depth
  FROM conversations
)
SELECT b.*, l.parent_turn, l.by_quote, r.root_turn, r.depth, w.position, '<|' || b.role || '|>' || chr(10) || b.body AS formatted
FROM bodies b JOIN links l USING (conv_id, turn) JOIN reached r USING (conv_id, turn) JOIN walked w USING (conv_id, turn)
"""

OP7 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3) + 1]::BIGINT AS weight FROM sources
),
filling AS (
  SELECT *, sum(source_size) OVER ()::BIGINT * 1.5::DOUBLE
            - coalesce(sum(source_size) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 2 AS rest,
         sum(weight) OVER (fill ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weight_left
  FROM weighed WINDOW fill AS (ORDER BY source_size::DOUBLE / weight, source COLLATE "C" NULLS LAST)
),
marked AS (SELECT *, (source_size * 2)::DOUBLE * weight_left <= weight * rest AS is_full FROM filling),
levels AS (
  SELECT rest, weight_left FROM marked WHERE NOT is_full
  ORDER BY source_size::DOUBLE / weight, source COLLATE "C" NULLS LAST LIMIT 1
),
targets AS (
  SELECT m.source, m.source_size,
         CASE WHEN m.is_full OR l.rest IS NULL THEN (m.source_size * 2)::DOUBLE
              ELSE least((m.source_size * 2)::DOUBLE, m.weight * l.rest / l.weight_left) END AS target
  FROM marked m LEFT JOIN levels l ON true
),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('7:' || coalesce(s.doc_id::VARCHAR, 'null') || ':' || s.text), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM rated
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2, "op5_quote_threads": OP5, "op7_mixture": OP7}
