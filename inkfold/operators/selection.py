"""Selection, planning, usage and text operators."""

from __future__ import annotations

from inkfold.functions import expressions as E
from inkfold.operators.template import Operator

# The model of least description length among those within the error bound: fit error against number of parameters.
best_model = Operator(f"""
WITH scored AS (SELECT *, 10 * ln(1e0 + rms) + 0.5e0 * params * ln(20e0) AS score FROM {{model_errors}} WHERE worst <= 2.5),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ring_id, interval_id ORDER BY floor(score * 1000000), params) AS k FROM scored)
SELECT ring_id, interval_id, model, {E.rounded('score')} AS score, {E.rounded('rms')} AS rms_error, {E.rounded('worst')} AS max_error FROM ranked WHERE k = 1""")

# Trials of a case that no other trial beats in error, nodes and editability at once.
pareto_frontier = Operator("""
SELECT g.case_id, g.trial, g.error, g.nodes, g.editability FROM {trials} g
WHERE NOT EXISTS (
  SELECT 1 FROM {trials} o WHERE o.case_id = g.case_id AND o.error <= g.error AND o.nodes <= g.nodes AND o.editability >= g.editability
    AND (o.error < g.error OR o.nodes < g.nodes OR o.editability > g.editability))""")

plan_progress = Operator("""
SELECT plan_id, count(*) AS total, CAST(sum(CASE WHEN status = 'COMPLETED' THEN 1 ELSE 0 END) AS BIGINT) AS completed, CAST(sum(CASE WHEN status = 'WAITING_CONFIRMATION' THEN 1 ELSE 0 END) AS BIGINT) AS waiting,
       CAST(sum(CASE WHEN classification IN ('MANUAL', 'INFORMATIONAL') AND status <> 'COMPLETED' THEN 1 ELSE 0 END) AS BIGINT) AS manual, CAST(sum(CASE WHEN status = 'BLOCKED' THEN 1 ELSE 0 END) AS BIGINT) AS blocked,
       CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(sum(CASE WHEN status = 'SKIPPED' THEN 1 ELSE 0 END) AS BIGINT) AS skipped,
       CASE WHEN max(CASE WHEN status = 'FAILED' OR (classification = 'MANUAL' AND severity = 'error' AND status <> 'COMPLETED') THEN 1 ELSE 0 END) = 1 THEN 'BLOCKED'
            WHEN min(CASE WHEN status = 'COMPLETED' THEN 1 ELSE 0 END) = 1 THEN 'READY_FOR_PRODUCTION' WHEN max(CASE WHEN status = 'WAITING_CONFIRMATION' THEN 1 ELSE 0 END) = 1 THEN 'AWAITING_CONFIRMATION'
            WHEN max(CASE WHEN status = 'BLOCKED' THEN 1 ELSE 0 END) = 1 THEN 'BLOCKED' ELSE 'PARTIALLY_EXECUTED' END AS state
FROM {steps} GROUP BY plan_id""")

receipts_pending = Operator("""
SELECT s.plan_id, s.step_id, s.status FROM {steps} s
WHERE NOT EXISTS (SELECT 1 FROM {steps} r WHERE r.plan_id = s.plan_id AND r.step_id = s.step_id AND r.status IN ('COMPLETED', 'SKIPPED'))""")

telemetry_summary = Operator(f"""
SELECT provider_id, organization_id, count(*) AS requests, CAST(sum(CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END) AS BIGINT) AS successful, CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
       CAST(sum(CASE WHEN status = 'CACHED' THEN 1 ELSE 0 END) AS BIGINT) AS cached, CAST(sum(credits_calculated) AS BIGINT) AS credits_calculated, CAST(sum(credits_charged) AS BIGINT) AS credits_charged,
       {E.whole('CAST(sum(duration_ms) AS DOUBLE) / count(*) + 0.5')} AS average_latency_ms
FROM {{telemetry}} GROUP BY provider_id, organization_id""")

telemetry_rollup = Operator("""
SELECT provider_id, organization_id, count(*) AS requests, CAST(sum(credits_charged) AS BIGINT) AS credits_charged, max(duration_ms) AS slowest FROM {telemetry} GROUP BY ROLLUP (provider_id, organization_id)""")

telemetry_hourly = Operator("""
SELECT date_trunc('hour', ts) AS hour, provider_id, count(*) AS requests, CAST(sum(credits_charged) AS BIGINT) AS credits_charged FROM {telemetry} GROUP BY date_trunc('hour', ts), provider_id""")

cache_dedup = Operator("""
WITH ranked AS (SELECT sha, event_id, row_number() OVER (PARTITION BY sha ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY sha) AS n FROM {telemetry})
SELECT sha, event_id AS first_event, n AS requests, n - 1 AS hits FROM ranked WHERE k = 1""")

history_cap = Operator("""
WITH ranked AS (SELECT organization_id, event_id, row_number() OVER (PARTITION BY organization_id ORDER BY ts DESC, event_id DESC) AS k FROM {telemetry})
SELECT organization_id, event_id, CAST(k AS BIGINT) AS age FROM ranked WHERE k <= 50""")

unit_parse = Operator(f"""
WITH said AS (
  SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR(10)) || ' cm' WHEN 1 THEN CAST(p_size AS VARCHAR(10)) || ',5mm' WHEN 2 THEN 'about ' || CAST(p_size AS VARCHAR(10)) || '.25 centimetros' WHEN 3 THEN 'no size' ELSE CAST(p_size AS VARCHAR(10)) END AS said FROM {{part}}
),
parts AS (SELECT p_partkey, said, regexp_extract(lower(said), '([0-9]+([.,][0-9]+)?)', 1) AS num, regexp_extract(lower(said), '[0-9] *(cm|cent[a-z]*|mm|mil[a-z]*)', 1) AS unit FROM said)
SELECT p_partkey, said, CASE WHEN num = '' OR num IS NULL THEN NULL ELSE {E.rounded("CAST(replace(num, ',', '.') AS DOUBLE) * CASE WHEN unit LIKE 'c%' THEN 10 ELSE 1 END", 2)} END AS mm FROM parts""")

color_parse = Operator("""
WITH said AS (
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '#' || lpad(CAST(p_partkey % 1000 AS VARCHAR(10)), 6, 'c') WHEN 1 THEN 'rgb(' || CAST(p_size AS VARCHAR(10)) || ', 20, 30)' WHEN 2 THEN 'cmyk(' || CAST(p_size AS VARCHAR(10)) || ', 0, 0, 10)' ELSE 'Pantone ' || CAST(p_partkey % 900 AS VARCHAR(10)) || ' C' END AS said FROM {part}
)
SELECT p_partkey, said, CASE WHEN said LIKE '#%' THEN 'HEX' WHEN said LIKE 'rgb(%' THEN 'RGB' WHEN said LIKE 'cmyk(%' THEN 'CMYK' WHEN lower(said) LIKE 'pantone%' THEN 'PANTONE' ELSE 'UNKNOWN' END AS format,
       CASE WHEN said LIKE '#%' THEN lower(substr(said, 2)) WHEN said LIKE '%(%' THEN regexp_extract(said, '[(]([0-9]+)', 1) ELSE regexp_extract(said, '([0-9]+)', 1) END AS value
FROM said""")

sensitivity_matrix = Operator(f"""
WITH colours AS (SELECT image_id, r, g, b, count(*) AS n FROM {{pixels}} GROUP BY image_id, r, g, b),
trials AS (
  SELECT image_id, t.tolerance, floor(r / t.tolerance) AS qr, floor(g / t.tolerance) AS qg, floor(b / t.tolerance) AS qb, CAST(sum(n) AS BIGINT) AS n
  FROM colours JOIN (SELECT 8 AS tolerance UNION ALL SELECT 16 UNION ALL SELECT 32 UNION ALL SELECT 64) t ON true GROUP BY image_id, t.tolerance, floor(r / t.tolerance), floor(g / t.tolerance), floor(b / t.tolerance)
)
SELECT image_id, CAST(sum(CASE WHEN tolerance = 8 THEN 1 ELSE 0 END) AS BIGINT) AS t8, CAST(sum(CASE WHEN tolerance = 16 THEN 1 ELSE 0 END) AS BIGINT) AS t16, CAST(sum(CASE WHEN tolerance = 32 THEN 1 ELSE 0 END) AS BIGINT) AS t32,
       CAST(sum(CASE WHEN tolerance = 64 THEN 1 ELSE 0 END) AS BIGINT) AS t64, {E.rounded('CAST(max(n) AS DOUBLE) / sum(n)')} AS largest_share FROM trials GROUP BY image_id""")

# Every node of a document in order of its id; a change to any of them changes the digest.
fingerprints = Operator("""
SELECT doc_id, sha2(listagg(part, '|') WITHIN GROUP (ORDER BY node_id), 256) AS fingerprint, count(*) AS nodes FROM (
  SELECT doc_id, node_id, concat_ws(':', CAST(node_id AS VARCHAR(20)), type, CAST(CAST(floor(x_mm * 100 + 0.5) AS BIGINT) AS VARCHAR(20)), CAST(CAST(floor(y_mm * 100 + 0.5) AS BIGINT) AS VARCHAR(20)),
         CAST(CAST(floor(w_mm * 100 + 0.5) AS BIGINT) AS VARCHAR(20)), CAST(CAST(floor(h_mm * 100 + 0.5) AS BIGINT) AS VARCHAR(20)), CASE WHEN visible THEN 'shown' ELSE 'hidden' END, coalesce(fill, 'none')) AS part FROM {nodes}) q
GROUP BY doc_id""")

slug_names = Operator("""
SELECT p_partkey, trim(BOTH '-' FROM regexp_replace(lower(p_name), '[^a-z0-9]+', '-' /*g*/)) AS slug, sha2(p_name, 256) AS cache_key FROM {part}""")
