"""DuckDB statements that give the same rows as the pN_ queries of the same name."""

from __future__ import annotations

_LATEST = """
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC) AS rn FROM roi_candidates WHERE row_id IS NOT NULL)
  WHERE rn = 1)"""

P1_FOUND = f"""
WITH {_LATEST},
valid AS (
  SELECT regexp_replace(lower(trim(class_key)), '[\\s-]+', '_', 'g') AS class_key, cluster_id FROM latest),
have AS (SELECT class_key, cluster_id, count(*) AS n FROM valid GROUP BY ALL),
wish AS (
  SELECT t.class_key, t.cluster_id, t.target_share, t.min_rows, coalesce(h.n, 0) AS n
  FROM sample_targets t LEFT JOIN have h ON h.class_key = t.class_key AND h.cluster_id = t.cluster_id)
SELECT class_key, cluster_id FROM wish
WHERE n < coalesce(target_share * CAST(0.2 AS DOUBLE) * (SELECT sum(n) FROM wish), 0) OR n < min_rows
"""

P1_QUOTAS = f"""
WITH {_LATEST},
valid AS (
  SELECT regexp_replace(lower(trim(class_key)), '[\\s-]+', '_', 'g') AS class_key, cluster_id FROM latest),
have AS (SELECT class_key, cluster_id, count(*) AS n FROM valid GROUP BY ALL),
cats AS (
  SELECT t.class_key, t.cluster_id, max(coalesce(t.target_share, 0)) AS share, max(coalesce(t.min_rows, 0)) AS least, max(coalesce(h.n, 0)) AS n
  FROM sample_targets t LEFT JOIN have h ON h.class_key = t.class_key AND h.cluster_id = t.cluster_id GROUP BY ALL),
size AS (SELECT CAST(0.2 AS DOUBLE) * sum(n) AS size FROM cats),
want AS (SELECT class_key, cluster_id, n, least, share * size AS s, size FROM cats, size),
points AS (SELECT 0.0::DOUBLE AS x UNION SELECT least / s FROM want WHERE s > 0 UNION SELECT n / s FROM want WHERE s > 0),
filled AS (SELECT x, sum(least(n, greatest(least, x * s))) AS y, any_value(size) AS size FROM points, want GROUP BY x),
low AS (SELECT max(x) AS x, max(y) AS y FROM filled WHERE y <= size),
high AS (SELECT min(x) AS x, min(y) AS y FROM filled WHERE y > size),
level AS (SELECT coalesce(low.x + (size - low.y) / (high.y - low.y) * (high.x - low.x), low.x, 0) AS level FROM low, high, size)
SELECT class_key, cluster_id, CAST(n AS BIGINT) AS available, round(greatest(s, least), 6) AS wanted, round(least(n, greatest(least, level * s)), 6) AS allotted
FROM want, level
"""

_P3 = f"""
WITH {_LATEST},
valid AS (
  SELECT row_id, cluster_id, cell_key,
    regexp_replace(replace(lower(regexp_replace(image_id, '^\\s+|\\s+$', '', 'g')), '-', '_'), '\\.(png|jpe?g|bmp|tiff?|gif|webp)$', '') AS image,
    CASE WHEN quality_score IS NULL THEN 1.0::DOUBLE WHEN isnan(quality_score) THEN 0.0::DOUBLE ELSE quality_score END AS quality
  FROM latest),
one AS (SELECT *, row_number() OVER (PARTITION BY image, cluster_id, cell_key ORDER BY quality DESC, row_id) AS r1 FROM valid),
two AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY quality DESC, row_id) AS r2 FROM one WHERE r1 <= 3)
"""

P3_FOUND = _P3 + "SELECT row_id FROM one WHERE row_id NOT IN (SELECT row_id FROM two WHERE r2 <= 25)"
P3_KEPT = _P3 + "SELECT row_id, image, cluster_id, cell_key, quality FROM two WHERE r2 <= 25"

_P4 = """
WITH item AS (SELECT roi_idx, unnest(cand) AS x FROM clean_bg_selected),
best AS (
  SELECT roi_idx, x.normal_id AS normal_id, max(x.score) AS score FROM item
  WHERE roi_idx IS NOT NULL AND x.normal_id IS NOT NULL AND x.score IS NOT NULL AND NOT isnan(x.score) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY roi_idx ORDER BY score DESC, normal_id) AS rank FROM best)
"""
P4_FOUND = _P4 + "SELECT roi_idx, normal_id FROM ranked WHERE rank <= 5"
P4_TOP = _P4 + "SELECT roi_idx, normal_id, score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5"

_NUM = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"
_CELL = lambda c: f"CASE WHEN regexp_matches(trim({c}), '{_NUM}') AND isfinite(TRY_CAST(trim({c}) AS DOUBLE)) THEN TRY_CAST(trim({c}) AS DOUBLE) END"
P2_IMAGES = f"""
WITH cells AS (
  SELECT image_id, patch_xy,
    CASE WHEN lower(trim(image_type)) IN ('good', 'ok', 'normal', 'pass') THEN 0
         WHEN lower(trim(image_type)) IN ('defect', 'ng', 'bad', 'anomaly', 'fail') THEN 1 ELSE 2 END AS kind,
    {_CELL("local_variance")} AS v, {_CELL("texture_entropy")} AS e
  FROM context_features),
patch AS (
  SELECT image_id, patch_xy, max(kind) AS kind,
    max(CASE WHEN v >= 0 THEN v END) AS local_variance, max(CASE WHEN e >= 0 AND e <= 3.3219281 + 1e-4 THEN e END) AS texture_entropy
  FROM cells GROUP BY image_id, patch_xy),
long AS (
  SELECT ['good', 'defect', 'unknown'][kind + 1] AS image_kind, image_id, 'local_variance' AS metric, local_variance AS x FROM patch WHERE local_variance IS NOT NULL
  UNION ALL
  SELECT ['good', 'defect', 'unknown'][kind + 1], image_id, 'texture_entropy', texture_entropy FROM patch WHERE texture_entropy IS NOT NULL),
lists AS (SELECT image_kind, image_id, metric, count(*) AS n, list_sort(list(x)) AS xs FROM long GROUP BY ALL HAVING count(*) <= 512)
SELECT image_kind, image_id, metric, n, p, xs[greatest(1, CAST(ceil(p * n) AS BIGINT))] AS value
FROM lists CROSS JOIN (SELECT CAST(unnest([0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]) AS DOUBLE) AS p)
"""

P7_DECODED = "SELECT doc_id, coalesce(text, '') AS text FROM documents"

ORACLE: dict[str, str] = {"p7_decoded": P7_DECODED, "p1_quotas": P1_QUOTAS, "p2_images": P2_IMAGES, "p1_found": P1_FOUND, "p3_found": P3_FOUND, "p3_kept": P3_KEPT, "p4_found": P4_FOUND, "p4_top": P4_TOP}
