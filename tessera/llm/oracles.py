"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

OP6_REVISIT = r"""
WITH canon AS (
  SELECT page_id, html,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[.]', ''), '^$', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    regexp_replace(regexp_replace('&' || regexp_extract(bare, '[?](.*)$', 1), '&(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*', '', 'g'), '^&+', '') AS q
  FROM (SELECT page_id, coalesce(html, '') AS html,
          regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages)
), base AS (
  SELECT page_id, host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS key,
    page_id * 7919 % 1000000 AS ts, md5(html) AS body, md5(html || '+') AS other, strlen(html) AS n FROM canon
), visits AS (
  SELECT page_id * 4 + 1 AS id, key, ts - 50000 AS ts, body AS etag, NULL AS digest FROM base
  UNION ALL SELECT page_id * 4 + 2, key, ts + 3600 * (1 + page_id % 5), body, NULL FROM base
  UNION ALL SELECT page_id * 4 + 3, key, ts + 400000, NULL, CASE WHEN page_id % 3 = 0 THEN other ELSE body END FROM base
), found AS (
  SELECT v.id, v.key, v.ts, v.etag, v.digest, b.page_id * 4 AS ref, b.body, b.n, b.page_id IS NULL AS lost,
    row_number() OVER (PARTITION BY v.id ORDER BY b.ts DESC NULLS LAST, b.page_id DESC) AS k
  FROM visits v LEFT JOIN base b ON v.key = b.key AND (b.ts < v.ts OR (b.ts = v.ts AND b.page_id * 4 < v.id))
), judged AS (
  SELECT *, CASE WHEN lost THEN 'orphan' WHEN coalesce(etag, digest) = body THEN 'resolved' ELSE 'mismatch' END AS state
  FROM found WHERE k = 1
)
SELECT id AS capture_id, key AS canonical_url, ts, ref AS refers_to, state,
  'cache-control: max-age=600' || chr(10) || 'content-length: ' || CASE WHEN state = 'resolved' THEN n ELSE 0 END
  || CASE WHEN state = 'resolved' THEN chr(10) || 'content-type: text/html' ELSE '' END || chr(10) || 'date: ' || ts AS headers
FROM judged
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_revisit": OP6_REVISIT}
