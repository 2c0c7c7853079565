"""DuckDB SQL for the operators that SQL can express over whole tables."""

from __future__ import annotations

OP3 = """
WITH call AS (
  SELECT conv_id, 'c' || turn AS call_id, turn AS seq,
    list_extract(['search', 'lookup', 'calculate', 'browse'], (length(text) % 4)::INT + 1) AS name,
    CASE (conv_id + turn) % 10
      WHEN 0 THEN '{"query": ' || text
      WHEN 1 THEN json_object('query', text, 'limit', length(text)::VARCHAR)::VARCHAR
      WHEN 2 THEN json_object('limit', length(text))::VARCHAR
      WHEN 3 THEN json_object('query', text, 'limit', length(text), 'deep', true)::VARCHAR
      ELSE json_object('query', text, 'limit', length(text))::VARCHAR END AS arguments,
    CASE WHEN conv_id % 5 = 0 AND (turn // 2) % 2 = 0 THEN 'c' || (turn + 2)
      WHEN conv_id % 5 <> 0 THEN 'c' || (turn - 2) END AS needs
  FROM conversations WHERE role = 'assistant'),
answer AS (SELECT conv_id, 'c' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'user' AND turn > 0),
keyed AS (
  SELECT c.*, greatest(c.seq, coalesce(d.seq, c.seq)) AS place, (coalesce(d.seq, -1) > c.seq)::INT AS step,
    (c.needs IS NOT NULL AND d.seq IS NULL)::BIGINT AS missing
  FROM call c LEFT JOIN call d ON d.conv_id = c.conv_id AND d.call_id = c.needs),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place, step, call_id) - 1 AS position,
    NOT json_valid(arguments) AS malformed,
    CASE WHEN json_valid(arguments) THEN arguments END AS parsed FROM keyed),
judged AS (
  SELECT *, CASE WHEN malformed THEN 'malformed' WHEN name = 'browse' THEN 'unknown_tool' ELSE
    concat_ws(',',
      CASE WHEN json_extract(parsed, '$.query') IS NULL THEN 'missing:query' END,
      CASE WHEN json_type(parsed, '$.limit') = 'VARCHAR' THEN 'type:limit' END,
      CASE WHEN json_extract(parsed, '$.deep') IS NOT NULL THEN 'unknown:deep' END) END AS errors,
    CASE WHEN malformed THEN '{"raw":' || to_json(arguments)::VARCHAR || '}' ELSE '{' || concat_ws(',',
      CASE WHEN json_extract(parsed, '$.deep') IS NOT NULL THEN '"deep":true' END,
      '"limit":' || json_extract(parsed, '$.limit')::VARCHAR,
      '"query":' || json_extract(parsed, '$.query')::VARCHAR) || '}' END AS sorted
  FROM placed)
SELECT conv_id, call_id, j.position,
  CASE WHEN j.seq IS NULL THEN 'orphan' WHEN errors = 'malformed' THEN 'malformed' WHEN errors <> '' THEN 'invalid'
    WHEN a.content IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
  errors, coalesce(missing, 0) AS missing, (j.seq IS NOT NULL)::BIGINT AS n_calls, (a.content IS NOT NULL)::BIGINT AS n_results,
  '{' || concat_ws(',', '"arguments":' || sorted, '"id":' || to_json(call_id)::VARCHAR, '"name":' || to_json(name)::VARCHAR,
    '"result":' || to_json(content)::VARCHAR) || '}' AS record
FROM judged j FULL OUTER JOIN answer a USING (conv_id, call_id)
"""

_SHARES = """
  SELECT count(*) AS g, sum(n)::DOUBLE AS total, sum(k)::DOUBLE AS good, sum(k * k / n::DOUBLE) AS kk, sum(n * n)::DOUBLE AS nn
  FROM {0} WHERE n > 0"""
_STRENGTH = """
  SELECT (1 - rho) / rho AS s FROM (SELECT least(greatest(coalesce(CASE WHEN below > 0 THEN
      (kk - good * good / total - spread * (g - 1)) / below END, 0), 1.0 / 10001), 1 / 1.01) AS rho
    FROM (SELECT *, CASE WHEN g > 1 THEN spread * (total - nn / total - (g - 1)) ELSE 0 END AS below
      FROM (SELECT *, good / total * (1 - good / total) AS spread FROM (""" + _SHARES + """))))"""

#: Two-label suffixes and any single label, as a pattern; fixed values.
_LAST = ("ac[.]uk|co[.]uk|gov[.]uk|org[.]uk|com[.]au|net[.]au|org[.]au|co[.]nz|co[.]jp|ne[.]jp|or[.]jp|com[.]br|com[.]mx|com[.]ar|com[.]tr|com[.]cn"
         "|co[.]in|co[.]kr|co[.]za|[^.]*")

OP10 = f"""
WITH parsed AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2), '') AS path, good
  FROM (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest,
    CASE WHEN length(html) > 0 THEN ((length(html) - length(replace(html, '***', '')) + length(html) - length(replace(html, '%%%', ''))
      + length(html) - length(replace(html, '###', '')) + length(html) - length(replace(html, '$$$', ''))) / 3.0
      <= 0.05 * (length(html) - length(replace(html, ' ', '')) + 1))::INT END AS good FROM pages)),
hosts AS (
  SELECT host, count(good) AS n, coalesce(sum(good), 0) AS k, regexp_extract(host, '(?:^|[.])({_LAST})$', 1) AS suffix,
    regexp_extract(host, '(?:^|[.])((?:[^.]*[.])?(?:{_LAST}))$', 1) AS domain FROM parsed GROUP BY host),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
s1 AS ({_STRENGTH.format('suffixes')}), s2 AS ({_STRENGTH.format('domains')}), s3 AS ({_STRENGTH.format('hosts')}),
overall AS (SELECT (sum(k) + 1.0) / (sum(n) + 2.0) AS m FROM suffixes),
m1 AS (SELECT suffix, (k + s * m) / (n + s) AS m FROM suffixes, s1, overall),
m2 AS (SELECT suffix, domain, (d.k + s * m) / (d.n + s) AS m FROM domains d JOIN m1 USING (suffix), s2),
m3 AS (SELECT host, h.n, (h.k + s * m) / (h.n + s) AS m, h.n + s + 1 AS w FROM hosts h JOIN m2 USING (suffix, domain), s3),
rules(action, pattern) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'),
  ('block', 'net/es/'), ('block', 'net/fr/')),
split AS (SELECT *, split_part(pattern, '/', 1) AS name, substr(pattern, position('/' IN pattern)) AS lead FROM rules)
SELECT page_id, host, path, rule.pattern AS rule,
  coalesce(rule.action, CASE WHEN m - 1.645 * sqrt(m * (1 - m) / w) >= 0.8 THEN 'allow' ELSE 'block' END) AS verdict, n AS n_labelled
FROM (SELECT *, (SELECT max_by({{'pattern': pattern, 'action': action}}, length(pattern)) FROM split
    WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, lead)) AS rule FROM parsed) JOIN m3 USING (host)
"""

ORACLES = {"op3_tool_calls": OP3, "op10_url_reputation": OP10}
