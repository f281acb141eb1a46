"""SQL for DuckDB of the queries that it can express; the others need XXH64, Arrow code or a trained model."""

OP3 = r"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_window AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, list_slice(w, k, k + least(len(w), 13) - 1) AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT size FROM item_window),
doc_window AS (
  SELECT rid, k, size, list_slice(w, k, k + size - 1) AS words
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM doc, size WHERE len(w) >= size)),
hit AS (SELECT d.rid, d.k, d.size, i.item_id FROM doc_window d JOIN item_window i ON d.size = i.size AND d.words = i.words),
hit_words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + size)) AS p FROM hit) GROUP BY rid),
hit_items AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""

OP5 = r"""
WITH doc AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight
  FROM doc GROUP BY source),
level AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER w, 0) AS DOUBLE)
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
  FROM per
  WINDOW w AS (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size, CASE WHEN 3 * source_size < weight * level THEN CAST(3 * source_size AS DOUBLE)
    ELSE weight * max(CASE WHEN 3 * source_size >= weight * level THEN level END) OVER () END AS target
  FROM level),
placed AS (
  SELECT doc_id, doc.source, size, source_size, target,
    CASE WHEN source_size > 0 THEN CAST(floor(target * 4294967296.0 / source_size) AS BIGINT) ELSE 4294967296 END AS expected,
    length(bin(size)) AS bin,
    CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
      % greatest(1, CAST(ceil(count(*) OVER (PARTITION BY doc.source, length(bin(size))) / 1000000) AS BIGINT)) AS slice,
    CAST('0x' || substr(md5('mix|' || coalesce(doc.source, '')), 1, 8) AS BIGINT) AS start
  FROM doc JOIN goal ON doc.source IS NOT DISTINCT FROM goal.source),
summed AS (
  SELECT *, start + sum(expected) OVER (
    PARTITION BY source ORDER BY bin, slice, size, doc_id ASC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total
  FROM placed)
SELECT doc_id, size, source_size, target,
  CAST(size * (total // 4294967296 - (total - expected) // 4294967296) AS BIGINT) AS taken
FROM summed
"""

OP7 = r"""
WITH page AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
    list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '*' ELSE s END) AS first
  FROM page),
labelled AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS by_rule FROM ruled),
counted AS (
  SELECT host, first, count(*) AS n, count(by_rule) AS l, count(*) FILTER (by_rule = 'block') AS b FROM labelled GROUP BY host, first),
part AS (SELECT host, first, n, k, first[k] AS s FROM (SELECT *, unnest(range(1, len(first) + 1)) AS k FROM counted)),
support AS (SELECT host, k, s, sum(n) AS seen FROM part GROUP BY ALL),
grown AS (
  SELECT host, first, list(CASE WHEN seen < 5 THEN '*' ELSE s END ORDER BY k) AS grown
  FROM part JOIN support USING (host, k, s) GROUP BY host, first),
tree AS (
  SELECT c.host, c.first, l, b, coalesce(grown, []) AS grown,
    list_max(list_transform(range(1, len(coalesce(grown, [])) + 1), lambda i: CASE WHEN grown[i] <> '*' THEN i ELSE 0 END)) AS last
  FROM counted c LEFT JOIN grown g ON c.host = g.host AND c.first = g.first),
branch AS (
  SELECT host, grown, list_transform(range(1, len(grown) + 1), lambda i: CASE WHEN i = last THEN '*' ELSE grown[i] END) AS parent, sum(l) AS l, sum(b) AS b
  FROM tree GROUP BY host, grown, last),
rated AS (SELECT *, (sum(b) OVER w + 1) / (sum(l) OVER w + 2) AS rate FROM branch WINDOW w AS (PARTITION BY host, parent)),
merged AS (
  SELECT host, grown, l, b, CASE WHEN l > 0 AND abs(b / l - rate) <= 1.96 * sqrt(rate * (1 - rate) / l) THEN parent ELSE grown END AS template
  FROM rated),
prior AS (SELECT (sum(b) + 1) / (sum(l) + 2) AS prior FROM merged),
judged AS (
  SELECT host, template, sum(l) > 0 AND (sum(b) + 2.0 * any_value(prior)) / (sum(l) + 2.0) >= 0.5 AS rejected
  FROM merged, prior GROUP BY host, template)
SELECT page_id, p.host, path, rule, coalesce(by_rule, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict
FROM labelled p JOIN tree t ON p.host = t.host AND p.first = t.first
JOIN merged m ON t.host = m.host AND t.grown = m.grown
JOIN judged j ON m.host = j.host AND m.template = j.template
"""

OP11 = r"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text, crc32 % 2 = 0 AS even,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head
  FROM (
    SELECT *, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
        lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda h, x: CASE WHEN x >= 0 THEN xor(h, x) WHEN h % 2 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END), 4294967295) AS crc32
    FROM documents)),
hashed AS (
  SELECT rid, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(got) || ':' || got, '-')) AS received
  FROM (SELECT *, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS got FROM doc)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id ASC NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM hashed),
node(tree, lvl, pos, n, digest) AS (
  SELECT source, 0, pos, n, leaf FROM ranked
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY tree, lvl, pos // 3, n),
subroot AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree ASC NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
upper(lvl, pos, n, digest) AS (
  SELECT 0, pos, n, digest FROM subroot
  UNION ALL
  SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY lvl, pos // 3, n),
step AS (
  SELECT a.tree, a.lvl, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS prior,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS later
  FROM node a JOIN node b ON a.tree IS NOT DISTINCT FROM b.tree AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3
  WHERE a.n > 1 GROUP BY a.tree, a.lvl, a.pos),
upper_step AS (
  SELECT a.lvl, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS prior,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS later
  FROM upper a JOIN upper b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.lvl, a.pos),
folded(rid, tree, lvl, pos, digest, proof) AS (
  SELECT rid, source, 0, pos, received, '' FROM ranked
  UNION ALL
  SELECT f.rid, f.tree, f.lvl + 1, f.pos // 3, sha256(prior || f.digest || later), f.proof || prior || later
  FROM folded f JOIN step s ON f.tree IS NOT DISTINCT FROM s.tree AND f.lvl = s.lvl AND f.pos = s.pos),
at_subroot AS (
  SELECT f.rid, s.pos, f.digest, f.proof FROM folded f JOIN node n ON f.tree IS NOT DISTINCT FROM n.tree AND f.lvl = n.lvl AND n.n = 1
  JOIN subroot s ON s.tree IS NOT DISTINCT FROM f.tree),
finished(rid, lvl, pos, digest, proof) AS (
  SELECT rid, 0, pos, digest, proof FROM at_subroot
  UNION ALL
  SELECT f.rid, f.lvl + 1, f.pos // 3, sha256(prior || f.digest || later), f.proof || prior || later
  FROM finished f JOIN upper_step s ON f.lvl = s.lvl AND f.pos = s.pos)
SELECT r.doc_id, r.leaf, s.digest AS subroot, u.digest AS root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root, f.digest = u.digest AS verified
FROM ranked r JOIN subroot s ON s.tree IS NOT DISTINCT FROM r.source JOIN finished f ON f.rid = r.rid JOIN upper u ON u.n = 1 AND u.lvl = f.lvl
"""

OP13 = r"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS text FROM documents),
pattern(kind, p) AS (VALUES
  (0, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'AKIA[A-Z0-9]+'), (2, '[0-9a-f]{16,}'), (3, '[A-Za-z0-9+_-]{12,}')),
hits AS (
  SELECT rid, doc_id, owner, kind, p, regexp_extract_all(text, p) AS vals, list_transform(string_split_regex(text, p), lambda x: length(x)) AS gaps FROM doc, pattern),
each AS (SELECT rid, doc_id, owner, kind, p, i, vals[i] AS val, gaps[i] AS gap FROM (SELECT *, unnest(range(1, len(vals) + 1)) AS i FROM hits)),
placed AS (
  SELECT *, CAST(sum(gap + length(val)) OVER (PARTITION BY rid, kind ORDER BY i) AS BIGINT) AS stop FROM each),
span AS (
  SELECT rid, doc_id, owner, kind, val, stop - length(val) AS start, stop FROM placed
  WHERE CASE kind WHEN 0 THEN length(regexp_extract(val, p, 2)) >= 12 WHEN 1 THEN length(val) >= 18
    WHEN 3 THEN regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]') ELSE true END),
token AS (
  SELECT *, EXISTS (SELECT 1 FROM span b WHERE b.rid = t.rid AND b.kind < 3 AND b.start <= t.start AND b.stop >= t.stop) AS inside FROM span t WHERE kind = 3),
live AS (
  SELECT val FROM token GROUP BY val
  HAVING count(DISTINCT owner) <= 2 AND count(DISTINCT (owner, coalesce(CAST(doc_id AS VARCHAR), ''))) <= 20 AND (bool_or(inside) OR (
    length(val) >= 16 AND length(regexp_replace(val, '[^0-9]', '', 'g')) >= 4 AND length(regexp_replace(val, '[^A-Za-z]', '', 'g')) >= 4
    AND len(list_distinct(regexp_extract_all(val, '.'))) >= 8))),
final AS (
  SELECT rid, kind, start, stop FROM span WHERE kind < 3
  UNION ALL SELECT rid, kind, start, stop FROM token WHERE NOT inside AND val IN (SELECT val FROM live)),
per AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
    string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
  FROM final GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN per USING (rid)
"""

SQL: dict[str, str] = {"op3_contamination": OP3, "op5_mix": OP5, "op7_urls": OP7, "op11_merkle": OP11, "op13_secrets": OP13}
