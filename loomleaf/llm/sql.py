"""DuckDB SQL for those queries that SQL can express."""

OP9 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS bound,
    list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT a.source, a.bound / a.weight AS ratio,
    (1.5::DOUBLE * (SELECT sum(source_size) FROM sources) - coalesce((SELECT sum(b.bound) FROM sources b WHERE b.bound / b.weight < a.bound / a.weight), 0))
      / (SELECT sum(b.weight) FROM sources b WHERE b.bound / b.weight >= a.bound / a.weight) AS level FROM sources a),
found AS (SELECT min_by(level, ratio) AS level FROM levels WHERE level <= ratio),
aims AS (SELECT source, source_size, least(weight * level, bound) AS target FROM sources, found),
placed AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, CAST(round(a.target) AS BIGINT) AS budget,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('9:' || s.doc_id), s.doc_id ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END AS BIGINT) AS taken
FROM placed
"""

OP12 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
counted AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4, 5]) AS k)) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::HUGEINT AS n FROM counted WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND f >= 100),
cuts AS (SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)),
scores AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, t.n, 1000::HUGEINT * c.a * t.n // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.first JOIN counted y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (
  SELECT * FROM lowest p WHERE NOT EXISTS (
    SELECT 1 FROM candidates q WHERE q.lang = p.lang AND q.k > len(string_split(p.phrase, ' ')) AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' ') AND 100 * q.a >= 100 * p.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""

OP13 = r"""
WITH counted AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
flags AS (
  SELECT c.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(c.doc_id > min(c.doc_id) OVER (PARTITION BY t), false) AS e
  FROM counted c LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON c.doc_id = l.doc_id),
grouped AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM flags GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM letters p, letters q, letters r, letters s, letters t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND p.bit | q.bit | r.bit | s.bit | t.bit = 31),
steps AS (SELECT filter_order, k AS step, bits[k] AS own, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS gone FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k))
SELECT part, filter_order, step::INT AS step,
  CAST(sum(CASE WHEN mask & (own + gone) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN mask & own <> 0 AND mask & gone = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN mask & own <> 0 AND mask & gone <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN mask & own <> 0 AND mask & gone = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN mask & own <> 0 AND mask & gone = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN mask & own <> 0 THEN n * (120 // bit_count(mask)) ELSE 0 END) AS BIGINT) AS shapley
FROM steps, grouped GROUP BY ALL
"""

SQL: dict[str, str] = {"op9_mixing": OP9, "op12_collocations": OP12, "op13_filter_audit": OP13}
