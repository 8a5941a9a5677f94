"""DuckDB SQL of the queries that SQL can express."""

_HOST = r"translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's')"
_CANON = r"regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/)$', '')"

URL_FILTER = rf"""
WITH parsed AS (SELECT page_id, url, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path FROM pages),
 rules(rule, verdict) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'),
   ('example.net/de/8', 'block'), ('org/es/', 'block')),
 split AS (SELECT rule, verdict, string_split(rule, '/')[1] AS h, substr(rule, strpos(rule, '/')) AS p FROM rules),
 fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
   FROM parsed JOIN split ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
 canon AS (SELECT *, {_CANON} AS key FROM parsed),
 listed AS (SELECT DISTINCT key FROM canon WHERE starts_with(host, 'spam') OR contains(url, 'utm_source=feed'))
SELECT c.page_id, c.host, c.path, f.rule,
  coalesce(f.verdict, CASE WHEN c.host <> '' AND c.key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM canon c LEFT JOIN fit f USING (page_id)"""

MIX = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
   ('0x' || substr(md5('17:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn
   FROM d GROUP BY source),
 w AS (SELECT source, source_size, turn % 3 + 1 AS weight FROM s),
 l AS (SELECT *, ((sum(source_size) OVER ())::BIGINT - 3 * coalesce(sum(source_size) OVER before, 0)::BIGINT)::DOUBLE
     / ((sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER before, 0)::BIGINT) AS level
   FROM w WINDOW before AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 g AS (SELECT *, max(CASE WHEN level * weight <= 3 * source_size THEN level END) OVER () AS share FROM l),
 t AS (SELECT source, source_size, least(coalesce(share * weight, 'inf'::DOUBLE), (3 * source_size)::DOUBLE) AS target FROM g),
 r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
  size * least(floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT, 3) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source"""

AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 first AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
 l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
 m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
   (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
   + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
   + 16 * (doc_id > first_id)::INT AS mask
   FROM d JOIN first USING (t) LEFT JOIN l USING (doc_id)),
 c AS (SELECT part, mask, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
 f(i) AS (VALUES (0), (1), (2), (3), (4)),
 o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
 s AS (SELECT o, k AS step, 1 << o[k] AS own,
   list_sum([1 << x FOR x IN o[1:k]])::INT AS after FROM o, range(1, 6) t(k)),
 x AS (SELECT part, list_aggregate([chr(65 + v) FOR v IN o], 'string_agg', '') AS filter_order, step, own,
   sum(docs) FILTER (mask & after = 0) AS kept,
   sum(docs) FILTER (mask & own > 0 AND mask & (after - own) = 0) AS removed,
   sum(docs) FILTER (mask & own > 0 AND mask & (after - own) > 0) AS redundant,
   sum(docs) FILTER (mask = own) AS unique_fails,
   sum(good) FILTER (mask & own > 0 AND mask & (after - own) = 0) AS good_lost,
   sum(toxic) FILTER (mask & own > 0 AND mask & (after - own) = 0) AS toxic_lost
   FROM c, s GROUP BY part, o, step, own)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
 coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
 coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
 (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM x"""

PHRASES = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
   regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
     '[.,;:!?\x0A-\x0D]') AS parts FROM documents),
 p AS (SELECT doc, lang, unnest(parts) AS part, unnest(range(len(parts))) AS piece FROM d),
 q AS (SELECT doc, lang, piece, regexp_extract_all(part, '[^\x20\x09]+') AS w FROM p),
 r AS (SELECT doc, lang, piece, unnest(w) AS w1, unnest(range(len(w))) AS pos FROM q),
 g AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM r
   WINDOW o AS (PARTITION BY doc, piece ORDER BY pos)),
 f1 AS (SELECT lang, w1, count(*) AS n FROM g GROUP BY ALL),
 f2 AS (SELECT lang, w1, w2, count(*) AS n FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
 f3 AS (SELECT lang, w1, w2, w3, count(*) AS n FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
 cuts AS (
   SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, 1 AS k, c.n AS a, x.n AS l, y.n AS r
   FROM f2 c JOIN f1 x USING (lang, w1) JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2
   WHERE c.n >= 10 AND NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = c.lang AND 100 * t.n >= 50 * c.n
     AND ((t.w1 = c.w1 AND t.w2 = c.w2) OR (t.w2 = c.w1 AND t.w3 = c.w2)))
   UNION ALL
   SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 1, c.n, x.n, y.n
   FROM f3 c JOIN f1 x USING (lang, w1) JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
   UNION ALL
   SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 2, c.n, x.n, y.n
   FROM f3 c JOIN f2 x USING (lang, w1, w2) JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w3),
 s AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT t.lang, rank, phrase, a, l, r, n.n, score
FROM t JOIN (SELECT lang, sum(n)::BIGINT AS n FROM f1 GROUP BY lang) n USING (lang) WHERE rank <= 2000"""

_CONTROLS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<|", "|>", "\\")
_ESCAPES = " + ".join(f"(length(t) - length(replace(t, '{c}', ''))) // {len(c)}" for c in _CONTROLS)
_ROLE_ESCAPES = _ESCAPES.replace("(t", "(role")

CHAT = rf"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
   UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
 m AS (SELECT *, length(t) + {_ESCAPES} + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
   ELSE 11 + length(role) + {_ROLE_ESCAPES} END AS chars FROM rows),
 g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t) AS said,
   coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, t) FILTER (role = 'assistant'), '') AS loss, sum(chars)::BIGINT AS chars
   FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
 chars AS formatted_chars FROM g"""

ORACLES = {"op5_url_filter": URL_FILTER, "op9_mix_sources": MIX, "op11_filter_audit": AUDIT, "op12_phrase_mining": PHRASES,
           "op13_chat_format": CHAT}
