"""DuckDB SQL for the corpus queries that SQL can express."""

OP3 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *,
    CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
         ELSE 20 + length(regexp_replace(role, '([<\[])(\\*)(s>|/s>|<SYS>>|</SYS>>|\|endoftext\|>|INST\]|/INST\]|ROLE\]|/ROLE\]|/TURN\])', '\1\\\2\3', 'g')) END
    + length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|<SYS>>|</SYS>>|\|endoftext\|>|INST\]|/INST\]|ROLE\]|/ROLE\]|/TURN\])', '\1\\\2\3', 'g')) AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP5 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

#: CTEs from ``docs`` (id, source, text) to ``mixed`` (id, source, size, source_size, target, repeats, taken);
#: ``docs`` gives the columns that name a row as ``key``.
MIX = r"""
sized AS (
  SELECT *, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         md5('17:' || key) AS h FROM docs),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::INT + 1]::BIGINT AS weight
  FROM sized GROUP BY source),
filling AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () -
             coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source IS NULL, source
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2.0::DOUBLE)
            / sum(weight) OVER (ORDER BY source_size / weight, source IS NULL, source
                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
leveled AS (SELECT *, level * weight >= source_size * 2.0::DOUBLE AS filled FROM filling),
targets AS (
  SELECT source, source_size, CASE WHEN filled THEN source_size * 2.0::DOUBLE
         ELSE weight * max(CASE WHEN NOT filled THEN level END) OVER () END AS target FROM leveled),
ordered AS (
  SELECT s.*, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS whole,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
mixed AS (
  SELECT *, CASE WHEN source_size > 0 THEN
      least(whole + CASE WHEN ahead + size / 2 <= target - whole * source_size THEN 1 ELSE 0 END, 2) ELSE 0 END::BIGINT AS repeats
  FROM ordered)
"""

OP9 = f"""
WITH docs AS (SELECT doc_id AS id, source, text, doc_id::VARCHAR AS key FROM documents), {MIX}
SELECT id AS doc_id, size, source_size, target, size * repeats AS taken FROM mixed
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS phrase
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(s) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS phrase
  FROM d, lengths, unnest(range(1, len(w) - n + 2)) AS t(p)),
found AS (SELECT doc_id, p, g.n, item_id FROM grams g JOIN windows USING (n, phrase)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM found, unnest(range(p, p + n)) AS t(q) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS item_ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(item_ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

OP2 = r"""
WITH lines AS (
  SELECT doc_id, coalesce('=' || source, '') AS site, i, line, trim(line, ' ' || chr(9) || chr(13)) AS bare
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
boilerplate AS (
  SELECT bare FROM lines WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= 8)
SELECT doc_id, count(*) FILTER (bare <> '') AS n_lines, count(*) FILTER (bare <> '' AND b) AS n_removed,
       length(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (bare = '' OR NOT b), '')) AS kept_chars,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (bare = '' OR NOT b), '')) AS kept_sha256
FROM (SELECT l.*, p.bare IS NOT NULL AS b FROM lines l LEFT JOIN boilerplate p USING (bare)) GROUP BY doc_id
"""

OP13 = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score, q.r
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored) WHERE rank <= 10
"""
