"""SQL that gives the rows of those queries that SQL can state."""

WORD = r"[^\x20\x09-\x0D]+"

NEAR_VECTORS = """
WITH RECURSIVE given AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
         sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm
  FROM embeddings
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM given a JOIN given b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / a.norm / b.norm >= 0.98
),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM given
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
       (SELECT min(b) FROM reach WHERE a = vec_id) AS component_id,
       vec_id = (SELECT min(b) FROM reach WHERE a = vec_id) AS kept
FROM given"""

QUALITY = f"""
WITH pages AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
),
grams AS (
  SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM pages)
),
twice AS (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM grams JOIN twice USING (doc_id, g), range(0, 3) AS offsets(k) GROUP BY doc_id
),
page_lines AS (
  SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM pages)
  WHERE regexp_matches(line, '{WORD}')
),
repeats AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM page_lines GROUP BY doc_id),
figures AS (
  SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(r.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS marks,
         length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS upper,
         length(t) - length(regexp_replace(t, '\\p{{Ll}}', '', 'g')) AS lower,
         length(t) - length(regexp_replace(t, '\\p{{L}}', '', 'g')) AS letters,
         len(string_split(t, chr(10))) AS n_lines
  FROM pages LEFT JOIN repeats r USING (doc_id) LEFT JOIN covered c USING (doc_id)
),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_symbols <= 0.25 * n_words AND marks <= 0.5 * n_words
       AND word_chars BETWEEN 2 * n_words AND 16 * n_words AND upper <= 0.6 * greatest(1, upper + lower)
       AND letters >= 0.5 * greatest(1, word_chars) AND n_dup_lines <= 0.5 * n_lines AS kept
FROM judged"""

SUBSTRINGS = f"""
WITH pages AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
grams AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM pages)
),
firsts AS (SELECT g, min(doc_id) AS f FROM grams GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, i + k AS pos FROM grams JOIN firsts USING (g), range(0, 13) AS offsets(k) WHERE f < doc_id
),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM pages),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, pos)
  GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM pages LEFT JOIN kept USING (doc_id)"""

#: CRC-32 is built from its polynomial (0xEDB88320, reflected), as DuckDB has no such function.
MERKLE = """
WITH RECURSIVE
crc_steps(n, c, k) AS (
  SELECT n, CAST(n AS UBIGINT), 0 FROM range(256) t(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS UBIGINT), c >> 1) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8
),
crc_table AS (SELECT n, c FROM crc_steps WHERE k = 8),
ids AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL),
crc_run(s, i, c) AS (
  SELECT s, 0, CAST(4294967295 AS UBIGINT) FROM ids
  UNION ALL
  SELECT r.s, r.i + 1, xor(t.c, r.c >> 8) FROM crc_run r JOIN crc_table t ON t.n = xor(r.c, CAST(ascii(substr(r.s, r.i + 1, 1)) AS UBIGINT)) & 255
  WHERE r.i < length(r.s)
),
crc AS (SELECT s, xor(c, CAST(4294967295 AS UBIGINT)) AS crc FROM crc_run WHERE i = length(s)),
leaves AS (
  SELECT doc_id, lang,
    sha256(concat_ws('', f_id, f_src, f_lang, f_n, f_text)) AS leaf,
    sha256(concat_ws('', f_id, f_src, f_lang, CASE WHEN n_chars IS NOT NULL AND crc % 7 = 0
                                                   THEN strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR) ELSE f_n END, f_text)) AS bad_leaf
  FROM (
    SELECT *,
      CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR) END AS f_id,
      CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END AS f_src,
      CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS f_lang,
      CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR) END AS f_n,
      CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS f_text
    FROM documents LEFT JOIN crc ON crc.s = CAST(doc_id AS VARCHAR))
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n
  FROM leaves
),
low(lang, lvl, pos, h, n) AS (
  SELECT lang, 0, pos, leaf, n FROM placed
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, sha256(h || coalesce(nxt, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (PARTITION BY lang ORDER BY pos) AS nxt FROM low WHERE n > 1)
  WHERE pos % 2 = 0
),
subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
),
high(lvl, pos, h, n) AS (
  SELECT 0, pos, subroot, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(h || coalesce(nxt, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (ORDER BY pos) AS nxt FROM high WHERE n > 1)
  WHERE pos % 2 = 0
),
root AS (SELECT h AS root FROM high WHERE n = 1),
steps AS (
  SELECT p.doc_id, p.leaf, p.lang, l.lvl AS k, s.h AS sibling, (p.pos >> l.lvl) % 2 = 0 AS is_left
  FROM placed p JOIN low l ON l.lang IS NOT DISTINCT FROM p.lang AND l.pos = p.pos >> l.lvl AND l.n > 1
  LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM p.lang AND s.lvl = l.lvl AND s.pos = xor(p.pos >> l.lvl, 1)
  UNION ALL
  SELECT p.doc_id, p.leaf, p.lang, 1000 + g.lvl, s.h, (r.pos >> g.lvl) % 2 = 0
  FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang
  JOIN high g ON g.pos = r.pos >> g.lvl AND g.n > 1
  LEFT JOIN high s ON s.lvl = g.lvl AND s.pos = xor(r.pos >> g.lvl, 1)
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, leaf ORDER BY k) AS i FROM steps),
folded(doc_id, leaf, i, h) AS (
  SELECT doc_id, leaf, 0, bad_leaf FROM placed
  UNION ALL
  SELECT f.doc_id, f.leaf, f.i + 1,
         CASE WHEN s.sibling IS NULL THEN sha256(f.h) WHEN s.is_left THEN sha256(f.h || s.sibling) ELSE sha256(s.sibling || f.h) END
  FROM folded f JOIN numbered s ON s.doc_id IS NOT DISTINCT FROM f.doc_id AND s.leaf = f.leaf AND s.i = f.i + 1
),
proofs AS (
  SELECT doc_id, leaf, sha256(coalesce(string_agg(sibling, '' ORDER BY k), '')) AS proof_sha256 FROM steps GROUP BY doc_id, leaf
)
SELECT p.doc_id, p.leaf, r.subroot, (SELECT root FROM root) AS root,
       coalesce(q.proof_sha256, sha256('')) AS proof_sha256,
       f.h AS folded_root, f.h = (SELECT root FROM root) AS verified
FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang
LEFT JOIN proofs q ON q.doc_id IS NOT DISTINCT FROM p.doc_id AND q.leaf = p.leaf
JOIN (SELECT doc_id, leaf, arg_max(h, i) AS h FROM folded GROUP BY doc_id, leaf) f ON f.doc_id IS NOT DISTINCT FROM p.doc_id AND f.leaf = p.leaf
"""

#: Leftmost non-overlapping matches of each rule by RE2, placed by the lengths of the gaps between them, then the short ones dropped.
SECRETS = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT doc_id, 'assign' AS kind, 1 AS k, 6 AS least, regexp_split_to_array(t, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps, regexp_extract_all(t, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS hits, regexp_extract_all(t, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS parts FROM docs
  UNION ALL SELECT doc_id, 'access' AS kind, 2 AS k, 20 AS least, regexp_split_to_array(t, 'AKIA[A-Z0-9]+') AS gaps, regexp_extract_all(t, 'AKIA[A-Z0-9]+') AS hits, regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) AS parts FROM docs
  UNION ALL SELECT doc_id, 'hex' AS kind, 3 AS k, 24 AS least, regexp_split_to_array(t, '[0-9a-f]+') AS gaps, regexp_extract_all(t, '[0-9a-f]+') AS hits, regexp_extract_all(t, '[0-9a-f]+', 0) AS parts FROM docs
  UNION ALL SELECT doc_id, 'private_key' AS kind, 4 AS k, 0 AS least, regexp_split_to_array(t, '-----BEGIN[A-Z ]* PRIVATE KEY-----') AS gaps, regexp_extract_all(t, '-----BEGIN[A-Z ]* PRIVATE KEY-----') AS hits, regexp_extract_all(t, '-----BEGIN[A-Z ]* PRIVATE KEY-----', 0) AS parts FROM docs
  UNION ALL SELECT doc_id, 'github' AS kind, 5 AS k, 40 AS least, regexp_split_to_array(t, 'gh[pousr]_[A-Za-z0-9]+') AS gaps, regexp_extract_all(t, 'gh[pousr]_[A-Za-z0-9]+') AS hits, regexp_extract_all(t, 'gh[pousr]_[A-Za-z0-9]+', 0) AS parts FROM docs
  UNION ALL SELECT doc_id, 'slack' AS kind, 6 AS k, 15 AS least, regexp_split_to_array(t, 'xox[abprs]-[A-Za-z0-9-]+') AS gaps, regexp_extract_all(t, 'xox[abprs]-[A-Za-z0-9-]+') AS hits, regexp_extract_all(t, 'xox[abprs]-[A-Za-z0-9-]+', 0) AS parts FROM docs
  UNION ALL SELECT doc_id, 'google' AS kind, 7 AS k, 39 AS least, regexp_split_to_array(t, 'AIza[0-9A-Za-z_-]+') AS gaps, regexp_extract_all(t, 'AIza[0-9A-Za-z_-]+') AS hits, regexp_extract_all(t, 'AIza[0-9A-Za-z_-]+', 0) AS parts FROM docs
),
each AS (
  SELECT doc_id, kind, k, least, i, length(gaps[i]) AS gap, length(hits[i]) AS width, length(parts[i]) AS measured
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found)
),
placed AS (SELECT *, sum(gap + width) OVER (PARTITION BY doc_id, k ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM each),
kept AS (SELECT doc_id, kind, k, e - width AS s, e FROM placed WHERE measured >= least)
SELECT d.doc_id,
  count(x.k) FILTER (WHERE x.kind = 'assign') AS n_assign,
  count(x.k) FILTER (WHERE x.kind = 'access') AS n_access,
  count(x.k) FILTER (WHERE x.kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(x.kind || ':' || x.s || ':' || x.e, ',' ORDER BY x.s, x.k) FILTER (WHERE x.k <= 3), '')) AS base_sha256,
  coalesce(string_agg(x.kind || ':' || x.s || ':' || x.e, ',' ORDER BY x.s, x.k), '') AS spans
FROM docs d LEFT JOIN kept x ON x.doc_id = d.doc_id
GROUP BY d.doc_id
"""

#: Integer scores of every anchor with every row, positives and windows by ranking.
NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
a AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS alabel, v.vec_id, v.label,
         CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(v.q AS DOUBLE[])) AS BIGINT) AS score
  FROM a JOIN v ON v.vec_id <> a.vec_id AND len(v.q) = len(a.q)
),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE label = alabel)
  WHERE r <= 5
),
neg AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM pos p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.alabel
  WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""
