"""DuckDB statements of the corpus queries that SQL can express."""

from __future__ import annotations

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, range(1, 5) AS size(k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30
), inside AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM candidates, range(2, 4) AS size(s), range(1, 4) AS place(i)
  WHERE s < k AND i + s - 1 <= k GROUP BY ALL
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inside i USING (lang, phrase)
  WHERE i.longer IS NULL OR 100 * i.longer < 80 * c.a
), cuts AS (
  SELECT c.lang, c.phrase, c.a, j, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * c.a) // (l.f + r.f) AS BIGINT) AS score
  FROM kept c, range(1, 4) AS cut(j)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ')
  WHERE j < c.k
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS low FROM cuts
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE low = 1
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

#: CRC-32 of a decimal number: 256 table entries from the polynomial, then one step for each digit.
_CRC = """
crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS t
  FROM range(256) AS bytes(b)
)"""

MERKLE = f"""
WITH RECURSIVE {_CRC.strip()}, docs AS (
  SELECT *, row_number() OVER () AS row_no FROM documents
), hit AS (
  SELECT d.*, coalesce(xor(list_reduce(
      list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) % 7 = 0, false) AS hit
  FROM docs d, crc_table
), parts AS (
  SELECT doc_id, lang, row_no, hit, n_chars,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS size,
    coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS size_changed,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM hit
), leaves AS (
  SELECT doc_id, lang, row_no, sha256(head || size || tail) AS leaf,
    sha256(head || CASE WHEN hit THEN size_changed ELSE size END || tail) AS changed
  FROM parts
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves
), up AS (
  SELECT lang, 0 AS level, pos, leaf AS node, n FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM up
  WHERE n > 1 GROUP BY lang, level, pos // 2, n
), subroots AS (
  SELECT lang, node AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM up WHERE n = 1
), top AS (
  SELECT 0 AS level, pos, subroot AS node, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2, n
), steps AS (
  SELECT p.row_no, u.level, s.node AS beside, (p.pos >> u.level) % 2 = 1 AS on_left
  FROM placed p JOIN up u ON u.lang IS NOT DISTINCT FROM p.lang AND u.pos = p.pos >> u.level AND u.n > 1
  LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = u.level AND s.pos = xor(u.pos, 1)
  UNION ALL
  SELECT p.row_no, r.height + u.level, s.node, (r.pos >> u.level) % 2 = 1
  FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang
  JOIN top u ON u.pos = r.pos >> u.level AND u.n > 1
  LEFT JOIN top s ON s.level = u.level AND s.pos = xor(u.pos, 1)
), folded AS (
  SELECT row_no, 0 AS level, changed AS node FROM placed
  UNION ALL
  SELECT f.row_no, f.level + 1, sha256(CASE WHEN s.beside IS NULL THEN f.node WHEN s.on_left THEN s.beside || f.node ELSE f.node || s.beside END)
  FROM folded f JOIN steps s ON s.row_no = f.row_no AND s.level = f.level
), last AS (
  SELECT row_no, arg_max(node, level) AS folded_root FROM folded GROUP BY row_no
), proofs AS (
  SELECT row_no, sha256(coalesce(string_agg(beside, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY row_no
)
SELECT p.doc_id, p.leaf, r.subroot, t.node AS root, coalesce(h.proof_sha256, sha256('')) AS proof_sha256, l.folded_root,
  l.folded_root = t.node AS verified
FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang JOIN (SELECT node FROM top WHERE n = 1) t ON true
JOIN last l USING (row_no) LEFT JOIN proofs h USING (row_no)
"""

#: Blocks of 1,024 turn numbers, cells of the room that 2,048 tokens leave, two turns of history within 512.
CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) + 4 AS tokens,
    greatest(coalesce(floor(turn / 1024), 0), 0) AS block
  FROM turns
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, block ORDER BY turn NULLS FIRST, role, text) AS pos,
    coalesce(sum(tokens) OVER (PARTITION BY conv_id, block ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    role = 'system' AND row_number() OVER (PARTITION BY conv_id, role ORDER BY block, turn NULLS FIRST, text) = 1 AS pinned
  FROM sized
), systems AS (
  SELECT conv_id, block AS from_block, pos AS from_at, tokens AS held, role, text
  FROM numbered WHERE pinned
), roomy AS (
  SELECT t.*, 1536 - CASE WHEN s.held <= 1024 AND s.from_block <= t.block THEN s.held ELSE 0 END AS room, s.from_block, s.from_at, s.held,
    s.role AS system_role, s.text AS system_text
  FROM numbered t LEFT JOIN systems s ON s.conv_id IS NOT DISTINCT FROM t.conv_id
), placed AS (
  SELECT *, 2 * (before // room) + CASE WHEN before // room = (before + tokens - 1) // room THEN 0 ELSE 1 END AS w,
    length(replace(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), chr(10), '\' || chr(10)))
    + length(replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>')) + 13 AS chars
  FROM roomy
), windows AS (
  SELECT conv_id, block, w, min(pos) AS head, max(pos) AS tail, max(from_block) AS from_block, max(from_at) AS from_at, max(held) AS held
  FROM placed GROUP BY ALL
), linked AS (
  SELECT *, lag(head) OVER (PARTITION BY conv_id, block ORDER BY w) AS past_head, lag(tail) OVER (PARTITION BY conv_id, block ORDER BY w) AS past_tail
  FROM windows
), past AS (
  SELECT l.conv_id, l.block, l.w, p.pinned, p.chars, sum(p.tokens) OVER (PARTITION BY l.conv_id, l.block, l.w ORDER BY p.block DESC, p.pos DESC) AS upto,
    row_number() OVER (PARTITION BY l.conv_id, l.block, l.w ORDER BY p.block DESC, p.pos DESC) AS back
  FROM linked l JOIN placed p ON p.conv_id IS NOT DISTINCT FROM l.conv_id
   AND (p.block = l.block AND p.pos BETWEEN l.past_head AND l.past_tail OR l.past_tail IS NULL AND p.block = l.block - 1 AND p.turn >= l.block * 1024 - 2)
), repeated AS (
  SELECT conv_id, sum(chars) AS chars FROM (
    SELECT conv_id, chars FROM past WHERE back <= 2 AND upto <= 512 AND NOT pinned
    UNION ALL
    SELECT l.conv_id, p.chars FROM linked l JOIN placed p ON p.conv_id IS NOT DISTINCT FROM l.conv_id AND p.pinned AND p.tokens <= 1024
     AND (p.block < l.block OR p.block = l.block AND p.pos < l.head)
  ) GROUP BY conv_id
), whole AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY block, pos) AS turns,
    coalesce(string_agg(text, '' ORDER BY block, pos) FILTER (role = 'assistant'), '') AS loss
  FROM placed GROUP BY conv_id
)
SELECT w.conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(w.chars + coalesce(r.chars, 0) AS BIGINT) AS formatted_chars
FROM whole w LEFT JOIN repeated r ON r.conv_id IS NOT DISTINCT FROM w.conv_id
"""

TILES = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS k, vec_id, label, embedding::DOUBLE[] AS e,
    coalesce(vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
      AND list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) AS fits
  FROM embeddings
), links AS (
  SELECT a.k, b.k AS other FROM v a JOIN v b ON a.label = b.label AND a.k <> b.k AND a.fits AND b.fits
   AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT k, k AS other FROM v
  UNION
  SELECT r.k, l.other FROM reach r JOIN links l ON l.k = r.other
), roots AS (
  SELECT r.k, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.k = r.other GROUP BY r.k
)
SELECT vec_id, (SELECT count(*) FROM links l WHERE l.k = v.k) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept
FROM v JOIN roots USING (k)
"""
