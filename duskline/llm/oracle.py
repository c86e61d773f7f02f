"""DuckDB SQL for the text queries that SQL can express, over the same tables."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]+"
LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

REPEATS = f"""
WITH w AS (
  SELECT row_number() OVER () AS doc, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS words
  FROM documents
),
windows AS (
  SELECT doc, i, array_to_string(words[i:i + 34], ' ') AS content
  FROM w, unnest(range(1, len(words) - 33)) AS r(i) WHERE len(words) >= 35
),
again AS (SELECT content FROM windows GROUP BY content HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc, unnest(range(i, i + 35)) AS pos FROM windows JOIN again USING (content)
),
places AS (SELECT doc, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
kept AS (
  SELECT doc, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n
  FROM places ANTI JOIN gone USING (doc, pos) GROUP BY doc
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc)
"""

REACH = """
reach(a, b) AS (
  SELECT a, b FROM links
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
),
lowest AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), {LETTERS}), '{SPACE}'), lambda x: x <> '') AS words
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM w, unnest(range(1, greatest(len(words) - 3, 2))) AS r(i) WHERE len(words) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS shared
  FROM shingles l JOIN shingles r USING (shingle) WHERE l.doc_id <> r.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 75 * (x.n + y.n - shared)
),
{REACH.strip()}
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, low) AS component_id,
       doc_id = least(doc_id, low) AS kept
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest ON a = doc_id
"""

EMBEDDINGS = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT l.vec_id AS a, r.vec_id AS b FROM good l JOIN good r ON l.vec_id <> r.vec_id
  WHERE len(l.v) = len(r.v) AND list_cosine_similarity(l.v, r.v) >= 0.9
),
{REACH.strip()},
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, low) AS component_id,
       vec_id = least(vec_id, low) AS kept
FROM embeddings LEFT JOIN counts ON counts.a = vec_id LEFT JOIN lowest ON lowest.a = vec_id
"""

MARKS = r"^((?:[ \t]{0,3}>)+)[ \t]?"
ATTRIBUTION = r"(?i)^.{0,200}\b(wrote|writes|schrieb|écrit|escribió)\s*:\s*$"


def _sentences(text: str) -> str:
    plain = f"lower(trim(regexp_replace({text}, '\\s+', ' ', 'g')))"
    ended = f"regexp_replace({plain}, '([.!?…])\\s+', '\\1' || chr(1), 'g')"
    return f"list_distinct(list_filter(string_split({ended}, chr(1)), lambda x: x <> ''))"


QUOTES = rf"""
WITH RECURSIVE numbered AS (
  SELECT row_number() OVER () AS m, conv_id, turn, coalesce(role, 'unknown') AS role,
         string_split_regex(coalesce(text, ''), '\r\n|\r|\n') AS parts
  FROM conversations
),
lines AS (
  SELECT m, conv_id, turn, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM numbered
),
leveled AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '{MARKS}', 1), '[^>]', '', 'g')) AS level,
         regexp_replace(line, '{MARKS}', '') AS said
  FROM lines
),
marked AS (
  SELECT *, level = 0 AND NOT (regexp_matches(line, '{ATTRIBUTION}')
         AND coalesce(lead(level) OVER (PARTITION BY m ORDER BY pos), 0) > 0) AS own
  FROM leveled
),
parsed AS (
  SELECT m, conv_id, turn, CAST(max(level) AS INT) AS quote_levels,
         regexp_replace(coalesce(string_agg(said, chr(10) ORDER BY pos) FILTER (own), ''),
                        '^\s+|\s+$', '', 'g') AS text
  FROM marked GROUP BY m, conv_id, turn
),
known AS (SELECT * FROM parsed WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
said AS (SELECT conv_id, turn, unnest({_sentences('text')}) AS s FROM known),
whole AS (
  SELECT m, conv_id, turn, level, string_agg(said, ' ' ORDER BY pos) AS text
  FROM marked WHERE level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
),
quoted AS (
  SELECT DISTINCT conv_id, turn, level, unnest({_sentences('text')}) AS s FROM whole
),
sayers AS (SELECT DISTINCT conv_id, turn, s FROM said),
inside AS (
  SELECT q.conv_id, q.turn, level, s, q.conv_id AS parent_conv_id, h.turn AS parent_turn
  FROM quoted q JOIN sayers h USING (conv_id, s) WHERE h.turn < q.turn
),
outside AS (
  SELECT q.conv_id, q.turn, level, s, h.conv_id AS parent_conv_id, h.turn AS parent_turn
  FROM quoted q JOIN sayers h USING (s) WHERE h.conv_id < q.conv_id
),
votes AS (
  SELECT conv_id, turn, level, parent_conv_id, parent_turn, sum(length(s)) AS size
  FROM (FROM inside UNION ALL FROM outside) GROUP BY ALL
),
linked AS (
  SELECT conv_id, turn, parent_conv_id, parent_turn FROM votes
  QUALIFY row_number() OVER (
    PARTITION BY conv_id, turn
    ORDER BY parent_conv_id <> conv_id, level, size DESC, parent_conv_id, parent_turn) = 1
),
moved(conv_id, turn, to_conv, to_turn, depth) AS (
  SELECT conv_id, turn, parent_conv_id, parent_turn, 1 FROM linked
  UNION ALL
  SELECT moved.conv_id, moved.turn, l.parent_conv_id, l.parent_turn, depth + 1
  FROM moved JOIN linked l ON l.conv_id = moved.to_conv AND l.turn = moved.to_turn
),
homes AS (SELECT conv_id, turn, arg_max(to_conv, depth) AS thread FROM moved GROUP BY ALL)
SELECT coalesce(thread, p.conv_id) AS thread, p.conv_id, p.turn, role, p.text, quote_levels,
       parent_conv_id, parent_turn,
       '<|' || role || '|>' || chr(10) || p.text || chr(10) || '<|end|>' || chr(10) AS formatted
FROM parsed p JOIN (SELECT m, role FROM numbered) USING (m)
LEFT JOIN linked l ON l.conv_id = p.conv_id AND l.turn = p.turn
LEFT JOIN homes ON homes.conv_id = p.conv_id AND homes.turn = p.turn
"""

HARD_NEGATIVES = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM good a JOIN good r ON len(a.v) = len(r.v) AND a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id,
       positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

SPELLING = rf"""
WITH RECURSIVE bits AS (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM (SELECT unnest(range(256)) AS i)
),
crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM bits),
said AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), {LETTERS}) AS run FROM documents
),
runs AS (SELECT doc_id, run, count(*) AS n FROM said WHERE length(run) >= 7 GROUP BY ALL),
coded AS (
  SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS code FROM runs
),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
           list_concat([4294967295], list_transform(range(0, length(code) // 2),
             lambda i: CAST('0x' || substr(code, 2 * i + 1, 2) AS BIGINT))),
           lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS h
  FROM coded, crc
),
cut AS (
  SELECT n, CASE WHEN h % 31 = 0
              THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word
  FROM hashed
),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
),
less AS MATERIALIZED (
  SELECT word, i, word[1:i - 1] || word[i + 1:] AS rest
  FROM words, unnest(range(1, length(word) + 1)) AS r(i)
),
near AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b USING (i, rest) WHERE a.word <> b.word
  UNION
  SELECT a.word, a.rest FROM less a JOIN words b ON b.word = a.rest
  UNION
  SELECT a.rest, a.word FROM less a JOIN words b ON b.word = a.rest
),
about AS (
  SELECT l.word, l.n, count(*) AS n_near, min({{'n': -r.n, 'word': r.word}}) AS best
  FROM near JOIN words l ON l.word = near.word JOIN words r ON r.word = near.other GROUP BY ALL
),
formed AS MATERIALIZED (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN -best.n >= 10 * words.n THEN best.word END AS form,
         CASE WHEN -best.n >= 10 * words.n THEN -best.n END AS form_n
  FROM words LEFT JOIN about USING (word)
),
steps(word, root) AS (
  SELECT word, word FROM formed
  UNION ALL
  SELECT steps.word, form FROM steps JOIN formed ON formed.word = steps.root WHERE form IS NOT NULL
)
SELECT f.word, f.form, steps.root, f.n, f.n_near, f.form_n
FROM formed f JOIN steps USING (word) JOIN formed last ON last.word = steps.root
WHERE last.form IS NULL
"""

ORACLE: dict[str, str] = {
    "op3_repeats": REPEATS,
    "op4_near_duplicates": NEAR_DUPLICATES,
    "op5_embeddings": EMBEDDINGS,
    "op7_quotes": QUOTES,
    "op11_negatives": HARD_NEGATIVES,
    "op13_spelling": SPELLING,
}
