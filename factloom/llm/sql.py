"""DuckDB SQL of the training-data queries that SQL can express in full: exact links and windows, without the dealt methods' sketches."""

from __future__ import annotations

_WORDS = r"coalesce(regexp_extract_all({0}, '[^\x20\x09-\x0D]+'), [])"

#: Links with 100 * intersection >= 85 * union of 3-word shingles, found by the shingles two distinct sets share; components by closure.
NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')))) END AS s FROM words),
classes AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
held AS (SELECT rep, n, unnest(s) AS shingle FROM classes),
links AS (SELECT a.rep AS a, b.rep AS b FROM held a JOIN held b ON a.shingle = b.shingle AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT reach.a, steps.b FROM reach JOIN steps ON reach.b = steps.a),
least AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN least ON least.rep = classes.rep"""

#: Words covered by a window of 13 that also starts in a document with a smaller doc_id.
SUBSTRINGS = f"""
WITH words AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS k, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS w FROM words WHERE len(ws) >= 13),
firsts AS (SELECT w, min(doc_id) AS owner FROM windows GROUP BY w),
covered AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k FROM windows JOIN firsts USING (w) WHERE doc_id > owner),
placed AS (SELECT doc_id, unnest(range(1, 1 + len(ws))) AS k, unnest(ws) AS word FROM words),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM placed ANTI JOIN covered USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)"""

#: Two cuts of every text by the digest of its id; what is rebuilt is the text.
FILL_MIDDLE = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('1:', doc_id)) AS d FROM documents),
draws AS (SELECT *, length(t) AS n, ('0x' || d[1:8])::UBIGINT AS h1, ('0x' || d[9:16])::UBIGINT AS h2, ('0x' || d[17:24])::UBIGINT AS h3, ('0x' || d[25:32])::UBIGINT AS h4 FROM texts),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM draws),
parts AS (SELECT *, '<P>' || left(t, a) AS p, '<M>' || substring(t, a + 1, b - a) AS m, '<S>' || substring(t, b + 1) AS s FROM cuts)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts"""

#: CRC-32 by its table of 256 entries, made here by rule; near words by what is left without one code point.
SPELLING = """
WITH RECURSIVE crcs AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
found AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS n, hex(encode(concat(doc_id, ':', run))) AS x FROM found WHERE length(run) >= 6 GROUP BY doc_id, run),
marked AS (SELECT run, n, xor(4294967295, list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS h FROM runs, crcs),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM marked)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
rests AS (SELECT word, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM words)),
pairs AS (SELECT a.word AS a, b.word AS b FROM rests a JOIN rests b ON a.rest = b.rest AND a.p = b.p AND a.word < b.word UNION SELECT r.word, w.word FROM rests r JOIN words w ON r.rest = w.word),
links AS (SELECT a AS word, b AS near FROM pairs UNION SELECT b, a FROM pairs),
best AS (SELECT l.word, count(*) AS n_near, first(l.near ORDER BY v.n DESC, l.near) AS form, max(v.n) AS form_n FROM links l JOIN words v ON v.word = l.near GROUP BY l.word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e USING (word)"""

ORACLE = {"op7_minhash_near_dedup": NEAR_DUPLICATES, "op9_substring_dedup": SUBSTRINGS, "op11_spelling_variants": SPELLING, "op13_fill_in_middle": FILL_MIDDLE}
