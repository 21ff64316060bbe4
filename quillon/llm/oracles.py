"""DuckDB SQL that says the same as the operators, plainly: all pairs of equal windows, shingles or lines, no sketches or hashes.

Each text reads a table named `documents`; `over` renames it, so that the pipeline's SQL chains the same texts.
"""

from __future__ import annotations

import re

from quillon.llm import lines, lm, mixing, negatives, variants

WORDS = r"'[^\x20\x09-\x0D]+'"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR = rf"""
d AS (SELECT DISTINCT doc_id, regexp_extract_all({_LOW}, {WORDS}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
"""

QUALITY = rf"""
d AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), {WORDS}) AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS five FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM w) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
    (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
f AS (
  SELECT *, ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (5 * n_symbols > n_words)::BIGINT
    + 8 * (word_chars < 2 * n_words)::BIGINT + 16 * (word_chars > 25 * n_words)::BIGINT
    + 32 * (n_lines >= 4 AND 2 * n_dup_lines > n_lines)::BIGINT)::BIGINT AS failed FROM m)
"""

LINES = rf"""
raw AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
line AS (
  SELECT doc_id, k, line, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, len(regexp_extract_all(line, {WORDS})) AS words,
    regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS id
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
run AS (
  SELECT a.doc_id, a.i, n.n, string_agg(b.id, chr(10) ORDER BY b.i) AS ids, sum(b.words) AS words
  FROM line a, (SELECT unnest(range(1, 9)) AS n) n, line b WHERE b.doc_id = a.doc_id AND b.i >= a.i AND b.i < a.i + n.n GROUP BY ALL HAVING count(*) = n.n),
earliest AS (SELECT doc_id, i, n, words, min((doc_id, i)) OVER (PARTITION BY n, ids) AS place FROM run),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM earliest WHERE words >= 8 AND place < (doc_id, i)),
kept AS (
  SELECT raw.doc_id, string_agg(CASE WHEN gone.i IS NULL THEN raw.line END, chr(10) ORDER BY raw.k) AS text
  FROM raw LEFT JOIN line ON line.doc_id = raw.doc_id AND line.k = raw.k LEFT JOIN gone ON gone.doc_id = raw.doc_id AND gone.i = line.i GROUP BY raw.doc_id),
nl AS (SELECT line.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed FROM line LEFT JOIN gone ON gone.doc_id = line.doc_id AND gone.i = line.i GROUP BY line.doc_id)
"""

BENCH = r"""
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram FROM (
    SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (
    SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hits AS (SELECT dw.doc_id, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.gram = bw.gram AND dw.k = bw.k),
nh AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
""".replace("{low}", _LOW)

#: crc32 of the digits of doc_id: a step for each byte, then one for each of its bits.
CRC = """xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda x, y: CASE WHEN y < 0 THEN xor(x >> 1, (x & 1) * 3988292384) ELSE xor(x, y::BIGINT) END, 4294967295::BIGINT), 4294967295)"""

MODEL = rf"""
t AS (SELECT row_number() OVER () AS r, doc_id, coalesce({CRC} % 7 = 2, false) AS held, list_append(regexp_extract_all({_LOW}, {WORDS}), ' end') AS w FROM documents),
tok AS (
  SELECT r, held, w[i] AS w, CASE WHEN i = 1 THEN ' start' ELSE w[i - 1] END AS v, CASE WHEN i = 2 THEN ' start' WHEN i > 2 THEN w[i - 2] END AS u
  FROM (SELECT r, held, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
c1 AS (SELECT w, count(*) AS c1 FROM tok WHERE NOT held GROUP BY w),
c2 AS (SELECT v, w, count(*) AS c2 FROM tok WHERE NOT held GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS c3 FROM tok WHERE NOT held AND u IS NOT NULL GROUP BY u, v, w),
h1 AS (SELECT v, count(*) AS h1 FROM tok WHERE NOT held GROUP BY v),
h2 AS (SELECT u, v, count(*) AS h2 FROM tok WHERE NOT held AND u IS NOT NULL GROUP BY u, v),
n AS (SELECT coalesce(sum(c1), 0)::BIGINT AS n, count(*) AS types FROM c1),
p AS (
  SELECT r, coalesce(c1, 0) AS c1, n, types, u, (coalesce(c1, 0) + 1) / (n + types + 1)::DOUBLE AS p1, coalesce(c2, 0) AS c2, coalesce(h1, 0) AS h1, coalesce(c3, 0) AS c3, coalesce(h2, 0) AS h2
  FROM tok LEFT JOIN c1 USING (w) LEFT JOIN c2 USING (v, w) LEFT JOIN c3 USING (u, v, w) LEFT JOIN h1 USING (v) LEFT JOIN h2 USING (u, v), n),
q AS (SELECT *, (c2 + {lm.PRIOR[0]} * p1) / (h1 + {lm.PRIOR[0]}) AS p2 FROM p),
s AS (
  SELECT r, count(*) AS n_tokens, count(*) FILTER (c1 > 0) AS n_known, any_value(n) AS train_tokens, sum(log10(p1)) AS base_score,
    sum(log10(CASE WHEN u IS NULL THEN p2 ELSE (c3 + {lm.PRIOR[1]} * p2) / (h2 + {lm.PRIOR[1]}) END)) AS score FROM q GROUP BY r)
"""

#: crc32 of a text's UTF-8: a step for each byte, then one for each of its bits.
CRC_OF = """xor(list_reduce(flatten(list_transform(range(0, strlen({x})), lambda i: [CAST(concat('0x', substr(hex({x}), 2 * i + 1, 2)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda x, y: CASE WHEN y < 0 THEN xor(x >> 1, (x & 1) * 3988292384) ELSE xor(x, y::BIGINT) END, 4294967295::BIGINT), 4294967295)"""

NEGATIVES = f"""
v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % {negatives.FLIP_EVERY} = 0 THEN (label + 1) % {negatives.LABELS} ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor({negatives.SCALE} * CAST(x AS DOUBLE))) AS codes
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS alike, CAST(list_inner_product(a.codes, r.codes) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % {negatives.ANCHOR_EVERY} = 0 AND r.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {negatives.POSITIVES}),
q AS (
  SELECT p.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS r
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND {negatives.LEAST_PART} * positive_score <= 100 * s.score AND 100 * s.score <= {negatives.MOST_PART} * positive_score)
"""

VARIANTS = rf"""
runs AS (
  SELECT doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS x FROM documents)
  WHERE length(x) >= {variants.LEAST_LENGTH}),
pairs AS (SELECT doc_id, x, count(*) AS n FROM runs GROUP BY ALL),
h AS (SELECT x, n, {{crc}} AS h FROM (SELECT x, n, concat(CAST(doc_id AS VARCHAR), ':', x) AS key FROM pairs)),
w AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % {variants.DROP_EVERY} = 0 THEN concat(substr(x, 1, (h % length(x))::BIGINT), substr(x, (h % length(x))::BIGINT + 2)) ELSE x END AS word, n FROM h)
  WHERE length(word) >= {variants.LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {variants.LEAST_COUNT}),
cuts AS (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
links AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN w b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cuts a JOIN w b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS best, max(other_n) AS best_n FROM links GROUP BY word),
f AS (
  SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= {variants.FACTOR} * n THEN best END AS form, CASE WHEN best_n >= {variants.FACTOR} * n THEN best_n END AS form_n
  FROM w LEFT JOIN best ON best.word = w.word),
up AS (SELECT word, coalesce(form, word) AS root FROM f UNION SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
""".replace("{crc}", CRC_OF.replace("{x}", "key"))

SQL = {
    "op1_lm_score": f"""WITH {MODEL}
SELECT doc_id, held AS held_out, n_tokens, n_known, train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score FROM t JOIN s USING (r)""",
    "op2_minhash_dedup": f"""WITH RECURSIVE {NEAR}
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id JOIN comp ON comp.doc_id = documents.doc_id""",
    "op3_quality_rules": f"""WITH {QUALITY}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, n_lines, failed FROM f""",
    "op5_substring_dedup": f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM late),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d WHERE doc_id IN (SELECT doc_id FROM late)),
cut AS (SELECT word.doc_id, count(gone.j) AS n_removed, coalesce(string_agg(CASE WHEN gone.j IS NULL THEN x END, ' ' ORDER BY word.j), '') AS kept FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.j = word.j GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, array_to_string(w, ' '))) AS kept_sha256 FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id""",
    "op7_line_dedup": f"""WITH {LINES}
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  (length(coalesce(d.text, '')) - length(coalesce(kept.text, '')))::BIGINT AS n_chars_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN nl ON nl.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op8_source_mix": mixing.oracle(),
    "op9_decontaminate": f"""WITH {BENCH}
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN nh ON nh.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id""",
    "op11_hard_negatives": f"""WITH {NEGATIVES}
SELECT anchor_id, positive_id, CAST(r AS INT) AS rank, negative_id, positive_score, negative_score FROM q WHERE r <= {negatives.NEGATIVES}""",
    "op13_spelling_variants": f"""WITH RECURSIVE {VARIANTS}
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word JOIN f last ON last.word = up.root AND last.form IS NULL""",
}


def over(sql: str, name: str) -> str:
    return re.sub(r"\bdocuments\b", name, sql)


def pipeline() -> str:
    """SQL of the five stages, each over the rows that the last one kept."""
    stages = [
        f"SELECT * FROM documents WHERE doc_id IN (WITH {QUALITY} SELECT doc_id FROM f WHERE failed = 0)",
        f"""SELECT x.doc_id, CASE WHEN y.n_removed > 0 THEN y.new_text ELSE x.text END AS text, x.lang, x.source, CASE WHEN y.n_removed > 0 THEN length(y.new_text)::BIGINT ELSE x.n_chars END AS n_chars
FROM documents x LEFT JOIN (WITH {LINES} SELECT nl.doc_id, n_lines, n_removed, coalesce(kept.text, '') AS new_text FROM nl JOIN kept ON kept.doc_id = nl.doc_id) y ON y.doc_id = x.doc_id
WHERE coalesce(y.n_removed, 0) = 0 OR len(regexp_extract_all(y.new_text, {WORDS})) >= {lines.LEAST_LEFT}""",
        f"SELECT * FROM documents WHERE doc_id IN (WITH RECURSIVE {NEAR} SELECT component_id FROM comp)",
        f"SELECT * FROM documents WHERE doc_id NOT IN (WITH {BENCH} SELECT d.doc_id FROM d JOIN nh ON nh.doc_id = d.doc_id WHERE 20 * n_hit >= len(w))",
    ]
    parts, last = [], "documents"
    for k, stage in enumerate(stages):
        parts.append(f"stage{k} AS MATERIALIZED ({over(stage, last)})")
        last = f"stage{k}"
    mixed = over(mixing.oracle(), last)
    return f"""WITH {', '.join(parts)}
SELECT s.*, m.n_tokens AS mix_tokens, m.weight AS mix_weight, m.prob AS mix_prob FROM {last} s JOIN ({mixed}) m ON m.doc_id = s.doc_id WHERE m.kept"""
