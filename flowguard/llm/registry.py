"""The registered query of each operator, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from flowguard.llm import (
    bytebpe,
    decontaminate,
    kneser_ney,
    language,
    licenses,
    pieces,
    pii,
    prefixes,
    simhash,
    substrings,
    topk,
    url_filter,
    variants,
)

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_decontaminate": decontaminate.query,
    "op3_topk": topk.query,
    "op4_licenses": licenses.query,
    "op5_pii": pii.query,
    "op6_simhash": simhash.query,
    "op7_sentencepiece": pieces.query,
    "op8_kneser_ney": kneser_ney.query,
    "op9_language": language.query,
    "op10_substrings": substrings.query,
    "op11_byte_bpe": bytebpe.query,
    "op12_variants": variants.query,
    "op13_prefix_trie": prefixes.query,
}

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), test AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
        FROM items WHERE len(w) > 0)
), spots AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM test) WHERE len(w) >= n)
), met AS (SELECT doc_id, n, i, item_id FROM spots JOIN test USING (n, win)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM met)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM met WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN named ON d.doc_id = named.doc_id
""".replace("{lower}", LOWER.format("text"))

TOPK = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM e q, e c WHERE q.vec_id % 100 = 0 AND c.vec_id != q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), again AS (
  SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""

#: CRC-32 of the bytes in a list.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, {0}), lambda x, b:
  list_reduce(list_prepend(xor(x, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, i: xor(y >> 1, (y & 1) * 3988292384))))"""

VARIANTS = r"""
WITH RECURSIVE r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, {lower} AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{6,}')) AS raw FROM documents)
), g AS (SELECT id, run, count(*) AS k FROM r GROUP BY id, run),
s AS (
  SELECT run, k, flatten(list_transform(string_split(id || ':' || run, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END)) AS raw FROM g
), c AS (SELECT run, k, {crc} AS h FROM s),
w AS (
  SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word,
    CAST(sum(k) AS BIGINT) AS n
  FROM c GROUP BY 1 HAVING sum(k) >= 5 AND length(word) >= 6
), cut AS (
  SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), pair AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word != b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word
), near AS (SELECT word, count(*) AS n_near, max(m) AS m, first(other ORDER BY m DESC, other) AS other FROM pair GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n
  FROM w LEFT JOIN near ON w.word = near.word
), chain AS (SELECT word, word AS at FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, chain.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN chain ON f.word = chain.word JOIN f AS top ON top.word = chain.at AND top.form IS NULL
""".replace("{lower}", LOWER.format("raw")).replace("{crc}", CRC.format("raw"))

PREFIXES = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS x,
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT)) AS raw
  FROM t GROUP BY conv_id
), h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, x, {crc} % 6 AS h FROM own),
built AS (SELECT h.conv_id, list_concat(coalesce(b.x[1:h.h], []), h.x[h.h + 1:]) AS x FROM h LEFT JOIN own b ON b.conv_id = h.base),
node AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = long), '')) AS ends_sha256
  FROM (SELECT conv_id, x[1:d] AS p, d, len(x) AS long FROM (SELECT conv_id, x, unnest(range(0, len(x) + 1)) AS d FROM built))
  GROUP BY p, d
), kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
value AS (
  SELECT node.p, node.d, CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END AS leaf,
    CASE WHEN node.d = 0 THEN 0 ELSE (n_convs - 1) * length(node.p[node.d].text) END AS saved
  FROM node LEFT JOIN kids ON node.p = kids.p AND node.d = kids.d
), below AS (
  SELECT p[1:k] AS p, k AS d, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM (SELECT p, leaf, saved, unnest(range(0, d + 1)) AS k FROM value) GROUP BY 1, 2
)
SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves,
  saved_tokens, node.ends_sha256
FROM node JOIN below ON node.p = below.p AND node.d = below.d
LEFT JOIN kids ON node.p = kids.p AND node.d = kids.d
LEFT JOIN node AS up ON node.d > 0 AND up.d = node.d - 1 AND up.p = node.p[1:node.d - 1]
""".replace("{crc}", CRC.format("raw"))

ORACLE = {
    "op12_variants": VARIANTS,
    "op13_prefix_trie": PREFIXES,
    "op1_url_filter": url_filter.oracle(),
    "op4_licenses": licenses.oracle(),
    "op10_substrings": SUBSTRINGS,
    "op3_topk": TOPK,
    "op2_decontaminate": DECONTAMINATE,
}
