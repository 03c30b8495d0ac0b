"""Expected results as SQL over the given tables, where SQL can express the operator."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[ \\t\\n\\x0b\\x0c\\r]+'), lambda x: x <> '')"


OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {words(LOW)} AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5
      THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w)
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_in AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
),
link AS (
  SELECT a, b FROM both_in JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE c >= 0.8 * (x.n + y.n - c) - 1e-6
),
reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT l.b, reach.r FROM reach JOIN link l ON l.a = reach.doc_id
)
SELECT d.doc_id, min(r) AS class_id,
  (SELECT count(*) FROM link WHERE link.a = d.doc_id) AS n_links
FROM documents d JOIN reach ON reach.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP8 = f"""
WITH w AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
win AS (
  SELECT doc_id, i, w[i : i + 34] AS s FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w)
),
twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, j FROM (
    SELECT doc_id, unnest(range(i, i + 35)) AS j FROM win JOIN twice USING (s))
),
marks AS (SELECT doc_id, list(j) AS j FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, w, coalesce(len(j), 0) AS n, CASE WHEN j IS NULL THEN w ELSE
    list_filter(w, lambda x, k: NOT list_contains(j, k)) END AS v
  FROM w LEFT JOIN marks USING (doc_id)
)
SELECT doc_id, len(w) AS n_words, n AS n_removed,
  sha256(coalesce(array_to_string(v, ' '), '')) AS kept_sha256 FROM kept
"""

OP9 = """
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS s,
    generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents
),
f AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM l
  WHERE trim(s, ' ' || chr(9) || chr(13)) <> ''
),
win AS (
  SELECT doc_id, k, s AS a, lead(s) OVER o AS b, lead(s, 2) OVER o AS c FROM f
  WINDOW o AS (PARTITION BY doc_id ORDER BY k)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) AS r FROM win
  WHERE c IS NOT NULL
),
gone AS (SELECT DISTINCT doc_id, unnest([k, k + 1, k + 2]) AS k FROM ranked WHERE r > 1),
kept AS (
  SELECT l.doc_id, l.n, l.s FROM l LEFT JOIN f ON f.doc_id = l.doc_id AND f.n = l.n
  LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.k = f.k WHERE gone.k IS NULL
),
new AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY n) AS t FROM kept GROUP BY doc_id),
cnt AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t, '') END AS text,
  coalesce(c, 0) AS lines_removed
FROM documents d LEFT JOIN new USING (doc_id) LEFT JOIN cnt USING (doc_id)
"""

OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

# The 256 steps of CRC-32 as a list, for crc32() below.
CRC = """
crc_steps AS (
  SELECT n, list_reduce(list_prepend(n::BIGINT, range(8)::BIGINT[]),
    lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS c
  FROM range(256) t(n)
),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM crc_steps)
"""


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, over the list ``t`` of ``crc_table``."""
    digits = f"hex(encode({text}))"
    places = f"range(1, strlen({text})::BIGINT * 2, 2)"
    data = f"list_transform({places}, lambda i: ('0x' || substr({digits}, i, 2))::BIGINT)"
    step = "lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), {step}), 4294967295::BIGINT)"


def field(column: str) -> str:
    value = f"CAST({column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({value}) || ':' || {value} END"


def leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"


OP11 = f"""
WITH RECURSIVE {CRC},
doc AS (
  SELECT doc_id, coalesce('1' || source, '0') AS tree, {leaf("text")} AS leaf,
    CASE WHEN {crc32("coalesce(doc_id::VARCHAR, '')")} % 2 = 0 AND doc_id IS NOT NULL
      THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS checked
  FROM documents, crc_table
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS n FROM doc
),
low AS (
  SELECT 0 AS level, tree, pos, n, leaf AS h FROM ranked
  UNION ALL
  SELECT level + 1, tree, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
  FROM low WHERE n > 1 GROUP BY ALL
),
roots AS (
  SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n
  FROM low WHERE n = 1
),
high AS (
  SELECT 0 AS level, pos, n, h FROM roots
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
  FROM high WHERE n > 1 GROUP BY ALL
),
low_path AS (
  SELECT r.tree, r.pos AS leaf_pos, x.level,
    coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < r.pos // (3 ** x.level)::BIGINT), '') AS l,
    coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > r.pos // (3 ** x.level)::BIGINT), '') AS r
  FROM ranked r JOIN low x ON x.tree = r.tree AND x.n > 1
    AND x.pos // 3 = r.pos // (3 ** (x.level + 1))::BIGINT
  GROUP BY ALL
),
high_path AS (
  SELECT s.tree, 1000 + x.level AS level,
    coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < s.pos // (3 ** x.level)::BIGINT), '') AS l,
    coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > s.pos // (3 ** x.level)::BIGINT), '') AS r
  FROM roots s JOIN high x ON x.n > 1 AND x.pos // 3 = s.pos // (3 ** (x.level + 1))::BIGINT
  GROUP BY ALL
),
steps AS (
  SELECT tree, leaf_pos, level, l, r FROM low_path
  UNION ALL
  SELECT h.tree, d.pos, h.level, h.l, h.r FROM high_path h JOIN ranked d ON d.tree = h.tree
),
proof AS (
  SELECT tree, leaf_pos, list([l, r] ORDER BY level) AS p FROM steps GROUP BY ALL
),
out AS (
  SELECT d.doc_id, d.leaf, s.h AS subroot, top.h AS root, coalesce(p, []) AS p,
    list_reduce(list_prepend([d.checked, ''], coalesce(p, [])), lambda a, x: [sha256(x[1] || a[1] || x[2]), ''])[1]
      AS folded_root
  FROM ranked d JOIN roots s ON s.tree = d.tree JOIN high top ON top.n = 1
  LEFT JOIN proof ON proof.tree = d.tree AND proof.leaf_pos = d.pos
)
SELECT doc_id, leaf, subroot, root,
  sha256(coalesce(array_to_string(list_transform(p, lambda x: x[1] || x[2]), ''), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM out
"""

ALNUM = (
    f"list_filter(string_split_regex({LOW}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
)

OP12 = f"""
WITH {CRC},
d AS (SELECT doc_id, {ALNUM} AS w, row_number() OVER () AS r FROM documents),
b AS (SELECT {ALNUM} AS w FROM benchmark),
dw AS (SELECT r, w, count(*) AS c FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS c FROM (SELECT unnest(w) AS w FROM b) GROUP BY ALL),
word AS (
  SELECT w, {crc32('w')} % 10000 AS bucket
  FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc_table
),
total AS (SELECT coalesce((SELECT sum(c) FROM dw), 0)::DOUBLE AS s_all, coalesce((SELECT sum(c) FROM bw), 0)::DOUBLE AS t_all),
s AS (SELECT bucket, sum(c)::DOUBLE AS s FROM dw JOIN word USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(c)::DOUBLE AS t FROM bw JOIN word USING (w) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + 10000)
    / ((coalesce(s, 0) + 1) * (t_all + 10000))))::BIGINT AS g
  FROM s FULL JOIN t USING (bucket), total
),
sums AS (SELECT r, sum(c * g)::HUGEINT AS g FROM dw JOIN word USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_features,
    coalesce(floor(g::DOUBLE / len(w))::BIGINT, 0) AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296)))::BIGINT AS noise
  FROM d LEFT JOIN sums USING (r)
),
ranked AS (
  SELECT *, weight + noise AS score,
    row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id NULLS LAST) AS k
  FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND k <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN k END AS rank
FROM ranked
"""

ORACLE: dict[str, str] = {
    "op1_near_duplicates": OP1,
    "op2_topk": OP2,
    "op8_substring_dedup": OP8,
    "op9_line_dedup": OP9,
    "op11_manifest": OP11,
    "op12_resampling": OP12,
}
