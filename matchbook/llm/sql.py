"""DuckDB SQL of the subpackage's queries, where SQL can express them."""

ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WHITE_WORD = r"'[^\x20\x09-\x0D]+'"

OP1 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ''
                                  ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(24 + length(replace(replace(replace(role, '\', '\b'), '<|', '<\p'), chr(10), '\n'))
                + length(replace(replace(text, '\', '\b'), '<|', '<\p'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP3 = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n,
         array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM iw WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, size WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dwin JOIN win USING (n, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS s
  FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 AS BIGINT) - 49)) AS i FROM d WHERE length(h) >= 100)),
seen AS (SELECT s, min(doc_id) AS low FROM starts GROUP BY s),
hit AS (SELECT doc_id, i FROM starts JOIN seen USING (s) WHERE low < doc_id),
run AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r
  FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh
        FROM hit)),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, r),
piece AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_, a AS to_ FROM span),
kept AS (
  SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, max(b) AS last,
         string_agg(substr(h, 2 * from_ + 1, 2 * (to_ - from_)), '' ORDER BY a) AS head
  FROM piece JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP7 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {WHITE_WORD})), 0) AS size,
         CAST('0x' || substr(md5('mix|0|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '')
                                 || '|' || coalesce(md5(text), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid
      FROM d GROUP BY source),
w AS (SELECT *, CAST((sid - 1) % 3 + 1 AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())
             - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT *, coalesce(least(cap, w * (SELECT min_by(level, cap / w) FROM l WHERE cap / w > level)), cap) AS target FROM l),
p AS (
  SELECT doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS quota,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE (quota // source_size) * size
            + greatest(0, least(place + size, quota % source_size) - place) END AS BIGINT) AS taken
FROM p
"""

OP8 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({ASCII_LOWER}, {WHITE_WORD}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (
  SELECT a, b FROM link
  UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(min(b), doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON a = doc_id GROUP BY doc_id, n
"""

OP9 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

def crc32_of(utf8: str) -> str:
    """Unsigned CRC-32 of a text expression's UTF-8 bytes, bit by bit."""
    digit = lambda k: f"(instr('0123456789ABCDEF', substr(hx, 2 * i + {k}, 1)) - 1)"
    codes = f"list_transform(range(0, length(hx) // 2), lambda i: {digit(1)} * 16 + {digit(2)})"
    step = "lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
    crc = (f"list_reduce(list_concat([4294967295], {codes}), lambda c, b: "
           f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {step}))")
    return f"(SELECT xor({crc}, 4294967295) FROM (SELECT hex(encode({utf8})) AS hx))"


def tree_levels(name: str, nodes: str, paths: str, depth: int) -> str:
    """CTEs of ``depth`` levels over nodes (tree, pos, d) and the way of paths (id, tree, at_,
    cur, proof) through them; a tree that has one node left stays as it is."""
    out = []
    for k in range(depth):
        out.append(f"""
{name}r{k} AS (SELECT tree, pos // 16 AS up, list(d ORDER BY pos) AS ds, any_value(n) > 1 AS more
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {nodes}) GROUP BY tree, pos // 16),
{name}n{k} AS (SELECT tree, up AS pos, CASE WHEN more THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d
  FROM {name}r{k}),
{name}p{k} AS (SELECT id, tree, place // 16 AS place, CASE WHEN more THEN sha256(a || cur || b) ELSE cur END AS cur,
  CASE WHEN more THEN proof || a || b ELSE proof END AS proof
  FROM (SELECT p.*, more, array_to_string(ds[1:place % 16], '') AS a, array_to_string(ds[place % 16 + 2:], '') AS b
        FROM {paths} p JOIN {name}r{k} r ON r.tree = p.tree AND r.up = p.place // 16))""")
        nodes, paths = f"{name}n{k}", f"{name}p{k}"
    return ",".join(out)


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"


LOWER_TEXT = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))

# Trees of up to 16 ** 6 leaves a source and 16 ** 3 sources.
OP11 = f"""
WITH rows AS (
  SELECT row_number() OVER () AS id, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         sha256({_LEAF} || {_field('text')}) AS leaf,
         CASE WHEN {crc32_of("coalesce(CAST(doc_id AS VARCHAR), '')")} % 5 = 0 AND doc_id IS NOT NULL
              THEN sha256({_LEAF} || {_field(LOWER_TEXT)}) END AS changed
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos FROM rows),
leaves AS (SELECT tree, pos, leaf AS d FROM placed),
start AS (SELECT id, tree, pos AS place, coalesce(changed, leaf) AS cur, '' AS proof FROM placed),
{tree_levels('s', 'leaves', 'start', 6)},
subroots AS (SELECT 0 AS tree, tree AS pos, d FROM sn5),
further AS (SELECT id, 0 AS tree, tree AS place, cur, proof FROM sp5),
{tree_levels('t', 'subroots', 'further', 3)}
SELECT doc_id, leaf, s.d AS subroot, r.d AS root, sha256(p.proof) AS proof_sha256, p.cur AS folded_root,
       p.cur = r.d AS verified
FROM placed JOIN tp2 p USING (id) JOIN sn5 s ON s.tree = placed.tree CROSS JOIN tn2 r
"""

# Near words share a pattern with one place open, or one is the other with a letter deleted.
OP12 = f"""
WITH runs AS (
  SELECT doc_id, unnest(regexp_extract_all({LOWER_TEXT}, '[a-zÀ-ÿ]+')) AS w FROM documents),
found AS (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY doc_id, w),
hashed AS (SELECT *, {crc32_of("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM found),
words AS (
  SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2)
           ELSE w END AS w, n FROM hashed)
  WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5),
places AS (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM words),
masks AS (SELECT w, substr(w, 1, i - 1) || '*' || substr(w, i + 1) AS m FROM places),
cuts AS (SELECT DISTINCT w, substr(w, 1, i - 1) || substr(w, i + 1) AS m FROM places),
near AS (
  SELECT a.w, b.w AS v FROM masks a JOIN masks b USING (m) WHERE a.w <> b.w
  UNION SELECT c.w, x.w FROM cuts c JOIN words x ON c.m = x.w
  UNION SELECT x.w, c.w FROM cuts c JOIN words x ON c.m = x.w),
best AS (
  SELECT p.w, count(*) AS n_near, arg_min(p.v, (-y.n, p.v)) AS v, max(y.n) AS m
  FROM near p JOIN words y ON y.w = p.v GROUP BY p.w),
forms AS (
  SELECT x.w, x.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * x.n THEN v END AS form,
         CASE WHEN m >= 5 * x.n THEN m END AS form_n
  FROM words x LEFT JOIN best USING (w)),
RECURSIVE_CHAIN
SELECT w AS word, form, arg_max(r, step) AS root, n, n_near, form_n
FROM chain JOIN forms USING (w) GROUP BY w, form, n, n_near, form_n
""".replace("WITH runs", "WITH RECURSIVE runs", 1).replace("RECURSIVE_CHAIN", """chain AS (
  SELECT w, w AS r, 0 AS step FROM forms
  UNION ALL SELECT c.w, f.form, c.step + 1 FROM chain c JOIN forms f ON f.w = c.r WHERE f.form IS NOT NULL)""")

OP13 = """
WITH rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
raw AS (
  SELECT row_number() OVER () AS id, page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM raw),
pages_ AS (
  SELECT id, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM cut),
fits AS (
  SELECT id, r.host || r.path AS rule, verdict,
         row_number() OVER (PARTITION BY id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM pages_ p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM pages_ LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (id)
"""


ORACLE = {"op1_chat_formatting": OP1, "op3_benchmark_decontamination": OP3, "op6_suffix_dedup": OP6,
          "op7_source_mixing": OP7, "op8_jaccard_join": OP8, "op9_exact_dedup": OP9,
          "op11_merkle_manifest": OP11, "op12_spelling_variants": OP12, "op13_url_filter": OP13}
