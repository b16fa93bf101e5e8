"""DuckDB SQL of the registered queries that SQL can express.

Near-duplicate groups, embedding groups and repeated strings are stated by
brute force over all pairs or windows (no index, no sampling); the mix by the
closed form of its water filling.  Tokenizers, trained models, entropy scans
and fingerprints of 64-bit hashes have no SQL; their queries are tested
against brute force in ``tests/llm``.
"""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

#: Smallest reachable id over a table links(a, b) of both directions, for every id of a table ids(id).
_COMPONENTS = """
reach(id, root) AS (
  SELECT id, id FROM ids
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id
),
component AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
"""

OP1 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words
),
ids AS (SELECT d.doc_id AS id, count(s.s) AS n FROM documents d LEFT JOIN shingles s USING (doc_id) GROUP BY d.doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id
),
links AS (
  SELECT a, b FROM common JOIN ids i ON i.id = a JOIN ids j ON j.id = b WHERE 100 * c >= 85 * (i.n + j.n - c)
),
{_COMPONENTS}
SELECT ids.id AS doc_id, CAST(ids.n AS BIGINT) AS n_shingles, component_id, ids.id = component_id AS kept
FROM ids JOIN component USING (id)
"""

OP6 = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS tie, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents
),
per AS (
  SELECT source, sum(size) AS source_size, count(*) AS docs,
         (ARRAY[5, 2, 1])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM sized GROUP BY source
),
-- sources close in the order of bound / weight; the first whose bound is no less than its share of what is left stays open
ranked AS (
  SELECT *, coalesce(sum(2 * source_size) OVER w, 0) AS used, (SELECT sum(weight) FROM per) - coalesce(sum(weight) OVER w, 0) AS open_weight
  FROM per WINDOW w AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
level AS (
  SELECT arg_min((1.5 * total - used) / open_weight, nth) AS share
  FROM (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS nth, (SELECT sum(source_size) FROM per) AS total FROM ranked)
  WHERE 2 * source_size * open_weight >= (1.5 * total - used) * weight
),
goal AS (
  SELECT source, source_size, docs, least(2.0 * source_size, coalesce(CAST(share AS DOUBLE) * weight, 2.0 * source_size)) AS target FROM per CROSS JOIN level
),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM goal),
numbered AS (
  SELECT s.*, r.source_size, r.target, rate, rate - floor(rate) AS p,
         ('0x' || substr(d, 1, 8))::BIGINT % 2147483647 AS a, ('0x' || substr(d, 9, 8))::BIGINT % 2147483647 AS b
  FROM (SELECT *, md5('mix' || chr(1) || coalesce(CAST(doc_id AS VARCHAR), '') || chr(1) || tie) AS d FROM sized) s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
),
-- what each of 32 seeds would take of each source; the nearest to the target counts
tried AS (
  SELECT source, k, abs(sum(CASE WHEN ((a * k + b) % 2147483647)::DOUBLE / 2147483647.0::DOUBLE < p THEN size ELSE 0 END) + any_value(floor(rate)) * any_value(source_size) - any_value(target)) AS off
  FROM numbered, range(1, 33) t(k) GROUP BY source, k
),
seeds AS (SELECT source, min(struct_pack(off := off, k := k)).k AS k FROM tried GROUP BY source),
drawn AS (
  SELECT n.*, CAST(floor(rate) + CASE WHEN ((a * k + b) % 2147483647)::DOUBLE / 2147483647.0::DOUBLE < p THEN 1 ELSE 0 END AS BIGINT) AS copies
  FROM numbered n JOIN seeds s ON n.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target, CAST(size * copies AS BIGINT) AS taken, copies
FROM drawn
"""

OP8 = f"""
WITH RECURSIVE rows AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, embedding FROM embeddings),
ids AS (SELECT id FROM rows),
units AS (
  SELECT id, CAST(embedding AS DOUBLE[]) AS v FROM rows
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT x.id AS a, y.id AS b FROM units x JOIN units y ON x.id <> y.id AND len(x.v) = len(y.v) AND CASE WHEN len(x.v) = len(y.v) THEN list_cosine_similarity(x.v, y.v) >= 0.9 END
),
{_COMPONENTS},
degree AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT r.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, t.vec_id AS component_id, coalesce(r.vec_id = t.vec_id, true) AS kept, CAST(1.0 AS DOUBLE) AS audit_recall
FROM rows r JOIN component USING (id) JOIN rows t ON t.id = component_id LEFT JOIN degree ON degree.id = r.id
"""

OP10 = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM texts),
windows AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS w FROM starts),
twice AS (SELECT doc_id, i FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),
-- covered runs: a gap of more than 200 between starts begins a new one
marked AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM twice),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, run, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS a, a AS b FROM runs),
kept AS (
  SELECT g.doc_id, string_agg(substr(t.h, CAST(2 * g.a + 1 AS BIGINT), CAST(2 * (g.b - g.a) AS BIGINT)), '' ORDER BY g.run) AS head
  FROM gaps g JOIN texts t USING (doc_id) GROUP BY g.doc_id
),
total AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last FROM runs GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN removed IS NULL THEN t.h ELSE coalesce(head, '') || substr(t.h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM texts t LEFT JOIN total USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP11 = rf"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM texts WHERE len(w) >= 35),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM starts),
twice AS (SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
marked AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 35 THEN 0 ELSE 1 END AS new FROM twice),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 34 AS b FROM numbered GROUP BY doc_id, run),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM runs),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM texts),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
total AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM texts t LEFT JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)
"""

#: crc32 of a number's decimal digits, bit by bit (the polynomial 0xEDB88320).
_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"""

OP12 = rf"""
WITH turns AS (
  SELECT conv_id, coalesce(text, '') AS text, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC32.format("conv_id")} % 4 AS take FROM (SELECT DISTINCT conv_id FROM turns)),
based AS (SELECT c.*, least(take, (SELECT count(*) FROM turns t WHERE t.conv_id = c.base)) AS taken FROM convs c),
rebuilt AS (
  SELECT c.conv_id, t.pos, h, text FROM based c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.take
  UNION ALL
  SELECT c.conv_id, t.pos - take + taken, h, text FROM based c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.take
),
members AS (
  SELECT conv_id, pos AS depth, string_agg(h, ',') OVER (PARTITION BY conv_id ORDER BY pos) AS node, len(regexp_extract_all(text, '{_WORD}')) AS words FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, '', 0 FROM convs
),
linked AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(depth) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM members
),
nodes AS (
  SELECT node, depth, any_value(parent) AS parent, any_value(words) AS words, min(conv_id) AS owner, count(*) AS n,
         string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS ends
  FROM linked GROUP BY node, depth
),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
-- every node counts for all nodes on its owner's path down to it
below AS (
  SELECT m.node, sum((u.n - 1) * u.words) AS saved, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS leaves
  FROM full_nodes u JOIN members m ON m.conv_id = u.owner AND m.depth <= u.depth GROUP BY m.node
)
SELECT v.owner AS conv_id, CAST(v.depth AS BIGINT) AS depth, p.owner AS parent_conv_id, CAST(v.n AS BIGINT) AS n_convs, CAST(v.n_children AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM full_nodes v JOIN below USING (node) LEFT JOIN nodes p ON p.node = v.parent
"""

#: Parts to their nearest entry of the codebooks {0}; then the codebooks after a round.
_ASSIGNED = """near{0} AS MATERIALIZED (
  SELECT vec_id, copy, length, part, v, min({{'d': CAST(coalesce(list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - e[i]) * (v[i] - e[i]))), 0) AS BIGINT), 'entry': entry}}) AS best
  FROM parts JOIN books{0} USING (length, part) GROUP BY vec_id, copy, length, part, v
)"""
_ROUND = (
    _ASSIGNED
    + """,
sums{0} AS (
  SELECT length, part, entry, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT length, part, best.entry AS entry, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM near{0}) GROUP BY length, part, entry, i
),
moved{0} AS (SELECT length, part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM sums{0} GROUP BY length, part, entry),
books{1} AS MATERIALIZED (SELECT length, part, entry, coalesce(m.e, b.e) AS e FROM books{0} b LEFT JOIN moved{0} m USING (length, part, entry))"""
)

OP13 = f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER () AS copy, len(embedding) AS length, embedding,
         list_transform(embedding, lambda x: CAST(greatest(least(floor(256 * CAST(x AS DOUBLE)), 67108864), -67108864) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (SELECT vec_id, copy, length, part, v[part * length // 16 + 1 : (part + 1) * length // 16] AS v FROM kept, range(16) p(part)),
firsts AS (SELECT copy, row_number() OVER (PARTITION BY length ORDER BY vec_id NULLS LAST, embedding) - 1 AS entry FROM kept),
books0 AS MATERIALIZED (SELECT length, part, entry, v AS e FROM parts JOIN firsts USING (copy) WHERE entry < 64),
{_ROUND.format(0, 1)},
{_ROUND.format(1, 2)},
{_ASSIGNED.format(2)},
digests AS (
  SELECT length, sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books2 WHERE len(e) > 0 GROUP BY length
),
coded AS (
  SELECT copy, length, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near2 GROUP BY copy, length
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, coalesce(codebooks_sha256, sha256('')) AS codebooks_sha256
FROM coded JOIN kept USING (copy, length) LEFT JOIN digests USING (length)
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per query key."""
    return {"op1_hyperminhash": OP1, "op6_source_mix": OP6, "op8_flat_graph": OP8, "op10_suffix_dedup": OP10, "op11_recompression": OP11, "op12_prefix_trie": OP12, "op13_orchard": OP13}
