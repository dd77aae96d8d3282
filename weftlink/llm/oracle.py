"""SQL for the training-data queries that it can express."""

from __future__ import annotations

from .licenses import BY_LINE, RULES, SENTENCES, WITHIN, WRAPPED
from .queries import SHARD_BYTES

OP1 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY n ORDER BY doc_id) = 1 AS kept, sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n)
"""

# Base 32 by groups of five bits; SHA-1 is 32 of them.
OP5 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p),
d AS (
  SELECT *, sha1(h) AS x FROM f
), e AS (
  SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(x, 1 + 5 * i, 5))::BIGINT) AS q FROM d
)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda j:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((q[1 + j // 4] >> (15 - 5 * (j % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM e
"""

OP6 = f"""
WITH t AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
                  ('0x' || substr(md5('shard:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
b AS (SELECT d::INT AS depth, h >> (60 - d)::INT AS bucket, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs,
             min(h) = max(h) AS one
      FROM t, range(0, 61) r(d) GROUP BY ALL),
f AS (SELECT t.doc_id, t.n_bytes, t.h, b.depth, b.shard_bytes, b.shard_docs,
             row_number() OVER (PARTITION BY t.doc_id, t.h ORDER BY b.depth) AS k
      FROM t, b WHERE b.bucket = t.h >> (60 - b.depth) AND (b.shard_bytes <= {SHARD_BYTES} OR b.one))
SELECT doc_id, n_bytes, substr(lpad(bin(h), 60, '0'), 1, depth) AS shard, depth, shard_bytes, shard_docs FROM f WHERE k = 1
"""

# A share is the least of what its source may give and its part of what the
# capped sources leave: sources join the capped ones in the order of size by weight.
OP8 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS ticket FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS k, sum(source_size) OVER () AS total FROM s),
c AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
             sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM o),
l AS (SELECT min(k) AS k FROM c WHERE (total - used) * w <= 3 * source_size * free),
r AS (SELECT used AS u, free AS f FROM c, l WHERE c.k = l.k),
g AS (SELECT source, source_size, CASE WHEN c.k < l.k THEN (3 * source_size)::DOUBLE
             ELSE ((total - u) * w)::BIGINT::DOUBLE / f::BIGINT END AS target
      FROM c, l LEFT JOIN r ON true),
x AS (SELECT d.doc_id, d.size, g.source_size, g.target, floor(g.target)::BIGINT AS q,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ticket, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (q // source_size) * size + greatest(0, least(size, q % source_size - ahead)) END::BIGINT AS taken
FROM x
"""


def _op10() -> str:
    known = ", ".join(f"'{text}': {key}" for key, text in SENTENCES.items())

    def cut(ends: str) -> str:
        plain = f"trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{ends}', '|', 'g'), '[^a-z0-9|]+', ' ', 'g'))"
        return f"list_filter(string_split_regex({plain}, '[ |]*\\|[ |]*'), lambda s: s <> '')"

    def ids(column: str) -> str:
        return f"array_to_string(list_filter(list_transform({column}, lambda s: (SELECT m FROM k)[s]), lambda x: x IS NOT NULL), ',')"

    def holds(name: str, column: str) -> str:
        hit = " OR ".join(f"contains({column}, ',{','.join(map(str, rule))},')" for rule in RULES[name])
        return f"(({hit}) AND NOT {holds(WITHIN[name], column)})" if name in WITHIN else f"({hit})"

    names = ", ".join(f"CASE WHEN {holds(n, 'a')} OR {holds(n, 'b')} THEN '{n}' END" for n in sorted(RULES))
    looked = lambda c: f"array_to_string(list_filter(list_transform({c}, lambda s: MAP {{{known}}}[s]), lambda x: x IS NOT NULL), ',')"
    return f"""
WITH s AS (SELECT doc_id, {cut(WRAPPED)} AS w, {cut(BY_LINE)} AS l FROM documents),
i AS (SELECT doc_id, len(l)::BIGINT AS n_sentences, coalesce({looked('w')}, '') AS sentence_ids, coalesce({looked('l')}, '') AS line_ids FROM s),
r AS (SELECT *, ',' || sentence_ids || ',' AS a, ',' || line_ids || ',' AS b FROM i)
SELECT doc_id, n_sentences, sentence_ids, line_ids, coalesce(array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ','), '') AS licenses FROM r
"""


# CRC-32 by a table of 256 entries, a byte at a time. Neighbours have a deletion
# or a word with one letter blanked out in common.
OP11 = r"""
WITH RECURSIVE t0 AS (SELECT range::BIGINT AS i, range::BIGINT AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM t0 WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM t0 WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs),
each AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS key, run, count(*) AS n FROM low GROUP BY ALL),
bytes AS (SELECT *, hex(encode(key)) AS x FROM each),
sums AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i::INT + 1, 2))::BIGINT)),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h FROM bytes, crc),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM sums),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest, substr(word, 1, i::INT) || '*' || substr(word, i::INT + 2) AS blank
        FROM (SELECT word, unnest(range(0, length(word))) AS i FROM w)),
pairs AS MATERIALIZED (SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.blank = b.blank AND a.word <> b.word
          UNION SELECT word, rest FROM cut WHERE rest IN (SELECT word FROM w)
          UNION SELECT rest, word FROM cut WHERE rest IN (SELECT word FROM w)),
best AS (SELECT p.word, count(*) AS n_near, arg_min(p.near, (-x.n, p.near)) AS near, max(x.n) AS near_n FROM pairs p JOIN w x ON x.word = p.near GROUP BY p.word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
      FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN last USING (word)
"""

ORACLE: dict[str, str] = {
    "op1_exact_dedup": OP1,
    "op5_warc": OP5,
    "op6_sharding": OP6,
    "op8_mixing": OP8,
    "op10_license_scan": _op10(),
    "op11_spelling_variants": OP11,
}
