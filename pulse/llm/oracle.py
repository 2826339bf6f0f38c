"""SQL with the same results as the queries that SQL can express."""

from __future__ import annotations

#: Words of a text, as everywhere in the subpackage.
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

OP10 = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s
    FROM words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
    SELECT a.doc_id AS u, b.doc_id AS v, a.n AS n, b.n AS m, count(*) AS c
    FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (SELECT u, v FROM common WHERE 100 * c >= 80 * (n + m - c)),
reach AS (
    SELECT doc_id AS node, doc_id AS seen FROM documents
    UNION SELECT reach.node, links.v FROM reach JOIN links ON reach.seen = links.u
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM sets s JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) r ON s.doc_id = r.node
"""

#: 16 shards and the least prime from 1601 on. A turn's claim is its shard's first slot that nobody has.
OP2 = """
WITH RECURSIVE shards AS (
    SELECT i::BIGINT AS i, 'shard-' || lpad(i::VARCHAR, 3, '0') AS shard,
        ('0x' || substr(md5('shard-' || lpad(i::VARCHAR, 3, '0') || '/offset'), 1, 15))::BIGINT % 1601 AS o,
        ('0x' || substr(md5('shard-' || lpad(i::VARCHAR, 3, '0') || '/step'), 1, 15))::BIGINT % 1600 + 1 AS s
    FROM range(16) t(i)
), prefs AS MATERIALIZED (SELECT i, (o + j * s) % 1601 AS slot, j FROM shards, range(1601) t(j)),
claims AS (
    SELECT 0::BIGINT AS turn, slot::BIGINT AS slot, NULL::BIGINT AS owner FROM range(1601) t(slot)
    UNION ALL
    SELECT turn + 1, slot, CASE WHEN owner IS NULL AND j = min(CASE WHEN owner IS NULL THEN j END) OVER () THEN i ELSE owner END
    FROM claims JOIN prefs USING (slot) WHERE i = turn % 16 AND turn < 1601
), slots AS (SELECT slot, owner AS i FROM claims WHERE turn = 1601),
keys AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0))), 1, 15))::BIGINT % 1601 AS slot FROM documents)
SELECT doc_id, slot, shard FROM keys JOIN slots USING (slot) JOIN shards USING (i)
"""

OP3 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
r AS (SELECT h, max(page_id) AS response FROM d WHERE n >= 1000 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
    CASE WHEN n >= 1000 AND response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 1000 AND response <> page_id THEN response END AS refers_to
FROM d LEFT JOIN r USING (h)
"""

OP5 = f"""
WITH words AS (
    SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), starts AS (
    SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM words WHERE len(w) >= 13
), windows AS (SELECT doc_id, p, array_to_string(w[p:p+12], ' ') AS g FROM starts),
firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g),
hit AS (SELECT doc_id, p FROM windows JOIN firsts USING (g) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM hit, range(0, 13) t(k)),
lists AS (SELECT doc_id, list(p) AS gone FROM gone GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
    sha256(coalesce(array_to_string(list_transform(
        list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: w[i]), ' '), '')) AS kept_sha256
FROM words LEFT JOIN lists USING (doc_id)
"""

_TERMS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""

OP11 = f"""
WITH items AS (SELECT row_number() OVER () AS no, item_id, text FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
lengths AS (SELECT r, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
total AS (SELECT count(*)::HUGEINT AS docs, sum(n)::HUGEINT AS words FROM lengths),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS t FROM d) GROUP BY ALL),
q AS (SELECT no, t, count(*)::BIGINT AS c FROM (SELECT no, unnest({_TERMS}) AS t FROM items) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total WHERE t IN (SELECT t FROM q) GROUP BY t, docs),
scores AS (
    SELECT no, r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
    FROM q JOIN w USING (t) JOIN tf USING (t) JOIN lengths USING (r), total GROUP BY no, r
), ranks AS (
    SELECT no, r, score, row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores JOIN lengths USING (r) WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranks JOIN items USING (no) JOIN lengths USING (r) WHERE rank <= 20
"""

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _part(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


#: The trees level by level, then each row's way up to its subroot and on to the root. crc32 is worked out bit by bit.
OP12 = f"""
WITH RECURSIVE given AS (
    SELECT row_number() OVER () AS r, doc_id, source,
        sha256({_part("doc_id")} || {_part("source")} || {_part("lang")} || {_part("n_chars")} || {_part("text")}) AS leaf,
        sha256({_part("doc_id")} || {_part("source")} || {_part("lang")} || {_part("n_chars")} || {_part(_LOW)}) AS low,
        coalesce(xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
            lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 5 = 0, false) AS changed
    FROM documents
), placed AS (
    SELECT *, coalesce('s' || source, '-') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
        count(*) OVER (PARTITION BY source) AS n FROM given
), tree AS (
    SELECT g, source, 0 AS level, p, n, leaf AS h FROM placed
    UNION ALL
    SELECT g, source, level + 1, p // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY p)) FROM tree WHERE n > 1 GROUP BY g, source, level, p // 16, n
), subroots AS (
    SELECT g, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
    SELECT 0 AS level, p, n, subroot AS h FROM subroots
    UNION ALL
    SELECT level + 1, p // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY p)) FROM top WHERE n > 1 GROUP BY level, p // 16, n
), runs AS (
    SELECT g, level, p // 16 AS run, list(h ORDER BY p) AS hs FROM tree WHERE n > 1 GROUP BY g, level, p // 16
), top_runs AS (
    SELECT level, p // 16 AS run, list(h ORDER BY p) AS hs FROM top WHERE n > 1 GROUP BY level, p // 16
), walk AS (
    SELECT r, g, 0 AS level, p, CASE WHEN changed THEN low ELSE leaf END AS h, '' AS proof FROM placed
    UNION ALL
    SELECT r, g, level + 1, p // 16, sha256(array_to_string(hs[1:p % 16], '') || h || array_to_string(hs[p % 16 + 2:], '')),
        proof || array_to_string(hs[1:p % 16], '') || array_to_string(hs[p % 16 + 2:], '')
    FROM walk JOIN runs USING (g, level) WHERE run = p // 16
), below AS (SELECT r, g, h, proof FROM walk QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1),
climb AS (
    SELECT r, 0 AS level, p, h, proof, subroot FROM below JOIN subroots USING (g)
    UNION ALL
    SELECT r, level + 1, p // 16, sha256(array_to_string(hs[1:p % 16], '') || h || array_to_string(hs[p % 16 + 2:], '')),
        proof || array_to_string(hs[1:p % 16], '') || array_to_string(hs[p % 16 + 2:], ''), subroot
    FROM climb JOIN top_runs USING (level) WHERE run = p // 16
), ends AS (SELECT r, h, proof, subroot FROM climb QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1)
SELECT doc_id, leaf, subroot, top.h AS root, sha256(proof) AS proof_sha256, ends.h AS folded_root, ends.h = top.h AS verified
FROM given JOIN ends USING (r) JOIN top ON top.n = 1
"""

SQL: dict[str, str] = {"op2_sharding": OP2, "op3_warc": OP3, "op5_substring_dedup": OP5, "op10_minhash": OP10, "op11_ranked_search": OP11, "op12_manifest": OP12}
