"""SQL twins for DuckDB of those queries that SQL can express."""

from __future__ import annotations

TOPK = """
WITH usable AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM usable q JOIN usable c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

# crc32 half a byte at a time. The remainders of the sixteen halves under the reversed
# polynomial 0xEDB88320.
HALVES = (
    "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, "
    "3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
)
SHARDS = f"""
WITH sized AS (
    SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size,
           string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\\2\\1', 'g'), '') AS halves FROM documents),
coded AS (
    SELECT doc_id, size, list_transform(list_filter(halves, lambda x: x <> ''), lambda x:
        instr('0123456789ABCDEF', x)::BIGINT - 1) AS b FROM sized),
summed AS MATERIALIZED (
    SELECT doc_id, size, xor(4294967295, list_reduce(b, lambda c, x:
        xor(c >> 4, {HALVES}[(xor(c, x) & 15) + 1]), 4294967295))::BIGINT AS text_crc32 FROM coded),
placed AS (
    SELECT *, (sum(size) OVER w)::HUGEINT AS done, (sum(size) OVER ())::HUGEINT AS total, row_number() OVER w AS nth
    FROM summed WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING)),
dealt AS (SELECT *, least(7, (2 * done - size) * 8 // (2 * total))::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, nth - min(nth) OVER (PARTITION BY shard) AS slot,
       NULL::INTEGER AS grown_shard FROM dealt
"""

JACCARD = r"""
WITH RECURSIVE tokens AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS MATERIALIZED (
    SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g1, md5_number(array_to_string(w[i:i + 4], ' ')) AS g2
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM tokens WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b USING (g1, g2)
    WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (
    SELECT a, a FROM both_ways UNION SELECT r.doc_id, e.b FROM reached r JOIN both_ways e ON e.a = r.other),
tops AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id),
equals AS (
    SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE k = x.n AND k = y.n),
classes AS MATERIALIZED (
    SELECT doc_id, coalesce(first, doc_id) AS class_id FROM documents LEFT JOIN (SELECT b AS doc_id, min(a) AS first FROM equals GROUP BY b)
    USING (doc_id)),
counted AS (
    SELECT x.doc_id, count(DISTINCT y.class_id) AS n_links FROM both_ways l JOIN classes x ON x.doc_id = l.a
    JOIN classes y ON y.doc_id = l.b WHERE x.class_id <> y.class_id GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, class_id,
       coalesce(n_links, 0) AS n_links
FROM documents d JOIN classes USING (doc_id) LEFT JOIN sizes USING (doc_id) LEFT JOIN tops USING (doc_id) LEFT JOIN counted USING (doc_id)
"""

REPEATS = """
WITH bytes AS MATERIALIZED (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
windows AS (
    SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS w
    FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM bytes)),
marked AS MATERIALIZED (
    SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS first FROM windows)
    WHERE first < doc_id),
runs AS (
    SELECT doc_id, i, sum(CASE WHEN i - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
    FROM (SELECT doc_id, i, lag(i, 1, -100) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM marked)),
spans AS MATERIALIZED (
    SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b,
           lag(max(i) + 50, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS kept_from FROM runs GROUP BY doc_id, run),
cut AS (
    SELECT s.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
           string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY run) AS head, max(b) AS last
    FROM spans s JOIN bytes USING (doc_id) GROUP BY s.doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM bytes LEFT JOIN cut USING (doc_id)
"""

COLLOCATIONS = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
counted AS MATERIALIZED (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) AS t(k) WHERE len(w) >= k)
    GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, k)) AS c FROM candidates),
scored AS (
    SELECT x.lang, x.phrase, x.a, x.c, h.f AS l, t.f AS r, ((2000000::HUGEINT * x.a) // (h.f::HUGEINT + t.f))::BIGINT AS score
    FROM cuts x JOIN counted h ON h.lang = x.lang AND h.phrase = array_to_string(x.w[1:x.c], ' ')
    JOIN counted t ON t.lang = x.lang AND t.phrase = array_to_string(x.w[x.c + 1:x.k], ' ')),
weakest AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS place FROM scored) WHERE place = 1),
inside AS (
    SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (
            SELECT lang, a, w, k, m, unnest(range(1, k - m + 2)) AS i FROM candidates, (VALUES (2), (3)) AS t(m) WHERE m < k))
    GROUP BY ALL),
ranked AS (
    SELECT x.*, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, encode(x.phrase)) AS rank
    FROM weakest x LEFT JOIN inside i ON i.lang = x.lang AND i.phrase = x.phrase
    WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

_LENGTHS = ", ".join(
    f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')" for x in ("doc_id", "source", "lang"))
MERKLE = f"""
WITH RECURSIVE coded AS (
    SELECT *, list_transform(list_filter(string_split(regexp_replace(hex(encode(doc_id::VARCHAR)), '(.)(.)', '\\2\\1', 'g'), ''),
        lambda x: x <> ''), lambda x: instr('0123456789ABCDEF', x)::BIGINT - 1) AS b FROM documents),
drawn AS (
    SELECT *, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 4, {HALVES}[(xor(c, x) & 15) + 1]), 4294967295))::BIGINT % 7 = 0
        AS tampered FROM coded),
leaves AS MATERIALIZED (
    SELECT doc_id, lang, sha256(concat({_LENGTHS}, {{0}}, {{2}})) AS leaf,
           CASE WHEN tampered THEN sha256(concat({_LENGTHS}, {{1}}, {{2}})) ELSE sha256(concat({_LENGTHS}, {{0}}, {{2}})) END AS other
    FROM drawn),
ranked AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
    FROM leaves),
nodes(lang, level, idx, n, digest) AS (
    SELECT lang, 0, idx, n, leaf FROM ranked
    UNION ALL
    SELECT lang, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1
    GROUP BY lang, level, n, idx // 2),
subroots AS MATERIALIZED (
    SELECT lang, level, digest AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS idx, count(*) OVER () AS n
    FROM nodes WHERE n = 1),
upper_nodes(level, idx, n, digest) AS (
    SELECT 0, idx, n, subroot FROM subroots
    UNION ALL
    SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM upper_nodes WHERE n > 1
    GROUP BY level, n, idx // 2),
lower_nodes AS MATERIALIZED (SELECT * FROM nodes),
higher_nodes AS MATERIALIZED (SELECT * FROM upper_nodes),
walk(doc_id, lang, idx0, level, idx, n, proof, folded) AS (
    SELECT doc_id, lang, idx, 0, idx, n, '', other FROM ranked
    UNION ALL
    SELECT w.doc_id, w.lang, w.idx0, w.level + 1, w.idx // 2, (w.n + 1) // 2, w.proof || coalesce(s.digest, ''),
           sha256(CASE WHEN w.idx % 2 = 0 THEN w.folded || coalesce(s.digest, '') ELSE s.digest || w.folded END)
    FROM walk w LEFT JOIN lower_nodes s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.idx = xor(w.idx, 1)
    WHERE w.n > 1),
climb(doc_id, lang, idx0, level, idx, n, proof, folded) AS (
    SELECT w.doc_id, w.lang, w.idx0, 0, r.idx, r.n, w.proof, w.folded
    FROM walk w JOIN subroots r ON r.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
    UNION ALL
    SELECT w.doc_id, w.lang, w.idx0, w.level + 1, w.idx // 2, (w.n + 1) // 2, w.proof || coalesce(s.digest, ''),
           sha256(CASE WHEN w.idx % 2 = 0 THEN w.folded || coalesce(s.digest, '') ELSE s.digest || w.folded END)
    FROM climb w LEFT JOIN higher_nodes s ON s.level = w.level AND s.idx = xor(w.idx, 1) WHERE w.n > 1),
top AS (SELECT digest AS root FROM higher_nodes WHERE n = 1)
SELECT w.doc_id, k.leaf, r.subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM climb w JOIN ranked k ON k.lang IS NOT DISTINCT FROM w.lang AND k.idx = w.idx0
JOIN subroots r ON r.lang IS NOT DISTINCT FROM w.lang, top WHERE w.n = 1
""".format(
    "coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-')",
    "coalesce(strlen((n_chars + 1)::VARCHAR)::VARCHAR || ':' || (n_chars + 1)::VARCHAR, '-')",
    "coalesce(strlen(text)::VARCHAR || ':' || text, '-')")

WARC = """
WITH paid AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
digested AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS best FROM paid),
coded AS (
    SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest
    FROM digested)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to FROM coded
"""

ORACLES: dict[str, str] = {
    "op1_topk_search": TOPK,
    "op3_sharding": SHARDS,
    "op6_jaccard_join": JACCARD,
    "op9_suffix_dedup": REPEATS,
    "op11_collocations": COLLOCATIONS,
    "op12_merkle": MERKLE,
    "op13_warc": WARC,
}
