"""DuckDB SQL for those queries that it can express over whole tables."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE = r"[\x20\x09-\x0D]+"

#: Quality rules. Lines are normalised by lower() as in the operator; limits as its parameters.
OP4 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '{SPACE}'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT r, i, list_aggregate(ws[i:i + 4], 'string_agg', ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w) x),
twice AS (SELECT r, gram FROM g GROUP BY r, gram HAVING count(*) > 1),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT g.r, unnest(range(g.i, g.i + 5)) AS p FROM g JOIN twice USING (r, gram)) x GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
n AS (SELECT d.source, d.t, trim(regexp_replace(lower(x), '{SPACE}', ' ', 'g'), ' ') AS line, x, d.r FROM (SELECT r, unnest(ls) AS x FROM l) u JOIN d USING (r)),
f AS (SELECT source, line FROM (SELECT source, line, count(DISTINCT t) AS docs FROM n GROUP BY source, line) c JOIN (SELECT source AS s, count(DISTINCT t) AS texts FROM d GROUP BY source) z ON c.source IS NOT DISTINCT FROM z.s WHERE docs > greatest(20, 2.0 * sqrt(texts))),
gone AS (SELECT r, sum(len(list_filter(regexp_split_to_array(x, '{SPACE}'), lambda y: y <> ''))) AS n FROM n JOIN f ON n.source IS NOT DISTINCT FROM f.source AND n.line = f.line GROUP BY r),
a AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(hit.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
    FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN hit USING (r) LEFT JOIN gone USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND NOT (n_words - removed_words < 0.3 * n_words) AS kept FROM b"""

#: Decontamination: every window of an item as words, joined with the documents' windows of that many words.
OP8 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array({LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array({LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
v AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT item_id, ws, least(13, len(ws)) AS k, unnest(range(1, greatest(2, len(ws) - 11))) AS i FROM b WHERE len(ws) > 0) x),
p AS (SELECT r, i, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM v) s WHERE len(ws) >= k) x),
h AS (SELECT r, i, p.k, item_id FROM p JOIN v ON p.k = v.k AND p.win = v.win),
n AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(i, i + k)) AS q FROM h) x GROUP BY r),
m AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
    coalesce(n.n, 0) > 0 AND 20 * coalesce(n.n, 0) >= len(ws) AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)"""

#: Components: documents that share a shingle, whole intersections, and reachability.
OP10 = rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER}, '{SPACE}'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) AS i FROM d WHERE len(ws) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
c AS (SELECT doc_id AS root, doc_id AS node FROM documents UNION SELECT c.root, e.b FROM c JOIN e ON e.a = c.node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(c.node) AS component_id FROM d JOIN c ON c.root = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n"""



def _op13(clusters: int = 40, rounds: int = 5) -> str:
    """Clustering: vectors as (r, i, x), centroids of round k as c<k>(j, i, x), assignments as a<k>(r, j, d)."""
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        "x AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS i, unnest(v) AS x FROM v)",
        f"s AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS j FROM v QUALIFY j < {clusters})",
        "c0 AS MATERIALIZED (SELECT j, i, x FROM s JOIN x USING (r))",
    ]
    for k in range(rounds + 1):
        parts.append(f"a{k} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, j := j)) AS m FROM (SELECT r, j, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d FROM x JOIN c{k} c USING (i) GROUP BY r, j) y GROUP BY r)")
        if k < rounds:
            parts.append(f"""c{k + 1} AS MATERIALIZED (SELECT j, i, coalesce(n.x, c.x) AS x FROM c{k} c LEFT JOIN
                (SELECT m.j AS j, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM a{k} JOIN x USING (r) GROUP BY m.j, i) n USING (j, i))""")
    return f"""WITH {", ".join(parts)}, h AS (SELECT j, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY j)
    SELECT vec_id, m.j::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.j))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM v JOIN a{rounds} USING (r) JOIN h ON h.j = m.j"""


ORACLES: dict[str, str] = {"op13_hamerly_clusters": _op13(), "op4_quality_rules": OP4, "op8_decontaminate": OP8, "op10_jaccard_components": OP10}
