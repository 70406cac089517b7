"""The queries of queries.py that SQL can state, for DuckDB over whole tables."""

ORACLES = {
    "p2_found": """
        WITH a AS (SELECT DISTINCT id, entities FROM articles),
        t AS (SELECT DISTINCT id, lower(trim(regexp_replace(e, '\\s+', ' ', 'g'))) AS e FROM (SELECT id, unnest(entities) AS e FROM a) WHERE e IS NOT NULL AND trim(e) <> ''),
        s AS (SELECT id, count(*) AS n FROM t GROUP BY id HAVING count(*) >= 3),
        o AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS c FROM t x JOIN t y ON x.e = y.e AND x.id < y.id GROUP BY 1, 2)
        SELECT id_a, id_b FROM o JOIN s sa ON sa.id = id_a JOIN s sb ON sb.id = id_b WHERE c >= 0.6 * (sa.n + sb.n - c) - 1e-9
    """,
    "p2_classes": """
        WITH a AS (SELECT DISTINCT id, entities FROM articles),
        t AS (SELECT DISTINCT id, lower(trim(regexp_replace(e, '\\s+', ' ', 'g'))) AS e FROM (SELECT id, unnest(entities) AS e FROM a) WHERE e IS NOT NULL AND trim(e) <> ''),
        s AS (SELECT id, md5(string_agg(e, chr(31) ORDER BY e)) AS class, count(*) AS n FROM t GROUP BY id HAVING count(*) >= 3),
        r AS (SELECT class, min(id) AS id, any_value(n) AS n FROM s GROUP BY class), u AS (SELECT r.class, r.n, t.e FROM r JOIN t ON t.id = r.id),
        o AS (SELECT x.class AS a, y.class AS b, x.n AS na, y.n AS nb, count(*) AS c FROM u x JOIN u y ON x.e = y.e AND x.class <> y.class GROUP BY 1, 2, 3, 4),
        l AS (SELECT a AS class, count(*) AS links FROM o WHERE c >= 0.6 * (na + nb - c) - 1e-9 GROUP BY 1)
        SELECT s.id, s.class, coalesce(l.links, 0) AS links FROM s LEFT JOIN l ON l.class = s.class
    """,
    "p5_found": """
        WITH a AS (SELECT DISTINCT id, source_domain, content FROM articles),
        s AS (SELECT id, source_domain, string_split(content, chr(10)) AS lines FROM a),
        l AS (SELECT id, source_domain, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS line_no FROM s),
        k AS (SELECT id, source_domain, line_no, regexp_replace(lower(line), '[^\\p{L}]', '', 'g') AS key FROM l),
        c AS (SELECT source_domain, key FROM k WHERE key <> '' GROUP BY 1, 2 HAVING count(DISTINCT id) >= 5)
        SELECT DISTINCT k.id, CAST(k.line_no AS BIGINT) AS line_no FROM k JOIN c ON c.key = k.key AND c.source_domain IS NOT DISTINCT FROM k.source_domain
    """,
}
