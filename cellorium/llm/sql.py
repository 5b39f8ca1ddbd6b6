"""SQL twins of the training-data queries that SQL can express over whole tables."""

_LAST = "(SELECT *, row_number() OVER (PARTITION BY dataset_id, cluster_id, gene_id ORDER BY loaded_at DESC) AS rn FROM gene_de_list)"
_SCORES = f"v AS (SELECT cluster_id, gene_id, max(auc) AS auc FROM {_LAST} WHERE rn = 1 AND auc IS NOT NULL AND NOT isnan(auc) AND auc BETWEEN 0 AND 1 GROUP BY 1, 2)"


def _key(c: str) -> str:
    k = f"regexp_replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '[-_\\s]', '_', 'g')"
    return f"CASE WHEN {k} IN ('', 'na', 'unknown', 'unassigned') THEN NULL ELSE {k} END"


_SUPPLY = f"""c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC) AS rn FROM cells) WHERE rn = 1),
m AS (SELECT dataset_id, 'major_cluster' AS f, {_key("major_cluster")} AS k, cell_id FROM c UNION ALL SELECT dataset_id, 'cell_type1', {_key("cell_type1")}, cell_id FROM c),
s AS (SELECT dataset_id, f, k, count(DISTINCT cell_id) AS n FROM m WHERE k IS NOT NULL GROUP BY 1, 2, 3),
t AS (SELECT t.*, coalesce(s.n, 0) AS supply, coalesce(target_share * sample_size, 0) AS ideal, floor(coalesce(target_share * sample_size, 0)) AS low FROM sample_targets t LEFT JOIN s ON t.dataset_id = s.dataset_id AND t.field_name = s.f AND {_key("t.category")} = s.k)"""

_QUOTA = f"""x AS (SELECT *, {_key("category")} AS ck, round(sum(ideal) OVER w) - sum(low) OVER w AS spare, row_number() OVER (PARTITION BY dataset_id, field_name ORDER BY ideal - low DESC, target_id) AS nth, coalesce(target_share, 0) AS sh, supply::DOUBLE AS hi, least(supply, coalesce(min_cells, 0))::DOUBLE AS lo, coalesce(sample_size, 0) AS size FROM t WINDOW w AS (PARTITION BY dataset_id, field_name)),
y AS (SELECT *, (low + (nth <= spare)::INT)::BIGINT AS wanted FROM x), bd AS (SELECT DISTINCT dataset_id, field_name, round(unnest(CASE WHEN sh > 0 THEN [0.0, lo / sh, hi / sh] ELSE [0.0] END), 9) AS l FROM y),
up AS (SELECT bd.dataset_id, bd.field_name, l, sum(greatest(least(l * sh, hi), lo)) AS filled, max(size) AS size, sum(CASE WHEN sh > 0 AND lo / sh <= l + 1e-9 AND hi / sh > l + 1e-9 THEN sh ELSE 0 END) AS free FROM bd JOIN y ON bd.dataset_id = y.dataset_id AND bd.field_name = y.field_name GROUP BY 1, 2, 3),
st AS (SELECT *, l + CASE WHEN free > 0 THEN (size - filled) / free ELSE 0 END AS times FROM up WHERE filled <= size + 1e-6 QUALIFY row_number() OVER (PARTITION BY dataset_id, field_name ORDER BY l DESC) = 1),
ex AS (SELECT y.*, round(greatest(least(coalesce(times * sh, 0), hi), lo), 6) AS exact FROM y LEFT JOIN st ON st.dataset_id = y.dataset_id AND st.field_name = y.field_name), fl AS (SELECT *, round(sum(exact) OVER w) - sum(floor(exact)) OVER w AS left_over, row_number() OVER (PARTITION BY dataset_id, field_name ORDER BY exact - floor(exact) DESC, target_id) AS no FROM ex WINDOW w AS (PARTITION BY dataset_id, field_name)),
fq AS (SELECT *, (floor(exact) + (no <= left_over AND exact > floor(exact))::INT)::BIGINT AS quota FROM fl)"""

_WORDS = "regexp_extract_all(strip_accents(regexp_replace(lower({c}), '\\p{{Cf}}', '', 'g')), '[\\p{{L}}\\p{{N}}]+')"
_GRAMS = "SELECT DISTINCT id, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {id} AS id, {w} AS w FROM {t}))"

_P3 = """v AS (SELECT 'exprs' AS f, dataset_id AS ds, strftime(run_day, '%Y-%m-%d') AS dy, exprs AS x FROM expr WHERE exprs >= 0 AND exprs < 100 AND NOT isnan(exprs)
UNION ALL SELECT 'median_f_rank', dataset_id, strftime(de_day, '%Y-%m-%d'), median_f_rank FROM gene_de_list WHERE median_f_rank >= 0 AND median_f_rank <= 1 AND NOT isnan(median_f_rank)),
w AS (SELECT f, ds, quantile_cont(x, 0.5) AS m FROM v GROUP BY 1, 2), d AS (SELECT f, ds, dy, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.9) AS q FROM v GROUP BY 1, 2, 3)"""


def oracle_sql() -> dict[str, str]:
    docs = _GRAMS.format(id="doc_id", w=_WORDS.format(c="text"), t="documents")
    held = _GRAMS.format(id="eval_id", w=_WORDS.format(c="passage"), t="(SELECT * FROM eval_items WHERE split_name IN ('test', 'validation'))")
    return {
        "p1_found": f"WITH {_SCORES} SELECT cluster_id, gene_id FROM v QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY auc DESC, gene_id) <= 10",
        "p1_ranked": f"WITH {_SCORES} SELECT cluster_id, gene_id, auc, row_number() OVER (PARTITION BY cluster_id ORDER BY auc DESC, gene_id) AS rank FROM v QUALIFY rank <= 10",
        "p2_found": """WITH c AS (SELECT cell_id, exprs FROM cell_exprs QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC) = 1),
u AS (SELECT cell_id, i, exprs[i] AS x FROM (SELECT cell_id, exprs, unnest(range(1, 65)) AS i FROM c WHERE len(exprs) = 64)), f AS (SELECT * FROM u WHERE x IS NOT NULL AND NOT isnan(x)),
k AS (SELECT cell_id FROM f GROUP BY 1 HAVING count(*) >= 32 AND min(x) < max(x)), g AS (SELECT f.* FROM f JOIN k USING (cell_id)),
p AS (SELECT a.cell_id AS a, b.cell_id AS b, corr(a.x, b.x) AS r FROM g a JOIN g b ON a.i = b.i AND a.cell_id < b.cell_id GROUP BY 1, 2 HAVING corr(a.x, b.x) >= 0.96),
d AS (SELECT a, b, r FROM p UNION ALL SELECT b, a, r FROM p), t AS (SELECT a, b FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY r DESC, b) <= 10)
SELECT x.a AS cell_a, x.b AS cell_b FROM t x JOIN t y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b""",
        "p3_found": f"WITH {_P3} SELECT d.f AS field_name, d.ds AS dataset_id, d.dy AS run_day FROM d JOIN w USING (f, ds) WHERE (f = 'exprs' AND (abs(d.m - w.m) > 0.8 OR d.q - w.m > 4.5)) OR (f <> 'exprs' AND (abs(d.m - w.m) > 0.15 OR d.q - w.m > 0.42))",
        "p3_exact": f"WITH {_P3}, n AS (SELECT f, ds, dy, count(*) AS n FROM v GROUP BY 1, 2, 3) SELECT d.f AS field_name, d.ds AS dataset_id, d.dy AS run_day, n, round(d.m, 6) AS median, round(d.q, 6) AS p90 FROM d JOIN n USING (f, ds, dy)",
        "p4_found": f"WITH {_SUPPLY} SELECT target_id FROM t WHERE supply < target_share * sample_size OR supply < min_cells",
        "p4_report": f"WITH {_SUPPLY}, {_QUOTA} SELECT target_id, supply, wanted, quota, quota = supply AND supply < greatest(wanted, coalesce(min_cells, 0)) AS exhausted FROM fq",
        "p4_sample": f"""WITH {_SUPPLY}, {_QUOTA}, pr AS (SELECT ds, f, k, cell_id, md5(cell_id || ':' || f || ':17') AS priority, row_number() OVER (PARTITION BY ds, f, k ORDER BY md5(cell_id || ':' || f || ':17'), cell_id) AS rn FROM (SELECT DISTINCT dataset_id AS ds, f, k, cell_id FROM m WHERE k IS NOT NULL))
SELECT target_id, dataset_id, field_name, k AS category_key, cell_id, priority FROM fq JOIN pr ON fq.dataset_id = pr.ds AND fq.field_name = pr.f AND fq.ck = pr.k WHERE rn <= quota""",
        "p8_found": f"WITH d AS ({docs}), e AS ({held}) SELECT DISTINCT d.id AS doc_id, e.id AS eval_id FROM d JOIN e USING (g)",
    }
