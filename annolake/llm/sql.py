"""SQL that gives the same rows as queries of this subpackage, where SQL can express them."""

_PLAN = r"""
WITH RECURSIVE rows AS (
  SELECT row_id, coalesce(regexp_replace(intent_3_level.level_3, '^\s+|\s+$', '', 'g'), '') AS category FROM hasaki_labelled_full),
counts AS (SELECT category, count(*) AS available FROM rows GROUP BY 1),
targets AS (SELECT l3 AS category, sum(greatest(coalesce("count", 0), 0))::DOUBLE AS weight FROM intent_distribution WHERE l3 IS NOT NULL GROUP BY 1),
a AS (SELECT coalesce(c.category, t.category) AS category, coalesce(available, 0) AS available, coalesce(weight, 0) AS weight
      FROM counts c FULL JOIN targets t ON c.category = t.category),
b AS (SELECT *, CASE WHEN sum(weight) OVER () > 0 THEN 1000.0::DOUBLE * weight / sum(weight) OVER () ELSE 0 END AS wanted FROM a),
lo AS (SELECT *, CASE WHEN weight > 0 THEN least(2, available) ELSE 0 END AS least_ FROM b),
goal AS (SELECT least(1000, sum(available) FILTER (weight > 0))::DOUBLE AS goal FROM lo),
-- The scale by bisection: chances scale x weight, between floor and what there is, add up to the size.
search AS (SELECT 0 AS step, 0::DOUBLE AS low, 1e6::DOUBLE AS high UNION ALL
  SELECT step + 1, CASE WHEN (SELECT sum(CASE WHEN weight > 0 THEN least(greatest((low + high) / 2 * weight, least_), available) ELSE 0 END) FROM lo) <= (SELECT goal FROM goal) THEN (low + high) / 2 ELSE low END,
    CASE WHEN (SELECT sum(CASE WHEN weight > 0 THEN least(greatest((low + high) / 2 * weight, least_), available) ELSE 0 END) FROM lo) <= (SELECT goal FROM goal) THEN high ELSE (low + high) / 2 END
  FROM search WHERE step < 80),
e AS (SELECT *, (SELECT max(low) FROM search) * weight AS free, CASE WHEN weight > 0 THEN least(greatest((SELECT max(low) FROM search) * weight, least_), available) ELSE 0 END AS expected FROM lo),
-- Every row with its chance; one is drawn where the sum of all chances up to it passes a whole number.
sums AS (SELECT row_id, r.category, sum(expected / available) OVER (ORDER BY r.category, substr(md5('7|' || row_id), 1, 15), row_id ROWS UNBOUNDED PRECEDING) AS upto, expected / available AS chance FROM rows r JOIN e ON e.category = r.category WHERE expected > 0),
sample AS (SELECT row_id, category FROM sums WHERE floor(round(upto + (7 * 2654435761 % 4294967296) / 4294967296.0::DOUBLE, 8)) > floor(round(upto - chance + (7 * 2654435761 % 4294967296) / 4294967296.0::DOUBLE, 8))),
"""
_WORDS = r"regexp_extract_all(replace(strip_accents(lower(coalesce(text, ''))), 'đ', 'd'), '[\p{L}\p{N}]+')"
_LEAKS = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, split, {_WORDS} AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
ig AS (SELECT DISTINCT item_id, split, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT item_id, split, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
leaks AS (SELECT DISTINCT doc_id, item_id, split FROM dg JOIN ig ON dg.g = ig.g)
"""
_NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
dp AS (SELECT doc_id, k AS pos, array_to_string(w[k : k + 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS k FROM d)),
ip AS (SELECT item_id, k AS j, array_to_string(w[k : k + 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w))) AS k FROM i)),
hit AS (SELECT doc_id, item_id, pos - j AS diagonal, j, j - row_number() OVER (PARTITION BY doc_id, item_id, pos - j ORDER BY j) AS island FROM dp JOIN ip ON dp.g = ip.g),
piece AS (SELECT doc_id, item_id, min(j) AS a, min(j) + diagonal AS d, count(*) + 1 AS n FROM hit GROUP BY doc_id, item_id, diagonal, island HAVING count(*) >= 4),
chain AS (SELECT doc_id, item_id, a + n AS a, d + n AS d, n AS words FROM piece
  UNION SELECT p.doc_id, p.item_id, p.a + n, p.d + n, words + n FROM chain c JOIN piece p ON p.doc_id = c.doc_id AND p.item_id = c.item_id AND p.a - c.a BETWEEN 0 AND 3 AND p.d - c.d BETWEEN 0 AND 3)
"""
_KEPT = r"regexp_replace(lower(nfc_normalize(coalesce({}, ''))), '[^\p{{L}}\p{{N}}]', '', 'g')"
_COPIES = (
    "WITH r AS ("
    + " UNION ALL ".join(
        f"SELECT '{src}' AS src, {key} AS id, [{', '.join(_KEPT.format(f) for f in fields)}] AS k FROM {src}"
        for src, key, fields in (
            ("crawl_hasaki", "row_id", ("product_id", "question")),
            ("hasaki_labelled_full", "row_id", ("category", "sentence")),
            ("crawl_raw", "rec_id", tuple(f"json_extract_string(payload, '$.{f}')" for f in ("product_id", "product_name", "user", "question", "date"))),
        )
    )
    + "), f AS (SELECT src, id, min(id) OVER (PARTITION BY src, k) AS first_id, count(*) OVER (PARTITION BY src, k) AS n FROM r)"
)

_OVERLAPS = rf"""
WITH g AS (SELECT gold_id, split, nullif(regexp_replace(lower(regexp_replace(sample_id, '^\s+|\s+$', '', 'g')), '_q0+(\d)', '_q\1'), '') AS k, {_WORDS.replace('text', 'sentence')} AS w FROM d3_human_gold),
t AS (SELECT train_id, label_source, nullif(regexp_replace(lower(regexp_replace(sample_id, '^\s+|\s+$', '', 'g')), '_q0+(\d)', '_q\1'), '') AS k, {_WORDS.replace('text', 'sentence')} AS w FROM d1_annotator_train),
gw AS (SELECT w AS a, min(gold_id) AS gold_class, count(*) AS gold_rows FROM g WHERE len(w) > 0 GROUP BY 1), tw AS (SELECT w AS b, min(train_id) AS train_class, count(*) AS train_rows FROM t WHERE len(w) > 0 GROUP BY 1),
near AS (SELECT *, greatest(len(a), len(b)) AS n, least(6, (greatest(len(a), len(b)) - 1) // 2) AS may FROM gw, tw WHERE abs(len(a) - len(b)) <= 6 AND len(list_distinct(a)) - len(list_intersect(a, b)) <= 6),
pairs AS (SELECT * FROM near WHERE abs(len(a) - len(b)) <= may AND n - list_extract(list_reduce(a, lambda row, x: list_reduce(range(1, len(b) + 1), lambda done, j:
  list_append(done, greatest(CASE WHEN b[j] = x THEN row[j] + 1 ELSE 0 END, row[j + 1], done[j])), [0::BIGINT]), list_resize([0::BIGINT], len(b) + 1, 0)), -1) <= may),
found AS (SELECT gold_id, train_id, split, label_source FROM g JOIN t ON g.k = t.k UNION SELECT gold_id, train_id, split, label_source FROM pairs JOIN g ON g.w = a JOIN t ON t.w = b)
"""
_SQUEEZED = r"regexp_replace(replace(strip_accents(lower({})), 'đ', 'd'), '[^\p{{L}}\p{{N}}]', '', 'g')"
_TOKENS = "unnest(list_concat(list_transform(range(1, length(s) + 1), lambda i: s[i]), list_transform(range(1, length(s) + 2), lambda i: ('^' || s || '$')[i : i + 1]))) AS t"
_LABELS = (
    "WITH l AS (" + " UNION ALL ".join(f"SELECT 'level_{k}' AS field_name, node_id AS id, substr(node_id, instr(node_id, ':') + 1) AS label FROM intent_nodes WHERE node_level = 'l{k}'" for k in (1, 2, 3))
    + f"), e AS (SELECT DISTINCT field_name, id, {_SQUEEZED.format('label')} AS s FROM l), w AS (" + " UNION ".join(f"SELECT 'level_{k}' AS field_name, intent_3_level.level_{k} AS val FROM hasaki_labelled_full" for k in (1, 2, 3))
    + rf"""), v AS (SELECT field_name, val, {_SQUEEZED.format('val')} AS s FROM w WHERE regexp_matches(val, '[^\s\x{{A0}}]') AND (field_name, val) NOT IN (SELECT field_name, label FROM l)),
ve AS (SELECT field_name, s, t, count(*) AS c FROM (SELECT field_name, s, {_TOKENS} FROM (SELECT DISTINCT field_name, s FROM v)) GROUP BY ALL), ee AS (SELECT field_name, id, s, t, count(*) AS c FROM (SELECT field_name, id, s, {_TOKENS} FROM e) GROUP BY ALL),
x AS (SELECT ve.field_name, ve.s, ee.id, ee.s AS es, sum(least(ve.c, ee.c)) AS shared FROM ve JOIN ee ON ve.field_name = ee.field_name AND ve.t = ee.t GROUP BY ALL),
y AS (SELECT *, shared / (2 * length(s) + 1 + 2 * length(es) + 1 - shared)::DOUBLE AS j FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY field_name, s ORDER BY j DESC, id) AS rn FROM y WHERE j >= 0.45 AND (s = es OR damerau_levenshtein(s, es) <= least(2 * length(es) // 7, greatest(2, length(es) // 5))))
SELECT v.field_name, val, coalesce(id, '') AS canonical_id FROM v LEFT JOIN z ON z.field_name = v.field_name AND z.s = v.s AND rn = 1"""
)

ORACLES = {
    "p7_labels": _LABELS,
    "p2_found": _OVERLAPS + "SELECT gold_id, train_id FROM found",
    "p2_report": _OVERLAPS + "SELECT split, label_source, count(*) AS pairs, count(DISTINCT gold_id) AS gold_rows, count(DISTINCT train_id) AS train_rows FROM found GROUP BY ALL",
    "p2_classes": _OVERLAPS + "SELECT gold_class, train_class, gold_rows, train_rows, count(*) OVER (PARTITION BY gold_class) AS links FROM pairs",
    "p4_kinds": "WITH f AS ("
    + " UNION ALL ".join(f"SELECT '{t}' AS src, '{f}' AS field_name, {f} AS v FROM {t}" for t, f in (("crawl_hasaki", "question"), ("crawl_hasaki", "product_name_raw"), ("hasaki_labelled_full", "sentence")))
    + r"), k AS (SELECT src, field_name, count(*) FILTER (regexp_matches(v, '[\x{FF01}-\x{FF5E}]')) AS width, count(*) FILTER (regexp_matches(v, '[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]')) AS blank, count(*) FILTER (regexp_matches(v, '[a-zA-Z\x{C0}-\x{1EF9}][\x{300}\x{301}\x{303}\x{309}\x{323}]')) AS apart FROM f GROUP BY ALL) SELECT * FROM k WHERE width + blank + apart > 0",
    "p5_report": _PLAN
    + """k AS (SELECT e.*, (SELECT count(*) FROM sample s WHERE s.category = e.category) AS kept, weight / sum(weight) OVER () AS target FROM e),
    o AS (SELECT *, kept - target * sum(kept) OVER () AS off, kept / sum(kept) OVER ()::DOUBLE AS share FROM k)
    SELECT category, available, weight, round(target, 6) AS target_share, round(wanted, 6) AS wanted, kept, round(share, 6) AS share,
      CASE WHEN weight <= 0 THEN 'untargeted' WHEN available = 0 THEN 'absent' WHEN kept = available AND off <= -1 THEN 'short' WHEN free < least_ AND kept = least_ THEN 'floor'
        WHEN abs(off) < 1 THEN 'met' WHEN off > 0 THEN 'above' ELSE 'below' END AS status FROM o""",
    "p5_sample": _PLAN + "x AS (SELECT 1) SELECT row_id, category FROM sample",
    "p6_found": _COPIES + " SELECT src, first_id, id AS copy_id FROM f WHERE id <> first_id",
    "p6_counts": _COPIES + " SELECT src, first_id, any_value(n) AS copies FROM f WHERE n > 1 GROUP BY src, first_id",
    "p9_found": _LEAKS + "SELECT doc_id, item_id FROM leaks",
    "p9_proximity": _NEAR + "SELECT doc_id, item_id, longest, near FROM (SELECT doc_id, item_id, max(words) AS near FROM chain GROUP BY ALL) JOIN (SELECT doc_id, item_id, max(n) AS longest FROM piece GROUP BY ALL) USING (doc_id, item_id) WHERE near >= 12",
    "p9_leaked": _LEAKS + "SELECT item_id, split, count(DISTINCT doc_id) AS documents FROM leaks GROUP BY item_id, split",
}
