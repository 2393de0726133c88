"""SQL for the queries over the labelled tables."""

#: White space of all kinds; RE2's own class is ASCII.
_GAP = r"[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]"
_STRIP = rf"regexp_replace({{}}, '^{_GAP}+|{_GAP}+$', '', 'g')"
_WORDS = rf"len(list_filter(regexp_split_to_array(coalesce({{}}, ''), '{_GAP}+'), lambda w: w <> ''))"
_L = """SELECT *, coalesce(intent_3_level.level_1, '') AS l1, coalesce(intent_3_level.level_2, '') AS l2, coalesce(intent_3_level.level_3, '') AS l3 FROM {}"""
_F = _L.format("hasaki_labelled_full")
_DIST = f"""
WITH r AS ({_F}), k AS (SELECT DISTINCT l3 FROM intent_nodes WHERE node_level = 'l3'),
m2 AS (SELECT l3, l2, row_number() OVER (PARTITION BY l3 ORDER BY count(*) DESC, l2) AS rn FROM r WHERE l3 <> '' GROUP BY l3, l2),
m1 AS (SELECT l3, l1, row_number() OVER (PARTITION BY l3 ORDER BY count(*) DESC, l1) AS rn FROM r WHERE l3 <> '' GROUP BY l3, l1),
n AS (SELECT l3, count(*) AS c FROM r WHERE l3 <> '' GROUP BY l3),
dist AS (SELECT m1.l1, m2.l2, n.l3, c AS "count", k.l3 IS NOT NULL AS in_taxonomy, greatest(0, 30 - c) AS gap, greatest(0, c - 200) AS excess,
  CASE WHEN c >= 30 THEN 'sufficient' WHEN c > 0 THEN 'needs_augmentation' ELSE 'empty' END AS status
  FROM n JOIN m1 ON m1.l3 = n.l3 AND m1.rn = 1 JOIN m2 ON m2.l3 = n.l3 AND m2.rn = 1 LEFT JOIN k ON k.l3 = n.l3)
"""
_SLUG = "regexp_replace(replace(lower(" + _STRIP + "), ' ', '_'), '[^a-z0-9_]', '', 'g')"
_HIST = "WITH v AS (SELECT {0} AS x FROM {1} WHERE {0} IS NOT NULL), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v) SELECT CASE WHEN hi > lo THEN least(floor((x - lo) * {2} / (hi - lo)), {2} - 1) ELSE 0 END::BIGINT AS bin, count(*) AS n FROM v, e GROUP BY 1"
_VAGUE = (
    "WITH t AS (SELECT "
    + _STRIP.format("coalesce(question, '')")
    + r""" AS t FROM crawl_hasaki), u AS (SELECT t, length(regexp_replace(t, '\s+', '', 'g')) AS n,
  len(list_filter(regexp_extract_all(lower(t), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 2 AND w NOT IN ('có', 'thế', 'này', 'kia', 'được', 'như'))) AS m FROM t)
SELECT CASE WHEN t = '' THEN 'empty_sentence' WHEN n < 6 THEN 'too_short_chars_' || n WHEN m < 1 THEN 'too_few_meaningful_words_' || m
  WHEN regexp_matches(regexp_replace(lower(t), '\s+', ' ', 'g'), '^((có ?)?(không ?)?gì|sao|nào|đâu)[ ?]*$') THEN 'question_word_only' ELSE '' END AS reason, count(*) AS n FROM u GROUP BY 1"""
)
_STRATA = f"""
WITH r AS (SELECT * FROM ({_F}) WHERE qa_status = 'approved'), c AS (SELECT *, count(*) OVER (PARTITION BY l3) AS n3 FROM r),
s AS (SELECT row_id, CASE WHEN l3 <> '' AND n3 >= 3 THEN 'L3::' || l3 WHEN l2 <> '' THEN 'L2::' || l2 WHEN l1 <> '' THEN 'L1::' || l1 ELSE 'UNK' END AS stratum FROM c),
z0 AS (SELECT stratum, count(*) AS n FROM s GROUP BY 1),
z1 AS (SELECT *, greatest(1, round_even(n * 0.7::DOUBLE, 0))::BIGINT AS a FROM z0),
z2 AS (SELECT *, least(round_even(n * 0.15::DOUBLE, 0)::BIGINT, n - a) AS b0 FROM z1),
z AS (SELECT stratum, n, CASE WHEN n <= 2 THEN 1 ELSE a END AS n_train, CASE WHEN n <= 2 THEN 0 WHEN n - a - b0 > 0 THEN b0 WHEN n - a > 0 THEN n - a - 1 ELSE 0 END AS n_val FROM z2)
"""
_JUDGED = (
    "WITH g AS (SELECT gold_level_1 AS g1, gold_level_2 AS g2, gold_level_3 AS g3, coalesce(machine_level_1, '') AS m1, coalesce(machine_level_2, '') AS m2, coalesce(machine_level_3, '') AS m3 FROM d3_human_gold"
    " WHERE coalesce(gold_level_1, '') <> '' AND coalesce(gold_level_2, '') <> '' AND coalesce(gold_level_3, '') <> ''),"
    " j AS (SELECT *, g1 || '::' || g2 || '::' || g3 AS g, m1 || '::' || m2 || '::' || m3 AS m FROM g)"
)
_LEVELS = "p AS (" + " UNION ALL ".join(f"SELECT '{n}' AS level, {t} AS t, {p} AS p FROM j" for n, t, p in (("l1", "g1", "m1"), ("l2", "g2", "m2"), ("l3", "g3", "m3"), ("path", "g", "m"))) + ")"
_APPROVED = "qa_status = 'approved' AND coalesce(sample_id, '') <> ''"
_PRELABEL = (
    r"""WITH p AS (SELECT product_id, product_name AS name, coalesce(brand, '') AS brand, image_url FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY row_id DESC) AS rn FROM crawl_hasaki) WHERE rn = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY row_id) - 1 AS nth FROM crawl_hasaki)
SELECT q.row_id, q.product_id || '_q' || CASE WHEN nth < 10 THEN '0' ELSE '' END || nth AS sample_id, coalesce(q.product_name, name) AS product_name, p.brand, """
    + _STRIP.format("coalesce(q.question, '')")
    + """ AS sentence, coalesce(p.image_url, '') <> '' AS has_image, coalesce({asks}, false) AS is_question FROM q LEFT JOIN p ON p.product_id = q.product_id"""
)
_PHRASES = "bao giờ|bao lâu|bao nhiêu|khi nào|ở đâu|tại sao|vì sao|như thế nào|thế nào|làm sao|sao lại|gì |cái gì|là gì|loại nào|màu nào|size nào|cỡ nào|mấy giờ|mấy ngày|ai |của ai|cho ai|từ đâu|ntn"
_EDGE = r"[^\p{L}\p{N}\p{M}_]"


def _asks(c: str) -> str:
    """RE2 knows ASCII word ends only: a phrase stands between other characters, or ends with a blank before a word."""
    text = _STRIP.format(c)
    ends = "|".join(p for p in _PHRASES.split("|") if p[-1] != " ")
    open_ = "|".join(p for p in _PHRASES.split("|") if p[-1] == " ")
    word = _EDGE.replace("[^", "[")
    return f"regexp_matches(lower({text}), '(^|{_EDGE})(({ends})($|{_EDGE})|({open_}){word})')"


ORACLES = {
    "audit_distribution": _DIST + "SELECT * FROM dist",
    "audit_longtail": _DIST + """SELECT count(*) AS classes, count(*) FILTER ("count" = 1) AS singletons, count(*) FILTER ("count" < 30) AS rare, count(*) FILTER ("count" > 200) AS frequent, min("count") AS least, max("count") AS most,
      (SELECT l3 FROM dist ORDER BY "count" DESC, l3 DESC LIMIT 1) AS largest, (SELECT l3 FROM dist ORDER BY "count", l3 LIMIT 1) AS smallest, sum(gap) AS gap, sum(excess) AS excess, round(max("count") / min("count")::DOUBLE, 6) AS imbalance FROM dist""",
    "taxonomy_setops": f"WITH d AS (SELECT DISTINCT {_SLUG.format('l3')} AS s FROM ({_F}) WHERE {_SLUG.format('l3')} <> ''), k AS (SELECT DISTINCT {_SLUG.format('l3')} AS s FROM intent_nodes WHERE node_level = 'l3') SELECT CASE WHEN d.s IS NOT NULL AND k.s IS NOT NULL THEN 'both' WHEN d.s IS NOT NULL THEN 'only_data' ELSE 'only_taxonomy' END AS side, count(*) AS slugs FROM d FULL JOIN k ON d.s = k.s GROUP BY 1",
    "dup_stats": f"WITH r AS (SELECT 'exact' AS kind, sentence AS k FROM hasaki_labelled_full UNION ALL SELECT 'trimmed_lower', lower({_STRIP.format('sentence')}) FROM hasaki_labelled_full), g AS (SELECT kind, k, count(*) AS n FROM r GROUP BY ALL) SELECT kind, coalesce(sum(n) FILTER (n > 1), 0) AS members, count(*) FILTER (n > 1) AS recurring, coalesce(sum(n - 1) FILTER (n > 1), 0) AS surplus FROM g GROUP BY kind",
    "text_lengths": f"WITH r AS (SELECT 'words' AS field, {_WORDS.format('text')}::DOUBLE AS x FROM documents UNION ALL SELECT 'chars', length(text) FROM documents) SELECT field, count(x) AS n, round(avg(x), 1) AS mean, round(stddev_samp(x), 1) AS deviation, round(min(x), 1) AS least, round(quantile_cont(x, 0.25), 1) AS q1, round(quantile_cont(x, 0.5), 1) AS median, round(quantile_cont(x, 0.75), 1) AS q3, round(max(x), 1) AS most FROM r GROUP BY field",
    "length_histogram": _HIST.format("length(text)::DOUBLE", "documents", "30"),
    "confidence_histogram": _HIST.format("round(confidence, 6)", "hasaki_labelled_full", "20"),
    "status_shares": "SELECT qa_status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM hasaki_labelled_full GROUP BY 1",
    "dominant_labels": f"SELECT * FROM (SELECT l2, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM ({_F}) GROUP BY 1) WHERE percent > 3 AND l2 <> ''",
    "issue_table": f"WITH r AS ({_F}), c AS (SELECT * FROM r LEFT JOIN (SELECT DISTINCT l3 AS k FROM intent_nodes WHERE node_level = 'l3') ON k = l3) "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS issue, count(*) FILTER ({w}) AS n FROM c"
        for n, w in (
            ("invalid_slug", "l3 <> '' AND NOT regexp_matches(l3, '^[a-z][a-z0-9_]+$')"), ("skipped_ambiguous", "qa_status = 'skipped_ambiguous'"), ("needs_review", "regexp_matches(coalesce(qa_status, ''), 'needs_review|pending')"),
            ("not_in_taxonomy", "l3 <> '' AND k IS NULL"), ("under_five_words", _WORDS.format("sentence") + " < 5"), ("no_label", "l3 = ''"), ("has_error", "error IS NOT NULL"),
        )
    ),
    "dataset_summary": f"SELECT count(*) AS n, count(*) FILTER (starts_with(qa_status, 'approved')) AS approved, count(*) FILTER (needs_human_review) AS to_review, count(*) FILTER (l3 = '') AS unlabelled, count(DISTINCT l1) AS l1_labels, count(DISTINCT l2) AS l2_labels, count(DISTINCT l3) AS l3_labels, count(DISTINCT product_id) AS products, round(avg({_WORDS.format('sentence')}), 2) AS mean_words, round(avg(length(sentence)), 2) AS mean_chars, round(avg(confidence), 2) AS mean_confidence FROM ({_F})",
    "level_counts": " UNION ALL ".join(f"SELECT '{t}' AS dataset, count(*) AS n, count(DISTINCT l1) AS l1, count(DISTINCT l2) AS l2, count(DISTINCT l3) AS l3 FROM ({_L.format(t)})" for t in ("d1_annotator_train", "hasaki_labelled_clean", "hasaki_labelled_full_verified")),
    "verifier_summary": "SELECT count(*) AS total, count(verifier_decision) AS verified, count(*) FILTER (verifier_decision = 'RETAIN') AS retained, count(*) FILTER (verifier_decision = 'REVISE') AS revised, count(error) AS failed, round(count(verifier_decision) / count(*)::DOUBLE, 6) AS coverage, round(count(*) FILTER (verifier_decision = 'RETAIN') / count(verifier_decision)::DOUBLE, 6) AS retain_rate FROM hasaki_labelled_full",
    "first_wins": "SELECT product_id, row_id, product_name_raw FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY row_id) AS rn FROM crawl_hasaki) WHERE rn = 1",
    "last_wins": "SELECT sample_id, row_id, qa_status FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY row_id DESC) AS rn FROM hasaki_labelled_full) WHERE rn = 1",
    "prelabel_join": _PRELABEL.replace("{asks}", _asks("q.question")),
    "batch_numbers": "WITH r AS (SELECT row_id - 1 AS ord FROM unified_intents) SELECT ord // ((SELECT count(*) FROM r) // 4 + 1) AS batch, count(*) AS n, min(ord) AS first, max(ord) AS last FROM r GROUP BY 1",
    "verified_partial": f"SELECT row_id, sample_id, sentence, 'clean' AS from_set FROM hasaki_labelled_clean WHERE {_APPROVED} AND sample_id NOT IN (SELECT sample_id FROM hasaki_labelled_full_verified WHERE coalesce(sample_id, '') <> '') UNION ALL SELECT row_id, sample_id, sentence, 'verified' FROM hasaki_labelled_full_verified WHERE {_APPROVED}",
    "verified_full": f"SELECT row_id, sample_id FROM hasaki_labelled_full_verified WHERE {_APPROVED}",
    "matched_train": f"WITH i AS (SELECT DISTINCT sample_id FROM hasaki_labelled_full_verified WHERE {_APPROVED} AND sample_id NOT IN (SELECT sample_id FROM d3_human_gold WHERE coalesce(sample_id, '') <> '')), t AS (SELECT sample_id, max(row_id) AS row_id FROM hasaki_labelled_full GROUP BY 1) SELECT i.sample_id, t.row_id, t.row_id IS NULL AS missing FROM i LEFT JOIN t ON t.sample_id = i.sample_id",
    "leakage": "SELECT DISTINCT sample_id FROM d3_human_gold WHERE sample_id IN (SELECT sample_id FROM d1_annotator_train WHERE sample_id IS NOT NULL)",
    "gold_levels": "WITH g AS (SELECT gold_id, " + ", ".join(f"coalesce(CASE WHEN coalesce(gold_level_1, '') <> '' THEN gold_level_{k} ELSE machine_level_{k} END, '') AS l{k}" for k in (1, 2, 3)) + ") FROM d3_human_gold) SELECT *, l1 || '::' || l2 || '::' || l3 AS label FROM g WHERE l1 <> '' AND l2 <> '' AND l3 <> ''".replace(") FROM", " FROM", 1),
    "template_rows": f"SELECT row_id, sample_id, l1 AS machine_level_1, l2 AS machine_level_2, l3 AS machine_level_3, '' AS gold_level_1, '' AS gold_level_2, '' AS gold_level_3, '' AS human_notes FROM ({_L.format('hasaki_labelled_clean')})",
    "bulk_update_dry": f"WITH k AS (SELECT DISTINCT l1 AS new, replace(l1, '_', '') AS key FROM intent_nodes WHERE node_level = 'l1'), r AS (SELECT l1, regexp_replace(replace(strip_accents(lower(l1)), 'đ', 'd'), '[^a-z0-9]', '', 'g') AS key FROM ({_F})) SELECT new, count(*) AS matched, count(DISTINCT l1) AS spellings FROM r JOIN k USING (key) WHERE l1 <> new GROUP BY new",
    "split_assign": _STRATA + ", x AS (SELECT row_id, s.stratum, n_train, n_val, row_number() OVER (PARTITION BY s.stratum ORDER BY substr(md5('42|' || row_id), 1, 15), row_id) AS rn FROM s JOIN z ON z.stratum = s.stratum) SELECT row_id, stratum, CASE WHEN rn <= n_train THEN 'train' WHEN rn <= n_train + n_val THEN 'val' ELSE 'test' END AS split FROM x",
    "split_sizes": _STRATA + "SELECT *, n - n_train - n_val AS n_test FROM z",
    "gold_sample": f"""
WITH r AS (SELECT row_id, l2, l3, substr(md5('42|' || row_id), 1, 15) AS h FROM ({_F}) WHERE l1 <> '' AND l2 <> '' AND l3 <> ''),
c2 AS (SELECT l2, count(*) AS n FROM r GROUP BY 1),
o AS (SELECT row_id, l3 FROM (SELECT *, row_number() OVER (PARTITION BY l2 ORDER BY h, row_id) AS rn FROM r) WHERE rn = 1 AND (SELECT count(*) FROM c2) <= 300),
w AS (SELECT row_id, rn2 FROM (SELECT row_id, row_number() OVER (ORDER BY n, l3) AS rn2 FROM (SELECT *, count(*) OVER (PARTITION BY l3) AS n, row_number() OVER (PARTITION BY l3 ORDER BY h, row_id) AS rn FROM r) WHERE rn = 1 AND l3 NOT IN (SELECT l3 FROM o)) WHERE rn2 <= 300 - (SELECT count(*) FROM o)),
t AS (SELECT row_id, 1 AS phase FROM o UNION ALL SELECT row_id, 2 FROM w),
q0 AS (SELECT l2, n, round_even((300 - (SELECT count(*) FROM t)) * n / (SELECT count(*) FROM r)::DOUBLE, 0)::BIGINT AS t FROM c2),
q1 AS (SELECT *, sum(t) OVER () - (300 - (SELECT count(*) FROM t)) AS off, row_number() OVER (ORDER BY n DESC, l2) AS big FROM q0),
q2 AS (SELECT l2, off, t + CASE WHEN big = 1 THEN greatest(-off, 0) ELSE 0 END AS t FROM q1),
q3 AS (SELECT l2, t - least(t, greatest(0, off - coalesce(sum(t) OVER (ORDER BY t, l2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS t FROM q2),
f AS (SELECT row_id, l2, row_number() OVER (PARTITION BY l2 ORDER BY h, row_id) AS rn FROM r WHERE row_id NOT IN (SELECT row_id FROM t)),
u AS (SELECT * FROM t UNION ALL SELECT f.row_id, 3 FROM f JOIN q3 ON q3.l2 = f.l2 AND rn <= t)
SELECT row_id, phase FROM u UNION ALL SELECT row_id, 4 FROM (SELECT row_id, row_number() OVER (ORDER BY h, row_id) AS rn FROM r WHERE row_id NOT IN (SELECT row_id FROM u)) WHERE rn <= 300 - (SELECT count(*) FROM u)""",
    "metrics_hier": _JUDGED + f", {_LEVELS}, lab AS (SELECT level, t AS label FROM p UNION SELECT level, p FROM p), f AS (SELECT lab.level, label, count(*) FILTER (t = label) AS s, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (p = label) AS pr FROM lab JOIN p ON p.level = lab.level GROUP BY ALL) SELECT level, sum(s) AS n, round(sum(tp) / sum(s)::DOUBLE, 6) AS accuracy, round(avg(2.0 * tp / (s + pr)), 6) AS macro_f1, round(sum(2.0 * tp / (s + pr) * s) / sum(s), 6) AS weighted_f1 FROM f GROUP BY level",
    "confusion_topn": _JUDGED + ", top AS (SELECT g2 FROM j GROUP BY 1 ORDER BY count(*) DESC, g2 LIMIT 12), c AS (SELECT CASE WHEN g2 IN (SELECT g2 FROM top) THEN g2 ELSE 'Other' END AS t, CASE WHEN m2 IN (SELECT g2 FROM top) THEN m2 ELSE 'Other' END AS p FROM j) SELECT t AS \"true\", p AS predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY t)::DOUBLE, 6) AS share FROM c GROUP BY t, p",
    "label_index": _JUDGED + ", l AS (SELECT g AS label FROM j UNION SELECT m FROM j) SELECT label, row_number() OVER (ORDER BY label) - 1 AS number FROM l",
    "review_funnel": f"WITH r AS ({_F}) " + " UNION ALL ".join(f"SELECT '{n}' AS step, count(*) FILTER ({w}) AS n, round(count(*) FILTER ({w}) / count(*)::DOUBLE, 6) AS share FROM r" for n, w in (("all", "true"), ("labelled", "l3 <> ''"), ("without_error", "l3 <> '' AND error IS NULL"), ("no_review_needed", "l3 <> '' AND error IS NULL AND NOT coalesce(needs_human_review, false)"))),
    "ambiguity_filter": _VAGUE,
    "questions_asked": f"SELECT row_id FROM crawl_hasaki WHERE {_asks('question')}",
    "link_ids": r"SELECT doc_id, CASE WHEN regexp_extract(url, '/san-pham/([^/?#]+?)(?:\.html)?(?:[?#]|$)', 1) <> '' THEN regexp_extract(url, '/san-pham/([^/?#]+?)(?:\.html)?(?:[?#]|$)', 1) ELSE replace(regexp_extract(url, '([^/]*)/?$', 1), '.html', '') END AS link_id FROM documents WHERE url IS NOT NULL",
    "confidence_notes": f"WITH t AS (SELECT {_STRIP.format(chr(99) + 'oalesce(confidence_level, ' + chr(39) * 2 + ')')} AS t FROM unified_intents) " + r"SELECT CASE WHEN t = '' THEN 'Cao' WHEN regexp_matches(t, '^(\d+\.?\d*|\.\d+)$') THEN CASE WHEN t::DOUBLE >= 0.7 THEN 'Cao' ELSE 'Trung binh' END ELSE t END AS confidence, count(*) AS n FROM t GROUP BY 1",
    "blank_fields": " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER ({_STRIP.format(f)} = '' OR {f} IS NULL) AS blanks FROM unified_intents" for f in ("description", "detection_signals", "examples", "domain", "logic_category")),
    "product_names": "WITH a AS (SELECT row_id, " + _STRIP.format("string_split(product_name_raw, chr(10))[1]") + " AS n FROM crawl_hasaki)" + "".join(
        f", {b} AS (SELECT row_id, {_STRIP.format(f'regexp_replace(n, {p!r}, {chr(39) * 2})')} AS n FROM {a})"
        for a, b, p in (("a", "b", r"^-?\d+\s*%\s*"), ("b", "c", r"^\d[\d.,]*\s*₫\s*"), ("c", "e", r"^\d[\d.,]*\s*₫\s*"), ("e", "f", r"^Tặng:.*?₫\s*"), ("f", "g", r"\d+\.\d+\(\d+\)\d*$"), ("g", "h", r"\d+$"))
    ).replace("\\\\", "\\") + r" SELECT row_id, regexp_replace(n, '(\d+(?:ml|g|L))[A-Z][a-z].*$', '\1') AS name FROM h",
}
