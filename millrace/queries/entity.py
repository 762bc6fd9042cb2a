"""Contact-dedupe queries on contacts derived from customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import entity as e
from millrace.plans.storage import materialise
from millrace.plans.views import view, with_views

MAPPING = {
    "first": "first_name", "last": "last_name", "email": "email", "phone": "phone", "company": "company",
    "country": "country", "title": "title", "lifecycle": "stage", "last_activity": "last_activity",
}


def _std(spark, d):
    return e.standardise(view(spark, d, "v_contacts"), MAPPING, "row_id")


def _decisions(spark, d):
    c = view(spark, d, "customer").filter("c_custkey % 3 > 0")
    return c.selectExpr("c_custkey * 3 as a", "c_custkey * 3 + 1 as b", "case when c_custkey % 7 = 1 then 'separate' else 'merge' end as decision").filter("a % 7 < 2")


def _keys(spark, d):
    """Blocking keys name match keys several times; these are written first, so that each is worked out once."""
    return e.blocking_keys(materialise(_std(spark, d).select("row", "k"), "contact-keys"))


def _scored(spark, d):
    std = materialise(_std(spark, d), "contacts")
    return std, e.score_pairs(e.candidate_pairs(e.blocking_keys(std)), std)


def _clustered(spark, d):
    std, s = _scored(spark, d)
    dec = materialise(e.decided(s, _decisions(spark, d)), "contact-pairs")
    return std, dec, materialise(e.clusters(std, dec), "contact-clusters")


def d_standardise(spark, d):
    cols = ["row", "first", "last", "email", "email_valid", "phone", "phone_ok", "company", "title", "seniority", "fn", "stage", "stage_rank", "date"]
    return _std(spark, d).select(*cols)


def d_match_keys(spark, d):
    return _std(spark, d).select("row", "k.email", F.col("k.phone").alias("phone"), F.col("k.first").alias("first"), "k.last", F.col("k.co").alias("co"), "k.pf", "k.pl", "k.free_mail")


def d_change_log(spark, d):
    return e.change_log(_std(spark, d)).select("row", "field", "after")


def d_change_counts(spark, d):
    return e.change_counts(e.change_log(_std(spark, d)))


def d_blocks(spark, d):
    return e.block_sizes(_keys(spark, d)).select("key", "kind", "rows", "kept")


def d_candidates(spark, d):
    return e.candidate_pairs(_keys(spark, d))


def d_pair_space(spark, d):
    return e.pair_space(_std(spark, d), e.candidate_pairs(_keys(spark, d)))


def d_scores(spark, d):
    return _scored(spark, d)[1].select("a", "b", "s", "signals", "swapped")


def d_bands(spark, d):
    return e.bands(_scored(spark, d)[1]).groupBy("band").agg(F.count("*").alias("pairs"))


def d_histogram(spark, d):
    return e.score_histogram(_scored(spark, d)[1])


def d_decided(spark, d):
    std, s = _scored(spark, d)
    return e.decided(s, _decisions(spark, d)).select("a", "b", "decision", "link")


def d_clusters(spark, d):
    return _clustered(spark, d)[2]


def d_review_queue(spark, d):
    _, dec, lab = _clustered(spark, d)
    return e.review_queue(dec, lab)


def d_cluster_links(spark, d):
    _, dec, lab = _clustered(spark, d)
    return e.cluster_links(dec, lab)


def d_golden(spark, d):
    std, _, lab = _clustered(spark, d)
    return e.golden(std, lab).select("cluster", "master", "members", "first", "last", "email", "phone", "stage", "date")


def d_provenance(spark, d):
    std, _, lab = _clustered(spark, d)
    return e.golden(std, lab).select("cluster", F.explode("prov").alias("field", "p")).select("cluster", "field", "p.from", "p.rule").filter("field in ('email', 'first', 'stage')")


def d_pass_through(spark, d):
    std, _, lab = _clustered(spark, d)
    return e.pass_through(std, lab, e.golden(std, lab), "person_id")


def d_clean_table(spark, d):
    std, _, lab = _clustered(spark, d)
    return e.clean_table(e.golden(std, lab), std, lab).select("cluster", "id", "merged_from")


def d_merge_log(spark, d):
    std, dec, lab = _clustered(spark, d)
    return e.merge_log(e.golden(std, lab), dec).groupBy("kind").agg(F.count("*").alias("rows"))


def d_metrics(spark, d):
    _, _, lab = _clustered(spark, d)
    return e.pair_metrics(lab, view(spark, d, "v_contacts").selectExpr("row_id as row", "person_id as person"))


def d_stage_metrics(spark, d):
    std, _, lab = _clustered(spark, d)
    return e.stage_metrics(std, e.change_log(std), e.golden(std, lab))


QUERIES = {f.__name__: f for f in (
    d_standardise, d_match_keys, d_change_log, d_change_counts, d_blocks, d_candidates, d_pair_space, d_scores, d_bands, d_histogram, d_decided,
    d_clusters, d_review_queue, d_cluster_links, d_golden, d_provenance, d_pass_through, d_clean_table, d_merge_log, d_metrics, d_stage_metrics,
)}

# The derived contacts have few shapes, so the oracle states each field's cleaning plainly for them.
_STD = """
r AS (SELECT *, trim(first_name) AS tf, row_id AS row, regexp_replace(phone, '\\D', '', 'g') AS dg FROM v_contacts),
s AS (SELECT row, person_id, first_name, last_name, email AS raw_email, phone AS raw_phone, company AS raw_company, country, title AS raw_title, stage AS raw_stage, last_activity,
   upper(tf[1:1]) || lower(tf[2:]) AS first, upper(last_name[1:1]) || lower(last_name[2:]) AS last,
   CASE WHEN email = '' THEN '' ELSE split_part(split_part(lower(email), '@', 1), '+', 1) || '@' || split_part(lower(email), '@', 2) END AS email, true AS email_valid,
   '+' || dg[3:] AS phone, true AS phone_ok, upper(split_part(company, ' ', 1)[1:1]) || lower(split_part(company, ' ', 1)[2:]) AS company,
   CASE title WHEN 'VP of Sales' THEN title WHEN 'head of IT and ops' THEN 'Head of IT and OPS' ELSE title END AS title,
   CASE title WHEN '' THEN '' WHEN 'VP of Sales' THEN 'VP' WHEN 'head of IT and ops' THEN 'Head' WHEN 'CEO' THEN 'C-level' ELSE 'Manager' END AS seniority,
   CASE title WHEN '' THEN '' WHEN 'VP of Sales' THEN 'Sales' WHEN 'head of IT and ops' THEN 'Engineering' WHEN 'CEO' THEN 'General mgmt' ELSE 'Marketing' END AS fn,
   stage, CASE stage WHEN 'Lead' THEN 1 WHEN 'Customer' THEN 5 WHEN 'MQL' THEN 2 ELSE -1 END AS stage_rank,
   CASE WHEN last_activity LIKE '%/%' THEN '2024-03-02' WHEN last_activity LIKE '%.%' THEN last_activity[7:10] || '-' || last_activity[4:5] || '-' || last_activity[1:2] ELSE last_activity END AS date FROM r),
k0 AS (SELECT *, CASE WHEN regexp_matches(lower(first), '^(bob|robert)$') THEN 'robert' WHEN lower(first) IN ('kate', 'katharina') THEN 'katharina' WHEN lower(first) IN ('tom', 'thomas') THEN 'thomas'
   ELSE 'juergen' END AS kf, 'name' AS kl, [strip_accents(lower(company))] AS co FROM s),
k AS (SELECT *, CASE kf WHEN 'robert' THEN '7172' WHEN 'katharina' THEN '4276' WHEN 'thomas' THEN '268' ELSE '0746' END AS pf, '66' AS pl0 FROM k0),
kk AS (SELECT * EXCLUDE (pf), regexp_replace(pf, '(.)0', '\\1') AS pf, '66' AS pl FROM k),
by0 AS (SELECT row, 0 AS o, 'email' AS kind, 'e:' || email AS key FROM kk WHERE email <> '' UNION ALL SELECT row, 1, 'phone', 'p:' || phone FROM kk
   UNION ALL SELECT row, 2, 'company', 'c:' || co[1] || '#' || list_sort([pf, pl])[1] || '|' || list_sort([pf, pl])[2] FROM kk
   UNION ALL SELECT row, 3, 'name', 'n:' || list_sort([pf, pl])[1] || '|' || list_sort([pf, pl])[2] FROM kk),
bs AS (SELECT key, kind, count(*) AS rows, min(row) AS first_row, count(*) BETWEEN 2 AND 40 AS kept FROM by0 GROUP BY 1, 2),
cp AS (SELECT x.row AS a, y.row AS b, list_sort(list(DISTINCT x.kind)) AS via, arg_min(x.kind, bs.first_row * 10 + x.o) AS reason FROM by0 x JOIN by0 y ON x.key = y.key AND x.row < y.row JOIN bs ON bs.key = x.key AND bs.kept GROUP BY 1, 2),
pr AS (SELECT a, b, p.kf AS fa, q.kf AS fb, p.kl AS la, q.kl AS lb, CASE WHEN p.email <> '' AND q.email <> '' THEN CAST(p.email = q.email AS DOUBLE) END AS fe, CAST(p.phone = q.phone AS DOUBLE) AS fp,
   CAST(p.co = q.co AS DOUBLE) AS fc, jaro_similarity(p.kf, q.kf) AS j1 FROM cp JOIN kk p ON p.row = a JOIN kk q ON q.row = b),
pj AS (SELECT *, CASE WHEN fa = fb THEN 1.0 ELSE j1 END AS ff FROM pr),
sw AS (SELECT *, CASE WHEN fe IS NULL THEN 0 WHEN fe = 0 THEN 0.15 ELSE 0.3 END AS we FROM pj),
sx AS (SELECT *, (coalesce(we * fe, 0) + 0.2 * fp + 0.15 * ff + 0.2 + 0.15 * fc) / (we + 0.7) * CASE WHEN ff < 0.75 THEN 0.8 ELSE 1 END AS raw FROM sw),
sp AS (SELECT *, floor(round(CAST(raw AS DOUBLE), 9) * 1000 + 0.5) / 1000 AS s FROM sx),
dd AS (SELECT c_custkey * 3 AS a, c_custkey * 3 + 1 AS b, CASE WHEN c_custkey % 7 = 1 THEN 'separate' ELSE 'merge' END AS decision FROM customer WHERE c_custkey % 3 > 0 AND c_custkey * 3 % 7 < 2),
de AS (SELECT sp.*, coalesce(dd.decision, '') AS decision, coalesce(dd.decision, '') = 'merge' OR (coalesce(dd.decision, '') <> 'separate' AND s >= 0.8) AS link FROM sp LEFT JOIN dd USING (a, b)),
wk AS (SELECT row AS n, row AS t FROM kk UNION SELECT w.n, CASE WHEN d.a = w.t THEN d.b ELSE d.a END FROM wk w JOIN de d ON d.link AND (d.a = w.t OR d.b = w.t)),
lab AS (SELECT n AS row, min(t) AS cluster FROM wk GROUP BY 1),
g0 AS (SELECT kk.*, lab.cluster, 100 * (1 + 1 + CAST(email <> '' AS INT) + 1 + 1 + 1 + CAST(title <> '' AS INT) * 3 + CAST(stage <> '' AS INT) + 1) + 1 + 5 + CAST(raw_email <> '' AS INT) + CAST(raw_title <> '' AS INT) + CAST(raw_stage <> '' AS INT) + 1 AS cm FROM kk JOIN lab USING (row)),
gd AS (SELECT cluster, first(row ORDER BY cm DESC, date DESC, row) AS master, count(*) AS members, first(first ORDER BY length(first) DESC, date DESC, row) AS first, first(last ORDER BY length(last) DESC, date DESC, row) AS last,
   coalesce(first(email ORDER BY date DESC, cm DESC, row) FILTER (email <> ''), '') AS email, first(phone ORDER BY date DESC, cm DESC, row) AS phone, first(stage ORDER BY stage_rank DESC, row) AS stage, first(date ORDER BY date DESC, cm DESC, row) AS date,
   first('row-' || row ORDER BY date DESC, cm DESC, row) FILTER (email <> '') AS email_from, first('row-' || row ORDER BY length(first) DESC, date DESC, row) AS first_from, first('row-' || row ORDER BY stage_rank DESC, row) AS stage_from,
   list('row-' || row ORDER BY row) AS ids FROM g0 GROUP BY 1)"""


def _sql(select: str) -> str:
    return with_views(_STD.strip() + "\n" + select, "v_contacts").replace("WITH v_contacts", "WITH RECURSIVE v_contacts", 1)


_LOG = """lo AS (SELECT row, unnest([{'field': 'first', 'before': first_name, 'after': first}, {'field': 'last', 'before': last_name, 'after': last}, {'field': 'email', 'before': raw_email, 'after': email}, {'field': 'phone', 'before': raw_phone, 'after': phone},
   {'field': 'company', 'before': raw_company, 'after': company}, {'field': 'title', 'before': raw_title, 'after': title}, {'field': 'date', 'before': last_activity, 'after': date}], recursive := true) FROM s)"""
ORACLES = {
    "d_standardise": _sql("SELECT row, first, last, email, email_valid, phone, phone_ok, company, title, seniority, fn, stage, stage_rank, date FROM s"),
    "d_match_keys": _sql("SELECT row, email, phone, kf AS first, kl AS last, co, pf, pl, false AS free_mail FROM kk"),
    "d_change_log": _sql(f", {_LOG} SELECT row, field, after FROM lo WHERE before <> after").replace("GROUP BY 1)\n, lo", "GROUP BY 1), lo"),
    "d_change_counts": _sql(f", {_LOG} SELECT field, count(*) AS changes FROM lo WHERE before <> after GROUP BY 1").replace("GROUP BY 1)\n, lo", "GROUP BY 1), lo"),
    "d_blocks": _sql("SELECT key, kind, rows, kept FROM bs"),
    "d_candidates": _sql("SELECT a, b, via, reason FROM cp"),
    "d_pair_space": _sql("SELECT (SELECT count(*) * (count(*) - 1) // 2 FROM kk) AS all_pairs, (SELECT count(*) FROM cp) AS candidates"),
    "d_scores": _sql("SELECT a, b, s, list_filter([CASE WHEN fe = 1 THEN 'email' END, CASE WHEN fp = 1 THEN 'phone' END, CASE WHEN ff >= 0.92 THEN 'name' ELSE 'last name' END, CASE WHEN fc >= 0.5 THEN 'company' END], lambda x: x IS NOT NULL) AS signals, false AS swapped FROM sp"),
    "d_bands": _sql("SELECT CASE WHEN s >= 0.8 THEN 'auto' WHEN s >= 0.6 THEN 'review' ELSE 'none' END AS band, count(*) AS pairs FROM sp GROUP BY 1"),
    "d_histogram": _sql("SELECT CAST(least(24, floor(s / 0.04)) AS INTEGER) AS bin, count(*) AS pairs FROM sp GROUP BY 1"),
    "d_decided": _sql("SELECT a, b, decision, link FROM de"),
    "d_clusters": _sql("SELECT row, cluster FROM lab"),
    "d_review_queue": _sql("SELECT a, b, s, decision, decision = '' AND x.cluster = y.cluster AS linked, decision = '' AND x.cluster <> y.cluster AS pending FROM de JOIN lab x ON x.row = a JOIN lab y ON y.row = b WHERE s >= 0.6 AND s < 0.8"),
    "d_cluster_links": _sql("SELECT cluster, count(*) AS links, min(s) AS weakest FROM de JOIN lab ON lab.row = a WHERE link GROUP BY 1"),
    "d_golden": _sql("SELECT cluster, master, members, first, last, email, phone, stage, date FROM gd"),
    "d_provenance": _sql("""SELECT cluster, 'email' AS field, email_from AS "from", 'most recent activity' AS rule FROM gd WHERE email <> '' UNION ALL SELECT cluster, 'first', first_from, 'most complete value' FROM gd UNION ALL SELECT cluster, 'stage', stage_from, 'highest lifecycle stage' FROM gd WHERE stage <> ''"""),
    "d_pass_through": _sql("SELECT gd.cluster, CAST(person_id AS VARCHAR) AS value FROM gd JOIN kk ON kk.row = master"),
    "d_clean_table": _sql("SELECT cluster, 'row-' || master AS id, array_to_string(list_filter(ids, lambda x: x <> 'row-' || master), ';') AS merged_from FROM gd"),
    "d_metrics": _sql("""SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM (SELECT h / f AS precision, h / r AS recall FROM (SELECT
        (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM kk JOIN lab USING (row) GROUP BY cluster, person_id)) AS h, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM lab GROUP BY cluster)) AS f,
        (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM kk GROUP BY person_id)) AS r))"""),
}
