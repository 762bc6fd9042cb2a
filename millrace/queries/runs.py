"""Run-log queries: proposals, objections and implementations derived from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import contracts
from millrace.operators import runs as r
from millrace.plans.views import view, with_views


def _all(spark, d):
    return [view(spark, d, n) for n in ("v_runlog", "v_proposals", "v_objections", "v_implementations")]


def _cycle(spark, d, as_of=None):
    log, p, o, i = _all(spark, d)
    return r.lifecycle(log, p, o, i, as_of)


def a_first_ok(spark, d):
    log, p, _, _ = _all(spark, d)
    return r.first_ok_after(r.reviewers(p), log).select("run_id", "proposal_id", "role", F.col("ok_pos").cast("long").alias("ok_pos"))


_CYCLE = ["run_id", "proposal_id", "filed_by", "filed_pos", "integrated_pos", "reopened_pos", "done_pos", "objections", "dropped", "warnings", "state"]


def a_lifecycle(spark, d):
    return _cycle(spark, d).select(*_CYCLE)


def a_lifecycle_as_of(spark, d):
    half = view(spark, d, "v_runlog").agg((F.max("pos") / 2).cast("int")).first()[0]
    return _cycle(spark, d, half).select(*_CYCLE)


def a_what_if(spark, d):
    log, p, o, i = _all(spark, d)
    # Some lie before the filing, and are dropped.
    injected = p.filter("proposal_id % 3 < 2").selectExpr("run_id", "proposal_id", "'critic' as role", "pos + 6 - 9 * (proposal_id % 3) as pos")
    return r.lifecycle(log, p, r.with_injected(o, injected), i).select(*_CYCLE)


def a_transitions(spark, d):
    return r.transitions(_cycle(spark, d))


def a_readable(spark, d):
    return r.readable(_cycle(spark, d))


def a_owed(spark, d):
    return r.owed(_cycle(spark, d), view(spark, d, "v_runlog"))


def a_eligible(spark, d):
    return r.eligible(_cycle(spark, d), view(spark, d, "v_runlog"))


_OUT = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '[1]' WHEN 2 THEN '{\"x\": 1}' WHEN 3 THEN '{\"k\": \"a\"}' ELSE '{\"k\": 3, \"x\": 2}' END AS output FROM events"


def a_contract_errors(spark, d):
    view(spark, d, "events").createOrReplaceTempView("events")
    return r.contract_errors(spark.sql(_OUT))


def a_dangling_objections(spark, d):
    return r.dangling_objections(view(spark, d, "v_objections"), _cycle(spark, d))


def a_role_costs(spark, d):
    return r.role_costs(view(spark, d, "v_runlog"))


def a_longest_gap(spark, d):
    return r.longest_gap(view(spark, d, "v_runlog"))


def a_objection_matrix(spark, d):
    return r.objection_matrix(view(spark, d, "v_objections"), view(spark, d, "v_proposals"))


def a_waits(spark, d):
    return r.waits(_cycle(spark, d), view(spark, d, "v_runlog"))


def a_wait_summary(spark, d):
    log, c = view(spark, d, "v_runlog"), _cycle(spark, d)
    return r.wait_summary(r.waits(c, log), r.longest_gap(log), c)


def a_reconcile(spark, d):
    recorded = view(spark, d, "v_proposals").selectExpr("run_id", "proposal_id", "case proposal_id % 3 when 0 then 'open' when 1 then 'done' else 'integrated' end as final_state")
    return r.reconcile(_cycle(spark, d), recorded)


def a_turn_effects(spark, d):
    _, p, o, i = _all(spark, d)
    return r.turn_effects(p, o, i)


_OUTPUTS = """SELECT run_id, CASE WHEN event_id % 301 = 0 THEN pos + 1000000 ELSE pos END AS pos,
  CASE WHEN event_id % 17 = 0 THEN 'critic' WHEN event_id % 97 = 0 THEN NULL ELSE role END AS role FROM v_runlog"""


def a_turn_errors(spark, d):
    log, _, o, _ = _all(spark, d)
    log.createOrReplaceTempView("v_runlog")
    return r.turn_errors(spark.sql(_OUTPUTS), log, o, _cycle(spark, d))


def a_state_intervals(spark, d):
    return r.state_intervals(_cycle(spark, d))


def a_counts_at(spark, d):
    """Counts by state at every position of every run."""
    return r.counts_at(r.state_intervals(_cycle(spark, d)), view(spark, d, "v_runlog").select("run_id", "pos"))


_NESTED = """SELECT event_id, CASE event_id % 8
  WHEN 0 THEN concat('{"role": "critic", "items": [{"id": ', CAST(user_id AS STRING), ', "tags": ["a"]}, {"id": 2.5, "tags": null}]}')
  WHEN 1 THEN concat('{"role": ', CAST(user_id AS STRING), ', "items": []}')
  WHEN 2 THEN '{"items": {"id": 1}, "more": true}'
  WHEN 3 THEN concat('{"role": "x", "items": [{"id": "', CAST(user_id AS STRING), '", "tags": [1, "b"], "note": 1}, 7]}')
  WHEN 4 THEN '[1]' WHEN 5 THEN 'no json' WHEN 6 THEN props ELSE '{"role": null, "items": [{"tags": "t"}]}' END AS output FROM events"""
_CONTRACT = [
    ("$", ["object"], True, True), ("$.role", ["string"], True, False), ("$.items", ["array"], False, False), ("$.items[*]", ["object"], False, True),
    ("$.items[*].id", ["number"], True, False), ("$.items[*].tags", ["array", "null"], False, False), ("$.items[*].tags[*]", ["string"], False, False),
]


def a_output_errors(spark, d):
    view(spark, d, "events").createOrReplaceTempView("events")
    return contracts.output_errors(spark.sql(_NESTED), spark.createDataFrame(_CONTRACT, contracts.CONTRACT))


QUERIES = {f.__name__: f for f in (
    a_turn_errors, a_state_intervals, a_counts_at, a_output_errors, a_first_ok, a_lifecycle, a_lifecycle_as_of, a_what_if, a_transitions, a_readable, a_owed, a_eligible, a_contract_errors,
    a_dangling_objections, a_role_costs, a_longest_gap, a_objection_matrix, a_waits, a_wait_summary, a_reconcile, a_turn_effects,
)}

# The oracle looks at every turn of a run for every proposal: plain, and quadratic in a run's length.
_BASE = """
lg AS (SELECT * FROM v_runlog), pr AS (SELECT * FROM v_proposals), ob AS (SELECT * FROM v_objections), im AS (SELECT * FROM v_implementations),
rv AS (SELECT p.*, r.role FROM pr p CROSS JOIN (VALUES ('research'), ('architect'), ('critic')) r(role) WHERE r.role <> p.filed_by),
ok AS (SELECT rv.run_id, rv.proposal_id, rv.role, min(l.pos) AS ok_pos FROM rv LEFT JOIN lg l
       ON l.run_id = rv.run_id AND l.role = rv.role AND l.status = 'ok' AND l.ts > rv.ts GROUP BY ALL),
rd AS (SELECT run_id, proposal_id, CASE WHEN count(ok_pos) = count(*) THEN max(ok_pos) END AS ready FROM ok GROUP BY ALL),
fo AS (SELECT ob.run_id, ob.proposal_id, min(ob.pos) FILTER (ob.pos >= pr.pos) AS o1, count(*) AS filed FROM ob JOIN pr USING (run_id, proposal_id) GROUP BY ALL),
b1 AS (SELECT p.run_id, p.proposal_id, p.filed_by, p.ts AS filed_ts, p.pos AS filed_pos, CASE WHEN o1 IS NULL OR o1 > ready THEN ready END AS ip, o1, filed
       FROM pr p LEFT JOIN rd USING (run_id, proposal_id) LEFT JOIN fo USING (run_id, proposal_id)),
b2 AS (SELECT b1.*, (SELECT min(i.pos) FROM im i WHERE i.run_id = b1.run_id AND i.proposal_id = b1.proposal_id AND i.pos > ip AND (o1 IS NULL OR i.pos < o1)) AS dp,
       (SELECT count(*) FROM im i WHERE i.run_id = b1.run_id AND i.proposal_id = b1.proposal_id) AS impls FROM b1),
b3 AS (SELECT b2.*, (SELECT count(*) FROM ob o WHERE o.run_id = b2.run_id AND o.proposal_id = b2.proposal_id AND (o.pos < b2.filed_pos OR coalesce(o.pos > dp, false))) AS dropped FROM b2),
cy AS (SELECT run_id, proposal_id, filed_by, filed_ts, CAST(filed_pos AS DOUBLE) AS filed_pos, CAST(ip AS DOUBLE) AS integrated_pos,
       CAST(CASE WHEN dp IS NULL AND ip IS NOT NULL THEN o1 END AS DOUBLE) AS reopened_pos, CAST(dp AS DOUBLE) AS done_pos, coalesce(filed, 0) - dropped AS objections, dropped,
       dropped + impls - CAST(dp IS NOT NULL AS INT) AS warnings, CASE WHEN dp IS NOT NULL THEN 'done' WHEN ip IS NOT NULL AND o1 IS NULL THEN 'integrated' ELSE 'open' END AS state FROM b3),
gp AS (SELECT run_id, pos AS gap_pos, gap AS gap_us FROM (SELECT run_id, pos, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY run_id ORDER BY pos) AS gap FROM lg) WHERE gap IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY gap DESC, pos) = 1),
wt AS (SELECT c.run_id, c.proposal_id, epoch_us(l1.ts) - epoch_us(filed_ts) AS to_integrate_us, epoch_us(l2.ts) - epoch_us(filed_ts) AS to_done_us, objections FROM cy c
       LEFT JOIN lg l1 ON l1.run_id = c.run_id AND l1.pos = c.integrated_pos LEFT JOIN lg l2 ON l2.run_id = c.run_id AND l2.pos = c.done_pos)"""
_SELECT = "SELECT run_id, proposal_id, filed_by, filed_pos, integrated_pos, reopened_pos, done_pos, objections, dropped, warnings, state FROM cy"


def _sql(select: str, base: str = _BASE) -> str:
    return with_views(base.strip() + "\n" + select, "v_runlog", "v_proposals", "v_objections", "v_implementations")


_OWED = "SELECT ok.run_id, ok.proposal_id, ok.role FROM ok JOIN cy USING (run_id, proposal_id) WHERE state = 'open' AND ok_pos IS NULL"
ORACLES = {
    "a_first_ok": _sql("SELECT * FROM ok"),
    "a_lifecycle": _sql(_SELECT),
    "a_lifecycle_as_of": _sql(_SELECT, _BASE.replace("SELECT * FROM v_runlog", "SELECT * FROM v_runlog WHERE pos <= (SELECT max(pos) // 2 FROM v_runlog)").replace("SELECT * FROM v_proposals", "SELECT * FROM v_proposals WHERE pos <= (SELECT max(pos) // 2 FROM v_runlog)").replace("SELECT * FROM v_objections", "SELECT * FROM v_objections WHERE pos <= (SELECT max(pos) // 2 FROM v_runlog)").replace("SELECT * FROM v_implementations", "SELECT * FROM v_implementations WHERE pos <= (SELECT max(pos) // 2 FROM v_runlog)")),
    "a_what_if": _sql(_SELECT, _BASE.replace("SELECT * FROM v_objections", "SELECT run_id, proposal_id, role, CAST(pos AS DOUBLE) AS pos FROM v_objections UNION ALL SELECT run_id, proposal_id, 'critic', CAST(pos + 6.5 - 9 * (proposal_id % 3) AS DOUBLE) FROM v_proposals WHERE proposal_id % 3 < 2")),
    "a_transitions": _sql("SELECT run_id, proposal_id, pos, \"to\" FROM (SELECT run_id, proposal_id, filed_pos AS pos, 'open' AS \"to\" FROM cy UNION ALL SELECT run_id, proposal_id, integrated_pos, 'integrated' FROM cy UNION ALL SELECT run_id, proposal_id, reopened_pos, 'reopened' FROM cy UNION ALL SELECT run_id, proposal_id, done_pos, 'done' FROM cy) WHERE pos IS NOT NULL"),
    "a_readable": _sql("""SELECT run_id, proposal_id, CASE WHEN state <> 'open' THEN state WHEN objections > 0 THEN 'blocked' ELSE 'objection window' END AS label,
        CASE WHEN state = 'done' THEN 'implemented at ' || CAST(done_pos AS INT) WHEN state = 'integrated' THEN 'every reviewer passed by ' || CAST(integrated_pos AS INT) WHEN reopened_pos IS NOT NULL THEN 'reopened by an objection at ' || CAST(reopened_pos AS INT)
             WHEN objections > 0 THEN objections || ' objections stand' ELSE 'awaiting reviewers' END AS why FROM cy"""),
    "a_owed": _sql(_OWED),
    "a_eligible": _sql(f"SELECT run_id, role, 'objection window: ' || proposal_id AS reason FROM ({_OWED}) UNION ALL SELECT run_id, 'engineer', 'ready to implement: ' || proposal_id FROM cy WHERE state = 'integrated'"),
    "a_contract_errors": f"""WITH o AS ({_OUT}), k AS (SELECT event_id, json_type(output) = 'OBJECT' AS obj, json_keys(output) AS ks, json_type(output, '$.k') AS kt FROM o)
        SELECT event_id, 'not an object' AS error FROM k WHERE NOT obj UNION ALL SELECT event_id, 'k is missing' FROM k WHERE obj AND NOT list_contains(ks, 'k')
        UNION ALL SELECT event_id, 'k must be a whole number' FROM k WHERE obj AND list_contains(ks, 'k') AND kt NOT IN ('UBIGINT', 'BIGINT') UNION ALL SELECT event_id, 'unknown keys' FROM k WHERE obj AND len(list_filter(ks, lambda x: x <> 'k')) > 0""",
    "a_dangling_objections": _sql("SELECT o.run_id, o.proposal_id, o.role, o.pos FROM ob o LEFT JOIN cy USING (run_id, proposal_id) WHERE filed_pos IS NULL OR filed_pos > pos OR done_pos < pos"),
    "a_role_costs": _sql("SELECT *, cost / sum(cost) OVER (PARTITION BY run_id) AS share FROM (SELECT run_id, role, count(*) AS turns, count(*) FILTER (status = 'ok_with_warnings') AS warned, count(*) FILTER (status = 'error') AS errors, sum(cost_usd) AS cost, sum(cost_usd) / count(cost_usd) AS per_turn FROM lg GROUP BY ALL)"),
    "a_longest_gap": _sql("SELECT * FROM gp"),
    "a_objection_matrix": _sql("SELECT run_id, role AS objector, " + ", ".join(f"count(*) FILTER (filed_by = '{x}') AS by_{x}" for x in r.ROLES) + ", count(DISTINCT proposal_id) AS proposals_hit FROM ob JOIN (SELECT run_id, proposal_id, filed_by FROM pr) USING (run_id, proposal_id) GROUP BY 1, 2"),
    "a_waits": _sql("SELECT * FROM wt"),
    "a_wait_summary": _sql("SELECT w.run_id, count(to_integrate_us) AS integrated, quantile_cont(CAST(to_integrate_us AS DOUBLE), 0.5) AS median_us, (SELECT count(*) FROM cy JOIN gp USING (run_id) WHERE cy.run_id = w.run_id AND filed_pos < gap_pos AND integrated_pos >= gap_pos) AS spanning FROM wt w GROUP BY 1"),
    "a_reconcile": _sql("SELECT count(*) FILTER (state = f) AS matching, count(*) FILTER (state <> f) AS differing, 0 AS missing, CAST(sum(warnings) AS BIGINT) AS warnings FROM (SELECT *, CASE proposal_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'done' ELSE 'integrated' END AS f FROM cy)"),
    "a_turn_effects": _sql("SELECT run_id, pos, list(t ORDER BY k, proposal_id) AS effects FROM (SELECT run_id, pos, 0 AS k, proposal_id, 'filed ' || proposal_id AS t FROM pr UNION ALL SELECT run_id, pos, 1, proposal_id, 'objected to ' || proposal_id FROM ob UNION ALL SELECT run_id, pos, 2, proposal_id, 'implemented ' || proposal_id FROM im) GROUP BY 1, 2"),
}

_INTERVALS = """tr AS (SELECT run_id, proposal_id, filed_pos AS pos, 'open' AS state, 0 AS k FROM cy UNION ALL SELECT run_id, proposal_id, integrated_pos, 'integrated', 1 FROM cy
   UNION ALL SELECT run_id, proposal_id, reopened_pos, 'open', 2 FROM cy UNION ALL SELECT run_id, proposal_id, done_pos, 'done', 2 FROM cy),
iv AS (SELECT run_id, proposal_id, state, pos AS from_pos, lead(pos) OVER (PARTITION BY run_id, proposal_id ORDER BY pos, k) AS to_pos FROM tr WHERE pos IS NOT NULL)"""
ORACLES["a_state_intervals"] = _sql("SELECT * FROM iv WHERE to_pos IS NULL OR to_pos > from_pos", _BASE.strip() + ",\n" + _INTERVALS)
# Plain: each position looks at every proposal's positions.
ORACLES["a_counts_at"] = _sql(
    """SELECT l.run_id, CAST(l.pos AS DOUBLE) AS pos, CAST(count(*) FILTER (filed_pos <= l.pos AND NOT coalesce(done_pos <= l.pos, false) AND (coalesce(integrated_pos, 1e18) > l.pos OR coalesce(reopened_pos <= l.pos, false))) AS BIGINT) AS open,
       CAST(count(*) FILTER (integrated_pos <= l.pos AND NOT coalesce(reopened_pos <= l.pos, false) AND NOT coalesce(done_pos <= l.pos, false)) AS BIGINT) AS integrated,
       CAST(count(*) FILTER (done_pos <= l.pos) AS BIGINT) AS done FROM lg l LEFT JOIN cy USING (run_id) GROUP BY 1, 2"""
)
_KIND = "CASE json_type({0}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"
ORACLES["a_output_errors"] = f"""WITH o AS ({_NESTED}), j AS (SELECT event_id, CASE WHEN json_valid(output) THEN CAST(output AS JSON) END AS v FROM o),
 t AS (SELECT event_id, v, {_KIND.format("v")} AS k FROM j WHERE v IS NOT NULL), ob AS (SELECT * FROM t WHERE k = 'object'),
 rl AS (SELECT event_id, {_KIND.format("v->'$.role'")} AS k FROM ob WHERE list_contains(json_keys(v), 'role')),
 it AS (SELECT event_id, v->'$.items' AS v, {_KIND.format("v->'$.items'")} AS k FROM ob WHERE list_contains(json_keys(v), 'items')),
 el AS (SELECT event_id, unnest(CAST(v AS JSON[])) AS v, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS i FROM it WHERE k = 'array'),
 ek AS (SELECT *, {_KIND.format("v")} AS k FROM el), eo AS (SELECT *, json_keys(v) AS ks FROM ek WHERE k = 'object'),
 ei AS (SELECT event_id, i, {_KIND.format("v->'$.id'")} AS k FROM eo WHERE list_contains(ks, 'id')),
 eg AS (SELECT event_id, i, v->'$.tags' AS v, {_KIND.format("v->'$.tags'")} AS k FROM eo WHERE list_contains(ks, 'tags')),
 tg AS (SELECT event_id, i, unnest(CAST(v AS JSON[])) AS v, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS n FROM eg WHERE k = 'array')
SELECT event_id, '$' AS path, 'not JSON' AS error FROM j WHERE v IS NULL
UNION ALL SELECT event_id, '$', 'expected object, got ' || k FROM t WHERE k <> 'object'
UNION ALL SELECT event_id, '$', 'missing role' FROM ob WHERE NOT list_contains(json_keys(v), 'role')
UNION ALL SELECT event_id, '$', 'not allowed: ' || k FROM (SELECT event_id, unnest(json_keys(v)) AS k FROM ob) WHERE k NOT IN ('role', 'items')
UNION ALL SELECT event_id, '$.role', 'expected string, got ' || k FROM rl WHERE k <> 'string'
UNION ALL SELECT event_id, '$.items', 'expected array, got ' || k FROM it WHERE k <> 'array'
UNION ALL SELECT event_id, '$.items[' || i || ']', 'expected object, got ' || k FROM ek WHERE k <> 'object'
UNION ALL SELECT event_id, '$.items[' || i || ']', 'missing id' FROM eo WHERE NOT list_contains(ks, 'id')
UNION ALL SELECT event_id, '$.items[' || i || ']', 'not allowed: ' || k FROM (SELECT event_id, i, unnest(ks) AS k FROM eo) WHERE k NOT IN ('id', 'tags')
UNION ALL SELECT event_id, '$.items[' || i || '].id', 'expected number, got ' || k FROM ei WHERE k <> 'number'
UNION ALL SELECT event_id, '$.items[' || i || '].tags', 'expected array or null, got ' || k FROM eg WHERE k NOT IN ('array', 'null')
UNION ALL SELECT event_id, '$.items[' || i || '].tags[' || n || ']', 'expected string, got ' || {_KIND.format("v")} FROM tg WHERE {_KIND.format("v")} <> 'string'"""
ORACLES["a_turn_errors"] = _sql(
    """SELECT run_id, pos, error FROM wr UNION ALL SELECT o.run_id, o.pos, 'objection dropped: ' || o.proposal_id FROM ob o LEFT JOIN cy USING (run_id, proposal_id)
       WHERE (filed_pos IS NULL OR filed_pos > o.pos OR done_pos < o.pos) AND NOT EXISTS (SELECT 1 FROM wr WHERE wr.run_id = o.run_id AND wr.pos = o.pos)""",
    _BASE.strip() + f""",
ou AS ({_OUTPUTS}),
wr AS (SELECT ou.run_id, ou.pos, CASE WHEN lg.role IS NULL THEN 'no such turn' ELSE 'activated ' || lg.role || ', output says ' || coalesce(ou.role, 'nothing') END AS error
       FROM ou LEFT JOIN lg ON lg.run_id = ou.run_id AND lg.pos = ou.pos WHERE lg.role IS NULL OR ou.role IS DISTINCT FROM lg.role)""",
)
