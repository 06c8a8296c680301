"""SQL for resampled metrics, sweeps and studies, in DuckDB's dialect; the rest is in plans/oracle.py."""

from __future__ import annotations

from evidra.functions.draws import CUTS, FIRST, SECOND, STEP, WORD
from evidra.plans.oracle import (
    _AT, _TOP, _pl, AVERAGE, DECISION_POINTS, DOC, ENTROPY, FOLD, GATES, LONG, RES, SCORED, SIDES, STAT, R, decided, detection, report, searched, state, tuned_decisions, VOTE)
from evidra.plans.oracle import ORACLE_SQL as ORACLE
from evidra.plans.views import SQL

GOLD = ("supported", "refuted", "insufficient", "conflicting")


def drawn(source: str, key: str, resamples: int, name: str, seed: int = 42) -> str:
    """A CTE: rows of source with r (resample; -1: what was observed) and w, those of weight 0 left out."""
    word = lambda at: f"(('0x' || substr(dg_, {at}, 8))::BIGINT & {WORD - 1})"
    x = f"(SELECT s.* EXCLUDE (dg_), {word(9)} AS b_, r, ({word(1)} + (r + {seed * 1_000_003}) * {STEP}) % {WORD} AS x_ FROM (SELECT *, md5({key}) AS dg_ FROM {source}) s, range(-1, {resamples}) t(r))"

    def mixed(x: str) -> str:
        for shift, factor in ((15, FIRST), (12, SECOND), (15, None)):
            x = f"(SELECT * REPLACE (xor(x_, x_ >> {shift}) AS x_) FROM {x})"
            x = f"(SELECT * REPLACE (x_ * {factor} % {WORD} AS x_) FROM {x})" if factor else x
        return x

    x = mixed(f"(SELECT * REPLACE (xor(x_, b_) AS x_) FROM {mixed(x)})")
    times = " ".join(f"WHEN x_ < {cut} THEN {k}" for k, cut in enumerate(CUTS))
    return f"{name} AS MATERIALIZED (SELECT * FROM (SELECT * EXCLUDE (x_, b_), CASE WHEN r < 0 THEN 1 {times} ELSE {len(CUTS)} END AS w FROM {x}) WHERE w > 0)"


def label_values(source: str, keys: str, sides: list[str], labels=GOLD) -> str:
    """CTEs up to lv (keys, side, metric, r, value, n) of a drawn table (keys, gold_state, sides, r, w)."""
    k = f"{keys}, " if keys else ""
    each = " UNION ALL ".join(f"SELECT {k}r, '{s}' AS side, gold_state, {s} AS predicted, w FROM lb" for s in sides)
    inside = ", ".join(f"'{x}'" for x in labels)
    return f"""lb AS (SELECT {k}r, gold_state, {", ".join(sides)}, sum(w) AS w FROM {source} GROUP BY ALL), ls AS ({each}),
        lc AS (SELECT {k}side, r, label, sum(tp) AS tp, sum(s) AS s, sum(p) AS p FROM (
            SELECT {k}side, r, gold_state AS label, CASE WHEN gold_state = predicted THEN w ELSE 0 END AS tp, w AS s, 0 AS p FROM ls UNION ALL SELECT {k}side, r, predicted, 0, 0, w FROM ls) GROUP BY ALL),
        lm AS (SELECT {k}side, r, sum(tp) / sum(s) AS accuracy, sum(CASE WHEN label IN ({inside}) THEN 2 * tp / (p + s) ELSE 0 END) / {len(labels)} AS macro_f1, sum(s)::BIGINT AS n FROM lc GROUP BY ALL),
        lv AS (SELECT {k}side, r, 'accuracy' AS metric, accuracy AS value, n FROM lm UNION ALL SELECT {k}side, r, 'macro_f1', macro_f1, n FROM lm)"""


def auroc_values(source: str, keys: str, name: str = "av") -> str:
    """CTEs up to av (keys, r, value) of a drawn table (keys, score, positive, r, w)."""
    return f"""{name}_s AS (SELECT {keys}, r, score, sum(positive * w) AS p, sum(w) AS n FROM {source} GROUP BY ALL),
        {name}_c AS (SELECT *, sum(p) OVER o AS tp, sum(n) OVER o AS seen, sum(p) OVER k AS pp, sum(n) OVER k AS nn FROM {name}_s WINDOW k AS (PARTITION BY {keys}, r), o AS (PARTITION BY {keys}, r ORDER BY score DESC)),
        {name} AS (SELECT {keys}, r, CASE WHEN max(pp) > 0 AND max(pp) < max(nn) THEN sum(p * ((nn - pp) - (seen - tp) + (n - p) / 2)) / (max(pp) * (max(nn) - max(pp))) END AS value FROM {name}_c GROUP BY ALL)"""


def summary(source: str, keys: str) -> str:
    """A query (keys, observed, low, high, p_value, n_resamples) of a table (keys, r, value)."""
    inside = "r >= 0 AND value IS NOT NULL"
    return f"""SELECT {keys}, max(value) FILTER (r < 0) AS observed, max(value) FILTER (d AND k = floor(n_ * 0.025)) AS low, max(value) FILTER (d AND k = least(floor(n_ * 0.975), n_ - 1)) AS high,
        least(1, 2 * least(count(*) FILTER (d AND value <= 0), count(*) FILTER (d AND value >= 0)) / max(n_)) AS p_value, max(n_)::BIGINT AS n_resamples
        FROM (SELECT *, {inside} AS d, row_number() OVER (PARTITION BY {keys}, {inside} ORDER BY value, r) - 1 AS k, count(*) FILTER ({inside}) OVER (PARTITION BY {keys}) AS n_ FROM {source}) GROUP BY {keys}"""


def rivals(source: str, keys: str, reference: str, name: str = "name") -> str:
    """CTEs dl (keys, rival, r, value) and a query part (keys, rival, both values, delta ...) of a table (keys, name, r, value)."""
    k = f"{keys}, " if keys else ""
    on = " AND ".join(f"a.{x.strip()} = b.{x.strip()}" for x in [*keys.split(","), "r"] if x.strip())
    pick = "".join(f"a.{x.strip()}, " for x in keys.split(",") if x.strip())
    return f"""dl AS (SELECT {pick}b.{name} AS rival, a.r, a.value AS value_reference, b.value AS value_rival, a.value - b.value AS value FROM {source} a JOIN {source} b ON {on} WHERE a.{name} = '{reference}' AND b.{name} <> '{reference}'),
        sm AS ({summary("dl", k + "rival")}), cmp AS (SELECT sm.*, value_reference, value_rival FROM sm JOIN dl USING ({k}rival) WHERE dl.r < 0)"""


CMP = R("value_reference AS value_reference", "value_rival AS value_rival", "observed AS delta", "low", "high", "p_value") + ", n_resamples"
PAIRED = f"SELECT metric, {R('observed AS difference', 'low', 'high', 'p_value')}, n_resamples, (SELECT max(n) FROM lv WHERE r < 0) AS n_claims FROM ({summary('dv', 'metric')})"
_DV = "dv AS (SELECT a.metric, a.r, a.value - b.value AS value FROM lv a JOIN lv b USING (metric, r) WHERE a.side = 'predicted_a' AND b.side = 'predicted_b')"
_PROXY = {
    "one_minus_abs_margin": "1 - abs(score_support - score_refute)", "min_mean": "least(score_support, score_refute)", "mean_product": "score_support * score_refute", "max_product": "conflict_max_product",
    "min_max": "min_max", "sr_std": "conflict_sr_std", "document_count": "document_count", "mean_unknown": "score_unknown", "min_unknown": "min_unknown", "unknown_product": "insufficiency_uprod",
}
_TASKED = [("conflict", "ds", "k_doc", "res"), ("insufficiency", "ds", "m_theta", "res"), *(("insufficiency" if "unknown" in n else "conflict", n, x, "stat") for n, x in _PROXY.items())]
TASKS = "rows AS (" + " UNION ALL ".join(f"SELECT '{t}' AS task, '{n}' AS name, claim_id, round(({x})::DOUBLE, 9) AS score, (gold_state = '{'conflicting' if t == 'conflict' else 'insufficient'}')::INT AS positive FROM {of}" for t, n, x, of in _TASKED) + ")"
AURC = """rk AS (SELECT name, r, correct, w, sum(w) OVER o AS k, sum(correct * w) OVER o AS hits, sum(w) OVER (PARTITION BY name, r) AS n FROM dr WINDOW o AS (PARTITION BY name, r ORDER BY risk_score, order_key ROWS UNBOUNDED PRECEDING)),
    cov AS (SELECT round(0.5 + 0.02 * i, 2)::DOUBLE AS coverage FROM range(26) t(i)),
    rc AS (SELECT name, r, 1 - (hits - (k - want) * correct) / want AS risk FROM (SELECT *, greatest(1, round_even(n * coverage, 0)) AS want FROM rk, cov) WHERE want > k - w AND want <= k),
    ac AS (SELECT name, r, avg(risk) AS value FROM rc GROUP BY ALL)"""


def runs(tag: str, evidence: str) -> str:
    """A table of the baselines' predictions."""
    from evidra.plans.oracle import BASES

    parts = (f"SELECT '{m}' AS method, claim_id, gold_state, state AS predicted FROM ({q.replace(SQL, evidence) + decided(aware=m == 'conflict_aware')} SELECT * FROM base)" for m, q in BASES.items())
    return f"{tag} AS (" + " UNION ALL ".join(parts) + ")"


FULL = SQL.replace("reliability AS doc_reliability", "1::DOUBLE AS doc_reliability").replace("SELECT sample_id, sample_id, doc_id, pos, reliability, 'e2'", "SELECT sample_id, sample_id, doc_id, pos, 1::DOUBLE, 'e2'")
_VOTES = "floor(4 * a + 1e-9::DOUBLE) AS va, floor(4 * b + 1e-9::DOUBLE) AS vb, floor(4 * c + 1e-9::DOUBLE) AS vc"
_LEAD = lambda s="": f"CASE WHEN ({' + '.join(f'({_TOP} - p_{k} <= 1e-9)::INT' for k in ('support', 'refute', 'unknown'))}) > 1 THEN NULL {' '.join(f'WHEN {_TOP} - p_{k} <= 1e-9 THEN {chr(39)}{k}{chr(39)}' for k in ('support', 'refute', 'unknown'))} END"
VOTED = SQL + f""", voted AS (SELECT sample_id, sample_id AS claim_id, doc_id, {", ".join(f"CASE WHEN va + vb + vc > 0 THEN {v} / (va + vb + vc) ELSE 1 / 3 END AS p_{k}" for k, v in (("support", "va"), ("refute", "vb"), ("unknown", "vc")))}
        FROM (SELECT *, {_VOTES} FROM contexts))"""
THREE = VOTED + f""", tops AS (SELECT 'oracle' AS side, claim_id, doc_id, p_support, p_refute, p_unknown, {_LEAD()} AS top FROM voted UNION ALL SELECT CASE evaluator WHEN 'e1' THEN 'reference' ELSE 'rival' END, claim_id, doc_id, p_support, p_refute, p_unknown, {_LEAD()} FROM evidence),
    met AS (SELECT o.claim_id, o.doc_id, o.top AS oracle, a.top AS reference, b.top AS rival, {", ".join(f"{t}.p_{k} AS {n}_{k}" for t, n in (("a", "reference"), ("b", "rival")) for k in ("support", "refute", "unknown"))}
        FROM tops o JOIN tops a ON a.claim_id = o.claim_id AND a.doc_id = o.doc_id AND a.side = 'reference' JOIN tops b ON b.claim_id = o.claim_id AND b.doc_id = o.doc_id AND b.side = 'rival' WHERE o.side = 'oracle')"""
KEY = "claim_id || '/' || claim_id"


def swept(parts: list[tuple[str, str, str, str]]) -> str:
    """CTEs up to points of settings (name, mean reliability, document reliability, oracle) over evidence with known."""
    each = " UNION ALL ".join(f"SELECT '{n}' AS setting, claim_id, evaluator, evaluator_reliability AS er, {r} AS r, p_support AS s, p_refute AS f FROM evidence" for n, _, r, _ in parts)
    names = ", ".join(f"('{n}', {m}, {o})" for n, m, _, o in parts)
    return f""", names(setting, mean_reliability, is_oracle) AS (VALUES {names}), lev AS ({each}),
        ld AS (SELECT setting, claim_id, er, (qs - qt) / nn AS s, (qr - qt) / nn AS f, greatest(0, least(1, 1 - nn)) AS k FROM (SELECT *, qs + qr - qt AS nn FROM (
            SELECT setting, claim_id, evaluator, min(er) AS er, product(1 - r * f) AS qs, product(1 - r * s) AS qr, product(1 - r * s - r * f) AS qt FROM lev GROUP BY 1, 2, 3))),
        lf AS (SELECT setting, claim_id, k AS k_doc, (qs - qt) / nn AS m_support, (qr - qt) / nn AS m_refute, qt / nn AS m_theta FROM (SELECT *, qs + qr - qt AS nn FROM (
            SELECT setting, claim_id, sum(er * k) / sum(er) AS k, product(1 - er * f) AS qs, product(1 - er * s) AS qr, product(1 - er * s - er * f) AS qt FROM ld GROUP BY 1, 2))),
        lr AS (SELECT setting, gold_state, m_theta, k_doc, coalesce({state('0.2371', '0.3137')}, 'undetermined') AS predicted FROM (SELECT n.setting, c.gold_state, coalesce(m_support, 0) AS m_support, coalesce(m_refute, 0) AS m_refute,
            coalesce(m_theta, 1) AS m_theta, coalesce(k_doc, 0) AS k_doc FROM claims c CROSS JOIN names n LEFT JOIN lf ON lf.claim_id = c.claim_id AND lf.setting = n.setting))""" + report("lr", "setting", "_w") + """,
        points AS (SELECT n.setting, mean_reliability, accuracy, macro_f1, macro_f1 - (SELECT macro_f1 FROM rep_w WHERE setting = '1.0') AS delta, mean_theta, mean_k_doc, share_insufficient, share_conflicting, n, is_oracle FROM names n JOIN rep_w USING (setting) JOIN (
            SELECT setting, avg(m_theta) AS mean_theta, avg(k_doc) AS mean_k_doc, avg((predicted = 'insufficient')::INT) AS share_insufficient, avg((predicted = 'conflicting')::INT) AS share_conflicting FROM lr GROUP BY 1) USING (setting))"""


_SHOWN = R("accuracy", "macro_f1", "delta", "mean_theta", "mean_k_doc", "share_insufficient", "share_conflicting") + ", n"
_KNOWN = ENTROPY.replace("SELECT p.* REPLACE (k.reliability AS doc_reliability)", "SELECT p.*, k.reliability AS own")


def verdicts(settings: list[tuple[str, float, float, float, float]]) -> str:
    """SQL up to vd (setting, method, claim_id, gold_state, margin, predicted)."""
    rows = ", ".join(f"('{n}', {', '.join(f'{x}::DOUBLE' for x in v)})" for n, *v in settings)
    return SQL + f""", st(setting, hi, me, lo, un) AS (VALUES {rows}),
        sev AS (SELECT setting, claim_id, evaluator, evaluator_reliability AS er, CASE source_id % 4 WHEN 0 THEN hi WHEN 1 THEN me WHEN 2 THEN lo ELSE un END AS r, p_support AS s, p_refute AS f, p_unknown AS u FROM evidence JOIN contexts USING (sample_id, doc_id), st),
        vdoc AS (SELECT setting, claim_id, er, (qs - qt) / nn AS s, (qr - qt) / nn AS f FROM (SELECT *, qs + qr - qt AS nn FROM (
            SELECT setting, claim_id, evaluator, min(er) AS er, product(1 - r * f) AS qs, product(1 - r * s) AS qr, product(1 - r * s - r * f) AS qt FROM sev GROUP BY 1, 2, 3))),
        vf AS (SELECT setting, claim_id, (qs - qr) / (qs + qr - qt) AS margin FROM (SELECT setting, claim_id, product(1 - er * f) AS qs, product(1 - er * s) AS qr, product(1 - er * s - er * f) AS qt FROM vdoc GROUP BY 1, 2)),
        vp AS (SELECT setting, claim_id, sum(r * er * (s - f)) / nullif(sum(r * er), 0) AS average, avg(CASE WHEN s = greatest(s, f, u) AND f <> s THEN 1 WHEN f = greatest(s, f, u) AND s <> f THEN -1 ELSE 0 END) AS votes FROM sev GROUP BY 1, 2),
        vc AS (SELECT setting, claim_id, gold_state FROM claims, st WHERE gold_state IN ('supported', 'refuted')),
        vm AS (SELECT setting, 'ds' AS method, claim_id, gold_state, coalesce(margin, 0) AS margin FROM vc LEFT JOIN vf USING (setting, claim_id) UNION ALL SELECT setting, 'weighted_average', claim_id, gold_state, coalesce(average, 0) FROM vc LEFT JOIN vp USING (setting, claim_id)
            UNION ALL SELECT setting, 'majority_vote', claim_id, gold_state, coalesce(votes, 0) FROM vc LEFT JOIN vp USING (setting, claim_id)),
        vd AS (SELECT *, CASE WHEN margin > 1e-6 THEN 'supported' WHEN margin < -1e-6 THEN 'refuted' ELSE 'undetermined' END AS predicted, round(margin, 9) AS score, (gold_state = 'supported')::INT AS positive FROM vm)"""


VREP = report("vd", "setting, method", "_v").replace("avg(f1) FILTER (support > 0) AS macro_f1", "sum(CASE WHEN label IN ('supported', 'refuted') THEN f1 ELSE 0 END) / 2 AS macro_f1") + detection("vd", "setting, method") + """,
    vx AS (SELECT setting, method, count(*) FILTER (predicted NOT IN ('supported', 'refuted')) AS undetermined, 0::BIGINT AS ds_undefined, count(*) FILTER (predicted = 'supported') AS predicted_supported FROM vd GROUP BY ALL)"""
TWO = [("none", 1, 1, 1, 1), ("credibility", 1.0, 0.6, 0.2, 0.6)]
TWELVE = [(f"low={a},unrated={b}", 1.0, 0.6, a, b) for a in (0.0, 0.2, 0.4) for b in (0.4, 0.6, 0.8, 1.0)]
VPAIRS = [("ds@credibility", "ds@none"), ("weighted_average@credibility", "weighted_average@none"), ("ds@credibility", "weighted_average@credibility"), ("ds@none", "weighted_average@none"), ("ds@credibility", "majority_vote@none")]

SEEDED = GATES.replace(", inn AS (SELECT o.x AS outer_fold, g.* FROM gates g, range(5) o(x) WHERE o.x <> g.fold)", "") + ", seeds AS (" + " UNION ALL ".join(f"SELECT {s} AS seed, claim_id, {FOLD.format(5).replace('42:', f'{s}:')} AS fold FROM claims" for s in (42, 1, 2, 3, 4)) + """),
    sgates AS (SELECT seed, s.fold, g.* EXCLUDE (fold) FROM gates g JOIN seeds s USING (claim_id)), inn AS (SELECT o.x AS outer_fold, g.* FROM sgates g, range(5) o(x) WHERE o.x <> g.fold)"""


def keyed(sql: str, key: str) -> str:
    """tuned_decisions() with a further key (seed) beside the outer fold."""
    for a, b in (("outer_fold, method", f"{key}, outer_fold, method"), ("SELECT o.x AS outer_fold, d.*", f"SELECT o.x AS outer_fold, {key}, d.*"), ("SELECT outer_fold, b.method", f"SELECT {key}, outer_fold, b.method"),
                 ("min(decision) AS a, max(decision) AS b FROM flat GROUP BY 1, 2)", "min(decision) AS a, max(decision) AS b FROM flat GROUP BY 1, 2, 3)"), ("shared AS (SELECT outer_fold, CASE", f"shared AS (SELECT {key}, outer_fold, CASE"),
                 ("method) GROUP BY 1)", "method) GROUP BY 1, 2)"), ("SELECT s.outer_fold AS fold", f"SELECT s.{key}, s.outer_fold AS fold"), ("ON o.outer_fold = s.outer_fold", f"ON o.{key} = s.{key} AND o.outer_fold = s.outer_fold")):
        sql = sql.replace(a, b)
    return sql


_FIN = f"SELECT {{0}}g.method, gold_state, coalesce({state('theta', 'conflict')}, 'undetermined') AS predicted FROM {{1}} g JOIN pick_i p ON {{2}}g.fold = p.outer_fold AND g.method = p.method"
# evidence beside each outer fold, with evaluators as the other folds' claims suggest
EST_GATES = """, oev AS (SELECT outer_fold, claim_id, evaluator, doc_reliability AS dr, reliability AS er, doc_id, p_support AS s, p_refute AS f, p_unknown AS u FROM evidence JOIN est USING (evaluator)),
    ofu AS (SELECT outer_fold, claim_id, coalesce(sum(reliability * k_doc) / nullif(sum(reliability), 0), 0) AS k_doc, product(1 - reliability * m_refute) AS qs, product(1 - reliability * m_support) AS qr, product(1 - reliability * m_support - reliability * m_refute) AS qt FROM doc JOIN est USING (evaluator) GROUP BY 1, 2),
    oc AS (SELECT o.x AS outer_fold, c.claim_id, c.gold_state, fold FROM claims c JOIN folds USING (claim_id), range(5) o(x)),
    ost AS (SELECT outer_fold, claim_id, sum(dr * er * s) / nullif(sum(dr * er), 0) AS ss, sum(dr * er * f) / nullif(sum(dr * er), 0) AS sf, sum(dr * er * u) / nullif(sum(dr * er), 0) AS su, sqrt(sum(dr * er * (s - f - mean) ** 2) / nullif(sum(dr * er), 0)) AS dev, max(dr * er * s) * max(dr * er * f) AS mp,
        1 - 1 / count(DISTINCT doc_id) AS dc, product(1 - dr * er * (1 - u)) AS up FROM (SELECT *, sum(dr * er * (s - f)) OVER k / nullif(sum(dr * er) OVER k, 0) AS mean FROM oev WINDOW k AS (PARTITION BY outer_fold, claim_id)) GROUP BY 1, 2),
    og AS (SELECT oc.*, coalesce((qs - qt) / (qs + qr - qt), 0) AS m_support, coalesce((qr - qt) / (qs + qr - qt), 0) AS m_refute, coalesce(qt / (qs + qr - qt), 1) AS m_theta, coalesce(k_doc, 0) AS k_doc, coalesce(ss, 0) AS ss, coalesce(sf, 0) AS sf, coalesce(su, 1) AS su, coalesce(dev, 0) AS sr_std,
        CASE WHEN ss IS NULL THEN 0 ELSE mp END AS max_product, CASE WHEN ss IS NULL THEN 0 ELSE dc END AS doc_count, CASE WHEN ss IS NULL THEN 1 ELSE up END AS up, ss IS NULL AS none FROM oc LEFT JOIN ofu USING (outer_fold, claim_id) LEFT JOIN ost USING (outer_fold, claim_id)),
    egates AS (SELECT 'ds' AS method, outer_fold, fold, claim_id, gold_state, round(m_support, 9) AS m_support, round(m_refute, 9) AS m_refute, round(m_theta, 9) AS m_theta, round(k_doc, 9) AS k_doc FROM og """ + " ".join(
    f"UNION ALL SELECT 'stat_gate_{c}{t}', outer_fold, fold, claim_id, gold_state, round(ss, 9), round(sf, 9), round({'up' if t else 'su'}, 9), round({c}, 9) FROM og" for c in ("sr_std", "max_product", "doc_count") for t in ("", "_uprod")) + """),
    inn AS (SELECT * FROM egates WHERE fold <> outer_fold)"""
EST_BASES = """, escored AS (SELECT m.method, outer_fold, fold, claim_id, gold_state, round(CASE m.method WHEN 'majority_vote' THEN coalesce(v.score_support, 0) WHEN 'single_evaluator' THEN coalesce(o.score_support, 0) ELSE ss END, 9) AS s,
        round(CASE m.method WHEN 'majority_vote' THEN coalesce(v.score_refute, 0) WHEN 'single_evaluator' THEN coalesce(o.score_refute, 0) ELSE sf END, 9) AS f, round(CASE m.method WHEN 'majority_vote' THEN coalesce(v.score_unknown, 1) WHEN 'single_evaluator' THEN coalesce(o.score_unknown, 1) ELSE su END, 9) AS u
        FROM og LEFT JOIN sc_majority_vote v USING (claim_id) LEFT JOIN sc_single_evaluator o USING (claim_id), (VALUES ('weighted_average'), ('majority_vote'), ('single_evaluator'), ('conflict_aware')) m(method)),
    edecided AS (SELECT *, greatest(s, f, u) AS top, least(s, f) AS low, abs(s - f) AS gap,
        CASE WHEN (top - s <= 1e-6)::INT + (top - f <= 1e-6)::INT + (top - u <= 1e-6)::INT > 1 OR u = top THEN 'insufficient' WHEN s = top THEN 'supported' ELSE 'refuted' END AS label FROM escored)"""
# the best Macro-F1 of each evaluator alone
F1_EST = f""", folds AS (SELECT claim_id, {FOLD.format(5)} AS fold FROM claims), ow AS (SELECT evaluator, claim_id, sum(doc_reliability * p_support) / sum(doc_reliability) AS s, sum(doc_reliability * p_refute) / sum(doc_reliability) AS f, sum(doc_reliability * p_unknown) / sum(doc_reliability) AS u FROM evidence GROUP BY 1, 2),
    oe AS (SELECT e.evaluator, c.gold_state, o.x AS outer_fold, coalesce(round(s, 9), 0) AS s, coalesce(round(f, 9), 0) AS f, coalesce(round(u, 9), 1) AS u FROM claims c JOIN folds USING (claim_id) CROSS JOIN (VALUES ('e1'), ('e2')) e(evaluator) CROSS JOIN range(5) o(x) LEFT JOIN ow ON ow.evaluator = e.evaluator AND ow.claim_id = c.claim_id WHERE o.x <> fold),
    ol AS (SELECT *, greatest(s, f, u) AS top, CASE WHEN (top - s <= 1e-6)::INT + (top - f <= 1e-6)::INT + (top - u <= 1e-6)::INT > 1 OR u = top THEN 'insufficient' WHEN s = top THEN 'supported' ELSE 'refuted' END AS label FROM oe),
    ot AS (SELECT evaluator, outer_fold, decision, gold_state, CASE WHEN top < decision THEN 'insufficient' ELSE label END AS predicted FROM ol, {DECISION_POINTS})""" + report("ot", "evaluator, outer_fold, decision", "_o") + """,
    est AS (SELECT outer_fold, evaluator, greatest(0, least(1, (max(macro_f1) - 0.25) / 0.75)) AS reliability, max(macro_f1) AS skill FROM rep_o GROUP BY 1, 2)"""


def estimated(est: str) -> str:
    """The methods' pooled reports with estimated reliabilities; est: CTEs up to est and folds."""
    tuned = tuned_decisions([0.1], False).replace("bi AS (SELECT o.x AS outer_fold, d.* FROM decided d JOIN folds USING (claim_id), range(5) o(x) WHERE o.x <> fold)", "bi AS (SELECT * FROM edecided WHERE fold <> outer_fold)")
    return DOC + est + EST_GATES + SCORED + EST_BASES + searched("inn", "method, outer_fold", "_i", steps=5) + tuned + ", fin AS (" + _FIN.format("", "egates", "g.outer_fold = p.outer_fold AND ") + f""" UNION ALL SELECT d.method, gold_state, {_AT.replace("method", "d.method")} FROM edecided d JOIN chosen c ON c.fold = d.outer_fold AND c.method = d.method WHERE d.fold = d.outer_fold)""" + report("fin", "method", "_f") + f" SELECT method, {R('accuracy', 'macro_f1')}, n FROM rep_f"


JUDGE = SQL + """, judged AS (SELECT claim_id, gold_state, CASE WHEN claim_id % 9 = 0 THEN 'missing' WHEN label = 'other' OR refused THEN 'invalid' ELSE 'valid' END AS status, CASE WHEN claim_id % 9 <> 0 THEN label END AS label, claim_id % 9 <> 0 AND refused AS refused,
        CASE WHEN claim_id % 9 <> 0 THEN claim_id % 50 + 100 END AS input_tokens, CASE WHEN claim_id % 9 <> 0 THEN claim_id % 3 + 5 END AS output_tokens
        FROM (SELECT *, ['supported', 'refuted', 'insufficient', 'conflicting', 'other'][(claim_id * 7 % 5 + 1)::INT] AS label, claim_id % 14 = 0 AS refused FROM claims))"""
#: Each pair's labels as shares (w), by the fold of its claim, beside its annotation.
LABELLED = VOTED + f""", fo AS (SELECT sample_id, {FOLD.format(5)} AS fold FROM claims), lv AS (SELECT claim_id, doc_id, pos, doc_reliability, evaluator, {VOTE} AS v FROM evidence),
    lw AS (SELECT claim_id, doc_id, any_value(pos) AS pos, any_value(doc_reliability) AS doc_reliability, avg((v = 'supported')::INT) AS entailment, avg((v = 'unknown')::INT) AS neutral, avg((v = 'refuted')::INT) AS contradiction FROM lv GROUP BY 1, 2),
    met AS (SELECT lw.*, fold, o.p_support, o.p_refute, o.p_unknown, CASE WHEN (p_support = greatest(p_support, p_refute, p_unknown))::INT + (p_refute = greatest(p_support, p_refute, p_unknown))::INT + (p_unknown = greatest(p_support, p_refute, p_unknown))::INT > 1 THEN 'tie'
            WHEN p_support = greatest(p_support, p_refute, p_unknown) THEN 'support' WHEN p_refute = greatest(p_support, p_refute, p_unknown) THEN 'refute' ELSE 'unknown' END AS lead FROM lw JOIN voted o USING (claim_id, doc_id) JOIN fo ON fo.sample_id = lw.claim_id),
    cells AS (SELECT 'entailment' AS label, entailment AS w, * FROM met UNION ALL SELECT 'neutral', neutral, * FROM met UNION ALL SELECT 'contradiction', contradiction, * FROM met),
    mp AS (SELECT label, sum(w) AS weight, sum(w * p_support) / sum(w) AS s, sum(w * p_refute) / sum(w) AS f, sum(w * p_unknown) / sum(w) AS u, count(*) FILTER (w > 0.5) AS majority_pairs, count(*) AS pair_count,
        {", ".join(f"count(*) FILTER (w > 0.5 AND lead = '{m}') AS met_{m}" for m in ("support", "refute", "unknown", "tie"))} FROM cells WHERE fold = 0 GROUP BY label)"""

ORACLE_SQL = {
    "paired_bootstrap": RES + ", wa AS (SELECT claim_id, state FROM (" + AVERAGE + decided() + " SELECT claim_id, state FROM base)), two AS (SELECT claim_id, gold_state, predicted AS predicted_a, state AS predicted_b FROM lab JOIN wa USING (claim_id)), " + drawn("two", "claim_id::VARCHAR", 200, "dr") + ", " + label_values("dr", "", ["predicted_a", "predicted_b"]) + f", {_DV} {PAIRED}",
    "bootstrap_interval": RES + ", one AS (SELECT claim_id, gold_state, predicted FROM lab), " + drawn("one", "claim_id::VARCHAR", 200, "dr") + ", " + label_values("dr", "", ["predicted"]) + f" SELECT metric, {R('observed', 'low', 'high')}, n_resamples, (SELECT max(n) FROM lv WHERE r < 0) AS n_claims FROM ({summary('lv', 'metric')})",
    "compare_runs": f"WITH {runs('ra', SQL)}, {runs('rb', FULL)}, two AS (SELECT a.method, claim_id, a.gold_state, a.predicted AS predicted_a, b.predicted AS predicted_b FROM ra a JOIN rb b USING (method, claim_id)), " + drawn("two", "claim_id::VARCHAR", 200, "dr") + ", " + label_values("dr", "method", ["predicted_a", "predicted_b"]) + f""",
        dv AS (SELECT a.method, a.metric, a.r, a.value - b.value AS value FROM lv a JOIN lv b USING (method, metric, r) WHERE a.side = 'predicted_a' AND b.side = 'predicted_b')
        SELECT method, metric, {R('observed AS difference', 'low', 'high', 'p_value')}, n_resamples, (SELECT max(n) FROM lv WHERE r < 0) AS n_claims FROM ({summary('dv', 'method, metric')})""",
    "paired_auroc_bootstrap": RES + STAT.removeprefix(SQL) + f", {TASKS}, " + drawn("rows", KEY, 50, "dr") + ", " + auroc_values("dr", "task, name") + ", " + rivals("av", "task", "ds") + " SELECT task, 'ds' AS reference, rival, " + CMP.replace("AS value_reference", "AS auroc_reference").replace("AS value_rival", "AS auroc_rival") + " FROM cmp",
    "paired_selective_bootstrap": f"WITH {LONG}, risks AS (SELECT method AS name, claim_id, round(1 - confidence, 9) AS risk_score, claim_id AS order_key, (predicted = gold_state)::INT AS correct, risk_score AS score, 1 - correct AS positive FROM pred WHERE method IN ('ds', 'weighted_average')), " + drawn("risks", "claim_id::VARCHAR", 2000, "dr") + ", " + auroc_values("dr", "name") + f", {AURC}, both_metrics AS (SELECT 'auroc' AS metric, * FROM av UNION ALL SELECT 'aurc', * FROM ac), " + rivals("both_metrics", "metric", "ds") + f" SELECT metric, 'ds' AS reference, rival, {CMP} FROM cmp",
    "comparison_report": f"WITH {LONG}" + report("pred", "method") + ", rows AS (SELECT method, 'conflict' AS name, round(conflict_score, 9) AS score, (gold_state = 'conflicting')::INT AS positive FROM pred UNION ALL SELECT method, 'insufficiency', round(insufficiency_score, 9), (gold_state = 'insufficient')::INT FROM pred)" + detection("rows", "method, name") + f" SELECT r.method, {R('accuracy', 'macro_f1')}, r.n, " + ", ".join(f"round({t}.{c}, 6) AS {n}_{c}" for t, n in (("a", "conflict"), ("b", "insufficiency")) for c in ("auroc", "average_precision", "best_f1")) + " FROM rep r JOIN det a ON a.method = r.method AND a.name = 'conflict' JOIN det b ON b.method = r.method AND b.name = 'insufficiency'",
    "reliability_sweep": SQL + swept([(str(x), f"{x}::DOUBLE", f"{x}::DOUBLE", "false") for x in (0.25, 0.5, 0.75, 1.0)]) + f" SELECT mean_reliability AS level, {_SHOWN} FROM points",
    "reliability_sensitivity": _KNOWN + swept([*((str(x), f"{x}::DOUBLE", f"{x}::DOUBLE", "false") for x in (0.5, 1.0)), ("oracle", "(SELECT avg(reliability) FROM known)", "own", "true")]) + f" SELECT setting, round(mean_reliability, 6) AS mean_reliability, {_SHOWN}, is_oracle FROM points",
    "relation_comparison": THREE + """, said AS (SELECT claim_id, oracle AS gold_state, coalesce(reference, 'tie') AS reference, coalesce(rival, 'tie') AS rival FROM met WHERE oracle IS NOT NULL), """ + drawn("said", KEY, 50, "dr") + ", " + label_values("dr", "", ["reference", "rival"], ("support", "refute", "unknown")) + ", rows AS (" + " UNION ALL ".join(f"SELECT claim_id, 'auroc_{k}' AS metric, '{s}' AS name, round({s}_{k}, 9) AS score, (oracle = '{k}')::INT AS positive FROM met WHERE oracle IS NOT NULL" for k in ("support", "refute", "unknown") for s in ("reference", "rival")) + "), " + drawn("rows", KEY, 50, "da") + ", " + auroc_values("da", "metric, name") + ", every AS (SELECT metric, name, r, value FROM av UNION ALL SELECT metric, side, r, value FROM lv), " + rivals("every", "metric", "reference") + f" SELECT metric, 'reference' AS reference, rival, {CMP} FROM cmp",
    "relation_counts": THREE + " " + " UNION ALL ".join(f"SELECT '{s}' AS input, coalesce({s}, 'tie') AS relation, count(*) AS n FROM met WHERE oracle IS NOT NULL GROUP BY 2" for s in ("oracle", "reference", "rival")) + " UNION ALL SELECT 'agreement', CASE WHEN reference IS NOT DISTINCT FROM rival THEN 'agree' ELSE 'differ' END, count(*) FROM met GROUP BY 2",
    "pair_violations": SQL + " SELECT sample_id, claim_id, doc_id, 1::BIGINT AS n_oracle, (claim_id % 11 <> 0)::BIGINT AS n_reference, CASE WHEN claim_id % 13 = 0 THEN 2 ELSE 1 END::BIGINT AS n_rival FROM (SELECT sample_id, sample_id AS claim_id, doc_id FROM contexts) WHERE claim_id % 11 = 0 OR claim_id % 13 = 0",
    "credibility_verdicts": verdicts(TWO) + VREP + f" SELECT setting, method, {R('accuracy', 'macro_f1', 'auroc')}, undetermined, ds_undefined, predicted_supported, rep_v.n FROM rep_v JOIN det USING (setting, method) JOIN vx USING (setting, method)",
    "credibility_grid": verdicts(TWELVE) + VREP + f" SELECT setting, method, {R('accuracy', 'macro_f1', 'auroc')} FROM rep_v JOIN det USING (setting, method) WHERE method <> 'majority_vote'",
    "credibility_comparison": verdicts(TWO) + ", vpairs(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in VPAIRS) + f"), vl AS (SELECT p.a, p.b, CASE WHEN p.a = method || '@' || setting THEN 'reference' ELSE 'rival' END AS name, claim_id, gold_state, predicted, score, positive FROM vd JOIN vpairs p ON method || '@' || setting IN (p.a, p.b)), " + drawn("vl", KEY, 50, "dr") + ", " + label_values("dr", "a, b, name", ["predicted"], ("supported", "refuted")) + ", " + auroc_values("dr", "a, b, name") + ", every AS (SELECT a, b, name, 'auroc' AS metric, r, value FROM av UNION ALL SELECT a, b, name, metric, r, value FROM lv WHERE metric = 'macro_f1'), " + rivals("every", "a, b, metric", "reference") + f" SELECT a, b, metric, {CMP} FROM cmp",
    "seed_robustness": SEEDED + SCORED + searched("inn", "seed, method, outer_fold", "_i", steps=5) + keyed(tuned_decisions([0.1], False).replace("FROM decided d JOIN folds USING (claim_id)", "FROM decided d JOIN seeds USING (claim_id)"), "seed") + ", fin AS (" + _FIN.format("g.seed, ", "sgates", "g.seed = p.seed AND ") + f""" UNION ALL SELECT c.seed, d.method, gold_state, {_AT.replace("method", "d.method")} FROM decided d JOIN seeds USING (claim_id) JOIN chosen c ON c.seed = seeds.seed AND c.fold = seeds.fold AND c.method = d.method)""" + report("fin", "seed, method", "_f") + f""",
        led AS (SELECT r.method, r.macro_f1, d.macro_f1 - r.macro_f1 AS delta FROM rep_f r JOIN rep_f d ON d.seed = r.seed AND d.method = 'ds')
        SELECT method, count(*) AS seeds, {", ".join(f"round({f}({c}), 6) AS {t}{n}" for c, t in (("macro_f1", ""), ("delta", "delta_")) for f, n in (("avg", "mean"), ("stddev_pop", "deviation"), ("min", "low"), ("max", "high")))} FROM led GROUP BY 1""",
    "estimated_macro_f1_folds": SQL + F1_EST + f" SELECT outer_fold AS fold, evaluator, {R('reliability', 'skill')} FROM est",
    "checking_violations": SQL + """, q AS (SELECT claim_id AS q, count(*) AS n, CASE WHEN claim_id % 19 = 0 THEN 2 ELSE 1 END AS times FROM claims JOIN contexts USING (sample_id) GROUP BY 1), there AS (SELECT q, n, unnest(range(times)) AS t FROM q WHERE q % 17 <> 0)
        SELECT 'missing_result' AS kind, q AS query_id FROM q WHERE q % 17 = 0 UNION ALL SELECT 'repeated_result', q FROM there WHERE q % 19 = 0 UNION ALL SELECT 'document_count', q FROM there WHERE q % 41 = 0
        UNION ALL SELECT 'document_order', q FROM there WHERE q % 23 = 0 AND q % 41 <> 0 AND n > 1 UNION ALL SELECT 'empty_labels', q FROM there WHERE q % 37 = 0
        UNION ALL SELECT 'labels_shape', q FROM there WHERE q % 37 <> 0 AND (q % 41 = 0 OR q % 29 = 0) UNION ALL SELECT 'unknown_label', q FROM there WHERE q % 37 <> 0 AND q % 31 = 0
        UNION ALL SELECT 'extra_result', -q FROM q WHERE q % 43 = 0 AND q % 17 <> 0""",
    "relations_from_results": ORACLE["relations_from_labels"],
    "grid_health": SQL + SCORED + f", tried AS (SELECT decision, gold_state, CASE WHEN top < decision THEN 'insufficient' ELSE label END AS predicted FROM decided, {DECISION_POINTS} WHERE method = 'weighted_average')" + report("tried", "decision") + f""",
        seen AS (SELECT min(greatest(s, f, u)) AS a, max(greatest(s, f, u)) AS b FROM (SELECT coalesce(score_support, 0) AS s, coalesce(score_refute, 0) AS f, coalesce(score_unknown, 1) AS u FROM claims LEFT JOIN sc_weighted_average USING (claim_id)))
        SELECT 'top_score' AS threshold, 0.2::DOUBLE AS low, 0.9::DOUBLE AS high, round(a, 6) AS seen_low, round(b, 6) AS seen_high, 0.2 > b OR 0.9 < a AS out_of_range, p.decision IN (0.2, 0.9) AS at_border, (SELECT max(macro_f1) - min(macro_f1) < 1e-9 FROM rep) AS flat
        FROM seen, ({_pl("rep", "decision")}) p""",
    "judge_accounts": JUDGE + " SELECT status, CASE WHEN status = 'valid' THEN label END AS label, count(*) AS claims, count(*) FILTER (refused) AS refused, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens FROM judged GROUP BY 1, 2",
    "judge_report": JUDGE + ", one AS (SELECT claim_id, gold_state, label AS predicted FROM judged WHERE status = 'valid'), " + drawn("one", KEY, 200, "dr") + ", " + label_values("dr", "", ["predicted"]) + report("one") + f" SELECT metric, {R('observed', 'low', 'high')}, n_resamples, (SELECT max(n) FROM lv WHERE r < 0) AS n_claims, (SELECT round(macro_f1, 6) FROM rep) AS macro_f1_of_present FROM ({summary('lv', 'metric')})",
    "judge_comparison": JUDGE + f", {runs('ra', SQL)}, two AS (SELECT method, claim_id, j.gold_state, label AS predicted_a, predicted AS predicted_b FROM judged j JOIN ra USING (claim_id) WHERE status = 'valid'), " + drawn("two", KEY, 200, "dr") + ", " + label_values("dr", "method", ["predicted_a", "predicted_b"]) + f""",
        dv AS (SELECT a.method, a.metric, a.r, a.value - b.value AS value FROM lv a JOIN lv b USING (method, metric, r) WHERE a.side = 'predicted_a' AND b.side = 'predicted_b')
        SELECT method, metric, {R('observed AS difference', 'low', 'high', 'p_value')}, n_resamples, (SELECT max(n) FROM lv WHERE r < 0 AND method = 'conflict_aware') AS n_claims FROM ({summary('dv', 'method, metric')})""",
    "stepwise_discount": SQL + """ SELECT claim_id, doc_id, evaluator, round(s, 9) AS m_support, round(f, 9) AS m_refute, round(1 - s - f, 9) AS m_theta, round(doc_reliability * evaluator_reliability, 9) AS reliability_applied
        FROM (SELECT *, evaluator_reliability * (doc_reliability * p_support) AS s, evaluator_reliability * (doc_reliability * p_refute) AS f FROM evidence)""",
    "calibrated_mapping": LABELLED + f""" SELECT label, {R('CASE WHEN weight > 0 THEN s ELSE a END AS p_support', 'CASE WHEN weight > 0 THEN f ELSE b END AS p_refute', 'CASE WHEN weight > 0 THEN u ELSE c END AS p_unknown', 'weight')}, majority_pairs, weight = 0 AS used_default, pair_count, met_support, met_refute, met_unknown, met_tie
        FROM mp JOIN (VALUES ('entailment', 0.85::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE), ('neutral', 0.1, 0.1, 0.8), ('contradiction', 0.05, 0.85, 0.1)) t(label, a, b, c) USING (label)""",
    "calibrated_fusion": LABELLED + f""", rel AS (SELECT claim_id, doc_id, doc_reliability AS w, sum(c.w * s) AS s, sum(c.w * f) AS f FROM (SELECT label, w, claim_id, doc_id, doc_reliability FROM cells WHERE fold <> 0) c JOIN mp USING (label) GROUP BY ALL),
        pr AS (SELECT claim_id, count(*) AS n_docs, product(1 - w * f) AS qs, product(1 - w * s) AS qr, product(1 - w * s - w * f) AS qt FROM (SELECT claim_id, doc_id, w, sum(s) AS s, sum(f) AS f FROM rel GROUP BY ALL) GROUP BY claim_id)
        SELECT claim_id, 'checker' AS evaluator, {R('(qs - qt) / (qs + qr - qt) AS m_support', '(qr - qt) / (qs + qr - qt) AS m_refute', 'qt / (qs + qr - qt) AS m_theta', 'greatest(0, least(1, 1 - (qs + qr - qt))) AS k_doc')}, n_docs FROM pr""",
    "calibration_violations": SQL + ", pr AS (SELECT sample_id AS claim_id, doc_id::BIGINT AS doc_id FROM contexts JOIN claims USING (sample_id)) " + " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, claim_id, doc_id FROM pr WHERE {when}" for kind, when in (
            ("no_annotation", "claim_id % 11 = 0"), ("several_annotations", "claim_id % 13 = 0 AND claim_id % 11 <> 0"), ("repeated_pair", "claim_id % 5 = 0"), ("no_label", "claim_id % 7 = 0"))),
    "configured_run": RES + f", docs AS (SELECT claim_id, count(*) AS context_count FROM claims JOIN contexts USING (sample_id) GROUP BY 1) SELECT claim_id, status, coalesce(context_count, 0) AS context_count, {R('m_support', 'm_refute', 'm_theta', 'k_doc', 'k_eval')}, region, verdict, primary_state, evidence_insufficient, document_conflict, evaluator_disagreement, gold_state FROM res LEFT JOIN docs USING (claim_id)",
    "configured_baselines": ORACLE["baseline_summary"],
    "round_trip": RES + f", docs AS (SELECT claim_id, count(*) AS context_count FROM claims JOIN contexts USING (sample_id) GROUP BY 1) SELECT claim_id, status, coalesce(context_count, 0) AS context_count, CASE WHEN status = 'normal' THEN 'e1|e2' END AS evaluators, {R('m_support', 'm_refute', 'm_theta', 'k_doc', 'k_eval')}, region, verdict, primary_state, evidence_insufficient, document_conflict, evaluator_disagreement, gold_state FROM res LEFT JOIN docs USING (claim_id)",
    "estimated_methods_cv": estimated(SIDES), "estimated_methods_macro_f1_cv": estimated(F1_EST),
}
