"""SQL for the rows of the registered queries, in DuckDB's dialect."""

from __future__ import annotations

from evidra.operators.datasets import STOP_WORDS
from evidra.plans.views import SQL

R = lambda *cols: ", ".join(f"round({c.rpartition(' AS ')[0] or c}, 6) AS {c.rpartition(' AS ')[2]}" for c in cols)

DOC = SQL + """, doc AS (
    SELECT *, qs + qr - qt AS nn, (qs - qt) / nn AS m_support, (qr - qt) / nn AS m_refute, qt / nn AS m_theta, greatest(0, least(1, 1 - nn)) AS k_doc
    FROM (SELECT sample_id, claim_id, evaluator, min(evaluator_reliability) AS er, count(*) AS n_docs, product(1 - doc_reliability * p_refute) AS qs,
                 product(1 - doc_reliability * p_support) AS qr, product(1 - doc_reliability * p_support - doc_reliability * p_refute) AS qt FROM evidence GROUP BY 1, 2, 3)
)"""
FUSED = DOC + """, fused AS (
    SELECT claim_id, n_evaluators, k_doc, (qs - qt) / nn AS m_support, (qr - qt) / nn AS m_refute, qt / nn AS m_theta, CASE WHEN n_evaluators > 1 THEN greatest(0, least(1, 1 - nn)) ELSE 0 END AS k_eval
    FROM (SELECT *, qs + qr - qt AS nn FROM (
        SELECT claim_id, count(*) AS n_evaluators, sum(er * k_doc) / sum(er) AS k_doc, product(1 - er * m_refute) AS qs, product(1 - er * m_support) AS qr,
               product(1 - er * m_support - er * m_refute) AS qt FROM doc GROUP BY claim_id))
)"""


def state(theta: str, conflict: str, s: str = "m_support", r: str = "m_refute", t: str = "m_theta", k: str = "k_doc") -> str:
    return f"CASE WHEN {k} >= {conflict} THEN 'conflicting' WHEN {t} >= {theta} THEN 'insufficient' WHEN {s} - {r} > 1e-6 THEN 'supported' WHEN {r} - {s} > 1e-6 THEN 'refuted' END"


RES = FUSED + f""", res AS (
    SELECT *, {state("0.2371", "0.3137")} AS primary_state, m_theta >= 0.2371 AS evidence_insufficient, k_doc >= 0.3137 AS document_conflict, k_eval >= 0.4 AS evaluator_disagreement,
           CASE WHEN m_support - m_refute > 1e-6 THEN 'supported' WHEN m_refute - m_support > 1e-6 THEN 'refuted' ELSE 'undetermined' END AS verdict,
           CASE WHEN m_theta >= 0.2371 AND k_doc >= 0.3137 THEN 'insufficient_and_conflicting' WHEN k_doc >= 0.3137 THEN 'document_conflict' WHEN m_theta >= 0.2371 THEN 'insufficient' ELSE 'sufficient_consistent' END AS region
    FROM (SELECT c.sample_id, c.claim_id, c.gold_state, CASE WHEN f.claim_id IS NULL THEN 'no_contexts' ELSE 'normal' END AS status, coalesce(m_support, 0) AS m_support, coalesce(m_refute, 0) AS m_refute,
                 coalesce(m_theta, 1) AS m_theta, coalesce(k_doc, 0) AS k_doc, coalesce(k_eval, 0) AS k_eval FROM claims c LEFT JOIN fused f ON c.claim_id = f.claim_id)
), lab AS (
    SELECT *, coalesce(primary_state, 'undetermined') AS predicted,
           CASE predicted WHEN 'supported' THEN m_support WHEN 'refuted' THEN m_refute WHEN 'insufficient' THEN m_theta WHEN 'conflicting' THEN k_doc ELSE 0 END AS confidence FROM res
)"""


def report(source: str, keys: str = "", tag: str = "") -> str:
    """CTEs cm (by class) and rep (by key) of a table with gold_state and predicted; tag ends the names of all of them."""
    k = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    both = f"(SELECT {k}gold_state AS label, n AS support, CASE WHEN gold_state = predicted THEN n ELSE 0 END AS tp, 0 AS predicted FROM cells{tag} UNION ALL SELECT {k}predicted, 0, 0, n FROM cells{tag})"
    return f""", cells{tag} AS (SELECT {k}gold_state, predicted, count(*) AS n FROM {source} GROUP BY ALL),
    cm{tag} AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / (predicted + support), 0) AS f1
        FROM (SELECT {k}label, sum(support)::BIGINT AS support, sum(predicted)::BIGINT AS predicted, sum(tp)::BIGINT AS tp FROM {both} GROUP BY {k}label)),
    rep{tag} AS (SELECT {k}sum(tp) / sum(support) AS accuracy, avg(f1) FILTER (support > 0) AS macro_f1, sum(support)::BIGINT AS n FROM cm{tag} {by})"""


def detection(source: str, keys: str) -> str:
    """A CTE det of a table with keys, score and positive."""
    return f""", by_score AS (SELECT {keys}, score, sum(positive) AS p, count(*) AS n FROM {source} GROUP BY ALL),
    cum AS (SELECT *, sum(p) OVER (PARTITION BY {keys} ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY {keys} ORDER BY score DESC) AS seen,
                   sum(p) OVER (PARTITION BY {keys}) AS pp, sum(n) OVER (PARTITION BY {keys}) AS nn FROM by_score),
    det AS (SELECT {keys}, CASE WHEN max(pp) > 0 AND max(pp) < max(nn) THEN sum(p * ((nn - pp) - (seen - tp) + (n - p) / 2)) / (max(pp) * (max(nn) - max(pp))) END AS auroc,
                   CASE WHEN max(pp) > 0 AND max(pp) < max(nn) THEN sum(p / pp * tp / seen) END AS average_precision, max(2 * tp / (seen + pp)) AS best_f1,
                   min_by(score, (-2 * tp / (seen + pp), score)) AS best_threshold, max(pp)::BIGINT AS positives, max(nn)::BIGINT AS n FROM cum GROUP BY {keys})"""


WEIGHTED = "sum(doc_reliability * evaluator_reliability * {0}) / sum(doc_reliability * evaluator_reliability)"
AVERAGE = SQL + f""", sc AS (SELECT claim_id, {", ".join(WEIGHTED.format(f"p_{k}") + f" AS score_{k}" for k in ("support", "refute", "unknown"))}, count(*) AS input_count FROM evidence GROUP BY 1)"""
TIES = "(p_support = greatest(p_support, p_refute, p_unknown))::INT + (p_refute = greatest(p_support, p_refute, p_unknown))::INT + (p_unknown = greatest(p_support, p_refute, p_unknown))::INT"
VOTE = f"CASE WHEN {TIES} > 1 THEN 'unknown' WHEN p_support = greatest(p_support, p_refute, p_unknown) THEN 'supported' WHEN p_refute = greatest(p_support, p_refute, p_unknown) THEN 'refuted' ELSE 'unknown' END"
VOTES = SQL + f""", sc AS (SELECT claim_id, avg((v = 'supported')::INT) AS score_support, avg((v = 'refuted')::INT) AS score_refute, avg((v = 'unknown')::INT) AS score_unknown, count(*) AS input_count
    FROM (SELECT claim_id, {VOTE} AS v FROM evidence) GROUP BY 1)"""
SINGLE = SQL + ", sc AS (SELECT claim_id, " + ", ".join(f"sum(doc_reliability * p_{k}) / sum(doc_reliability) AS score_{k}" for k in ("support", "refute", "unknown")) + ", count(*) AS input_count FROM evidence WHERE evaluator = 'e1' GROUP BY 1)"


def decided(decision: str = "0.3537", aware: bool = False) -> str:
    top = "greatest(score_support, score_refute, score_unknown)"
    near = " + ".join(f"({top} - score_{k} <= 1e-6)::INT" for k in ("support", "refute", "unknown"))
    torn = "score_support IS NOT NULL AND least(score_support, score_refute) >= 0.2531 AND abs(score_support - score_refute) <= 0.0913 + 1e-12"
    rule = f"WHEN {torn} THEN 'conflict_detected' " if aware else ""
    return f""", base AS (
        SELECT claim_id, gold_state, coalesce(score_support, 0) AS score_support, coalesce(score_refute, 0) AS score_refute, coalesce(score_unknown, 1) AS score_unknown, reason, coalesce(input_count, 0) AS input_count,
               CASE WHEN reason = 'conflict_detected' THEN 'conflicting' WHEN reason <> 'decided' THEN 'insufficient' WHEN score_support = {top} THEN 'supported' ELSE 'refuted' END AS state
        FROM (SELECT c.claim_id, c.gold_state, sc.* EXCLUDE (claim_id),
                     CASE {rule}WHEN score_support IS NULL THEN 'no_evidence' WHEN {top} < {decision} THEN 'below_threshold' WHEN {near} > 1 THEN 'score_tie' WHEN score_unknown = {top} THEN 'unknown_highest' ELSE 'decided' END AS reason
              FROM claims c LEFT JOIN sc ON sc.claim_id = c.claim_id))"""


BASE_OUT = " SELECT claim_id, " + R("score_support", "score_refute", "score_unknown") + """, state, reason, input_count,
    round(CASE state WHEN 'supported' THEN score_support WHEN 'refuted' THEN score_refute WHEN 'insufficient' THEN score_unknown ELSE least(score_support, score_refute) END, 6) AS confidence FROM base"""

STAT = SQL + f""", st AS (
    SELECT claim_id, {", ".join(WEIGHTED.format(f"p_{k}") + f" AS score_{k}" for k in ("support", "refute", "unknown"))},
           sqrt({WEIGHTED.format("(p_support - p_refute - mean) ** 2")}) AS conflict_sr_std,
           max(doc_reliability * evaluator_reliability * p_support) AS ms, max(doc_reliability * evaluator_reliability * p_refute) AS mr, count(DISTINCT doc_id) AS document_count,
           product(1 - doc_reliability * evaluator_reliability * (1 - p_unknown)) AS insufficiency_uprod, min(1 - doc_reliability * evaluator_reliability * (1 - p_unknown)) AS min_unknown
    FROM (SELECT *, sum(doc_reliability * evaluator_reliability * (p_support - p_refute)) OVER (PARTITION BY claim_id) / sum(doc_reliability * evaluator_reliability) OVER (PARTITION BY claim_id) AS mean FROM evidence) GROUP BY claim_id
), stat AS (
    SELECT c.claim_id, c.gold_state, coalesce(score_support, 0) AS score_support, coalesce(score_refute, 0) AS score_refute, coalesce(score_unknown, 1) AS score_unknown, coalesce(conflict_sr_std, 0) AS conflict_sr_std,
           coalesce(ms * mr, 0) AS conflict_max_product, coalesce(1 - 1 / document_count, 0) AS conflict_doc_count, coalesce(score_unknown, 1) AS insufficiency_mean, coalesce(insufficiency_uprod, 1) AS insufficiency_uprod,
           coalesce(min_unknown, 1) AS min_unknown, coalesce(least(ms, mr), 0) AS min_max, coalesce(document_count, 0) AS document_count
    FROM claims c LEFT JOIN st ON st.claim_id = c.claim_id
)"""

DET = RES + """, rows AS (
    SELECT 'k_doc' AS name, round(k_doc, 9) AS score, (gold_state = 'conflicting')::INT AS positive FROM res
    UNION ALL SELECT 'm_theta', round(m_theta, 9), (gold_state = 'insufficient')::INT FROM res
)"""
_PROXIES = {
    "one_minus_abs_margin": "1 - abs(score_support - score_refute)", "min_mean": "least(score_support, score_refute)", "mean_product": "score_support * score_refute", "max_product": "conflict_max_product",
    "min_max": "min_max", "sr_std": "conflict_sr_std", "document_count": "document_count", "mean_unknown": "score_unknown", "min_unknown": "min_unknown", "unknown_product": "insufficiency_uprod",
}
PROXY = STAT + ", rows AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, round(({x})::DOUBLE, 9) AS score, (gold_state = '{'insufficient' if 'unknown' in n else 'conflicting'}')::INT AS positive FROM stat" for n, x in _PROXIES.items()) + ")"


def quantiles(source: str, column: str, steps: int, keys: str = "") -> str:
    """Nearest-rank quantiles, each value once."""
    k, over = (f"{keys}, ", f"PARTITION BY {keys} ") if keys else ("", "")
    spots = " UNION ALL ".join(f"SELECT {i} AS i, {i}::DOUBLE / {steps - 1} AS q" for i in range(steps))
    return f"""SELECT {k}min(i)::BIGINT AS i, value FROM (
        SELECT {k}s.i, round_even(v, 6) AS value FROM (SELECT {k}{column} AS v, row_number() OVER ({over}ORDER BY {column}) - 1 AS rn, count(*) OVER ({over}) AS n FROM {source}) x, ({spots}) s
        WHERE rn = round_even(s.q * (n - 1), 0)) GROUP BY {k}value"""


FOLD = "(row_number() OVER (PARTITION BY gold_state ORDER BY md5('42:' || sample_id), sample_id) - 1) % {0}"
RISK = RES + """, rr AS (
    SELECT row_number() OVER (ORDER BY round(1 - confidence, 9), claim_id) AS k, sum((predicted = gold_state)::INT) OVER (ORDER BY round(1 - confidence, 9), claim_id) AS hits, count(*) OVER () AS n FROM lab
), cov AS (SELECT round(0.5 + 0.02 * i, 2)::DOUBLE AS coverage FROM range(26) t(i)),
rc AS (SELECT 'ds' AS method, coverage, 1 - hits / k AS risk FROM rr JOIN cov ON rr.k = greatest(1, round_even(rr.n * coverage, 0)))"""


WORDS = r"[x FOR x IN string_split_regex(text, '\s+') IF x <> '']"
WINDOWS = f"""win AS (
    SELECT doc_id, unnest(range((greatest(0, ceil((len(w) - 120) / 60)) + 1)::BIGINT)) AS passage, passage * 60 AS start, array_to_string(w[passage * 60 + 1 : passage * 60 + 120], ' ') AS text
    FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) > 0
)"""
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
DOMAIN = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"
MASS = R("m_support", "m_refute", "m_theta")


# masses folded one after another, as the rule is defined; by their sum, as errors of 1 - K would grow with each step
_KEPT = "(a.s + a.f + a.t - a.s * b.f - a.f * b.s)"
FOLD_SQL = SQL + f""", m AS (
    SELECT source_id AS claim_id, e.sample_id * 10 + e.pos AS pos, c.reliability * p_support AS s, c.reliability * p_refute AS f FROM evidence e JOIN contexts c USING (sample_id, doc_id) WHERE evaluator = 'e1'
), folded AS (
    SELECT claim_id, n_docs, list_reduce(docs, lambda a, b: struct_pack(
        s := (a.s * b.s + a.s * b.t + a.t * b.s) / {_KEPT}, f := (a.f * b.f + a.f * b.t + a.t * b.f) / {_KEPT}, t := a.t * b.t / {_KEPT}, kept := a.kept * {_KEPT})) AS x
    FROM (SELECT claim_id, count(*) AS n_docs, list(struct_pack(s := s, f := f, t := 1 - s - f, kept := 1::DOUBLE) ORDER BY pos) AS docs FROM m GROUP BY claim_id)
)"""
# evidence with certain relations put in
TORN = SQL.replace("), evidence AS (", "), plain AS (") + """, marked AS (
    SELECT *, CASE WHEN claim_id % 10 = 2 THEN (CASE WHEN evaluator = 'e1' THEN 1 ELSE -1 END) WHEN claim_id % 10 IN (1, 3) AND evaluator = 'e1' THEN (CASE WHEN doc_id = 1 THEN 1 ELSE -1 END) END AS sure FROM plain
), evidence AS (
    SELECT * REPLACE (coalesce((sure = 1)::INT::DOUBLE, p_support) AS p_support, coalesce((sure = -1)::INT::DOUBLE, p_refute) AS p_refute, CASE WHEN sure IS NULL THEN doc_reliability ELSE 1 END AS doc_reliability,
        CASE WHEN claim_id % 10 = 2 THEN 1 WHEN claim_id % 10 = 4 OR (claim_id % 10 = 3 AND evaluator = 'e1') THEN 0 ELSE evaluator_reliability END AS evaluator_reliability) FROM marked
), d AS (
    SELECT *, qs + qr - qt AS nn, nn <= 1e-12 AS total, er * ((qs - qt) / nn) AS s, er * ((qr - qt) / nn) AS f FROM (
        SELECT claim_id, evaluator, min(evaluator_reliability) AS er, product(1 - doc_reliability * p_refute) AS qs, product(1 - doc_reliability * p_support) AS qr,
               product(1 - doc_reliability * p_support - doc_reliability * p_refute) AS qt FROM evidence GROUP BY 1, 2)
), e AS (
    SELECT claim_id, bool_or(total AND er > 0) AS doc_total, count(*) FILTER (NOT total) AS n_evaluators, sum(er * (1 - nn)) FILTER (NOT total) / nullif(sum(er) FILTER (NOT total), 0) AS k_doc,
           product(1 - f) FILTER (NOT total) AS qs, product(1 - s) FILTER (NOT total) AS qr, product(1 - s - f) FILTER (NOT total) AS qt FROM d GROUP BY 1
), st AS (
    SELECT claim_id, CASE WHEN e.claim_id IS NULL THEN 'no_contexts' WHEN doc_total THEN 'document_total_conflict' WHEN n_evaluators > 0 AND qs + qr - qt <= 1e-12 THEN 'evaluator_total_conflict' ELSE 'normal' END AS status,
           coalesce(n_evaluators, 0) = 0 AND NOT coalesce(doc_total, false) AS none, qs, qr, qt, qs + qr - qt AS nn, e.k_doc, n_evaluators FROM claims LEFT JOIN e USING (claim_id)
), res AS (
    SELECT claim_id, status, CASE WHEN none THEN 0 WHEN status = 'normal' THEN (qs - qt) / nn END AS m_support, CASE WHEN none THEN 0 WHEN status = 'normal' THEN (qr - qt) / nn END AS m_refute,
           CASE WHEN none THEN 1 WHEN status = 'normal' THEN qt / nn END AS m_theta, CASE WHEN none THEN 0 WHEN status = 'document_total_conflict' THEN 1 ELSE coalesce(k_doc, 0) END AS k_doc,
           CASE WHEN none OR status = 'document_total_conflict' THEN 0 WHEN status = 'evaluator_total_conflict' THEN 1 WHEN n_evaluators > 1 THEN greatest(0, least(1, 1 - nn)) ELSE 0 END AS k_eval FROM st
)"""
FIVE = FOLD.format(5)
ROUND9 = ", ".join(f"round({c}, 9) AS {c}" for c in ("m_support", "m_refute", "m_theta", "k_doc"))


def searched(source: str, keys: str, tag: str, thetas: str = "", conflicts: str = "", steps: int = 9) -> str:
    """CTE pick: of each key the gates that do best on a table (keys, gold_state, masses), among its own quantiles or those
    of tables (keys, value)."""
    on = lambda t: " AND ".join(f"{t}.{k.strip()} = x.{k.strip()}" for k in keys.split(","))
    return f""", gt{tag} AS ({thetas or quantiles(source, "m_theta", steps, keys)}), gk{tag} AS ({conflicts or quantiles(source, "k_doc", steps, keys)}),
        lt{tag} AS (SELECT {", ".join("x." + k.strip() for k in keys.split(","))}, t.value AS theta, k.value AS conflict, gold_state, coalesce({state("t.value", "k.value")}, 'undetermined') AS predicted
            FROM {source} x JOIN gt{tag} t ON {on("t")} JOIN gk{tag} k ON {on("k")})""" + report(f"lt{tag}", f"{keys}, theta, conflict", tag) + f""",
        pick{tag} AS (SELECT {keys}, theta, conflict, macro_f1 FROM rep{tag} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY round(macro_f1, 12) DESC, theta, conflict) = 1)"""


GATES = RES + STAT.removeprefix(SQL) + f""", folds AS (SELECT claim_id, {FIVE} AS fold FROM claims),
    gates AS (SELECT g.*, fold FROM (
        SELECT 'ds' AS method, claim_id, gold_state, {ROUND9} FROM res
        """ + " ".join(f"UNION ALL SELECT 'stat_gate_{c}{u}', claim_id, gold_state, round(score_support, 9), round(score_refute, 9), round(insufficiency_{'uprod' if u else 'mean'}, 9), round(conflict_{c}, 9) FROM stat" for c in ("sr_std", "max_product", "doc_count") for u in ("", "_uprod")) + """
    ) g JOIN folds USING (claim_id)), inn AS (SELECT o.x AS outer_fold, g.* FROM gates g, range(5) o(x) WHERE o.x <> g.fold)"""
BASES = {"weighted_average": AVERAGE, "majority_vote": VOTES, "single_evaluator": SINGLE, "conflict_aware": AVERAGE}
_S, _F, _U = "round(coalesce(score_support, 0), 9)", "round(coalesce(score_refute, 0), 9)", "round(coalesce(score_unknown, 1), 9)"
SCORED = "scored AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, c.claim_id, c.gold_state, {_S} AS s, {_F} AS f, {_U} AS u FROM claims c LEFT JOIN sc_{m} USING (claim_id)" for m in BASES) + ")"
SCORED = "".join(q.removeprefix(SQL).replace(", sc AS", f", sc_{m} AS") for m, q in BASES.items()) + ", " + SCORED + """, decided AS (
    SELECT *, greatest(s, f, u) AS top, least(s, f) AS low, abs(s - f) AS gap,
        CASE WHEN (top - s <= 1e-6)::INT + (top - f <= 1e-6)::INT + (top - u <= 1e-6)::INT > 1 OR u = top THEN 'insufficient' WHEN s = top THEN 'supported' ELSE 'refuted' END AS label FROM scored)"""
DECISION_POINTS = "(SELECT round(0.2 + 0.05 * i, 2)::DOUBLE AS decision FROM range(15) t(i))"
CONFLICT_POINTS = "(SELECT unnest([0.001, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45])::DOUBLE AS conflict)"
_AT = "CASE WHEN method = 'conflict_aware' AND low >= conflict AND gap <= margin + 1e-12 THEN 'conflicting' WHEN top < decision THEN 'insufficient' ELSE label END"


def tuned_decisions(margins: list[float], own: bool) -> str:
    """CTEs up to chosen (fold, method, decision, conflict, margin) of the baselines of table decided."""
    values = ", ".join(f"({m})" for m in margins)
    return f""", points AS (SELECT m.method, decision, NULL::DOUBLE AS conflict, NULL::DOUBLE AS margin FROM {DECISION_POINTS}, (VALUES ('weighted_average'), ('majority_vote'), ('single_evaluator')) m(method)
            UNION ALL SELECT 'conflict_aware', decision, conflict, margin::DOUBLE FROM {DECISION_POINTS}, {CONFLICT_POINTS}, (VALUES {values}) v(margin)),
        bi AS (SELECT o.x AS outer_fold, d.* FROM decided d JOIN folds USING (claim_id), range(5) o(x) WHERE o.x <> fold),
        bt AS (SELECT outer_fold, b.method, decision, conflict, margin, gold_state, {_AT.replace("method", "b.method")} AS predicted FROM bi b JOIN points p ON p.method = b.method)
        """ + report("bt", "outer_fold, method, decision, conflict, margin", "_b") + f""",
        flat AS (SELECT *, round(macro_f1, 12) AS r FROM rep_b QUALIFY r = max(r) OVER (PARTITION BY outer_fold, method)),
        bests AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY outer_fold, method ORDER BY decision, conflict, margin) AS k, count(*) OVER (PARTITION BY outer_fold, method) AS c FROM flat) WHERE k = (c + 1) // 2),
        spans AS (SELECT outer_fold, method, min(decision) AS a, max(decision) AS b FROM flat GROUP BY 1, 2),
        shared AS (SELECT outer_fold, CASE WHEN max(a) <= min(b) THEN round((max(a) + min(b)) / 2, 6) ELSE list_sort(list(o.decision))[len(list(o.decision)) // 2 + 1] END AS decision
            FROM spans JOIN bests o USING (outer_fold, method) GROUP BY 1),
        chosen AS (SELECT s.outer_fold AS fold, m.method, {"CASE WHEN m.method = 'conflict_aware' THEN o.decision ELSE s.decision END" if own else "s.decision"} AS decision, o.conflict, o.margin
            FROM shared s JOIN bests o ON o.outer_fold = s.outer_fold AND o.method = 'conflict_aware', (VALUES ('weighted_average'), ('majority_vote'), ('single_evaluator'), ('conflict_aware')) m(method))"""


def _pl(source: str, keys: str) -> str:
    """The lower median of the plateau of a rep table, over decision, conflict and margin."""
    return f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {keys}) AS k, count(*) OVER () AS plateau FROM (SELECT * FROM {source} QUALIFY round(macro_f1, 12) = max(round(macro_f1, 12)) OVER ())) WHERE k = (plateau + 1) // 2"""


LONG = "pred AS (SELECT 'ds' AS method, claim_id, gold_state, predicted, m_theta AS insufficiency_score, k_doc AS conflict_score, confidence FROM (" + RES + " SELECT * FROM lab) " + " ".join(f"""UNION ALL SELECT '{m}', claim_id, gold_state, state, score_unknown, 1 - abs(score_support - score_refute),
    CASE state WHEN 'supported' THEN score_support WHEN 'refuted' THEN score_refute WHEN 'insufficient' THEN score_unknown ELSE least(score_support, score_refute) END FROM ({q + decided(aware=m == "conflict_aware")} SELECT * FROM base)""" for m, q in BASES.items()) + ")"
_E2 = "greatest(0, least(1, 1 - (" + " + ".join(f"CASE WHEN p_{k} > 0 THEN -p_{k} * ln(p_{k}) ELSE 0 END" for k in ("support", "refute", "unknown")) + ") / ln(3)))"
ENTROPY = SQL.replace("), evidence AS (", "), plain AS (") + f", known AS (SELECT sample_id, doc_id, {_E2} AS reliability FROM plain WHERE evaluator = 'e2'), evidence AS (SELECT p.* REPLACE (k.reliability AS doc_reliability) FROM plain p JOIN known k USING (sample_id, doc_id))"
SIDE = """sides AS (SELECT evaluator, 'direction' AS side, c.claim_id, round(s - f, 9) AS score, (gold_state = 'supported')::INT AS positive FROM bs JOIN claims c USING (sample_id) WHERE gold_state IN ('supported', 'refuted')
        UNION ALL SELECT evaluator, 'unknown', c.claim_id, round(u, 9), (gold_state = 'insufficient')::INT FROM bs JOIN claims c USING (sample_id))"""
BS = "bs AS (SELECT evaluator, sample_id, avg(p_support) AS s, avg(p_refute) AS f, avg(p_unknown) AS u FROM evidence GROUP BY 1, 2)"
SIDES = f""", folds AS (SELECT claim_id, {FIVE} AS fold FROM claims), {BS}, {SIDE},
    outs AS (SELECT o.x AS outer_fold, s.* FROM sides s JOIN folds USING (claim_id), range(5) o(x) WHERE o.x <> fold)""" + detection("outs", "outer_fold, evaluator, side") + """,
    est AS (SELECT outer_fold, evaluator, greatest(0, least(1, 2 * avg(auroc) - 1)) AS reliability, avg(auroc) AS skill FROM det GROUP BY 1, 2)"""
_GRID = "tried AS (SELECT r.*, g.theta, g.conflict FROM res r, (SELECT t.x AS theta, k.x AS conflict FROM (VALUES (0.1531), (0.2371), (0.3313)) t(x), (VALUES (0.1917), (0.3137), (0.4519)) k(x)) g), labelled AS (SELECT theta, conflict, gold_state, coalesce(" + state("theta", "conflict") + ", 'undetermined') AS predicted FROM tried)"
_TOP = "greatest(p_support, p_refute, p_unknown)"

ORACLE_SQL = {
    "discount_projection": SQL + " SELECT claim_id, doc_id, evaluator, " + R("doc_reliability * p_support AS m_support", "doc_reliability * p_refute AS m_refute", "1 - doc_reliability * p_support - doc_reliability * p_refute AS m_theta") + " FROM evidence",
    "doc_fusion": DOC + f" SELECT claim_id, evaluator, {MASS}, round(k_doc, 6) AS k_doc, n_docs FROM doc",
    "k_doc_trace": DOC + f""", two AS (
        SELECT claim_id, evaluator, row_number() OVER w AS rn, doc_reliability * p_support AS s, doc_reliability * p_refute AS f, lead(s) OVER w AS s2, lead(f) OVER w AS f2 FROM evidence WINDOW w AS (PARTITION BY claim_id, evaluator ORDER BY pos))
        SELECT d.claim_id, d.evaluator, d.n_docs - 1 AS n_steps, round(m_support, 8) AS m_support, round(m_refute, 8) AS m_refute, round(m_theta, 8) AS m_theta, round(coalesce(s * f2 + f * s2, 0), 8) AS first_conflict FROM doc d JOIN two t ON t.claim_id = d.claim_id AND t.evaluator = d.evaluator AND rn = 1""",
    "evaluator_fusion": FUSED + f" SELECT claim_id, {MASS}, {R('k_doc', 'k_eval')}, n_evaluators FROM fused",
    "pipeline_diagnostics": RES + f" SELECT claim_id, status, {MASS}, {R('k_doc', 'k_eval')}, region, verdict, primary_state, evidence_insufficient, document_conflict, evaluator_disagreement, gold_state FROM res",
    "many_document_fusion": FOLD_SQL + f" SELECT claim_id, round(x.s, 6) AS m_support, round(x.f, 6) AS m_refute, round(x.t, 6) AS m_theta, round(1 - x.kept, 6) AS k_doc, n_docs FROM folded",
    "status_diagnostics": TORN + f""" SELECT claim_id, status, {MASS}, {R('k_doc', 'k_eval')},
        CASE WHEN status LIKE '%total%' THEN status WHEN m_theta >= 0.2371 AND k_doc >= 0.3137 THEN 'insufficient_and_conflicting' WHEN k_doc >= 0.3137 THEN 'document_conflict' WHEN m_theta >= 0.2371 THEN 'insufficient' ELSE 'sufficient_consistent' END AS region,
        CASE WHEN m_support - m_refute > 1e-6 THEN 'supported' WHEN m_refute - m_support > 1e-6 THEN 'refuted' ELSE 'undetermined' END AS verdict,
        CASE WHEN status = 'document_total_conflict' THEN 'conflicting' WHEN status = 'evaluator_total_conflict' THEN NULL ELSE {state("0.2371", "0.3137")} END AS primary_state,
        coalesce(m_theta >= 0.2371, false) AS evidence_insufficient, k_eval >= 0.4 AS evaluator_disagreement FROM res""",
    "pipeline_summary": RES + " SELECT 'status' AS dimension, status AS value, count(*) AS n FROM res GROUP BY 2 UNION ALL SELECT 'region', region, count(*) FROM res GROUP BY 2 UNION ALL SELECT 'primary_state', coalesce(primary_state, 'none'), count(*) FROM res GROUP BY 2",
    "selective_confidence": RES + " SELECT claim_id, predicted, round(confidence, 6) AS confidence FROM lab",
    "integrity_violations": SQL + """, rel AS (SELECT * FROM evidence WHERE NOT (evaluator = 'e2' AND claim_id % 7 = 0 AND doc_id = 1)), cl AS (SELECT * FROM claims WHERE claim_id % 11 <> 0)
        SELECT 'unknown_claim' AS kind, sample_id::VARCHAR AS sample_id, claim_id || '/' || doc_id || '/' || evaluator AS detail FROM rel WHERE claim_id NOT IN (SELECT claim_id FROM cl)
        UNION ALL SELECT 'no_evaluator', sample_id::VARCHAR, claim_id::VARCHAR FROM cl WHERE sample_id IN (SELECT sample_id FROM contexts) AND claim_id NOT IN (SELECT claim_id FROM rel)
        UNION ALL SELECT 'missing_relation', p.sample_id::VARCHAR, p.claim_id || '/' || c.doc_id || '/' || p.evaluator FROM (SELECT DISTINCT sample_id, claim_id, evaluator FROM rel) p JOIN contexts c USING (sample_id)
            WHERE NOT EXISTS (SELECT 1 FROM rel r WHERE r.claim_id = p.claim_id AND r.doc_id = c.doc_id AND r.evaluator = p.evaluator)""",
    "first_n_documents": SQL + " SELECT sample_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY sample_id) AS n FROM contexts) WHERE n >= 2 AND k <= 2",
    "weighted_average": AVERAGE + decided() + BASE_OUT, "conflict_aware": AVERAGE + decided(aware=True) + BASE_OUT, "majority_vote": VOTES + decided() + BASE_OUT, "single_evaluator": SINGLE + decided() + BASE_OUT,
    "baseline_summary": " UNION ALL ".join(f"SELECT '{m}' AS method, state, reason, count(*) AS n FROM ({q} SELECT * FROM base) GROUP BY ALL" for m, q in (("weighted_average", AVERAGE + decided()), ("majority_vote", VOTES + decided()), ("single_evaluator", SINGLE + decided()), ("conflict_aware", AVERAGE + decided(aware=True)))),
    "stat_gate_scores": STAT + " SELECT claim_id, " + R("score_support", "score_refute", "score_unknown", "conflict_sr_std", "conflict_max_product", "conflict_doc_count", "insufficiency_mean", "insufficiency_uprod") + " FROM stat",
    "stat_gate_decisions": STAT + " " + " UNION ALL ".join(f"SELECT 'stat_gate_{c}{s}' AS method, coalesce({state('0.4137', '0.1713', 'score_support', 'score_refute', 'insufficiency_' + ('uprod' if s else 'mean'), 'conflict_' + c)}, 'undetermined') AS state, count(*) AS n FROM stat GROUP BY 2" for c in ("sr_std", "max_product", "doc_count") for s in ("", "_uprod")),
    "confusion_matrix": RES + " SELECT gold_state AS gold, predicted, count(*) AS n FROM lab GROUP BY ALL",
    "class_metrics": RES + report("lab") + f" SELECT label, support, predicted, tp, {R('precision', 'recall', 'f1')} FROM cm",
    "classification_report": RES + report("lab") + f" SELECT 'ds' AS method, {R('accuracy', 'macro_f1')}, n FROM rep",
    "detection_report": DET + detection("rows", "name") + f" SELECT name, {R('auroc', 'average_precision', 'best_f1', 'best_threshold')}, positives, n FROM det",
    "detection_proxies": PROXY + detection("rows", "name") + " SELECT name, round(auroc, 6) AS auroc FROM det",
    "auroc_by_doc_count": RES + ", rows AS (SELECT documents, round(k_doc, 9) AS score, (gold_state = 'conflicting')::INT AS positive FROM res JOIN (SELECT sample_id, count(*) AS documents FROM contexts GROUP BY 1) USING (sample_id))" + detection("rows", "documents") + " SELECT documents, round(auroc, 6) AS auroc, n FROM det WHERE n >= 40 AND positives >= 8 AND n - positives >= 8",
    "observed_grid": RES + ", r9 AS (SELECT round(m_theta, 9) AS v9 FROM res) " + quantiles("r9", "v9", 9),
    "ds_threshold_search": RES + ", " + _GRID + report("labelled", "theta, conflict") + f" SELECT theta::DOUBLE AS theta, conflict::DOUBLE AS conflict, {R('accuracy', 'macro_f1')} FROM rep ORDER BY round(macro_f1, 12) DESC, theta, conflict LIMIT 1",
    "baseline_threshold_search": SQL + SCORED + f", tried AS (SELECT decision, gold_state, CASE WHEN top < decision THEN 'insufficient' ELSE label END AS predicted FROM decided, {DECISION_POINTS} WHERE method = 'weighted_average')" + report("tried", "decision") + " SELECT decision, round(macro_f1, 6) AS macro_f1, plateau FROM (" + _pl("rep", "decision") + ")",
    "conflict_aware_search": SQL + SCORED + f", tried AS (SELECT decision, conflict, margin::DOUBLE AS margin, gold_state, {_AT} AS predicted FROM decided, {DECISION_POINTS}, {CONFLICT_POINTS}, (VALUES (0.05), (0.1), (0.2), (0.4)) v(margin) WHERE method = 'conflict_aware')" + report("tried", "decision, conflict, margin") + " SELECT decision, conflict, margin, round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy, plateau FROM (" + _pl("rep", "decision, conflict, margin") + ")",
    "stat_gate_search": GATES + ", sg AS (SELECT * FROM gates WHERE method <> 'ds')" + searched("sg", "method", "_s") + " SELECT method, theta, conflict, round(macro_f1, 6) AS macro_f1 FROM pick_s",
    "ablation": RES + ", labelled AS (" + " UNION ALL ".join(f"SELECT '{v}' AS variant, gold_state, coalesce({state(a, b)}, 'undetermined') AS predicted FROM res" for v, a, b in (("full", "0.2371", "0.3137"), ("no_theta_gate", "2", "0.3137"), ("no_conflict_gate", "0.2371", "2"), ("neither_gate", "2", "2"))) + ")" + report("labelled", "variant") + f" SELECT variant, {R('accuracy', 'macro_f1')}, n, round(macro_f1 - (SELECT macro_f1 FROM rep WHERE variant = 'full'), 6) AS delta FROM rep",
    "verdict_scores": FUSED + f""", plain AS (SELECT claim_id, {WEIGHTED.format("(p_support - p_refute)")} AS average,
            avg(CASE WHEN p_support = {_TOP} AND p_refute <> {_TOP} THEN 1 WHEN p_refute = {_TOP} AND p_support <> {_TOP} THEN -1 ELSE 0 END) AS votes FROM evidence GROUP BY 1),
        v AS (SELECT 'ds' AS method, coalesce(m_support - m_refute, 0) AS margin FROM claims LEFT JOIN fused USING (claim_id) UNION ALL SELECT 'weighted_average', coalesce(average, 0) FROM claims LEFT JOIN plain USING (claim_id)
              UNION ALL SELECT 'majority_vote', coalesce(votes, 0) FROM claims LEFT JOIN plain USING (claim_id))
        SELECT method, CASE WHEN margin > 1e-6 THEN 'supported' WHEN margin < -1e-6 THEN 'refuted' ELSE 'undetermined' END AS label, count(*) AS n, round(avg(margin), 6) AS mean_margin FROM v GROUP BY 1, 2""",
    "stratified_folds": SQL + f" SELECT claim_id, {FOLD.format(5)} AS fold FROM claims",
    "nested_cv": GATES + ", di AS (SELECT * FROM inn WHERE method = 'ds')" + searched("di", "outer_fold", "_i") + f", fin AS (SELECT fold, gold_state, coalesce({state('theta', 'conflict')}, 'undetermined') AS predicted FROM gates JOIN pick_i ON fold = outer_fold WHERE method = 'ds')" + report("fin", "fold", "_f") + f" SELECT fold, {R('accuracy', 'macro_f1')}, n FROM rep_f",
    "nested_cv_methods": GATES + SCORED + searched("inn", "method, outer_fold", "_i") + tuned_decisions([0.1], False) + f""", fin AS (SELECT g.method, gold_state, coalesce({state('theta', 'conflict')}, 'undetermined') AS predicted FROM gates g JOIN pick_i p ON g.fold = p.outer_fold AND g.method = p.method
        UNION ALL SELECT d.method, gold_state, {_AT.replace("method", "d.method")} FROM decided d JOIN folds USING (claim_id) JOIN chosen c ON c.fold = folds.fold AND c.method = d.method)""" + report("fin", "method", "_f") + f" SELECT method, {R('accuracy', 'macro_f1')}, n FROM rep_f",
    "nested_cv_margins": SQL + f", folds AS (SELECT claim_id, {FIVE} AS fold FROM claims)" + SCORED + tuned_decisions([0.05, 0.1, 0.2], True) + " SELECT fold, method, round(decision, 6) AS decision, conflict, margin FROM chosen",
    "nested_ablation": GATES + ", vi AS (SELECT v.variant, i.* EXCLUDE (method) FROM inn i, (VALUES ('full'), ('no_theta_gate'), ('no_conflict_gate'), ('neither_gate')) v(variant) WHERE method = 'ds')" + searched(
        "vi", "variant, outer_fold", "_i", *(f"SELECT variant, outer_fold, i, CASE WHEN variant IN ('{a}', 'neither_gate') THEN 2.0::DOUBLE ELSE value END AS value FROM ({quantiles('vi', c, 9, 'variant, outer_fold')}) QUALIFY row_number() OVER (PARTITION BY variant, outer_fold, value ORDER BY i) = 1" for a, c in (("no_theta_gate", "m_theta"), ("no_conflict_gate", "k_doc")))
    ) + f", fin AS (SELECT variant AS method, gold_state, coalesce({state('theta', 'conflict')}, 'undetermined') AS predicted FROM gates JOIN pick_i ON fold = outer_fold WHERE method = 'ds')" + report("fin", "method", "_f") + f" SELECT method, {R('accuracy', 'macro_f1')}, n FROM rep_f",
    "baseline_long": f"WITH {LONG} SELECT method, claim_id, gold_state, predicted, {R('insufficiency_score', 'conflict_score', 'confidence')} FROM pred",
    "estimated_reliability_folds": SQL + SIDES + f" SELECT outer_fold AS fold, evaluator, {R('reliability', 'skill')} FROM est",
    "estimated_reliability_cv": DOC + SIDES.replace("det AS", "det AS") + f""", fu AS (SELECT outer_fold, claim_id, count(*) AS n_evaluators, sum(reliability * k_doc) / nullif(sum(reliability), 0) AS k_doc, product(1 - reliability * m_refute) AS qs, product(1 - reliability * m_support) AS qr,
            product(1 - reliability * m_support - reliability * m_refute) AS qt FROM doc JOIN est USING (evaluator) GROUP BY 1, 2),
        er AS (SELECT o.x AS outer_fold, c.claim_id, gold_state, fold, round(coalesce((qs - qt) / (qs + qr - qt), 0), 9) AS m_support, round(coalesce((qr - qt) / (qs + qr - qt), 0), 9) AS m_refute, round(CASE WHEN f.claim_id IS NULL THEN 1 ELSE qt / (qs + qr - qt) END, 9) AS m_theta,
            round(coalesce(f.k_doc, 0), 9) AS k_doc FROM claims c JOIN folds USING (claim_id) CROSS JOIN range(5) o(x) LEFT JOIN fu f ON f.claim_id = c.claim_id AND f.outer_fold = o.x),
        ei AS (SELECT * FROM er WHERE fold <> outer_fold)""" + searched("ei", "outer_fold", "_i") + f", fin AS (SELECT 'ds' AS method, gold_state, coalesce({state('theta', 'conflict')}, 'undetermined') AS predicted FROM er JOIN pick_i p ON er.outer_fold = p.outer_fold WHERE er.fold = er.outer_fold)" + report("fin", "method", "_f") + f" SELECT method, {R('accuracy', 'macro_f1')}, n FROM rep_f",
    "risk_coverage": RISK + f" SELECT method, {R('coverage', 'risk')} FROM rc", "aurc": RISK + " SELECT method, round(avg(risk), 6) AS aurc FROM rc GROUP BY 1",
    "label_calibration": SQL + f""", j AS (SELECT claim_id, doc_id, {VOTE} AS label, doc_reliability AS weight FROM evidence WHERE evaluator = 'e2')
        SELECT label, {", ".join(f"round(sum(weight * p_{k}) / sum(weight), 6) AS p_{k}" for k in ("support", "refute", "unknown"))}, round(sum(weight), 6) AS weight FROM j JOIN evidence e USING (claim_id, doc_id) WHERE e.evaluator = 'e1' GROUP BY label""",
    "vote_distribution": "SELECT l_orderkey AS claim_id, " + ", ".join(f"round(count(*) FILTER ({c}) / count(*), 6) AS {n}" for n, c in (("p_support", "l_returnflag = 'A'"), ("p_refute", "l_returnflag = 'R'"), ("p_unknown", "l_returnflag NOT IN ('A', 'R')"))) + ", count(*) AS n_votes FROM lineitem GROUP BY 1",
    "entropy_reliability": SQL + " SELECT claim_id, doc_id, evaluator, round(greatest(0, least(1, 1 - (" + " + ".join(f"CASE WHEN p_{k} > 0 THEN -p_{k} * ln(p_{k}) ELSE 0 END" for k in ("support", "refute", "unknown")) + ") / ln(3))), 6) AS reliability FROM evidence",
    "claim_dedup": r"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss'))",
    "passage_windows": f"WITH {WINDOWS} SELECT doc_id, passage, start, md5(text) AS text_md5 FROM win",
    "passage_tfidf_top1": f"""WITH {WINDOWS}, q AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS query_id, text FROM benchmark), p AS (SELECT w.*, doc_id % (SELECT count(*) FROM q) AS query_id FROM win w),
        pt AS (SELECT query_id, doc_id, passage, term, 1 + ln(count(*)) AS tf FROM (SELECT query_id, doc_id, passage, unnest({_TERMS}) AS term FROM p) WHERE term NOT IN ({_STOP}) GROUP BY ALL),
        qt AS (SELECT query_id, term, 1 + ln(count(*)) AS tf FROM (SELECT query_id, unnest({_TERMS}) AS term FROM q) WHERE term NOT IN ({_STOP}) GROUP BY ALL),
        n AS (SELECT query_id, count(*) + 1 AS n FROM p GROUP BY 1),
        idf AS (SELECT query_id, term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM (SELECT query_id, term FROM pt UNION ALL SELECT query_id, term FROM qt) JOIN n USING (query_id) GROUP BY query_id, term, n),
        sc AS (SELECT pt.query_id, doc_id, passage, coalesce(sum(pt.tf * idf * qt.tf * idf), 0) / sqrt(sum((pt.tf * idf) ** 2)) AS score FROM pt JOIN idf USING (query_id, term) LEFT JOIN qt USING (query_id, term) GROUP BY ALL)
        SELECT doc_id, passage, round(score, 6) AS score FROM (SELECT p.doc_id, p.passage, coalesce(score, 0) AS score FROM p LEFT JOIN sc USING (query_id, doc_id, passage))
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, passage) = 1""",
    "balanced_split": r"""WITH first AS (SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss')),
        r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS k FROM documents JOIN first USING (doc_id))
        SELECT doc_id, lang, CASE WHEN k <= 4 THEN 'train' WHEN k <= 6 THEN 'validation' ELSE 'test' END AS split FROM r WHERE k <= 9""",
    "vote_relations": """WITH v AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 1 / 3 ELSE (l_linestatus = 'F')::INT END AS s, CASE l_returnflag WHEN 'R' THEN 2 / 3 ELSE 0 END AS r, CASE WHEN l_returnflag IN ('A', 'R') THEN 0 ELSE (l_linestatus <> 'F')::INT END AS u FROM lineitem)
        SELECT 'climate-fever-' || CASE WHEN l_orderkey < 10000 THEN lpad(l_orderkey::VARCHAR, 4, '0') ELSE l_orderkey::VARCHAR END AS sample_id, count(*) AS n, round(sum(s), 6) AS p_support, round(sum(r), 6) AS p_refute, round(sum(u)::DOUBLE, 6) AS p_unknown FROM v GROUP BY l_orderkey""",
    "relations_from_labels": SQL + f""", lv AS (SELECT claim_id AS query_id, doc_id::VARCHAR AS doc_id, {VOTE} AS v FROM evidence),
        m(v, s, r, u) AS (VALUES ('supported', 0.85::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE), ('refuted', 0.05, 0.85, 0.1), ('unknown', 0.1, 0.1, 0.8))
        SELECT query_id, doc_id, 'checker' AS evaluator, round(avg(s), 6) AS p_support, round(avg(r), 6) AS p_refute, round(avg(u), 6) AS p_unknown FROM lv JOIN m USING (v) GROUP BY 1, 2""",
    "label_contingency": SQL + f""", a AS (SELECT claim_id, doc_id, {VOTE} AS label FROM evidence WHERE evaluator = 'e2'), b AS (SELECT claim_id, doc_id, CASE WHEN {TIES} > 1 THEN 'tie' WHEN p_support = {_TOP} THEN 'support' WHEN p_refute = {_TOP} THEN 'refute' ELSE 'unknown' END AS oracle FROM evidence WHERE evaluator = 'e1')
        SELECT label, oracle, count(*) AS n FROM a JOIN b USING (claim_id, doc_id) GROUP BY ALL""",
    "url_domain": f"SELECT page_id, {DOMAIN} AS domain FROM pages",
    "credibility_join": f"""WITH media(d, c) AS (VALUES ('example.com', 'high'), ('site1.example', 'medium'), ('site2.example', 'low'), ('example.org', 'medium')), p AS (SELECT {DOMAIN} AS domain FROM pages),
        j AS (SELECT coalesce(a.c, b.c) AS credibility FROM p LEFT JOIN media a ON a.d = p.domain LEFT JOIN media b ON b.d = array_to_string(string_split(p.domain, '.')[-2:], '.'))
        SELECT credibility, CASE credibility WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.2 ELSE 0.5 END::DOUBLE AS reliability, count(*) AS n FROM j GROUP BY ALL""",
    "reliability_estimate": SQL + f", {BS}, {SIDE}" + detection("sides", "evaluator, side") + " SELECT evaluator, round(greatest(0, least(1, 2 * avg(auroc) - 1)), 6) AS reliability, round(avg(auroc), 6) AS mean_auroc FROM det GROUP BY 1",
}
