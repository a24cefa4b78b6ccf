"""Bootstrap, quality score, thresholds, strategies, sweeps, attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.metric_checks import AP, AUROC, BRIER
from checks.profile_checks import flags
from checks.registry import CLINICAL, FEATURES, QUALITY_CUT, R, SPREAD_CUT, d, n, query, step, tables, P
from checks.views import view
from cohortmill import presets
from cohortmill.functions.columns import poisson_one_cdf
from cohortmill.operators import attribution, bootstrap, clean, curves, measures, reliability
from cohortmill.operators.running import exact_quantiles
from cohortmill.plans import steps
from cohortmill.session import materialize

KEY = R.entity
T = reliability.Thresholds(SPREAD_CUT, QUALITY_CUT)
ARGS = ("y", "p", "ustd", "dq")


def scored(spark, sf):
    return view(spark, sf, "fx_scored")


# --- bootstrap -------------------------------------------------------------------------

def poisson_sql(u: str) -> str:
    return "case " + " ".join(f"when {u} < {e!r}::double then {k}" for k, e in enumerate(poisson_one_cdf())) + " else 13 end"


@query("bootstrap_weights", f"""
select resample::bigint resample, y::bigint y, sum({poisson_sql("u")})::bigint copies, count(*) filter (where {poisson_sql("u")} > 0) used
from (select resample, y, (('0x' || substr(md5((42 + resample)::varchar || ':' || patientunitstayid::varchar), 1, 8))::bigint
        / 4294967296.0)::double u from fx_scored cross join range(30) b(resample)) group by 1, 2""")
def _(spark, sf):
    return bootstrap.resample_weights(scored(spark, sf), KEY, 30, keep=["y"]).groupBy("resample", "y").agg(
        F.sum("copies").alias("copies"), F.count_if(F.col("copies") > 0).alias("used"))


@query("ensemble_spread", f"""
select patientunitstayid, {d("m", "boot_mean")}, {d("sqrt(((a-m)*(a-m) + (b-m)*(b-m) + (c-m)*(c-m) + (e-m)*(e-m)) / 4)", "boot_std")}
from (select *, (a + b + c + e) / 4 m from (select patientunitstayid, p a, p * 0.9 b, p * p c, ustd e from fx_scored))""")
def _(spark, sf):
    p = F.col("p")
    wide = scored(spark, sf).select(KEY, p.alias("a"), (p * 0.9).alias("b"), (p * p).alias("c"), F.col("ustd").alias("e"))
    return bootstrap.ensemble_spread(wide, ["a", "b", "c", "e"]).select(KEY, "boot_mean", "boot_std")


# --- data-quality score ------------------------------------------------------------------

def dq_sql(flag: str) -> str:
    return f"""
select patientunitstayid, {d(f"least(1.0, greatest(0.0, 0.4::double * least(1.0, available_lab_count / 15.0::double) "
  f"+ 0.3::double * least(1.0, available_vital_count / 7.0::double) "
  f"+ 0.2::double * least(1.0, greatest(0.0, 1.0 - missing_feature_count / {len(CLINICAL)}.0::double)) "
  f"+ 0.1::double * coalesce({flag}, 0.5)))", "data_quality_score")}
from ftable left join qflags using (patientunitstayid)"""


PASSED = """1.0 - (flag_missing_demographics::int + flag_missing_target::int + flag_missing_lab_data::int
  + flag_missing_vital_data::int + flag_possible_invalid_value::int) / 5.0::double"""


def dq(spark, sf, share):
    features = steps.build_features(tables(spark, sf), P)
    return reliability.data_quality_score(features, KEY, share(flags(spark, sf), KEY), len(CLINICAL)).select(
        KEY, "data_quality_score")


@query("dq_score", dq_sql(PASSED))
def _(spark, sf):
    return dq(spark, sf, reliability.passed_share)


@query("dq_score_legacy", dq_sql("0.0"))
def _(spark, sf):
    return dq(spark, sf, reliability.keyword_share)


# --- strategies ---------------------------------------------------------------------------

RULES = {"model_only": "true", "uncertainty_abstain": f"ustd < {SPREAD_CUT}", "dq_abstain": f"dq >= {QUALITY_CUT}",
         "combined": f"ustd < {SPREAD_CUT} and dq >= {QUALITY_CUT}"}


@query("strategy_decisions", " union all ".join(
    f"select patientunitstayid, '{s}' strategy, {w} accept from fx_scored" for s, w in RULES.items()))
def _(spark, sf):
    return reliability.strategy_decisions(scored(spark, sf), KEY, "ustd", "dq", T)


def accepted_sql(where: str, extra: str = "") -> str:
    """Metrics of the accepted rows as one row, with the total."""
    return f"""
select {extra} (select count(*) from fx_scored) n_total, coalesce(sum(pos + neg), 0) n,
  sum(case when p >= 0.5 then neg else pos end)::double / sum(pos + neg) error_rate, {BRIER} brier,
  case when max(tp) > 0 and max(fp) > 0 then {AUROC} end auroc, case when max(tp) > 0 and max(fp) > 0 then {AP} end pr_auc
from (select *, sum(pos) over (order by p desc) tp, sum(neg) over (order by p desc) fp
      from (select p, sum(y) pos, sum(1 - y) neg from fx_scored where {where} group by p))"""


step("strategies", " union all ".join(
    accepted_sql(w, f"{i} \"position\", '{s}' strategy,") for i, (s, w) in enumerate(RULES.items())))


@query("strategy_metrics", f"""
select "position"::bigint "position", strategy, n_total, n::bigint n_accepted, {d("n::double / n_total", "coverage")},
  {d("1 - n::double / n_total", "abstention_rate")}, {d("error_rate")}, {d("brier")}, {d("auroc")}, {d("pr_auc")} from strategies""")
def _(spark, sf):
    return reliability.evaluate_strategies(scored(spark, sf), *ARGS, T)


LABELS = {"model_only": "Model only", "uncertainty_abstain": "Abstain on spread", "dq_abstain": "Abstain on data quality",
          "combined": "Combined"}


@query("strategy_table", "select \"position\"::bigint \"position\", case strategy " + " ".join(
    f"when '{k}' then '{v}'" for k, v in LABELS.items()) + """ end strategy_label,
  printf('%.1f%%', 100.0 * n::double / n_total) coverage, printf('%.1f%%', 100.0 * (1 - n::double / n_total)) abstained, n::bigint n_accepted,
  coalesce(printf('%.1f%%', 100.0 * error_rate), 'N/A') error_rate, coalesce(printf('%.3f', auroc), 'N/A') auroc,
  coalesce(printf('%.3f', pr_auc), 'N/A') pr_auc, coalesce(printf('%.4f', brier), 'N/A') brier from strategies""")
def _(spark, sf):
    return reliability.strategy_table(reliability.evaluate_strategies(scored(spark, sf), *ARGS, T), LABELS)


# --- threshold choice -----------------------------------------------------------------------

@query("percentile_candidates", " union all ".join(
    [f"select 'spread' kind, {q}::double quantile, {d(f'quantile_cont(ustd, {q})', 'threshold')} from fx_scored" for q in presets.SPREAD_QUANTILES]
    + [f"select 'quality' kind, {q}::double quantile, {d(f'quantile_cont(dq, {q})', 'threshold')} from fx_scored" for q in presets.QUALITY_QUANTILES]))
def _(spark, sf):
    return reliability.candidate_thresholds(scored(spark, sf), "ustd", "dq")


step("ucut", "select distinct u from (" + " union all ".join(
    f"select quantile_cont(ustd, {q}) u from fx_scored" for q in presets.SPREAD_QUANTILES) + ")")
step("qcut", "select distinct q from (" + " union all ".join(
    f"select quantile_cont(dq, {q}) q from fx_scored" for q in presets.QUALITY_QUANTILES) + ")")
step("cellrows", "select u, q, p, sum(y) pos, sum(1 - y) neg from fx_scored, ucut, qcut where ustd < u and dq >= q group by u, q, p")
step("cellranked", """
select *, sum(pos) over (partition by u, q order by p desc) tp, sum(neg) over (partition by u, q order by p desc) fp from cellrows""")
step("cellmetrics", f"select u, q, sum(pos + neg) n, max(tp) np, max(fp) nn, {AUROC} auroc from cellranked group by u, q")
step("grid", """
select ucut.u, qcut.q, coalesce(n, 0) n, coalesce(n, 0)::double / (select count(*) from fx_scored) coverage,
  coalesce(n >= 10 and n::double / (select count(*) from fx_scored) >= 0.6 and np > 0 and nn > 0, false) eligible, auroc
from ucut cross join qcut left join cellmetrics c on c.u = ucut.u and c.q = qcut.q""")


def grid(spark, sf):
    rows = materialize(scored(spark, sf))
    u, q = reliability.distinct_cuts(reliability.candidate_thresholds(rows, "ustd", "dq"))
    return reliability.threshold_grid(rows, *ARGS, u, q)


@query("threshold_grid", f"""
select {d("u", "thresh_u")}, {d("q", "thresh_dq")}, n::bigint n_accepted, {d("coverage")}, eligible,
  {d("case when eligible then auroc end", "auroc_accepted")} from grid""")
def _(spark, sf):
    return grid(spark, sf)


RANGED = 1000
RANGED_U, RANGED_Q = (0.1, 0.2, 0.28), (0.4, 0.7)


def full(spark, sf):
    return view(spark, sf, "fx_full")


# Area under the curve from average ranks: ties take the middle of their places.
step("fullranks", "select *, rank() over (partition by unittype order by p) + (count(*) over (partition by unittype, p) - 1) / 2.0::double r from fx_full")


@query("auroc_ranged", f"""
select unittype, count(*) n, {n("sum(y)", "n_pos")},
  {d("(sum(r) filter (where y = 1) - sum(y)::double * (sum(y) + 1) / 2) / nullif(sum(y)::double * sum(1 - y), 0)", "auroc")}
from fullranks group by unittype""")
def _(spark, sf):
    """Nearly all scores differ, and a range holds 1,000 of them."""
    return curves.ranking_metrics(full(spark, sf), "y", "p", ["unittype"], rows_per_range=RANGED).select(
        "unittype", "n", "n_pos", "auroc")


@query("quantiles_ranged", f"""
select unittype, count(*) n, {d("quantile_cont(p, 0.25)", "q0")}, {d("quantile_cont(p, 0.5)", "q1")}, {d("quantile_cont(p, 0.99)", "q2")}
from fx_full group by unittype""")
def _(spark, sf):
    return exact_quantiles(full(spark, sf), "p", [0.25, 0.5, 0.99], ["unittype"], rows_per_range=RANGED)


@query("threshold_grid_ranged", f"""
with cuts as (select * from (values {", ".join(f"({u}::double, {q}::double)" for u in RANGED_U for q in RANGED_Q)}) t(u, q)),
x as (
  select u, q, y, rank() over (partition by u, q order by p) + (count(*) over (partition by u, q, p) - 1) / 2.0::double r
  from fx_full, cuts where ustd < u and dq >= q),
g as (
  select u, q, count(*) n, sum(y) np, sum(1 - y) nn,
    (sum(r) filter (where y = 1) - sum(y)::double * (sum(y) + 1) / 2) / nullif(sum(y)::double * sum(1 - y), 0) auroc
  from x group by u, q),
e as (
  select cuts.u, cuts.q, coalesce(n, 0) n, coalesce(n, 0)::double / (select count(*) from fx_full) coverage, auroc,
    coalesce(n >= 10 and n::double / (select count(*) from fx_full) >= 0.1 and np > 0 and nn > 0, false) eligible
  from cuts left join g on cuts.u = g.u and cuts.q = g.q)
select {d("u", "thresh_u")}, {d("q", "thresh_dq")}, n n_accepted, {d("coverage")}, eligible,
  {d("case when eligible then auroc end", "auroc_accepted")} from e""")
def _(spark, sf):
    return reliability.threshold_grid(full(spark, sf), *ARGS, list(RANGED_U), list(RANGED_Q), min_coverage=0.1,
                                      rows_per_range=RANGED)


@query("threshold_choice", f"""
select {d("u", "thresh_u")}, {d("q", "thresh_dq")}, {d("coverage")}, {d("case when eligible then auroc else 0 end", "auroc_accepted")}, eligible
from grid order by eligible desc, case when eligible then auroc end desc nulls last,
  case when eligible then u else -u end, q limit 1""")
def _(spark, sf):
    return reliability.threshold_choice(grid(spark, sf))


POINTS = 40
step("sweepcuts", f"""
select i, case when i = {POINTS - 1} then hi else i * ((hi - lo) / {POINTS - 1}) + lo end t, med
from range({POINTS}) r(i), (select min(ustd) + 1e-6::double lo, max(ustd) + 1e-6::double hi, quantile_cont(dq, 0.5) med from fx_scored)""")
step("sweeprows", "select i, p, sum(y) pos, sum(1 - y) neg from fx_scored, sweepcuts where ustd < t and dq >= med group by i, p")
step("sweepranked", """
select *, sum(pos) over (partition by i order by p desc) tp, sum(neg) over (partition by i order by p desc) fp from sweeprows""")
step("sweepmetrics", f"""
select i, sum(pos + neg) n, case when max(tp) > 0 and max(fp) > 0 then {AUROC} end auroc,
  case when max(tp) > 0 and max(fp) > 0 then {AP} end pr_auc, {BRIER} brier from sweepranked group by i""")
step("sweep", """
select i point, t thresh_u, coalesce(n, 0) n_accepted, coalesce(n, 0)::double / (select count(*) from fx_scored) coverage,
  case when n >= 5 then auroc end auroc, case when n >= 5 then pr_auc end pr_auc, case when n >= 5 then brier end brier
from sweepcuts left join sweepmetrics using (i)""")


@query("risk_coverage", "select point::bigint point, " + ", ".join([d("thresh_u"), n("n_accepted")] + [
    d(c) for c in ("coverage", "auroc", "pr_auc", "brier")]) + " from sweep")
def _(spark, sf):
    return reliability.risk_coverage(materialize(scored(spark, sf)), *ARGS, POINTS)


TARGETS = [0.60, 0.75, 0.90, 1.00]


@query("sweep_at_targets", f"""
with near as (select target, s.*, round(coverage, 2) r from (values {", ".join(f"({t}::double)" for t in TARGETS)}) t(target), sweep s
  qualify row_number() over (partition by target order by abs(coverage - target), point) = 1),
one as (select * from near qualify row_number() over (partition by r order by target) = 1)
select target target_coverage, point::bigint point, """ + ", ".join([d("thresh_u"), d("coverage"), n("n_accepted")] + [
    d(c) for c in ("auroc", "pr_auc", "brier")]) + " from one")
def _(spark, sf):
    return reliability.sweep_at_targets(reliability.risk_coverage(materialize(scored(spark, sf)), *ARGS, POINTS), TARGETS)


# --- per-entity records ---------------------------------------------------------------------

LOW = SPREAD_CUT * 0.55


@query("reliability_bands", f"""
select patientunitstayid,
  case when ustd <= {LOW!r}::double then 'LOW' when ustd >= {SPREAD_CUT} then 'HIGH' else 'MODERATE' end spread_band,
  case when dq <= {QUALITY_CUT} then 'LOW' when dq >= 0.75 then 'HIGH' else 'MODERATE' end quality_band,
  case when ustd >= {SPREAD_CUT} then 'HIGH' when ustd >= {LOW!r}::double then 'MODERATE' else 'LOW' end spread_band_strict,
  case when dq < {QUALITY_CUT} then 'LOW' when dq < 0.75 then 'MODERATE' else 'HIGH' end quality_band_strict,
  case when p > 0.5 then 'high' when p > 0.2 then 'medium' else 'low' end risk_band from fx_scored""")
def _(spark, sf):
    return reliability.reliability_bands(scored(spark, sf), KEY, "p", "ustd", "dq", T)


@query("reliability_report", f"""
select patientunitstayid, {d("p", "probability")}, {d("p", "ensemble_mean")}, {d("ustd", "ensemble_std")},
  case when ustd <= {LOW!r}::double then 'LOW' when ustd >= {SPREAD_CUT} then 'HIGH' else 'MODERATE' end spread_band,
  {d("dq", "data_quality_score")}, case when dq <= {QUALITY_CUT} then 'LOW' when dq >= 0.75 then 'HIGH' else 'MODERATE' end quality_band,
  case when {RULES["combined"]} then 'ACCEPT' else 'ABSTAIN' end decision,
  concat_ws('; ', case when ustd >= {SPREAD_CUT} then printf('The resampled models disagree: spread %.3f, allowed is less than %.3f', ustd, {SPREAD_CUT}::double) end,
    case when dq < {QUALITY_CUT} then 'The row rests on too little data: quality ' || printf('%.2f', floor(dq * 100 + 0.5 + 1e-9) / 100) || printf(', needed is %.2f', {QUALITY_CUT}::double) end) reasons
from fx_scored""")
def _(spark, sf):
    report = reliability.reliability_report(scored(spark, sf), KEY, "p", "p", "ustd", "dq", T)
    return report.withColumn("reasons", F.array_join("reasons", "; "))


@query("abstain_profile", f"""
select case when {RULES["combined"]} then 'ACCEPT' else 'ABSTAIN' end decision, count(*) n, {d("avg(ustd)", "mean_spread")},
  {d("avg(dq)", "mean_quality")} from fx_scored group by 1""")
def _(spark, sf):
    return reliability.abstain_profile(scored(spark, sf), "ustd", "dq", T)


@query("case_studies", f"""
select quadrant, patientunitstayid, uniquepid, unittype, {d("p", "probability")}, case when y = 1 then 'Deceased' else 'Survived' end actual_outcome
from (select *, case when y = 1 and p >= 0.2 then 'TP' when y = 0 and p < 0.2 then 'TN' when y = 0 then 'FP' else 'FN' end quadrant from fx_scored)
qualify row_number() over (partition by quadrant order by case when p >= 0.2 then -p else p end, patientunitstayid) = 1""")
def _(spark, sf):
    rows = scored(spark, sf)
    return attribution.with_metadata(attribution.case_studies(rows, KEY, "y", "p", 0.2), rows, KEY, ["uniquepid", "unittype"])


# --- attributions of a linear model over the signal means --------------------------------------

WEIGHTS = {f"{c}_mean": w for c, w in zip(FEATURES.wide, (0.02, -0.03, 0.05, 0.4, -0.01, 0.015, -0.02))}
CENTRES = {f"{c}_mean": m for c, m in zip(FEATURES.wide, (130.0, 85.0, 30.0, 36.0, 120.0, 70.0, 90.0))}
step("contrib", " union all ".join(
    f"select patientunitstayid, '{c}' feature, {c} feature_value, coalesce({w}::double * ({c} - {CENTRES[c]}::double), 0.0) shap_value from vfeat"
    for c, w in WEIGHTS.items()))


def contributions(spark, sf):
    vitals = clean.mask_wide(clean.in_window(view(spark, sf, "fx_vital"), R.wide_offset), P.wide_bounds)
    return attribution.linear_contributions(measures.wide_features(vitals, KEY, FEATURES.wide), KEY, WEIGHTS, CENTRES)


@query("linear_contributions", f"select patientunitstayid, feature, {d('feature_value')}, {d('shap_value')} from contrib")
def _(spark, sf):
    return contributions(spark, sf)


step("importance", """
select feature, m mean_abs_shap, 100.0 * m / sum(m) over () relative_pct,
  100.0 * sum(m) over (order by m desc, feature rows unbounded preceding) / sum(m) over () cumulative_pct,
  row_number() over (order by m desc, feature) "rank"
from (select feature, avg(abs(shap_value)) m from contrib group by feature)""")


@query("global_importance", f"select feature, {d('mean_abs_shap')}, {d('relative_pct')} from importance")
def _(spark, sf):
    return attribution.global_importance(contributions(spark, sf)).select("feature", "mean_abs_shap", "relative_pct")


@query("importance_cumulative", f"select feature, \"rank\"::bigint \"rank\", {d('cumulative_pct')} from importance")
def _(spark, sf):
    return attribution.global_importance(contributions(spark, sf)).select("feature", "rank", "cumulative_pct")


step("signed", """
select *, case when shap_value > 0 then 'increase' else 'decrease' end direction,
  row_number() over (partition by patientunitstayid, shap_value > 0 order by abs(shap_value) desc, feature) rk
from contrib where shap_value <> 0""")


@query("topk_contributions", f"""
select patientunitstayid, direction, rk::bigint "rank", feature, {d("feature_value")}, {d("shap_value")} from signed where rk <= 3""")
def _(spark, sf):
    return attribution.signed_top(contributions(spark, sf), KEY, 3)


@query("local_contributions", f"""
select patientunitstayid, {d("0.25", "base_value")}, {d("sum(shap_value)", "total_shap")}, {d("0.25 + sum(shap_value)", "margin")},
  coalesce(string_agg(feature, ',' order by abs(shap_value) desc, feature) filter (where shap_value > 0), '') top_increasing,
  coalesce(string_agg(feature, ',' order by abs(shap_value) desc, feature) filter (where shap_value < 0), '') top_decreasing
from contrib group by patientunitstayid""")
def _(spark, sf):
    local = attribution.local_contributions(contributions(spark, sf).withColumn("base_value", F.lit(0.25)), KEY, 7)
    names = lambda c: F.array_join(F.transform(c, lambda e: e["feature"]), ",")
    return local.withColumns({c: names(c) for c in ("top_increasing", "top_decreasing")})


@query("driver_text", """
select patientunitstayid, coalesce(string_agg(feature, ', ' order by rk) filter (where direction = 'increase'), '') increasing,
  coalesce(string_agg(feature, ', ' order by rk) filter (where direction = 'decrease'), '') decreasing
from signed where rk <= 3 group by patientunitstayid""")
def _(spark, sf):
    return attribution.driver_text(contributions(spark, sf), KEY)
