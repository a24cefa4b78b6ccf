"""Ranking, threshold, calibration and model-selection queries on scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import d, pct, query, ratio, step
from checks.views import view
from cohortmill import presets
from cohortmill.operators import curves, models

EDGES10 = curves.uniform_edges(10)
EDGES8 = curves.uniform_edges(8)


def scored(spark, sf):
    return view(spark, sf, "fx_scored")


def catalog_rows(spark, sf):
    """Nine (model, variant) score sets derived from the scored rows."""
    p = F.col("p")
    base = scored(spark, sf).select(
        "patientunitstayid", "y", F.when(F.col("uniquepid") % 2 == 0, "validation").otherwise("test").alias("split"), "p",
        F.inline(F.array(*[F.struct(F.lit(m).alias("model"), e.alias("b")) for m, e in (
            ("logistic", p), ("forest", F.round(F.sqrt(p), 4)), ("boosted", F.round(p * p, 4)))])))
    b = F.col("b")
    return base.select("patientunitstayid", "y", "split", "model", F.inline(F.array(*[
        F.struct(F.lit(v).alias("variant"), e.alias("p")) for v, e in (
            ("uncalibrated", b), ("sigmoid_platt", F.round(b * 0.8 + 0.02, 4)), ("isotonic", F.round(b, 1)))])))


step("catalog", """
select patientunitstayid, y, split, model, variant,
  case variant when 'uncalibrated' then b when 'sigmoid_platt' then round(b * 0.8 + 0.02, 4) else round(b, 1) end p
from (select patientunitstayid, y, case when uniquepid % 2 = 0 then 'validation' else 'test' end split, model,
        case model when 'logistic' then p when 'forest' then round(sqrt(p), 4) else round(p * p, 4) end b
      from fx_scored cross join (values ('logistic'), ('forest'), ('boosted')) m(model)) s
cross join (values ('uncalibrated'), ('sigmoid_platt'), ('isotonic')) v(variant)""")


def curve_steps(name: str, source: str, by: str) -> None:
    """SQL steps: counts per score, running counts and class totals per group."""
    comma = f"{by}, " if by else ""
    part = f"partition by {by}" if by else ""
    step(f"{name}_counts", f"select {comma}p, sum(y) pos, sum(1 - y) neg from {source} group by {comma}p")
    step(f"{name}_ranked", f"""
select *, sum(pos) over ({part} order by p desc) tp, sum(neg) over ({part} order by p desc) fp,
  sum(pos) over ({part}) np, sum(neg) over ({part}) nn from {name}_counts""")


curve_steps("allrows", "fx_scored", "")
curve_steps("unit", "fx_scored", "unittype")
curve_steps("cat", "catalog", "model, variant, split")

AUROC = "sum(neg * (tp - pos / 2.0)) / (max(tp) * max(fp))"
AP = "sum(pos * tp::double / (tp + fp)) / max(tp)"
BRIER = "sum(pos * (1 - p) * (1 - p) + neg * p * p) / sum(pos + neg)"


@query("auroc", f"""select unittype, sum(pos + neg)::bigint n, sum(pos)::bigint n_pos, {d(AUROC, "auroc")} from unit_ranked group by unittype""")
def _(spark, sf):
    return curves.ranking_metrics(scored(spark, sf), "y", "p", ["unittype"]).select("unittype", "n", "n_pos", "auroc")


@query("average_precision", f"""select unittype, {d(AP, "average_precision")} from unit_ranked group by unittype""")
def _(spark, sf):
    return curves.ranking_metrics(scored(spark, sf), "y", "p", ["unittype"]).select("unittype", "average_precision")


@query("brier", f"select count(*) n, {d('avg((p - y) * (p - y))', 'brier')} from fx_scored")
def _(spark, sf):
    return curves.brier_score(scored(spark, sf), "y", "p")


def point_sql(tp="tp", fp="fp", fn="fn", tn="tn"):
    return (f"{tn}::bigint tn, {fp}::bigint fp, {fn}::bigint fn, {tp}::bigint tp, "
            f"{d(ratio(tp, f'{tp} + {fp}'), 'precision')}, {d(ratio(tp, f'{tp} + {fn}'), 'recall')}, "
            f"{d(ratio(tn, f'{tn} + {fp}'), 'specificity')}, {d(ratio(tn, f'{tn} + {fn}'), 'npv')}, "
            f"{d(ratio(f'2.0 * {tp}', f'2 * {tp} + {fp} + {fn}'), 'f1')}, "
            f"{d(f'({ratio(tp, f'{tp} + {fn}')} + {ratio(tn, f'{tn} + {fp}')}) / 2.0', 'balanced_accuracy')}")


@query("operating_metrics", " union all ".join(f"""
select {t}::double threshold, {point_sql()} from (select count(*) filter (where y = 1 and p >= {t}) tp,
  count(*) filter (where y = 0 and p >= {t}) fp, count(*) filter (where y = 1 and p < {t}) fn,
  count(*) filter (where y = 0 and p < {t}) tn from fx_scored)""" for t in (0.1, 0.5, 0.9)))
def _(spark, sf):
    rows = scored(spark, sf).select("y", "p", F.explode(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("cut"))
    return curves.operating_metrics(rows, "y", "p", F.col("cut"), ["cut"]).drop("cut")


@query("roc_curve", f"""
select null::double threshold, 0.0::double fpr, 0.0::double tpr union all
select {d("p", "threshold")}, {d("fp::double / nn", "fpr")}, {d("tp::double / np", "tpr")} from allrows_ranked""")
def _(spark, sf):
    points = curves.roc_points(scored(spark, sf), "y", "p")
    return points.withColumn("threshold", F.when(F.col("threshold") < float("inf"), F.col("threshold")))


@query("pr_curve", f"""
select {d("p", "threshold")}, {d("tp::double / (tp + fp)", "precision")}, {d("tp::double / np", "recall")} from allrows_ranked
union all select null, 1.0, 0.0""")
def _(spark, sf):
    return curves.pr_points(scored(spark, sf), "y", "p")


@query("youden_threshold", f"""
select unittype, {d("p", "youden_threshold")}, {d("(tp * nn - fp * np)::double / (np * nn)", "youden_j")}
from unit_ranked qualify row_number() over (partition by unittype order by tp * nn - fp * np desc, p desc) = 1""")
def _(spark, sf):
    return curves.youden_threshold(scored(spark, sf), "y", "p", ["unittype"])


@query("max_f1_threshold", f"""
select unittype, {d("p", "max_f1_threshold")}, {d("2.0 * tp::double / (tp + fp + np)", "max_f1")}
from unit_ranked qualify row_number() over (partition by unittype order by 2.0 * tp::double / (tp + fp + np) desc, p) = 1""")
def _(spark, sf):
    return curves.max_f1_threshold(scored(spark, sf), "y", "p", ["unittype"])


def bin_sql(edges, op=">="):
    return " + ".join(f"(p {op} {e!r}::double)::int" for e in edges[1:-1])


step("bins10", f"""
select model, variant, split, {bin_sql(EDGES10)} bin, sum(pos + neg) n, sum(p * (pos + neg)) / sum(pos + neg) confidence,
  sum(pos)::double / sum(pos + neg) accuracy from cat_counts group by all""")


@query("calibration_bins", f"""
select bin::bigint bin, n::bigint n, {d("c", "confidence")}, {d("a", "accuracy")}, {d("abs(a - c)", "gap")} from (
  select {bin_sql(EDGES10)} bin, sum(pos + neg) n, sum(p * (pos + neg)) / sum(pos + neg) c, sum(pos)::double / sum(pos + neg) a
  from allrows_counts group by 1)""")
def _(spark, sf):
    return curves.calibration_bins(scored(spark, sf), "y", "p")


@query("ece_mce", f"""
select model, variant, split, sum(n)::bigint n, {d("sum(n * abs(accuracy - confidence)) / sum(n)", "ece")},
  {d("max(abs(accuracy - confidence))", "mce")} from bins10 group by model, variant, split""")
def _(spark, sf):
    by = ["model", "variant", "split"]
    return curves.calibration_error(curves.calibration_bins(catalog_rows(spark, sf), "y", "p", by), by)


@query("ece_quantile", f"""
with e as (select distinct e from (select unnest([0.0::double, 1.0::double, {", ".join(f"quantile_cont(p, {i / 10!r})" for i in range(1, 10))}]) e
    from fx_scored)),
b as (select greatest(0, least((select count(*) from e where e.e <= c.p) - 1, (select count(*) from e) - 2)) bin, p, pos, neg from allrows_counts c),
g as (select bin, sum(pos + neg) n, sum(p * (pos + neg)) / sum(pos + neg) c, sum(pos)::double / sum(pos + neg) a from b group by bin)
select sum(n)::bigint n, {d("sum(n * abs(a - c)) / sum(n)", "ece")}, {d("max(abs(a - c))", "mce")} from g""")
def _(spark, sf):
    return curves.calibration_error(curves.quantile_bins(scored(spark, sf), "y", "p"))


@query("reliability_curve", f"""
select bin::bigint bin, n::bigint n, {d("c", "confidence")}, {d("a", "accuracy")} from (
  select {bin_sql(EDGES8, ">")} bin, sum(pos + neg) n, sum(p * (pos + neg)) / sum(pos + neg) c, sum(pos)::double / sum(pos + neg) a
  from allrows_counts group by 1)""")
def _(spark, sf):
    return curves.reliability_curve(scored(spark, sf), "y", "p")


@query("confusion_matrix", f"""
select y::bigint actual, (p >= 0.2)::bigint predicted, count(*) n,
  {d("count(*)::double / sum(count(*)) over (partition by y)", "row_share")} from fx_scored group by 1, 2, y""")
def _(spark, sf):
    return curves.confusion_matrix(scored(spark, sf), "y", "p", 0.2)


def rates_sql(prefix, tp, fp, names=("precision", "recall", "specificity", "f1")):
    fn, tn = f"(np - {tp})", f"(nn - {fp})"
    texts = {"precision": ratio(tp, f"{tp} + {fp}"), "recall": ratio(tp, "np"), "specificity": ratio(tn, "nn"),
             "npv": ratio(tn, f"{tn} + {fn}"), "f1": ratio(f"2.0 * {tp}", f"2 * {tp} + {fp} + {fn}")}
    return ", ".join(d(texts[k], f"{prefix}_{k}") for k in names)


def at(source, keys, threshold, column):
    match = " and ".join(f"r.{k} = t.{k}" for k in keys) or "true"
    return f"coalesce((select max(r.{column}) from {source} r where {match} and r.p >= t.{threshold}), 0)"


@query("binary_metrics", f"""
with m as (select unittype, max(tp) np, max(fp) nn, {AUROC} auroc, {AP} ap, {BRIER} brier from unit_ranked group by unittype),
j as (select unittype, case when tp * nn - fp * np > 0 then least(1.0, greatest(0.0, p)) else 1.0 end yt from unit_ranked
  qualify row_number() over (partition by unittype order by tp * nn - fp * np desc, p desc) = 1),
f as (select unittype, least(1.0, greatest(0.0, p)) ft, 2.0 * tp::double / (tp + fp + np) f1 from unit_ranked
  qualify row_number() over (partition by unittype order by 2.0 * tp::double / (tp + fp + np) desc, p) = 1),
a as (select *, 0.5::double half from m join j using (unittype) join f using (unittype)),
t as (select t.*, {at("unit_ranked", ["unittype"], "half", "tp")} dtp, {at("unit_ranked", ["unittype"], "half", "fp")} dfp,
  {at("unit_ranked", ["unittype"], "yt", "tp")} ytp, {at("unit_ranked", ["unittype"], "yt", "fp")} yfp from a t)
select unittype, np::bigint n_pos, nn::bigint n_neg, {d("auroc")}, {d("ap", "average_precision")}, {d("brier")}, half threshold,
  {rates_sql("fixed", "dtp", "dfp")}, {d("yt", "youden_threshold")}, {rates_sql("youden", "ytp", "yfp")},
  {d("ft", "max_f1_threshold")}, {d("f1", "max_f1")} from t""")
def _(spark, sf):
    return curves.binary_metrics(scored(spark, sf), "y", "p", ["unittype"])


KEYS = ["model", "variant"]
step("cat_metrics", f"""
select model, variant, split, max(tp) np, max(fp) nn, {AUROC} auroc, {AP} ap, {BRIER} brier from cat_ranked group by model, variant, split""")
step("cat_ece", """
select model, variant, split, sum(n * abs(accuracy - confidence)) / sum(n) ece, max(abs(accuracy - confidence)) mce
from bins10 group by model, variant, split""")
step("cat_youden", """
select model, variant, case when tp * nn - fp * np > 0 then least(0.99, greatest(0.01, p)) else 0.99 end yt
from cat_ranked where split = 'validation'
qualify row_number() over (partition by model, variant order by tp * nn - fp * np desc, p desc) = 1""")
step("cat_f1", """
select model, variant, least(0.99, greatest(0.01, p)) ft from cat_ranked where split = 'validation'
qualify row_number() over (partition by model, variant order by 2.0 * tp::double / (tp + fp + np) desc, p) = 1""")
step("cat_test", "select * from cat_ranked where split = 'test'")
step("evaluated", f"""
select t.model, t.variant, t.np, t.nn, t.auroc test_auroc, t.ap test_pr_auc, v.auroc val_auroc, v.ap val_pr_auc,
  t.brier test_brier, te.ece test_ece, te.mce test_mce, v.brier val_brier, ve.ece val_ece, ve.mce val_mce,
  abs(v.auroc - t.auroc) delta_auroc, abs(v.ap - t.ap) delta_pr_auc, abs(v.brier - t.brier) delta_brier,
  y.yt, f.ft, 0.5::double half
from cat_metrics t join cat_metrics v on t.model = v.model and t.variant = v.variant and v.split = 'validation'
join cat_ece te on te.model = t.model and te.variant = t.variant and te.split = 'test'
join cat_ece ve on ve.model = t.model and ve.variant = t.variant and ve.split = 'validation'
join cat_youden y on y.model = t.model and y.variant = t.variant join cat_f1 f on f.model = t.model and f.variant = t.variant
where t.split = 'test'""")
FULL = ("recall", "specificity", "precision", "npv", "f1")


@query("evaluation_catalog", f"""
with pt as (select t.*, {at("cat_test", KEYS, "half", "tp")} dtp, {at("cat_test", KEYS, "half", "fp")} dfp,
  {at("cat_test", KEYS, "yt", "tp")} ytp, {at("cat_test", KEYS, "yt", "fp")} yfp,
  {at("cat_test", KEYS, "ft", "tp")} ftp, {at("cat_test", KEYS, "ft", "fp")} ffp from evaluated t)
select model, variant, np::bigint n_pos, nn::bigint n_neg, """ + ", ".join(d(c) for c in (
    "test_auroc", "test_pr_auc", "val_auroc", "val_pr_auc", "test_brier", "test_ece", "test_mce", "val_brier", "val_ece",
    "val_mce", "delta_auroc", "delta_pr_auc", "delta_brier")) + f""",
  {rates_sql("default", "dtp", "dfp")}, {d("yt", "youden_threshold")}, {rates_sql("youden", "ytp", "yfp", FULL)},
  {d("ft", "max_f1_threshold")}, {rates_sql("max_f1", "ftp", "ffp", FULL)} from pt""")
def _(spark, sf):
    return models.evaluation_catalog(catalog_rows(spark, sf))


@query("model_scorecard", f"""
with b as (select * from evaluated qualify row_number() over (partition by model order by val_brier, variant) = 1),
s as (select model, variant best_variant, val_auroc auroc, val_pr_auc pr_auc, val_brier brier, val_ece ece,
  0.5 * val_auroc / max(val_auroc) over () + 0.5 * val_pr_auc / max(val_pr_auc) over () discrimination,
  0.5 * min(val_brier) over () / val_brier + 0.5 * (min(val_ece) over () / (val_ece + 1e-6)) calibration,
  case model when 'logistic' then 1.0 when 'forest' then 0.80 when 'boosted' then 0.85 else 0.75 end::double interpretability,
  min(delta_auroc + delta_brier) over () / (delta_auroc + delta_brier + 1e-6) stability from b)
select model, best_variant, """ + ", ".join(d(c) for c in (
    "auroc", "pr_auc", "brier", "ece", "discrimination", "calibration", "interpretability", "stability")) + f""",
  {d("0.35 * discrimination + 0.35 * calibration + 0.15 * interpretability + 0.15 * stability", "composite")} from s""")
def _(spark, sf):
    return models.model_scorecard(models.evaluation_catalog(catalog_rows(spark, sf)))


@query("select_model", f"""
select model selected_model, {d("auroc + ap", "selection_score")} from cat_metrics
where split = 'validation' and variant = 'uncalibrated' order by auroc + ap desc, model desc limit 1""")
def _(spark, sf):
    rows = catalog_rows(spark, sf).where("split = 'validation' and variant = 'uncalibrated'")
    return models.select_model(curves.ranking_metrics(rows, "y", "p", ["model"]), "model", "auroc", "average_precision")


@query("platt_apply", f"select patientunitstayid, {d('1.0 / (1.0 + exp(-(3.25 * p - 2.5)))', 'p_calibrated')} from fx_scored")
def _(spark, sf):
    return scored(spark, sf).select("patientunitstayid", models.Platt(3.25, -2.5).apply(F.col("p")).alias("p_calibrated"))
