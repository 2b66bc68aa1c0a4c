"""Feature table, churn model, evaluation, reporting views, rule scores."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog import inputs
from catalog.forest_sql import forest_sql, prepared_features_sql
from catalog.registry import register
from catalog.sql_views import cents, money
from lossledger.operators import evaluate, forest, model, recommend, rollups, scoring
from lossledger.operators.features import CATEGORICAL, LABEL, NUMERIC, account_features
from lossledger.operators.taxonomy import classify
from lossledger.plans import views
from lossledger.session import stage
from lossledger.sources import star_schema as star

FEATURE_COLUMNS = ", ".join(["account_id", *CATEGORICAL, *NUMERIC, LABEL])


def feature_table(spark, path):
    return account_features(star.star_tables(spark, path))


# ---- feature table and model ------------------------------------------------------------------


@register("m01_account_features", f"""
    select {FEATURE_COLUMNS}, cast(signup_date as varchar) as signup_date from features""")
def features(spark, path):
    return feature_table(spark, path)


@register("m02_feature_columns", f"select {FEATURE_COLUMNS.replace('account_id, ', '')} from features")
def feature_columns(spark, path):
    return feature_table(spark, path).select(*CATEGORICAL, *NUMERIC, LABEL)


def _held_out_sql(label: str) -> str:
    """The rounded quarter of each class with the smallest hashes."""
    number = f"cast('0x' || left(md5('42:' || {label} || ':' || account_id), 8) as bigint)"
    return (f"row_number() over (partition by {label} order by {number}, account_id) "
            f"<= round(0.25 * count(*) over (partition by {label}))")


@register("m03_stratified_holdout", f"""
    select account_id, churned as is_churned, {_held_out_sql('churned')} as is_holdout from account_usage""")
def stratified_holdout(spark, path):
    flagged = inputs.labelled(spark, path).select("account_id", F.col("churned").alias(LABEL))
    return model.with_holdout(flagged, "account_id", LABEL)


@register("m04_one_hot", """
    with n as (select plan_type, row_number() over (order by count(*) desc, plan_type) - 1 as i, count(*) over () as many
               from accounts group by plan_type)
    select account_id, plan_type, array_to_string(list_transform(range(many), lambda b: (b = i)::integer), '') as bits
    from accounts join n using (plan_type)""")
def one_hot(spark, path):
    """One bit per category, as many as the fitted indexer found."""
    table = star.accounts(spark, path).select("account_id", "plan_type")
    indexer, fill, encoder = model.preprocessing(["plan_type"], [])[:3]
    fitted = Pipeline(stages=[indexer, fill, encoder]).fit(table)
    bits = F.transform(vector_to_array(F.col("plan_type_onehot")), lambda b: b.cast("int").cast("string"))
    return fitted.transform(table).select("account_id", "plan_type", F.array_join(bits, "").alias("bits"))


@register("m05_median_impute", """
    with u as (select account_id, avg_projects_created, avg_weekly_active_users
               from accounts left join usage_means using (account_id))
    select account_id, avg_projects_created, avg_weekly_active_users,
           coalesce(avg_projects_created, (select quantile_cont(avg_projects_created, 0.5) from u))
             as avg_projects_created_imputed,
           coalesce(avg_weekly_active_users, (select quantile_cont(avg_weekly_active_users, 0.5) from u))
             as avg_weekly_active_users_imputed
    from u""")
def median_impute(spark, path):
    """Usage measures left null where an account has none, then filled with the median."""
    table = account_features(star.star_tables(spark, path), fill=None)
    shown = ["avg_projects_created", "avg_weekly_active_users"]
    stages = model.preprocessing([], shown)
    fitted = Pipeline(stages=[s for s in stages if type(s).__name__ in ("SQLTransformer", "MedianImputer")]).fit(table)
    return fitted.transform(table).select("account_id", *shown, *(f"{c}_imputed" for c in shown))


@register("m07_class_weights", """
    select is_churned, count(*) as accounts, any_value(n / (2.0::double * of_class)) as class_weight
    from (select churned as is_churned, count(*) over () as n, count(*) over (partition by churned) as of_class
          from account_usage) group by is_churned""")
def class_weights(spark, path):
    flagged = inputs.labelled(spark, path).select("account_id", F.col("churned").alias(LABEL))
    weighted = model.with_class_weight(flagged)
    return weighted.groupBy(LABEL, "class_weight").agg(F.count(F.lit(1)).alias("accounts"))


@register("m08_prepared_features", f"""
    with {prepared_features_sql('true')}
    select account_id, unnest(x) as value, (generate_subscripts(x, 1) - 1)::integer as feature from prepared""")
def prepared_features(spark, path):
    """The preprocessing of the model alone: one vector per account, as long as the fitted stages make it."""
    table = stage(feature_table(spark, path))
    fitted = Pipeline(stages=model.preprocessing()).fit(table)
    return fitted.transform(table).select("account_id", F.posexplode(vector_to_array(F.col("features"))).alias("feature", "value"))


_LEARNED = f"account_id not in (select account_id from features qualify {_held_out_sql(LABEL)})"


@register("m09_holdout_scores", f"""
    with {forest_sql(_LEARNED)}
    select account_id, {LABEL}, churn_probability from scored join prepared using (account_id) where not learn""")
def holdout_scores(spark, path):
    """Scores of the accounts the forest was not fitted on."""
    return forest.train(stage(feature_table(spark, path))).holdout.select("account_id", LABEL, "churn_probability")


@register("m06_forest_scores", f"""
    with {forest_sql('true')}
    select account_id, {LABEL}, churn_probability from scored join prepared using (account_id)""")
def forest_scores(spark, path):
    """A forest of balanced bootstraps on all accounts, scored on the same accounts."""
    table = stage(feature_table(spark, path))
    return forest.score(forest.fit(table), table).select("account_id", LABEL, "churn_probability")


@register("m07_bootstrap_weights", f"""
    with {forest_sql('true', depth=0)}
    select tree, zeros, ones, copies_rows as "rows", case when zeros > 0 then (zeros + ones) / (2.0::double * zeros) end as weight_of_zeros,
           case when ones > 0 then (zeros + ones) / (2.0::double * ones) end as weight_of_ones
    from (select tree::integer as tree, all_zeros as zeros, all_ones as ones from totals)
    join (select tree::integer as tree, count(*) as copies_rows from at_0 where copies > 0 group by tree) using (tree)""")
def bootstrap_weights(spark, path):
    """Per tree: copies of each class, rows, and the weights that give both classes half of the tree."""
    vectors = forest.vectors(Pipeline(stages=model.preprocessing()).fit(table := stage(feature_table(spark, path))), table)
    totals = forest.tree_totals(forest.bag(vectors))
    share = lambda c: (F.col("all_zeros") + F.col("all_ones")) / (2.0 * F.nullif(F.col(c), F.lit(0)))
    return totals.select("tree", F.col("all_zeros").alias("zeros"), F.col("all_ones").alias("ones"), F.col("all_rows").alias("rows"),
                         share("all_zeros").alias("weight_of_zeros"), share("all_ones").alias("weight_of_ones"))


@register("m06_forest_nodes", f"""
    with {forest_sql('true')}
    select tree::integer as tree, node::integer as node, zeros::bigint as zeros, ones::bigint as ones, p as probability
    from valued join leaves using (tree, node)""")
def forest_nodes(spark, path):
    """The leaves of the forest's table of nodes: copies of each class that came there."""
    fitted = forest.fit(stage(feature_table(spark, path)))
    return fitted.nodes.where("feature IS NULL AND zeros + ones > 0").select("tree", "node", "zeros", "ones", "probability")


@register("m10_precision_recall_curve", """
    select score, positives, negatives, tp, fp, "precision", recall, f1 from curve""")
def precision_recall_curve(spark, path):
    return inputs.curve(spark, path)


@register("m10_curve_of_deal_values", """
    with s as (select deal_value as score, count(*) filter (deal_status = 'lost') as positives,
                      count(*) filter (deal_status <> 'lost') as negatives from deals group by 1)
    select score, positives, negatives, cast(sum(positives) over (order by score desc) as bigint) as tp,
           cast(sum(negatives) over (order by score desc) as bigint) as fp from s""")
def curve_of_deal_values(spark, path):
    """A near-continuous score: almost every row is a step of its own."""
    lost = (F.col("deal_status") == "lost").cast("int")
    scored = star.deals(spark, path).select(lost.alias("lost"), "deal_value")
    return evaluate.pr_curve(scored, "lost", "deal_value").select("score", "positives", "negatives", "tp", "fp")


@register("m11_best_threshold", "select optimal_threshold, f1 from metrics")
def best_threshold(spark, path):
    return inputs.metrics(spark, path).select("optimal_threshold", "f1")


@register("m12_roc_auc", "select roc_auc from metrics")
def roc_auc(spark, path):
    return inputs.metrics(spark, path).select("roc_auc")


@register("m12_roc_auc_by_pairs", """
    with s as (select discount_pct as score, count(*) filter (deal_status = 'lost') as p,
                      count(*) filter (deal_status <> 'lost') as n from deals group by 1)
    select (select sum(case when a.score > b.score then a.p * b.n when a.score = b.score then a.p * b.n / 2 else 0 end)
            from s a, s b)::double / ((select sum(p) from s)::double * (select sum(n) from s)::double) as roc_auc""")
def roc_auc_by_pairs(spark, path):
    """Discount as a score for losing; the check compares every pair of scores."""
    lost = (F.col("deal_status") == "lost").cast("int")
    scored = star.deals(spark, path).select(lost.alias("lost"), "discount_pct")
    return evaluate.ranking_metrics(evaluate.pr_curve(scored, "lost", "discount_pct")).select("roc_auc")


@register("m13_average_precision", "select pr_auc from metrics")
def average_precision(spark, path):
    return inputs.metrics(spark, path).select("pr_auc")


@register("m14_quality_at_best_threshold", "select accuracy, recall, f1, positive_rate from metrics")
def quality_at_best_threshold(spark, path):
    return inputs.metrics(spark, path).select("accuracy", "recall", "f1", "positive_rate")


@register("m14_confusion", """
    select tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn)::double as accuracy, tp / (tp + fn)::double as recall,
           2.0::double * tp / (tp + fp + tp + fn) as f1
    from (select count(*) filter (churned = 1 and churn_probability >= 0.2::double) as tp,
                 count(*) filter (churned = 0 and churn_probability >= 0.2::double) as fp,
                 count(*) filter (churned = 1 and churn_probability < 0.2::double) as fn,
                 count(*) filter (churned = 0 and churn_probability < 0.2::double) as tn from churn_scores)""")
def confusion(spark, path):
    return evaluate.confusion_at(inputs.labelled(spark, path), "churned", "churn_probability", 0.2)


@register("m15_score_table", "select * from risk")
def score_table(spark, path):
    return inputs.risk(spark, path, ordered=True)


@register("m16_train_and_score", f"""
    with {forest_sql(_LEARNED)}
    select account_id, f.monthly_revenue, plan_type, region, industry, churn_probability,
           case when churn_probability <= 0.25 then 'Low' when churn_probability <= 0.5 then 'Medium'
                when churn_probability <= 0.75 then 'High' else 'Critical' end as risk_tier,
           {cents('f.monthly_revenue * churn_probability')} as estimated_monthly_revenue_at_risk
    from scored join prepared f using (account_id)""")
def train_and_score(spark, path):
    """The full forest, fitted on three quarters, and the scores of every account with tier and revenue at risk."""
    table = stage(feature_table(spark, path))
    trained = forest.train(table)
    scored = forest.score(trained.model, table).select(*scoring.SCORE_INPUTS, "churn_probability")
    return scoring.score_table(stage(scored))


# ---- recommendations, views, extracts ---------------------------------------------------------


@register("v01_recommendations", "select * from recommendations")
def recommendations(spark, path):
    return recommend.recommend(inputs.summary(spark, path))


@register("v02_at_risk_view", """
    select account_id, plan_type, region, industry, churn_probability, risk_tier, monthly_revenue,
           estimated_monthly_revenue_at_risk
    from risk where churn_probability >= 0.15::double and plan_type in ('pro', 'team') and region in ('ASIA', 'EUROPE')
    order by estimated_monthly_revenue_at_risk desc, churn_probability desc, account_id limit 50""")
def at_risk_view(spark, path):
    return views.top_at_risk(inputs.risk(spark, path), 0.15, ["pro", "team"], ["ASIA", "EUROPE"])


@register("v03_segment_view", """
    select plan_type || ' | ' || region || ' | ' || industry as segment, churn_revenue_lost, lost_deal_value,
           total_revenue_loss, churn_events, lost_deal_events from segments
    order by total_revenue_loss desc, plan_type, region, industry limit 25""")
def segment_view(spark, path):
    return views.top_segments(inputs.segments(spark, path)).drop(*rollups.SEGMENT)


@register("v04_cancellation_evidence", """
    select account_id, cast(cancellation_date as varchar) as cancellation_date, churned_revenue, category, subcategory,
           cancellation_reason_text from cancellations_classified""")
def cancellation_evidence(spark, path):
    return views.evidence_from_text(star.cancellations(spark, path), "cancellations")


@register("v04_ticket_evidence", """
    select account_id, cast(created_date as varchar) as created_date, ticket_type, priority, resolution_hours,
           category, subcategory, ticket_summary from tickets_classified""")
def ticket_evidence(spark, path):
    return views.evidence_from_text(star.support_tickets(spark, path), "support_tickets")


@register("v04_note_evidence", """
    select n.deal_id, o_custkey as account_id, cast(note_date as varchar) as note_date, category, subcategory,
           note_text from notes_classified n join orders on n.deal_id = o_orderkey""")
def note_evidence(spark, path):
    """Sorted before the texts are built: a global sort reads its input twice."""
    ordered = views.newest_first(star.with_account(spark, path, star.notes_without_text(spark, path)), "sales_notes")
    return classify(star.with_note_text(ordered), "note_text").select(*views.EVIDENCE["sales_notes"][2])


@register("v05_quality_row", "select case when roc_auc <= 1 then roc_auc else 0.0::double end as roc_auc, pr_auc, accuracy, recall, f1 from metrics")
def quality_row(spark, path):
    return views.quality_row(inputs.metrics(spark, path))


@register("v06_risk_extract", "select *, 0.5::double as risk_threshold_default from risk")
def risk_extract(spark, path):
    return views.risk_extract(inputs.risk(spark, path, ordered=True))


@register("v07_segment_extract", """
    select *, plan_type || ' | ' || region || ' | ' || industry as segment from segments""")
def segment_extract(spark, path):
    return views.segment_extract(inputs.segments(spark, path))


@register("v08_reconciliation", f"""
    select source, summary_total, trend_total, segment_total,
           greatest(abs(summary_total - trend_total), abs(trend_total - segment_total)) < 0.5 as agrees
    from (select source, {money('lost_revenue')} as summary_total from summary group by source)
    join (select 'churn' as source, {money('churn_revenue_lost')} as trend_total from trend
          union all select 'lost_deal', {money('lost_deal_value')} from trend) using (source)
    join (select 'churn' as source, {money('churn_revenue_lost')} as segment_total from segments
          union all select 'lost_deal', {money('lost_deal_value')} from segments) using (source)""")
def reconciliation(spark, path):
    """One stored ledger feeds all three rollups."""
    losses = stage(inputs.ledger(spark, path))
    return rollups.reconcile(rollups.loss_summary(losses, ordered=False), rollups.loss_trend(losses, ordered=False),
                             rollups.segment_loss(losses, star.accounts(spark, path), ordered=False))


# ---- rule scores ------------------------------------------------------------------------------


@register("r01_churn_propensity", "select account_id, plan_type, monthly_revenue, churn_probability from churn_scores")
def churn_propensity(spark, path):
    return inputs.propensity(spark, path).select("account_id", "plan_type", "monthly_revenue", "churn_probability")


@register("r02_win_propensity", "select deal_id, company_size, win_probability, expected_value from win_scores")
def win_propensity(spark, path):
    scored = scoring.rule_win_propensity(star.deals(spark, path), star.accounts(spark, path))
    return scored.select("deal_id", "company_size", "win_probability", "expected_value")
