import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog.shape_queries import rule_hits
from lossledger.operators.taxonomy import RULES, Rule, _Finder, _parts, classify, classify_indexed, keyword_index, rules_table
from lossledger.session import dealt_out
from lossledger.sources import star_schema as star
from tests.conftest import planned, rows

# sentence, subcategory, matched terms, confidence
TRUTH = [
    ("They want a wider variety and a template for each shop; canva has one.", "missing_templates", "template, variety", 0.7),
    ("Figma is what the designers open first.", "competitor_switch", "figma", 0.6),
    ("Which feature is in which plan?", "missing_features", "feature", 0.6),
    ("The pricing page lost them.", "pricing_concerns", "pricing", 0.6),
    ("Day one, onboarding call, nobody came.", "onboarding_confusion", "onboarding", 0.6),
    ("One template from the library would have done.", "missing_templates", "library, template", 0.7),
    ("All is well here.", "unclear_signal", "", 0.25),
    ("Onboarding is fine and time to value is short.", "onboarding_confusion", "onboarding, time to value", 0.7),
    ("More stakeholders join on Monday.", "low_team_adoption", "stakeholders", 0.6),
    ("No export on Sundays.", "export_limitations", "export", 0.6),
    ("Two imports failed.", "performance_reliability", "failed, imports", 0.7),
    ("At renewal the pricing was a surprise.", "pricing_concerns", "pricing, renewal", 0.7),
    ("Ten templates are too few.", "missing_templates", "template, templates", 0.7),
    ("Advanced controls, please.", "missing_features", "advanced, controls", 0.7),
    ("A lag in the preview before each export.", "export_limitations", "export, preview", 0.7),
    ("A competitor sells the same template.", "missing_templates", "template", 0.6),
    ("We see weak adoption.", "onboarding_confusion", "adoption", 0.6),
    ("Usage is low.", "unclear_signal", "", 0.25),
    ("They did not create a thing, which cannot justify the subscription.", "low_usage",
     "did not create, justify the subscription", 0.7),
    ("Out of familiarity, for the existing workflows; adobe express was near.", "competitor_advantage",
     "existing workflows, familiarity", 0.7),
    ("PRICING PRICE BUDGET COST INVOICE", "pricing_concerns", "budget, cost, invoice, price, pricing", 0.95),
    ("pricing price budget cost invoice billing discount renewal", "pricing_concerns",
     "billing, budget, cost, discount, invoice, price, pricing, renewal", 0.95),
    ("", "unclear_signal", "", 0.1),
    ("   ", "unclear_signal", "", 0.1),
    ("\t\n 　\x1c\x1f\x85", "unclear_signal", "", 0.1),
    ("​", "unclear_signal", "", 0.25),  # zero width, but not white space
    (None, "unclear_signal", "", 0.1),
]


def by_index(df, column, rules=RULES, **options):
    return classify_indexed(df, column, rules_table(df.sparkSession, rules), **options)


def shuffled(df, column, rules=RULES):
    return by_index(df, column, rules, index_bytes=0)


@pytest.mark.parametrize("method", [classify, by_index, shuffled])
def test_truth_table(spark, method):
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TRUTH)], "i int, text string")
    got = rows(method(df, "text").orderBy("i").select("subcategory", "matched_terms", "confidence"))
    assert got == [t[1:] for t in TRUTH]


def test_category_belongs_to_subcategory(spark):
    category = {r.subcategory: r.category for r in RULES} | {"unclear_signal": "Uncategorized"}
    df = spark.createDataFrame([(t[0],) for t in TRUTH], "text string")
    for c, s in rows(classify(df, "text").select("category", "subcategory")):
        assert c == category[s]


def test_input_columns_are_kept(spark):
    df = spark.createDataFrame([("x", 1)], "text string, keep int")
    assert classify(df, "text").columns == ["text", "keep", "category", "subcategory", "matched_terms", "confidence"]


def test_own_rules_and_quotes(spark):
    rules = [Rule("A", "a", ("it's", "back\\slash", "100%")), Rule("B", "b", ("_",))]
    df = spark.createDataFrame([("IT'S 100%",), ("back\\slash _",), ("_",)], "text string")
    for method in (classify, by_index, shuffled):
        got = rows(method(df, "text", rules).orderBy(F.desc("text")).select("subcategory", "matched_terms"))
        assert got == [("a", "back\\slash"), ("b", "_"), ("a", "100%, it's")]


def test_single_rule(spark):
    df = spark.createDataFrame([("yes",), ("no",)], "text string")
    got = rows(classify(df, "text", [Rule("A", "a", ("yes",))]).select("subcategory", "confidence"))
    assert got == [("a", 0.6), ("unclear_signal", 0.25)]


def test_five_thousand_rules_agree_with_a_plain_count(spark):
    rng = random.Random(2)
    part = lambda: "".join(rng.choice("abcdé\U00010000 ") for _ in range(rng.randint(1, 6)))
    rules = list(RULES) + [Rule("C", f"s{i}", tuple({f"{part()}{i % 50}", part(), f"keyword{i:04d}"})) for i in range(5000)]
    texts = [" ".join([part() + str(rng.randint(0, 60)), rng.choice(TRUTH)[0] or "", f"keyword{rng.randint(0, 9999):04d}"]) for _ in range(40)]
    texts += [t[0] for t in TRUTH] + ["ab", "a", "\U00010000"]

    def plain(text):
        low = (text or "").lower()
        hits = [sorted({k.lower() for k in r.keywords if k and k.lower() in low}) for r in rules]
        best = max(range(len(rules)), key=lambda i: (len(hits[i]), -i))
        return (rules[best].subcategory, ", ".join(hits[best])) if hits[best] else ("unclear_signal", "")

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for method in (by_index, shuffled):
        got = rows(method(df, "text", rules).orderBy("i").select("subcategory", "matched_terms"))
        assert got == [plain(t) for t in texts]


def test_index_on_shared_rules_equals_the_inline_plan(spark):
    words = [k for r in RULES for k in r.keywords]
    df = spark.range(300).select("id", F.concat_ws(" x ", *(F.element_at(F.array(*map(F.lit, words)), (F.pmod(
        F.xxhash64("id", F.lit(j)), F.lit(len(words))) + 1).cast("int")) for j in range(4))).alias("text"), F.lit(1).alias("_text"))
    assert sorted(rows(by_index(df, "text"))) == sorted(rows(classify(df.drop("_text"), "text").withColumn("_text", F.lit(1)).select(
        "id", "text", "_text", "category", "subcategory", "matched_terms", "confidence")))


def test_index_leaves_out_nothing_and_repeats_nothing(spark):
    rules = spark.createDataFrame([(0, "A", "a", "abc"), (0, "A", "a", "abc"), (0, "A", "a", None), (1, "B", "b", ""), (1, "B", "b", "Xy"),
                                   (2, "C", "c", "abcd")], "rule bigint, category string, subcategory string, keyword string")
    index = {(r["rule"], r["keyword"]): r["gram"] for r in keyword_index(rules).collect()}
    assert index == {(0, "abc"): "abc", (1, "xy"): "xy", (2, "abcd"): "bcd"}
    df = spark.createDataFrame([("abcd xy",), ("",), (None,)], "text string")
    got = rows(classify_indexed(df, "text", rules).select("subcategory", "matched_terms", "confidence"))
    assert got == [("a", "abc", 0.6), ("unclear_signal", "", 0.1), ("unclear_signal", "", 0.1)]
    assert rows(classify_indexed(df.limit(0), "text", rules)) == []


def test_no_python_and_no_shuffle(spark):
    df = spark.range(10).select(F.concat(F.lit("pricing "), F.col("id")).alias("text"))
    plan = planned(classify(df, "text"))
    assert "Exchange" not in plan and "Python" not in plan and "ArrowEval" not in plan


def test_filter_on_outcome_stays_above_the_counting(spark):
    df = spark.range(10).select(F.concat(F.lit("pricing "), F.col("id")).alias("text"))
    plan = planned(classify(df, "text").where("category = 'Product' and confidence > 0.5"))
    assert plan.count("Contains(_text") <= 2 * sum(len(r.keywords) for r in RULES)


@pytest.mark.parametrize("method", [classify, by_index])
def test_without_rules_nothing_is_categorized(spark, method):
    df = spark.createDataFrame([("pricing",), ("",), (None,)], "text string")
    got = rows(method(df, "text", ()).select("category", "subcategory", "matched_terms", "confidence"))
    assert got == [("Uncategorized", "unclear_signal", "", c) for c in (0.25, 0.1, 0.1)]


def test_finder_agrees_with_plain_containment():
    rng = random.Random(5)
    part = lambda n: "".join(rng.choice("abé\U00010000 ") for _ in range(n))
    keywords = sorted({part(rng.randint(1, 9)) for _ in range(300)})
    grams = [k if len(k) < 3 else k[(at := rng.randint(0, len(k) - 3)) : at + 3] for k in keywords]
    finder = _Finder(grams, keywords)
    texts = [part(rng.randint(0, 60)) for _ in range(200)] + ["", "a", "\U00010000"]
    data = [t.encode() for t in texts]
    found = finder.find(np.cumsum([0, *map(len, data)]), np.frombuffer(b"".join(data), np.uint8))
    got = [(int(t), finder.words[w].decode()) for t, w in zip(*found)]
    assert got == sorted(set(got)) and set(got) == {(i, k) for i, t in enumerate(texts) for k in keywords if k in t}


def test_parts_cover_all_items_in_order():
    upto = np.cumsum([3, 0, 9, 1, 1, 0, 4])
    assert list(_parts(upto, 4)) == [(0, 2), (2, 3), (3, 6), (6, 7)] and list(_parts(upto[:0], 4)) == []


def test_a_small_index_moves_no_text(spark):
    df = spark.range(10).select(F.concat(F.lit("pricing "), F.col("id")).alias("text"))
    assert "Exchange" not in planned(by_index(df, "text")) and "Exchange" in planned(shuffled(df, "text"))
    assert rows(by_index(df, "text").where("category = 'Product'")) == []


def test_the_text_is_made_once_before_the_counting(spark):
    df = spark.range(10).select(F.concat(F.lit("pricing "), F.col("id")).alias("text"))
    plan = planned(classify(df, "text"))
    assert plan.count("Generate explode") == 2 and plan.count("lower(") == 1


def test_rule_hits_of_one_row_group_are_found_by_many_tasks(spark, tmp_path):
    lines = spark.range(400).select(
        F.when(F.col("id") % 9 > 0, F.col("id") % 150).alias("l_orderkey"), (F.col("id") % 7).cast("int").alias("l_linenumber"),
        F.lit("1995-01-02").cast("timestamp").alias("l_shipdate"))
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = rule_hits(spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" in planned(found).split("ArrowEvalPython")[-1]
    wanted = classify(star.sales_notes(spark, str(tmp_path)), "note_text").groupBy("category", "subcategory").agg(F.count(F.lit(1)))
    assert sorted(rows(found)) == sorted(rows(wanted)) and sum(r[2] for r in rows(found)) == 400


def test_rows_without_or_with_one_key_are_dealt_out_evenly(spark):
    df = spark.range(4000).coalesce(1).select(F.lit(None).cast("bigint").alias("key"), F.lit(1).alias("_place"))
    sizes = dealt_out(df).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 1200 and dealt_out(df).columns == ["key", "_place"]
