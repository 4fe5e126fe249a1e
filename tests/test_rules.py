"""Itemsets against brute force, rules against published numbers."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from riskgrove.operators import rules as R

# Published supports of four items and their combinations (30,000 rows).
SUPPORTS = {
    ("AI_Moderate",): 0.3347333333333333,
    ("Growth_Inc",): 0.5045333333333333,
    ("Remote_High",): 0.24506666666666665,
    ("Risk_High",): 0.40023333333333333,
    ("AI_Moderate", "Growth_Inc"): 0.17053333333333334,
    ("AI_Moderate", "Remote_High"): 0.08143333333333333,
    ("AI_Moderate", "Risk_High"): 0.13546666666666668,
    ("Growth_Inc", "Remote_High"): 0.12263333333333333,
    ("Growth_Inc", "Risk_High"): 0.2018,
    ("Remote_High", "Risk_High"): 0.09993333333333333,
    ("AI_Moderate", "Growth_Inc", "Risk_High"): 0.06903333333333334,
    ("Growth_Inc", "Remote_High", "Risk_High"): 0.05043333333333333,
}

# Published rules with Risk_High over those items:
# lift, confidence, leverage, conviction, zhang, jaccard, certainty, kulczynski.
PUBLISHED = {
    ("Growth_Inc, Remote_High", "Risk_High"): (1.0275332503443844, 0.4112530578961674, 0.0013513855555555565, 1.0187172514619882, 0.030540804209596664, 0.10675227545332673, 0.018373352797478017, 0.26863144274836687),
    ("Growth_Inc, Risk_High", "AI_Moderate"): (1.0219713476935028, 0.3420878757846052, 0.001484146666666672, 1.0111786090886266, 0.026934334749565175, 0.14766488413547238, 0.011055029238308256, 0.27416084687457704),
    ("Remote_High", "Risk_High"): (1.0188561569044825, 0.40778019586507075, 0.001849484444444452, 1.0127433471137652, 0.024514989269898386, 0.18324063321312878, 0.012582997607520846, 0.3287339390252313),
    ("AI_Moderate, Growth_Inc", "Risk_High"): (1.0114311087622654, 0.4048084440969507, 0.0007802088888888836, 1.0076867870826491, 0.013625520823186368, 0.1375896890778634, 0.007628151109238123, 0.2886455812556045),
    ("AI_Moderate", "Risk_High"): (1.0111608034793886, 0.4047002589125673, 0.0014952288888888943, 1.0075036578565852, 0.016591263898280934, 0.22596608284681685, 0.00744777232129264, 0.3715847425986173),
    ("Risk_High", "AI_Moderate"): (1.0111608034793884, 0.3384692262846673, 0.0014952288888888943, 1.0056473456712411, 0.018403181508469455, 0.22596608284681685, 0.0056156322547359075, 0.3715847425986173),
    ("AI_Moderate, Risk_High", "Growth_Inc"): (1.0100352603585756, 0.5095964566929133, 0.0006858844444444512, 1.0103244020739253, 0.011492390286709647, 0.12090606573647032, 0.010218898061585107, 0.3232112833147442),
    ("Remote_High, Risk_High", "Growth_Inc"): (1.0002704410410324, 0.5046697798532355, 1.3635555555557843e-05, 1.000275465768799, 0.0003003865518664442, 0.09102942061247819, 0.00027538990830635587, 0.30231506963063465),
    ("Risk_High", "Growth_Inc"): (0.9993509776097842, 0.5042058799033897, -0.00013105777777774885, 0.9993395374881014, -0.001081656342028975, 0.28706908815022053, -0.0006608990109194529, 0.4520897264210395),
    ("Growth_Inc", "Risk_High"): (0.9993509776097842, 0.3999735729386893, -0.00013105777777774885, 0.9995670850767087, -0.0013090562471563495, 0.28706908815022053, -0.0004331024197922038, 0.4520897264210395),
}
NAMES = ["lift", "confidence", "leverage", "conviction", "zhangs_metric", "jaccard", "certainty", "kulczynski"]


@pytest.fixture(scope="module")
def published(spark):
    return spark.createDataFrame(
        [(list(items), s) for items, s in SUPPORTS.items()], "items array<string>, support double"
    )


def test_rules_equal_the_published_ones(published):
    found = R.involving(R.association_rules(published, 0.3)).collect()
    got = {(r["antecedents_str"], r["consequents_str"]): r for r in found}
    assert set(got) == set(PUBLISHED)
    for key, numbers in PUBLISHED.items():
        assert [got[key][n] for n in NAMES] == pytest.approx(numbers, abs=1e-12)
        assert got[key]["representativity"] == 1.0


def test_rules_come_by_lift(published):
    first = R.by_lift(R.involving(R.association_rules(published, 0.3)), 3).collect()
    assert [(r["antecedents_str"], r["consequents_str"]) for r in first] == list(PUBLISHED)[:3]


def test_rules_may_have_several_consequents(published):
    found = R.association_rules(published, 0.0).collect()
    assert any(len(r["consequents"]) == 2 for r in found)
    assert all(not set(r["antecedents"]) & set(r["consequents"]) for r in found)


def test_predictive_rules_have_no_risk_item_before(published):
    found = R.predictive(R.association_rules(published, 0.0)).collect()
    assert found
    for r in found:
        assert "Risk_High" in r["consequents"]
        assert not any("Risk" in i for i in r["antecedents"])


def test_certain_rule_has_infinite_conviction(spark):
    sets = spark.createDataFrame([(["a"], 0.4), (["b"], 0.8), (["a", "b"], 0.4)], "items array<string>, support double")
    got = {r["antecedents_str"]: r["conviction"] for r in R.association_rules(sets, 0.1).collect()}
    assert got["a"] == float("inf")


def brute_force(baskets, min_support, max_length):
    counts = Counter()
    for basket in baskets:
        for k in range(1, max_length + 1):
            counts.update(combinations(sorted(set(basket)), k))
    return {i: c for i, c in counts.items() if c / len(baskets) >= min_support}


@pytest.mark.parametrize("min_support,max_length", [(0.05, 4), (0.2, 3), (0.3, 1), (0.9, 4)])
def test_itemsets_equal_brute_force(spark, min_support, max_length):
    rng = np.random.default_rng(3)
    baskets = [sorted({f"i{v}" for v in rng.integers(0, 9, rng.integers(1, 7))}) for _ in range(300)]
    baskets += [["i1", "i2", "i3"]] * 150
    rows = spark.createDataFrame([(b,) for b in baskets], "items array<string>")
    got = {tuple(r["items"]): r["n"] for r in R.frequent_itemsets(rows, min_support, max_length).collect()}
    assert got == brute_force(baskets, min_support, max_length)


def test_support_on_the_threshold_is_kept(spark):
    rows = spark.createDataFrame([(["a", "b"],)] + [(["b"],)] * 19, "items array<string>")
    got = {tuple(r["items"]) for r in R.frequent_itemsets(rows, 0.05).collect()}
    assert got == {("a",), ("b",), ("a", "b")}


def test_no_itemsets(spark):
    rows = spark.createDataFrame([([f"i{i}"],) for i in range(50)], "items array<string>")
    assert R.frequent_itemsets(rows, 0.5).count() == 0
    assert R.association_rules(R.frequent_itemsets(rows, 0.5)).count() == 0
