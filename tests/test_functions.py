"""Edge rows of bins, lookups, rounding, encoders and profiling."""

import math

import pytest
from pyspark.sql import functions as F

from riskgrove.functions import columns as C
from riskgrove.functions.binning import cut, qcut
from riskgrove.functions.tails import chi2_tail
from riskgrove.operators import crosstab, distributions, encode, profile, select
from riskgrove.sources import schema as S

INF, NAN = float("inf"), float("nan")


def values(frame, column="x"):
    return [r[column] for r in frame.collect()]


def test_cut_is_left_open_right_closed(spark):
    rows = spark.createDataFrame([(v,) for v in [-1.0, 0.0, 25.0, 25.1, 100.0, 100.1, None, NAN]], "v double")
    got = values(rows.select(cut("v", S.REMOTE_EDGES, S.REMOTE_LEVELS).alias("x")))
    assert got == [None, "Low", "Low", "Medium", "VeryHigh", None, None, None]


def test_open_ends_take_plus_but_not_minus_infinity(spark):
    rows = spark.createDataFrame([(v,) for v in [-INF, -5.0, -0.3, 0.0, 1.0, INF]], "v double")
    got = values(rows.select(cut("v", S.GROWTH_EDGES, S.GROWTH_LEVELS).alias("x")))
    assert got == [None, "SevereDecline", "SevereDecline", "ModerateDecline", "ModerateGrowth", "HighGrowth"]


def test_cut_needs_one_label_per_bin():
    with pytest.raises(ValueError):
        cut(None, [0, 1, 2], ["a"])


def test_qcut_closes_the_lowest_edge(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(9)], "v double")
    got = qcut(rows, "v", 3, [0, 1, 2], "x").orderBy("v")
    assert values(got) == [0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_qcut_refuses_equal_edges(spark):
    rows = spark.createDataFrame([(1.0,)] * 5, "v double")
    with pytest.raises(ValueError):
        qcut(rows, "v", 3, [0, 1, 2], "x")


def test_growth_rate_with_zero_openings(spark):
    rows = spark.createDataFrame([(0, 5), (0, 0), (0, -5), (4, 6)], "openings_now int, openings_future int")
    assert values(rows.select(C.growth_rate().alias("x"))) == [INF, None, -INF, 0.5]


def test_lookup_of_unknown_and_null(spark):
    rows = spark.createDataFrame([("Low",), ("other",), (None,)], "v string")
    assert values(rows.select(C.ordinal("v", S.IMPACT_ORDER).alias("x"))) == [0, None, None]


def test_education_spelling(spark):
    rows = spark.createDataFrame([("Bachelor’s Degree",), ("Bachelor's Degree",), ("PhD",)], "v string")
    assert values(rows.select(C.education_code("v").alias("x"))) == [2, 2, 4]
    assert values(rows.select(C.education_code("v", "strict").alias("x"))) == [None, 2, 4]


def test_chi_square_tail():
    # Closed forms: exp(-x/2) for two degrees, erfc(sqrt(x/2)) for one.
    assert chi2_tail(3.0, 2) == pytest.approx(math.exp(-1.5), rel=1e-12)
    assert chi2_tail(3.0, 1) == pytest.approx(math.erfc(math.sqrt(1.5)), rel=1e-12)
    assert chi2_tail(11.070497693516351, 5) == pytest.approx(0.05, rel=1e-9)
    assert chi2_tail(0.0, 5) == 1.0


def test_missing_report_counts_nulls_and_nan(spark):
    rows = spark.createDataFrame([(1.0, "a"), (NAN, None), (None, "b")], "v double, t string")
    got = {r["column"]: (r["missing"], r["missing_pct"]) for r in profile.missing_report(rows).collect()}
    assert got == {"v": (2, 66.67), "t": (1, 33.33)}


def test_describe_skips_missing(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,), (NAN,)], "v double")
    r = profile.describe_numeric(rows, ["v"]).first()
    assert (r["count"], r["min"], r["q50"], r["max"]) == (3, 1.0, 2.0, 4.0)


def test_duplicates(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, None), (2, "a")], "v int, t string")
    r = profile.duplicates(rows).first()
    assert (r["duplicates"], r["duplicate_pct"]) == (2, 40.0)


def test_moments_of_tiny_input(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    r = rows.agg(profile.skewness(F.col("v")).alias("s"), profile.excess_kurtosis(F.col("v")).alias("k")).first()
    assert r["s"] is None and r["k"] is None


def test_histogram_keeps_empty_bins_and_last_edge(spark):
    rows = spark.createDataFrame([(0.0,), (0.0,), (10.0,)], "v double")
    got = distributions.histogram(rows, "v", 5).orderBy("bin").collect()
    assert [r["n"] for r in got] == [2, 0, 0, 0, 1]


def test_histogram_of_constant_column(spark):
    rows = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert sum(r["n"] for r in distributions.histogram(rows, "v", 4).collect()) == 2


def test_level_counts_keep_empty_levels(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,)], "v string")
    got = distributions.level_counts(rows, "v", ["a", "b"]).collect()
    assert [(r["level"], r["n"], r["pct"]) for r in got] == [("a", 2, 66.67), ("b", 0, 0.0)]


def test_reach_of_densities_equals_the_full_sum(spark):
    rows = spark.range(300).select((F.col("id") * F.col("id") % 97).cast("double").alias("v"), (F.col("id") % 2).alias("g"))
    near, full = (distributions.kde(rows, "v", 50, reach=r).orderBy("point").collect() for r in (9.0, None))
    assert [r["density"] for r in near] == pytest.approx([r["density"] for r in full], rel=1e-12, abs=1e-17)
    near, full = (
        distributions.kde_groups(rows, ["v"], "g", 40, reach=r).orderBy("g", "point").collect() for r in (9.0, None)
    )
    assert [r["density"] for r in near] == pytest.approx([r["density"] for r in full], rel=1e-12, abs=1e-17)


def test_kde_integrates_to_one(spark):
    rows = spark.createDataFrame([(float(i % 17),) for i in range(400)], "v double")
    got = distributions.kde(rows, "v").orderBy("point").collect()
    step = got[1]["x"] - got[0]["x"]
    assert sum(r["density"] for r in got) * step == pytest.approx(1.0, abs=1e-3)


def test_box_whiskers_and_fliers(spark):
    rows = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100]], "v double")
    r = distributions.box_stats(rows, ["v"]).first()
    assert (r["q1"], r["median"], r["q3"]) == (2.25, 3.5, 4.75)
    assert (r["whisker_low"], r["whisker_high"], r["fliers"]) == (1.0, 5.0, 1)


def test_one_hot_drops_the_first_level(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "v string")
    got = encode.one_hot(rows, ["v"])
    assert got.columns == ["v_b", "v_c"]
    assert [tuple(r) for r in got.collect()] == [(1, 0), (0, 0), (0, 1), (0, 0)]


def test_target_encoding_of_unseen_level(spark):
    train = spark.createDataFrame([("a", 10.0)] * 30 + [("b", 0.0)] * 10, "t string, y double")
    encoding = encode.target_encoding(train, "t", "y")
    got = {r["t"]: r["encoded"] for r in encoding.collect()}
    weight = 1 / (1 + math.exp(-1.0))
    assert got["a"] == pytest.approx(7.5 * (1 - weight) + 10 * weight)
    rows = spark.createDataFrame([("a",), ("zzz",)], "t string")
    out = {r["t"]: r["x"] for r in encode.apply_target_encoding(rows, encoding, train, "t", "y", "x").collect()}
    assert out["zzz"] == pytest.approx(7.5)


def test_saved_encoding_and_scaler(spark, tmp_path):
    train = spark.createDataFrame([("a", 10.0, 5.0)] * 30 + [("b", 0.0, 5.0)] * 10, "t string, y double, c double")
    encode.fitted_encoding(train, "t", "y").write.parquet(str(tmp_path / "e"))
    encode.fitted_scaler(train, ["y", "c"]).write.parquet(str(tmp_path / "s"))
    rows = spark.createDataFrame([("a", 1.0, 5.0), ("zzz", 2.0, 6.0), (None, 3.0, 4.0)], "t string, y double, c double")
    saved = spark.read.parquet(str(tmp_path / "e"))
    got = {r["t"]: r["x"] for r in encode.apply_fitted_encoding(rows, saved, "t", "x").collect()}
    weight = 1 / (1 + math.exp(-1.0))
    assert got["a"] == pytest.approx(7.5 * (1 - weight) + 10 * weight)
    assert got["zzz"] == got[None] == pytest.approx(7.5)
    saved = spark.read.parquet(str(tmp_path / "s"))
    want = encode.standardise(rows, ["y", "c"], fit_on=train).orderBy("y").collect()
    assert encode.apply_fitted_scaler(rows, saved, ["y", "c"]).orderBy("y").collect() == want


def test_scaling_of_constant_columns(spark):
    rows = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "a double, b double")
    assert [tuple(r) for r in encode.standardise(rows, ["a", "b"]).collect()] == [(0.0, -1.0), (0.0, 1.0)]
    assert [tuple(r) for r in encode.min_max(rows, ["a", "b"]).collect()] == [(0.0, 0.0), (0.0, 1.0)]


def test_fill_missing_covers_flags_and_nan(spark):
    rows = spark.createDataFrame([(NAN, None, None), (1.5, True, 3)], "a double, b boolean, c int")
    got = [tuple(r) for r in encode.fill_missing(rows, ["a", "b", "c"]).collect()]
    assert got == [(0.0, 0, 0), (1.5, 1, 3)]


def test_compare_means_guards_a_zero_mean(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (9.0, 4.0)], "g double, v double")
    r = crosstab.compare_means(rows, ["v"], F.col("g") > 5, F.col("g") < 5).first()
    assert (r["high_mean"], r["low_mean"], r["diff_pct"]) == (4.0, 0.0, 0.0)


def test_competition_rank_shares_the_smallest(spark):
    rows = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", 0.9), ("d", 0.1)], "k string, m double")
    got = {r["k"]: r["rank"] for r in select.competition_rank(rows, "m").collect()}
    assert got == {"a": 3, "b": 1, "c": 1, "d": 4}


def test_raw_csv_with_wrong_field_fails(spark, tmp_path):
    from riskgrove.sources import files as IO

    names = ",".join(f'"{n}"' for n, _, _ in S.RAW_COLUMNS)
    good = "Clerk,IT,Increasing,Low,50000.5,PhD,3,10,20,40.0,55.5,UK,48.1"
    (tmp_path / "good.csv").write_text(f"{names}\n{good}\n")
    r = IO.read_raw(spark, str(tmp_path / "good.csv")).first()
    assert (r["job_title"], r["salary"], r["experience"]) == ("Clerk", 50000.5, 3)
    (tmp_path / "bad.csv").write_text(f"{names}\n{good.replace('50000.5', 'much')}\n")
    with pytest.raises(Exception):
        IO.read_raw(spark, str(tmp_path / "bad.csv")).collect()


def test_scratch_folder_on_a_cluster_must_be_named():
    from riskgrove import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        applicationId, master = "cluster-app", "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.shared_dir(Session())
