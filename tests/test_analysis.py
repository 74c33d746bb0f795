import pytest
from pyspark.sql import functions as F

from caseloom.functions import text as fx
from caseloom.plans import analysis
from caseloom.plans.queries import QUERIES
from tests import simulated


def test_nine_tables(spark, tmp_path):
    df = simulated.simulate(spark, 90, 4)
    tables = analysis.analysis_tables(df, n_boot=12, use_logistic=False)
    assert sorted(tables) == ["arm_cells", "coefficients", "diagnostics", "qa_agreement", "qa_agreement_summary", "rule_summary", "rules", "static_vs_adaptive", "value_ci"]
    ci = {r["method"]: r for r in tables["value_ci"].collect()}
    assert set(ci) == {"in_sample", "cross_fitted", "m_out_of_n", "cms_projection"} and all(ci[k]["lo"] <= ci[k]["hi"] for k in ci if k != "in_sample")
    d = {r["metric"]: r["value"] for r in tables["diagnostics"].collect()}
    assert d["n_encounters"] == 90 and d["stage2_n_design_cols"] == 67 and d["stage1_n_design_cols"] == 34 and d["stage2_n_over_p"] == round(90 / 67, 3) and d["warning_high_dimensional"] == 0
    agree = tables["qa_agreement"].agg(F.count("*"), F.avg(F.col("agree_all").cast("int"))).first()
    assert agree[0] == 90 and tables["qa_agreement_summary"].first()["agree_all"] == pytest.approx(agree[1])
    assert tables["rule_summary"].agg(F.sum("n")).first()[0] == 90 and tables["static_vs_adaptive"].count() == 9
    analysis.write_analysis(tables, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "coefficients.csv")).count() == 67 + 34


def test_settings_with_defaults():
    assert analysis.coverage_settings({}) == {"enabled": True, "check_every": 5, "threshold": 0.5, "gate_mcq_finalize": True, "stage1_min_turns": 2, "stage2_min_turns": 2, "summary_subdir": "coverage_summaries", "r2_high_threshold": 0.7}
    some = analysis.coverage_settings({"coverage": {"check_every": 0, "stage2_min_turns": "5"}, "rounds": {"stage1": {"min_turns": 3}, "stage2": None}, "R2_high_confidence_threshold": 0.8})
    assert (some["check_every"], some["stage1_min_turns"], some["stage2_min_turns"], some["r2_high_threshold"]) == (1, 3, 5, 0.8)
    limits = analysis.turn_limits({"stage1_turns": 7, "rounds": {"mode": "Adaptive", "stage1": {"red_flags_min": "2", "check_every": 0}}})
    assert limits == {"mode": "adaptive", "adaptive": True, "stage1_max": 7, "stage2_max": 6, "stage1_min_turns": 2, "stage1_check_every": 1, "stage1_red_flags_min": 2, "stage2_min_turns": 2}
    assert analysis.turn_limits({"rounds": None})["adaptive"] is False


def test_option_texts_arrays_and_times(spark):
    df = spark.createDataFrame([({"a": "x", "B) ": "y", "E": "z"}, "b."), ({"a": "x"}, None), (None, "A"), ({"E": "z"}, "E")], "o map<string,string>, letter string")
    assert [r[0] for r in df.select(fx.option_text(F.col("o"), F.col("letter"))).collect()] == ["y", "", "", ""]
    arrays = spark.createDataFrame([(["p", "q"],), ([],), (None,)], "v array<string>")
    assert [tuple(r[0]) for r in arrays.select(fx.joined(F.col("v"), "; ")).collect()] == [(2, "p", "p; q"), (0, "", ""), (0, "", "")]
    at = spark.sql("SELECT timestamp '2024-02-03 04:05:06' AS a, timestamp '2024-02-03 04:05:06.25' AS b")
    assert at.select(fx.iso_time(F.col("a")), fx.iso_time(F.col("b"))).first()[:] == ("2024-02-03T04:05:06", "2024-02-03T04:05:06.250000")
    assert at.select(fx.encounter_id(F.col("b"))).first()[0] == "enc_20240203_040506_250000"


def test_every_query_says_what_it_covers():
    assert all((f.__doc__ or "").strip() for f in QUERIES.values())
