import pytest
from pyspark.sql import functions as F

from riskcohort import constants as K
from riskcohort.operators import cohort, experiments, profile, records, replay
from riskcohort.operators.scoring import scorecard
from riskcohort.plans import fixtures
from riskcohort.sources import sinks, tables


def test_contracts(spark):
    df = spark.createDataFrame([(1, 2.0)], "` seqn ` long, bmxbmi double")
    named = tables.normalise_names(df)
    assert named.columns == ["SEQN", "BMXBMI"]
    with pytest.raises(tables.ContractError):
        tables.require_columns(named, ["SEQN", "DIQ010"])
    with pytest.raises(tables.ContractError):
        tables.exact_columns(named, ["SEQN"])
    with pytest.raises(tables.ContractError):
        tables.reject_forbidden(["age", "LBXGH"])


def test_scan_module_and_dataset_round_trip(spark, small_dir, tmp_path):
    demo = fixtures.fixture(spark, small_dir, "demo").withColumnRenamed("SEQN", " seqn ")
    demo.filter("cycle = '2013-2014'").drop("cycle").write.parquet(str(tmp_path / "a"))
    demo.filter("cycle = '2015-2016'").drop("cycle").write.option("header", True).csv(str(tmp_path / "b"))
    one = tables.scan_module(spark, "demo", str(tmp_path / "a"), cycle="2013-2014")
    two = tables.scan_module(spark, "demo", str(tmp_path / "b"), "csv", "2015-2016", ignoreLeadingWhiteSpace="true")
    assert one.schema == two.schema and one.unionByName(two).groupBy("cycle").count().count() == 2
    data = cohort.supervised_dataset(cohort.candidate_cohort(fixtures.modules(spark, small_dir)))
    sinks.write_dataset(data, str(tmp_path / "d"))
    back = tables.read_dataset(spark, str(tmp_path / "d"))
    assert back.columns == list(K.DATASET_COLUMNS) and back.count() == data.count()
    sinks.export_csv(data, str(tmp_path / "c"))
    again = tables.read_dataset(spark, str(tmp_path / "c"), "csv")
    assert again.count() == data.count() and again.exceptAll(back).count() == 0


def test_observed_joins_match_audit(spark, small_dir):
    modules = fixtures.modules(spark, small_dir)
    seen: dict = {}
    rows = cohort.join_modules(modules, min_age=0, observations=seen).collect()
    assert seen["glu"].get["n"] == len(rows) and list(seen) == ["demo", *K.INNER_MODULES, *K.LEFT_MODULES]


def test_join_audit_with_repeated_keys(spark):
    def part(keys):
        return spark.createDataFrame([("c", k) for k in keys], "cycle string, SEQN long")

    modules = {n: part([1, 2]) for n in ("demo", *K.INNER_MODULES)}
    modules["bmx"] = part([1, 1, 2, 3])
    modules.update({"ghb": part([1]), "glu": part([])})
    got = {r.step: r.n_rows for r in cohort.join_audit(modules).collect()}
    assert got["0_demo"] == 2 and got["1_bmx"] == 3 and got["8_glu"] == 3


def test_first_per_key_and_duplicates(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "z"), (1, 1, "a"), (2, 5, "c")], "k int, o int, v string")
    assert {tuple(r) for r in cohort.first_per_key(df, ["k"], ["o"]).collect()} == {(1, 1, "a"), (2, 5, "c")}
    assert [tuple(r) for r in cohort.duplicate_keys(df, ["k"]).collect()] == [(1, 3)]


def test_checks_raise(spark):
    df = spark.createDataFrame([(1, None)], "a int, b int")
    with pytest.raises(ValueError):
        cohort.assert_no_violations(cohort.core_nulls(df, ["a", "b"]), "n_null")
    cohort.assert_no_violations(cohort.core_nulls(df, ["a"]), "n_null")


def test_filters_reach_the_scan(spark, small_dir):
    people = fixtures.table(spark, small_dir, "orders").filter(F.col("o_totalprice") > 1e5).select("o_orderkey")
    plan = people._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice" in plan
    distribution = profile.class_distribution(cohort.supervised_dataset(cohort.candidate_cohort(fixtures.modules(spark, small_dir))))
    text = distribution._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_followup_reader(spark):
    names = list(K.FOLLOWUP_HEADERS)
    df = spark.createDataFrame([(7, 3.5, 1, 40, 2, 25.5, 5.0), (8, 2.0, 0, 41, 1, 22.0, None)], names)
    got = tables.read_followup(df).orderBy("participant_id").collect()
    assert got[0].male == 0 and got[1].male == 1 and got[0].age == 40.0
    assert tables.eligible_followup(tables.read_followup(df)).count() == 1


def test_named_profiles_and_reference_grid(spark):
    named = scorecard(experiments.named_profiles(spark))
    assert named.groupBy("profile_set").count().count() == 4 and named.count() == 17
    grid = scorecard(experiments.profile_grid(experiments.base_background(spark)))
    assert grid.count() == 224
    verdict = experiments.validation_verdict(grid).first()
    assert verdict.passed and verdict.reasons == [] and verdict.separation > 0.2
    flat = grid.withColumns({"p_high": F.lit(0.1), "y_pred": F.lit("Low")})
    failed = experiments.validation_verdict(flat).first()
    assert not failed.passed and "class_missing" in failed.reasons and "weak_separation" in failed.reasons
    trends = experiments.trend_lines(grid).collect()
    assert len(trends) == 2 and all(t.increasing for t in trends)


def test_replay_excludes_people_without_labs(spark):
    cols = ("LBXGH double, LBXGLU double, p_high double, p_low double, age int, bmi double, sex int, race_ethnicity int, "
            "family_history double, hypertension double, physical_activity double, smoking_status double, diq010 double")
    rest = (40, 25.0, 1, 3, 0.0, 0.0, 1.0, 0.0)
    df = spark.createDataFrame([
        (None, None, 0.9, 0.05, *rest, 2.0), (5.0, 90.0, 0.9, 0.05, *rest, 1.0), (5.0, 90.0, 0.3, 0.3, *rest, 2.0),
        (6.5, 90.0, 0.9, 0.05, *rest, 2.0), (6.0, 90.0, 0.5, 0.1, *rest, 2.0), (5.0, None, 0.2, 0.6, *rest, 2.0)], cols)
    got = {(r.scope, r.measure): r.n for r in replay.policy_replay(replay.replay_masks(df)).collect()}
    assert got[("all", "no_labs")] == 1 and got[("rule2", "final_high")] == 1 and got[("rule4", "final_high")] == 1
    assert got[("rule2", "both_normal_known_diabetes")] == 1 and got[("all", "both_normal")] == 2
    assert got[("all", "available_normal")] == 3


def test_records(spark):
    rows = [(1, 1, 1, 9, "create", "a"), (2, 2, 1, 9, "result", "a"), (3, 3, 1, 9, "edit", "b"), (4, 4, 1, 9, "result", "b"),
            (5, 1, 2, 9, "create", "c"), (6, 5, 2, 9, "delete", None), (7, 6, 3, 8, "create", "d"), (8, 7, 3, 8, "clear", None),
            (9, 8, 4, 8, "create", "e"), (10, 9, 1, 9, "result", None)]
    df = spark.createDataFrame(rows, "event_id long, t long, assessment_id long, owner_id long, action string, snapshot string")
    df = df.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    assert {r.assessment_id for r in records.current_records(df).collect()} == {1, 4}
    stored, current = records.results(df), records.current_assessments(df)
    assert {r.event_id for r in records.valid_results(stored, current).collect()} == {4}
    assert {r.event_id for r in records.stale_results(stored, current).collect()} == {2, 10}
