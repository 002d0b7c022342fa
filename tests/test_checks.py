"""Checks inside plans, exact quantiles, and the audit of landed files."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskcohort import constants as K
from riskcohort.functions.checks import must, one_per_key
from riskcohort.operators import cohort, profile, replay, survival
from riskcohort.operators.quantiles import exact_quantiles
from riskcohort.plans import fixtures
from riskcohort.sources import tables


def fails(df, *words):
    with pytest.raises(Exception) as error:
        df.write.format("noop").mode("overwrite").save()
    return all(w in str(error.value) for w in words)


def test_must(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "k int, v int")
    assert must(df, {"large": F.col("v") > 9}, "t").count() == 2  # a comparison with null is no breach
    assert fails(must(df, {"large": F.col("v") > 9, "gone": F.col("v").isNull()}, "t"), "t: gone")
    assert one_per_key(df, ["k"], "t").orderBy("k").collect() == df.orderBy("k").collect()
    assert fails(one_per_key(df.unionByName(df), ["k"], "t"), "t: a key repeats")


@pytest.mark.parametrize("column,value,rule", [("age", 19, "age_below_minimum"), ("sex", 3, "sex_code"), ("race_ethnicity", 5, "race_code"),
                                               (K.TARGET, "None", "label"), ("SEQN", None, "missing_key")])
def test_dirty_cohorts_stop_the_job(spark, small_dir, column, value, rule):
    people = cohort.cohort_v2(fixtures.modules(spark, small_dir)) if hasattr(cohort, "cohort_v2") else None
    if people is None:
        rows = spark.range(4).select(F.col("id").alias("SEQN"), F.lit("c").alias("cycle"))
        people = rows.withColumns({c: F.lit(None).cast("double") for c in K.DATASET_COLUMNS if c not in ("SEQN", "cycle")})
        people = people.withColumns({"age": F.lit(40), "sex": F.lit(1), "race_ethnicity": F.lit(K.RACE_CODES[0]), K.TARGET: F.lit("Low")})
    assert cohort.supervised_dataset(people).count() > 0
    dirty = people.withColumn(column, F.when(F.col("SEQN") == people.first()["SEQN"], F.lit(value)).otherwise(F.col(column)))
    assert fails(cohort.supervised_dataset(dirty), "dataset: " + rule)


def test_dirty_followup_stops_the_job(spark, small_dir):
    df = fixtures.fixture(spark, small_dir, "followup_all")
    assert tables.eligible_followup(df).count() > 0
    assert fails(tables.eligible_followup(df.withColumn("bmi", F.lit(None).cast("double"))), "follow-up table: bmi is missing")
    with pytest.raises(Exception, match="follow-up cohort: event"):
        survival.ipcw_weights(df.withColumn("event", F.lit(2))).count()
    with pytest.raises(Exception, match="follow-up cohort: time"):
        survival.ipcw_weights(df.withColumn("time_years", -F.col("time_years"))).count()


def test_repeated_lab_keys_stop_the_job(spark):
    ghb = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0)], "cycle string, SEQN long, LBXGH double")
    glu = spark.createDataFrame([("a", 2, 100.0)], "cycle string, SEQN long, LBXGLU double")
    labs = replay.labs_outer_join(ghb, glu)
    assert labs.count() == 2 and replay.with_labs(glu.select("cycle", "SEQN"), labs).count() == 1
    assert fails(replay.labs_outer_join(ghb.unionByName(ghb), glu), "LBXGH: a key repeats")
    assert fails(replay.with_labs(ghb, labs.unionByName(labs)), "labs: a key repeats")


@pytest.mark.parametrize("bins", [2, 1024])
def test_exact_quantiles(spark, monkeypatch, bins):
    from riskcohort.operators import quantiles

    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = np.random.default_rng(3)
    columns = {"a": rng.normal(size=500), "b": np.round(rng.normal(size=500), 1), "c": np.full(500, 7.0), "d": 10.0 ** rng.integers(-80, 80, 500),
               "e": np.where(rng.random(500) < 0.9, 3.0, rng.normal(size=500)), "f": np.r_[[-1.7e308, 1.7e308], np.zeros(498)]}
    rows = [tuple(None if i % 50 == 9 and c != "f" else float(v[i]) for c, v in columns.items()) + (None, float("nan")) for i in range(500)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*columns, "g", "h"])).repartition(4)
    marks = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = exact_quantiles(df, [*columns, "g", "h"], marks)
    for c, v in columns.items():
        kept = v if c == "f" else v[np.arange(500) % 50 != 9]
        if c == "f":
            kept = np.sort(kept)
            assert [got[c][m] for m in (0.0, 0.5, 1.0)] == [kept[0], 0.0, kept[-1]]
            continue
        assert [got[c][m] for m in marks] == pytest.approx(list(np.quantile(kept, marks)))
    assert set(got["g"].values()) == set(got["h"].values()) == {None}


def test_no_percentile_buffers(spark, small_dir):
    df = fixtures.fixture(spark, small_dir, "followup_all")
    for out in (profile.evidence_ranges(df, ["age", "bmi"]),):
        assert "percentile" not in out._jdf.queryExecution().toString().lower()


def test_landing_audit(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"PAR1" + b"x" * 3_000_000)
    (tmp_path / "b.bin").write_bytes(b"PAX1")
    (tmp_path / "c.bin").write_bytes(b"")
    (tmp_path / "d.txt").write_bytes(b"PAR1")
    got = {r.file: r for r in tables.landing_audit(spark, str(tmp_path), "PAR1", "*.bin").collect()}
    assert set(got) == {"a.bin", "b.bin", "c.bin"}
    for name in got:
        data = (tmp_path / name).read_bytes()
        assert (got[name].bytes, got[name].sha256) == (len(data), hashlib.sha256(data).hexdigest())
    assert [got[n].magic_ok for n in sorted(got)] == [True, False, False] and got["a.bin"].size_ok and not got["c.bin"].size_ok
    assert tables.landing_audit(spark, "file://" + str(tmp_path), "PAR1", "nothing").count() == 0
    with pytest.raises(Exception):
        tables.landing_audit(spark, str(tmp_path / "absent"), "PAR1").count()


def test_audit_of_a_file_beyond_two_gigabytes(spark, tmp_path):
    with open(tmp_path / "large", "wb") as f:
        f.write(b"PAR1")
        f.truncate((1 << 31) + 4096)  # sparse: takes no disk
    row = tables.landing_audit(spark, str(tmp_path), "PAR1").first()
    digest, left = hashlib.sha256(b"PAR1"), (1 << 31) + 4092
    zeros = bytes(1 << 22)
    while left:
        digest.update(zeros[:min(left, len(zeros))])
        left -= min(left, len(zeros))
    assert (row.bytes, row.magic_ok, row.sha256) == ((1 << 31) + 4096, True, digest.hexdigest())
    os.truncate(tmp_path / "large", 0)
