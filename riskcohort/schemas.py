"""Explicit schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

from riskcohort import constants as K


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in kinds.items()])


MODULES = {
    name: T.StructType(
        [T.StructField("cycle", T.StringType())]
        + [T.StructField(c, T.LongType() if c == "SEQN" else T.DoubleType()) for c in columns]
    )
    for name, columns in K.MODULE_COLUMNS.items()
}

DATASET = _fields(
    SEQN=T.LongType(), cycle=T.StringType(), age=T.IntegerType(), sex=T.IntegerType(),
    bmi=T.DoubleType(), race_ethnicity=T.IntegerType(), family_history=T.DoubleType(),
    hypertension=T.DoubleType(), physical_activity=T.DoubleType(),
    smoking_status=T.DoubleType(), diq010=T.DoubleType(), diabetes_risk=T.StringType(),
)

BINARY_DATASET = _fields(
    SEQN=T.LongType(), age=T.IntegerType(), sex=T.IntegerType(),
    race_ethnicity=T.IntegerType(), bmi=T.DoubleType(), family_history=T.IntegerType(),
    diabetes=T.IntegerType(), cycle=T.StringType(),
)

SCORED = _fields(
    id=T.LongType(), y_true=T.StringType(), y_pred=T.StringType(),
    p_high=T.DoubleType(), p_low=T.DoubleType(), p_moderate=T.DoubleType(),
)

FOLLOWUP = _fields(
    participant_id=T.LongType(), time_years=T.DoubleType(), event=T.IntegerType(),
    age=T.DoubleType(), male=T.IntegerType(), bmi=T.DoubleType(), fpg_mmol_l=T.DoubleType(),
)

OUT_OF_FOLD = _fields(
    participant_id=T.LongType(), time_years=T.DoubleType(), event=T.IntegerType(),
    ipcw_weight=T.DoubleType(), oof_risk_3y=T.DoubleType(),
)

SUBMISSION = _fields(
    submission_id=T.LongType(), user_id=T.LongType(), ts=T.TimestampType(), body=T.StringType(),
)

RECORD_EVENT = _fields(
    event_id=T.LongType(), ts=T.TimestampType(), assessment_id=T.LongType(), owner_id=T.LongType(),
    action=T.StringType(), snapshot=T.StringType(),
)
