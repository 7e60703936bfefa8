"""Declared column contracts of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PROFILE_STEP = 5
PROFILE_HEIGHTS = list(range(0, 101, PROFILE_STEP))


def _fields(names: list[str], kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


# Percentiles of relative height in the shot metrics file.
RH_PERCENTILES = sorted({*range(0, 101, 5), 92, 98, 99})

# Shot metrics file: position, biomass, relative heights, cover and plant area profiles.
METRIC_SCHEMA = T.StructType(
    [
        T.StructField("shot_num", T.LongType()),
        *_fields(["orbit", "sub_orbit"], T.IntegerType()),
        T.StructField("beam", T.StringType()),
        *_fields(["lon_lm_a0", "lat_lm_a0", "agbd_a0"], T.DoubleType()),
        *_fields([f"rh_{p}_a0" for p in RH_PERCENTILES], T.DoubleType()),
        *_fields([f"{kind}_{h}" for kind in ("cov", "pai") for h in PROFILE_HEIGHTS], T.DoubleType()),
        T.StructField("elev_lm_a0", T.DoubleType()),
        *_fields(["num_modes_a0", "outlier_umd"], T.IntegerType()),
    ]
)

PAIR_KEY_FIELDS = _fields(["t1_shot_number", "t2_shot_number"], T.LongType())
POSITION_FIELDS = _fields(["t2_lon", "t2_lat"], T.DoubleType())

YEARLY_IN = T.StructType([*PAIR_KEY_FIELDS, *POSITION_FIELDS, *_fields(["t1_year", "t2_year"], T.IntegerType())])
ALERT_IN = T.StructType([*PAIR_KEY_FIELDS, *POSITION_FIELDS, *_fields(["t1_days", "t2_days"], T.IntegerType())])
INTENSITY_IN = T.StructType(
    [*PAIR_KEY_FIELDS, *POSITION_FIELDS, *_fields([f"p{i}_disturb_date" for i in range(1, 5)], T.IntegerType())]
)


def _counts(window: int) -> list[T.StructField]:
    names = ["measured_disturbance", "control_disturbance", *[f"p{i}_disturb_date" for i in range(1, window + 1)]]
    return _fields(names, T.IntegerType())


YEARLY_OUT = T.StructType([*PAIR_KEY_FIELDS, *_counts(4)])
ALERT_OUT = T.StructType([*PAIR_KEY_FIELDS, *_counts(9)])
INTENSITY_OUT = T.StructType([*PAIR_KEY_FIELDS, T.StructField("disturb_intensity", T.FloatType())])
INTACT_OUT = T.StructType(PAIR_KEY_FIELDS)


def require(df: DataFrame, contract: T.StructType) -> DataFrame:
    """The frame itself, if it has every column of the contract with its type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{f.name} {f.dataType.simpleString()}" for f in contract.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"missing or differently typed columns: {', '.join(wrong)}")
    return df
