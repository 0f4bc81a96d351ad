"""Schemas with field ids, required fields and strict widening."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD_ID = "parquet.field.id"
#: What may be written into a column of another type.
WIDER = {"byte": ("short", "integer", "long", "float", "double"), "short": ("integer", "long", "float", "double"), "integer": ("long", "double"), "long": ("double",), "float": ("double",), "timestamp": ("timestamp_ntz",)}


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    id: int
    name: str
    type: T.DataType
    required: bool = False

    def dump(self) -> dict:
        return {"id": self.id, "name": self.name, "type": self.type.jsonValue(), "required": self.required}

    @classmethod
    def load(cls, x: dict) -> Field:
        holder = T.StructType.fromJson({"type": "struct", "fields": [{"name": "x", "type": x["type"], "nullable": True, "metadata": {}}]})
        return cls(x["id"], x["name"], holder["x"].dataType, x["required"])


def fields_of(schema: T.StructType, first: int = 1) -> list[Field]:
    """Numbers the columns; a column that isn't nullable is required."""
    if len({f.name.lower() for f in schema}) != len(schema):
        raise SchemaError("a column name comes twice")
    return [Field(first + i, f.name, f.dataType, not f.nullable) for i, f in enumerate(schema)]


def spark_schema(fields: list[Field]) -> T.StructType:
    """For reading: all nullable, resolved by id."""
    return T.StructType([T.StructField(f.name, f.type, True, {FIELD_ID: f.id}) for f in fields])


def may_widen(found: T.DataType, wanted: T.DataType) -> bool:
    if found == wanted or isinstance(found, T.NullType):
        return True
    if isinstance(found, T.DecimalType) and isinstance(wanted, T.DecimalType):
        return wanted.scale >= found.scale and wanted.precision - wanted.scale >= found.precision - found.scale
    return wanted.typeName() in WIDER.get(found.typeName(), ())


def conform(df: DataFrame, fields: list[Field], strict: bool = False, fill_missing: bool = False) -> DataFrame:
    """``df`` as the table's columns: matched by name, widened only without loss, required columns checked as rows are written.

    Columns that the table lacks are left out (``strict``: an error).  A missing column is an error
    (``fill_missing``: null).
    """
    extra = [c for c in df.columns if c not in {f.name for f in fields}]
    if extra and strict:
        raise SchemaError(f"the table has no column {', '.join(extra)}")
    out: list[Column] = []
    for f in fields:
        if f.name not in df.columns:
            if not fill_missing:
                raise KeyError(f.name)
            value = F.lit(None).cast(f.type)
        else:
            found = df.schema[f.name].dataType
            if not may_widen(found, f.type):
                raise SchemaError(f"{f.name}: {found.simpleString()} doesn't fit {f.type.simpleString()}")
            value = F.col(f"`{f.name}`")
            if isinstance(found, T.TimestampType) and isinstance(f.type, T.TimestampNTZType):
                value = F.to_utc_timestamp(value, F.current_timezone()) if df.sparkSession.conf.get("spark.sql.session.timeZone") != "UTC" else value
            value = value.cast(f.type)
        if f.required:
            value = F.coalesce(value, F.raise_error(F.lit(f"{f.name} is required")).cast(f.type))
        out.append(value.alias(f.name, metadata={FIELD_ID: f.id}))
    return df.select(*out)


def from_pandas(spark: SparkSession, data: pd.DataFrame, fields: list[Field]) -> DataFrame:
    """A pandas frame: NaN becomes null, zoned times become UTC wall time, nanoseconds must fit microseconds."""
    data = data.copy()
    columns = []
    for name in data.columns:
        s = data[name]
        if pd.api.types.is_datetime64_any_dtype(s.dtype):
            if isinstance(s.dtype, pd.DatetimeTZDtype):
                s = s.dt.tz_convert("UTC").dt.tz_localize(None)
            if getattr(s.dtype, "unit", "ns") == "ns" and (s.dropna().astype("int64") % 1000).any():
                raise SchemaError(f"{name}: nanoseconds don't fit a timestamp")
            data[name] = s.astype("datetime64[us]")
            columns.append(T.StructField(str(name), T.TimestampNTZType()))
            continue
        kinds = {"bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "float32": T.FloatType(), "float64": T.DoubleType()}
        if s.dtype.name in kinds:
            columns.append(T.StructField(str(name), kinds[s.dtype.name]))
            continue
        values = [v for v in s if not (v is None or v is pd.NaT or isinstance(v, float) and v != v)]
        if not values:
            kind: T.DataType = T.NullType()
        else:
            import pyarrow as pa
            from pyspark.sql.pandas.types import from_arrow_type

            arrow = pa.array(values)
            if pa.types.is_timestamp(arrow.type) and arrow.type.tz:
                values_utc = [None if v not in values else v.astimezone(__import__("datetime").timezone.utc).replace(tzinfo=None) for v in s]
                data[name] = values_utc
                kind = T.TimestampNTZType()
            elif pa.types.is_timestamp(arrow.type):
                kind = T.TimestampNTZType()
            else:
                kind = from_arrow_type(arrow.type)
        data[name] = data[name].astype(object).where(s.notna(), None)
        columns.append(T.StructField(str(name), kind))
    rows = [tuple(None if v is pd.NaT or isinstance(v, float) and v != v else (v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v) for v in row) for row in data.itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, T.StructType(columns))
