"""What lands in files: wide batches of a download, and lines of JSON that may be anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("open", "high", "low", "close", "volume")


def depivoted(wide: DataFrame, day: str = "date", separator: str = "|", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """A batch with a column ``ticker|field`` for each name and field as one row a ticker and day.

    The batch's columns become an array of one struct for each name, which is exploded: no exchange, one pass.  Fields that
    a name lacks are null; a name's day without any value gives no row; columns of other shapes are left out.
    """
    names: dict[str, dict[str, str]] = {}
    for column in wide.columns:
        ticker, found, field = column.rpartition(separator)
        if found and ticker and field.lower() in fields:
            names.setdefault(ticker, {})[field.lower()] = column
    if not names:
        raise ValueError(f"no columns like ticker{separator}{fields[0]}")
    value = lambda own, field: F.col(f"`{own[field]}`").cast("double") if field in own else F.lit(None).cast("double")
    rows = [F.struct(F.lit(ticker).alias("ticker"), *[value(own, field).alias(field) for field in fields]) for ticker, own in names.items()]
    out = wide.select(F.col(day).cast("date").alias("date"), F.explode(F.array(*rows)).alias("row")).select("row.ticker", "date", *[f"row.{field}" for field in fields])
    return out.dropna(how="all", subset=list(fields))


def json_lines(lines: DataFrame, schema: str, required: list[str], text: str = "line") -> tuple[DataFrame, DataFrame]:
    """Rows parsed from JSON texts, and the rows that could not be, with a reason; other columns of ``lines`` stay.

    Reasons, the first that applies: ``empty`` (null or blank), ``page`` (a page of HTML in place of data, as from a check
    for bots), ``not_json``, ``not_an_object``, ``wrong_type`` (a field that does not fit its column), ``missing`` (a
    required field is absent or null).  Every line is in one of the two results.
    """
    kind = T.StructType.fromDDL(schema)
    fields = [f.name for f in kind.fields]
    body = F.trim(F.col(text))
    own = lines.withColumns({
        "_any": F.expr(f"try_parse_json(`{text}`)"),
        "_row": F.from_json(F.col(text), T.StructType([*kind.fields, T.StructField("_broken", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}),
    })
    absent = F.lit(False)
    for name in required:
        absent |= F.col(f"_row.{name}").isNull()
    reason = (
        F.when(body.isNull() | (body == ""), "empty").when(body.startswith("<"), "page").when(F.col("_any").isNull(), "not_json").when(~F.expr("schema_of_variant(_any)").startswith("OBJECT"), "not_an_object")
        .when(F.col("_row._broken").isNotNull(), "wrong_type").when(absent, "missing")
    )
    own = own.withColumn("_reason", reason)
    rest = [c for c in lines.columns if c not in fields and c != text]
    good = own.where("_reason is null").select(*rest, *[F.col(f"_row.{f}").alias(f) for f in fields])
    return good, own.where("_reason is not null").select(*lines.columns, F.col("_reason").alias("reason"))
