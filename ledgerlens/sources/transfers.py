"""Readers and writers: raw transfers, accounts, pattern blocks, alert tables, JSON documents."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import new_folder, read_text, write_text

#: Header fields of the raw files, and the names used here.
TRANSACTION_HEADER = ["Timestamp", "From Bank", "Account", "To Bank", "Account", "Amount Received", "Receiving Currency", "Amount Paid", "Payment Currency", "Payment Format", "Is Laundering"]
TRANSACTION_FIELDS = ["timestamp", "from_bank", "from_account", "to_bank", "to_account", "amount_received", "receiving_currency", "amount_paid", "payment_currency", "payment_format", "is_laundering"]
ACCOUNT_HEADER = ["Bank Name", "Bank ID", "Account Number", "Entity ID", "Entity Name"]
ACCOUNT_FIELDS = ["bank_name", "bank_id", "account_number", "entity_id", "entity_name"]
TIME_FORMAT = "yyyy/MM/dd HH:mm"


def require_columns(found: list[str], expected: list[str], source: str) -> None:
    """Raise a ValueError that lists missing and found columns; repeated names count as often as they stand."""
    left = list(found)
    missing = []
    for name in expected:
        if name in left:
            left.remove(name)
        else:
            missing.append(name)
    if missing:
        raise ValueError(f"{source}: missing expected columns {missing}; found {list(found)}")


def account_key(bank: Column, account: Column) -> Column:
    """Bank number without leading zeros, an underscore, and the account as text."""
    return F.concat_ws("_", bank.cast("bigint").cast("string"), account)


def _header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).limit(1).first()
    return [x.strip() for x in first[0].split(",")] if first else []


def _csv(spark: SparkSession, path: str, header: list[str], fields: list[str], kinds: dict[str, str], source: str) -> DataFrame:
    require_columns(_header(spark, path), header, source)
    schema = ", ".join(f"`{f}` {kinds.get(f, 'string')}" for f in fields)
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=True)


def typed_transactions(raw: DataFrame) -> DataFrame:
    """Raw text fields -> times, keys and a txn_id by time and all source fields, so equal files give equal ids."""
    typed = raw.withColumn("timestamp", F.to_timestamp_ntz("timestamp", F.lit(TIME_FORMAT))).withColumns(
        {"from_account_key": account_key(F.col("from_bank"), F.col("from_account")), "to_account_key": account_key(F.col("to_bank"), F.col("to_account"))}
    )
    # A day's rows are numbered in their own window; the days' totals give each day's first number.
    day = F.to_date("timestamp")
    totals = typed.groupBy(day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    starts = totals.select("_day", (F.sum("_n").over(Window.orderBy("_day")) - F.col("_n")).alias("_start"))
    order = Window.partitionBy("_day").orderBy(*TRANSACTION_FIELDS)
    rows = typed.withColumn("_day", day)
    joined = rows.withColumn("_at", F.row_number().over(order) - 1).join(F.broadcast(starts), rows["_day"].eqNullSafe(starts["_day"]))
    return joined.select((F.col("_start") + F.col("_at")).cast("bigint").alias("txn_id"), *TRANSACTION_FIELDS, "from_account_key", "to_account_key")


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Transfers of a CSV file whose header has "Account" twice; accounts stay text."""
    kinds = {"from_bank": "bigint", "to_bank": "bigint", "amount_received": "double", "amount_paid": "double", "is_laundering": "int"}
    return typed_transactions(_csv(spark, path, TRANSACTION_HEADER, TRANSACTION_FIELDS, kinds, "transactions"))


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    """The account dimension with its key."""
    raw = _csv(spark, path, ACCOUNT_HEADER, ACCOUNT_FIELDS, {"bank_id": "bigint"}, "accounts")
    return raw.withColumn("account_key", account_key(F.col("bank_id"), F.col("account_number")))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Labelled transfers of a block file: BEGIN lines name a type, END lines close it.

    Blank lines, lines outside blocks and lines without eleven fields are
    skipped. The type is the text between the first hyphen and the first colon
    after it. Each file is one row before it is split into numbered lines, so
    a file must fit into a task; blocks are found per file.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    begin = F.col("value").rlike("^BEGIN LAUNDERING ATTEMPT")
    marker = F.when(begin, F.trim(F.regexp_extract("value", r"^BEGIN LAUNDERING ATTEMPT[^-]*-([^:]*)", 1))).when(F.col("value").rlike("^END LAUNDERING ATTEMPT"), F.lit(""))
    so_far = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fields = F.split(F.trim("value"), ",")
    inside = (
        lines.withColumn("marker", marker).withColumn("pattern_type", F.last("marker", ignorenulls=True).over(so_far))
        .filter(F.col("marker").isNull() & (F.coalesce("pattern_type", F.lit("")) != "") & (F.size(fields) == len(TRANSACTION_FIELDS)))
    )
    cell = {f: F.trim(fields[i]) for i, f in enumerate(TRANSACTION_FIELDS)}
    cell["timestamp"] = F.to_timestamp_ntz(cell["timestamp"], F.lit(TIME_FORMAT))
    for f in ("from_bank", "to_bank"):
        cell[f] = cell[f].cast("bigint")
    for f in ("amount_received", "amount_paid"):
        cell[f] = cell[f].cast("double")
    cell["is_laundering"] = cell["is_laundering"].cast("int")
    return inside.select(*[c.alias(f) for f, c in cell.items()], "pattern_type")


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table, or some of its columns; only those are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, by_day: str | None = None) -> None:
    """The modelling table as Parquet, in folders by day if ``by_day`` names a timestamp."""
    if by_day:
        df.withColumn("day", F.to_date(by_day)).write.mode("overwrite").partitionBy("day").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_artifact(df: DataFrame, path: str, budget_mb: float = 20.0) -> float:
    """A review table as one snappy file, or a file per ``budget_mb`` beyond that; returns its MB and warns beyond the budget.

    All tasks work the table out first; a lone task would run its last joins too.
    """
    import warnings

    spark = df.sparkSession

    def megabytes(at: str) -> float:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength() / 1e6

    whole = new_folder(spark, "artifact-rows")
    df.write.option("compression", "snappy").parquet(whole)
    files = max(1, math.ceil(megabytes(whole) / budget_mb))
    spark.read.schema(df.schema).parquet(whole).coalesce(files).write.mode("overwrite").option("compression", "snappy").parquet(path)
    size = megabytes(path)
    if size > budget_mb:
        warnings.warn(f"artifact of {size:.1f} MB is over its budget of {budget_mb} MB", stacklevel=2)
    return size


def write_json(document: dict, path: str) -> None:
    """A metrics document with indent 2; values JSON has no form for become text."""
    write_text(json.dumps(document, indent=2, default=str), path)


def read_json(path: str) -> dict:
    return json.loads(read_text(path))


def records(df: DataFrame) -> list[dict]:
    """Rows of a small frame for JSON: whole numbers stay whole, NaN becomes null."""
    kinds = dict(df.dtypes)
    clean = df.select(*[(F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if kinds[c] in ("float", "double") else F.col(c)) for c in df.columns])
    return [r.asDict(recursive=True) for r in clean.collect()]


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row, nulls and NaN written as null."""
    kinds = dict(df.dtypes)
    cells = [(F.when(~F.isnan(c), F.col(c)) if kinds[c] in ("float", "double") else F.col(c)).alias(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("json"))


def frame(spark: SparkSession, document: dict, *keys: str) -> DataFrame:
    """A list of records inside a metrics document as a DataFrame."""
    found = document
    for k in keys:
        found = found[k]
    return spark.createDataFrame([json.loads(json.dumps(r)) for r in found])


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The review table in its stored order; ranks are never computed again."""
    return spark.read.parquet(path).orderBy("rank")


def display_columns(columns: list[str]) -> list[str]:
    """What a person reads: all but the feature and contribution columns."""
    return [c for c in columns if not c.startswith(("feat_", "shap_"))]


def feature_names(columns: list[str]) -> list[str]:
    """Model features of a review table, from its feature columns."""
    return [c.removeprefix("feat_") for c in columns if c.startswith("feat_")]


def write_csv(df: DataFrame, path: str) -> None:
    """A view's display columns as CSV with a header."""
    df.select(*display_columns(df.columns)).write.mode("overwrite").csv(path, header=True)
