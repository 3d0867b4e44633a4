"""The logs as JSON records, and reading and writing them.

A record is key columns next to a JSON payload, so filters on the key run before
any JSON is parsed. Logs are folders of files; the file format is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Payload fields per request type (schema DDL).
REQUESTS = {
    "neworder": (
        "type string, customerId bigint, districtId int, warehouseId int, date bigint, "
        "lines array<struct<itemId: bigint, supplyingWarehouseId: int, quantity: int>>, "
        "items array<struct<itemId: bigint, supplyingWarehouseId: int, quantity: int>>"
    ),
    "neworder-line": "type string, lineNumber int, itemId bigint, supplyingWarehouseId int, quantity int",
    "payment": (
        "type string, customerId bigint, customerLastName string, districtId int, warehouseId int, "
        "customerDistrictId int, customerWarehouseId int, amount decimal(12,2)"
    ),
    "delivery": "type string, warehouseId int, carrierId int, deliveryDate bigint",
}

# Payload fields per modification type (schema DDL).
MODIFICATIONS = {
    "neworder": (
        "type string, customerId bigint, districtId int, warehouseId int, orderId bigint, date bigint, "
        "lines array<struct<lineNumber: int, itemId: bigint, supplyWarehouseId: int, deliveryDate: bigint, "
        "quantity: int, amount: decimal(12,2), distInfo: string, homeWarehouseStockLevel: int>>"
    ),
    "payment": (
        "type string, districtId int, warehouseId int, customerId bigint, customerDistrictId int, "
        "customerWarehouseId int, amount decimal(12,2), balance decimal(12,2), customerData string"
    ),
    "delivery": (
        "type string, orderId bigint, districtId int, warehouseId int, carrierId int, customerId bigint, "
        "deliveryDate bigint, orderTotal decimal(12,2)"
    ),
    "remote-stock": "type string, itemId bigint, warehouseId int, stockLevel int",
}


def encode(**fields: Column) -> Column:
    """JSON text of the fields; nulls are left out."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def decode(log: DataFrame, kind: str, schemas: dict[str, str], strict: bool = True) -> DataFrame:
    """Records of one type with their payload parsed into ``r``.

    ``strict`` raises on malformed JSON; otherwise such records come back with the
    text in ``corrupt``. A null value stays null. A log that carries ``type`` as a key
    column is filtered on that, before any JSON is read.
    """
    tag = F.col("type") if "type" in log.columns else F.get_json_object("value", "$.type")
    tagged = log.where(tag == kind)
    if strict:
        parsed = F.from_json("value", schemas[kind], {"mode": "FAILFAST"})
        out = tagged.withColumn("r", parsed)
    else:
        out = quarantine(tagged, schemas[kind])
    if kind == "neworder" and "items array" in schemas[kind]:
        out = out.withColumn("r", F.col("r").withField("lines", F.coalesce("r.lines", "r.items")).dropFields("items"))
    return out


def quarantine(log: DataFrame, schema: str) -> DataFrame:
    """Parse what parses; keep the text of what does not in ``corrupt``."""
    wide = f"{schema}, _corrupt_record string"
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    out = log.withColumn("_p", parsed).withColumn("corrupt", F.col("_p._corrupt_record"))
    return out.withColumn("r", F.when(F.col("corrupt").isNull(), F.col("_p").dropFields("_corrupt_record"))).drop("_p")


#: How logs that streams write are compressed.
CODEC = "zstd"
#: Files of a log that a micro-batch takes.
FILES_PER_BATCH = 64


def read_log(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    """The whole log, from its beginning."""
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def stream_log(
    spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "parquet",
    files_per_batch: int | None = FILES_PER_BATCH, **options,
) -> DataFrame:
    """The log as a stream, from its beginning, then as it grows. A batch takes at most ``files_per_batch``
    files (None: all there are), so that a replay of a long log is many batches."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def write_log(log: DataFrame, path: str, fmt: str = "parquet", by: str | None = None, mode: str = "append") -> None:
    """Append records; ``by`` makes a folder per value of a partition column."""
    writer = log.write.mode(mode).format(fmt)
    if by:
        writer = writer.partitionBy(by)
    writer.save(path)


def move_into_log(spark: SparkSession, source: str, path: str) -> bool:
    """Append a folder of files to a log as it is: its files are moved, not written again. False: there is no such folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    folder, log = at(source), at(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return False
    files.mkdirs(log)
    # under its own name: an empty folder would be replaced
    if not files.rename(folder, at(log, folder.getName())):
        raise OSError(f"{source} could not be moved into {path}")
    return True


def write_table(table: DataFrame, path: str, mode: str = "append", jdbc: dict[str, str] | None = None) -> None:
    """Insert rows into a table: a parquet folder, or a database table with ``jdbc`` options."""
    if jdbc:
        table.write.mode(mode).format("jdbc").options(**jdbc).save()
    else:
        table.write.mode(mode).parquet(path)


def write_metrics(records: DataFrame, path: str) -> None:
    """``t,event,duration`` or ``t,event,data`` lines with a header."""
    records.write.mode("append").option("header", True).csv(path)
