"""The raw file: every column a string, nothing repaired."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Columns of the raw order-line file that the warehouse uses.
RAW_COLUMNS = (
    "Order_ID", "Order_Date", "Ship_Date", "Customer_ID", "Customer_Name", "Segment", "Country",
    "City", "State", "Postal_Code", "Region", "Product_ID", "Category", "Sub_Category",
    "Product_Name", "Sales", "Quantity", "Discount", "Profit",
)

#: Holds a line that does not have the header's fields.
MALFORMED = "malformed_line"
#: Lines in a compressed file.
MOST_LINES = 1_000_000
#: The file that a line comes from.
SOURCE = "source_file"


def raw_schema(columns: Sequence[str] = RAW_COLUMNS) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_raw(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    multi_line: bool = False,
    keep_malformed: bool = False,
) -> DataFrame:
    """Read order lines as text. Without ``columns`` the names come from the header line, so files
    with extra columns keep them. A missing field is NULL, a quoted empty one is ''.

    A file whose header differs from the others' fails the job, and so does a line with too few or
    too many fields; with ``keep_malformed`` such a line comes whole in the column MALFORMED, and every
    line with the path of its file in SOURCE.

    Leave ``multi_line`` off unless fields hold line breaks: such files cannot be split."""
    reader = spark.read.option("header", True).option("inferSchema", False)
    reader = reader.option("multiLine", multi_line).option("escape", '"')
    if columns is None:
        columns = reader.csv(path).columns
    schema = raw_schema([*columns, MALFORMED] if keep_malformed else columns)
    # Every header must have these names in this order.
    reader = reader.schema(schema).option("enforceSchema", False)
    reader = reader.option("mode", "PERMISSIVE" if keep_malformed else "FAILFAST")
    reader = reader.option("columnNameOfCorruptRecord", MALFORMED)
    # With the default null marker (the empty string) quoted empty fields would turn into NULL.
    reader = reader.option("nullValue", r"\N")
    lines = reader.csv(path)
    return lines.select("*", F.col("_metadata.file_path").alias(SOURCE)) if keep_malformed else lines


def write_raw(df: DataFrame, path: str, compression: str = "none") -> None:
    """Write order lines so that ``read_raw`` returns the same values, outer blanks included.

    Compressed files cannot be split, so they hold a million lines at most: no reader gets more in one piece."""
    writer = df.write.mode("overwrite")
    if compression != "none":
        writer = writer.option("compression", compression).option("maxRecordsPerFile", MOST_LINES)
    (
        writer
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
