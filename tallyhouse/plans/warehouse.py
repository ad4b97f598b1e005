"""The layers as tables: bronze (raw text), silver (clean lines), gold (star schema).

Every build writes to a folder of its own under the root and counts only when it is complete: a row in the
table of builds, which Spark adds in one step, makes it the current one. Until then, and if it fails or is
killed, readers and published tables keep the build before."""

import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from copy import copy
from threading import RLock

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyhouse.plans import gold, silver
from tallyhouse.plans.quality import quality_report
from tallyhouse.sources.raw_csv import read_raw
from tallyhouse.sources.shared import SharedFolder, shares

# Namespaces and tables.
BRONZE = "bronze/sales_lines"
REJECTED = "bronze/rejected_lines"
SILVER = "silver/sales"
GOLD = ("dim_customer", "dim_product", "dim_geography", "dim_date", "fact_sales")
BUILDS = "complete_builds"
TABLES = (BRONZE, SILVER, *(f"gold/{t}" for t in GOLD))
FACT = "gold/fact_sales"
# In how many shares at most the fact is built: its lines are read in a few columns, so a share costs little.
FACT_SHARES = 3
# Whether the catalog keeps a list of a table's folders.
_LISTED = "spark.sql.hive.manageFilesourcePartitions"


class QualityError(ValueError):
    """``failed`` names the checks."""

    def __init__(self, failed: list[str]):
        super().__init__(f"quality checks failed: {', '.join(failed)}")
        self.failed = failed


class Warehouse:
    """Builds each layer from the one before it and reads it back as a parquet table.

    Tables are built on first use, so a query that needs only bronze builds only bronze.
    """

    def __init__(
        self,
        root: str,
        bronze: Callable[[], DataFrame],
        lenient: bool = False,
        date_formats: Sequence[str] = silver.DATE_FORMATS,
    ):
        self.folder = SharedFolder(root, lean=True)
        self.lenient = lenient
        self.date_formats = tuple(date_formats)
        self.build_path = f"builds/{uuid.uuid4().hex}"
        self._source = bronze
        self._tables: dict[str, DataFrame] = {}
        self._days: tuple[str, str] | None = None
        self._building = RLock()

    @classmethod
    def from_csv(
        cls,
        spark: SparkSession,
        csv_path: str,
        root: str,
        lenient: bool = False,
        date_formats: Sequence[str] = silver.DATE_FORMATS,
    ) -> "Warehouse":
        """With ``lenient``, lines that are malformed or do not fit their types end up in
        ``rejected`` instead of failing the job. Dates are ISO or one of ``date_formats``."""
        return cls(root, lambda: read_raw(spark, csv_path, keep_malformed=lenient), lenient, date_formats)

    @classmethod
    def opened(cls, spark: SparkSession, root: str) -> "Warehouse":
        """The last complete build under ``root``."""
        house = cls(root, lambda: house.bronze)
        builds = house.folder.read(spark, BUILDS)
        house.build_path = builds.orderBy(F.desc("finished"), "path").first()["path"]
        house._tables = {t: house.folder.read(spark, f"{house.build_path}/{t}") for t in TABLES if t != FACT}
        house._tables[FACT] = house.folder.read(spark, f"{house.build_path}/{FACT}", house._new_fact(house.silver).schema)
        return house

    def period(self, first_day: str, last_day: str) -> "Warehouse":
        """The same tables, but of the fact only the lines of these days, both included: every report
        on it reads the years of the period. For reports; checks compare whole tables."""
        part = copy(self)
        part._days = (first_day, last_day)
        return part

    @property
    def bronze(self) -> DataFrame:
        return self._table(BRONZE, self._source)

    @property
    def silver(self) -> DataFrame:
        return self._table_of_parts(
            SILVER,
            lambda: [
                silver.silver_sales(self._accepted(lines), self.date_formats)
                for lines in shares(self.bronze, silver.LINE_KEY)
            ],
        )

    def _accepted(self, bronze: DataFrame) -> DataFrame:
        return silver.castable(bronze, self.date_formats)[0] if self.lenient else bronze

    @property
    def rejected(self) -> DataFrame:
        """Raw lines that silver leaves out, with the columns at fault."""
        return self._table(REJECTED, lambda: silver.castable(self.bronze, self.date_formats)[1])

    @property
    def dim_customer(self) -> DataFrame:
        return self._table("gold/dim_customer", lambda: gold.dim_customer(self.silver))

    @property
    def dim_product(self) -> DataFrame:
        return self._table("gold/dim_product", lambda: gold.dim_product(self.silver, self.folder))

    @property
    def dim_geography(self) -> DataFrame:
        return self._table(
            "gold/dim_geography", lambda: gold.dim_geography(self.silver, self.folder)
        )

    @property
    def dim_date(self) -> DataFrame:
        return self._table("gold/dim_date", lambda: gold.dim_date(self.silver))

    @property
    def fact_sales(self) -> DataFrame:
        with self._building:
            if FACT not in self._tables:
                parts = [self._new_fact(lines) for lines in shares(self.silver, silver.LINE_KEY, FACT_SHARES)]
                self._tables[FACT] = self.folder.replace_partitioned(
                    parts, f"{self.build_path}/{FACT}", gold.YEAR, gold.CLUSTERED
                )
        fact = self._tables[FACT]
        if self._days is None:
            return fact
        return gold.within(fact, *[F.lit(day).cast("date") for day in self._days])

    def _new_fact(self, lines: DataFrame) -> DataFrame:
        return gold.with_year(gold.fact_sales(lines, self.dim_geography, self.dim_product))

    def __getitem__(self, table: str) -> DataFrame:
        """A table by name: bronze, silver or one of the gold tables."""
        return getattr(self, table)

    def _table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return self._table_of_parts(name, lambda: [make()])

    def _table_of_parts(self, name: str, make: Callable[[], list[DataFrame]]) -> DataFrame:
        with self._building:
            if name not in self._tables:
                self._tables[name] = self.folder.replace_by_parts(make(), f"{self.build_path}/{name}")
            return self._tables[name]

    def build(self, check: bool = False) -> "Warehouse":
        """Build every layer, dimensions before the fact table, and make this build the current one;
        with ``check``, bad data is refused before that."""
        for name in ("bronze", "silver", *GOLD, *(["rejected"] if self.lenient else [])):
            self[name]
        if check:
            self.check()
        spark = self.bronze.sparkSession
        done = spark.range(1).select(F.lit(self.build_path).alias("path"), F.lit(time.time_ns()).alias("finished"))
        done.coalesce(1).write.mode("append").parquet(f"{self.folder.root}/{BUILDS}")
        return self

    def check(self, expected_rows: Mapping[str, int] | None = None) -> None:
        """Raise QualityError, naming the checks that fail."""
        failed = quality_report(self, expected_rows).filter(~F.coalesce("passed", F.lit(False)))
        names = sorted(row["check"] for row in failed.collect())  # at most one row per check
        if names:
            raise QualityError(names)

    def publish(self, spark: SparkSession, expected_rows: Mapping[str, int] | None = None) -> None:
        """Name the tables in the session catalog: bronze.*, silver.*, gold.*.

        Refused if a check fails, or if one of the names is taken by a table of somewhere else."""
        self.check(expected_rows)
        foreign = [t for t in TABLES if not self._ours(spark, t.replace("/", "."))]
        if foreign:
            raise ValueError(f"the catalog has other tables of these names: {', '.join(foreign)}")
        for table in TABLES:
            layer, name = table.split("/")
            spark.sql(f"CREATE SCHEMA IF NOT EXISTS {layer}")
            path = f"{self.folder.root}/{self.build_path}/{table}".replace("'", "\\'")
            full = f"{layer}.{name}"
            if spark.catalog.tableExists(full) and spark.table(full).schema == self._tables[table].schema:
                # Readers see the old build or the new one, never none.
                spark.sql(f"ALTER TABLE {full} SET LOCATION '{path}'")
                spark.catalog.refreshTable(full)
            else:
                spark.sql(f"DROP TABLE IF EXISTS {full}")
                self._create(spark, full, table, path)

    def _create(self, spark: SparkSession, full: str, table: str, path: str) -> None:
        """The fact's folders are found by looking, not listed in the catalog: one change of the location
        then moves all of them."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._tables[table].schema)
        folders = f"PARTITIONED BY ({gold.YEAR})" if table == FACT else ""
        listed = spark.conf.get(_LISTED)
        spark.conf.set(_LISTED, "false")
        try:
            spark.sql(f"CREATE TABLE {full} ({columns}) USING parquet {folders} LOCATION '{path}'")
        finally:
            spark.conf.set(_LISTED, listed)

    def _ours(self, spark: SparkSession, table: str) -> bool:
        """Whether there is no such table, or it lies under this root."""
        if not spark.catalog.tableExists(table):
            return True
        about = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'").first()
        plain = lambda path: path.removeprefix("file:").replace("//", "/").rstrip("/")
        return about is not None and plain(about.data_type).startswith(f"{plain(self.folder.root)}/")
