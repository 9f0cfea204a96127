"""CSV and parquet tables with declared schemas and versioned snapshots."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.operators.clean import require_columns
from cohortspark.sources.guard import require_aggregates, small_cells


def _schema(**kinds) -> T.StructType:
    names = {"long": T.LongType(), "double": T.DoubleType(), "int": T.IntegerType(), "string": T.StringType()}
    return T.StructType([T.StructField(n, names[k]) for n, k in kinds.items()])


# Input columns; all times are minutes on a clock per subject.
OPERATIONS = _schema(
    subject_id="long", op_id="long", age="double", sex="string", height="double", weight="double",
    emop="int", department="string", antype="string", asa="int", orin_time="double",
    orout_time="double", anstart_time="double", anend_time="double", opstart_time="double",
    opend_time="double", icuin_time="double", icuout_time="double", inhosp_death_time="double",
    allcause_death_time="double",
)
MEASUREMENTS = _schema(subject_id="long", item_name="string", chart_time="double", value="double")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; without a schema the types are inferred by a scan."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.option("enforceSchema", False).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, columns: list[str] = ()) -> DataFrame:
    return require_columns(spark.read.parquet(path), list(columns))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A named parquet table below a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


@dataclass(frozen=True)
class Snapshots:
    """Versioned parquet snapshots; private rows and shareable results apart."""

    private_root: str
    shareable_root: str

    def path(self, name: str, version: int) -> str:
        return f"{self.private_root}/{name}/version={version:02d}"

    def write(self, df: DataFrame, name: str, version: int) -> str:
        """Row-level data stays under the private root."""
        target = self.path(name, version)
        df.write.mode("overwrite").parquet(target)
        return target

    def read(self, spark: SparkSession, name: str, version: int) -> DataFrame:
        return spark.read.parquet(self.path(name, version))

    def write_bucketed(self, df: DataFrame, name: str, version: int, *, key: str, time: str, buckets: int) -> str:
        """Rows dealt by ``key`` into ``buckets`` files and sorted by key and time inside each.

        Joins and groupings by the key read them back without a shuffle
        (``read_bucketed``), so a table that is joined again and again is shuffled once. A key with very many
        rows lies in one file, as in any layout by key; the balanced joins spread such keys by salt after reading.
        """
        spark, target = df.sparkSession, self.path(name, version)
        held = f"layout_{uuid.uuid4().hex}"
        (df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key, time)
         .option("path", target).saveAsTable(held))
        spark.sql(f"DROP TABLE {held}")     # the files stay
        spec = spark.range(1).select(F.lit(key).alias("key"), F.lit(time).alias("time"), F.lit(buckets).alias("buckets"))
        spec.coalesce(1).write.mode("overwrite").json(self._layout(name, version))
        return target

    def _layout(self, name: str, version: int) -> str:
        return f"{self.private_root}/{name}/layout={version:02d}"

    def read_bucketed(self, spark: SparkSession, name: str, version: int) -> DataFrame:
        """A bucketed snapshot with the layout it was written in, in any session."""
        spec = spark.read.json(self._layout(name, version)).first()
        path = self.path(name, version)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        held = f"layout_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {held} ({columns}) USING parquet CLUSTERED BY (`{spec['key']}`) "
                  f"SORTED BY (`{spec['key']}`, `{spec['time']}`) INTO {spec['buckets']} BUCKETS LOCATION '{path}'")
        return spark.table(held)

    def share(self, df: DataFrame, name: str, *, count: str | None = None, least: int = 1,
              extremes: bool = True) -> str:
        """Aggregated results go to the shareable root as CSV; rows are refused.

        ``guard.row_paths`` tells what counts as rows. ``count`` names the column of
        subjects behind each line: a line of fewer than ``least`` is refused, too.
        """
        require_aggregates(df, extremes=extremes)
        if count is not None and not small_cells(df, count, least).isEmpty():
            raise PermissionError(f"{name}: lines of fewer than {least} subjects")
        target = f"{self.shareable_root}/{name}"
        write_csv(df, target)
        return target
