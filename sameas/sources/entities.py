"""Entity tables and the folder layouts they come in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from sameas.sources.lines import csv_records

# Names in a dataset folder.
ID_COLUMN = "subject_id"
GOLD_FILES = {"train": "gs_train.csv", "val": "gs_val.csv", "test": "gs_test.csv"}
CUSTOM_FOLDER = "custom_dataset"
CUSTOM_A, CUSTOM_B = "1_custom.csv", "2_custom.csv"

QUOTES = {"quote": '"', "escape": '"'}


def _csv(spark: SparkSession, path: str, encoding: str, line_breaks: bool) -> DataFrame:
    return spark.read.options(header=True, encoding=encoding, multiLine=line_breaks, **QUOTES).csv(path)


def read_entities(spark: SparkSession, path: str, id_col: str = ID_COLUMN, as_id: str = "id") -> DataFrame:
    """CSV (all columns text, as spelled) or parquet, by the ending of `path`. A CSV is
    read in splits, with quoted line breaks put together again across them; one that is not
    UTF-8 is Latin-1. Every file has the header of the first; empty lines are skipped."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        records, encoding = csv_records(spark, path)
        columns = _csv(spark, path, encoding, True).columns      # reads the first record
        rows = records.filter((F.col("record") > 0) & (F.trim("text") != ""))
        kinds = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
        df = rows.select(F.from_csv("text", kinds, QUOTES).alias("row")).select("row.*")
    return df.withColumnRenamed(id_col, as_id)


def list_columns(df: DataFrame, id_col: str = "id") -> list[str]:
    return [c for c in df.columns if c != id_col]


@dataclass(frozen=True)
class Layout:
    table_a: str
    table_b: str
    gold: dict[str, str]

    @property
    def self_linkage(self) -> bool:
        return self.table_a == self.table_b


def _listing(spark: SparkSession, folder: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(status.getPath().getName() for status in system.listStatus(path))


def resolve_layout(spark: SparkSession, folder: str) -> Layout:
    """Which files of a dataset folder are the tables and the labelled pairs.

    `custom_dataset` holds 1_custom.csv and 2_custom.csv; a folder with one CSV
    beside the pair files links it with itself; a folder 'x-y' has 1_x.csv and 2_y.csv.
    """
    folder = folder.rstrip("/")
    name, files = folder.rsplit("/", 1)[-1], _listing(spark, folder)
    tables = [f for f in files if f.endswith(".csv") and not f.startswith("gs")]
    gold = {split: f"{folder}/{f}" for split, f in GOLD_FILES.items() if f in files}
    if name == CUSTOM_FOLDER:
        return Layout(f"{folder}/{CUSTOM_A}", f"{folder}/{CUSTOM_B}", gold)
    if len(tables) == 1:
        return Layout(f"{folder}/{tables[0]}", f"{folder}/{tables[0]}", gold)
    first, second = name.split("-")[:2]
    return Layout(f"{folder}/1_{first}.csv", f"{folder}/2_{second}.csv", gold)


def write_tables(a: DataFrame, b: DataFrame, folder: str) -> None:
    """Both tables as parquet, ids in the column `subject_id`."""
    for df, name in ((a, "table_a"), (b, "table_b")):
        df.withColumnRenamed("id", ID_COLUMN).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
