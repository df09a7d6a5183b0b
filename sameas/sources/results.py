"""Result files, run metrics and the bookkeeping of grid runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Header of an exported result file, and dataset names.
EXPORT_COLUMNS = {"a_id": "Entity A", "b_id": "Entity B", "score": "Score"}
DATASETS = ["abt-buy", "amazon-google", "fodors-zagats", "walmart-amazon", "wdc_xlarge_cameras",
            "wdc_xlarge_computers", "custom_dataset"]
RESULT_NAME = r"^results_(.+)\.csv$"
RUN_METRICS = ["Accuracy", "Precision", "Recall", "F1"]


def export_form(scored: DataFrame) -> DataFrame:
    return scored.select(*[F.col(c).alias(name) for c, name in EXPORT_COLUMNS.items()])


def export_results(scored: DataFrame, path: str) -> None:
    export_form(scored).write.mode("overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    back = {name: c for c, name in EXPORT_COLUMNS.items()}
    df = spark.read.option("header", True).csv(path).select(*back)
    return df.toDF(*back.values()).withColumn("score", F.col("score").cast("double"))


def dataset_name(file_name: Column, known: Sequence[str] = tuple(DATASETS)) -> Column:
    """Dataset of a result file name, null if it is not one of the known ones."""
    base = F.element_at(F.split(file_name, "/"), -1)
    name = F.regexp_extract(base, RESULT_NAME, 1)
    return F.when(name.isin(list(known)), name)


def write_run_metric(spark: SparkSession, path: str, run: str, seconds: float) -> None:
    """Append one timing to the run table."""
    spark.createDataFrame([(run, float(seconds))], "run string, seconds double").write.mode("append").parquet(path)


def run_time(runs: DataFrame) -> DataFrame:
    """Mean seconds per run name."""
    return runs.groupBy("run").agg(F.avg("seconds").alias("mean_seconds"), F.count(F.lit(1)).alias("n"))


def read_run_metrics(spark: SparkSession, path: str, method: str) -> DataFrame:
    """A JSON file of finished metrics as one summary row."""
    found = spark.read.option("multiLine", True).json(path)
    return found.select(F.lit(method).alias("method"), *[F.col(m).cast("double").alias(m.lower()) for m in RUN_METRICS])


def write_summary(summary: DataFrame, path: str) -> None:
    """A few rows: one file."""
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def pending(grid: DataFrame, done: DataFrame, config: Sequence[str]) -> DataFrame:
    """Configurations of the grid without a result yet."""
    return grid.join(done.select(*config).distinct(), list(config), "left_anti")


def write_cell(rows: DataFrame, path: str, cell: dict) -> None:
    """The rows of one grid cell as a partition of its own, which replaces what stands
    there; other cells are not touched, and a cell is there whole or not at all."""
    marked = rows.select("*", *[F.lit(v).alias(c) for c, v in cell.items()])
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*cell).parquet(path)


def read_cells(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The finished cells, none where nothing was written yet. `schema` is that of the rows and the cell."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_grid(grid: DataFrame, run: Callable[[dict], DataFrame], path: str, schema: str, most: int | None = None) -> DataFrame:
    """Runs the cells of `grid` (a small table, a row per cell) that have no result under
    `path` yet, one after another, at most `most` of them, and returns all finished
    rows. A run that broke off is resumed by calling it again."""
    spark, config = grid.sparkSession, grid.columns
    waiting = pending(grid, read_cells(spark, path, schema), config).orderBy(*config)
    for cell in (waiting if most is None else waiting.limit(most)).collect():
        write_cell(run(cell.asDict()), path, cell.asDict())
    return read_cells(spark, path, schema)


def option_grid(spark: SparkSession, options: dict[str, Sequence]) -> DataFrame:
    """Every combination of the given option values."""
    grid = spark.range(1).drop("id")
    for name, values in options.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return grid
