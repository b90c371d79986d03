"""Scans of series from text files, sources of random walks, views of relational tables as series, and model tables on disk.

Readers keep file order as series_id where the order carries meaning; it comes from one ordered index pass over lines, not from one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.functions.series import derivative, znorm


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line: lines in file order, numbered across partitions by zipWithIndex."""
    rows = spark.read.text(path).rdd.zipWithIndex().map(lambda p: (p[1], p[0][0]))
    return spark.createDataFrame(rows, "line_no long, line string")


def numbers(fields: Column) -> Column:
    """The fields that are numbers; empty ones, NaN and what can't be read are dropped."""
    parsed = F.transform(F.filter(fields, lambda f: ~F.trim(f).isin("", "NaN", "\t")), lambda f: F.trim(f).try_cast("double"))
    return F.filter(parsed, lambda x: x.isNotNull() & ~F.isnan(x))


def labelled_text(spark: SparkSession, path: str, z_norm: bool = True) -> DataFrame:
    """A1: series_id, label, values: one series a line, label first; comma or spaces; lines of "@" are comments."""
    rows = numbered_lines(spark, path).filter(~F.col("line").startswith("@"))
    rows = rows.withColumn("x", numbers(F.split("line", F.when(F.col("line").contains(","), F.lit(",")).otherwise(F.lit(" ")))))
    rows = rows.filter(F.size("x") > 1)
    values = F.slice("x", F.lit(2), F.size("x") - 1)
    out = rows.select("line_no", F.col("x")[0].alias("label"), (znorm(values) if z_norm else values).alias("values"))
    return _renumbered(out, "line_no")


def _renumbered(rows: DataFrame, order: str) -> DataFrame:
    """series_id from 0 in the given order: ranks within ranges of lines plus the sizes of the ranges before."""
    part = rows.withColumn("_part", F.floor(F.col(order) / 10_000))
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return part.withColumn("_rank", rank).join(before, "_part").withColumn("series_id", F.col("before") + F.col("_rank")).drop("_part", "_rank", "before", order).select("series_id", *[c for c in rows.columns if c != order])


def multivariate_text(spark: SparkSession, path: str, derivatives: bool = False) -> DataFrame:
    """series_id, dim, label, values: "id time label d1 d2 ..." a line; a new sample where the id changes; the time is ignored."""
    rows = numbered_lines(spark, path).withColumn("f", F.split(F.trim("line"), " +")).filter(F.size("f") > 3)
    rows = rows.select("line_no", F.col("f")[0].alias("file_id"), F.col("f")[2].cast("double").alias("label"), numbers(F.slice("f", F.lit(4), F.size("f") - 3)).alias("x"))
    w = Window.partitionBy(F.lit(0)).orderBy("line_no")
    start = (F.lag("file_id").over(w).isNull() | (F.lag("file_id").over(w) != F.col("file_id"))).cast("int")
    rows = rows.withColumn("start", start).withColumn("series_id", F.sum("start").over(w) - 1)
    long = rows.select("series_id", "line_no", "label", F.posexplode("x").alias("dim", "v"))
    out = long.groupBy("series_id", "dim").agg(F.min_by("label", "line_no").alias("label"), F.transform(F.sort_array(F.collect_list(F.struct("line_no", "v"))), lambda r: r["v"]).alias("values"))
    return with_derivatives(out) if derivatives else out


def with_derivatives(rows: DataFrame) -> DataFrame:
    """One more dimension for each: the absolute differences, numbered after all given ones."""
    dims = rows.groupBy("series_id").agg(F.count(F.lit(1)).cast("int").alias("dims"))
    more = rows.join(dims, "series_id").select("series_id", (F.col("dim") + F.col("dims")).alias("dim"), "label", derivative(F.col("values")).alias("values"))
    return rows.select("series_id", "dim", "label", "values").unionByName(more)


def arff_text(spark: SparkSession, path: str, derivatives: bool = False) -> DataFrame:
    """A3: series_id, dim, label, values. Dimensions are parted by a written backslash-n, "?" is missing; string labels become 1, 2, ... in order of
    first sight."""
    rows = numbered_lines(spark, path).filter(~F.col("line").contains("@") & ~F.col("line").contains("%") & (F.trim("line") != ""))
    body, name = F.regexp_extract("line", r"^'(.*)',\s*(.*)$", 1), F.regexp_extract("line", r"^'(.*)',\s*(.*)$", 2)
    rows = rows.select("line_no", F.trim(name).alias("name"), F.split(body, r"\\n").alias("dims"))
    names = rows.groupBy("name").agg(F.min("line_no").alias("first"))
    labels = names.select("name", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first")).cast("double").alias("label"))  # one row a label
    out = _renumbered(rows.join(F.broadcast(labels), "name").select("line_no", "label", "dims"), "line_no")
    out = out.select("series_id", "label", F.posexplode("dims").alias("dim", "d")).select("series_id", "dim", "label", numbers(F.split("d", ",")).alias("values"))
    out = out.filter(F.size("values") > 0)
    return with_derivatives(out) if derivatives else out


def single_column_text(spark: SparkSession, path: str) -> DataFrame:
    """A4: one long series: the first number of each line."""
    rows = numbered_lines(spark, path).select("line_no", numbers(F.split(F.trim("line"), r"\s+")).alias("x")).filter(F.size("x") > 0)
    one = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", F.col("x")[0].alias("v")))), lambda r: r["v"]).alias("values"))
    return one.select(F.lit(0).cast("long").alias("series_id"), F.lit(None).cast("double").alias("label"), "values")


def query_text(spark: SparkSession, path: str) -> DataFrame:
    """A5: one unlabelled series a line, not normalised."""
    rows = numbered_lines(spark, path).select("line_no", numbers(F.split("line", r"[ ,]+")).alias("values")).filter(F.size("values") > 0)
    return _renumbered(rows, "line_no").withColumn("label", F.lit(None).cast("double"))


def random_walks(spark: SparkSession, count: int, length: int, seed: int = 1) -> DataFrame:
    """Gaussian start and steps."""
    steps = spark.range(count).select(F.col("id").alias("series_id"), *[F.randn(seed + i).alias(f"s{i}") for i in range(length)])
    raw = F.array(*[f"s{i}" for i in range(length)])
    walk = F.aggregate(raw, F.array().cast("array<double>"), lambda a, s: F.concat(a, F.array(F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1), F.lit(0.0)) + s)))
    return steps.select("series_id", F.lit(None).cast("double").alias("label"), walk.alias("values"))


def save_model(tables: dict[str, DataFrame], path: str) -> None:
    """A model is a folder of Parquet tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


# ---- views of the relational tables -------------------------------------------------------------


def ordered_values(rows: DataFrame, by: list[str], order: list[str], value: Column) -> DataFrame:
    """by, values: each group's values in order. A series is a record of bounded length."""
    packed = F.sort_array(F.collect_list(F.struct(*order, value.alias("_v"))))
    return rows.groupBy(*by).agg(F.transform(packed, lambda r: r["_v"]).alias("values"))


def fixed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, label, values of the embeddings."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("series_id"), F.col("label").cast("double").alias("label"), F.col("embedding").cast("array<double>").alias("values"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, label (user_id % 2), values of the events in time order."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value")
    out = ordered_values(rows, ["user_id"], ["ts", "event_id"], F.col("value"))
    return out.select(F.col("user_id").alias("series_id"), (F.col("user_id") % 2).cast("double").alias("label"), "values")


def part_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, dim, label (series_id % 3), values: quantity, price and discount of each part's line items, in order; one shuffle for all."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    packed = F.sort_array(F.collect_list(F.struct("l_shipdate", "l_orderkey", "l_linenumber", F.array("l_quantity", "l_extendedprice", "l_discount").alias("v"))))
    out = rows.groupBy(F.col("l_partkey").alias("series_id")).agg(packed.alias("p"))
    out = out.select("series_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("dim"), "p")
    return out.select("series_id", "dim", (F.col("series_id") % 3).cast("double").alias("label"), F.transform("p", lambda r: F.get(r["v"], F.col("dim"))).alias("values"))
