"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.operators.pixels import dense_rows


def write_sparse(cells: DataFrame, path: str) -> None:
    """``bin1 bin2 value`` text; one file a task, no global sort."""
    cells.select(F.concat_ws("\t", "i", "j", "v").alias("value")).write.mode("overwrite").text(path)


def write_dense(cells: DataFrame, bins: DataFrame, path: str) -> None:
    """Rows with ``chrom start-end`` names, in bin order.  The number of bins must suit a dense text."""
    n = bins.count()
    rows = dense_rows(cells.sparkSession, cells, n).join(bins, F.col("i") == F.col("bin"))
    name = F.concat("chrom", F.lit("\t"), F.col("start") + 1, F.lit("-"), "end")
    line = F.concat(name, F.lit("\t"), F.concat_ws("\t", F.transform("row", lambda v: v.cast("string"))))
    rows.repartitionByRange("i").sortWithinPartitions("i").select(line.alias("value")).write.mode("overwrite").text(path)


def write_coordinates(cells: DataFrame, bins: DataFrame, path: str) -> None:
    """``chrom:start-end`` pairs with their value."""
    place = lambda s: bins.select(F.col("bin").alias(s), F.concat("chrom", F.lit(":"), F.col("start") + 1, F.lit("-"), "end").alias(f"name_{s}"))
    rows = cells.join(place("i"), "i").join(place("j"), "j")
    rows.select("name_i", "name_j", "v").write.mode("overwrite").option("sep", "\t").csv(path)


def write_tables(path: str, **tables: DataFrame) -> None:
    """Named tables as Parquet below one folder: biases, decay, bad bins, or a map with its chromosomes and bins."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def read_tables(spark, path: str, *names: str, resolution: int | None = None) -> dict[str, DataFrame]:
    """Tables written by ``write_tables``; a stored resolution that differs raises."""
    found = {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}
    if resolution is not None:
        stored = spark.read.parquet(f"{path.rstrip('/')}/settings").first()["resolution"]
        if stored != resolution:
            raise ValueError(f"stored resolution {stored} is not {resolution}")
    return found


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Pairs by chromosome, sorted by position inside a file, so that region queries prune folders and row groups."""
    pairs.repartition("c1").sortWithinPartitions("c1", "p1").write.mode("overwrite").partitionBy("c1").parquet(path)


def write_domains(domains: DataFrame, path: str) -> None:
    """1-based tab-separated domains."""
    one = [F.col(c) + 1 if c in ("start", "end") else F.col(c) for c in domains.columns]
    domains.select(*[c.alias(n) for c, n in zip(one, domains.columns, strict=True)]).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


write_compartments = write_domains


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def map_json(cells: DataFrame, **about) -> DataFrame:
    """One JSON text per row bin: a viewer's rows, with the description."""
    row = F.sort_array(F.collect_list(F.struct("j", "v"))).alias("cells")
    return cells.groupBy("i").agg(row).select(F.to_json(F.struct("i", "cells", *[F.lit(v).alias(k) for k, v in about.items()])).alias("value"))


def xyz_lines(particles: DataFrame) -> DataFrame:
    """(model, value): XYZ lines."""
    line = F.format_string("p%d\t%d\t%.3f\t%.3f\t%.3f", F.col("particle") + 1, F.col("particle") + 1, "x", "y", "z")
    return particles.select("model", line.alias("value"))


def cmm_text(particles: DataFrame, radius: float) -> DataFrame:
    """(model, value): marker XML per model, with links between neighbours."""
    mark = F.format_string(f'<marker id="%d" x="%.3f" y="%.3f" z="%.3f" radius="{radius}"/>', F.col("particle") + 1, "x", "y", "z")
    link = F.format_string('<link id1="%d" id2="%d" radius="1"/>', F.col("particle"), F.col("particle") + 1)
    rows = particles.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("particle", mark.alias("m"), link.alias("l")))).alias("p"))
    marks, links = F.concat_ws("\n", F.transform("p", lambda x: x["m"])), F.concat_ws("\n", F.transform(F.expr("slice(p, 2, size(p))"), lambda x: x["l"]))
    return rows.select("model", F.concat(F.lit('<marker_set name="'), "model", F.lit('">\n'), marks, F.lit("\n"), links, F.lit("\n</marker_set>")).alias("value"))


def write_text(rows: DataFrame, path: str) -> None:
    """``value`` text, one folder per model if there are models."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy("model") if "model" in rows.columns else writer).text(path)


def synthetic_reads(cells: DataFrame, resolution: int) -> DataFrame:
    """Pairs that bin to the map: each count of the upper triangle becomes a row."""
    rows = cells.where("i <= j AND v >= 1").select("i", "j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("v").cast("long"))).alias("k"))
    name = F.concat_ws("_", "i", "j", "k")
    return rows.select(name.alias("read_id"), (F.col("i") * resolution + 1).alias("p1"), (F.col("j") * resolution + 1).alias("p2"))
