"""Comparison of contact maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.operators.normalize import checkpointed


def with_rank(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with the average rank of a column, ties sharing their mean; nulls have none.

    Different values are counted first and dealt by ranges of the value; ranks follow from
    running sums inside a range and the totals of the ranges before it, so no task sorts
    the whole column.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count("*").alias("n"))
    ranged = checkpointed(counts.repartitionByRange("x").withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("range").agg(F.sum("n").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    upto = F.sum("n").over(Window.partitionBy("range").orderBy("x"))
    ranks = ranged.withColumn("upto", upto).join(F.broadcast(offsets), "range")
    ranks = ranks.select(F.col("x").alias(value), (F.col("offset") + F.col("upto") - (F.col("n") - 1) / 2).alias(name))
    return rows.join(ranks, value, "left")


def aligned_diagonals(first: DataFrame, second: DataFrame, bins: DataFrame, max_dist: int = 10, min_dist: int = 1) -> DataFrame:
    """(chrom, dist, i, a, b): cells of both maps per cis distance; zero where one map has none."""
    chrom = lambda side: bins.select(F.col("bin").alias(side), F.col("chrom").alias(f"c{side}"))
    a, b = first.select("i", "j", F.col("v").alias("a")), second.select("i", "j", F.col("v").alias("b"))
    near = lambda df: df.where((F.col("j") - F.col("i")).between(min_dist, max_dist))
    rows = near(a).join(near(b), ["i", "j"], "full").fillna(0, ["a", "b"])
    rows = rows.join(chrom("i"), "i").join(chrom("j"), "j").where("ci = cj")
    return rows.select(F.col("ci").alias("chrom"), (F.col("j") - F.col("i")).alias("dist"), "i", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))


def known_corr(a: Column, b: Column) -> Column:
    """Pearson's correlation over the rows with both values; null if one of them does not vary."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def _weighted_corr(a: str, b: str, n: str) -> Column:
    """Pearson's correlation of two columns with counts."""
    total = F.sum(n)
    mean = lambda c: F.sum(F.col(n) * c) / total
    x, y = F.col(a), F.col(b)
    cov = mean(x * y) - mean(x) * mean(y)
    var = (mean(x * x) - mean(x) * mean(x)) * (mean(y * y) - mean(y) * mean(y))
    return F.try_divide(cov, F.sqrt(F.when(var > 0, var)))


def by_distance(cells: DataFrame) -> DataFrame:
    """(dist, n, pearson, spearman) of aligned diagonals.

    Equal pairs of values are counted first; ranks are running sums over a distance's
    different values, which are few, since values are counts.
    """
    pairs = cells.groupBy("dist", "a", "b").agg(F.count("*").alias("n"))
    ranked = pairs
    for c in "ab":
        counts = pairs.groupBy("dist", c).agg(F.sum("n").alias("m"))
        upto = F.sum("m").over(Window.partitionBy("dist").orderBy(c))
        ranked = ranked.join(counts.select("dist", c, (upto - (F.col("m") - 1) / 2).alias(f"r{c}")), ["dist", c])
    return ranked.groupBy("dist").agg(F.sum("n").alias("n"), _weighted_corr("a", "b", "n").alias("pearson"), _weighted_corr("ra", "rb", "n").alias("spearman"))


def stratum_adjusted(cells: DataFrame) -> DataFrame:
    """One row scc, std: correlations per distance weighted by n and the deviations of the unit ranks.

    Unit ranks 1/n .. n/n have the variance (n + 1) / (12 n) whatever the values are, so
    the weight is (n + 1) / 12 and nothing is ranked.
    """
    strata = cells.groupBy("dist").agg(known_corr(F.col("a"), F.col("b")).alias("r"), ((F.count("*") + 1) / 12).alias("w"), F.count("*").alias("n"))
    strata = strata.where("r IS NOT NULL AND n > 1")
    return strata.agg(
        F.try_divide(F.sum(F.col("r") * F.col("w")), F.sum("w")).alias("scc"),
        F.sqrt(F.try_divide(F.sum(F.col("w") * F.col("w")) * F.var_samp("r"), F.sum("w") * F.sum("w"))).alias("std"),
    )


def _vector_pairs(key, v1, v2):
    """All pairs of the columns of two sets of vectors over the same bins."""
    import numpy as np
    import pandas as pd

    k = min(v1.shape[1], v2.shape[1])
    rows = []
    for x in range(k):
        for y in range(k):
            a, b = v1[:, x], v2[:, y]
            c = abs(float(np.corrcoef(a, b)[0, 1])) if a.std() > 0 and b.std() > 0 else None
            d = float(min(np.linalg.norm(a - b), np.linalg.norm(a + b)))
            rows.append((*key, x, y, c, d, float(1 / (a**4).sum()), float(1 / (b**4).sum())))
    return pd.DataFrame(rows, columns=["chrom", "x", "y", "corr", "distance", "ipr_a", "ipr_b"])


def _top_vectors(n: int, laplacian: bool):
    """From the cells of one chromosome."""
    import numpy as np

    from contactloom.functions.linear import dense, eigenvectors, normalized_laplacian

    def kernel(key, pdf):
        size = int(pdf["n"].iloc[0])
        m1, m2 = dense(pdf, size, "a"), dense(pdf, size, "b")
        used = (m1.sum(axis=0) > 0) & (m2.sum(axis=0) > 0)
        m1, m2 = m1[np.ix_(used, used)], m2[np.ix_(used, used)]
        if laplacian:
            m1, m2 = normalized_laplacian(m1), normalized_laplacian(m2)
        return _vector_pairs(key, eigenvectors(m1, n, smallest=laplacian), eigenvectors(m2, n, smallest=laplacian))

    return kernel


def _sparse_vectors(rows: DataFrame, n: int, laplacian: bool) -> DataFrame:
    """(chrom, idx, va, vb) over the bins that both maps of (chrom, i, j, a, b) use."""
    from contactloom.operators.normalize import checkpointed
    from contactloom.operators.spectral import leading_vectors

    sums = rows.groupBy("chrom", F.col("i").alias("idx")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    used = checkpointed(sums.where("a > 0 AND b > 0").select("chrom", "idx"))
    inner = rows.join(used.withColumnRenamed("idx", "i"), ["chrom", "i"]).join(used.withColumnRenamed("idx", "j"), ["chrom", "j"])
    kind, none = "laplacian" if laplacian else "map", F.array_repeat(F.lit(0.0), n)
    for side in ("a", "b"):
        cells = inner.where(F.col(side) != 0).select("chrom", "i", "j", F.col(side).alias("v"))
        used = used.join(leading_vectors(cells, n, kind).withColumnRenamed("vectors", f"v{side}"), ["chrom", "idx"], "left")
    return used.select("chrom", "idx", F.coalesce("va", none).alias("va"), F.coalesce("vb", none).alias("vb"))


def eigenvector_table(first: DataFrame, second: DataFrame, bins: DataFrame, n: int = 6, laplacian: bool = False, dense_limit: int = 4_000) -> DataFrame:
    """(chrom, x, y, corr, distance, ipr_a, ipr_b) of the leading eigenvectors of both maps, chromosome by chromosome.

    Maps of at most ``dense_limit`` bins are solved in a task; those of larger chromosomes stay
    sparse (see ``spectral``), and a task gets their vectors only.
    """
    from contactloom.shipping import ship

    place = bins.select(F.col("bin"), "chrom", "idx")
    size = bins.groupBy("chrom").agg(F.count("*").alias("n"))
    a, b = first.select("i", "j", F.col("v").cast("double").alias("a")), second.select("i", "j", F.col("v").cast("double").alias("b"))
    rows = a.join(b, ["i", "j"], "full").fillna(0.0, ["a", "b"])
    rows = rows.join(place.toDF("i", "ci", "x"), "i").join(place.toDF("j", "cj", "y"), "j").where("ci = cj")
    rows = rows.select(F.col("ci").alias("chrom"), F.col("x").alias("i"), F.col("y").alias("j"), "a", "b").join(size, "chrom")
    schema = f"chrom {dict(rows.dtypes)['chrom']}, x int, y int, corr double, distance double, ipr_a double, ipr_b double"
    found = ship(rows.where(F.col("n") <= dense_limit)).groupBy("chrom").applyInPandas(_top_vectors(n, laplacian), schema)
    if size.where(F.col("n") > dense_limit).isEmpty():
        return found

    def compared(key, pdf):
        import numpy as np

        pdf = pdf.sort_values("idx")
        return _vector_pairs(key, *(np.stack([np.asarray(v, dtype=float) for v in pdf[c]]) for c in ("va", "vb")))

    vectors = _sparse_vectors(rows.where(F.col("n") > dense_limit), n, laplacian)
    return found.unionByName(ship(vectors).groupBy("chrom").applyInPandas(compared, schema))


def reproducibility(first: DataFrame, second: DataFrame, bins: DataFrame, n: int = 20, min_ipr: float = 5.0, dense_limit: int = 4_000) -> DataFrame:
    """(chrom, score): 1 - distance of the Laplacian eigenvectors / sqrt(2), vectors on too few bins left out."""
    rows = eigenvector_table(first, second, bins, n, True, dense_limit).where(f"x = y AND ipr_a > {min_ipr} AND ipr_b > {min_ipr}")
    return rows.groupBy("chrom").agg((1 - F.avg("distance") / 2**0.5).alias("score"), F.count("*").alias("vectors"))


def structure_score(cells: DataFrame, bins: DataFrame, runs: int = 10) -> DataFrame:
    """(chrom, excess, skewness, kurtosis, n): a map's spectrum against maps with shuffled diagonals, one chromosome a task.

    ``excess`` is the mean of the leading eigenvalues beyond those of the shuffled
    maps, relative to their sum; skewness and kurtosis are those of the log values.
    """
    import numpy as np
    import pandas as pd

    from contactloom.operators.segment import _dense, chromosome_cells
    from contactloom.shipping import ship

    rows = chromosome_cells(cells, bins)
    chrom = dict(rows.dtypes)["chrom"]

    def kernel(key, pdf):
        m = _dense(pdf)
        n = len(m)
        spectrum = lambda x: np.sort(np.abs(np.linalg.eigvalsh((x + x.T) / 2)))[::-1]
        rng, random = np.random.default_rng(1), np.zeros(n)
        for _ in range(runs):
            x = np.zeros_like(m)
            for k in range(n):
                d = rng.permutation(np.diagonal(m, k))
                x[np.arange(n - k), np.arange(k, n)] = d
            random += spectrum(np.triu(x) + np.triu(x, 1).T) / runs
        real = spectrum(m)
        logs = np.log(m[np.triu_indices(n)][m[np.triu_indices(n)] > 0])
        z = (logs - logs.mean()) / (logs.std() or 1.0) if len(logs) else np.zeros(1)
        excess = float(np.maximum(real - random, 0).sum() / max(random.sum(), 1e-300))
        return pd.DataFrame([(key[0], excess, float((z**3).mean()), float((z**4).mean() - 3), n)], columns=["chrom", "excess", "skewness", "kurtosis", "n"])

    return ship(rows).groupBy("chrom").applyInPandas(kernel, f"chrom {chrom}, excess double, skewness double, kurtosis double, n long")
