"""Leading eigenvectors of sparse chromosome maps by restarted block Krylov iteration.

The map stays a table of cells.  A step multiplies it with a block of vectors, one join on bins and one
aggregate per row; what makes the matrix dense is kept out of it: the centring and scaling of a
correlation matrix are rank-one terms and factors per bin, and the normalised Laplacian's are factors too.

    correlation   Z Z' with Z = D (M - mu 1'), so Z'X = M (D X) - 1 (mu' D X), and Z W = D (M W - mu (1' W))
    laplacian     I + D M D, whose largest eigenvectors are the smallest of I - D M D
    map           M

The blocks span a Krylov space, made orthogonal chromosome by chromosome: a task holds a chromosome's
vectors (bins x a few dozen numbers), never its map.  The eigenvectors of the
matrix in that space start the next cycle until their residuals are small.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.operators.normalize import MAX_BROADCAST_BINS, shared_folder
from contactloom.shipping import ship

KINDS = ("correlation", "laplacian", "map")
#: Vectors of a block beside those that are asked for.
EXTRA = 4
#: Multiplications of a cycle.
STEPS = 8
CYCLES = 40
TOLERANCE = 1e-6


def _stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the session's shared checkpoint folder.

    A checkpoint keeps the planner's estimate of its size, and the products of estimates over
    many rounds of joins take longer than the joins; a table that is read again has its true size.
    """
    path = f"{shared_folder(df.sparkSession)}/vectors-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _factors(cells: DataFrame, kind: str) -> DataFrame:
    """(chrom, idx, d, mu) of every bin with contacts: its factor and the mean of its row."""
    sums = cells.groupBy("chrom", F.col("i").alias("idx")).agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    used = sums.where("s > 0")
    if kind != "correlation":
        factor = F.lit(1.0) if kind == "map" else 1 / F.sqrt("s")
        return used.select("chrom", "idx", factor.alias("d"), F.lit(0.0).alias("mu"))
    size = used.groupBy("chrom").agg(F.count("*").alias("n"))
    mu = F.col("s") / F.col("n")
    spread = F.col("q") - F.col("n") * mu * mu
    # A constant row has no correlation; rounding leaves it a little above or below zero.
    factor = F.when(spread > 1e-12 * F.col("q"), 1 / F.sqrt(spread)).otherwise(0.0)
    return used.join(size, "chrom").select("chrom", "idx", factor.alias("d"), mu.alias("mu"))


def _product(cells: DataFrame, block: DataFrame, width: int, small: bool) -> DataFrame:
    """(chrom, idx, y): the map times the block (chrom, idx, x), as arrays; rows without cells are left out."""
    right = block.select("chrom", F.col("idx").alias("j"), "x")
    right = F.broadcast(right) if small else right
    sums = [F.sum(F.col("v") * F.col("x")[k]).alias(f"y{k}") for k in range(width)]
    return cells.join(right, ["chrom", "j"]).groupBy("chrom", F.col("i").alias("idx")).agg(*sums).select("chrom", "idx", F.array(*[f"y{k}" for k in range(width)]).alias("y"))


def _totals(block: DataFrame, width: int, weight: str | None) -> DataFrame:
    """(chrom, t): the block's weighted column sums."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    sums = [F.sum(w * F.col("x")[k]).alias(f"t{k}") for k in range(width)]
    return block.groupBy("chrom").agg(*sums).select("chrom", F.array(*[f"t{k}" for k in range(width)]).alias("t"))


def _per_element(width: int, element) -> F.Column:
    return F.array(*[element(k) for k in range(width)])


def _image(cells: DataFrame, factors: DataFrame, block: DataFrame, kind: str, width: int, small: bool) -> DataFrame:
    """(chrom, idx, y): the matrix of this kind times the block."""
    known = block.join(factors, ["chrom", "idx"])
    scaled = known.withColumn("x", _per_element(width, lambda k: F.col("d") * F.col("x")[k]))
    if kind != "correlation":
        product = _product(cells, scaled.select("chrom", "idx", "x"), width, small)
        rows = known.join(product, ["chrom", "idx"])
        shift = 1.0 if kind == "laplacian" else 0.0
        return rows.select("chrom", "idx", _per_element(width, lambda k: shift * F.col("x")[k] + F.col("d") * F.col("y")[k]).alias("y"))
    product = _product(cells, scaled.select("chrom", "idx", "x"), width, small)
    middle = factors.join(product, ["chrom", "idx"]).join(_totals(scaled, width, "mu"), "chrom")
    middle = _stored(middle.select("chrom", "idx", "d", "mu", _per_element(width, lambda k: F.col("y")[k] - F.col("t")[k]).alias("x")))
    product = _product(cells, middle.select("chrom", "idx", "x"), width, small)
    rows = middle.drop("x").join(product, ["chrom", "idx"]).join(_totals(middle, width, None), "chrom")
    return rows.select("chrom", "idx", _per_element(width, lambda k: F.col("d") * (F.col("y")[k] - F.col("mu") * F.col("t")[k])).alias("y"))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column]) if len(column) else np.zeros((0, 0))


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the block's part outside ``basis``; columns that are not needed are zero.

    Singular vectors keep the whole span where columns depend on each other.
    """
    scale = np.sqrt((block * block).sum(axis=0)).max(initial=1e-300)
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    u, size, _ = np.linalg.svd(block, full_matrices=False)
    out = np.zeros_like(block)
    fresh = u[:, size > 1e-11 * scale]
    # Small parts are mostly rounding, which may point back into the basis.
    fresh = fresh - basis @ (basis.T @ fresh)
    out[:, : fresh.shape[1]] = fresh
    return out


def _grown(last: bool, kind: str, width: int):
    return lambda key, pdf: _grow(key, pdf, last, kind, width)


def _grow(key, pdf: pd.DataFrame, last: bool, kind: str, width: int) -> pd.DataFrame:
    """A chromosome's basis and its image with one more block; at the end of a cycle the vectors that it holds."""
    pdf = pdf.sort_values("idx")
    basis, image, y = _stack(pdf["basis"]), _stack(pdf["image"]), _stack(pdf["y"])
    image = np.hstack([image.reshape(len(y), -1), y])
    residual = 0.0
    if not last:
        x = _orthonormal(y, basis)
        basis = np.hstack([basis, x])
    else:
        alive = (basis * basis).sum(axis=0) > 0.5
        k, a = basis[:, alive], image[:, alive]
        h = k.T @ a
        values, u = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-values if kind == "laplacian" else -np.abs(values), kind="stable")[:width]
        x = np.zeros((len(y), width))
        x[:, : len(order)] = k @ u[:, order]
        gap = a @ u[:, order] - x[:, : len(order)] * values[order]
        norms = np.sqrt((gap * gap).sum(axis=0)) / max(float(np.abs(values).max(initial=0.0)), 1e-300)
        residual = float(norms[: max(width - EXTRA, 1)].max(initial=0.0))
        basis, image = x, np.zeros((len(y), 0))
    return pd.DataFrame({"chrom": key[0], "idx": pdf["idx"].to_numpy(), "x": list(x), "basis": list(basis), "image": list(image), "residual": residual})


def leading_vectors(cells: DataFrame, n: int, kind: str = "correlation", steps: int = STEPS, cycles: int = CYCLES, tolerance: float = TOLERANCE) -> DataFrame:
    """(chrom, idx, vectors): the n leading eigenvectors of every chromosome's map (chrom, i, j, v), both halves given.

    Vectors are ordered by falling size of their value (``laplacian``: by rising value of the
    Laplacian), have norm 1 and a positive first entry that isn't zero; bins without contacts have no row,
    and entries beyond a chromosome's bins are zero.  Cycles end when the residuals of all chromosomes are
    below ``tolerance`` of the largest value; an error tells if they don't.
    """
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}")
    width = n + EXTRA
    cells = _stored(cells.select("chrom", "i", "j", "v").repartition("chrom", "i"))
    factors = _stored(_factors(cells, kind))
    n_bins = factors.count()
    small = n_bins <= MAX_BROADCAST_BINS // width
    chrom = dict(cells.dtypes)["chrom"]
    schema = f"chrom {chrom}, idx long, x array<double>, basis array<double>, image array<double>, residual double"
    # Numbers between -1 and 1 that depend on the bin only.
    draw = lambda k: F.pmod(F.xxhash64("chrom", "idx", F.lit(k)), F.lit(2_000_003)) / 1_000_001.5 - 1
    start = factors.select("chrom", "idx", _per_element(width, draw).alias("y"), F.array().cast("array<double>").alias("basis"), F.array().cast("array<double>").alias("image"))

    def first(key, pdf):
        pdf = pdf.sort_values("idx")
        y = _stack(pdf["y"])
        x = _orthonormal(y, np.zeros((len(y), 1)))
        return pd.DataFrame({"chrom": key[0], "idx": pdf["idx"].to_numpy(), "x": list(x), "basis": list(x), "image": [np.zeros(0)] * len(x), "residual": 1.0})

    state = _stored(ship(start).groupBy("chrom").applyInPandas(first, schema))
    for _ in range(cycles):
        for step in range(steps):
            image = _image(cells, factors, state.select("chrom", "idx", "x"), kind, width, small)
            rows = state.drop("x", "residual").join(image, ["chrom", "idx"])
            state = _stored(rows.groupBy("chrom").applyInPandas(_grown(step == steps - 1, kind, width), schema))
        worst = state.agg(F.max("residual")).first()[0]
        if worst is None or worst <= tolerance:
            break
    else:
        raise RuntimeError(f"eigenvectors have a residual of {worst:.1e} after {cycles} cycles")
    return state.groupBy("chrom").applyInPandas(lambda key, pdf: _signed(key, pdf, n), f"chrom {chrom}, idx long, vectors array<double>")


def _signed(key, pdf: pd.DataFrame, n: int) -> pd.DataFrame:
    pdf = pdf.sort_values("idx")
    x = _stack(pdf["x"])[:, :n]
    for k in range(x.shape[1]):
        big = np.flatnonzero(np.abs(x[:, k]) > 1e-9)
        if len(big) and x[big[0], k] < 0:
            x[:, k] *= -1
    return pd.DataFrame({"chrom": key[0], "idx": pdf["idx"].to_numpy(), "vectors": list(x)})
