"""Likelihood domains of chromosomes of any size and of any length, without a dense map.

A segment's likelihood is a Poisson fit of its own block and of half of the blocks with what lies
before and after.  The contacts of a block enter by two sums, their number and their summed log
distances; its expected weights by the row sums of the bins.  So a round needs

    cells      -> sums per pair of neighbouring atoms (stretches between candidate borders): one aggregate
    row sums   -> one number a bin, in each of a chromosome's tasks

and a task never holds a map.  The search goes from coarse to fine.  The first round fits all segments
between candidates on an even grid of at most ``width`` places; the next ones keep the accepted borders, add
places around them at a quarter of the step and a grid inside every segment, and fit only
segments that hold at most two accepted borders.  A round's choice is taken if it is better than the
one before; the search of a chromosome ends when, at a step of one bin, none is.  A chromosome of at
most ``width`` bins has all its segments fitted in the first round, so its result is the exact optimum.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.functions.segmentation import best_path, inner_totals, kept_domains, next_places, scored_path, segment_fits
from contactloom.operators.spectral import _stored
from contactloom.shipping import ship

#: Bins of the shortest segment, accepted borders that a refitted one may hold, gain that counts.
LEAST = 5
SPAN = 2
GAIN = 1e-6
_SUMS, _PLACES, _BAND, _ROWS, _COLUMNS = range(5)


def kept_bins(rows: DataFrame, bins: DataFrame, bad: DataFrame | None) -> DataFrame:
    """(chrom, n, i, x): bins with contacts that are not bad, numbered along their chromosome."""
    kept = rows.groupBy("chrom", "n", "i").agg(F.sum("v").alias("s")).where("s > 0").drop("s")
    if bad is not None:
        marks = bad.select("bin").distinct().join(bins.select("bin", "chrom", F.col("idx").alias("i")), "bin")
        kept = kept.join(marks, ["chrom", "i"], "left_anti")
    return kept.withColumn("x", F.row_number().over(Window.partitionBy("chrom").orderBy("i")).cast("long") - 1).select("chrom", "n", "i", "x")


def _first_places(track: DataFrame, width: int, longest: int | None) -> DataFrame:
    """(chrom, q, accepted, step, done) of the even grid; only the ends are accepted."""
    size = track.groupBy("chrom").agg(F.count("*").alias("m")).where(F.col("m") >= LEAST)
    step = F.ceil(F.col("m") / width)
    if longest is not None:
        step = F.least(step, F.lit(max(longest // 4, 1)))
    grid = F.explode(F.array_union(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, step.cast("long")), F.array("m")))
    places = size.select("chrom", "m", grid.alias("q"), step.cast("long").alias("step"))
    return places.select("chrom", "q", ((F.col("q") == 0) | (F.col("q") == F.col("m"))).alias("accepted"), "step", F.lit(False).alias("done"))


def _blocks(half: DataFrame, track: DataFrame, places: DataFrame) -> DataFrame:
    """(chrom, kind, a, b, k, l): everything that a round's fits of a chromosome need."""
    along = Window.partitionBy("chrom").orderBy("q")
    # The end of the chromosome opens no atom.
    atoms = places.select("chrom", "q", F.row_number().over(along).cast("long").alias("atom"), F.sum(F.col("accepted").cast("int")).over(along).alias("rank"))
    upto = Window.partitionBy("chrom").orderBy("x")
    of_bin = track.join(atoms.withColumnRenamed("q", "x"), ["chrom", "x"], "left").join(places.select("chrom").distinct(), "chrom", "left_semi")
    of_bin = of_bin.select("chrom", "x", "s", (F.last("atom", True).over(upto) - 1).alias("a"), F.last("rank", True).over(upto).alias("ra"))
    ends = of_bin.select("chrom", F.col("x").alias("y"), F.col("a").alias("b"), F.col("ra").alias("rb"))
    pairs = half.join(of_bin.drop("s"), ["chrom", "x"]).join(ends, ["chrom", "y"])
    # One aggregate: pairs of near atoms stay apart, far ones are told apart by their rows' and columns' atoms only.
    pairs = pairs.groupBy("chrom", "a", "b", (F.col("rb") - F.col("ra") <= SPAN).alias("near")).agg(F.sum("v").alias("k"), F.sum("l").alias("l"))
    pairs = _stored(pairs)
    side = lambda kind, col: pairs.groupBy("chrom", col).agg(F.sum("k").alias("k"), F.sum("l").alias("l")).select(
        "chrom", F.lit(kind).alias("kind"), F.col(col).alias("a"), F.lit(0).cast("long").alias("b"), "k", "l"
    )
    none = F.lit(0.0)
    parts = [
        of_bin.select("chrom", F.lit(_SUMS).alias("kind"), F.col("x").alias("a"), F.lit(0).cast("long").alias("b"), F.col("s").alias("k"), none.alias("l")),
        places.select("chrom", F.lit(_PLACES).alias("kind"), F.col("q").alias("a"), F.col("accepted").cast("long").alias("b"), none.alias("k"), none.alias("l")),
        pairs.where("near").select("chrom", F.lit(_BAND).alias("kind"), "a", "b", "k", "l"),
        side(_ROWS, "a"),
        side(_COLUMNS, "b"),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def _reach(accepted: np.ndarray) -> np.ndarray:
    """For every candidate the last one that it may be joined to."""
    rank = np.cumsum(accepted)
    # Strictly between p and q lie rank[q] - accepted[q] - rank[p] accepted borders.
    return np.searchsorted(rank - accepted, rank + SPAN, side="right") - 1


def _fit(pdf: pd.DataFrame, part: int, parts: int, longest: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, value) of a part's segments."""
    of = lambda kind: pdf[pdf["kind"] == kind].sort_values(["a", "b"])
    sums, places, band = of(_SUMS)["k"].to_numpy(), of(_PLACES), of(_BAND)
    q, accepted = places["a"].to_numpy(), places["b"].to_numpy()
    last, atoms = _reach(accepted), len(q) - 1
    widest = int((last - np.arange(len(q))).max())
    a, b = band["a"].to_numpy(), band["b"].to_numpy()
    used = b - a < widest
    own, rows, columns = [], np.zeros((atoms + 1, 2)), np.zeros((atoms + 1, 2))
    for at, name in enumerate("kl"):
        dense = np.zeros((atoms, widest))
        dense[a[used], (b - a)[used]] = band[name].to_numpy()[used]
        own.append(inner_totals(dense))
        for kind, out in ((_ROWS, rows), (_COLUMNS, columns)):
            side = of(kind)
            out[side["a"].to_numpy() + 1, at] = side[name].to_numpy()
    rows, columns = rows.cumsum(axis=0), columns.cumsum(axis=0)
    found = []
    for p in range(part, atoms, parts):
        e = np.arange(p + 1, last[p] + 1)
        size = q[e] - q[p]
        e = e[(size >= LEAST) & (size <= (longest or size.max(initial=0)))]
        if len(e):
            inside = np.stack([o[p, e - p - 1] for o in own], axis=1)
            # A cell's row lies before its column: columns below e count the own block and what comes from before.
            before, after = columns[e] - columns[p] - inside, rows[e] - rows[p] - inside
            value = segment_fits(sums, int(q[p]), q[e], inside, np.maximum(before, 0), np.maximum(after, 0))
            found.append((np.full(len(e), q[p]), q[e], value))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _choose(pdf: pd.DataFrame, step: int, whole: bool) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """(places, accepted, step, done) of the next round from a round's fits and its accepted borders."""
    fits, old = pdf[pdf["kind"] == _BAND], np.sort(pdf[(pdf["kind"] == _PLACES) & (pdf["value"] > 0)]["first"].to_numpy())
    first, end, value = fits["first"].to_numpy(), fits["end"].to_numpy(), fits["value"].to_numpy()
    path = best_path(first, end, value, int(old[-1]))
    known = {(f, e): v for f, e, v in zip(first.tolist(), end.tolist(), value.tolist(), strict=True)}
    total = lambda borders: sum(known.get(s, -np.inf) - 7 for s in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True))
    new = np.r_[0, end[path]]
    better = total(new) > total(old) + GAIN
    borders = new if better else old
    if step == 1 and (whole or not better):
        return borders, np.ones(len(borders), bool), 1, True
    step = max(1, step // 4)
    places = next_places(borders, step)
    return places, np.isin(places, borders), step, False


def domains(cells: DataFrame, bins: DataFrame, bad: DataFrame | None = None, longest: int | None = None, parts: int = 16, width: int = 128) -> DataFrame:
    """(chrom, start, end, score) of the segments of greatest likelihood; ``longest`` bounds their bins if given.

    A chromosome with fewer than five bins left is one domain without score; one without contacts
    has no row.  A task holds numbers per bin and per pair of near atoms of one chromosome.
    """
    from contactloom.operators.segment import chromosome_cells

    rows = chromosome_cells(cells, bins)
    chrom = dict(rows.dtypes)["chrom"]
    kept = _stored(kept_bins(rows, bins, bad))
    inner = rows.select("chrom", "i", "j", "v").join(kept.select("chrom", "i", "x"), ["chrom", "i"])
    inner = inner.join(kept.select("chrom", F.col("i").alias("j"), F.col("x").alias("y")), ["chrom", "j"]).select("chrom", "x", "y", "v")
    sums = inner.groupBy("chrom", "x").agg(F.sum("v").alias("s"))
    track = _stored(kept.join(sums, ["chrom", "x"], "left").fillna(0.0, ["s"]))
    half = inner.where("x < y").groupBy("chrom", "x", "y").agg(F.sum("v").alias("v"))
    half = _stored(half.withColumn("l", F.col("v") * F.log((F.col("y") - F.col("x")).cast("double"))))

    def fit(key, pdf):
        first, end, value = _fit(pdf, key[1], parts, longest)
        return pd.DataFrame({"chrom": key[0], "kind": _BAND, "first": first, "end": end, "value": value})

    def make_choice(whole):
        def choose(key, pdf):
            places, accepted, step, done = _choose(pdf, int(pdf["step"].max()), whole)
            return pd.DataFrame({"chrom": key[0], "q": places, "accepted": accepted, "step": step, "done": done})

        return choose

    def finish(key, kept_pdf, fits_pdf):
        n, keep = int(kept_pdf["n"].iloc[0]), np.sort(kept_pdf["i"].dropna().to_numpy().astype(int))
        if len(keep) < LEAST:
            found = [(0, n - 1, None)]
        else:
            columns = [fits_pdf[c].to_numpy() for c in ("first", "end", "value")]
            found = kept_domains(scored_path(*columns, len(keep)), keep, n)
        return pd.DataFrame([(key[0], *d) for d in found], columns=["chrom", "start", "end", "score"]).astype({"score": float})

    state, ended, whole = _stored(_first_places(track, width, longest)), [], True
    ship(state)
    deal = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    while not state.isEmpty():
        dealt = _blocks(half, track, state).withColumn("part", deal)
        fits = _stored(dealt.groupBy("chrom", "part").applyInPandas(fit, f"chrom {chrom}, kind int, first long, end long, value double"))
        marks = state.select("chrom", F.lit(_PLACES).alias("kind"), F.col("q").alias("first"), F.lit(0).cast("long").alias("end"), F.col("accepted").cast("double").alias("value"), "step")
        rounds = fits.withColumn("step", F.lit(0).cast("long")).unionByName(marks)
        state = _stored(rounds.groupBy("chrom").applyInPandas(make_choice(whole), f"chrom {chrom}, q long, accepted boolean, step long, done boolean"))
        ended.append(fits.join(state.where("done").select("chrom").distinct(), "chrom", "left_semi"))
        state, whole = state.where("not done"), False
    every = rows.select("chrom", "n").distinct().join(kept.select("chrom", "i"), "chrom", "left")
    fits = ended[0] if ended else None
    for e in ended[1:]:
        fits = fits.unionByName(e)
    if fits is None:
        fits = rows.sparkSession.createDataFrame([], f"chrom {chrom}, first long, end long, value double")
    return every.groupBy("chrom").cogroup(fits.groupBy("chrom")).applyInPandas(finish, f"chrom {chrom}, start long, end long, score double")
