"""Registered queries and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from contactloom.operators import badbins, borders, compare, models3d, normalize, pairs, pixels, probable, restraints, segment, stats
from contactloom.plans import inputs as I
from contactloom.plans.inputs import PER_CHROM, recursive, sql
from contactloom.sources import annotations, contact_bam

_QUERIES: dict = {}
_SQL: dict = {}


def query(text: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with SQL that gives the same rows."""

    def add(f):
        _QUERIES[f.__name__] = f
        if text is not None:
            _SQL[f.__name__] = text
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


def _half(s, d, which: int | None = None):
    rows = I.contacts(s, d)
    rows = rows if which is None else rows.where(F.col("read_id") % 2 == which)
    return pixels.half_pixels(rows, I.bin_of(1), I.bin_of(2))


def _full(s, d):
    return pixels.symmetric(_half(s, d))


def _bad(s, d):
    return badbins.by_min_count(_full(s, d), I.bins(s), 50)


def _good(s, d):
    return pixels.good(_full(s, d), _bad(s, d))


def _bias(s, d):
    return normalize.vanilla(_good(s, d))


def _norm(s, d):
    return pixels.normalized(_good(s, d), _bias(s, d))


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


_FLAGS = """
over_ AS (SELECT c, rs, n FROM (SELECT c, rs, count(*) AS n FROM (SELECT c1 AS c, rs1 AS rs FROM pairs UNION ALL SELECT c2, rs2 FROM pairs) GROUP BY 1, 2)
  WHERE n > (SELECT n FROM (SELECT n, row_number() OVER (ORDER BY n) AS r, count(*) OVER () AS t FROM (SELECT count(*) AS n FROM (SELECT c1 AS c, rs1 AS rs FROM pairs UNION ALL SELECT c2, rs2 FROM pairs) GROUP BY c, rs)) WHERE r = floor((1 - 0.005::double) * t + 0.5))),
flags AS (SELECT p.read_id, (
    CASE WHEN c1 = c2 AND re1 = re2 AND s1 <> s2 AND (p2 > p1)::int = s2 THEN 1 WHEN c1 = c2 AND re1 = re2 AND s1 <> s2 THEN 2 WHEN c1 = c2 AND re1 = re2 THEN 4
         WHEN c1 = c2 AND abs(p1 - p2) < 500 AND s1 <> s2 AND (p2 > p1)::int <> s2 THEN 8 ELSE 0 END
  + CASE WHEN least(re1 - p1, p1 - rs1, re2 - p2, p2 - rs2) < 5 THEN 16 ELSE 0 END
  + CASE WHEN least(re1 - rs1, re2 - rs2) < 100 THEN 32 ELSE 0 END + CASE WHEN greatest(re1 - rs1, re2 - rs2) > 100000 THEN 64 ELSE 0 END
  + CASE WHEN EXISTS (SELECT 1 FROM over_ o WHERE o.c = p.c1 AND o.rs = p.rs1) OR EXISTS (SELECT 1 FROM over_ o WHERE o.c = p.c2 AND o.rs = p.rs2) THEN 128 ELSE 0 END
  + CASE WHEN row_number() OVER (PARTITION BY c1, p1, c2, p2, s1, s2 ORDER BY read_id) > 1 THEN 256 ELSE 0 END
  + CASE WHEN least(re1 - p1, p1 - rs1) > 750 OR least(re2 - p2, p2 - rs2) > 750 THEN 512 ELSE 0 END
  + CASE WHEN c1 <> c2 THEN 1024 ELSE 0 END)::int AS flag, c1, p1, c2, p2 FROM pairs p)
"""


def _flag_sql(body: str) -> str:
    return sql("", "base", "pairs").rstrip() + ", " + _FLAGS + body


@query(_flag_sql("SELECT read_id, flag FROM flags"))
def pair_flags(s, d):
    return pairs.classify(I.with_copies(I.contacts(s, d))).select("read_id", "flag")


@query(_flag_sql("SELECT k::int AS filter, count(*) AS n FROM flags, range(1, 12) t(k) WHERE (flag >> (k - 1)::int) & 1 = 1 GROUP BY 1"))
def flag_counts(s, d):
    return pairs.filter_counts(pairs.classify(I.with_copies(I.contacts(s, d))))


@query(_flag_sql(f"SELECT least(a, b) AS i, greatest(a, b) AS j, count(*) AS v FROM (SELECT c1 * {PER_CHROM} + p1 // 100000 AS a, c2 * {PER_CHROM} + p2 // 100000 AS b FROM flags WHERE flag & 463 = 0) GROUP BY 1, 2"))
def valid_pixels(s, d):
    valid = pairs.apply_filter(pairs.classify(I.with_copies(I.contacts(s, d))), (1, 2, 3, 4, 7, 8, 9))
    return pixels.half_pixels(valid, I.bin_of(1), I.bin_of(2))


@query(_flag_sql("SELECT read_id FROM flags WHERE flag & 15 <> 0"))
def filtered_pairs(s, d):
    return pairs.apply_filter(pairs.classify(I.with_copies(I.contacts(s, d))), (1, 2, 3, 4), reverse=True).select("read_id")


@query(sql("SELECT c, rs, count(*) AS n FROM (SELECT c1 AS c, rs1 AS rs FROM base UNION ALL SELECT c2, rs2 FROM base) GROUP BY 1, 2", "base"))
def fragment_counts(s, d):
    return pairs.fragment_counts(I.contacts(s, d))


@query(_flag_sql("SELECT * FROM over_"))
def over_represented(s, d):
    return pairs.over_represented_fragments(I.with_copies(I.contacts(s, d)))


@query(sql("SELECT read_id FROM (SELECT read_id, row_number() OVER (PARTITION BY c1, p1, c2, p2, s1, s2 ORDER BY read_id) AS r FROM pairs) WHERE r > 1", "base", "pairs"))
def duplicates(s, d):
    return I.with_copies(I.contacts(s, d)).withColumn("r", pairs.duplicate_rank()).where("r > 1").select("read_id")


@query(sql("SELECT read_id FROM (SELECT read_id, row_number() OVER (PARTITION BY c1, p1, c2, p2, s1, s2, l1, l2 ORDER BY read_id) AS r FROM pairs) WHERE r > 1", "base", "pairs"))
def duplicates_strict(s, d):
    return I.with_copies(I.contacts(s, d)).withColumn("r", pairs.duplicate_rank(True)).where("r > 1").select("read_id")


@query(sql("SELECT read_id, CASE WHEN w THEN c2 ELSE c1 END AS c1, CASE WHEN w THEN p2 ELSE p1 END AS p1, CASE WHEN w THEN c1 ELSE c2 END AS c2, CASE WHEN w THEN p1 ELSE p2 END AS p2 FROM (SELECT *, c1 > c2 OR c1 = c2 AND p1 > p2 AS w FROM base)", "base"))
def oriented_pairs(s, d):
    return pairs.oriented(I.contacts(s, d)).select("read_id", "c1", "p1", "c2", "p2")


@query(sql("SELECT * FROM half", "base", "half"))
def pixels_half(s, d):
    return _half(s, d)


@query(sql("SELECT i, j, v FROM full_", "base", "half", "full_"))
def pixels_symmetric(s, d):
    return _full(s, d)


@query(sql("SELECT * FROM cover", "base", "half", "full_", "cover"))
def bin_coverage(s, d):
    return badbins.coverage(_full(s, d))


@query(sql(f"SELECT b.bin, CASE WHEN 160 - coalesce(cells, 0) > 144 THEN 'zeros' ELSE 'low count' END AS why FROM bins b LEFT JOIN cover c ON b.bin = c.bin WHERE 160 - coalesce(cells, 0) > 144 OR coalesce(total, 0) < 100", "base", "half", "full_", "cover", "bins"))
def bad_bins_zero(s, d):
    return badbins.by_zero_count(_full(s, d), I.bins(s), 160, 90, 50)


@query(sql("SELECT bin, 'low count' AS why FROM bad", "base", "half", "full_", "cover", "bins", "bad"))
def bad_bins_mincount(s, d):
    return _bad(s, d)


_LOCAL = "local AS (SELECT f.i AS bin, sum(CASE WHEN x.chrom = y.chrom THEN v ELSE 0 END)::bigint AS cis, sum(v)::bigint AS total, sum(CASE WHEN x.chrom = y.chrom AND abs(f.i - f.j) <= 1 THEN v ELSE 0 END)::bigint AS near, sum(CASE WHEN x.chrom = y.chrom AND abs(f.i - f.j) > 1 AND abs(f.i - f.j) <= 5 THEN v ELSE 0 END)::bigint AS mid FROM full_ f JOIN bins x ON f.i = x.bin JOIN bins y ON f.j = y.bin GROUP BY 1)"


def _local_sql(body: str) -> str:
    return sql("", "base", "half", "full_", "bins").rstrip() + ", " + _LOCAL + " " + body


@query(_local_sql("SELECT * FROM local"))
def local_counts(s, d):
    return badbins.local_counts(_half(s, d), I.bins(s), 1, 5)


@query(_local_sql("SELECT bin, 'local ratio' AS why FROM local WHERE coalesce(near::double / nullif(mid, 0), 0) < 1 OR near < (SELECT coalesce(quantile_cont(near::double, 0.95), 0) FROM local WHERE coalesce(near::double / nullif(mid, 0), 0) < 1 AND near >= 1)"))
def bad_bins_local_ratio(s, d):
    return badbins.by_local_ratio(badbins.local_counts(_half(s, d), I.bins(s), 1, 5))


@query(_local_sql("SELECT bin, round(cis::double / total, 9) AS share FROM local"))
def cis_share(s, d):
    return badbins.cis_share(badbins.local_counts(_half(s, d), I.bins(s), 1, 5)).select("bin", _r("share", 9))


@query(sql('SELECT chrom, min(idx) AS first, max(idx) AS last, count(*) AS n FROM (SELECT chrom, idx, idx - row_number() OVER (PARTITION BY chrom ORDER BY idx) AS g FROM bad JOIN bins USING (bin)) GROUP BY chrom, g', "base", "half", "full_", "cover", "bins", "bad"))
def bad_bin_runs(s, d):
    return badbins.runs(_bad(s, d), I.bins(s))


@query()
def bad_bins_by_mean(s, d):
    """Bins of 10 kb, whose depth has a mode of low values at the chromosomes' ends."""
    place = lambda k: F.expr(f"cast(c{k} * 300 + p{k} div 10000 as bigint)")
    cells = pixels.symmetric(pixels.half_pixels(I.contacts(s, d), place(1), place(2)))
    return badbins.by_mean(cells, s.range(1500).withColumnRenamed("id", "bin"))


@query(sql("SELECT round(sum(CASE WHEN x.chrom = y.chrom THEN v ELSE 0 END)::double / sum(v)::double, 9) AS ratio FROM full_ f JOIN bins x ON f.i = x.bin JOIN bins y ON f.j = y.bin", "base", "half", "full_", "bins"))
def cis_trans_ratio(s, d):
    return stats.cis_trans_ratio(_full(s, d), I.bins(s)).select(_r("ratio", 9))


_B = ("base", "half", "full_", "cover", "bins", "bad", "good", "sums", "bias")


@query(sql("SELECT bin, round(b, 9) AS b FROM bias", *_B))
def vanilla_bias(s, d):
    return _bias(s, d).select("bin", _r("b", 9))


@query(sql("SELECT bin, round(q / m * sqrt(m), 9) AS b FROM (SELECT bin, sqrt(s) AS q, avg(sqrt(s)) OVER () AS m FROM sums)", *_B[:-1]))
def sqrt_bias(s, d):
    return normalize.square_root(_good(s, d)).select("bin", _r("b", 9))


@query(sql("SELECT bin, round(b * sqrt(t / 25600), 9) AS b FROM bias, (SELECT sum(v) AS t FROM norm)", *_B, "norm"))
def rescaled_bias(s, d):
    return normalize.rescaled(_good(s, d), _bias(s, d), 160).select("bin", _r("b", 9))


def _ice_sql(rounds: int) -> str:
    """Rounds of balancing unrolled, one block of definitions each."""
    parts = ["b0 AS (SELECT DISTINCT i AS bin, 1.0::double AS b FROM good)"]
    for k in range(rounds):
        parts.append(f"s{k} AS (SELECT g.i AS bin, sum(g.v / x.b / y.b) AS s FROM good g JOIN b{k} x ON g.i = x.bin JOIN b{k} y ON g.j = y.bin GROUP BY 1)")
        parts.append(f"b{k + 1} AS (SELECT s.bin, b.b * s.s / m.m AS b, m.m FROM s{k} s JOIN b{k} b ON s.bin = b.bin, (SELECT avg(s) AS m FROM s{k}) m)")
    body = f" SELECT bin, round(CASE WHEN b = 0 THEN 1.0 ELSE b * sqrt(m) END, 6) AS b FROM b{rounds}"
    return sql("", "base", "half", "full_", "cover", "bins", "bad", "good").rstrip() + ", " + ", ".join(parts) + body


@query(_ice_sql(6))
def ice_bias(s, d):
    return normalize.iterative(_good(s, d), iterations=5).select("bin", _r("b", 6))


@query(sql("SELECT i, j, round(v, 9) AS v FROM norm WHERE i < 32 AND j >= 32 AND j < 64", *_B, "norm"))
def norm_matrix_region(s, d):
    ranges = pixels.focus(("0", "1:0-3200000"), {"0": (0, 32), "1": (32, 64)}, 100_000)
    return pixels.crop(_norm(s, d), ranges, shift=False).select("i", "j", _r("v", 9))


_SIDES = "sides AS (SELECT read_id, c1, p1, s1, l1, rs1, re1, c2, p2, s2, l2, rs2, re2 FROM base UNION ALL SELECT read_id, c2, p2, s2, l2, rs2, re2, c1, p1, s1, l1, rs1, re1 FROM base)"


@query(sql("", "base").rstrip() + f", {_SIDES} SELECT * REPLACE (read_id::VARCHAR AS read_id, c1::VARCHAR AS c1, c2::VARCHAR AS c2) FROM sides WHERE c1 = 2 AND p1 BETWEEN 500000 AND 900000")
def bam_region(s, d):
    """All contacts written as sorted BAM files, those of a region read back from either end."""
    folder = f"{normalize.shared_folder(s)}/contacts-{uuid.uuid4().hex}"
    named = I.contacts(s, d).withColumns({c: F.col(c).cast("string") for c in ("read_id", "c1", "c2")})
    contact_bam.write_contacts(named, folder, [(str(k), 4_000_000) for k in range(I.CHROMS)])
    return contact_bam.read_contacts(s, folder, both=True, region=("2", 500_000, 900_000)).drop("flag", "multi")



@query(sql("SELECT i - 5 AS i, j - 5 AS j, v FROM full_ WHERE i >= 5 AND i < 20 AND j >= 5 AND j < 20 AND i <> j", "base", "half", "full_"))
def raw_region(s, d):
    return pixels.crop(_full(s, d), pixels.focus((6, 20), {}, 100_000), diagonal=False)


@query(sql("SELECT round(sum(v), 6) AS total FROM norm", *_B, "norm"))
def map_total(s, d):
    return pixels.total(_full(s, d), _bad(s, d), _bias(s, d)).select(_r("total"))


_DIST = "dist AS (SELECT x.chrom, g.i - g.j AS dist, sum(g.v)::double AS raw, sum(g.v / p.b / q.b) AS nrm FROM good g JOIN bins x ON g.i = x.bin JOIN bins y ON g.j = y.bin JOIN bias p ON g.i = p.bin JOIN bias q ON g.j = q.bin WHERE g.i >= g.j AND x.chrom = y.chrom GROUP BY 1, 2)"


@query(sql("", *_B).rstrip() + ", " + _DIST + " SELECT chrom, dist, raw, round(nrm, 6) AS nrm FROM dist")
def decay_raw(s, d):
    return normalize.distance_sums(_good(s, d), I.bins(s), _bias(s, d)).select("chrom", "dist", "raw", _r("nrm"))


_DECAY = _DIST + """, gb AS (SELECT * FROM bins WHERE bin NOT IN (SELECT bin FROM bad)),
ncell AS (SELECT x.chrom, x.idx - y.idx AS dist, count(*) AS n FROM gb x JOIN gb y ON x.chrom = y.chrom AND x.idx >= y.idx GROUP BY 1, 2),
alld AS (SELECT c.chrom, c.idx AS dist, coalesce(raw, 0) AS raw, coalesce(nrm, 0) AS nrm, coalesce(n, 0) AS n FROM bins c LEFT JOIN dist d ON c.chrom = d.chrom AND c.idx = d.dist LEFT JOIN ncell e ON c.chrom = e.chrom AND c.idx = e.dist),
walk AS (SELECT chrom, dist, raw AS acc, 0 AS g FROM alld WHERE dist = 0
  UNION ALL SELECT a.chrom, a.dist, CASE WHEN w.acc > 400 THEN a.raw ELSE w.acc + a.raw END, CASE WHEN w.acc > 400 THEN w.g + 1 ELSE w.g END FROM walk w JOIN alld a ON a.chrom = w.chrom AND a.dist = w.dist + 1),
grp AS (SELECT w.chrom, w.g, sum(a.raw) AS raw, sum(a.nrm) AS nrm, sum(a.n) AS n FROM walk w JOIN alld a USING (chrom, dist) GROUP BY 1, 2),
ok AS (SELECT g.*, CASE WHEN g.raw > 400 THEN g.nrm / g.n WHEN p.n IS NOT NULL THEN (p.nrm + g.nrm) / (p.n + g.n) END AS e FROM grp g LEFT JOIN grp p ON p.chrom = g.chrom AND p.g = g.g - 1)
"""
_DECAY_SQL = "WITH RECURSIVE " + sql("", *_B)[5:].rstrip() + ", " + _DECAY


@query(_DECAY_SQL + " SELECT w.chrom, w.dist, round(e, 9) AS expected FROM walk w JOIN ok USING (chrom, g) WHERE e IS NOT NULL")
def decay_grouped(s, d):
    return normalize.decay(_full(s, d), I.bins(s), _bias(s, d), _bad(s, d)).select("chrom", "dist", _r("expected", 9))


@query(_DECAY_SQL + " SELECT n.i, n.j, round(n.v / o.e, 6) AS v FROM norm_ n JOIN bins x ON n.i = x.bin JOIN bins y ON n.j = y.bin AND x.chrom = y.chrom JOIN walk w ON w.chrom = x.chrom AND w.dist = abs(n.i - n.j) JOIN ok o ON o.chrom = w.chrom AND o.g = w.g WHERE o.e IS NOT NULL".replace("norm_", "(SELECT g.i, g.j, g.v / p.b / q.b AS v FROM good g JOIN bias p ON g.i = p.bin JOIN bias q ON g.j = q.bin)"))
def decay_corrected(s, d):
    decay = normalize.decay(_full(s, d), I.bins(s), _bias(s, d), _bad(s, d))
    return pixels.decayed(_good(s, d), _bias(s, d), I.bins(s), decay).select("i", "j", _r("v"))


@query(sql("SELECT round(sum(CASE WHEN x.chrom = y.chrom THEN v ELSE 0 END), 6) AS cis, round(sum(v), 6) AS total FROM norm f JOIN bins x ON f.i = x.bin JOIN bins y ON f.j = y.bin WHERE i > j", *_B, "norm"))
def cis_percent(s, d):
    return normalize.cis_percent(_good(s, d), I.bins(s), _bias(s, d)).select(_r("cis"), _r("total"))


_CURVE = "curve AS (SELECT h.j - h.i AS dist, sum(h.v)::bigint AS total, (5 * (32 - (h.j - h.i)))::bigint AS cells FROM half h JOIN bins x ON h.i = x.bin JOIN bins y ON h.j = y.bin WHERE x.chrom = y.chrom AND h.j > h.i GROUP BY 1)"


@query(sql("", "base", "half", "bins").rstrip() + ", " + _CURVE + " SELECT dist, total, cells, round(total / cells::double, 9) AS mean FROM curve")
def distance_curve(s, d):
    return stats.distance_curve(_half(s, d), I.bins(s)).select("dist", "total", "cells", _r("mean", 9))


@query(sql("", "base", "half", "bins").rstrip() + ", " + _CURVE + " SELECT round(regr_slope(ln(total / cells::double), ln(dist)), 6) AS slope, round(regr_intercept(ln(total / cells::double), ln(dist)), 6) AS intercept, round(regr_r2(ln(total / cells::double), ln(dist)), 6) AS r2 FROM curve WHERE dist <= 10")
def loglog_slope(s, d):
    return stats.log_slope(stats.distance_curve(_half(s, d), I.bins(s)), 0, 10).select(_r("slope"), _r("intercept"), _r("r2"))


@query(sql("SELECT i // 4 AS i, j // 4 AS j, sum(v)::bigint AS v FROM full_ GROUP BY 1, 2", "base", "half", "full_"))
def rebin(s, d):
    return pixels.rebin(_full(s, d), 4)


@query(sql("SELECT i, j, sum(v)::bigint AS v FROM (SELECT * FROM half_a UNION ALL SELECT * FROM half_b) GROUP BY 1, 2", "base", "half_a", "half_b"))
def experiment_sum(s, d):
    return pixels.add(_half(s, d, 0), _half(s, d, 1))


@query(sql("SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, round(coalesce(a.v, 0) / b.v::double, 9) AS v FROM half_a a FULL JOIN half_b b ON a.i = b.i AND a.j = b.j", "base", "half_a", "half_b"))
def experiment_ratio(s, d):
    return pixels.divide(_half(s, d, 0), _half(s, d, 1)).select("i", "j", _r("v", 9))


@query(sql("SELECT i, j, round((l - m) / sd, 6) AS z FROM (SELECT i, j, log10(v) AS l, avg(log10(v)) OVER () AS m, stddev_pop(log10(v)) OVER () AS sd FROM full_ WHERE i <= j)", "base", "half", "full_"))
def zscores(s, d):
    return pixels.zscores(_full(s, d)).select("i", "j", _r("z"))


@query(sql("SELECT i, j, v FROM full_ WHERE i < j AND v > 5", "base", "half", "full_"))
def interaction_pairs(s, d):
    return pixels.interaction_pairs(_full(s, d), 5)


_ALIGNED = "al AS (SELECT x.chrom, j - i AS dist, i, coalesce(a, 0)::double AS a, coalesce(b, 0)::double AS b FROM (SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, a.v AS a, b.v AS b FROM half_a a FULL JOIN half_b b ON a.i = b.i AND a.j = b.j) q JOIN bins x ON q.i = x.bin JOIN bins y ON q.j = y.bin WHERE x.chrom = y.chrom AND j - i BETWEEN 1 AND 10)"


def _al_sql(body: str) -> str:
    return sql("", "base", "half_a", "half_b", "bins").rstrip() + ", " + _ALIGNED + " " + body


def _aligned(s, d):
    return compare.aligned_diagonals(_half(s, d, 0), _half(s, d, 1), I.bins(s), 10)


@query(_al_sql("SELECT dist, count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM (SELECT *, rank() OVER (PARTITION BY dist ORDER BY a) + (count(*) OVER (PARTITION BY dist, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY dist ORDER BY b) + (count(*) OVER (PARTITION BY dist, b) - 1) / 2 AS rb FROM al) GROUP BY 1"))
def diagonal_correlations(s, d):
    return compare.by_distance(_aligned(s, d)).select("dist", "n", _r("pearson"), _r("spearman"))


@query(_al_sql("SELECT round(sum(r * w) / sum(w), 6) AS scc, round(sqrt(sum(w * w) * var_samp(r) / (sum(w) * sum(w))), 6) AS std FROM (SELECT dist, corr(a, b) AS r, sqrt(var_samp(ua) * var_samp(ub)) * count(*) AS w FROM (SELECT *, row_number() OVER (PARTITION BY dist ORDER BY a, i) / (count(*) OVER (PARTITION BY dist))::double AS ua, row_number() OVER (PARTITION BY dist ORDER BY b, i) / (count(*) OVER (PARTITION BY dist))::double AS ub FROM al) GROUP BY 1)"))
def stratum_adjusted_correlation(s, d):
    return compare.stratum_adjusted(_aligned(s, d)).select(_r("scc"), _r("std"))


@query()
def eigenvector_correlations(s, d):
    return compare.eigenvector_table(pixels.symmetric(_half(s, d, 0)), pixels.symmetric(_half(s, d, 1)), I.bins(s), 3).select("chrom", "x", "y", _r("corr", 4))


@query()
def reproducibility(s, d):
    return compare.reproducibility(pixels.symmetric(_half(s, d, 0)), pixels.symmetric(_half(s, d, 1)), I.bins(s), 10, 2.0)


_INS = "ins AS (SELECT b.chrom, b.idx, coalesce(sum(f.v), 0)::double AS score FROM bins b LEFT JOIN (SELECT x.chrom, x.idx AS x, y.idx AS y, f.v FROM full_ f JOIN bins x ON f.i = x.bin JOIN bins y ON f.j = y.bin WHERE x.chrom = y.chrom) f ON f.chrom = b.chrom AND f.x BETWEEN b.idx - 4 AND b.idx - 1 AND f.y BETWEEN b.idx + 1 AND b.idx + 4 WHERE b.idx >= 4 AND b.idx < 28 GROUP BY 1, 2)"


def _ins_sql(body: str) -> str:
    return sql("", "base", "half", "full_", "bins").rstrip() + ", " + _INS + " " + body


@query(_ins_sql("SELECT * FROM ins"))
def insulation(s, d):
    return segment.insulation(_full(s, d), I.bins(s), 1, 4)


@query(_ins_sql("SELECT chrom, idx, round(log2(score / m), 6) AS score FROM (SELECT *, avg(score) OVER (PARTITION BY chrom) AS m FROM ins) WHERE score > 0 UNION ALL SELECT chrom, idx, NULL FROM ins WHERE score = 0"))
def insulation_normalized(s, d):
    return segment.insulation(_full(s, d), I.bins(s), 1, 4, True).select("chrom", "idx", _r("score"))


@query(_ins_sql("SELECT chrom, idx, score, round(avg(score) OVER (PARTITION BY chrom ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) - avg(score) OVER (PARTITION BY chrom ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 6) AS delta FROM ins"))
def insulation_delta(s, d):
    return segment.insulation_delta(segment.insulation(_full(s, d), I.bins(s), 1, 4), 3).select("chrom", "idx", "score", _r("delta"))


@query(_ins_sql("""SELECT chrom, idx, round(2 / (1 + exp(-(peak - trough))) - 1, 6) AS strength FROM (
  SELECT *, lag(score) OVER w AS s0, lead(score) OVER w AS s2, lag(delta) OVER w AS d0, lead(delta) OVER w AS d2,
    last_value(CASE WHEN up THEN delta END IGNORE NULLS) OVER (PARTITION BY chrom ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak,
    first_value(CASE WHEN down THEN delta END IGNORE NULLS) OVER (PARTITION BY chrom ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS trough
  FROM (SELECT *, coalesce(lag(delta) OVER w < delta, true) AS up, coalesce(lead(delta) OVER w > delta, true) AS down FROM (
    SELECT chrom, idx, score, avg(score) OVER (PARTITION BY chrom ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) - avg(score) OVER (PARTITION BY chrom ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS delta
    FROM (SELECT chrom, idx, CASE WHEN score > 0 THEN log2(score / m) END AS score FROM (SELECT *, avg(score) OVER (PARTITION BY chrom) AS m FROM ins)))
    WINDOW w AS (PARTITION BY chrom ORDER BY idx))
  WINDOW w AS (PARTITION BY chrom ORDER BY idx))
WHERE score < s0 AND score < s2 AND d0 > 0 AND d2 < 0 AND peak > trough"""))
def insulation_borders(s, d):
    found = segment.insulation_borders(segment.insulation_delta(segment.insulation(_full(s, d), I.bins(s), 1, 4, True), 3), 0.0)
    return found.select("chrom", "idx", _r("strength"))


@query()
def domains_by_window(s, d):
    return segment.domains_by_window(_full(s, d), I.bins(s), 4)


@query()
def domains_by_likelihood(s, d):
    return segment.domains_by_likelihood(_full(s, d), I.bins(s))


@query()
def compartments(s, d):
    full, b = _full(s, d), I.bins(s)
    return segment.compartments(full, b, normalize.decay(full, b)).select("chrom", "start", "end", "type")


@query(sql("SELECT e.chrom, e.start, e.\"end\", coalesce(o.observed, 0) AS observed, round(e.expected, 6) AS expected, round(coalesce(o.observed, 0) / e.expected, 6) AS height FROM (SELECT a.chrom, a.start, a.\"end\", sum(coalesce(m.m, 0) * (a.\"end\" - a.start + 1 - k.k)) AS expected FROM domains a JOIN (SELECT range AS k FROM range(32)) k ON k.k <= a.\"end\" - a.start LEFT JOIN (SELECT x.chrom, f.j - f.i AS k, sum(f.v)::double / (32 - (f.j - f.i)) AS m FROM full_ f JOIN bins x ON f.i = x.bin JOIN bins y ON f.j = y.bin WHERE x.chrom = y.chrom AND f.i <= f.j GROUP BY 1, 2) m ON m.chrom = a.chrom AND m.k = k.k WHERE a.experiment = 'a' GROUP BY 1, 2, 3) e LEFT JOIN (SELECT a.chrom, a.start, sum(f.v)::double AS observed FROM domains a JOIN (SELECT x.chrom, x.idx AS x, y.idx AS y, f.v FROM full_ f JOIN bins x ON f.i = x.bin JOIN bins y ON f.j = y.bin WHERE x.chrom = y.chrom AND f.i <= f.j) f ON f.chrom = a.chrom AND f.x >= a.start AND f.y <= a.\"end\" WHERE a.experiment = 'a' GROUP BY 1, 2) o ON o.chrom = e.chrom AND o.start = e.start", "base", "half", "full_", "bins", "half_a", "half_b", "cis_ab", "dips", "domains"))
def domain_density(s, d):
    found = segment.domain_density(I.domains(s, d).where("experiment = 'a'"), _full(s, d), I.bins(s))
    return found.select("chrom", "start", "end", "observed", _r("expected"), _r("height"))


@query(sql("SELECT chrom, start, \"end\", CASE WHEN \"end\" - start + 1 > 10 THEN -abs(score) ELSE abs(score) END AS score FROM domains", "base", "bins", "half_a", "half_b", "cis_ab", "dips", "domains"))
def limited_domains(s, d):
    return segment.limit_domains(I.domains(s, d), 10).select("chrom", "start", "end", "score")


@query(sql("SELECT chrom, idx FROM (SELECT DISTINCT experiment, chrom, start + k.range AS idx FROM domains, range(32) k WHERE k.range <= \"end\" - start AND \"end\" - start + 1 > 7) GROUP BY 1, 2 HAVING count(*) = 2", "base", "bins", "half_a", "half_b", "cis_ab", "dips", "domains"))
def forbidden_bins(s, d):
    return segment.forbidden(I.domains(s, d), 7)


@query(sql("SELECT chrom, first, last, n FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY n DESC, first) AS r FROM (SELECT chrom, min(idx) AS first, max(idx) AS last, count(*) AS n FROM (SELECT chrom, idx, idx - row_number() OVER (PARTITION BY chrom ORDER BY idx) AS g FROM bins WHERE bin NOT IN (SELECT i FROM full_)) GROUP BY chrom, g)) WHERE r = 1", "base", "half", "full_", "bins"))
def longest_gap(s, d):
    return segment.longest_gap(_full(s, d), I.bins(s))


@query(sql("SELECT chrom, \"end\", score, coalesce(lag(\"end\") OVER (PARTITION BY chrom ORDER BY \"end\") + 1, 0) AS start FROM (SELECT chrom, \"end\", max(score) AS score FROM domains GROUP BY 1, 2)", "base", "bins", "half_a", "half_b", "cis_ab", "dips", "domains"))
def reordered_domains(s, d):
    return borders.reordered(I.domains(s, d))


_MARKS = """ma AS (SELECT DISTINCT c1 AS chrom, p1 AS pos FROM base), mb AS (SELECT DISTINCT c2 AS chrom, p2 AS pos FROM base),
na AS (SELECT chrom, a, CASE WHEN hi IS NULL OR a - lo <= hi - a THEN lo ELSE hi END AS b, least(a - lo, hi - a) AS d FROM (
    SELECT ma.chrom, ma.pos AS a, l.pos AS lo, h.pos AS hi FROM ma ASOF LEFT JOIN mb l ON ma.chrom = l.chrom AND ma.pos >= l.pos ASOF LEFT JOIN mb h ON ma.chrom = h.chrom AND ma.pos <= h.pos)
  WHERE least(a - lo, hi - a) <= 20000),
nb AS (SELECT chrom, CASE WHEN hi IS NULL OR b - lo <= hi - b THEN lo ELSE hi END AS a, b FROM (
    SELECT mb.chrom, mb.pos AS b, l.pos AS lo, h.pos AS hi FROM mb ASOF LEFT JOIN ma l ON mb.chrom = l.chrom AND mb.pos >= l.pos ASOF LEFT JOIN ma h ON mb.chrom = h.chrom AND mb.pos <= h.pos)
  WHERE least(b - lo, hi - b) <= 20000)"""


def _marks(s, d):
    rows = I.contacts(s, d)
    pick = lambda k: rows.select(F.col(f"c{k}").alias("chrom"), F.col(f"p{k}").alias("pos")).distinct()
    return pick(1), pick(2)


@query(sql("", "base").rstrip() + ", " + _MARKS + " SELECT * FROM na")
def nearest_borders(s, d):
    return borders.nearest(*_marks(s, d), 20_000)


@query(sql("", "base").rstrip() + ", " + _MARKS + " SELECT na.chrom, na.a, na.b, na.d FROM na JOIN nb ON na.chrom = nb.chrom AND na.a = nb.a AND na.b = nb.b")
def mutual_nearest_borders(s, d):
    return borders.mutual_nearest(*_marks(s, d), 20_000)


@query()
def aligned_borders(s, d):
    rows = I.domains(s, d).select("experiment", "chrom", (F.col("end") * 100_000).alias("pos"))
    return borders.align(rows, max_dist=100_000.0)


@query(sql("SELECT id, chrom, start, \"end\" FROM (SELECT id, q.chrom + 1 AS chrom, q.bstart * 2 + 2 * (greatest(start, bstart) - bstart) AS start, q.bstart * 2 + 2 * (least(\"end\", bend) - bstart) AS \"end\", row_number() OVER (PARTITION BY id ORDER BY least(\"end\", bend) - greatest(start, bstart) DESC, bstart) AS r FROM (SELECT read_id AS id, min(c1) AS chrom, min(p1) AS start, min(p1) + 30000 AS \"end\" FROM base GROUP BY 1) s JOIN (SELECT c.range::int AS chrom, k.range * 250000 AS bstart, k.range * 250000 + 200000 AS bend FROM range(5) c, range(8) k) q ON q.chrom = s.chrom AND least(\"end\", bend) - greatest(start, bstart) > 10) WHERE r = 1", "base"))
def lifted_segments(s, d):
    rows = I.contacts(s, d).groupBy(F.col("read_id").alias("id"))
    segments = rows.agg(F.min("c1").alias("chrom"), F.min("p1").alias("start"), (F.min("p1") + 30_000).alias("end"))
    k = F.col("id") % 8 * 250_000
    blocks = s.range(40).select(
        F.expr("cast(id div 8 as int)").alias("chrom"), k.alias("bstart"), (k + 200_000).alias("bend"), F.expr("cast(id div 8 as int) + 1").alias("tchrom"),
        (k * 2).alias("tstart"), (k * 2 + 400_000).alias("tend"), F.lit(1).alias("tstrand"),
    )
    return borders.lift(segments, blocks)


_MOVES = """spans_ AS (SELECT DISTINCT c1 AS chrom, p1 // 4096 AS e FROM base),
one_ AS (SELECT chrom, e, m, bstart * 2 + 2 * (greatest(s, bstart) - bstart) AS a, bstart * 2 + 2 * (least(t, bend) - bstart) AS b FROM (
  SELECT *, row_number() OVER (PARTITION BY chrom, e ORDER BY least(t, bend) - greatest(s, bstart) DESC, bstart) AS r, count(*) OVER (PARTITION BY chrom, e) AS m
  FROM (SELECT chrom, e, e * 4096 AS s, e * 4096 + 4096 AS t FROM spans_) x JOIN (SELECT range * 250000 AS bstart, range * 250000 + 248000 AS bend FROM range(8)) y ON least(t, bend) - greatest(s, bstart) > 10) WHERE r = 1),
two_ AS (SELECT chrom, e, m AS m2, 900000 + bstart // 2 + 250000 - round((least(b, bend) - bstart) / 2) AS a, 900000 + bstart // 2 + 250000 - round((greatest(a, bstart) - bstart) / 2) AS b FROM (
  SELECT *, row_number() OVER (PARTITION BY chrom, e ORDER BY least(b, bend) - greatest(a, bstart) DESC, bstart) AS r, count(*) OVER (PARTITION BY chrom, e) AS m
  FROM (SELECT chrom, e, a, b FROM one_) x JOIN (SELECT range * 600000 AS bstart, range * 600000 + 500000 AS bend FROM range(7)) y ON least(b, bend) - greatest(a, bstart) > 10) WHERE r = 1),
bins_ AS (SELECT *, cast(round(b / 4096) AS bigint) AS k, count(*) OVER (PARTITION BY chrom, cast(round(b / 4096) AS bigint)) AS shared FROM two_)"""


@query(sql("", "base").rstrip() + ", " + _MOVES + """ SELECT s.chrom, s.e AS "end", o.a AS mid_start, o.b AS mid_end, t.chrom + 2 AS to_chrom, cast(t.a AS bigint) AS to_start, cast(t.b AS bigint) AS to_end, t.k AS to_bin,
CASE WHEN o.m IS NULL THEN 'lost in assembly' WHEN t.m2 IS NULL THEN 'lost in synteny' WHEN t.shared > 1 THEN 'merged' WHEN o.m > 1 OR t.m2 > 1 THEN 'split' ELSE 'moved' END AS status
FROM spans_ s LEFT JOIN one_ o ON s.chrom = o.chrom AND s.e = o.e LEFT JOIN bins_ t ON s.chrom = t.chrom AND s.e = t.e""")
def remapping_trace(s, d):
    """Fragments with a read as borders, through blocks of a new assembly twice as long, then reversed synteny blocks half as long."""
    marks = I.contacts(s, d).select(F.col("c1").alias("chrom"), F.expr("p1 div 4096").alias("end")).distinct()
    k = F.col("id") % 8
    new = s.range(40).select(
        F.expr("cast(id div 8 as int)").alias("chrom"), (k * 250_000).alias("bstart"), (k * 250_000 + 248_000).alias("bend"), F.expr("cast(id div 8 as int) + 1").alias("tchrom"),
        (k * 500_000).alias("tstart"), (k * 500_000 + 496_000).alias("tend"), F.lit(1).alias("tstrand"),
    )
    k = F.col("id") % 7
    other = s.range(35).select(
        F.expr("cast(id div 7 as int) + 1").alias("chrom"), (k * 600_000).alias("bstart"), (k * 600_000 + 500_000).alias("bend"), F.expr("cast(id div 7 as int) + 2").alias("tchrom"),
        (k * 300_000 + 900_000).alias("tstart"), (k * 300_000 + 1_150_000).alias("tend"), F.lit(-1).alias("tstrand"),
    )
    return borders.remapped(marks, 4096, new, other).drop("mid_chrom")


@query(sql("SELECT chrom, bin, count(*) AS n FROM (SELECT c1 AS chrom, p1 // 10000 AS bin FROM base UNION ALL SELECT c2, p2 // 10000 FROM base) GROUP BY 1, 2", "base"))
def genomic_distribution(s, d):
    return stats.genomic_distribution(I.contacts(s, d))


@query(sql("SELECT dist, count(*) AS n, round(avg((a = 1 AND b = 1)::int), 9) AS plus, round(avg((a = 0 AND b = 0)::int), 9) AS minus, round(avg((a = 1 AND b = 0)::int), 9) AS facing, round(avg((a = 0 AND b = 1)::int), 9) AS away FROM (SELECT abs(p2 - p1) // 5000 AS dist, CASE WHEN p1 <= p2 THEN s1 ELSE s2 END AS a, CASE WHEN p1 <= p2 THEN s2 ELSE s1 END AS b FROM base WHERE c1 = c2 AND abs(p2 - p1) < 200000) GROUP BY 1", "base"))
def strand_bias(s, d):
    return stats.strand_bias(I.contacts(s, d), 5000, 200_000).select("dist", "n", *[_r(c, 9) for c in ("plus", "minus", "facing", "away")])


_SIZES = "sz AS (SELECT abs(p2 - p1) AS size FROM base WHERE c1 = c2 AND re1 = re2 AND s1 <> s2 AND (p2 > p1)::int <> s2 AND abs(p2 - p1) <= 10000)"


@query(sql("", "base").rstrip() + ", " + _SIZES + " SELECT size, count(*) AS n FROM sz GROUP BY 1")
def insert_sizes(s, d):
    return stats.insert_sizes(I.contacts(s, d))


@query(sql("", "base").rstrip() + ", " + _SIZES + " SELECT count(*) AS n, round(avg(size), 6) AS mean, median(size)::double AS median, (SELECT median(abs(size - (SELECT median(size) FROM sz))) FROM sz)::double AS mad, round(quantile_cont(size::double, 0.999), 6) AS perc_max FROM sz")
def insert_size_stats(s, d):
    return stats.insert_size_stats(I.contacts(s, d)).select("n", _r("mean"), "median", "mad", _r("perc_max"))


@query(sql("SELECT dist, count(*) AS n FROM (SELECT least(p1 - rs1, re1 - p1) AS dist FROM base WHERE s1 <> s2 UNION ALL SELECT least(p2 - rs2, re2 - p2) FROM base WHERE s1 <> s2) WHERE dist <= 1000 GROUP BY 1", "base"))
def site_distances(s, d):
    return stats.site_distances(I.contacts(s, d))


_ANN = "SELECT c1 AS chrom, p1 AS start, p1 + 150000 AS \"end\", (read_id % 10)::double AS value FROM base"


def _annotation(s, d):
    rows = I.contacts(s, d)
    return rows.select(F.col("c1").alias("chrom"), F.col("p1").alias("start"), (F.col("p1") + 150_000).alias("end"), (F.col("read_id") % 10).cast("double").alias("value"))


@query(sql(f"SELECT chrom, bin, round(sum((least(\"end\", (bin + 1) * 100000) - greatest(start, bin * 100000)) * value) / 100000, 6) AS value FROM (SELECT *, unnest(range(start // 100000, (\"end\" - 1) // 100000 + 1)) AS bin FROM ({_ANN})) GROUP BY 1, 2", "base"))
def interval_means(s, d):
    return stats.interval_means(_annotation(s, d), 100_000).select("chrom", "bin", _r("value"))


@query(sql(f"SELECT chrom, \"end\" // 100000 AS bin, sum(value) AS value FROM ({_ANN}) GROUP BY 1, 2", "base"))
def binned_annotation(s, d):
    return annotations.binned(_annotation(s, d), 100_000)


@query(sql("SELECT i, j, avg((d <= 0.3)::int::double) AS share FROM pp GROUP BY 1, 2", "particles", "pp"))
def model_contacts(s, d):
    return models3d.contact_matrix(I.particles(s, d), 0.3)


@query(sql("SELECT i, j, avg((d <= 0.3)::int::double) AS share FROM pp GROUP BY 1, 2 HAVING bool_or(d <= 0.3)", "particles", "pp"))
def near_contacts(s, d):
    """The pairs of particles in contact in some model, without comparing all pairs."""
    return models3d.contact_shares(I.particles(s, d), 0.3).select("i", "j", "share")


@query(sql("SELECT a.c AS a, b.c AS b, i, j, round(a.share, 6) AS share_a, round(b.share, 6) AS share_b, round(a.share - b.share, 6) AS difference FROM (SELECT model % 3 AS c, i, j, avg((d <= 0.3)::int::double) AS share FROM pp GROUP BY 1, 2, 3) a JOIN (SELECT model % 3 AS c, i, j, avg((d <= 0.3)::int::double) AS share FROM pp GROUP BY 1, 2, 3) b USING (i, j) WHERE a.c < b.c AND a.share <> b.share", "particles", "pp"))
def model_deconvolution(s, d):
    """Contact shares of three clusters of the models, by their number."""
    p = I.particles(s, d)
    clusters = p.select("model", (F.col("model") % 3).alias("cluster")).distinct()
    found = models3d.deconvolved(p, clusters, 0.3)
    return found.select("a", "b", "i", "j", _r("share_a"), _r("share_b"), _r("difference"))


@query(sql("SELECT i, j, round(avg(d), 6) AS mean, round(median(d), 6) AS median FROM pp GROUP BY 1, 2", "particles", "pp"))
def model_distances(s, d):
    return models3d.distance_matrix(I.particles(s, d)).select("i", "j", _r("mean"), _r("median"))


@query(sql("SELECT model, round(max(d), 6) AS longest, round(min(d), 6) AS shortest FROM pp GROUP BY 1", "particles", "pp"))
def model_axes(s, d):
    return models3d.axes(I.particles(s, d)).select("model", _r("longest"), _r("shortest"))


@query(sql("SELECT model, round(sqrt(avg((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz))), 6) AS radius_of_gyration, round(sum(step), 6) AS contour, round(sqrt(pow(max(x)-min(x),2)+pow(max(y)-min(y),2)+pow(max(z)-min(z),2)), 6) AS cube_side FROM (SELECT *, avg(x) OVER (PARTITION BY model) AS mx, avg(y) OVER (PARTITION BY model) AS my, avg(z) OVER (PARTITION BY model) AS mz, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS step FROM particles WINDOW w AS (PARTITION BY model ORDER BY particle)) GROUP BY 1", "particles"))
def model_shape(s, d):
    return models3d.shape(I.particles(s, d)).select("model", _r("radius_of_gyration"), _r("contour"), _r("cube_side"))


@query(sql("SELECT particle, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM particles GROUP BY 1", "particles"))
def mean_coordinates(s, d):
    return models3d.mean_coordinates(I.particles(s, d)).select("particle", _r("x"), _r("y"), _r("z"))


@query(sql("SELECT p.particle, round(avg(coalesce(k.n, 0)), 6) AS n FROM particles p LEFT JOIN (SELECT model, particle, count(*) AS n FROM (SELECT model, i AS particle FROM pp WHERE d <= 0.3 UNION ALL SELECT model, j FROM pp WHERE d <= 0.3) GROUP BY 1, 2) k ON k.model = p.model AND k.particle = p.particle GROUP BY 1", "particles", "pp"))
def model_interactions(s, d):
    return models3d.interactions(I.particles(s, d), 0.3).select("particle", _r("n"))


@query(sql("SELECT model, particle, round(degrees(acos(greatest(-1, least(1, dot / norm)))), 4) AS angle FROM (SELECT model, particle, (x-x1)*(x2-x1)+(y-y1)*(y2-y1)+(z-z1)*(z2-z1) AS dot, sqrt(pow(x-x1,2)+pow(y-y1,2)+pow(z-z1,2))*sqrt(pow(x2-x1,2)+pow(y2-y1,2)+pow(z2-z1,2)) AS norm FROM (SELECT *, lead(x,3) OVER w AS x1, lead(y,3) OVER w AS y1, lead(z,3) OVER w AS z1, lead(x,6) OVER w AS x2, lead(y,6) OVER w AS y2, lead(z,6) OVER w AS z2 FROM particles WINDOW w AS (PARTITION BY model ORDER BY particle))) WHERE dot IS NOT NULL AND norm > 0", "particles"))
def walking_angles(s, d):
    return models3d.walking_angle(I.particles(s, d)).select("model", "particle", _r("angle", 4))


_DIHEDRAL = ", ".join(
    [f"lead({k}, {n + 1}) OVER w - {f'lead({k}, {n}) OVER w' if n else k} AS b{n}{k}" for n in range(3) for k in "xyz"]
)


@query(sql(f"""SELECT model, particle, round(degrees(atan2(sqrt(b1x*b1x+b1y*b1y+b1z*b1z) * (b0x*ex+b0y*ey+b0z*ez), cx*ex+cy*ey+cz*ez)), 4) AS angle FROM (
  SELECT *, b0y*b1z-b0z*b1y AS cx, b0z*b1x-b0x*b1z AS cy, b0x*b1y-b0y*b1x AS cz, b1y*b2z-b1z*b2y AS ex, b1z*b2x-b1x*b2z AS ey, b1x*b2y-b1y*b2x AS ez
  FROM (SELECT model, particle, {_DIHEDRAL} FROM particles WINDOW w AS (PARTITION BY model ORDER BY particle)) WHERE b2x IS NOT NULL)""", "particles"))
def walking_dihedrals(s, d):
    return models3d.walking_dihedral(I.particles(s, d)).select("model", "particle", _r("angle", 4))


@query()
def model_scores(s, d):
    return models3d.model_scores(I.particles(s, d), 0.3).select("a", "b", "eqv", _r("rmsd"), _r("drmsd"))


@query()
def model_consistency(s, d):
    return models3d.consistency(I.particles(s, d), 0.3).select("particle", _r("share"))


@query()
def model_accessibility(s, d):
    return models3d.accessibility(I.particles(s, d), 0.1, 0.5).select("model", "particle", _r("share"))


@query(sql("", "base", "half", "full_").rstrip() + """, reg AS (SELECT i, j, log10(v) AS l FROM full_ WHERE i <= j AND i < 32 AND j < 32),
z AS (SELECT i, j, (l - m) / sd AS z FROM reg, (SELECT avg(l) AS m, stddev_pop(l) AS sd FROM reg) WHERE i < j),
f AS (SELECT a.range AS i, b.range AS j, coalesce(z0.z, list_avg([z1.z, z2.z, z3.z, z4.z])) AS z, z0.z IS NULL AS guessed FROM range(32) a JOIN range(32) b ON a.range < b.range
  LEFT JOIN z z0 ON z0.i = a.range AND z0.j = b.range LEFT JOIN z z1 ON z1.i = a.range - 1 AND z1.j = b.range LEFT JOIN z z2 ON z2.i = a.range + 1 AND z2.j = b.range
  LEFT JOIN z z3 ON z3.i = a.range AND z3.j = b.range - 1 LEFT JOIN z z4 ON z4.i = a.range AND z4.j = b.range + 1),
g AS (SELECT f.*, j - i AS gap, greatest(100.0, 500.0 + (100.0 - 500.0) / (hi - lo) * (z - lo)) AS line FROM f, (SELECT min(z) AS lo, max(z) AS hi FROM z WHERE j - i > 1))
SELECT i, j, type, round(CASE WHEN gap <= 2 THEN 5.0 ELSE sqrt(abs(z)) * CASE WHEN guessed THEN 0.5 ELSE 1.0 END END, 6) AS kforce,
  round(CASE WHEN gap = 1 AND z > 0.5 THEN line WHEN gap = 1 THEN 100.0 WHEN gap = 2 THEN 200.0 ELSE line END, 6) AS dist
FROM (SELECT *, CASE WHEN gap = 1 AND z > 0.5 THEN 'Harmonic' WHEN gap <= 2 THEN 'UpperBound' WHEN z > 0.5 THEN 'Harmonic' WHEN z < -0.5 THEN 'LowerBound' END AS type FROM g) WHERE type IS NOT NULL""")
def restraint_table(s, d):
    z = pixels.zscores(pixels.crop(_full(s, d), (0, 32, 0, 32))).where("i < j")
    return restraints.restraints(z, 32, 50.0, 500.0, 0.5, -0.5).select("i", "j", "type", _r("kforce"), _r("dist"))


@query(sql("SELECT bin - 32 AS bin, round(b, 9) AS b FROM bias WHERE bin >= 32 AND bin < 64", *_B))
def bias_region(s, d):
    return pixels.bias_region(_bias(s, d), 32, 64).select("bin", _r("b", 9))


@query(sql("SELECT i, j FROM full_ WHERE i < j AND v > (SELECT median(v) FROM full_ WHERE i < j)", "base", "half", "full_"))
def binary_contacts(s, d):
    return pixels.binary_contacts(_full(s, d))


@query()
def randomized_map(s, d):
    return pixels.randomized(_half(s, d), I.bins(s))


@query()
def structure_score(s, d):
    return compare.structure_score(_full(s, d), I.bins(s)).select("chrom", _r("excess", 4), _r("skewness", 4), _r("kurtosis", 4), "n")


@query(sql("SELECT read_id, ((read_id % 2 = 0)::int * 1 + (read_id % 3 = 0)::int * 256)::int AS flag FROM base", "base"))
def flags_from_lists(s, d):
    rows = I.contacts(s, d)
    ids = I.contacts(s, d).select("read_id").distinct()
    return pairs.flags_from_lists(rows, {1: ids.where("read_id % 2 = 0"), 9: ids.where("read_id % 3 = 0")}).select("read_id", "flag")


@query(sql("SELECT t.pos, p.chrom, p.rs, p.re FROM (SELECT DISTINCT c1 AS chrom, p1 AS pos FROM base) t JOIN (SELECT chrom, rs, re FROM (SELECT c.range::int AS chrom, k.range * 1000 + (k.range % 7) * 100 + 1 AS rs, lead(k.range * 1000 + (k.range % 7) * 100 + 1) OVER (PARTITION BY c.range ORDER BY k.range) AS re FROM range(5) c, range(2100) k) WHERE re IS NOT NULL) p ON p.chrom = t.chrom AND t.pos > p.rs AND t.pos <= p.re", "base"))
def fragment_lookup(s, d):
    from pyspark.sql import Window

    from contactloom.sources import reads

    k = F.col("id") % 2100
    sites = s.range(5 * 2100).select(F.expr("cast(id div 2100 as int)").alias("chrom"), (k * 1000 + k % 7 * 100 + 1).alias("start"))
    frags = sites.withColumn("end", F.lead("start").over(Window.partitionBy("chrom").orderBy("start"))).where("end IS NOT NULL")
    ends = I.contacts(s, d).select(F.col("c1").alias("chrom"), F.col("p1").alias("pos")).distinct()
    ends = ends.select(F.lit("r").alias("name"), "chrom", "pos", F.lit(1).alias("strand"), F.lit(50).alias("len"))
    return reads.with_fragment(ends, frags).where("rs IS NOT NULL AND pos > rs").select("pos", "chrom", "rs", "re")


@query(sql("""SELECT read_id, c1, p1, c2, p2, CASE
  WHEN short AND p2 - n2 BETWEEN 0 AND 5 THEN 12 WHEN short AND p1 - n1 BETWEEN -2 AND 3 THEN 11 WHEN short AND re1 = re2 THEN 15 WHEN short AND re1 <= rs2 THEN 13
  WHEN re1 = re2 AND back1 AND fore2 THEN 14 WHEN contact AND fore1 AND fore2 THEN 18 WHEN contact AND fore1 AND back2 AND p2 - p1 >= 2000 THEN 17
  WHEN contact AND back1 AND fore2 THEN 16 WHEN contact AND back1 AND back2 THEN 19 ELSE 20 END AS category
FROM (SELECT *, c1 = c2 AND p2 - p1 < 2000 AND s1 = 1 AND s2 = 0 AS short, c1 <> c2 OR (n1 <> n2 AND re1 <> re2) AS contact,
    s1 = 1 AND re1 - p1 < 2000 AS fore1, s2 = 1 AND re2 - p2 < 2000 AS fore2, s1 = 0 AND p1 - rs1 < 2000 AS back1, s2 = 0 AND p2 - rs2 < 2000 AS back2
  FROM (SELECT *, CASE WHEN p1 - rs1 < re1 - p1 THEN rs1 ELSE re1 END AS n1, CASE WHEN p2 - rs2 < re2 - p2 THEN rs2 ELSE re2 END AS n2 FROM (
    SELECT read_id, c1, p1, s1, rs1, re1, c2, p2, s2, rs2, re2 FROM base WHERE NOT (c1 > c2 OR c1 = c2 AND p1 > p2)
    UNION ALL SELECT read_id, c2, p2, s2, rs2, re2, c1, p1, s1, rs1, re1 FROM base WHERE c1 > c2 OR c1 = c2 AND p1 > p2)))""", "base"))
def site_classes(s, d):
    return pairs.site_classes(I.contacts(s, d), 2000).select("read_id", "c1", "p1", "c2", "p2", "category")


@query(sql("SELECT b.bin, min(why) AS why FROM (SELECT b.bin, CASE WHEN 160 - coalesce(cells, 0) > 144 THEN 'zeros' WHEN coalesce(total, 0) < 60 THEN 'low count' END AS why FROM bins b LEFT JOIN cover c ON b.bin = c.bin UNION ALL SELECT bin, 'empty diagonal' FROM bins WHERE bin NOT IN (SELECT i FROM full_ WHERE i = j)) b WHERE why IS NOT NULL GROUP BY 1", "base", "half", "full_", "cover", "bins"))
def bad_bins_for_modelling(s, d):
    return badbins.for_modelling(_full(s, d), I.bins(s), 160, 90, 60, auto=False)


_SIZE_MADS = "SELECT (SELECT median(abs(size - (SELECT median(size) FROM sz))) FROM sz)::double AS mad, (SELECT median(abs(size - (SELECT median(size) FROM sz))) FROM sz WHERE size >= (SELECT median(size) FROM sz))::double AS right_mad"


@query(sql("", "base").rstrip() + ", " + _SIZES + " " + _SIZE_MADS)
def size_deviations(s, d):
    sizes = stats.insert_sizes(I.contacts(s, d))
    each = sizes.select(F.explode(F.array_repeat(F.col("size").cast("double"), F.col("n").cast("int"))).alias("size"))
    return stats.mad("size", each).crossJoin(stats.right_double_mad("size", each).withColumnRenamed("mad", "right_mad"))


@query(sql("", "base").rstrip() + ", " + _SIZES + " SELECT size, n, round(avg(n) OVER (ORDER BY size ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 9) AS smooth FROM (SELECT r.range AS size, count(sz.size) AS n FROM range(801) r LEFT JOIN sz ON sz.size = r.range GROUP BY 1)")
def molecule_lengths(s, d):
    return stats.molecule_lengths(I.contacts(s, d), 20, 800).select("size", "n", _r("smooth", 9))


@query(sql("SELECT side, win AS \"window\", n, sum(n) OVER (PARTITION BY side ORDER BY win)::bigint AS upto FROM (SELECT 1 AS side, p1 // 1000 AS win, count(*) AS n FROM base GROUP BY 2 UNION ALL SELECT 2, p2 // 1000, count(*) FROM base GROUP BY 2)", "base"))
def cumulative_mapped(s, d):
    rows = I.contacts(s, d)
    sides = [rows.groupBy(F.expr(f"p{k} div 1000").alias("window")).agg(F.count("*").alias("n")).select(F.lit(k).alias("side"), "window", "n") for k in (1, 2)]
    return stats.cumulative_mapped(sides[0].unionByName(sides[1]))


@query("SELECT doc_id AS chrom, b AS bin, round(length(regexp_replace(s, '[^GC]', '', 'g'))::double / nullif(length(regexp_replace(s, '[^ACGT]', '', 'g')), 0), 9) AS gc FROM (SELECT doc_id, b, upper(substring(text, b * 100 + 1, 100)) AS s FROM documents, unnest(range((length(text) - 1) // 100 + 1)) t(b) WHERE length(text) > 0)")
def base_content(s, d):
    genome = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("chrom"), F.col("text").alias("seq"))
    return stats.base_content(genome, 100).select("chrom", "bin", _r("gc", 9))


@query(sql("SELECT particle, round(avg(density), 6) AS density FROM (SELECT particle, 2.0 * 100000 / sqrt(pow(lead(x) OVER w - lag(x) OVER w, 2) + pow(lead(y) OVER w - lag(y) OVER w, 2) + pow(lead(z) OVER w - lag(z) OVER w, 2)) AS density FROM particles WINDOW w AS (PARTITION BY model ORDER BY particle)) WHERE density IS NOT NULL GROUP BY 1", "particles"))
def model_density(s, d):
    return models3d.density(I.particles(s, d), 100_000).select("particle", _r("density"))


@query(sql("SELECT particle, round(avg(v) OVER w, 6) AS mean, round(avg(v) OVER w - 2 * avg(sd) OVER w, 6) AS low, round(avg(v) OVER w + 2 * avg(sd) OVER w, 6) AS high FROM (SELECT particle, avg(x) AS v, stddev_pop(x) AS sd FROM particles GROUP BY 1) WINDOW w AS (ORDER BY particle ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)", "particles"))
def windowed_coordinates(s, d):
    return models3d.windowed(I.particles(s, d), 5, "x").select("particle", _r("mean"), _r("low"), _r("high"))


_MODELS = "SELECT vec_id AS seed, embedding[1]::double AS objfun FROM embeddings"


def _models(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("seed"), F.col("embedding")[0].cast("double").alias("objfun"))


@query(f"SELECT seed, objfun, (row_number() OVER (ORDER BY objfun, seed) - 1)::int AS rank FROM ({_MODELS}) ORDER BY objfun, seed LIMIT 20")
def best_models(s, d):
    return models3d.best_models(_models(s, d), 20)


@query(f"SELECT seed, objfun, (row_number() OVER (ORDER BY objfun, seed) - 1)::int AS rank FROM (SELECT seed, objfun FROM ({_MODELS}) WHERE seed % 2 = 0 UNION ALL SELECT seed, objfun + 1 FROM ({_MODELS}) WHERE seed % 2 = 1)")
def extended_models(s, d):
    every = _models(s, d)
    return models3d.extended(every.where("seed % 2 = 0"), every.withColumn("objfun", F.col("objfun") + 1))


_DATA = "dat AS (SELECT sh.share, f.v::double AS v FROM (SELECT i, j, avg((d <= 0.3)::int::double) AS share FROM pp GROUP BY 1, 2) sh JOIN full_ f ON f.i = sh.i AND f.j = sh.j), rk AS (SELECT *, rank() OVER (ORDER BY share) + (count(*) OVER (PARTITION BY share) - 1) / 2 AS ra, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS rb FROM dat)"


@query(sql("", "base", "half", "full_", "particles", "pp").rstrip() + ", " + _DATA + " SELECT round(corr(share, v), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, round(corr(CASE WHEN share > 0 THEN ln(share) END, ln(v)), 6) AS logpearson, count(*) AS n FROM rk")
def models_with_data(s, d):
    cells = normalize.checkpointed(_full(s, d))
    return models3d.with_data(models3d.contact_matrix(models3d.among(I.particles(s, d), cells), 0.3), cells).select(_r("pearson"), _r("spearman"), _r("logpearson"), "n")


@query(sql("SELECT round(corr(a, b), 6) AS corr FROM (SELECT i, j, avg(CASE WHEN model % 2 = 0 THEN (d <= 0.3)::int::double END) AS a, avg(CASE WHEN model % 2 = 1 THEN (d <= 0.3)::int::double END) AS b FROM pp GROUP BY 1, 2) WHERE a IS NOT NULL AND b IS NOT NULL", "particles", "pp"))
def compared_ensembles(s, d):
    p = I.particles(s, d)
    return models3d.compare_ensembles(p.where("model % 2 = 0"), p.where("model % 2 = 1"), 0.3).select(_r("corr"))


@query(sql("SELECT round(avg(CASE WHEN i % 3 <> j % 3 THEN d END) * (n - 3) / (avg(CASE WHEN i % 3 = j % 3 THEN d END) * 2), 6) AS ch FROM (SELECT i, j, avg(d) AS d FROM pp GROUP BY 1, 2), (SELECT count(DISTINCT particle) AS n FROM particles) GROUP BY n", "particles", "pp"))
def cluster_quality(s, d):
    p = I.particles(s, d)
    scores = models3d.distance_matrix(p).select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("mean").alias("d"))
    clusters = p.select(F.col("particle").alias("item")).distinct().withColumn("cluster", F.col("item") % 3)
    return stats.cluster_quality(scores, clusters).select(_r("ch"))


@query(sql("SELECT b.bin AS i, 160 AS n, coalesce(sum(v), 0)::double AS total, coalesce(sum(v * f.j), 0)::double AS moment FROM bins b LEFT JOIN full_ f ON f.i = b.bin GROUP BY 1", "base", "half", "full_", "bins"))
def dense_map_rows(s, d):
    """Whole rows of the map with their zeros, checked by size, sum and first moment."""
    rows = pixels.dense_rows(s, _full(s, d), 160)
    add = lambda f: F.aggregate(f, F.lit(0.0), lambda x, y: x + y)
    moment = F.transform("row", lambda v, k: v * k)
    return rows.select("i", F.size("row").alias("n"), add(F.col("row")).alias("total"), add(moment).alias("moment"))


def _fine(s, d, width: int = 1000):
    """A map of 1 kb bins: 3,000 bins a chromosome."""
    place = lambda k: F.expr(f"cast(c{k} * 3000 + p{k} div {width} as bigint)")
    return pixels.half_pixels(I.contacts(s, d), place(1), place(2))


_FINE = "fine AS (SELECT least(a, b) AS i, greatest(a, b) AS j, count(*) AS v FROM (SELECT c1 * 3000 + p1 // 1000 AS a, c2 * 3000 + p2 // 1000 AS b FROM base) GROUP BY 1, 2)"


@query(sql("", "base").rstrip() + ", " + _FINE + " SELECT i, j, v FROM fine")
def fine_pixels(s, d):
    return _fine(s, d)


@query(sql("", "base").rstrip() + ", " + _FINE + ", sym AS (SELECT i, j, CASE WHEN i = j THEN 2 * v ELSE v END AS v FROM fine UNION ALL SELECT j, i, v FROM fine WHERE i <> j), t AS (SELECT i AS bin, sum(v)::double AS s FROM sym GROUP BY 1), m AS (SELECT avg(s) AS m FROM t) SELECT bin, round(s / m * sqrt(m), 9) AS b FROM t, m")
def fine_bias(s, d):
    return normalize.vanilla(pixels.symmetric(_fine(s, d))).select("bin", _r("b", 9))


def _wide_counts(s, d):
    """Cis and total contacts of 10 kb bins."""
    rows = I.contacts(s, d)
    end = lambda k: rows.select(F.expr(f"cast(c{k} * 300 + p{k} div 10000 as bigint)").alias("bin"), (F.col("c1") == F.col("c2")).cast("int").alias("cis"))
    return end(1).unionByName(end(2)).groupBy("bin").agg(F.sum("cis").alias("cis"), F.count("*").alias("total"))


@query()
def bad_bins_cis_share(s, d):
    return badbins.by_cis_share(_wide_counts(s, d), 1500, min_perc=5, max_perc=99)


@query()
def additive_bias(s, d):
    """Biases of 10 kb bins from three covariates that stand in for mappability, GC content and cut sites."""
    counts = _wide_counts(s, d).select("bin", F.col("total").alias("s"))
    b = F.col("id")
    covariates = s.range(1500).select(b.alias("bin"), (b % 300 / 300).alias("map"), (F.sin(b.cast("double")) / 2 + 0.5).alias("cg"), (b % 7).cast("double").alias("res"))
    return normalize.one_d(counts, covariates).select("bin", _r("b", 6))


@query()
def fine_domains(s, d):
    """Likelihood domains of any length on maps of 10 kb bins."""
    place = lambda k: F.expr(f"cast(c{k} * 300 + p{k} div 10000 as bigint)")
    cells = pixels.symmetric(pixels.half_pixels(I.contacts(s, d), place(1), place(2)))
    b = F.col("id")
    bins = s.range(1500).select(b.alias("bin"), F.expr("cast(id div 300 as int)").alias("chrom"), (b % 300).alias("idx"))
    return segment.domains_by_likelihood(cells, bins)


_AGREE = """zo AS (SELECT i, j, (l - avg(l) OVER ()) / stddev_pop(l) OVER () AS z FROM (SELECT i, j, log10(v) AS l FROM full_ WHERE i <= j)),
zm AS (SELECT i, j, (l - avg(l) OVER ()) / stddev_pop(l) OVER () AS z FROM (SELECT i, j, log10(count(*)) AS l FROM pp WHERE d <= 0.5 GROUP BY 1, 2)),
dd AS (SELECT zo.j - zo.i AS k, zo.z - zm.z AS d FROM zo JOIN zm ON zo.i = zm.i AND zo.j = zm.j),
cc AS (SELECT k, d, d - avg(d) OVER (PARTITION BY k) AS c FROM dd),
mm AS (SELECT k, count(*) AS n, avg(d) AS mean, sqrt(avg(c * c)) AS deviation, sqrt(avg(d * d)) AS distance, avg(c * c * c) AS c3, avg(c * c * c * c) AS c4 FROM cc GROUP BY k),
ss AS (SELECT *, CASE WHEN deviation > 1e-9 THEN c3 / pow(deviation, 3) END AS skew, CASE WHEN deviation > 1e-9 THEN c4 / pow(deviation, 4) - 3 END AS kurtosis FROM mm)"""
_AGREED = ("mean", "deviation", "distance", "skew", "kurtosis", "normality")


@query(sql("", "base", "half", "full_", "particles", "pp").rstrip() + ", " + _AGREE + " SELECT k, n, " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in _AGREED) + " FROM (SELECT *, n / 6 * (pow(skew, 2) + pow(kurtosis, 2) / 4) AS normality FROM ss)")
def zscore_agreement(s, d):
    """z-scores of the map against those of contacts in ten models, whose particles stand for bins."""
    cells, p = normalize.checkpointed(_full(s, d)), I.particles(s, d)
    every, here = (models3d.contact_shares(x, 0.5).select("i", "j", F.col("n").alias("v")) for x in (p, models3d.among(p, cells)))
    found = models3d.zscore_agreement(pixels.zscores(cells), pixels.zscores(here, every))
    return found.select("k", "n", *[(F.round(c, 5) + 0.0).alias(c) for c in _AGREED])


@query()
def parameter_search(s, d):
    """Eight sets of parameters for the first 32 bins: correlation of the models' contacts with the map at two cutoffs."""
    z = pixels.zscores(pixels.crop(_full(s, d), (0, 32, 0, 32))).where("i < j")
    settings = [{"max_dist": m, "upper": u, "lower": l} for m in (300.0, 500.0) for u in (0.0, 0.5) for l in (-1.0, -0.5)]
    results, _ = restraints.search(z, 32, settings, [150.0, 250.0], 50.0, 8, 4, steps=200)
    return results.select("set", "max_dist", "upper", "lower", "cutoff", _r("objfun", 3), _r("corr", 4))


_FITTED = """near_ AS (SELECT a.model, a.particle AS i, b.particle AS j, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d
  FROM particles a JOIN particles b ON a.model = b.model AND b.particle - a.particle BETWEEN 1 AND 3),
means_ AS (SELECT i, j, avg(d) AS m, var_pop(d) AS v FROM near_ GROUP BY 1, 2),
skew_ AS (SELECT n.i, n.j, any_value(m) AS m, any_value(v) AS v, CASE WHEN any_value(v) > 0 THEN avg(pow(d - m, 3)) / pow(any_value(v), 1.5) END AS s FROM near_ n JOIN means_ t ON n.i = t.i AND n.j = t.j GROUP BY 1, 2),
part_ AS (SELECT i, j, m, v, least(pow(greatest(coalesce(s, 0), 0) / 2, 2.0 / 3), 2.25 / 3.25) AS q FROM skew_),
fitted_ AS (SELECT i, j, k, m - k * width AS loc, width FROM (SELECT i, j, m, sqrt(q / (1 - q)) AS k, sqrt(v * (1 - q)) AS width FROM part_))"""
_DRAWN = """known_ AS (SELECT i, j, least(greatest(k, 0.5), 1.5) AS k, loc, width FROM fitted_ WHERE loc >= 0.01 AND width >= 0.01),
hex_ AS (SELECT *, sha256('1:' || model || ':' || i || ':' || j) AS h FROM known_, (SELECT unnest(range(5)) AS model)),
draws_ AS (SELECT *, """ + ", ".join(f"(cast('0x' || substr(h, {13 * n + 1}, 13) AS bigint) + 0.5) / 4503599627370496 AS u{n}" for n in range(4)) + " FROM hex_)"


@query(sql("", "particles").rstrip() + ", " + _FITTED + " SELECT i, j, round(k, 6) AS k, round(loc, 6) AS loc, round(width, 6) AS width FROM fitted_")
def distance_distributions(s, d):
    """Distributions of the distances of particles up to three apart, from the moments over the models."""
    return probable.fitted(I.particles(s, d), 3).select("i", "j", _r("k"), _r("loc"), _r("width"))


@query(sql("", "particles").rstrip() + ", " + _FITTED + ", " + _DRAWN + " SELECT model, i, j, round(loc + width * (sqrt(-2 * ln(u0)) * cos(2 * pi() * u1) - k * ln(u2)), 6) AS dist, round(u3, 9) AS place FROM draws_")
def drawn_distances(s, d):
    """A distance of every such pair in each of five models."""
    pairs = probable.known(probable.fitted(I.particles(s, d), 3), 0.01).where("known")
    return probable.drawn(pairs, 5).select("model", "i", "j", _r("dist"), _r("place", 9))


def _probable(s, d):
    """Models of the first 32 bins whose eight parents are placed first: (distributions, restraints, particles, headers)."""
    cells = pixels.crop(_full(s, d), (0, 32, 0, 32))
    fine = normalize.checkpointed(probable.expected(pixels.zscores(cells), 100.0, 500.0))
    whole = cells.groupBy(F.floor(F.col("i") / 4).alias("i"), F.floor(F.col("j") / 4).alias("j")).agg(F.sum("v").alias("v"))
    coarse = normalize.checkpointed(probable.expected(pixels.zscores(whole), 200.0, 800.0))
    return fine, *probable.two_level(fine.where("j - i <= 12"), coarse, 32, 4, 8, 4, 1.0, 50.0, far=12)


@query()
def probability_restraints(s, d):
    """Restraints of eight models from drawn distances, far pairs by their parents."""
    return _probable(s, d)[1].select("model", "i", "j", "type", _r("kforce"), _r("dist", 3))


@query()
def two_level_models(s, d):
    """The four best of these models: objective, and correlation of their distances with those expected from the map."""
    fine, _, particles, best = _probable(s, d)
    gaps = models3d.distances(particles).join(F.broadcast(fine.select("i", "j", "loc")), ["i", "j"])
    scored = gaps.groupBy("model").agg(compare.known_corr(F.col("d"), F.col("loc")).alias("corr"))
    return best.join(scored, "model").select("model", _r("objfun", 3), _r("corr", 4))
