"""Contacts, bins and models projected from the star-schema tables with integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RESOLUTION = 100_000
PER_CHROM = 32
CHROMS = 5
N_BINS = PER_CHROM * CHROMS

_END = """
select read_id, c1, p1, s1, 50 as l1, (p1 {d} 4096) * 4096 as rs1, (p1 {d} 4096) * 4096 + 4096 as re1,
       c2, p2, s2, 40 + cast(read_id % 3 as int) as l2, (p2 {d} 4096) * 4096 as rs2, (p2 {d} 4096) * 4096 + 4096 as re2
from (select r.*, case when c1 = c2 then p1 + delta else (p1 * 3 + delta) % 2000000 + 1 end as p2 from (
  select cast(l_orderkey * 8 + l_linenumber as bigint) as read_id,
         cast((l_orderkey * 31 + l_partkey) % 5 as int) as c1,
         cast(case when (l_orderkey * 7 + l_linenumber * 13) % 10 < 8 then (l_orderkey * 31 + l_partkey) % 5 else (l_suppkey + l_linenumber) % 5 end as int) as c2,
         cast((l_partkey * 7919 + l_orderkey * 104729) % 2000000 + 1 as bigint) as p1,
         cast(l_quantity as bigint) * cast(l_quantity as bigint) * cast(l_quantity as bigint) * 8 + (l_orderkey % 97) as delta,
         cast((l_orderkey + l_linenumber) % 2 as int) as s1, cast((l_partkey + l_linenumber) % 2 as int) as s2
  from lineitem) r) q
"""


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read pairs; only the five columns that they need are read from ``lineitem``."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(_END.format(d="div").replace("from lineitem)", "from {lines})"), lines=lines)


def with_copies(pairs: DataFrame) -> DataFrame:
    """Pairs plus a copy of every 37th."""
    return pairs.unionByName(pairs.where("read_id % 37 = 0").withColumn("read_id", F.col("read_id") + 1_000_000_000))


def bins(spark: SparkSession) -> DataFrame:
    """(bin, chrom, idx, start, end) of the five chromosomes."""
    b = F.col("id")
    return spark.range(N_BINS).select(
        b.alias("bin"), F.expr(f"cast(id div {PER_CHROM} as int)").alias("chrom"), (b % PER_CHROM).alias("idx"),
        (b % PER_CHROM * RESOLUTION).alias("start"), ((b % PER_CHROM + 1) * RESOLUTION).alias("end"),
    )


def bin_of(k: int):
    """Bin of a pair's end."""
    return F.expr(f"cast(c{k} * {PER_CHROM} + p{k} div {RESOLUTION} as bigint)")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten models whose particles are the first three values of all embeddings."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    axis = lambda k: F.col("embedding")[k].cast("double").alias("xyz"[k])
    return e.select((F.col("vec_id") % 10).alias("model"), F.expr("vec_id div 10").alias("particle"), axis(0), axis(1), axis(2))


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(experiment, chrom, start, end, score): domains between the local minima of insulation in the maps of even and of odd reads."""
    from contactloom.operators import pixels, segment

    rows, places, every = contacts(spark, sf_dir), bins(spark), None
    for name, rest in (("a", 0), ("b", 1)):
        half = pixels.half_pixels(rows.where(F.col("read_id") % 2 == rest), bin_of(1), bin_of(2))
        score = segment.insulation(half, places, 1, 3)
        w = Window.partitionBy("chrom").orderBy("idx")
        dips = score.withColumns({"before": F.lag("score").over(w), "after": F.lead("score").over(w)}).where("score < before and score <= after")
        starts = dips.select("chrom", F.col("idx").alias("start"), "score")
        starts = starts.unionByName(places.where("idx = 0").select("chrom", F.col("idx").alias("start"), F.lit(1.0).alias("score")))
        end = F.coalesce(F.lead("start").over(Window.partitionBy("chrom").orderBy("start")) - 1, F.lit(PER_CHROM - 1).cast("long"))
        found = starts.select(F.lit(name).alias("experiment"), "chrom", "start", end.alias("end"), "score")
        every = found if every is None else every.unionByName(found)
    return every


PAIRS_SQL = _END.format(d="//")
SQL = {
    "base": PAIRS_SQL,
    "pairs": "select * from base union all select * replace (read_id + 1000000000 as read_id) from base where read_id % 37 = 0",
    "bins": f"select range as bin, cast(range // {PER_CHROM} as int) as chrom, range % {PER_CHROM} as idx from range({N_BINS})",
    "half": f"select least(a, b) as i, greatest(a, b) as j, count(*) as v from (select c1 * {PER_CHROM} + p1 // {RESOLUTION} as a, c2 * {PER_CHROM} + p2 // {RESOLUTION} as b from base) group by 1, 2",
    "half_a": f"select least(a, b) as i, greatest(a, b) as j, count(*) as v from (select c1 * {PER_CHROM} + p1 // {RESOLUTION} as a, c2 * {PER_CHROM} + p2 // {RESOLUTION} as b from base where read_id % 2 = 0) group by 1, 2",
    "half_b": f"select least(a, b) as i, greatest(a, b) as j, count(*) as v from (select c1 * {PER_CHROM} + p1 // {RESOLUTION} as a, c2 * {PER_CHROM} + p2 // {RESOLUTION} as b from base where read_id % 2 = 1) group by 1, 2",
    "full_": "select i, j, case when i = j then 2 * v else v end as v from half union all select j, i, v from half where i <> j",
    "cover": "select i as bin, count(*) as cells, cast(sum(v) as bigint) as total from full_ group by 1",
    "bad": f"select b.bin from bins b left join cover c on b.bin = c.bin where coalesce(c.total, 0) < 50",
    "good": "select * from full_ where i not in (select bin from bad) and j not in (select bin from bad)",
    "sums": "select i as bin, sum(v)::double as s from good group by 1",
    "bias": "select bin, s / m * sqrt(m) as b from sums, (select avg(s) as m from sums)",
    "norm": "select g.i, g.j, g.v / x.b / y.b as v from good g join bias x on g.i = x.bin join bias y on g.j = y.bin",
    "particles": "select vec_id % 10 as model, vec_id // 10 as particle, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings",
    "pp": "select a.model, a.particle as i, b.particle as j, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) as d from particles a join particles b on a.model = b.model and a.particle < b.particle",
    "cis_ab": "select 'a' as experiment, x.chrom, x.idx as i, y.idx as j, v from half_a h join bins x on h.i = x.bin join bins y on h.j = y.bin where x.chrom = y.chrom union all select 'b', x.chrom, x.idx, y.idx, v from half_b h join bins x on h.i = x.bin join bins y on h.j = y.bin where x.chrom = y.chrom",
    "dips": "select * from (select *, lag(score) over w as before, lead(score) over w as after from (select e.experiment, b.chrom, b.idx, coalesce(sum(c.v), 0)::double as score from (select 'a' as experiment union all select 'b') e cross join bins b left join cis_ab c on c.experiment = e.experiment and c.chrom = b.chrom and c.i between b.idx - 3 and b.idx - 1 and c.j between b.idx + 1 and b.idx + 3 where b.idx between 3 and 28 group by 1, 2, 3) window w as (partition by experiment, chrom order by idx)) where score < before and score <= after",
    "domains": "select experiment, chrom, start, coalesce(lead(start) over (partition by experiment, chrom order by start) - 1, 31) as \"end\", score from (select experiment, chrom, idx as start, score from dips union all select e.experiment, b.chrom, b.idx, 1.0 from (select 'a' as experiment union all select 'b') e, bins b where b.idx = 0)",
}


def sql(body: str, *names: str) -> str:
    """``body`` after the named definitions, in order."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + body


def recursive(body: str, extra: str, *names: str) -> str:
    return "WITH RECURSIVE " + ", ".join([*[f"{n} AS ({SQL[n]})" for n in names], extra]) + " " + body
