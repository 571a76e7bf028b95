import random

import pytest

from contactloom.operators import pixels
from contactloom.plans import verbs
from contactloom.sources import reads


@pytest.fixture(scope="module")
def genome(spark):
    rng = random.Random(11)
    rows = [(f"c{k}", k, 40_000, "".join(rng.choice("ACGT") for _ in range(40_000))) for k in range(2)]
    return spark.createDataFrame(rows, "chrom string, ord int, length long, seq string").cache()


@pytest.fixture(scope="module")
def mapped(spark):
    rng, one, two = random.Random(12), [], []
    for k in range(300):
        c = rng.randrange(2)
        p = rng.randrange(100, 39_000)
        q = min(39_900, max(50, int(p + rng.gauss(0, 4000)))) if rng.random() < 0.9 else rng.randrange(100, 39_000)
        d = c if rng.random() < 0.9 else 1 - c
        one.append((f"r{k}", f"c{c}", p, rng.randrange(2), 50, 0, 0))
        two.append((f"r{k}", f"c{d}", q, rng.randrange(2), 50, 0, 0))
    return spark.createDataFrame(one, reads.ENDS), spark.createDataFrame(two, reads.ENDS)


def test_from_ends_to_maps(spark, genome, mapped):
    ends = [verbs.parse(df, genome, "DpnII") for df in mapped]
    assert all(df.where("rs IS NULL").count() == 0 and df.count() == 300 for df in ends)
    valid, every = verbs.filter_pairs(*ends, over_represented=0.0)
    valid = valid.cache()
    assert every.count() == 300 and 0 < valid.count() < 300
    bins = pixels.bins_of(genome, 2000).cache()
    half = verbs.binned(valid, bins, 2000).cache()
    assert half.agg({"v": "sum"}).first()[0] == valid.count()
    total, by_distance = verbs.merge(half, half, bins, 4)
    assert total.agg({"v": "sum"}).first()[0] == 2 * valid.count()
    assert all(r.pearson == pytest.approx(1) for r in by_distance.collect() if r.pearson is not None)


def test_registered_queries_have_unique_names_and_sql(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70
