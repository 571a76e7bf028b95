"""Registered queries read their tables whole."""

import itertools
import math
import random

import pytest

from contactloom.plans import catalogue
from contactloom.plans import inputs as I


@pytest.fixture(scope="module")
def embeddings(spark, tmp_path_factory):
    folder, rng = str(tmp_path_factory.mktemp("embeddings")), random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(453)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def test_models_have_a_particle_of_every_embedding(spark, embeddings):
    rows = I.particles(spark, embeddings).collect()
    assert sorted((r.model, r.particle) for r in rows) == sorted((k % 10, k // 10) for k in range(453))
    at = {(r.model, r.particle): (r.x, r.y, r.z) for r in rows}
    want = {
        (i, j): sum(math.dist(at[m, i], at[m, j]) <= 0.3 for m in range(10)) / 10 for i, j in itertools.combinations(range(45), 2)
    } | {(i, 45): sum(math.dist(at[m, i], at[m, 45]) <= 0.3 for m in range(3)) / 3 for i in range(45)}
    found = catalogue.queries()["model_contacts"](spark, embeddings).collect()
    assert {(r.i, r.j): pytest.approx(r.share) for r in found} == want
    for name in ("mean_coordinates", "model_interactions", "model_consistency"):
        assert catalogue.queries()[name](spark, embeddings).count() == 46, name
    assert catalogue.queries()["model_accessibility"](spark, embeddings).count() == 453


def test_models_of_different_lengths_are_compared_on_shared_particles(spark, embeddings):
    import numpy as np

    from contactloom.functions import geometry

    x = {m: np.array([[r.x, r.y, r.z] for r in sorted((r for r in I.particles(spark, embeddings).collect() if r.model == m), key=lambda r: r.particle)]) for m in range(10)}
    found = {(r.a, r.b): r for r in catalogue.queries()["model_scores"](spark, embeddings).collect()}
    assert set(found) == set(itertools.combinations(range(10), 2)) and (len(x[2]), len(x[3])) == (46, 45)
    for (a, b), r in found.items():
        n = min(len(x[a]), len(x[b]))
        p, q = geometry.superposed(x[a][:n], x[b][:n]), x[b][:n]
        gaps = [math.dist(p[i], p[j]) - math.dist(q[i], q[j]) for i, j in itertools.combinations(range(n), 2)]
        assert r.eqv == sum(math.dist(p[i], q[i]) < 0.3 for i in range(n))
        assert r.rmsd == pytest.approx(math.sqrt(sum(math.dist(p[i], q[i]) ** 2 for i in range(n)) / n), abs=1e-6)
        assert r.drmsd == pytest.approx(math.sqrt(sum(g * g for g in gaps) / len(gaps)), abs=1e-6)


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    folder, rng = str(tmp_path_factory.mktemp("lines")), random.Random(4)
    rows = [(k // 4 + 1, rng.randrange(1, 2000), rng.randrange(1, 100), k % 4 + 1, float(rng.randrange(1, 51))) for k in range(400)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_borders_of_all_contacts_find_their_nearest(spark, lines):
    contacts = I.contacts(spark, lines).collect()
    a, b = {(r.c1, r.p1) for r in contacts}, {(r.c2, r.p2) for r in contacts}

    def nearest(of, among):
        found = {}
        for c, p in of:
            near = [(abs(p - q), q) for k, q in among if k == c and abs(p - q) <= 20_000]
            if near:
                found[c, p] = min(near)[1]
        return found

    there, back = nearest(a, b), nearest(b, a)
    want = {(c, p, q, abs(p - q)) for (c, p), q in there.items()}
    found = [tuple(r) for r in catalogue.queries()["nearest_borders"](spark, lines).collect()]
    assert len(found) == len(set(found)) > 200 and set(found) == want
    found = [tuple(r) for r in catalogue.queries()["mutual_nearest_borders"](spark, lines).select("chrom", "a", "b", "d").collect()]
    assert len(found) == len(set(found)) and set(found) == {x for x in want if back.get((x[0], x[2])) == x[1]}


def test_segments_intervals_and_flags_are_of_all_contacts(spark, lines):
    contacts, queries = I.contacts(spark, lines).collect(), catalogue.queries()
    flags = {r.read_id: r.flag for r in queries["flags_from_lists"](spark, lines).collect()}
    assert flags == {r.read_id: (r.read_id % 2 == 0) + 256 * (r.read_id % 3 == 0) for r in contacts}
    overlaps = lambda p: any(min(p + 30_000, k + 200_000) - max(p, k) > 10 for k in range(0, 2_000_000, 250_000))
    assert {r.id for r in queries["lifted_segments"](spark, lines).collect()} == {r.read_id for r in contacts if overlaps(r.p1)}
    value = sum(r.read_id % 10 for r in contacts)
    assert sum(r.value for r in queries["binned_annotation"](spark, lines).collect()) == value
    assert sum(r.value for r in queries["interval_means"](spark, lines).collect()) == pytest.approx(1.5 * value, abs=1e-3)
