"""Every registered query of the library gives the rows of its SQL."""

import os

import pytest

from plurivox.plans import registry

from .parity import assert_same, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_parity(spark, con, name):
    assert_same(registry.queries()[name](spark, SF), con, registry.oracles()[name])


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def ids(spark, name, key):
    return {r[key] for r in table(spark, name).select(key).collect()}


def segments_hold(rows, key):
    assert len({r[key] for r in rows}) == len(rows)
    assert all(list(r["boundaries"]) == sorted(set(r["boundaries"])) and all(b - a >= 3 for a, b in zip([0, *r["boundaries"]], r["boundaries"])) for r in rows)
    assert any(r["boundaries"] for r in rows)


def communities_hold(spark, rows):
    assert {r["node"] for r in rows} <= ids(spark, "embeddings", "vec_id") and len({r["node"] for r in rows}) == len(rows)
    least = {}
    for r in rows:
        least[r["label"]] = min(r["node"], least.get(r["label"], r["node"]))
    assert len(least) > 2 and all(k == v for k, v in least.items())


def keywords_hold(rows):
    picks = {}
    for r in rows:
        picks.setdefault(r["source"], []).append(set(r["term"].split()))
    assert all(not (a <= b or b <= a) for ps in picks.values() for k, a in enumerate(ps) for b in ps[:k]) and max(map(len, picks.values())) == 8


#: What the rows of the queries without SQL must show; their operators are tested against brute force elsewhere.
HOLDS = {
    "communities": communities_hold,
    "live_recluster": lambda spark, rows: len(rows) > 2 and sum(r["n"] for r in rows) <= table(spark, "embeddings").count() and abs(sum(r["share"] for r in rows) - 1) < 0.01,
    "gamma_sweep": lambda spark, rows: [r["kept"] for r in rows].count(True) == 1 and max(rows, key=lambda r: r["modularity"])["kept"] and len(rows) == 8 and rows[0]["n_communities"] <= rows[-1]["n_communities"],
    "two_level_communities": lambda spark, rows: {r["node"] for r in rows} == ids(spark, "embeddings", "vec_id") and len({r["macro"] for r in rows}) == len({r["leaf"] for r in rows} & {r["macro"] for r in rows}) < len({r["leaf"] for r in rows}),
    "threshold_sweep": lambda spark, rows: [r["threshold"] for r in sorted(rows)] and all(r["communities"] > 2 and -0.5 <= r["modularity"] <= 1 for r in rows),
    "root_coarsening": lambda spark, rows: {r["label"] for r in rows} == ids(spark, "embeddings", "label") and all(r["root"] <= r["label"] for r in rows),
    "theme_keywords": lambda spark, rows: keywords_hold(rows),
    "centroid_segments": lambda spark, rows: segments_hold(rows, "doc_id"),
    "change_points": lambda spark, rows: segments_hold(rows, "doc_id"),
    "community_segments": lambda spark, rows: segments_hold(rows, "doc_id"),
    "boundary_scorecard": lambda spark, rows: len(rows) == 1 and 0 < rows[0]["precision"] <= 1 and 0 < rows[0]["recall"] <= 1 and 0 <= rows[0]["pk"] <= 1,
    "components_removed": lambda spark, rows: {r["vec_id"] for r in rows} == ids(spark, "embeddings", "vec_id") and all(r["norm"] == 1.0 and r["cosine"] <= 1 for r in rows),
    "bootstrap_agreement": lambda spark, rows: len(rows) == 6 and all(r["one"] < r["other"] and -1 <= r["ari"] <= 1 for r in rows),
    "layer_chain": lambda spark, rows: sorted(r["level"] for r in rows) == list(range(len(rows))) and min(rows)["cleanliness"] == 1,
    "deletion_shapes": lambda spark, rows: {r["seed"] for r in rows} == {0, 1, 2} and all(r["macros"] <= r["leaves"] for r in rows),
    "anonymised_texts": lambda spark, rows: {r["lang"] for r in rows} == ids(spark, "documents", "lang") and sum(r["email"] for r in rows) > 0,
}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_rows_hold(spark, name):
    assert HOLDS[name](spark, registry.queries()[name](spark, SF).collect()) in (True, None)
