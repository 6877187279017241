"""Catalogue queries against their SQL on the smallest data.

``STORMGRID_ALL=1`` runs every query; the default is one of each family.
"""

import os

import pytest
from compare import difference, duck

import __spark_entry__ as entry

SOME = [
    "haversine", "grid_metrics_haversine", "label_components_space_time", "dateline_merge",
    "storm_statistics", "breakup_clouds", "box_minimum", "uniform_smooth_fields",
    "frontal_diagnostic_field", "regrid_midpoints", "object_extent_boxes", "tropical_cyclone_tracks",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(entry.oracle_sql()) if os.environ.get("STORMGRID_ALL") else SOME)
def test_query_equals_sql(spark, con, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    assert len(got) > 0
    assert difference(got, con.execute(entry.oracle_sql()[name]).df()) is None


def test_rivers_take_steps_from_the_storms_of_the_whole_chain(spark, con, sf_dir):
    """The latitude from which rivers count lay beyond the grid, so that no step was ever excluded."""
    name = "identify_all_storm_statistics"
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    alone = con.execute(entry.oracle_sql()["storm_statistics"]).df()
    assert difference(got, want) is None and 0 < len(got) < len(alone)


def test_entry_and_names(spark):
    assert entry.entry(spark).columns[:3] == ["run_id", "object_id", "t"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
