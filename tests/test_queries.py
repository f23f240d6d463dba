"""Registered queries against their check SQL on the smallest tables. The whole
list at the next size is run by `python tests/compare.py`."""

import pytest
from compare import compare, connect

from fiscalis.plans import all_queries

SF = "/root/testdata/sf0.001"
SOME = ["fea11_feature_table", "fea18_last_years_split", "cat07_region_of_dataset", "cat10_safe_file_name", "sel08_latest_snapshot",
        "nrm02_header_dialect", "nrm05_sdmx_chapters", "nrm10_labelled_phases", "val02_whole_file_acceptance", "val03_duplicate_blocks",
        "mod24_prediction_table", "ana13_correlations", "ana15_describe", "ana24_pipeline_state", "ana32_region_comparison",
        "sta05_levene_pooled", "sta11_kruskal_by_region", "src05_number_format", "src11_cube_files", "src13_routed_files",
        "snk03_replace_regions", "snk08_orphan_counts", "snk11_prediction_ids"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SOME)
def test_query(spark, con, name):
    assert compare(spark, con, name, all_queries()[name], SF) in (None, "equal but empty")


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_names_without_a_session():
    """The names of the queries can be listed before there is a session."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout.split()[0]) >= 228
