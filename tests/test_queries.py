"""Queries next to their SQL twins. SIFTWORK_FULL=1 runs all of them."""

import os

import pytest

from siftwork.plans import all_oracles, all_queries

SF = os.environ.get("SIFTWORK_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = """k16_quota_selection k09_embedding_nn g04_utilities g06_labels b02_normalised_dedup b06_gram_overlap
c01_lengths c06_language_flags c13_model_stats d04_sketch e12_condition_vector e13_config_table g12_dispersion
p02_spearman t10_transfer_matrix t15_wilcoxon u04_token_f1 v05_overlap_symmetry w01_cost_rollup""".split()
NAMES = sorted(all_oracles()) if os.environ.get("SIFTWORK_FULL") else SAMPLE


@pytest.fixture(scope="session")
def duck():
    pytest.importorskip("duckdb")
    from check import connect

    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data is not here")
@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, duck, name):
    from check import compare

    msg = compare(all_queries()[name](spark, SF), duck, all_oracles()[name])
    assert msg is None, msg


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())
