"""What corpus queries leave in the shared folder: the tables that their results read, and no others."""

import os

import pytest

from skylattice.llm import queries
from skylattice.llm.common import shared_dir

KEPT = {
    "op1_mix_sources": {"mix-base", "mix-plan"}, "op4_near_duplicates": {"neardup-rows", "neardup-classes", "neardup-components"}, "op9_warc_fixity": {"warc", "fixity-differ"},
    "op11_merkle_manifest": {"manifest-blocks", "manifest-tops"}, "op12_centroid_clusters": {"clusters-assigned"},
}


@pytest.mark.parametrize("name", sorted(KEPT))
def test_only_what_the_result_reads_stays(spark, name):
    folder = shared_dir(spark)
    before = set(os.listdir(folder))
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert {n[:-33] for n in set(os.listdir(folder)) - before if not n.startswith(".")} <= KEPT[name]
    assert df.count() > 0
