"""Queries that need no stored index write none: it is larger than the texts that it is made of."""

import os
import shutil

import pytest

from tessera import catalog, registry
from tests.oracle import same

SF = "/root/testdata/sf0.001"
registry.load()


@pytest.mark.parametrize("name", ["rank_visual", "channel_agreement"])
def test_no_term_index_is_written(spark, tmp_path, name):
    tables = shutil.copytree(SF, tmp_path / "new")  # tables that no index is known of
    made = lambda: {n for n in os.listdir(catalog.shared_root(spark)) if n.startswith("term-index")}
    before = made()
    same(registry.QUERIES[name](spark, str(tables)), registry.ORACLES[name], str(tables))
    assert made() == before
