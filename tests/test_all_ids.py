"""The look-ups are registered for all ids."""

import os

import pytest

from patchloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_lookups_ask_for_all_ids(spark):
    every = registry.queries()
    words = {r["element_id"] for r in every["dictionary_encode"](spark, SF).collect()}
    patches = {r["patch_id"] for r in every["patch_size"](spark, SF).collect()}
    assert {r["element_id"] for r in every["reverse_map"](spark, SF).collect()} == words
    assert {r["element_id"] for r in every["patches_of"](spark, SF).collect()} == words | {max(words) + 1}
    assert {r["patch_id"] for r in every["patch_lookup"](spark, SF).collect()} == patches | {max(patches) + 1}
