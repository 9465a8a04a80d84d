"""The catalog tables derived from the given ones: keys are unique on every scale."""

import pytest

from assayer.plans.proxies import Tables


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
def test_item_keys_are_unique(spark, scale):
    t = Tables(spark, f"/root/testdata/sf{scale}")
    for df, key in ((t.items, "item_id"), (t.items, "row_no"), (t.media, "media_id"), (t.media, "item_id"), (t.saved, "item_id")):
        assert df.count() == df.select(key).distinct().count(), key
