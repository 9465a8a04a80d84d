"""Blocks of benchmark items: one at a time, whatever their number."""

import pytest

from assayer.llm import decontaminate


@pytest.mark.parametrize("run", ["scan", "clean"])
def test_one_block_is_live_at_a_time(spark, monkeypatch, run):
    texts = [" ".join(f"w{k}x{i}" for i in range(20)) for k in range(30)]
    docs = spark.createDataFrame([(k, t if k % 2 else f"clean text number {k}") for k, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    size = items.selectExpr("sum(octet_length(text) + 32)").first()[0]
    live, most, made, ship = set(), [], [], decontaminate._ship

    def counted(df, block):
        shipped = ship(df, block)
        live.add(shipped)
        most.append(len(live))
        made.append(len(block))
        destroy = shipped.destroy
        monkeypatch.setattr(shipped, "destroy", lambda: (live.discard(shipped), destroy()))
        return shipped

    monkeypatch.setattr(decontaminate, "_ship", counted)
    out = getattr(decontaminate, run)(docs, items, block_bytes=2 * size // 5)
    assert len(made) == 5 and max(made) < 30 and sum(made) == 30 and max(most) == 1 and not live
    if run == "clean":
        assert {r.doc_id for r in out.collect()} == {k for k in range(30) if k % 2 == 0}
    else:
        assert {r.doc_id: r.item_ids for r in out.collect()} == {k: [str(k)] if k % 2 else [] for k in range(30)}
