from __future__ import annotations

import gc
import os

from grainline.llm import common


def test_drop_leaves_other_frames_alone(spark):
    scratch = common.Scratch(spark, "test")
    for i in range(12):
        kept = scratch.keep(spark.range(5), f"t{i}").where("id > 1")
        gc.collect()
        for _ in range(5):
            scratch.drop(spark.range(3))
        assert kept.count() == 3
    again = scratch.keep(spark.range(5))
    path = scratch.kept[id(again)][1]
    scratch.drop(again, again)
    assert not os.path.exists(path)
    scratch.close()


def test_release_deletes_what_was_opened_since(spark):
    first = common.Scratch(spark, "test")
    first.keep(spark.range(5))
    mark = common.opened()
    later = [common.Scratch(spark, "test") for _ in range(2)]
    for s in later:
        s.keep(spark.range(5))
    common.release(mark)
    assert [os.path.exists(s.root) for s in (first, *later)] == [True, False, False]
    first.close()
