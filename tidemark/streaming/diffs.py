"""A stream of diffs, each answered as it comes; the same answers as in batch.

Nothing is kept between diffs: a micro-batch's diffs are parsed where they are and each is
answered over the tree of files that the caller gives. However many diffs a batch has, they come
to the driver one by one, and answers go to the sink ``AT_ONCE`` diffs together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.analyse import Change, analyse
from tidemark.sources.config import CONFIG

#: Answers that go to the sink together.
AT_ONCE = 20


def answer_diffs(diffs: DataFrame, files: Callable[[], DataFrame], anchors: list[str], sink: Callable[[DataFrame, int], None], config_name: str = CONFIG, checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """diffs: a stream of (diff_id, text). ``sink`` gets (diff_id, anchor, affected, direction,
    changed, path) and the batch's number, several times for a large batch; ``files`` gives the tree as it is then."""

    def answer(batch: DataFrame, number: int) -> None:
        out, held = None, 0
        for r in batch.select("diff_id", "text").toLocalIterator():
            found = analyse(files(), Change.read(r["text"] or ""), anchors, config_name).withColumn("diff_id", F.lit(r["diff_id"]))
            out, held = found if out is None else out.unionByName(found), held + 1
            if held == AT_ONCE:
                sink(out, number)
                out, held = None, 0
        if out is not None:
            sink(out, number)

    writer = diffs.writeStream.foreachBatch(answer)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
