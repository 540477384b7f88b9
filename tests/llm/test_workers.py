"""What Python workers, which outlive the stages of a pipeline, hold after a stage."""

import pyarrow as pa

from porelake.llm import packing, similar
from porelake.llm.queries import vocabulary


def held(spark):
    """The encoders of each worker: more tasks than workers, which take turns."""

    def look(batches):
        import os
        import time

        from porelake.llm import tokens

        list(batches)
        time.sleep(0.05)
        yield pa.RecordBatch.from_pydict({"pid": pa.array([os.getpid()], pa.int64()), "n": pa.array([len(tokens._ENCODERS)], pa.int64())})

    return {r.pid: r.n for r in spark.range(0, 96, 1, 96).mapInArrow(look, "pid long, n long").collect()}


def test_encoders_stay_for_tasks_of_the_stage_and_go_with_the_next(spark):
    docs = spark.createDataFrame([(i, f"words of number{i} and more") for i in range(96)], "doc_id long, text string").repartition(96)
    pieces = packing.cut(docs, vocabulary("word_bpe_49k.json"))
    assert any(held(spark).values())
    assert len({r.doc_id for r in similar.codes(docs, 5).collect()}) == 96
    after = held(spark)
    assert after and not any(after.values())
    again = packing.cut(docs, vocabulary("word_bpe_49k.json"))
    assert sorted((r.doc_id, bytes(r.ids)) for r in again.collect()) == sorted((r.doc_id, bytes(r.ids)) for r in pieces.collect())
