"""What a worker of the piece encoder holds."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import types as T

from qualispark.llm import pieces


class _Worker:
    """Stands for a DataFrame and keeps the function that each of its tasks runs."""

    columns = ["doc_id", "text"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def drop(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_a_worker_of_the_piece_encoder_holds_little():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 7))) for _ in range(400)) for _ in range(1000)]
    batch = pa.record_batch({"doc_id": list(range(len(texts))), "text": texts})
    run = pieces.encode_documents(_Worker(), decoded="decoded")
    pieces.encoder().encode(["a"])
    tracemalloc.start()
    try:
        assert [t for part in run(iter([batch])) for t in part.column(3).to_pylist()] == texts
        assert tracemalloc.get_traced_memory()[1] < 110_000_000
    finally:
        tracemalloc.stop()
