"""Look-ups of the trie go over the tokens of many batches at once, and short buckets need no search."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinetrack.llm import lm_trie
from kinetrack.llm.elias_fano import EliasFano

TEXTS = [f"a b c{k % 7} a {'d e ' * (k % 5)}F{k % 3}" for k in range(60)] + ["", None, "new", "a b"]


class Local:
    """Stands for a DataFrame whose rows are batches of this process."""

    def __init__(self, model):
        self.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))
        self.model, self.looked = model, []

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run

    def scored(self, rows: int) -> list[dict]:
        table = pa.table({"doc_id": pa.array([None, *range(1, len(TEXTS))], pa.int64()), "text": pa.array(TEXTS, pa.string())})
        found = type(self.model).found

        def counted(level, context, word, **more):
            self.looked.append(len(context))
            return found(self.model, level, context, word, **more)

        self.model.found = counted
        try:
            return [r for b in lm_trie.score(self, self.model)(iter(table.to_batches(max_chunksize=rows))) for r in b.to_pylist()]
        finally:
            del self.model.found


def test_batches_are_looked_up_at_once(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS[:50])), "doc_id long, text string")
    model = lm_trie.train(docs.where(F.col("doc_id") >= 0), piece=16)
    one, many = Local(model), Local(model)
    whole, parts = one.scored(len(TEXTS)), many.scored(1)
    assert len(whole) == len(TEXTS) and whole == parts and [r["doc_id"] for r in whole] == [None, *range(1, len(TEXTS))]
    assert len(one.looked) == len(many.looked) == 2  # pairs and triples
    monkeypatch.setattr(lm_trie, "TOKENS", 40)
    some = Local(model)
    assert some.scored(1) == whole and 4 < len(some.looked) < len(TEXTS)


def test_short_buckets_are_not_searched():
    v = (np.arange(2000, dtype=np.uint64)[:, None] * np.uint64(64) + np.arange(3, dtype=np.uint64)).ravel()
    x, asked = EliasFano.of(v), []

    def within(rows):
        asked.append(len(rows))
        return np.zeros(len(rows), np.int64), np.full(len(rows), len(v))

    assert x.find(v, within).tolist() == list(range(len(v)))
    assert (x.find(v[2::3] + np.uint64(1), within) == -1).all() and not asked
    dense = np.concatenate([np.arange(50, dtype=np.uint64), np.uint64(1 << 20) + np.arange(50, dtype=np.uint64)])
    assert EliasFano.of(dense).find(dense).tolist() == list(range(100))
