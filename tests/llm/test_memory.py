"""What Python workers hold while a task runs and after it."""

import gc
import re
import tracemalloc
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from celerix.llm import common, jaccard_join
from celerix.llm import language_ppm as L
from celerix.llm import tokens_repair as T

from .conftest import docs_of

PATH = public_tokenizers.path("word_bpe_49k.json")


def encoders() -> int:
    gc.collect()
    return sum(isinstance(x, T.WordEncoder) for x in gc.get_objects())


def test_tasks_drop_what_other_operators_left(spark, monkeypatch):
    """The tokenizer and its words serve the next tasks of tokens_repair, and are gone when another operator's task has begun."""
    docs, tasks = docs_of(spark, [(1, "one two"), (2, None)]), []
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **b: tasks.append(f) or plain(self, f, *a, **b))
    L.keep_identified(docs, L.Model({}))
    jaccard_join._signed(docs)
    T.read_shards(T.write_shards(docs, PATH))
    language, signed, _, read = tasks
    for other in (language, signed):
        T.encoder(PATH).encode([b"one two"])
        list(read(iter([])))
        assert encoders() == 1
        list(other(iter([])))
        assert encoders() == 0


def test_lean_tasks_hand_back_what_they_free():
    if not Path("/proc/self/smaps_rollup").exists():
        pytest.skip("no way to see the process's memory")
    private = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
    last = []

    def run(batches):
        arrays = [np.ones(8000) for _ in range(2000)]  # 128 MB, below an array that stays
        last.append(np.ones(8000))
        yield len(arrays)

    before = private()
    assert list(common.lean(run)(iter([]))) == [2000]
    assert private() < before + 40


def test_code_lengths_hold_one_chunk_of_numbers():
    model = L.Model({"a": [b"abcab" * 50], "b": [b"xyzzy" * 50]})
    text = b"abcxyz" * (1 << 20)  # 6 MB
    model.code_lengths([text[:100]])
    tracemalloc.start()
    bits = model.code_lengths([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 7 * len(text)
    assert np.allclose(bits[0], model.code_lengths([text[: len(text) // 2]])[0] * 2, rtol=1e-4)


def test_encoding_a_batch_holds_arrays_of_its_pieces(spark, monkeypatch):
    """A batch of 8 MB is encoded piece by piece: beside its tokens a task holds what one piece takes."""
    words = [f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'aeiou'[k // 100 % 5]}n" for k in range(500)]
    texts = [" ".join(words) * 8 for _ in range(400)]  # 8 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    docs, tasks = docs_of(spark, [(1, "one")]), []
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **b: tasks.append(f) or plain(self, f, *a, **b))
    T.write_shards(docs, PATH)
    monkeypatch.setattr(T, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(T.Shard, "dump", lambda names, sizes, ids: b"")
    T.encoder(PATH).encode([b"one"])
    tracemalloc.start()
    for _ in tasks[0](iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 << 20
