import itertools
import random
import zlib

from collections import Counter

import numpy as np
import public_tokenizers
from celerix.llm import tokens_repair as T
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from .conftest import docs_of

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_files_hold_the_tokenizers_ids(spark, corpus):
    rows = [*corpus, (2000, "<|endoftext|> it's I'LL don't İstanbul é \x1c x")]
    tokenizer = Tokenizer.from_file(PATH)
    got = sorted((tuple(r) for r in T.read_shards(T.write_shards(docs_of(spark, rows), PATH, shard_tokens=5000)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    at = 0
    want = {}
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(doc, set()).add((len(ids), zlib.crc32(ids.tobytes())))
    for doc, start, n, crc in got:
        assert start == at and (n, crc) in want[doc]
        at += n
    assert T.read_shards(T.write_shards(docs_of(spark, rows).limit(0), PATH)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6) | st.integers(65000, 70000), max_size=60), min_size=1, max_size=8))
def test_round_trip_and_random_access(docs):
    parts = [np.array([*d, T.END], np.uint32) for d in docs for _ in range(3)]
    flat = np.concatenate(parts)
    sequence, rules, first = T.repair(flat, min_count=2)
    assert np.array_equal(T.expand(sequence, rules, first), flat)
    pairs = [tuple(x) for x in zip(sequence[:-1].tolist(), sequence[1:].tolist(), strict=True) if T.END not in x]
    assert all(n < 2 or a == b for (a, b), n in Counter(pairs).items())  # nothing is left to replace
    old = T.MIN_COUNT
    shard = T.Shard(T.Shard.dump(list(range(len(parts))), np.array([len(p) for p in parts]), flat))
    assert T.MIN_COUNT == old
    for k, p in enumerate(parts):
        assert np.array_equal(shard.document(k), p)
        for a in range(0, len(p), 7):
            assert np.array_equal(shard.ids(k, a, min(len(p), a + 9)), p[a : a + 9])


def test_words_equal_the_whole_tokenizer(sf):
    """Word by word and from the model's parts: the same ids as of whole texts."""
    import pyarrow.parquet as pq

    tokenizer = Tokenizer.from_file(PATH)
    texts = [t or "" for t in pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column(0).to_pylist()]
    texts += ["it's We'LL x'd 'sup ''t don't", "a<|endoftext|>b <|startoftext|>", "Ünïcödé ÀÉ ß ÿ! Straße... ×÷ µ ª º", "ﬁ Ⅷ ½ x² İI ΣΑΣ σ", "e\u0301 \u0301 \u00a0x\u2003y \x1cz", "a1b2 ___ a_b -- (x) [y]{z}~`^", "語 日本 🙂🙂 \ud7ff"]
    ids, sizes = T.encoder(PATH).encode([t.encode() for t in texts])
    at = 0
    for t, n in zip(texts, sizes.tolist(), strict=True):
        assert ids[at : at + n].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, T.END], t[:80]
        at += n


def test_random_words_equal_the_whole_tokenizer():
    """Pieces are cut, lower-cased and found in batches: marks, signs, special tokens, long pieces and bytes near letters' ones."""
    tokenizer, rng = Tokenizer.from_file(PATH), random.Random(3)
    some = [*"abzABZHhKSs  \n\t.,!'-<|>09", *"éÉßÿŸ×÷ÀÞþªµÃÖİΣ語🙂", "\u0301", "\u0331", "\u0130", "\u212a", "\u212b", "\x00", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "x" * 23, "y" * 25, "!" * 30, "É" * 12]
    encoder = T.WordEncoder(PATH)
    for _ in range(150):
        texts = ["".join(rng.choices(some, k=rng.randrange(50))) for _ in range(rng.randrange(25))]
        ids, sizes = encoder.encode([t.encode() for t in texts])
        at = 0
        for t, n in zip(texts, sizes.tolist(), strict=True):
            assert ids[at : at + n].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, T.END], t
            at += n
        assert at == len(ids)


def test_each_piece_goes_through_the_model_once():
    encoder, calls = T.WordEncoder(PATH), []
    plain = encoder.tokenize
    encoder.tokenize = lambda x: calls.append(x) or plain(x)
    words = ["".join(w).encode() for w in itertools.product("bcdfghjklmnprstvwxyz", repeat=4)]
    for shape in (b"%s", b"%s,", b"%s!"):
        encoder.encode([b" ".join((shape % w).title() for w in words)])
    assert len(calls) == len(set(calls)) == len(words) + 2


def test_kept_words_are_bounded_by_their_bytes(monkeypatch):
    """Texts without spaces are words as long as they are: what is kept of them must not grow with their number."""
    monkeypatch.setattr(T, "KNOWN_BYTES", 1 << 20, raising=False)
    encoder = T.WordEncoder(PATH)
    kept = lambda x: sum(map(kept, x)) if isinstance(x, (list, tuple, dict)) else len(x) if isinstance(x, bytes) else 0
    for k in range(60):
        encoder.encode([f"{k}{j}語{'語x' * 8000}".encode() for j in range(4)])
        assert max(map(kept, vars(encoder).values())) < 2 << 20


def test_grammar_compresses():
    rng = np.random.default_rng(0)
    phrase = rng.integers(2, 49000, 12)
    flat = np.concatenate([np.concatenate([rng.integers(2, 49000, 5), phrase]) for _ in range(400)]).astype(np.uint32)
    sequence, rules, first = T.repair(flat)
    assert len(sequence) < 0.45 * len(flat) and T.expansion_lengths(rules, first).max() >= 8
    assert np.array_equal(T.expand(sequence, rules, first), flat)


def test_pairs_that_are_too_rare_are_not_sorted(monkeypatch):
    rng = np.random.default_rng(1)
    rare = rng.permutation(np.arange(2, 60002)).astype(np.uint32)
    flat = np.concatenate([rare, np.tile(np.array([70000, 70001, T.END], np.uint32), 50)])
    sizes, plain = [], np.sort
    monkeypatch.setattr(np, "sort", lambda x, *a, **b: sizes.append(len(x)) or plain(x, *a, **b))
    sequence, rules, first = T.repair(flat)
    monkeypatch.undo()
    assert rules.tolist() == [[70000, 70001]] and np.array_equal(T.expand(sequence, rules, first), flat)
    assert 50 <= sum(sizes) < len(flat) / 10
