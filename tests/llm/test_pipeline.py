"""run() against the stages' brute-force twins, and the guard around the folder."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from celerix.llm import jaccard_join, language_ppm
from celerix.llm.decontaminate import words_of
from tokenizers import Tokenizer

from .conftest import docs_of
from .conftest import docs_of as plain
from .test_decontaminate import brute as brute_leaks
from .test_jaccard_join import brute as brute_groups


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    model = language_ppm.learn(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    langs, _, rates = model.predict([(t or "").encode() for _, t in rows])
    rows = [r for r, lang, rate in zip(rows, langs, rates, strict=True) if lang != "und" and rate <= language_ppm.FOREIGN_BITS]
    keep = {c for (_, _, c) in brute_groups(rows)}
    rows = [r for r in rows if r[0] in keep]
    leaks = {k[0] for k in brute_leaks(rows, bench) if k[2]}  # every item has 13 words or more, so a hit is a full window
    assert all(len(words_of(t.encode())) >= 13 for _, t in bench)
    rows = [r for r in rows if r[0] not in leaks]
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, sf).collect()), key=lambda r: r[1])
    text = dict(rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, times = 0, {}
    for doc, start, n, crc in got:
        ids = np.array([*tokenizer.encode(text[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (start, n, crc) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += n
        times[doc] = times.get(doc, 0) + 1
    assert max(times.values()) <= 3 and len(times) > 0.3 * len(rows)


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark_leaks", "mix", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns


def test_rows_without_or_with_a_common_id_are_judged_by_their_text(spark, sf):
    """Only copies and leaks go, whatever the ids of unlike texts are."""
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(40))
    docs_of = lambda spark, rows: plain(spark, rows).selectExpr("*", "'q' as _id", "1 as class", "2 as copies", "3 as best", "4 as leaked", "5 as text_id", "6 as row")
    clean = [(None, text(k)) for k in range(5)] + [(7, text(10)), (7, text(11)), (8, text(12))]
    wordless = [(None, None), (None, None), (7, " "), (7, "")]
    copies = [(None, text(0)), (7, text(10)), (9, text(10) + " more"), (8, text(12).upper())]
    got = jaccard_join.keep_one(docs_of(spark, clean + wordless + copies))
    assert got.columns == docs_of(spark, clean).columns
    kept = Counter((r["doc_id"], (r["text"] or "").lower()) for r in got.collect())
    assert kept == Counter((d, t or "") for d, t in clean + wordless)
    item = next(r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(words_of((r["text"] or "").encode())) >= 13)
    left = corpus_pipeline.benchmark_leaks(spark, docs_of(spark, clean + wordless + [(None, item), (7, item)]), sf)
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(clean + wordless)
