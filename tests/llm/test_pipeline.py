"""The pipeline against a version of each stage by other means: plain loops, DuckDB and the sentencepiece library."""

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece

import corpus_pipeline
from latentfield.llm import quality, secret_scan
from latentfield.llm.queries import MIX_SQL

from .test_jaccard_join import brute as join_brute
from .test_quality import brute as counts
from .test_secret_scan import brute as base_spans


def redacted(text):
    """By plain patterns; what lies inside another span goes with it."""
    out, at = "", 0
    for kind, s, e in base_spans(text):
        if s >= at:
            out += text[at:s] + f"[SECRET:{kind}]"
        at = max(at, e)
    return out + text[at:]


def test_pipeline_equals_stages_by_other_means(spark, sf, docs):
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = []
    for r in docs.collect():
        n = counts(r.text)
        if n[0] < 50 or 100 * n[4] > 50 * n[0]:
            continue
        x, margin = quality.statistics(r.text.encode())[5], model.base
        for node in model.roots.tolist():  # down each tree by itself
            while model.left[node] != node:
                node = int(model.left[node] if x[model.feature[node]] <= model.threshold[node] else model.right[node])
            margin += model.value[node]
        if 1 / (1 + np.exp(-margin)) >= 0.3:
            kept.append(r)
    roots = join_brute([(r.doc_id, r.text) for r in kept])
    kept = [r for r in kept if roots[r.doc_id][1] == r.doc_id]
    assert not any(secret_scan.confirmed_spans(r.text) for r in kept)
    clean = {r.doc_id: redacted(r.text) for r in kept}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": [r.doc_id for r in kept], "text": [clean[r.doc_id] for r in kept], "source": [r.source for r in kept]}))
    want = []
    for doc_id, size, _, _, taken in con.execute(MIX_SQL).fetchall():
        want += [doc_id] * (taken // size)
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(want) and len(want) > 50
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(library.decode(list(r.piece_ids)) == clean[r.doc_id] for r in got)
    assert sum(list(r.piece_ids) != library.encode(clean[r.doc_id]) for r in got) > 0.9 * len(got)


def test_stages_take_odd_and_no_rows(spark, odd, none, sf):
    for table in (odd, none):
        docs = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, sf)
            assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == table.columns
        docs.collect()


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "secret_scan", "source_mixing", "sentencepiece_encoding"]


def test_repeated_rows_are_segmented_apart(spark, docs, sf):
    some = docs.where("length(text) > 500").limit(5)
    thrice = some.unionByName(some).unionByName(some)
    got = [sorted((r.doc_id, tuple(r.piece_ids)) for r in corpus_pipeline.encoding_stage(spark, x, sf).collect()) for x in (thrice, thrice.repartition(3))]
    assert got[0] == got[1] and len(got[0]) == len(set(got[0])) == 3 * some.count()
