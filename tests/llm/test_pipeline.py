"""The stages one by one, on documents with copies, near copies and junk."""

import corpus_pipeline
from textloom.llm.bpe import bpe_digests
from textloom.llm.exact_dedup import exact_dedup
from textloom.llm.quality import quality_scores
from textloom.llm.shared import written
from textloom.llm.simhash import simhash_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        if name == "quality":
            want = [r.doc_id for r in quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()]
        elif name == "exact":
            want = [r.doc_id for r in exact_dedup(docs).where("kept").collect()]
        elif name == "near":
            want = [r.doc_id for r in simhash_dedup(docs).where("doc_id = component_id").collect()]
        else:
            want = [i for i in ids(docs) if i in set(ids(out))]
        assert ids(out) == sorted(want) and len(want)
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(map(tuple, last)) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, bpe_digests(docs).collect()))


def test_pipeline_against_plain_versions(spark):
    import base64

    import tiktoken

    import public_tokenizers
    from tests.llm import brute

    rows = [(r.doc_id, r.text or "", r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    chosen = lambda flags: [r for r, f in zip(rows, flags) if f]
    rows = chosen(brute.quadratic_scores([r[:2] for r in rows], labels) >= 0.7)
    rows = chosen(brute.kept_copies([r[:2] for r in rows]))
    rows = chosen([c == r[0] for c, r in zip(brute.components([r[:2] for r in rows]), rows)])
    rows = chosen(brute.mixture(spark, rows, 0.9, 1.0))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {d: e.encode_ordinary(t) for d, t, *_ in rows}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert len(got) > 50 and set(got) == set(want)
    for d, t, *_ in rows:
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(want[d]), brute.sha(" ".join(map(str, want[d])).encode()), brute.sha(t.encode()))


def test_rows_without_doc_id_are_decided_by_their_text(spark):
    good = "one two three four five six seven eight nine ten eleven twelve thirteen " * 2
    df = spark.createDataFrame([(1, good), (None, good.upper()), (None, "another text " * 9), (None, "another text " * 9)], "doc_id long, text string")
    stages = dict(corpus_pipeline.STAGES)
    assert sorted((r.doc_id or 0, r.text[:3]) for r in stages["exact"](spark, df, SF).collect()) == [(0, "ano"), (0, "ano"), (1, "one")]
    assert sorted((r.doc_id or 0, r.text[:3]) for r in stages["near"](spark, df, SF).collect()) == [(0, "ano"), (0, "ano"), (1, "one")]


def test_stages_of_odd_documents(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert set(stage(spark, odd, SF).columns) == set(odd.columns), name
        assert stage(spark, none, SF).count() == 0
