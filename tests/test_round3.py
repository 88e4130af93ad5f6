"""Findings of round 3: each test failed before its commit."""

import math

import duckdb
from pyspark.sql import functions as F

from textloom.functions.text import as_paragraphs, as_sentences
from textloom.operators import phonetics
from textloom.plans.queries import rounded

from .test_goldens import listed, texts


def test_zeros_at_the_ends_of_paragraphs_stay(spark):
    docs = texts(spark, "0 is less. More is 10\n\n11 or 101")
    assert docs.select(as_paragraphs(F.col("text"))).first()[0] == ["0 is less. More is 10", "11 or 101"]
    assert docs.select(as_sentences(F.col("text"))).first()[0] == ["0 is less.", "More is 10", "11 or 101"]


def test_rounding_is_that_of_the_sql(spark):
    values = [207 / 3200, -207 / 3200, 1.5e-6, 1 / 3, 2.5, math.inf]
    got = [r.x for r in rounded(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double")).orderBy("i").collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]


def test_sounds_that_cannot_recur(spark):
    for n in (3, 49, 59):  # one word of n has the sound
        assert math.isnan(phonetics.repetition_index(listed(spark, ["b"] + ["x"] * (n - 1)), "b").first().repetition_index)


def test_partitions_of_documents_grow_with_the_table(spark, monkeypatch):
    from textloom.operators import words

    monkeypatch.setattr(words, "PART_BYTES", 1 << 14, raising=False)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert words.by_document(docs).rdd.getNumPartitions() > 16 and words.by_document(docs).count() == 200


def test_places_of_words_are_found_without_a_shuffle(spark):
    from textloom.operators import spans

    docs = spark.createDataFrame([(1, "Éa __ b-c, d"), (2, ""), (3, "x")], "doc_id long, text string")
    got = [tuple(r) for r in spans.token_spans(docs).where("doc_id = 1").orderBy("pos").collect()]
    assert [x[1:] for x in got] == [(0, 0, 2, "Éa"), (1, 6, 7, "b"), (2, 8, 9, "c"), (3, 11, 12, "d")]
    assert [r.gap for r in spans.gaps(docs).orderBy("pos").collect()] == [" __ ", "-", ", "]
    assert "Exchange" not in spans.gaps(docs)._jdf.queryExecution().executedPlan().toString()


def test_trigrams_are_counted_without_a_row_each(spark):
    from textloom.operators.words import char_ngram_counts, char_ngrams, frequencies

    docs = spark.createDataFrame([(1, "abab  abc\U0001f600é"), (2, "ab"), (3, None), (4, "abc")], "doc_id long, text string")
    for n in (1, 3, 30):
        want = {r.ngram: r.f for r in frequencies(char_ngrams(docs, n), [], "ngram").collect()}
        assert {r.ngram: r.f for r in char_ngram_counts(docs, n).collect()} == want
    assert "Generate" not in char_ngram_counts(docs, 3)._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_does_not_hang_on_the_order_of_rows(spark):
    from textloom.operators.compare import bootstrap_median_diff

    rows = [("x", "AB"[i % 2], str(i), float((i * 37) % 101)) for i in range(80)]
    one, two = (bootstrap_median_diff(spark.createDataFrame(r, "feature string, corpus string, text string, value double").coalesce(1), n_bootstrap=50).first() for r in (rows, rows[::-1]))
    assert one == two and one.low < one.high


def test_word_tree_by_its_longest_runs(spark):
    from textloom.operators.assembly import word_tree

    ws = listed(spark, "a b c a b d x a b c that_x b".split())
    assert {(r.n, r.ngram): r.f for r in word_tree(ws, "a", 3, 2).collect()} == {(2, "a_b"): 3, (3, "a_b_c"): 2, (3, "a_b_d"): 1}
    assert {(r.n, r.ngram): r.f for r in word_tree(ws, "b", 3, 1, forward=False).collect()} == {(2, "a_b"): 3, (3, "c_a_b"): 1}
    assert {r.ngram for r in word_tree(ws, "that", 2).collect()} == {"that_x_b"}


def test_pairs_are_counted_as_numbers(spark):
    from collections import Counter

    from textloom.operators import corpus

    docs = ["a b a c b", "c", "", "b a b a a c d", "d d"]
    ws = spark.createDataFrame([(i, p, w) for i, d in enumerate(docs) for p, w in enumerate(d.split())], "doc_id long, pos int, word string")
    want = Counter((x, y) for d in docs for i, x in enumerate(d.split()) for y in d.split()[i + 1 : i + 4])
    found = corpus.collocations(ws, 3, "dice", 1)
    assert {(r.left, r.right): r.freq for r in found.collect()} == want
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()


def test_triples_go_through_punctuation_to_the_root(spark):
    from textloom.operators import syntax

    kind = "doc_id long, sent_id int, idx int, form string, upos string, head int, deprel string"
    rows = [(1, 0, 1, "red", "ADJ", 2, "amod"), (1, 0, 2, "-", "PUNCT", 3, "punct"), (1, 0, 3, "house", "NOUN", 0, "root"), (1, 0, 4, "x", "X", 5, "dep"), (1, 0, 5, "(", "PUNCT", 6, "punct"), (1, 0, 6, ")", "PUNCT", 5, "punct")]
    rows += [(2, 0, 1, "it", "PRON", 2, "nsubj:pass"), (2, 0, 2, "is", None, 0, "root"), (2, 1, 1, "y", "X", 2, "dep"), (2, 1, 2, ",", "PUNCT", 1, "punct")]
    dep = spark.createDataFrame(rows, kind).withColumn("feats", F.lit(None).cast("string"))
    got = {tuple(r) for r in syntax.dependency_triples(dep).collect()}
    assert got == {(1, "NOUN", "amod", "ADJ", 1), (1, "", "root", "NOUN", 1), (1, "", "root", "X", 1), (2, "", "nsubj", "PRON", 1), (2, "", "root", "", 1), (2, "", "root", "X", 1)}


def test_pieces_without_a_word_stay_with_their_sentence(spark):
    import __spark_entry__ as entry

    found = ["...  ?! He said \"Yes!\" (Then.) ?! --  He left…\n", " ?! \n\n One. Two! ... (3.)  ", "Hello. ?! Bye.", ""]
    want = [["...  ?! He said \"Yes!\"", "(Then.) ?!", "--  He left…"], ["?!", "One.", "Two! ...", "(3.)"], ["Hello. ?!", "Bye."], []]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(found)], "doc_id long, text string")
    got = [r[0] for r in docs.orderBy("doc_id").select(as_sentences(F.col("text"), wordless=True)).collect()]
    assert got == want
    assert docs.select(as_sentences(F.col("text"))).count() == 4 and len(docs.where("doc_id = 1").select(as_sentences(F.col("text"))).first()[0]) == 3
    c = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841  (DuckDB reads it)
    rows = c.execute(f"SELECT doc_id, sent_id, n_chars FROM ({entry.oracle_sql()['sentence_table']}) ORDER BY 1, 2").fetchall()
    assert rows == [(d, i, len(s)) for d, w in enumerate(want) for i, s in enumerate(w)]
