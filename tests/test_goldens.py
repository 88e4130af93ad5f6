"""Small inputs with results worked out by hand or published with the measures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import assembly, basic, cohesion, compare, corpus, diversity, morphology, phonetics, style, stylometry, syntax
from textloom.operators.words import most_common, ngrams, phrase_spans, sentences, words
from textloom.sources.readers import parse_conllu

RIDDLE = "abcdebcfghgigjk"
CAT = "The cat sat on the mat. A beautiful day!"


def listed(spark, ws, key="doc_id", name=1):
    kind = "long" if isinstance(name, int) else "string"
    return spark.createDataFrame([(name, i, w) for i, w in enumerate(ws)], f"{key} {kind}, pos int, word string")


def texts(spark, *ts):
    return spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")


def test_basic_counts(spark):
    r = basic.basic_stats(texts(spark, CAT)).first()
    assert (r.n_sents, r.n_words, r.n_unique_words, r.n_letters, r.n_chars, r.n_spaces, r.n_punctuations) == (2, 9, 8, 30, 40, 8, 2)
    assert r.c_letters == {1: 1, 2: 1, 3: 6, 9: 1}


def test_readability(spark):
    r = basic.readability(basic.basic_stats(texts(spark, CAT), syllables=lambda w: F.regexp_count(F.lower(w), F.lit("[aeiouy]+")))).first()
    assert r.n_syllables == 11
    assert r.flesch_reading_easy == pytest.approx(206.835 - 1.015 * 4.5 - 84.6 * 11 / 9)
    assert r.smog_index == pytest.approx(1.043 * math.sqrt(15) + 3.1291)
    assert r.lix == pytest.approx(4.5 + 100 / 9) and r.rix == 0.5
    assert r.mu_index == pytest.approx(66.67, abs=0.01) and r.consensus_grade == 3.0


def test_empty_text(spark):
    r = basic.readability(basic.basic_stats(texts(spark, "", None, "?!"))).collect()
    assert [x.n_words for x in r] == [0, 0, 0] and all(math.isnan(x.lix) and math.isnan(x.consensus_grade) for x in r)


def test_diversity_of_riddle(spark):
    ws = listed(spark, RIDDLE)
    r = diversity.order_free(ws).first()
    assert (r.n_words, r.n_types) == (15, 11)
    assert r.yule_k == pytest.approx(1e4 * 10 / 225) and r.yule_i == pytest.approx(121 / 14)
    assert r.herdan_vm == pytest.approx(math.sqrt(25 / 225 - 1 / 11))
    codes = np.unique(list(RIDDLE), return_inverse=True)[1]
    assert diversity.mtld_of(codes) == pytest.approx(15.0)
    assert diversity.mamtld_of(codes) == pytest.approx(12.0)
    assert diversity.mtldw_of(codes) == pytest.approx(13.25)
    assert diversity.mtld(ws).first().mtld == pytest.approx(15.0)


@pytest.mark.parametrize("text, value", [("axaxaxaxax", -1.0), ("aaaaaxxxxx", 0.18350341907227388)])
def test_burstiness(spark, text, value):
    assert diversity.burstiness(listed(spark, text)).first().burstiness == pytest.approx(value)


def test_mattr_against_windows(spark):
    rng = np.random.default_rng(3)
    ws = [f"w{i}" for i in rng.integers(0, 40, 200)]
    want = np.mean([len(set(ws[i : i + 50])) / 50 for i in range(151)])
    assert diversity.mattr(listed(spark, ws)).first().mattr == pytest.approx(want)
    assert diversity.msttr(listed(spark, ws)).first().msttr == pytest.approx(np.mean([len(set(ws[i : i + 50])) / 50 for i in range(0, 200, 50)]))


def test_mtld_fold_is_the_kernel(spark):
    rng = np.random.default_rng(5)
    for size in (12, 60, 150):
        codes = rng.integers(0, 15, size)
        assert diversity.mtld(listed(spark, [f"w{c}" for c in codes])).first().mtld == pytest.approx(diversity.mtld_of(codes))


KITTY = "kitty is in window kitty is in rug kitty dozed in window".split()


def test_collocations(spark):
    r = corpus.collocations(listed(spark, KITTY), 2, "logdice", 2, top_n=1).first()
    assert (r.left, r.right, r.freq, r.freq_left, r.freq_right, r.score) == ("kitty", "in", 3, 3, 3, 13.0)


def test_dispersion(spark):
    ws = listed(spark, KITTY).withColumn("part", F.floor(F.col("pos") / 4))
    got = {r.word: r for r in corpus.dispersion_by(ws, "part").collect()}
    k = got["kitty"]
    assert (k.dp, k.juilland_d, k.carroll_d2, k.rosengren_s, k.kl_divergence) == pytest.approx((0, 1, 1, 1, 0), abs=1e-12)
    assert got["rug"].dp == pytest.approx(2 / 3)
    cells, sizes = spark.createDataFrame([("w", 0, 10)], "word string, part int, f int"), spark.createDataFrame([(i, 20) for i in range(5)], "part int, size int")
    r = corpus.dispersion(cells, sizes).first()
    assert (r.dp, r.dp_norm, r.juilland_d, r.carroll_d2, r.rosengren_s, r.kl_divergence) == pytest.approx((0.8, 1, 0, 0, 0.2, math.log2(5)), abs=1e-9)


def test_keyness_measures(spark):
    row = spark.createDataFrame([(10.0, 5.0, 1000.0, 2000.0)], "a double, b double, c double, d double")
    r = row.select(*(f(*map(F.col, "abcd")).alias(n) for n, f in corpus.KEYNESS.items())).first()
    assert r.log_likelihood == pytest.approx(2 * (10 * math.log(2) + 5 * math.log(0.5)))
    assert (r.chi2, r.diff, r.log_ratio) == pytest.approx((6.105527638190955, 300, 2))


def test_stylometry(spark):
    both = lambda name, t: spark.createDataFrame([(name, i, w) for i, w in enumerate(t.split())], "text string, pos int, word string")
    corpus_ = both("A", "a b a c").union(both("B", "b b c d")).union(both("C", "a d d d"))
    d = stylometry.delta(corpus_, 4).collect()
    assert len(d) == 3 and all(r.distance > 0 for r in d)
    assert stylometry.mendenhall_distance(both("A", "a"), both("B", "bb")).first().distance == pytest.approx(1)


def test_effects(spark):
    rows = [("f", "A", str(i), float(v)) for i, v in enumerate([2, 4, 6, 8])] + [("f", "B", str(i), float(v)) for i, v in enumerate([1, 3, 5, 7])]
    r = compare.effect_sizes(spark.createDataFrame(rows, "feature string, corpus string, text string, value double")).first()
    assert r.cohen_d == pytest.approx(1 / math.sqrt(20 / 3)) and r.cliff_delta == pytest.approx(4 / 16)
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", float("nan"))], "k string, p_value double")
    got = {x.k: x.p_holm for x in compare.holm(p).collect()}
    assert (got["a"], got["b"], got["c"]) == pytest.approx((0.03, 0.06, 0.06)) and math.isnan(got["d"])
    assert compare.exact_p(0, 3, 3) == pytest.approx(0.1)


def test_phrases_and_ngrams(spark):
    ws = listed(spark, "of the and of the x and the".split())
    phrases = spark.createDataFrame([("of the",), ("of the and",), ("and the",)], "phrase string")
    assert [(r.start, r.end) for r in phrase_spans(ws, phrases).orderBy("start").collect()] == [(0, 3), (3, 5), (6, 8)]
    assert ngrams(ws, 3).count() == 6
    assert most_common(ws, 1).first().word == "the"


def test_kwic_of_overlapping_keyword(spark):
    got = corpus.kwic(listed(spark, "a a a a a".split()), "a a", 1).orderBy("start").collect()
    assert [r.start for r in got] == [0, 2]


def test_cohesion(spark):
    sets = spark.createDataFrame([(1, 0, ["a"]), (1, 1, ["a"]), (1, 2, ["b"]), (2, 0, ["a", "b"]), (2, 1, ["b", "c"]), (3, 0, ["x"])], "doc_id long, sent_id int, items array<string>")
    got = {r.doc_id: r for r in cohesion.overlaps(sets).collect()}
    assert (got[1].overlap_adjacent, got[1].overlap_all, got[2].overlap_prop_adjacent) == pytest.approx((0.5, 1 / 3, 0.5))
    assert math.isnan(got[3].overlap_all)


def test_repetition_index(spark):
    ws = "ab cd bb xx b q bq zz b b b".split()
    seen = {s: sum(sum(s in w for w in ws[i : i + 3]) >= 2 for i in range(9)) for s in "bq"}
    want = {s: 9 * (1 - (math.comb(11 - c, 3) + c * math.comb(11 - c, 2)) / math.comb(11, 3)) for s, c in (("b", 7), ("q", 2))}
    r = phonetics.repetition_index(listed(spark, ws), "bq").first()
    assert r.repetition_index == pytest.approx(sum(seen.values()) / sum(want.values()))


def test_style(spark):
    r = style.style_stats(listed(spark, "a a a a b b c the".split()), ["the"]).first()
    assert (r.classic_nausea, r.water, r.spam) == pytest.approx((2, 12.5, 50))


CONLLU = """# text = The white house is nice.
1\tThe\tthe\tDET\t_\t_\t3\tdet\t_\t_
2\twhite\twhite\tADJ\t_\t_\t3\tamod\t_\t_
3\thouse\thouse\tNOUN\t_\tNumber=Sing\t5\tnsubj\t_\t_
4\tis\tbe\tAUX\t_\tVerbForm=Fin|Tense=Pres\t5\tcop\t_\t_
5\tnice\tnice\tADJ\t_\t_\t0\troot\t_\t_
6\t.\t.\tPUNCT\t_\t_\t5\tpunct\t_\t_

1\tIt\tit\tPRON\t_\t_\t3\tnsubj:pass\t_\t_
2\twas\tbe\tAUX\t_\tVerbForm=Fin\t3\taux:pass\t_\t_
3\tsold\tsell\tVERB\t_\tVerbForm=Part|Voice=Pass\t0\troot\t_\t_
4\tand\tand\tCCONJ\t_\t_\t5\tcc\t_\t_
5\tleft\tleave\tVERB\t_\tVerbForm=Fin\t3\tconj\t_\t_
"""


def test_syntax(spark):
    dep = parse_conllu(texts(spark, CONLLU))
    assert dep.count() == 11
    r = syntax.syntax_stats(dep).first()
    assert r.n_sents == 2 and r.tree_depth == pytest.approx(2.0)
    assert r.p_passive == pytest.approx(0.5) and r.p_agentless_passive == pytest.approx(1.0)
    assert r.coordination_chains_per_sent == pytest.approx(0.5) and r.mean_coordination_chain_len == pytest.approx(2)
    assert r.c_deps["nsubj"] == 2 and r.clauses_per_sent == pytest.approx(1.5)
    loop = spark.createDataFrame([(1, 0, 1, "a", None, "X", None, 2, "dep"), (1, 0, 2, "b", None, "X", None, 1, "dep")], "doc_id long, sent_id int, idx int, form string, lemma string, upos string, feats string, head int, deprel string")
    assert syntax.tree_depths(loop).count() == 1 and syntax.sentence_clauses(loop).first().n_clauses == 0


def test_morphology(spark):
    words_ = syntax.with_features(parse_conllu(texts(spark, CONLLU)))
    got = {(r.stat, r.value): r.n for r in morphology.morph_stats(words_, filter_none=True).collect()}
    assert got["verbform", "Fin"] == 3 and got["tense", "Pres"] == 1 and got["pos", "VERB"] == 2


def test_parts_and_windows(spark):
    docs = texts(spark, "One two. Three!\n\nFour (five) six")
    assert [r.text for r in assembly.parts(docs, "paragraphs").orderBy("part").collect()] == ["One two. Three!", "Four (five) six"]
    got = assembly.by_parts(docs, basic.basic_stats, "lines").orderBy("part").collect()
    assert [r.n_words for r in got] == [3, None, 3]
    assert [r.text for r in assembly.split_windows(docs, 4, 1).orderBy("window").collect()] == ["One two. Three!\n\nFour", "(five) six"]
    assert sentences(docs).count() == 3
    assert assembly.flatten(basic.basic_stats(docs)).columns.count("c_letters_3") == 1


def test_words_options(spark):
    docs = texts(spark, "The 3 cats and the 1,000 dogs", None)
    assert [r.word for r in words(docs, filter_numbers=True, stop_words=["the"], min_len=4).orderBy("pos").collect()] == ["cats", "dogs"]


def test_ordination_and_report(spark):
    from textloom.operators import ordination
    from textloom.plans.report import highlighted, report

    d = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 4.0), ("b", "c", 3.0)], "text_a string, text_b string, distance double")
    x = {r.text: r.x1 for r in ordination.mds(d, 1).collect()}
    assert abs(x["a"] - x["c"]) == pytest.approx(4)
    names, merges = ordination.linkage(d, "single")
    assert names == ["a", "b", "c"] and [(m[2], m[3]) for m in merges] == [(1.0, 2), (3.0, 3)]
    assert highlighted("a <b> c", [(2, 5, "x")]) == 'a <mark title="x">&lt;b&gt;</mark> c'
    page = report(texts(spark, CAT), 0)
    assert "<mark" in page and "flesch_reading_easy" in page


def test_spans_and_segments(spark):
    docs = texts(spark, CAT)
    got = assembly.complex_words(docs).collect()
    assert [(r.start, r.end, r.note) for r in got] == [(26, 35, "beautiful")]
    h = spark.createDataFrame([(1, 0, 4, "x"), (1, 2, 6, "y")], "doc_id long, start int, end int, layer string")
    assert [(r.start, r.end, r.layers) for r in assembly.elementary_segments(h).orderBy("start").collect()] == [(0, 2, ["x"]), (2, 4, ["x", "y"]), (4, 6, ["y"])]
    assert assembly.fingerprint(listed(spark, [f"w{i % 7}" for i in range(25)]), 10).orderBy("window").count() == 16


def test_rolling_delta(spark):
    w = lambda t, n: spark.createDataFrame([(t, i, f"w{(i * i) % n}") for i in range(60)], "text string, pos int, word string")
    got = stylometry.rolling_delta(w("A", 7).union(w("B", 11)), w("T", 7), 20, 10, 5).collect()
    assert len(got) == 10 and {r.middle for r in got} == {10, 20, 30, 40, 50}


def test_flat_morphology_raises_above_its_bound(spark):
    counts = spark.range(2001).selectExpr("1L AS doc_id", "'pos' AS stat", "cast(id AS string) AS value", "1L AS n")
    with pytest.raises(ValueError):
        morphology.flat(counts)
    assert len(morphology.flat(counts.limit(3)).columns) == 4


def test_phrases_of_more_than_64_lengths(spark):
    ws = spark.range(70).selectExpr("1L AS doc_id", "cast(id AS int) AS pos", "concat('w', id) AS word").coalesce(1)
    phrases = spark.createDataFrame([(" ".join(["other"] * n),) for n in range(1, 65)] + [(" ".join(f"w{i}" for i in range(65)),)], "phrase string")
    assert [(r.start, r.end) for r in phrase_spans(ws, phrases).collect()] == [(0, 65)]


def test_places(spark):
    from textloom.operators import spans

    df = spark.createDataFrame([(1, "So, it is late - very late"), (2, "It rains.\nWe stay\nhome.\n\nIt stops."), (3, None), (4, "well-known \u00abfact\u00bb")], "doc_id long, text string")
    at = lambda rows, d: sorted(r.pos for r in rows.where(f"doc_id = {d}").collect())
    assert at(spans.marks(df), 1) == [1, 4] and at(spans.marks(df), 4) == []
    assert at(spans.paragraph_words(df), 2) == [2, 4, 5] and at(spans.paragraph_words(df, True), 2) == [5]
    words = spark.createDataFrame([(1, x) for x in (0, 4, 10, 14, 20)], "doc_id long, start long")
    cuts = spark.createDataFrame([(1, 0, 9), (1, 9, 10), (1, 10, 19), (1, 20, 24)], "doc_id long, start long, end long")
    assert sorted((r.start, r.n_words) for r in spans.words_by_spans(words, cuts).collect()) == [(0, 2), (10, 2), (20, 1)]
    tokens = spans.token_spans(df)
    assert [(r.word, r.start, r.end) for r in spans.word_at(tokens, 4).where("doc_id = 1").collect()] == [("it", 4, 6)]
    assert [r.word for r in spans.document_part(tokens, 1, 3).where("doc_id = 2").orderBy("pos").collect()] == ["rains", "We"]
    phrases = spark.createDataFrame([("it is", "temporal", "primary"), ("late", "other", "primary")], "phrase string, cls string, kind string")
    assert sorted((r.start, r.end, r.layer) for r in spans.connector_highlights(df, phrases).collect()) == [(4, 9, "temporal"), (10, 14, "other"), (22, 26, "other")]
    assert spans.zipf_theory(12, 3) == [(1, 12.0), (2, 6.0), (3, 4.0)]


def test_rules_of_connectors(spark):
    from textloom.operators import cohesion

    words = spark.createDataFrame([(1, s, p, w, t) for s, p, w, t in [(0, 0, "but", "CCONJ"), (0, 1, "since", "SCONJ"), (0, 2, "then", "ADV"), (1, 3, "since", "ADP"), (1, 4, "monday", "NOUN"), (1, 5, "because", "SCONJ")]], "doc_id long, sent_id int, pos int, word string, upos string")
    rules = spark.createDataFrame([("but", "adversative", "primary", None, None), ("since", "causal", "subordinating", "SCONJ", ["then"]), ("because", "causal", "subordinating", None, None)], "phrase string, cls string, kind string, pos string, not_before array<string>")
    plain = cohesion.connectors(words, rules.drop("pos", "not_before")).first()
    assert plain.c_connectors == {"but": 1, "since": 2, "because": 1} and plain.c_classes == {"adversative": 1, "causal": 3} and round(plain.connectors_inter, 3) == round(1000 / 6, 3)
    ruled = cohesion.connectors(words, rules).first()
    assert ruled.c_connectors == {"but": 1, "because": 1} and ruled.c_kinds == {"primary": 1, "subordinating": 1}


def test_small_samples_are_exact(spark):
    from textloom.operators import compare

    rows = [("x", "A", str(i), v) for i, v in enumerate([1.0, 2.0, 3.0, 4.5])] + [("x", "B", str(i), v) for i, v in enumerate([4.0, 5.0, 6.0, 7.0])]
    got = compare.compare_features(spark.createDataFrame(rows, "feature string, corpus string, text string, value double"), n_bootstrap=50).first()
    assert abs(got.p_value - compare.exact_p(1.0, 4, 4)) < 1e-12 and abs(got.p_value - 4 / 70) < 1e-12
