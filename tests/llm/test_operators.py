"""The ten operators against brute force on small fixtures, with the cases that data can hold."""

import base64
import glob
import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import public_tokenizers
from tests.llm import brute
from textloom.llm import bpe, exact_dedup, line_crf, lm, mixing, passages, pii, quality, shared, simhash, token_files, units

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(odd):
    return [(r.doc_id, r.text or "") for r in odd.collect()]


# 1
def brute_fingerprint(text):
    w = WORD.findall(text.translate(LOW))
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(odd, none):
    got = simhash.simhash_dedup(odd).collect()
    texts = Counter((d, f"{brute_fingerprint(t):016x}") for d, t in rows_of(odd))
    assert Counter((r.doc_id, r.fingerprint) for r in got) == texts
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    marks = sorted({int(f, 16) for _, f in texts})
    for i, a in enumerate(marks):
        for b in marks[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for d, f in texts:
        if d is not None:
            least[root(int(f, 16))] = min(d, least.get(root(int(f, 16)), d))
    assert all(r.component_id == least.get(root(int(r.fingerprint, 16))) for r in got)
    assert simhash.simhash_dedup(none).count() == 0


def test_links_of_runs_and_chunks(spark):
    rng = random.Random(1)
    centre = [rng.getrandbits(64) for _ in range(20)]
    marks = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centre for _ in range(30)})
    df = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m,) for m in marks], "fp long")
    for chunk in (16384, 4):  # 4: every run is split into pairs of chunks
        from textloom.llm.graph import components

        got = components(simhash.links_between(df, 4, chunk)).collect()
        groups = defaultdict(set)
        for r in got:
            groups[r.component].add(r.node % (1 << 64))
        parent = {m: m for m in marks}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, a in enumerate(marks):
            for b in marks[:i]:
                if (a ^ b).bit_count() <= 4:
                    parent[root(a)] = root(b)
        want = defaultdict(set)
        for m in marks:
            want[root(m)].add(m)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_within_every_radius():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**64, 200, dtype=np.uint64)
    fps[50:60] = fps[40:50] ^ (np.uint64(1) << np.arange(10, dtype=np.uint64))
    planes = simhash.planes_of(fps)
    for radius in range(8):
        for by in (1, 10, 64, 70):
            alive = np.packbits(np.pad(np.arange(200) + by < 200, (0, 56)), bitorder="little").view(np.uint64)
            hit = np.unpackbits(simhash.within(planes, by, radius, alive).view(np.uint8), bitorder="little")[:200]
            want = [i + by < 200 and int(fps[i] ^ fps[(i + by) % 200]).bit_count() <= radius for i in range(200)]
            assert hit.astype(bool).tolist() == want


# 2
def test_exact_dedup(odd, none):
    got = exact_dedup.exact_dedup(odd, content_mb=0).collect()  # 0: every batch is combined alone
    groups = defaultdict(list)
    for d, t in rows_of(odd):
        groups[hashlib.sha256(t.translate(LOW).encode()).hexdigest()].append(d)
    assert len(got) == odd.count()
    for r in got:
        g = groups[r.text_sha256]
        keep = max((d for d in g if d is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(g), r.doc_id == keep)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_hot_classes_are_spread(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i % 1500}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df).collect()}
    groups = defaultdict(list)
    for d, t in rows:
        groups[t].append(d)
    assert got == {d: (max(groups[t]), len(groups[t])) for d, t in rows}


def test_cuckoo_filter_overflows_and_deletes():
    index = exact_dedup.CuckooIndex(2)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for k in keys:
        assert index.find(k) is None
        index.insert([k, k])
    assert index.filter.mask > 1 and all(index.find(k, k)[1] == k for k in keys)
    with pytest.raises(ValueError):
        index.find(keys[0], b"another text")
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert all((index.find(k) is None) == (i % 2 == 0) for i, k in enumerate(keys))
    assert sum(map(len, index.filter.rows)) == len(list(index.entries())) == 1500


def test_the_filter_turns_new_digests_away(monkeypatch):
    index = exact_dedup.CuckooIndex(4096)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(4000)]
    for k in keys[:2000]:
        index.insert([k, k])
    looked = []
    monkeypatch.setattr(exact_dedup.CuckooIndex, "_bucket", lambda self, d: looked.append(d) or [])
    assert all(index.find(k) is None for k in keys[2000:]) and len(looked) < 20


def test_update_index(spark):
    docs = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string")
    rows = lambda index: (sorted((bytes(r.content), r.n) for r in index[0].collect()), sorted((r.doc_id is not None, r.doc_id or 0) for r in index[1].collect()))
    index = exact_dedup.update_index(*exact_dedup.empty_index(spark), docs((1, "a"), (2, "A"), (3, "b"), (None, None)), docs(), 4)
    assert rows(index) == ([(b"", 1), (b"a", 2), (b"b", 1)], [(False, 0), (True, 1), (True, 2), (True, 3)])
    index = exact_dedup.update_index(*index, docs((4, "b"), (5, "c")), docs((2, None), (99, None), (None, None)), 4)
    assert rows(index) == ([(b"", 1), (b"a", 1), (b"b", 2), (b"c", 1)], [(False, 0), (True, 1), (True, 3), (True, 4), (True, 5)])
    index = exact_dedup.update_index(*index, docs((3, "d")), docs((1, None), (3, None), (4, None)), 4)
    assert rows(index) == ([(b"", 1), (b"c", 1), (b"d", 1)], [(False, 0), (True, 3), (True, 5)])


# 3
def brute_rules(t):
    w = WORD.findall(t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(odd, none, labels):
    got = line_crf.quality_rules(odd, labels).collect()
    want = Counter((d, *brute_rules(t)) for d, t in rows_of(odd))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert line_crf.quality_rules(none, labels).count() == 0 and line_crf.quality_rules(odd, labels.where("false")).count() == odd.count()


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(4)
    crf = line_crf.Crf(np.zeros(1), np.ones(1), np.array([0.1, 1.0]), np.array([[0.7, -0.4], [-0.2, 0.5]]))
    lengths = np.array([3, 0, 6, 1])
    x = rng.normal(size=(10, 1))
    got, u, at = crf.viterbi(x, lengths), crf.unary(x), 0
    for n in lengths:
        def value(bits):
            y = [bits >> k & 1 for k in range(n)]
            return sum(u[at + k] * y[k] for k in range(n)) + sum(crf.moves[a, b] for a, b in zip(y, y[1:]))
        if n:
            best = max(range(1 << n), key=value)
            assert got[at : at + n].astype(int).tolist() == [best >> k & 1 for k in range(n)]
        at += n


def test_lines_of_one_document_differ(spark):
    rng = random.Random(5)
    good = lambda: " ".join("".join(rng.choice(["ta", "re", "lo", "in", "the", "sa"]) for _ in range(rng.randint(1, 4))) for _ in range(25)) + "."
    junk = lambda: " | ".join("".join(rng.choice("abcde").upper() for _ in range(5)) + "!!" for _ in range(25))
    docs, known = [], []
    for i in range(160):
        bad = i % 4 == 0
        docs.append((i, "\n".join([good(), good(), *(junk() for _ in range(6))] if bad else [good() for _ in range(8)])))
        known.append((i, int(not bad)))
    docs += [(900, "\n".join([good()] * 1 + [good() for _ in range(9)] + [junk(), junk()])), (901, "\n".join([good()] + [junk() for _ in range(9)]))]
    df, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, quality int")
    got = {r.doc_id: r for r in line_crf.quality_rules(df, labels).collect()}
    assert all(0 < got[i].content_share < 0.6 and not got[i].kept for i in range(0, 160, 4))
    assert all(got[i].content_share == 1 and got[i].kept for i in range(160) if i % 4)
    assert 0.6 < got[900].content_share < 1 and got[900].kept and 0 < got[901].content_share < 0.4 and not got[901].kept


def test_rules_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = line_crf.quality_rules(docs, known).join(known, "doc_id").where(quality.held_out()).where("not base_failed").collect()
    assert len(rows) > 50 and sum(r.kept == bool(r.quality) for r in rows) > 0.97 * len(rows)


# 4
def test_passages(spark, odd, none):
    rng = random.Random(6)
    words = lambda n: [f"v{rng.randint(0, 5000)}" for _ in range(n)]
    shared = words(70)
    fuzzy = [w if i % 25 else "changed" for i, w in enumerate(shared)]
    docs = [words(40) + shared + words(30), words(90) + shared, fuzzy + words(50), words(200), shared[:30] + words(60)]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {(r.doc_id, r.other_id): r for r in passages.shared_passages(df).collect()}
    assert set(got) == {(1, 0), (2, 0)}
    r = got[1, 0]
    assert (r.start_word, r.end_word, r.other_start, r.other_end, r.similarity) == (90, 160, 40, 110, 1.0)
    assert got[2, 0].similarity >= 0.9 and got[2, 0].end_word - got[2, 0].start_word >= 55
    assert passages.shared_passages(none).count() == 0 and passages.shared_passages(odd).count() >= 0


def test_chains_take_ordered_matches():
    a, b = np.array([0, 10, 20, 30, 40]), np.array([5, 15, 90, 35, 45])
    best = max(passages.chains(a, b, 5), key=len)
    assert best == [(0, 45, 5, 50)]
    a, b = np.array([*range(0, 40), *range(60, 80), 4]), np.array([*range(7, 47), *range(71, 91), 90])
    best = max(passages.chains(a, b, 4), key=len)
    assert best == [(0, 43, 7, 50), (60, 83, 71, 94)]
    assert passages.chains(np.arange(0, 9000, 30), np.arange(0, 27000, 90), 4) is None  # too many runs


def passages_of(spark, docs):
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    return [(r.doc_id, r.other_id, r.start_word, r.end_word) for r in passages.shared_passages(df).collect()]


def test_passages_behind_earlier_fragments(spark):
    rng = random.Random(8)
    words = lambda n: [f"v{rng.randint(0, 5000)}" for _ in range(n)]
    whole = words(80)
    pieces = [words(30) + whole[:40] + words(30), words(20) + whole[40:] + words(40)]
    both = [words(25) + whole + words(30), words(60) + whole + words(5)]
    assert passages_of(spark, pieces + both) == [(3, 2, 60, 140)]
    # more fragments than a holder has partners, also between the two whole copies
    got = passages_of(spark, [*(words(9) + p[20:70] + words(9) for p in pieces * 9), both[0], *(words(9) + p[20:70] + words(9) for p in pieces * 9), both[1]])
    assert (37, 18, 60, 140) in got


def test_all_holders_of_a_seed_meet(spark):
    seed, doc, at = np.repeat(np.array([7, 9], np.uint32), [40, 1]), np.append(np.repeat(np.arange(20), 2), 3), np.append(np.arange(40), 5).astype(np.int32)
    for most in (1, 50, 10_000):
        got = Counter(m for part in passages.seed_matches(seed, doc, at, most) for m in zip(*(c.tolist() for c in part)))
        assert got == Counter((i // 2, j // 2, i, j) for i in range(40) for j in range(40) if j // 2 < i // 2)
    # two fuzzy copies whose common seeds are all held by a dozen fragments before, between and behind them
    rng = random.Random(14)
    words = lambda n: [f"v{rng.randint(0, 50000)}" for _ in range(n)]
    whole = words(80)
    fuzzy = [w if i % 10 else "changed" for i, w in enumerate(whole, 1)]
    fragments = lambda: [words(9) + whole[x : x + 12] + words(30) for x in range(0, 69, 4) for _ in range(12)]
    docs = [*fragments(), words(20) + whole + words(9), *fragments(), words(5) + fuzzy + words(20), *fragments()]
    n = len(fragments())
    assert (2 * n + 1, n) in {r[:2] for r in passages_of(spark, docs)}


def test_runs_of_one_word_meet_from_their_ends(spark):
    doc, at = np.repeat([1, 2], [300, 200]), np.append(np.arange(300) + 40, np.arange(200) + 10).astype(np.int32)
    got = [m for part in passages.seed_matches(np.zeros(500, np.uint32), doc, at) for m in zip(*(c.tolist() for c in part))]
    assert len(got) == 400 and {(a - b) for _, _, a, b in got} == {10 - 40, 209 - 339}  # 60,000 would say no more
    rng = random.Random(15)
    words = lambda n: [f"v{rng.randint(0, 50000)}" for _ in range(n)]
    both = words(60)
    docs = [words(9) + ["and"] * 300 + both + words(9), words(30) + ["and"] * 200 + both]
    assert passages_of(spark, docs) == [(1, 0, 30, 290)]


def test_matches_are_packed_by_documents():
    rng = np.random.default_rng(3)
    doc, at = np.repeat(np.arange(60), 400) * 1000, np.tile(np.arange(400), 60).astype(np.int32) + np.repeat(rng.integers(0, 50, 60), 400).astype(np.int32)
    seed = np.tile(rng.integers(1 << 24, 1 << 44, 400), 60).astype(np.uint64)  # near copies of a text
    kind, back = rng.integers(1, 3, len(doc)).astype(np.uint8), np.zeros(len(doc), np.int64)
    bucket = (seed >> np.uint64(32)).astype(np.uint16)
    order = np.lexsort((at, doc, bucket))
    sown = passages._blocks(bucket[order], [seed[order].astype(np.uint32), doc[order], at[order], kind[order], back[order]], passages.seed_block)
    blocks = [b for batch in passages._matched(None, 6)(iter([sown])) for b in batch.column(1)]
    got = Counter(m for b in blocks for m in zip(*(c.tolist() for c in passages.block_matches(b.as_buffer()))))
    pairs = [(d, d - o, int(x), int(x - y), int(k)) for part in passages.seed_matches(seed, doc, at, kind=kind) for d, o, x, y, k in zip(*part)]
    assert got == Counter(pairs) and len(pairs) == 400 * 60 * 59 // 2
    assert sum(len(b.as_py()) for b in blocks) < len(pairs)  # 25 bytes a match before, four of them after the shuffle's compression


def test_rounds_of_matches_are_all_matches(spark, monkeypatch):
    rng = np.random.default_rng(5)
    doc, at = np.repeat(np.arange(40), 50), np.tile(np.arange(50), 40).astype(np.int32)
    seed = np.where(at < 20, 7, rng.integers(0, 30, len(doc))).astype(np.uint32)  # with long runs of one word
    every = lambda *turn: [Counter(m for part in passages.seed_matches(seed, doc, at, turn_of=x) for m in zip(*(c.tolist() for c in part))) for x in turn]
    (whole,), (one, two) = every((0, 1)), every((0, 2), (1, 2))
    assert one + two == whole and {m[0] for m in one}.isdisjoint(m[0] for m in two) and max(one.total(), two.total()) < 0.8 * whole.total()
    rng = random.Random(16)
    words = lambda n: [f"v{rng.randint(0, 50000)}" for _ in range(n)]
    both = words(80)
    docs = [words(20) + both[i : i + 60] + words(20) for i in range(0, 20, 2)]
    once = sorted(passages_of(spark, docs))
    monkeypatch.setattr(passages, "MANY", 1)
    assert sorted(passages_of(spark, docs)) == once and len(once) >= 9


def test_seeds_are_packed_by_blocks():
    rng = np.random.default_rng(4)
    n = 300  # as 6 MB of text give a bucket
    doc, at = np.sort(rng.integers(0, 2500, n)) + 7_000_000, rng.integers(0, 400, n).astype(np.int32)
    columns = [rng.integers(0, 1 << 32, n).astype(np.uint32), doc, at, np.full(n, 100, np.uint8), np.zeros(n, np.int64)]
    block = passages.seed_block(*columns)
    assert len(block) < 8 * n  # 25 bytes a seed before
    assert all((x == y).all() for x, y in zip(passages.block_seeds(pa.py_buffer(block)), columns))


def test_shuffles_of_written_tables_are_forgotten(spark):
    files = lambda: {p for p in glob.glob(f"{folder}/*/shuffle_*")}
    made = spark.range(1000).repartition(3, "id")
    folder = os.path.dirname(os.path.dirname(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getFile("x").getPath()))
    before = files()
    got = shared.written(made, "forgotten", forget=True)
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and got.count() == 1000 and spark.conf.get(shared.CLEANUP) == "false"


def test_lines_of_many_documents(spark):
    rng = random.Random(16)
    words = lambda n: [f"v{rng.randint(0, 50000)}" for _ in range(n)]
    line, more = words(13), words(37)
    fuzzy = [w if i % 4 else "changed" for i, w in enumerate(more, 1)]  # no four equal words in a row
    docs = [words(60) + line + words(60) for _ in range(200)]
    docs[50], docs[150] = words(9) + line + more + words(30), words(20) + line + fuzzy + words(9)
    n, hashes = passages.word_hashes(pa.array([" ".join(d) for d in docs]))
    batch = pa.record_batch([pa.array(range(len(docs))), pa.array([" ".join(d) for d in docs])], names=["doc_id", "text"])
    mers, there, _ = passages.seeds(hashes, n, passages.frequent([batch], (3, 4), 128), 4, 50, 0.8)
    of = np.repeat(np.arange(len(docs)), n)
    seen = (mers >> np.uint64(20)).astype(np.uint32)
    assert sum(len(part[0]) for part in passages.seed_matches(seen, of[there], there.astype(np.int32))) < 100  # 200,000 with the line's seeds
    assert {r[:2] for r in passages_of(spark, docs)} == {(150, 50)}


def test_copies_and_covered_documents(spark):
    rng = random.Random(17)
    words = lambda n: [f"v{rng.randint(0, 50000)}" for _ in range(n)]
    base, other = words(120), words(80)
    near = lambda: [w if 30 < i < 90 and rng.random() < 0.04 else v for i, (w, v) in enumerate(zip(words(120), base))]
    docs = [other + words(20), base, *(near() for _ in range(140)), base[:110] + words(3) + other[:60]]
    docs += [docs[0], docs[2], docs[-1], docs[2]]
    got = sorted(passages_of(spark, docs))
    assert [r for r in got if r[0] < 142] == [(i, 1, 0, 120) for i in range(2, 142)]
    assert [r for r in got if r[0] == 142] == [(142, 0, 113, 173), (142, 1, 0, 110)]
    assert [r for r in got if r[0] > 142] == [(143, 0, 0, 100), (144, 1, 0, 120), (145, 0, 113, 173), (145, 1, 0, 110), (145, 142, 0, 173), (146, 1, 0, 120)]


@pytest.mark.parametrize("every", [25, 10, 8, 6, 5])
def test_fuzzy_passages_of_every_similarity(spark, every):
    rng = random.Random(every)
    words = lambda n: [f"v{rng.randint(0, 50000)}" for _ in range(n)]
    docs = []
    for size in (50, 60, 100) * 4:
        shared = words(size)
        docs += [words(40) + shared + words(30), words(20) + [w if i % every else "changed" for i, w in enumerate(shared, 1)] + words(50)]
    got = passages_of(spark, docs)
    assert {r[:2] for r in got} == {(i + 1, i) for i in range(0, len(docs), 2)}


def test_every_passage_of_two_documents(spark):
    rng = random.Random(9)
    words = lambda n: [f"v{rng.randint(0, 50000)}" for _ in range(n)]
    one, two, long = words(60), words(60), words(300)
    docs = [words(5) + one + words(50) + two, words(30) + one + words(50) + two + words(9), long, long[:140] + words(40) + long[140:]]
    got = passages_of(spark, docs)
    assert sorted(got) == [(1, 0, 30, 90), (1, 0, 140, 200), (3, 2, 0, 140), (3, 2, 180, 340)]


def test_alignment_crosses_gaps():
    rng = random.Random(10)
    a = np.array([rng.randint(0, 60000) for _ in range(200)], np.uint16)
    b = np.concatenate([a[:70], a[73:120], np.array([1, 2, 3, 4, 5], np.uint16), a[120:]])
    (found,) = passages.aligned([(a, b, -2, 3, 0)], 4, 50, 0.8)
    assert found == [(0, 200, 0, 202, 197)]


# 5
@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_files(odd, none, tmp_path, kind):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    index = token_files.write_tokens(odd, str(tmp_path / kind), kind=kind, shards=3)
    got = sorted(token_files.read_tokens(index, str(tmp_path / kind)).collect(), key=lambda r: r.start)
    want = sorted(rows_of(odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    for r, (d, t) in zip(got, want, strict=True):
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.token_files(none).count() == 0


def test_units_encode_as_texts_do():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, own, rng = Tokenizer.from_file(path), token_files.UnitEncoder(path), random.Random(12)
    pieces = ["the", "The", "Zürich", "a", "x9", "12", "é", "中文", "'s", "don't", "...", ".", ",", "!!", "###", "|", "\n", "\n\n", " ", "  ", "\t", "\x1c", "\u00a0", "\u3000", "_", "-", "١٢", "ﬁ", "²"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        counts, codes, strings = units.units_of(pa.array([text]))
        values, sizes = own(strings)
        assert token_files.gathered(values, np.cumsum(sizes) - sizes, sizes, codes).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_planes_round_trip():
    ids = np.random.default_rng(1).integers(0, 2**32, 1003, dtype=np.uint32)
    for kind in ("byte", "bit"):
        assert (token_files.joined(token_files.planes(ids, kind), len(ids), kind) == ids).all()


def test_units_are_the_text():
    for t in ["a  b", " \n c", "", "x \x1c y", "a　 b", " lead", "trail ", "it's\t\t3"]:
        counts, codes, strings = units.units_of(pa.array([t]))
        assert "".join(strings[int(c)].as_py() for c in codes) == t


# 6
def test_fill_and_budgets():
    assert mixing.fill(10, [(1, 100), (1, 2), (2, 100)]) == pytest.approx([8 / 3, 2, 16 / 3])
    supplies = {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("b", "y", "3"): 100}
    got = mixing.budgets(supplies, lambda p: 1.0, 100, 1.0)
    assert got == pytest.approx({("a", "x", "1"): 10, ("a", "x", "2"): 40, ("b", "y", "3"): 50})  # the sibling gains, not b
    assert sum(mixing.budgets(supplies, lambda p: 1.0, 1000, 1.0).values()) == 210


def test_mixing(odd, none):
    got = mixing.mix(odd, 0.6, 2.0).collect()
    assert len(got) == odd.count()
    total, taken = sum(r.n_tokens for r in got), sum(r.n_tokens * r.copies for r in got)
    assert taken <= 0.6 * total and Counter((r.doc_id, r.n_tokens) for r in got) == Counter((d, len(WORD.findall(t))) for d, t in rows_of(odd))
    everything = mixing.mix(odd, 10.0, 1.0).collect()
    assert all(r.copies == 1 for r in everything)
    assert mixing.mix(none).count() == 0 and set(mixing.mixed_documents(odd).columns) == set(odd.columns)


def test_mixing_by_sorting_whole_leaves(spark):
    rng = random.Random(13)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40]))), rng.choice(["en", "en", "en", "fr", None]), rng.choice(["src0", "src0", "src1", "src12", "other", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for share, epochs in ((0.5, 1.0), (0.9, 2.0), (1.7, 3.0), (5.0, 2.0)):
        got = {r.doc_id: r.copies for r in mixing.mix(df, share, epochs).collect()}
        want = brute.mixture(spark, rows, share, epochs)
        assert [got[d] for d, *_ in rows] == want, (share, epochs)


# 7
def test_scores_are_those_of_the_densities(spark):
    sf = "/root/testdata/sf0.001"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows, labels = [(r.doc_id, r.text) for r in docs.collect()], {r.doc_id: r.quality for r in known.collect()}
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, known).collect()}
    assert np.allclose([got[d] for d, _ in rows], brute.quadratic_scores(rows, labels), atol=1e-6)


def test_quality_classifier(spark, odd, none, labels):
    got = quality.quality_scores(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert quality.quality_scores(none, labels).count() == 0 and quality.quality_scores(odd, labels.where("false")).count() == odd.count()


def test_classifier_on_held_out_rows(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality_scores(docs, known).join(known, "doc_id").where("held_out")
    assert got.select(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.97


# 8
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in v.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    return sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t) if ok(kind, m[0]))


def test_pii(spark, none):
    texts = ["", None, "é a@b.c%d@e.f x@y..z@q.r ünï me@ho-st.org.", "1.2.3.4.5.6.7.8 300.1.1.1 0255.0.00.1 1.2.3", "4111 1111 1111 1111 2 4111-1111-1111-1111 4111111111111111", "+1 (988) 555-2485 4041894974608795 and +12 34 +123456789", "a@" + "b." * 20000 + "c " + "1 2 " * 20000, "9.9.9.9 " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        base = brute_spans(texts[r.doc_id] or "")
        joined = ",".join(f"{kind}:{a}:{z}" for a, _, z, kind in base)
        assert hashlib.sha256(joined.encode()).hexdigest() == r.base_sha256
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in base) for k in range(4)]
        assert {x for x in joined.split(",") if x} <= set(r.spans.split(","))
    assert pii.find_pii(none).count() == 0


def test_added_spans(spark):
    model = pii.trained(spark)
    texts = {
        "write to jane.doe [at] host [dot] org now": "email:9:37", "mail jane(at)host.org.": "email:5:21", "mail jane at host dot com": "email:5:25", "look at line dot plot here": "", "it was 5 @ 3.50 each": "",
        "card 4111.1111.1111.1111 ok": "card:5:24", "order 4111.1111.1111.1111 ok": "", "pay 4111 1111 1111 1111 2 x": "card:4:23", "call (988) 555-2485 today": "phone:5:19", "invoice 988-555-2485 today": "",
        "server 10[.]0[.]0[.]12 is": "ip:7:22", "server 10[.]0[.]0[.]912 is": "", "a@b.co [dot] uk mail": "email:0:6,email:0:15", "mail x@y.org or +1 (988) 555-2485": "email:5:12,phone:16:33",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {list(texts)[r.doc_id]: r for r in pii.find_pii(df, model).collect()}
    assert {t: r.spans for t, r in got.items()} == texts
    assert sum(r.n_added for r in got.values()) == 8
    off = pii.Boosted([], 0.0, {k: float("inf") for k in range(4)})
    assert sum(r.n_added for r in pii.find_pii(df, off).collect()) == 0


def test_boosted_trees_on_the_held_out_fold(spark):
    model = pii.trained(spark)
    assert all(math.isfinite(t) for t in model.thresholds.values())
    other = pii.training_texts(800, seed=99)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(other)], "doc_id long, text string")
    found = {r.doc_id: [tuple(x.split(":")) for x in r.spans.split(",") if x] for r in pii.find_pii(df, model).collect()}
    real = {i: [(pii.KINDS[k], str(a), str(z)) for a, k, z in spans] for i, (_, spans) in enumerate(other)}
    right = sum(s in found[i] for i, x in real.items() for s in x)
    assert right > 0.85 * sum(map(len, real.values()))


def test_pii_of_odd_documents(odd):
    got = Counter((r.doc_id, r.base_sha256, r.n_email + r.n_ip + r.n_card + r.n_phone) for r in pii.find_pii(odd).collect())
    want = Counter()
    for d, t in rows_of(odd):
        base = brute_spans(t)
        want[d, hashlib.sha256(",".join(f"{kind}:{a}:{z}" for a, _, z, kind in base).encode()).hexdigest(), len(base)] += 1
    assert got == want


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.cc now"), (2, "none")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df, pii.find_pii(df)).collect()}
    assert got == {1: "mail [EMAIL] now", 2: "none"}


# 9
def test_language_model(odd, none):
    rows = rows_of(odd)
    out = {d is not None and zlib.crc32(str(d).encode()) % 7 == 2: 0 for d, _ in rows}
    assert out is not None
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = [[*(w for w in WORD.findall(t.translate(LOW))), "</s>"] for _, t in rows]
    one, two = Counter(), Counter()
    for (d, _), t in zip(rows, tokens):
        if not held(d):
            one.update(t)
            two.update(zip(["</s>", *t], t))
    n, v = sum(one.values()), len(one)
    before, follow, total = Counter(), defaultdict(Counter), Counter()
    for (a, b), c in two.items():
        before[b] += 1
        follow[a][min(c, 3)] += 1
        total[a] += c
    d1 = lm.discounts([Counter(before.values()).get(k, 0) for k in range(1, 5)])
    d2 = lm.discounts([Counter(two.values()).get(k, 0) for k in range(1, 5)])
    cut = lambda c, d: max(c - (d[min(c, 3) - 1] if c else 0), 0)
    left = sum(d1[min(c, 3) - 1] for c in before.values()) / len(two)
    got = Counter()
    for r in lm.lm_scores(odd).collect():
        assert r.train_tokens == n
        got[r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score, 4)] += 1
    for (d, _), t in zip(rows, tokens):
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for a, b in zip(["</s>", *t], t):
            low = cut(before[b], d1) / len(two) + left / (v + 1)
            score += math.log10(cut(two[a, b], d2) / total[a] + sum(d2[k - 1] * follow[a][k] for k in (1, 2, 3)) / total[a] * low if total[a] else low)
        close = [k for k in got if k[:4] == (d, held(d), len(t), sum(one[w] > 0 for w in t)) and abs(k[4] - base) < 1e-3 * max(1, abs(base) / 1e3) and abs(k[5] - score) < 1e-3 * max(1, abs(score) / 1e3)]
        assert close, (d, base, score)
    assert lm.lm_scores(none).count() == 0


def test_packed_pairs():
    rng = np.random.default_rng(3)
    a, b, c = lm.summed(rng.integers(0, 2**64, 500, dtype=np.uint64) // np.uint64(2**60), rng.integers(0, 2**64, 500, dtype=np.uint64), np.ones(500, np.int64))
    x, y, z = lm._unpacked(lm._packed(a, b, c))
    assert (x == a).all() and (y == b).all() and (z == c).all()


# 10
def test_bpe(odd, none):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digests(odd).collect())
    want = Counter()
    for d, t in rows_of(odd):
        ids = e.encode_ordinary(t)
        want[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert got == want and bpe.bpe_digests(none).count() == 0


def test_long_words():
    import tiktoken

    b = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    for u in ["a" * 1000, "aab" * 400, "ofthstthornderha" * 100, "  x", "\n \n  ab  c ", "it's 12 3!?é", "中文" * 300]:
        assert b.units([u])[0][0] == " ".join(map(str, e.encode_ordinary(u))).encode()


def test_a_round_costs_a_row_a_word():
    import tiktoken

    b = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    rng = random.Random(10)
    words = {"".join(rng.choices(letters, k=n)) for letters in ("ab", "ethndro", "äéß中x") for n in (*range(2, 40), 66, 100) for _ in range(9)}
    words = sorted(w for w in words if w.encode() not in b.ranks and len(w.encode()) <= bpe.LONG)
    ids = [e.encode_ordinary(w) for w in words]
    assert b.words([w.encode() for w in words]) == [(" ".join(map(str, x)).encode(), w.encode(), len(x)) for w, x in zip(words, ids)]
    rows = []
    whole, sql = b.db, bpe.ONE_PAIR[: bpe.ONE_PAIR.rindex("SELECT")] + "SELECT count(*) FROM step"

    class Counting:
        def __getattr__(self, name):
            return getattr(whole, name)

        def sql(self, query):
            rows.append(whole.sql(sql).fetchall()[0][0])
            return whole.sql(query)

    b.db = Counting()
    b.words([w.encode() for w in words])
    assert rows == [sum(len(w.encode()) - len(x) + 1 for w, x in zip(words, ids))]  # before: a row a token and round


def test_texts_are_encoded_in_bounded_slices(monkeypatch):
    sizes, at_once = [], []
    units_of, encode = bpe.units_of, bpe.Bpe.words
    monkeypatch.setattr(bpe, "units_of", lambda c: (sizes.append(c.nbytes), units_of(c))[1])
    monkeypatch.setattr(bpe.Bpe, "words", lambda b, words: (at_once.append(len(words)), encode(b, words))[1])
    monkeypatch.setattr(bpe, "_workers", {})
    texts = [" ".join(f"{i}x{k}" for k in range(3000)) for i in range(300)]
    run = bpe._encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    batch = pa.record_batch([pa.array(range(300)), pa.array(texts)], names=["doc_id", "text"])
    assert batch.nbytes > 5e6 and [i for out in run(iter([batch])) for i in out.column(0).to_pylist()] == list(range(300))
    assert max(sizes) <= (3 << 20) + 8 * 301 and max(at_once) <= 20_000
