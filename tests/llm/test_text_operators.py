"""Toxicity, lines, passages, personal data and licenses against plain Python versions."""

import collections
import itertools
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketflow import session
from marketflow.llm import licenses, lines, passages, pii, queries, toxicity

from . import brute
from .test_pipeline_operators import DOC, empty

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="testdata not present")


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, None, None, None, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


# ------------------------------------------------------------------ toxicity --

def test_grammar_scores_clauses_not_words():
    lex = toxicity.Lexicon({"idiot": 2.0}, {"zorg": 1.0})
    m = toxicity.grammar()

    def s(t):
        return toxicity.clause_score(t, lex, m)
    assert s("what an idiot") == pytest.approx(2.0)
    assert s("you idiot") == pytest.approx(3.0) == pytest.approx(s("idiot , you"))
    assert s("she is not an idiot") == pytest.approx(2.0 * 0.3 * 1.5)
    assert s("not one two three idiot") == pytest.approx(2.0)
    assert s("he said idiot") == pytest.approx(2.0 * 0.5 * 1.5)
    assert s("i will kill you") == pytest.approx(0.4 + 0.0) and s("you i kill") == pytest.approx(2.0)
    assert s("zorgling") == pytest.approx(1.0) and s("zor") == 0.0 and s("") == 0.0


def test_composition_equals_running_one_after_the_other():
    a, b = toxicity.negation(), toxicity.reported()
    both = toxicity.compose(a, b)
    r = random.Random(5)
    for _ in range(200):
        p, q, x = a.start, b.start, both.start
        for _ in range(12):
            c = r.choice(toxicity.CLASSES)
            p, out, w = a.step(p, c)
            q, out, w2 = b.step(q, out)
            x, got, w3 = both.step(x, c)
            assert got == out and w3 == pytest.approx(w * w2)


def test_matched_clauses_cut_at_punctuation():
    lex = toxicity.Lexicon({"idiot": 2.0}, {})
    got = toxicity.matched_clauses("Fine. You IDIOT! idiotic. pre-idiot\nxidiot", lex, toxicity.grammar(), toxicity._triggers(lex))
    assert [("Fine. You IDIOT! idiotic. pre-idiot\nxidiot"[a:b].strip(), s) for a, b, s in got] == [("You IDIOT", 3.0), ("pre-idiot", 2.0)]
    assert toxicity.matched_clauses(None, lex, toxicity.grammar(), toxicity._triggers(lex)) == []


def test_toxicity_learns_words_and_generalises(spark):
    r = random.Random(2)
    vocabulary = ["w%03d" % i for i in range(200)]
    texts, labels = [], []
    for i in range(600):
        w = [r.choice(vocabulary) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            w[r.randrange(40)] = "zorgl" + r.choice("abcdefghij") + r.choice("klmnopq")
            w[r.randrange(40)] = "you"
        texts.append(" ".join(w))
        labels.append((i, int(toxic)))
    texts += [None, "", texts[0], texts[0]]
    df = frame(spark, texts, [*range(600), 600, None, 0, None])
    lab = spark.createDataFrame(labels + [(1, 1), (None, 1), (700, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, lab).select("__row.doc_id", "__row.text", "score", "predicted").collect()
    assert len(got) == 604 and all(0 <= x.score <= 1 for x in got)
    truth = dict(labels)
    wrong = sum(x.predicted != truth[x.doc_id] for x in got if x.doc_id in truth)
    assert wrong <= 3
    assert next(x for x in got if x.text is None).score == next(x for x in got if x.text == "").score < 0.5
    assert toxicity.toxicity(empty(df), lab).count() == 0
    assert toxicity.toxicity(df, empty(lab)).count() == 604


def test_training_rows_leave_out_fold_zero(spark):
    df = frame(spark, [f"t{i}" for i in range(100)])
    lab = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, toxic int")
    import zlib
    got = {int(r.text[1:]) for r in toxicity.training_rows(df, lab).collect()}
    assert got == {i for i in range(100) if zlib.crc32(str(i).encode()) % 5}
    assert toxicity.training_rows(df, lab, 7).count() == 7


# ------------------------------------------------------------------ personal data --

SAMPLES = ["a@b.c", "a@b@c.d x@y.z.", "..@a.b a+b%c@d-e.f.g,h@i", "@a.b", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 1..2.3.4.5",
           "4111 1111 1111 1111, 4111-1111-1111-1112 1", "+1 (988) 555-2485 +12 +1 +1( +123456789012345678 ++49 30 1234567",
           "9" * 5000, "1." * 3000, "a" * 3000 + "@" + "b" * 3000 + ".c", "+" * 50 + "1 2", "ü@ä.de İ@x.y ÄÖ 1.2.3.4", "", None]


@pytest.mark.parametrize("text", SAMPLES)
def test_base_spans_equal_the_patterns(text):
    got = pii.find_spans(text)
    assert [(k, s, e) for k in pii.BASE for s, e in got[k]] == brute.base_spans(text)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab1290.@+- ()%_\n", max_size=60))
def test_base_spans_equal_the_patterns_on_random_texts(text):
    got = pii.find_spans(text)
    assert [(k, s, e) for k in pii.BASE for s, e in got[k]] == brute.base_spans(text)


def test_added_spans():
    t = ("See https://user@example.com:80/a(b)?c=1). and ftp://x or http://nodot Account no: 12-345 678; "
         "IBAN DE89 3704 0044 0532 0130 00, iban DE00 3704 0044 0532 0130 00. accounting 99999 passport: X1234567")
    got = {k: [t[s:e] for s, e in v] for k, v in pii.find_spans(t).items()}
    assert got["url"] == ["https://user@example.com:80/a(b)?c=1"]
    assert got["iban"] == ["DE89 3704 0044 0532 0130 00"]
    assert "12-345 678" in got["account"] and "X1234567" in got["account"] and all("99999" not in x for x in got["account"])


def test_very_long_texts_take_linear_time():
    import time
    t0 = time.perf_counter()
    for t in ("a" * 2_000_000, "1" * 2_000_000, "1.1" * 600_000, "a@" * 600_000, "+1 " * 600_000, "1 " * 800_000):
        pii.find_spans(t)
    assert time.perf_counter() - t0 < 60


def test_personal_data_frame(spark):
    df = frame(spark, [*SAMPLES, SAMPLES[0]])
    got = pii.personal_data(df).select("__row.text", "pii.*").collect()
    assert len(got) == len(SAMPLES) + 1
    for r in got:
        assert r.base == ",".join(f"{k}:{s}:{e}" for k, s, e in brute.base_spans(r.text))
    assert pii.personal_data(empty(df)).count() == 0


# ------------------------------------------------------------------ lines --

def line_texts():
    r = random.Random(4)
    words = [f"v{i}" for i in range(30)]
    out = []
    for i in range(60):
        body = [" ".join(r.choice(words) for _ in range(r.randrange(0, 9))) for _ in range(r.randrange(0, 6))]
        if i % 3 == 0:
            body.insert(0, f"Page {i} of 100 printed by user{i} today")
        if i % 4 == 0:
            body.append("All content is free to use")
        out.append("\n".join(body))
    return out + [None, "", "\n\n", out[0], out[0], out[1], "one two three four " * 5000]


@pytest.mark.parametrize("min_docs", [2, 8])
def test_recurring_lines_match_brute_force(spark, min_docs):
    texts = line_texts()
    df = frame(spark, texts)
    got = {r.doc_id: r for r in lines.recurring_lines(df, min_docs=min_docs).select("__row.doc_id", "n_lines", "dropped").collect()}
    expected = brute.recurring(texts, min_docs)
    assert any(expected)
    assert [got[i].dropped for i in range(len(texts))] == expected
    assert [got[i].n_lines for i in range(len(texts))] == [0 if t is None else t.count("\n") + 1 for t in texts]
    clean = {r.doc_id: r for r in lines.drop_recurring_lines(df, min_docs=min_docs).collect()}
    for i, (t, gone) in enumerate(zip(texts, expected)):
        assert clean[i].text == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone))
        assert clean[i].n_words == "clash"
    assert lines.recurring_lines(empty(df)).count() == 0


def test_templates_generalise_variable_fields(spark):
    texts = [f"Page {i} of 100 printed by user{i} today\nbody{i} a{i} b{i} c{i}" for i in range(30)]
    got = lines.recurring_lines(frame(spark, texts)).select("dropped").collect()
    assert all(r.dropped == [0] for r in got)


@pytest.mark.parametrize("n", [30, 2000, 20_000])
def test_templates_are_found_at_any_size(spark, n):
    r = random.Random(n)
    texts = [f"Page {r.randrange(100)} of 100 printed by user{r.randrange(200)} today\nbody{i} a{i} b{i} c{i}" for i in range(n)]
    texts += [f"Page {i} of 100 sold by nobody{i} ever\nx{i} y{i} z{i}" for i in range(25)]       # a small template in the same leaf
    got = lines.recurring_lines(frame(spark, texts)).groupBy("dropped").count().collect()
    assert [(x.dropped, x["count"]) for x in got] == [([0], len(texts))]


# ------------------------------------------------------------------ passages --

def test_fenwick_prefix_maximum():
    r = random.Random(1)
    tree, held = passages.Fenwick(40), {}
    for i in range(400):
        at, value = r.randrange(40), (r.random(), i)
        tree.update(at, value)
        held[at] = max(held.get(at, value), value)
        q = r.randrange(41)
        assert tree.query(q) == max([v for k, v in held.items() if k < q], default=(0.0, -1))


def test_chain_scores_equal_the_quadratic_version():
    r = random.Random(9)
    for _ in range(40):
        m = sorted({(r.randrange(60), r.randrange(60)) for _ in range(r.randrange(1, 40))})
        best = {}
        for j, (a, b) in enumerate(m):
            best[j] = 5 + max([0.0] + [best[i] - 0.1 * (a - m[i][0] + b - m[i][1] - 10) for i in range(j)
                                      if m[i][0] < a and m[i][1] < b])
        paths = passages.chain(m, longest=10 ** 6)
        top = paths[0]
        score = 5 + sum(5 - 0.1 * (q[0] - p[0] + q[1] - p[1] - 10) for p, q in zip(top, top[1:]))
        assert score == pytest.approx(max(best.values()))
        assert sorted(x for p in paths for x in p) == m
        assert all(p[0] < q[0] and p[1] < q[1] for path in paths for p, q in zip(path, path[1:]))


def test_passages_are_found_and_clean_texts_left_alone(spark):
    r = random.Random(6)
    words = [f"q{i}" for i in range(3000)]

    def noise(n):
        return [r.choice(words) for _ in range(n)]
    passage, other, short = noise(60), noise(80), noise(30)
    fuzzy = list(other)
    for i in (20, 41, 62):
        fuzzy[i] = "changed"
    del fuzzy[50]
    texts = [noise(200) for _ in range(12)]
    for i in (0, 1, 2, 3):
        texts[i][50 + i:50 + i] = passage
    texts[4][10:10], texts[5][100:100] = other, fuzzy
    texts[6][10:10], texts[7][20:20] = short, short
    near = noise(150)
    texts += [near, [*near[:70], "x", *near[71:]], near, ["w"] * 2000, ["w"] * 1500 + ["z"]]
    texts = [" ".join(t) for t in texts] + [None, "", "a", None]
    df = frame(spark, texts)
    got = passages.repeated_passages(df).collect()
    linked = collections.defaultdict(set)
    for x in got:
        linked[x.doc_id].add(x.other_id)
        linked[x.other_id].add(x.doc_id)
        if x.doc_id in (0, 1, 2, 3):
            assert 55 <= x.words <= 62 and abs(x.start - 50 - x.doc_id) <= 3
    groups = [{0, 1, 2, 3}, {4, 5}, {12, 13, 14}, {15, 16}]
    for g in groups:
        assert all(linked[i] and linked[i] <= g for i in g)
    assert set(linked) == set().union(*groups)
    assert [(x.doc_id, x.other_id) for x in got if x.copy] in ([(14, 12)], [(12, 14)])
    assert all(x.similarity >= 0.8 and x.words >= 40 for x in got)
    assert passages.repeated_passages(empty(df)).count() == 0


def test_exact_passage_beside_a_shared_phrase_is_kept(spark):
    r = random.Random(12)
    words = [f"q{i}" for i in range(5000)]

    def noise(n):
        return [r.choice(words) for _ in range(n)]
    texts = []
    for _ in range(20):
        phrase, passage = noise(16), noise(50)
        for _ in range(2):
            texts.append(" ".join([*noise(40), *passage, *noise(20), *phrase, *noise(40)]))
    got = collections.defaultdict(list)
    for x in passages.repeated_passages(frame(spark, texts)).collect():
        got[min(x.doc_id, x.other_id), max(x.doc_id, x.other_id)].append(x)
    assert set(got) == {(2 * i, 2 * i + 1) for i in range(20)}
    assert all(any(x.start <= 40 and x.end >= 90 and x.similarity >= 0.8 for x in v) for v in got.values())


def test_passages_with_evenly_changed_words_are_found(spark):
    r = random.Random(14)
    words = [f"q{i}" for i in range(5000)]

    def noise(n):
        return [r.choice(words) for _ in range(n)]
    texts, pairs = [], [(step, n) for step in (5, 6, 7, 8, 10, 20) for n in (55, 60, 100) for _ in range(6)]
    for step, n in pairs:
        passage = noise(n)
        changed = [f"x{i}" if i % step == step - 1 else w for i, w in enumerate(passage)]
        texts += [" ".join([*noise(30), *p, *noise(30)]) for p in (passage, changed)]
    got = {}
    for x in passages.repeated_passages(frame(spark, texts)).collect():
        got.setdefault((min(x.doc_id, x.other_id), max(x.doc_id, x.other_id)), x)
    assert set(got) == {(2 * i, 2 * i + 1) for i in range(len(pairs))}
    assert all(x.start >= 27 and x.similarity >= 0.8 for x in got.values())


@pytest.mark.parametrize("others", [1, 40])
def test_a_passage_is_found_whatever_texts_hold_its_parts(spark, others):
    r = random.Random(15)
    words = [f"q{i}" for i in range(5000)]

    def noise(n):
        return [r.choice(words) for _ in range(n)]

    def around(part):
        return " ".join([*noise(40), *part, *noise(40)])
    passage = noise(60)
    # rows before and after the two texts hold one half each, so first and last texts of every seed are no partners
    halves = [around(x) for _ in range(2 * others) for x in (passage[:30], passage[30:])]
    texts = [*halves[:2 * others], around(passage), around(passage), *halves[2 * others:]]
    got = passages.repeated_passages(frame(spark, texts)).collect()
    assert {frozenset((x.doc_id, x.other_id)) for x in got} == {frozenset((2 * others, 2 * others + 1))}
    assert got[0].start <= 40 and got[0].end >= 100


@pytest.mark.parametrize("block", [256, 3])
def test_a_passage_of_common_seeds_is_found_whatever_texts_hold_them(spark, monkeypatch, block):
    r = random.Random(18)
    words = [f"q{i}" for i in range(5000)]

    def noise(n):
        return [r.choice(words) for _ in range(n)]
    # seven equal words, then a changed one: no longer shingle is shared, and each run is common with ends of its own
    runs = [noise(7) for _ in range(8)]
    pair = [" ".join([*noise(30), *[w for i, x in enumerate(runs) for w in [*x, f"{side}{i}"]], *noise(30)]) for side in "xy"]
    others, behind = ([" ".join([*noise(30), *x, *noise(30)]) for x in runs for _ in range(10)] for _ in range(2))
    # two of the runs as far apart as in the pair, with nothing else in common
    apart = [" ".join([*noise(20), *runs[0], *noise(49), *runs[7], *noise(20)]) for _ in range(9)]
    texts = [*others, *apart, *pair, *behind]
    monkeypatch.setattr(passages.the_rest, "__defaults__", (block,))
    got = passages.repeated_passages(frame(spark, texts)).collect()
    at = len(others) + len(apart)
    assert {frozenset((x.doc_id, x.other_id)) for x in got} == {frozenset((at, at + 1))}
    assert any(x.end - x.start >= 60 and x.similarity >= 0.8 for x in got)


def test_texts_that_one_passage_links_are_compared_over_what_it_leaves_uncovered(spark):
    r = random.Random(18)
    words = [f"q{i}" for i in range(5000)]

    def noise(n):
        return [r.choice(words) for _ in range(n)]
    runs, own = [noise(7) for _ in range(8)], noise(60)
    pair = [" ".join([*own, *noise(60), *[w for i, x in enumerate(runs) for w in [*x, f"{side}{i}"]], *noise(30)]) for side in "xy"]
    others, behind = ([" ".join([*noise(30), *x, *noise(30)]) for x in runs for _ in range(10)] for _ in range(2))
    got = passages.repeated_passages(frame(spark, [*others, *pair, *behind])).collect()
    assert {frozenset((x.doc_id, x.other_id)) for x in got} == {frozenset((80, 81))}
    spans = sorted((x.start, x.end, x.other_start, x.other_end) for x in got)
    assert len(spans) == 2                                     # the first passage once, though the pair is compared twice
    assert spans[0] == (0, 60, 0, 60) and all(x <= 120 and y >= 180 for x, y in (spans[1][:2], spans[1][2:]))


def test_stretches_of_a_text_are_rooted_apart(spark):
    def link(a, b, *at):
        return (a, b, dict(zip(("start", "end", "other_start", "other_end"), at)))
    links = spark.createDataFrame([link(1, 2, 0, 60, 10, 70), link(1, 3, 5, 62, 0, 57), link(1, 4, 100, 160, 0, 60), link(4, 5, 30, 90, 0, 60),
                                   link(2, 6, 60, 120, 0, 60)], "a long, b long, p struct<start:int,end:int,other_start:int,other_end:int>")
    got = sorted((x[passages.RID], x.low, x.high, x.root) for x in passages.stretches(links, 4, 50).collect())
    assert [x[:3] for x in got] == [(1, -3, 62), (1, 97, 160), (2, 7, 57), (2, 57, 120), (3, -3, 57), (4, -3, 90), (5, -3, 60), (6, -3, 60)]
    roots = {x[:2]: x[3] for x in got}
    together = [{(1, -3), (2, 7), (3, -3)}, {(1, 97), (4, -3), (5, -3)}, {(2, 57), (6, -3)}]
    assert [len({roots[x] for x in group}) for group in together] == [1, 1, 1] and len(set(roots.values())) == 3


def test_rows_of_a_pair_that_is_compared_again_stand_once(spark):
    schema = "a long, b long, p struct<start:int,end:int,other_start:int,other_end:int,words:int>"
    first = [(1, 2, (0, 60, 0, 60, 55)), (1, 2, (100, 150, 100, 150, 50)), (1, 2, (200, 260, 0, 60, 50)), (3, 4, (0, 50, 0, 50, 50)), (3, 4, (0, 50, 0, 50, 50))]
    again = [(1, 2, (0, 60, 0, 60, 56)), (1, 2, (90, 150, 90, 150, 58)), (1, 2, (200, 260, 0, 60, 50)), (5, 6, (0, 50, 0, 50, 50))]
    got = passages.with_again(*[spark.createDataFrame(x, schema) for x in (first, again)]).collect()
    assert sorted((x.a, x.b, tuple(x.p)) for x in got) == sorted([again[0], again[1], first[2], *first[3:], again[3]])


def test_marks_with_roots_are_given_once_for_each_two():
    r = random.Random(20)
    for _ in range(30):
        seeds = [(r.randrange(9), p, r.randrange(3)) for p in sorted(r.sample(range(60), r.randrange(1, 20)))]
        h, pos, roots = (np.array(x, t) for x, t in zip(zip(*seeds), (np.uint64, np.int64, np.int64)))
        m, of = passages.marks(h, pos, 5, 12, roots)
        assert np.unique(m).tolist() == passages.marks(h, pos, 5, 12).tolist()
        want = {(x, y, u, v) for x, p, u in seeds for y, q, v in seeds if 5 <= q - p <= 12}
        assert len(m) == len(set(zip(m.tolist(), of.tolist()))) == len({(x, y, u) if u == v else (x, y, u, v) for x, y, u, v in want})


def test_marks_and_matches_equal_the_plain_versions():
    r = random.Random(19)
    for _ in range(60):
        a, b = ([(r.randrange(9), p) for p in sorted(r.sample(range(60), r.randrange(1, 20)))] for _ in range(2))
        (ha, pa), (hb, pb) = ([np.array(x, t) for x, t in zip(zip(*s), (np.uint64, np.int64))] for s in (a, b))
        assert sorted(map(tuple, passages.matched(ha, pa, hb, pb).tolist())) == sorted((p, q) for h, p in a for g, q in b if h == g)
        shared = {(h, g) for h, p in a for g, q in a if 5 <= q - p <= 12} & {(h, g) for h, p in b for g, q in b if 5 <= q - p <= 12}
        assert len(np.intersect1d(passages.marks(ha, pa, 5, 12), passages.marks(hb, pb, 5, 12))) == len(shared)


@pytest.mark.parametrize("lot", [passages.COUNTED, 50])
def test_hashes_of_several_texts_are_counted_from_packed_parts(spark, monkeypatch, lot):
    r = np.random.default_rng(20)
    pool = r.integers(0, 2 ** 64, 300, np.uint64)
    texts = [np.concatenate([r.choice(pool, 60), r.integers(0, 2 ** 64, 40, np.uint64), np.array([2 ** 64 - 1, 0], np.uint64)]) for _ in range(40)]
    texts += [np.repeat(np.uint64(77 << 40), 5), np.empty(0, np.uint64)]          # often, but in one text
    monkeypatch.setattr(passages, "COUNTED", lot)
    for bits in (1, 6, 16):
        batches = list(passages.by_parts((passages.runs(np.sort(x)) for x in texts), bits))
        assert (len(batches) > 1) == (lot == 50)
        parts = spark.createDataFrame([tuple(x.values()) for b in batches for x in b.to_pylist()], passages.PARTS_SQL)
        got = {x.hash: x.n for x in passages.several_texts(parts, bits).collect()}
        held = collections.Counter(h for x in texts for h in set(x.tolist()))
        n = collections.Counter(h for x in texts for h in x.tolist())
        cut = np.array([h >> (32 - bits) << (32 - bits) for h in n if held[h] > 1], np.uint64)
        assert got == dict(zip(cut.view(np.int64).tolist(), [n[h] for h in n if held[h] > 1]))
    assert list(passages.by_parts(iter([texts[-1:] * 2]), 6)) == []


def test_what_is_shuffled_of_a_hash_of_one_text_is_small():
    h = np.random.default_rng(21).integers(0, 2 ** 64, 200_000, np.uint64)
    batch, = passages.by_parts(iter([passages.runs(np.sort(h))]), 6)
    assert len(zlib.compress(b"".join(batch.column(1).to_pylist()), 1)) < 3.5 * len(h)      # a row of hash and number took 16 bytes


def test_texts_are_aligned_in_slices_and_stored_tables_go_once_read(spark):
    r = random.Random(23)
    words = [f"q{i}" for i in range(5000)]
    passage = r.sample(words, 60)
    texts = [" ".join([*r.sample(words, 40), *passage, *r.sample(words, 40)]) for _ in range(7)]
    before = set(session.SCRATCH)
    got = passages.repeated_passages(frame(spark, texts)).collect()
    assert sorted((min(x.doc_id, x.other_id), max(x.doc_id, x.other_id)) for x in got) == list(itertools.combinations(range(7), 2))
    left = [os.path.basename(x).rsplit("-", 1)[0] for x in session.SCRATCH if x not in before]
    assert left.count("passage-links") >= 3                    # 21 pairs of 7 rows: three slices
    assert not {"passage-seeds", "passage-occurrences", "passage-held", "passage-near", "passage-few", "passage-rooted"} & set(left)


def test_pairs_that_cannot_chain_are_told_from_their_matches():
    r = random.Random(22)
    for low in (0, 46):
        ms, asked = [], []
        for _ in range(600):
            at, d = r.randrange(200), r.randrange(50)
            m = [(r.randrange(400), r.randrange(400)) for _ in range(r.randrange(1, 9))]
            m += [(at + x, at + d + x + r.choice([0, 0, 1])) for x in r.sample(range(r.choice([12, 90])), r.randrange(8))]
            ms.append(np.array(m))
            paths = passages.chain([tuple(x) for x in passages.thinned(ms[-1]).tolist()], 4)
            asked.append(any(passages._seeds_of(p) >= 4 and min(p[-1][0] - p[0][0], p[-1][1] - p[0][1]) >= low for p in paths))
        hope = passages.may_chain(ms, 4, 4, low)
        assert all(hope[np.array(asked)]) and any(asked) and hope.sum() < 0.9 * len(ms)
        got = passages.flat_paths(iter(ms), 4, 4, low)
        assert [len(x) > 0 for x in got["path"]] == asked


@pytest.mark.parametrize("lot", [passages.LOT, 30])
def test_pairs_are_chained_in_lots_and_those_without_a_chain_left_out(monkeypatch, lot):
    r = random.Random(24)
    ms = [np.array([(x, x + r.randrange(2)) for x in range(r.randrange(1, 40))]) for _ in range(80)]
    monkeypatch.setattr(passages, "LOT", lot)
    a, b = pa.array(range(80)), pa.array(range(100, 180))
    batches = list(passages.chained(a, b, iter(ms), 4, 4, 20))
    assert (len(batches) > 1) == (lot == 30)
    want = passages.flat_paths(ms, 4, 4, 20)
    want = [(i, 100 + i, *[list(want[x][i]) for x in ("path", "a", "b")]) for i in range(80) if len(want["path"][i])]
    assert [tuple(x.values()) for y in batches for x in y.to_pylist()] == want and 0 < len(want) < 80


def test_pairs_are_chained_once(spark, monkeypatch):
    plans, stored = {}, passages.materialize

    def watched(df, name, partitions=1):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name, partitions)

    monkeypatch.setattr(passages, "materialize", watched)
    passage = " ".join(f"w{i}" for i in range(80))
    got = passages.repeated_passages(frame(spark, [f"{passage} x y z", f"q r {passage}"])).collect()
    assert [(x.start, x.end, x.words) for x in got] == [(0, 80, 80)]
    for name in ("passage-chains", "passage-rest"):
        assert len(re.findall(r"ArrowEvalPython|MapInArrow|MapInPandas", plans[name])) == 1


def test_longer_shingles_are_chosen_by_their_words():
    r = random.Random(16)
    words = [b"w%d" % i for i in range(400)]
    for size, window in [*passages.LONGER.items(), (passages.MIN_WORDS, 1)]:
        for _ in range(40):
            stretch = [r.choice(words) for _ in range(size + window - 1)]
            found = []
            for _ in range(2):
                text = [r.choice(words) for _ in range(r.randrange(60))] + stretch + [r.choice(words) for _ in range(r.randrange(60))]
                n = len(text) - passages.SEED + 1
                got = passages.longer(text, np.ones(n, bool), np.ones(n, bool), [size])
                assert len(set(got[0].tolist())) == len(got[0]) and all(got[2] == size)
                found.append(set(got[0].tolist()))
            assert found[0] & found[1]
    same = passages.longer([b"w"] * 500, np.ones(497, bool), np.ones(497, bool), [50])
    assert [x.tolist() for x in same[1:]] == [[0], [50]]
    h = np.array([5, 3, 3, 9, 1], np.uint64)
    assert passages.least(h, 2).tolist() == [False, True, True, False, True] and passages.least(h[:1], 2).tolist() == [True]


def test_a_text_that_repeats_itself_is_linked_once_its_words_stand_elsewhere(spark):
    r = random.Random(17)
    block, noise = [f"b{i}" for i in range(60)], [f"n{i}" for i in range(4000)]
    texts = [" ".join(block * 30), " ".join(r.sample(noise, 80)), " ".join([*r.sample(noise, 40), *block, *r.sample(noise, 40)]), " ".join(["z"] * 3000)]
    got = passages.repeated_passages(frame(spark, texts)).collect()
    assert {frozenset((x.doc_id, x.other_id)) for x in got} == {frozenset((0, 2))}
    assert any(x.words >= 60 for x in got)


def test_segments_are_the_longest_good_parts():
    r = random.Random(13)
    for _ in range(200):
        steps, a, b = [], 0, 0
        for i in range(r.randrange(1, 12)):
            n, m = (r.randrange(1, 60),) * 2 if i % 2 == 0 else (r.randrange(0, 30), r.randrange(0, 30))
            steps.append((a, a + n, b, b + m, n if i % 2 == 0 else r.randrange(0, min(n, m) + 1)))
            a, b = a + n, b + m
        good = []
        for i in range(len(steps)):
            for j in range(i, len(steps)):
                x, y, same = steps[j][1] - steps[i][0], steps[j][3] - steps[i][2], sum(s[4] for s in steps[i:j + 1])
                if min(x, y) >= 50 and same >= 0.8 * max(x, y):
                    good.append((i, j))
        best = [(i, j) for i, j in good if not any((k, m) != (i, j) and k <= i and j <= m for k, m in good)]
        assert [(s[0], s[1]) for s in passages.segments(steps)] == [(steps[i][0], steps[j][1]) for i, j in best]


# ------------------------------------------------------------------ licenses --

def test_license_scan_matches_brute_force(spark):
    r = random.Random(8)
    fill = [f"f{i}" for i in range(500)]
    texts = [None, "", "MIT License", "Released under the MIT License", "released UNDER the (MIT) license!"]
    for name, t in licenses.TEMPLATES:
        around = [" ".join(r.choice(fill) for _ in range(r.randrange(0, 60))) for _ in range(2)]
        texts.append(f"{around[0]}\n{t}\n{around[1]}")
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(f"{around[1]} {' '.join(w)} {around[0]}")
        texts.append(" ".join(t.split()[: len(t.split()) // 2]))
    texts += [" ".join(r.choice(fill) for _ in range(20_000)) + " " + licenses.TEMPLATES[3][1], texts[5], texts[5]]
    df = frame(spark, texts)
    got = {x.doc_id: x.licenses for x in licenses.scan_licenses(df).select("__row.doc_id", "licenses").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        best = {}
        for name, tt in licenses.TEMPLATES:
            share = len(brute.shingles(tt) & brute.shingles(t)) / len(brute.shingles(tt))
            if share >= 0.8:
                best[name] = max(share, best.get(name, 0))
        assert [(x.license, pytest.approx(x.containment)) for x in got[i]] == sorted(best.items()), t
    assert licenses.scan_licenses(empty(df)).count() == 0


def test_license_scan_is_native(spark):
    plan = licenses.scan_licenses(frame(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# ------------------------------------------------------------------ queries --

@needs_data
def test_queries_return_their_contracts(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import zlib
    q6 = queries.QUERIES["op6_toxicity"](spark, SF).collect()
    assert len(q6) == len(docs) and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in q6)
    assert all(x.predicted == int(x.score >= 0.5) for x in q6)
    q9 = queries.QUERIES["op9_personal_data"](spark, SF).collect()
    for x in q9:
        spans = brute.base_spans(docs[x.doc_id].text)
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert x.base_sha256 == brute.sha([text]) and x.spans.startswith(text)
        assert [x[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]
    q7 = queries.QUERIES["op7_recurring_lines"](spark, SF).collect()
    expected = brute.recurring([docs[x.doc_id].text for x in q7], lines.MIN_DOCS)
    assert [x.dropped for x in q7] == [",".join(map(str, e)) for e in expected]
    q10 = queries.QUERIES["op10_license_scan"](spark, SF).collect()
    for x in q10:
        own = brute.shingles(docs[x.doc_id].text)
        assert x.licenses == ",".join(sorted({n for n, t in licenses.TEMPLATES
                                              if len(brute.shingles(t) & own) >= 0.8 * len(brute.shingles(t))}))
    q8 = queries.QUERIES["op8_repeated_passages"](spark, SF).collect()
    for x in q8:
        a, b = brute.words(docs[x.doc_id].text.lower()), brute.words(docs[x.other_id].text.lower())
        common = collections.Counter(a[x.start:x.end]) & collections.Counter(b[x.other_start:x.other_end])
        assert sum(common.values()) >= x.words - 1 and x.end - x.start >= 50
    assert F is not None
