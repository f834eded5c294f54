"""The operators of the corpus pipeline against plain Python versions."""

import collections
import math
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketflow.llm import queries, simhash
from marketflow.llm.common import ROW
from marketflow.llm.components import connected_components
from marketflow.llm.decontam import contamination
from marketflow.llm.mixing import mix_sources
from marketflow.llm.quality import bin_weights, quality_rules, trusted_ids
from marketflow.llm.shards import histogram_shards

from . import brute

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string, n_words string"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="testdata not present")


def texts_fixture():
    r = random.Random(7)
    vocabulary = ["w" + str(i) for i in range(300)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.choice([3, 60, 150]))) for _ in range(30)]
    long = " ".join(r.choice(vocabulary) for _ in range(30_000))
    near = base[1].split()
    texts = base + [" ".join([*near[:40], "x" + str(i), *near[41:]]) for i in range(8)]
    texts += [None, "", " \n\t ", "one", "one two", "A b\x0bc\x0cd", long, "äöü ß " * 40, "line\nline\n\nline\r\n" * 30, base[2], base[2]]
    return texts


@pytest.fixture(scope="module")
def rows():
    texts = texts_fixture()
    out = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 1, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, texts[4], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1 if i % 2 else 0) for i in range(20)] + [(1, 0), (None, 1), (3, None)],
                                 "doc_id long, quality int")


def empty(df):
    return df.limit(0)


# ------------------------------------------------------------------ quality --

def test_quality_statistics_and_score(spark, docs, rows, labels):
    got = quality_rules(docs, labels, buckets=1 << 10).select("__row.text", *brute.base_statistics("x"), "kept", "llr").collect()
    assert len(got) == len(rows)
    good = {r.doc_id for r in trusted_ids(labels).collect()}
    raw, trusted = collections.Counter(), collections.Counter()

    def bins(t):
        h = [brute.spark_hash(w) for w in brute.words(t)]
        import struct
        import xxhash
        pair = [xxhash.xxh64_intdigest(struct.pack("<q", b), xxhash.xxh64_intdigest(struct.pack("<q", a), 42))
                for a, b in zip(h, h[1:])]
        return [x % (1 << 10) for x in h] + [x % (1 << 10) for x in pair]
    for d, t, *_ in rows:
        raw.update(bins(t))
        if d in good:
            trusted.update(bins(t))
    assert trusted
    ratio = sum(trusted.values()) / sum(raw.values())
    for r in got:
        expected = brute.base_statistics(r.text)
        assert {k: r[k] for k in expected} == expected
        b = bins(r.text)
        llr = sum(math.log(trusted[x] + 5) - math.log(raw[x] * ratio + 5) for x in b) / len(b) if b else 0.0
        assert r.llr == pytest.approx(llr, abs=1e-9)
        assert r.kept == (not r.base_failed and r.llr >= -0.15)


def test_trusted_ids_need_one_opinion_and_are_bounded(labels):
    got = {r.doc_id for r in trusted_ids(labels).collect()}
    assert got == {3, 5, 7, 9, 11, 13, 15, 17, 19}
    assert trusted_ids(labels, 4).count() == 4


def test_quality_without_trusted_text_rejects_by_base_rule_only(docs, labels):
    got = quality_rules(docs, empty(labels)).collect()
    assert all(r.llr == 0.0 and r.kept == (not r.base_failed) for r in got)
    assert quality_rules(empty(docs), labels).count() == 0
    assert bin_weights(empty(docs), trusted_ids(labels), 8).first().weights == [0.0] * 8


# ------------------------------------------------------------------ simhash --

def test_near_duplicates_match_brute_force(docs, rows):
    got = simhash.near_duplicates(docs).select("__row.doc_id", "__row.text", "fp", "component_id", "first").collect()
    assert len(got) == len(rows)
    fps = [brute.simhash(r.text) for r in got]
    assert [r.fp & brute.M64 for r in got] == fps
    expected = brute.components([r.doc_id for r in got], fps)
    assert [r.component_id for r in got] == expected
    assert sum(r["first"] for r in got) == len(set(expected))
    assert simhash.near_duplicates(empty(docs)).count() == 0


@pytest.mark.parametrize("distance", [1, 2])
@pytest.mark.parametrize("bucket", [0, 4, 64])
def test_links_connect_what_brute_force_connects(spark, distance, bucket):
    r = random.Random(distance)
    centres = [r.getrandbits(64) for _ in range(15)]
    fps = set(centres)
    for c in centres:
        x = c
        for _ in range(12):      # a walk: long chains of near fingerprints
            for b in r.sample(range(64), r.choice([1, 2, 3])):
                x ^= 1 << b
            fps.add(x)
    for b in range(40):          # a dense ball around one centre
        fps.add(centres[0] ^ 1 << b)
    fps = sorted(fps)
    signed = [simhash._signed(x) for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance, bucket)
    root = {r.node: r.root for r in connected_components(edges).collect()}
    got = collections.defaultdict(set)
    for x in signed:
        got[root.get(x, x)].add(x)
    expected = collections.defaultdict(set)
    for x, c in zip(signed, brute.components(list(range(len(fps))), fps, distance)):
        expected[c].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_path(spark):
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1000), (5, 5)],
                                  "u long, v long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}
    assert connected_components(edges.limit(0)).count() == 0


def test_masks_cover_the_bits():
    for m in (2, 3, 5):
        seg = simhash.segments(m)
        assert sum(seg) == simhash.ALL and all(a & b == 0 for a in seg for b in seg if a is not b)
        assert all(sum(simhash.halves(s)) == s for s in seg)


# ------------------------------------------------------------------ decontamination --

@pytest.mark.parametrize("limit", [50_000, 0])
def test_contamination_matches_brute_force(spark, docs, rows, monkeypatch, limit):
    monkeypatch.setattr("marketflow.llm.decontam.BROADCAST_ROWS", limit)
    t = texts_fixture()
    pieces = [(1, " ".join(t[1].split()[3:40]) if len(t[1].split()) > 40 else t[1]), (2, t[-5][5000:5900]), (3, "one two"),
              (3, "W5"), (4, None), (5, ""), (None, "Äöü ß äöü"), (6, "not there at all, not even in part of it, never ever"),
              (7, t[40]), (7, t[40]), (8, "line LINE line line")]
    bench = spark.createDataFrame(pieces, "item_id int, text string").withColumn("n_words", F.lit("clash"))
    got = contamination(docs, bench).select("__row.text", "n_words", "n_hit", "items", "contaminated").collect()
    assert len(got) == len(rows)
    expected = brute.contamination([r.text for r in got], pieces)
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == expected
    assert all(r.contaminated == (r.n_hit > 0) for r in got) and any(r.contaminated for r in got)


def test_contamination_of_empty_tables(spark, docs):
    bench = spark.createDataFrame([(1, "a b c")], "item_id int, text string")
    assert contamination(empty(docs), bench).count() == 0
    assert not any(r.contaminated for r in contamination(docs, empty(bench)).collect())


# ------------------------------------------------------------------ mixing --

def check_mix(got, sizes_of):
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    sizes = {s: sum(r["size"] for r in rs) for s, rs in by.items()}
    expected = brute.targets(sizes)
    for s, rs in by.items():
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(expected[s]) for r in rs)
        taken = sum(r.taken for r in rs)
        assert abs(taken - expected[s]) <= max((r["size"] for r in rs), default=0)
        assert max(r.copies for r in rs) - min(r.copies for r in rs) <= 1 and max(r.copies for r in rs) <= 3
        assert all(r.taken == r.copies * r["size"] for r in rs)
    assert sorted(r["size"] for r in got) == sorted(sizes_of)


def test_mix_meets_targets_and_reruns_agree(docs, rows):
    pick = ["__row.doc_id", "__row.source", "__row.text", "size", "source_size", "target", "copies", "taken"]
    got = mix_sources(docs).select(pick).collect()
    check_mix(got, [len(brute.words(r[1])) for r in rows])
    again = mix_sources(docs.repartition(5)).select(pick).collect()
    key = lambda r: (str(r.doc_id), r.text or "", r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mix_sources(empty(docs)).count() == 0


def test_mix_prefers_quality(spark):
    rows = [(i, ("w " * 10) if i % 2 else ("w$$ " * 10), "a" if i < 2000 else "b") for i in range(2200)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).select(
        "__row.doc_id", "copies", "__row.source").filter("source = 'a'").collect()
    good = sum(r.copies for r in got if r.doc_id % 2)
    assert good > 1.5 * sum(r.copies for r in got if not r.doc_id % 2)


# ------------------------------------------------------------------ sharding --

@pytest.mark.parametrize("piece_rows", [2, 10_000])
def test_shards_are_even_and_slots_gapless(spark, docs, rows, piece_rows):
    r = random.Random(3)
    many = [(i, "t%d" % (i if r.random() < 0.6 else 0) + "x" * r.randrange(200), "en", "s", 1, "c", "c", "c") for i in range(3000)]
    many += [(5, "same", "en", "s", 1, "c", "c", "c")] * 300 + rows[:5]
    df = spark.createDataFrame(many, DOC)
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    got = histogram_shards(df, size, 8, piece_rows=piece_rows).select("__row.*", F.col("size").alias("bytes"),
                                                                     F.col("shard").alias("to"), "slot").collect()
    assert len(got) == len(many)
    total = sum(r.bytes for r in got)
    by = collections.defaultdict(list)
    for r in got:
        assert r.bytes == len((r.text or "").encode()) + 1
        by[r.to].append(r)
    biggest = max(r.bytes for r in got)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert abs(sum(r.bytes for r in rs) - total / 8) <= biggest + 0.01 * total / 8
    assert set(by) == set(range(8))
    small = histogram_shards(docs, size, 8).select("__row.text", F.col("shard").alias("to"), "slot").collect()
    assert len(small) == len(rows) and all(0 <= r.to < 8 for r in small)
    assert histogram_shards(empty(docs), size, 8).count() == 0


def test_equal_texts_stay_together_below_the_tolerance(spark):
    df = spark.createDataFrame([(i, "t%d" % (i // 2)) for i in range(4000)], "doc_id long, text string")
    got = histogram_shards(df, F.octet_length("text") + 1, 8, tolerance=0.02).select("__row.text", "shard").distinct().count()
    assert got == 2000


# ------------------------------------------------------------------ queries and pipeline --

@needs_data
def test_queries_return_their_contracts(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    q1 = {r.doc_id: r for r in queries.QUERIES["op1_quality_rules"](spark, SF).collect()}
    assert all(q1[d][k] == v for d in docs for k, v in brute.base_statistics(docs[d].text).items())
    q2 = queries.QUERIES["op2_histogram_shards"](spark, SF).collect()
    assert all(r.text_crc32 == zlib.crc32(docs[r.doc_id].text.encode()) and r["size"] == len(docs[r.doc_id].text.encode()) + 1 for r in q2)
    q3 = queries.QUERIES["op3_simhash_groups"](spark, SF).collect()
    fps = [brute.simhash(docs[r.doc_id].text) for r in q3]
    assert [r.fingerprint for r in q3] == [f"{x:016x}" for x in fps]
    assert [r.component_id for r in q3] == brute.components([r.doc_id for r in q3], fps)
    check_mix(queries.QUERIES["op4_mix_sources"](spark, SF).collect(), [len(brute.words(r.text)) for r in docs.values()])
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    q5 = queries.QUERIES["op5_decontaminate"](spark, SF).collect()
    expected = brute.contamination([docs[r.doc_id].text for r in q5], items)
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in q5] == [(a, b, len(c), brute.sha(c)) for a, b, c in expected]


@needs_data
def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("shard", F.lit("clash"))
    columns = docs.columns
    at = docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before = {(r.doc_id, r.text) for r in at.collect()}
        at = stage(spark, at, SF).persist()
        sizes.append(at.count())
        assert {(r.doc_id, r.text) for r in at.collect()} <= before
        if name != "histogram_shards":
            assert at.columns == columns
    assert sizes[0] < docs.count() and sizes[1] < sizes[0] and sizes[2] < sizes[1]
    got = at.collect()
    assert at.columns == [c for c in columns if c != "shard"] + ["shard", "slot"]
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]


def test_pipeline_stages_on_empty_and_odd_tables(spark, docs, rows):
    for odd in (docs, empty(docs)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, odd, SF)
            assert got.count() <= 3 * len(rows), name
            assert ROW not in got.columns


def test_repeated_words_with_and_without_repeated_windows(spark):
    from marketflow.llm.quality import repeated_words, word_hashes
    texts = [None, "", "a b", "a b c", "a a a a", "a b c d e f", "a b c x a b c", "a b c a b c a", " ".join(f"w{i}" for i in range(500)),
             " ".join(f"w{i % 499}" for i in range(1000)), " ".join([f"w{i}" for i in range(300)] + ["w7", "w8", "w9"])]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", repeated_words(word_hashes(F.col("t"))).alias("n"))
    for x in got.collect():
        w = (texts[x.i] or "").split()
        windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        assert x.n == len({i + j for i, v in enumerate(windows) if windows.count(v) > 1 for j in range(3)})
    assert "array_distinct" in got._jdf.queryExecution().analyzed().toString()       # no sorting where no window repeats
