"""Fill-in-middle against a plain Python version and its own way back."""

import hashlib
import os

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketflow.llm import fim, queries

from .test_pipeline_operators import DOC, empty

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="testdata not present")


def plain_version(doc_id, text):
    t = text or ""
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "a", "ab", "äöü€𝄞 x", "a<P>b", "x<S>", "<M>", "<P <S <M P> S>", "<" * 40, "<P" * 30, "line\nline\r\n\x00end", "𝄞" * 300,
         "word " * 60_000, "äé€𝄞" * 9_000, "same", "same"]


@pytest.mark.parametrize("block", [64, fim.BLOCK])
def test_frame_equals_plain_python(spark, block):
    rows = [(i * 37 + k, t, "en", "s", 1, "clash", "clash", "clash") for i, t in enumerate(TEXTS) for k in range(0 if len(t or "") < 1000 else 5, 6)]
    rows += [rows[4], rows[4], (None, "null id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    got = fim.fill_in_middle(df, block=block).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    seen = set()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_version(r["__row"].doc_id, r["__row"].text)
        assert r.back == (r["__row"].text or "") and r["__row"].shard in ("clash", None)
        seen.add(r.form)
    assert seen == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(empty(df)).count() == 0


def test_all_null_table(spark):
    df = spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")
    assert [(r.n, r.form, r.output) for r in fim.fill_in_middle(df).collect()] == [(0, "plain", "")] * 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=30), st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=6), st.integers(0, 2))
def test_pieces_of_any_batch_slice(cases, skip):
    texts = pa.array(["ä"] * skip + [t for t, _, _ in cases], pa.string()).slice(skip)
    cuts = [sorted((a, b)) for _, a, b in cases]
    first, second = (pa.array([c[i] for c in cuts], pa.int64()) for i in (0, 1))
    p, m, s = fim.pieces(texts, first, second, pa.array([0] * len(cases), pa.int64()))
    for (t, _, _), (a, b), *got in zip(cases, cuts, p.to_pylist(), m.to_pylist(), s.to_pylist()):
        assert got == [t[:a], t[a:b], t[b:]]
        assert [x[0].as_py() for x in fim.long_pieces(t, a, b, 3)] == [t[:a], t[a:b], t[b:]]


@needs_data
def test_query_on_the_given_table(spark):
    from marketflow.llm.queries import table
    got = queries.QUERIES["op12_fill_in_middle"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    assert len(got) == len(texts)
    for r in got:
        n, form, a, m, output = plain_version(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, a, m)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
