"""Operators on pages and embeddings, the Elias-Fano sequence, and the registered queries."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dagmar.llm import exact_topk, merkle
from dagmar.llm.elias_fano import EliasFano


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=300), st.integers(0, 30))
def test_elias_fano(values, shift):
    values = np.sort(np.array([v >> shift for v in values], np.uint64))
    universe = int(values.max(initial=0)) + 1 + shift
    coded = EliasFano.of(values, universe)
    raw = np.frombuffer(b"".join(p.tobytes() for p in coded.parts()) + b"rest", np.uint8)
    coded, rest = EliasFano.opened(raw)
    assert rest.tobytes() == b"rest"
    assert coded.get(np.arange(len(values))).tolist() == values.tolist()
    asked = np.unique(np.concatenate([values, values + np.uint64(1), np.array([0, universe - 1], np.uint64)]))
    asked = asked[asked < universe]
    assert coded.successor(asked).tolist() == np.searchsorted(values, asked).tolist()
    assert (coded.find(asked) >= 0).tolist() == np.isin(asked, values).tolist()


def test_elias_fano_of_a_dense_run_and_64_bits():
    values = np.concatenate([np.arange(5000, dtype=np.uint64), np.uint64(2**63) + np.arange(5000, dtype=np.uint64) * np.uint64(3)])
    coded = EliasFano.of(values, 2**64)
    assert coded.find(values).tolist() == list(range(10_000))
    assert coded.find(np.array([5000, 2**63 + 1], np.uint64)).tolist() == [-1, -1]


def brute_top(rows, k, every):
    used = [(i, [int(np.floor(1024.0 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for q, a in {i: v for i, v in used if i % every == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in used if i != q)[:k]
        out.update((q, n + 1, i, -s) for n, (s, i) in enumerate(scored))
    return out


@pytest.mark.parametrize("k,wave", [(10, 512), (3, 2), (1000, 512)])
def test_top_k(spark, k, wave, monkeypatch):
    monkeypatch.setattr(exact_topk, "WAVE", wave)
    monkeypatch.setattr(exact_topk, "BLOCK", 16)
    r = random.Random(1)
    rows = [(i, [r.uniform(-2, 2) for _ in range(8)]) for i in range(60)] + [(i, [0.5] * 8) for i in range(60, 120)]
    rows += [(120, None), (130, [1.0, None]), (140, [float("nan")] * 8), (150, [float("inf")]), (160, []), (170, [1.0]), (None, [1.0] * 8), (33, [0.25] * 8), (33, [0.25] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    got = Counter(map(tuple, exact_topk.top_k(spark, df, k, 10).collect()))
    assert got == brute_top(rows, k, 10)


def test_top_k_of_nothing(spark):
    assert exact_topk.top_k(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x/{i}", "<p>" + "é" * (i * 37 % 5000)) for i in range(1400)] + [(None, None, None), (5, "http://x/5", "again"), (6, "u", None)]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, offset int")


def test_audit_finds_each_kind_of_damage(spark, pages):
    ours = merkle.records(pages)
    assert merkle.audit(spark, ours, ours).collect() == []
    theirs = merkle.damaged(ours).union(ours.where("page_id = 3").selectExpr("file", "page_id", "length", "hash", "offset + 900000000"))
    got = Counter(r["status"] for r in merkle.audit(spark, ours, theirs).collect())
    lost = sum(i % 101 == 7 for i in range(1400))
    assert got == {"missing": lost, "corrupt": sum(i % 97 == 13 and i % 101 != 7 for i in range(1400)), "extra": 1}


def test_audit_of_a_lost_file_and_of_nothing(spark, pages):
    ours = merkle.records(pages)
    whole = ours.where("file = 1").count()
    assert [r["status"] for r in merkle.audit(spark, ours, ours.where("file <> 1")).collect()] == ["missing"] * whole
    assert merkle.audit(spark, ours.limit(0), ours.limit(0)).collect() == []


def test_a_tree_is_the_hash_of_its_parts(spark):
    import hashlib

    rows = spark.createDataFrame([(0, 0, 5, "aa"), (0, 5, 5, "bb"), (0, merkle.RANGE, 3, "cc")], "file long, offset long, length long, hash string")
    low, top = merkle.levels(rows, 2)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = {r["node"]: r["digest"] for r in low.collect()}
    assert digests == {0: sha("0:5:aa\n5:5:bb"), 1: sha(f"{merkle.RANGE}:3:cc")}
    assert [r["digest"] for r in top.collect()] == [sha(f"0:{digests[0]}\n1:{digests[1]}")]


def test_scores_beyond_64_bits_are_an_error(spark):
    vectors = spark.createDataFrame([(0, [3e35]), (1, [1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(OverflowError):
        exact_topk.top_k(spark, vectors)


def test_null_page_ids_are_dealt_out(spark):
    pages = spark.createDataFrame([(None, f"u{i}", "x" * 50) for i in range(300)] + [(1, None, None)], "page_id long, url string, html string")
    rows = merkle.records(pages).collect()
    assert len({r["file"] for r in rows if r["page_id"] is None}) > 290 and all(r["file"] < 0 for r in rows if r["page_id"] is None)


def test_offsets_of_a_hot_page_id(spark):
    pages = [(7, f"u{i % 40}", "x" * (i % 13)) for i in range(900)] + [(i, None, "y") for i in range(5, 10)] + [(None, "same", None)] * 3
    rows = [tuple(r) for r in merkle.records(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).select("file", "page_id", "hash", "length", "offset").collect()]
    assert len(rows) == len(pages)
    at = {}
    for file, _, _, length, offset in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2], r[4])):
        assert offset == at.get(file, 0)
        at[file] = offset + length
    assert {r[0] for r in rows if r[1] is not None} == {0} and len(at) == 2
