"""The corpus pipeline's stages, one by one and as a whole, over awkward rows."""

from collections import Counter

import pytest

import corpus_pipeline
from dagmar.llm import content_sort, pareto_mix, simhash
from tests.llm.test_documents import brute_components, brute_fingerprint, brute_languages, fake, lower, packed_ok, rows_of

NAMES = "row all largest hash salt prefix norm head keep_id group_size kept text_sha256 key first none fp component component_id size u digits _row _hash _salt _prefix _norm _key _id _stays _copy _times copies p rank".split()


def stages(spark, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialise(spark, stage(spark, out[-1], "")))
    return out


def test_stages(spark, docs, tokenizer):
    before, known, exact, near, mix, packed = stages(spark, docs)
    assert all(df.columns == docs.columns for df in (known, exact, near, mix))
    languages = list(brute_languages(rows_of(before)))
    assert Counter(r["doc_id"] for r in rows_of(known)) == Counter(i for i, lang, _ in languages if lang != "und")
    largest = {}
    for r in rows_of(known):
        k = lower(r["text"])
        largest[k] = max((x for x in (largest.get(k), r["doc_id"]) if x is not None), default=None)
    assert Counter((lower(r["text"]), r["doc_id"]) for r in rows_of(exact)) == Counter(largest.items())
    fps = [(r["doc_id"], brute_fingerprint(r["text"])) for r in rows_of(exact)]
    component = brute_components(fps)
    assert Counter(r["doc_id"] for r in rows_of(near)) == Counter(set(component.values()))
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in pareto_mix.pareto_mix(spark, near).collect()}
    assert Counter(r["doc_id"] for r in rows_of(mix)) == +Counter(taken)
    packed_ok(packed.collect(), rows_of(mix), lambda t: tokenizer.encode(t, add_special_tokens=False).ids, 2048)


def test_documents_with_null_and_shared_ids_stay(spark):
    texts = [f"{w} stands alone number {i} {w[::-1]} in its own place" for i, w in enumerate("stone river light winter garden amber".split())]
    assert len(set(map(brute_fingerprint, texts))) == len(texts)
    rows = [(i, t, None, "s", len(t)) for i, t in zip((None, None, 5, 5, 6, None), texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = stages(spark, docs)
    for df in out[1:4]:
        assert Counter(r["text"] for r in df.collect()) == Counter(texts)


def test_language_stage_drops_what_nothing_is_known_of(spark):
    learn = [i for i in range(100) if fake(i, 5)][:20]
    rows = [(i, "the river runs" if i % 2 else "la pierre reste", "en" if i % 2 else "fr") for i in learn] + [(1000, "日本語", None), (1001, "river", None), (1002, "42", "en")]
    kept = corpus_pipeline.find_language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert {r["doc_id"] for r in kept.collect()} == {*learn, 1001}


def test_empty_table(spark, no_docs):
    assert [df.count() for df in stages(spark, no_docs)] == [0] * 6


def test_whole_run(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == stages(spark, docs)[-1].count()


@pytest.mark.parametrize("stage", ["exact_dedup", "near_dedup", "mixing"])
def test_extra_columns_of_any_name(spark, stage):
    rows = [(i, f"text number {i // 2} of many words", "s", *(f"{n}{i}" for n in NAMES)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES))
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(tuple(r) == rows[r["doc_id"]] for r in got)
    if stage == "exact_dedup":
        judged = content_sort.content_sort(docs).collect()
        assert len(judged) == 12 and all(r["kept"] == (r["doc_id"] % 2 == 1) and r["row"] == f"row{r['doc_id']}" for r in judged)
    if stage == "near_dedup":
        assert simhash.near_dedup(spark, docs).count() == 12
