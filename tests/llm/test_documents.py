"""Each operator on documents against a brute-force version, over awkward rows and none."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from dagmar.llm import best_fit, content_sort, language_id, license_scan, ngram_lm, pareto_mix, separator_scan, simhash
from dagmar.llm.tokens import encoder

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows_of(df):
    return [r.asDict() for r in df.select("doc_id", "text", "lang", "source").collect()]


def fake(doc_id, mod):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod


def test_encoder_equals_tokenizers(tokenizer):
    texts = ["", " ", "\n\n a  b\t", "l'été  n'est-ce pas?? 123 <|endoftext|> ", "日本語 🙂 x" * 3, "don't we'll", "\x00\x7f\xa0　end  "]
    for t in texts:
        assert np.frombuffer(encoder().ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_equals_tokenizers_on_documents(tokenizer):
    import duckdb

    for (t,) in duckdb.connect().execute("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall():
        assert np.frombuffer(encoder().ids(t or ""), "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


def test_separator_scan(spark, docs, tokenizer):
    files = separator_scan.write_flat(spark, docs, file_tokens=3000)
    ids = {(r["file"], i): d for r in files.collect() for i, d in enumerate(r["ids"])}
    for block, group in ((7, 2), (1000, 64), (1 << 20, 64)):
        found = separator_scan.scan(spark, files.select("path", "file", "tokens"), block_tokens=block, group=group).collect()
        got = sorted((str(ids[r["file"], r["ordinal"]]), r["n_tokens"]) for r in found)
        assert got == sorted((str(r["doc_id"]), len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows_of(docs))
        assert all(r["terminated"] for r in found)


def test_separator_scan_of_files_from_elsewhere(spark, tmp_path):
    ids = [5, 6, 9, 9, 7, 9, 8, 8, 8]
    (tmp_path / "flat").write_bytes(struct.pack("<9I", *ids))
    (tmp_path / "none").write_bytes(b"")
    files = spark.createDataFrame([(str(tmp_path / "flat"), 0, 9), (str(tmp_path / "none"), 1, 0)], "path string, file long, tokens long")
    for block in (1, 2, 3, 100):
        got = sorted(tuple(r) for r in separator_scan.scan(spark, files, end=9, width=4, block_tokens=block, group=2).collect())
        assert got == [(0, 0, 0, 2, True), (0, 1, 3, 0, True), (0, 2, 4, 1, True), (0, 3, 6, 3, False)]


def test_pareto_mix(spark, docs):
    rows = rows_of(docs)
    got = pareto_mix.pareto_mix(spark, docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(WORDS.findall(r["text"] or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    targets, left, free = {}, 1.5 * sum(sizes.values()), set(names)
    while free:
        each = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * each > 2 * sizes[s]}
        if not full:
            targets |= {s: weight[s] * each for s in free}
            break
        for s in full:
            targets[s] = 2.0 * sizes[s]
            left -= targets[s]
        free -= full
    assert len(got) == len(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], targets[r["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in names:
        assert abs(taken[s] - targets[s]) <= largest[s] / 2, (s, taken[s], targets[s])
    again = pareto_mix.pareto_mix(spark, docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_pareto_order_has_its_own_odds_for_each_document(spark):
    """400 sources of the same sizes are 400 draws of one sample: documents are taken as often as their probability says."""
    from pyspark.sql import functions as F

    sizes = [1, 2, 4, 9, 16, 25, 36, 49, 64, 400] * 4
    ids = spark.range(400 * len(sizes)).withColumn("i", (F.col("id") % len(sizes)).cast("int"))
    docs = ids.select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.floor(F.col("id") / len(sizes))).alias("source"), F.expr("repeat('w ', element_at(array(" + ",".join(map(str, sizes)) + "), i + 1))").alias("text"))
    whole = sum(sizes)
    chosen = {}
    for measure in (F.sqrt, lambda size: F.lit(1.0)):
        got = pareto_mix.pareto_mix(spark, docs, measure, weights=(1,), share=0.7).collect()
        taken, words_ = Counter(), Counter()
        for r in got:
            taken[r["size"]] += r["taken"] > 0
            words_[r["source"]] += r["taken"]
        assert all(abs(w - 0.7 * whole) <= 200 for w in words_.values())
        weight = {s: (s**0.5 if measure is F.sqrt else 1.0) for s in set(sizes)}
        sure, left = set(), 0.7 * whole
        while True:  # split off what is certain
            k = left / sum(weight[s] * s for s in sizes if s not in sure)
            more = {s for s in weight if s not in sure and k * weight[s] > 1}
            if not more:
                break
            left -= sum(s for s in sizes if s in more)
            sure |= more
        for s in weight:
            p = 1.0 if s in sure else k * weight[s]
            assert abs(taken[s] / (400 * sizes.count(s)) - p) < 0.06, (s, p, taken[s])
        chosen[measure] = {r["doc_id"] for r in got if r["taken"]}
    assert chosen[F.sqrt] != chosen.popitem()[1]


def test_rows_alike_at_the_cut(spark):
    rows = [(7, "a b c d", "s")] * 100 + [(None, f"a b c {i}", "s") for i in range(20)] + [(8, None, "t"), (9, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    for share in (0.3, 0.5, 1.25, 1.6):
        got = pareto_mix.pareto_mix(spark, docs, weights=(1,), share=share).collect()
        assert len(got) == len(rows) and abs(sum(r["taken"] for r in got) - share * 480) <= 2
        out = pareto_mix.mixed(spark, docs, weights=(1,), share=share).collect()
        assert 4 * len(out) == sum(r["taken"] for r in got)


def test_mixed_rows_agree_with_the_mix(spark, docs):
    times = Counter()
    for r in pareto_mix.pareto_mix(spark, docs).collect():
        times[r["doc_id"]] += r["taken"]
    got, out = Counter(), pareto_mix.mixed(spark, docs)
    for r in out.collect():
        got[r["doc_id"]] += len(WORDS.findall(r["text"] or ""))
    assert +got == +times and out.columns == docs.columns


def test_content_sort(spark, docs):
    rows, groups = rows_of(docs), defaultdict(list)
    for r in rows:
        groups[lower(r["text"])].append(r["doc_id"])
    for least_hot in (64, 1, 10_000):
        out = content_sort.content_sort(docs, least_hot=least_hot)
        got, kept = out.collect(), Counter()
        assert len(got) == len(rows) and out.columns[:7] == docs.columns
        for r in got:
            key = lower(r["text"])
            assert r["group_size"] == len(groups[key]) and r["text_sha256"] == hashlib.sha256(key.encode()).hexdigest()
            assert r["keep_id"] == max((i for i in groups[key] if i is not None), default=None)
            kept[key] += r["kept"]
            assert not r["kept"] or r["doc_id"] == r["keep_id"]
        assert set(kept.values()) == {1}


def test_content_sort_of_null_ids(spark):
    docs = spark.createDataFrame([(None, "x")] * 200 + [(None, "y")], "doc_id long, text string")
    got = content_sort.content_sort(docs).collect()
    assert Counter((r["text"], r["group_size"], r["keep_id"]) for r in got if r["kept"]) == {("x", 200, None): 1, ("y", 1, None): 1}


def packed_ok(got, rows, ids_of, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    expected = Counter()
    for r in rows:
        ids = ids_of(r["text"] or "") + [0]
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[r["doc_id"], i, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [2048, 50])
def test_best_fit(spark, docs, tokenizer, capacity):
    got = best_fit.pack(spark, docs, capacity).collect()
    bins = packed_ok(got, rows_of(docs), lambda t: tokenizer.encode(t, add_special_tokens=False).ids, capacity)
    lengths = sorted((r["length"] for r in got), reverse=True)
    gaps = []
    for n in lengths:
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - n)
    assert bins <= len(gaps)


@pytest.mark.parametrize("lengths", [{7: 3, 5: 2, 3: 4, 1: 9}, {10: 2, 6: 1}, {1: 1000}, {}, {k: 40 * k % 31 + 1 for k in range(1, 101)}])
def test_places_hold_every_rank_once(spark, lengths):
    capacity = 10 if max(lengths, default=0) <= 10 else 100
    placed, bins = best_fit.places(spark, spark.createDataFrame(list(lengths.items()), "length int, n long"), capacity)
    ranks, filled = defaultdict(list), defaultdict(list)
    for r in placed.collect():
        for i in range(r["n"]):
            ranks[r["length"]].append(r["lo"] + i)
            filled[r["bin"] + i // r["per"]].append((r["offset"] + i % r["per"] * r["length"], r["length"]))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in lengths.items()}
    assert sorted(filled) == list(range(bins))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    gaps = []
    for n in sorted((k for k, m in lengths.items() for _ in range(m)), reverse=True):  # best-fit decreasing, one by one
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - n)
    assert bins <= 1.01 * len(gaps) + 1


def test_ranges_sweep_as_one_would():
    import random

    r = random.Random(2)
    for _ in range(50):
        gaps = [(g, 1000 * i, r.randint(1, 4)) for i, g in enumerate(r.sample(range(1, 100), 12))]
        documents = [(s, 0, r.randint(1, 4)) for s in r.sample(range(51, 100), 8)]  # one to a bin
        placed, left, rest, _ = best_fit.sweep(gaps, documents, 100)
        parts = [best_fit.sweep([g for g in gaps if lo < g[0] <= lo + 25], [d for d in documents if lo < d[0] <= lo + 25], 100) for lo in (0, 25, 50, 75)]
        top = best_fit.sweep([g for p in parts for g in p[2]], [d for p in parts for d in p[1]], 100)
        pairs = lambda ps: Counter((p[0], p[5]) for p in ps for _ in range(p[2]))
        assert pairs(placed) == pairs(top[0] + [x for p in parts for x in p[0]])
        assert sum(d[2] for d in left) == sum(d[2] for d in top[1]) and sum(g[2] for g in rest) == sum(g[2] for g in top[2])


def test_language_id(spark, docs):
    got = language_id.identify(spark, docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (fake(r["doc_id"], 5) == 0)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" for i in (100, 101, 102, 107))
    assert all(r["lang_pred"] in ("en", "fr") for r in got if r["doc_id"] not in (100, 101, 102, 107))
    kept = language_id.known_language(spark, docs)
    assert kept.count() == len(got) - 4 and kept.columns == docs.columns


def test_documents_stay_without_a_language_to_learn_from(spark):
    held = next(i for i in range(100) if fake(i, 5) == 0)
    rows = [(None, "the river", None), (1, "été", None), (2, "12 !", None), (3, None, None), (held, "la pierre", "fr")]
    kept = language_id.known_language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(r["text"] for r in kept.collect()) == ["la pierre", "the river", "été"]


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in language_id.identify(spark, docs).collect() if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) >= 0.97 * len(got)


def test_language_id_backs_off():
    model = language_id.Model.of([("en", "the", 9), ("fr", "le", 9)], [("en", "ing>", 5), ("en", "g>", 5), ("fr", "eau>", 5), ("fr", "u>", 5), ("fr", "e", 1)])
    predict = lambda t: language_id.Predictor(model).predict([t])[0]
    assert predict("the the")[0] == "en" and predict("walking")[0] == "en" and predict("bateau chateau")[0] == "fr"
    assert predict("zzz") == ("en", 0.5) and predict("12 .") == ("und", 0.0) and predict(None) == ("und", 0.0)


def brute_languages(rows):
    """doc_id, lang_pred and score of every row, by plain counting."""
    import regex

    split = lambda t: regex.findall(r"\p{L}+", (t or "").lower())
    words, levels = defaultdict(Counter), [defaultdict(Counter) for _ in range(6)]
    for r in rows:
        if fake(r["doc_id"], 5) and r["lang"]:
            words[r["lang"]].update(split(r["text"]))
    langs = sorted(k for k in words if words[k])

    def grams(w, n):
        return [g for g in (f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)) if g not in "<>"]

    for lang in langs:
        levels[0][lang] = words[lang]
        for w, c in words[lang].items():
            for n in range(1, 6):
                for g in set(grams(w, n)):
                    levels[n][lang][g] += c
    keys = [set().union(*(level[k] for k in langs)) for level in levels]

    def log(n, key, lang):
        return math.log((levels[n][lang][key] + 0.5) / (sum(levels[n][lang].values()) + 0.5 * (len(keys[n]) + 1)))

    def score(w, lang):
        if w in keys[0]:
            return log(0, w, lang)
        for n in range(5, 0, -1):
            if found := [g for g in grams(w, n) if g in keys[n]]:
                return sum(log(n, g, lang) for g in found) / len(found)
        return 0.0

    memo = {}
    for r in rows:
        own = split(r["text"])
        if not own or not langs:
            yield r["doc_id"], "und", 0.0
            continue
        totals = [sum(memo.setdefault((w, k), score(w, k) if (w, k) not in memo else memo[w, k]) for w in own) for k in langs]
        best = max(range(len(langs)), key=lambda i: (totals[i], -i))
        yield r["doc_id"], langs[best], 1 / sum(math.exp((t - totals[best]) / len(own) ** 0.5) for t in totals)


def test_language_id_against_brute_force(spark, docs, tmp_path):
    rows = rows_of(docs) + [{"doc_id": 900 + i, "text": t, "lang": None, "source": "x"} for i, t in enumerate(["gardenings lumière", "x² y_z 3été", "Ünbekannt qqq", "w" * 200, "e\u0301te\u0301"])]
    frame = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in rows], "doc_id long, text string, lang string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (str(r[0]), r[1], r[2])
    got = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.op6(spark, str(tmp_path)).collect()), key=key)
    want = sorted(brute_languages(rows), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-9), (a, b)


def test_sample_is_bounded(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('word ', id) AS text", "if(id % 4 = 0, 'fr', 'en') AS lang")
    for bounds in ((200, 1 << 30), (1 << 30, 200 * 9)):
        drawn = Counter(r["lang"] for r in language_id._sample(docs, *bounds).collect())
        assert 100 < drawn["en"] < 260 and 100 < drawn["fr"] < 260


def brute_fingerprint(text):
    words = WORDS.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fps: list of (doc_id, fp) -> component of each fp."""
    distinct = sorted({f for _, f in fps})
    of = {f: f for f in distinct}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                of[find(b)] = find(a)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return {f: least.get(find(f)) for f in distinct}


def test_simhash(spark, docs):
    rows = rows_of(docs)
    fps = [(r["doc_id"], brute_fingerprint(r["text"])) for r in rows]
    component = brute_components(fps)
    got = simhash.near_dedup(spark, docs).collect()
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == Counter((i, f, component[f]) for i, f in fps)
    kept = simhash.one_of_each(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(component.values()))


def test_one_of_each_of_null_and_repeated_ids(spark):
    texts = [f"{w} stands alone number {i} {w[::-1]}" for i, w in enumerate("stone river light winter garden amber".split())]
    rows = [(None, t) for t in texts[:3]] * 2 + [(7, t) for t in texts[3:5]] + [(8, texts[4]), (None, texts[5]), (9, texts[5])]
    assert len(set(brute_components([(i, brute_fingerprint(t)) for i, t in enumerate(texts)]).values())) == len(texts)
    kept = simhash.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([(None, t) for t in texts[:3]] + [(7, texts[3]), (7, texts[4]), (9, texts[5])])


@pytest.mark.parametrize("bucket", [2, 64])
def test_links_between_crowded_fingerprints(spark, bucket):
    import random

    r = random.Random(3)
    fps = set()
    for _ in range(6):
        base = r.getrandbits(64)
        for _ in range(40):
            f = base
            for _ in range(r.randint(0, 4)):
                f ^= 1 << r.randrange(64)
            fps.add(f)
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    marked = spark.createDataFrame([(i, simhash.signed(f)) for i, f in rows], "doc_id long, fp long")
    edges = simhash.links(spark, marked, bucket).collect()
    assert all(((e["src"] ^ e["dst"]) & (1 << 64) - 1).bit_count() <= 2 for e in edges)
    got = {r["fp"] % (1 << 64): r["component_id"] for r in simhash.components(spark, marked).collect()}
    assert got == brute_components(rows)


def brute_scores(rows):
    train = [[*WORDS.findall(lower(r["text"])), None] for r in rows if fake(r["doc_id"], 5) != 1]
    c, pair, kinds = Counter(w for d in train for w in d), Counter(), Counter()
    for d in train:
        for u, w in zip([None, *d[:-1]], d, strict=True):
            pair[u, w] += 1
    for u, _ in pair:
        kinds[u] += 1
    n, v = sum(c.values()), len(c)
    once, twice = (sum(x == k for x in pair.values()) for k in (1, 2))
    discount = min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95)
    for r in rows:
        tokens = [*WORDS.findall(lower(r["text"])), None]
        base = score = 0.0
        for u, w in zip([None, *tokens[:-1]], tokens, strict=True):
            p = (c[w] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            score += math.log10(max(pair[u, w] - discount, 0) / c[u] + discount * kinds[u] / c[u] * p) if c[u] else math.log10(p)
        yield r["doc_id"], fake(r["doc_id"], 5) == 1, len(tokens), sum(c[w] > 0 for w in tokens), n, base, score


def test_ngram_lm(spark, docs):
    key = lambda r: (str(r[0]), r[2], r[5])
    got = sorted(map(tuple, ngram_lm.score(docs, ngram_lm.build(spark, docs)).collect()), key=key)
    want = sorted(brute_scores(rows_of(docs)), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(a[6] - b[6]) <= 2e-4 * a[2], (a, b)


def brute_trigram_scores(rows):
    ends = lambda r: [None, *WORDS.findall(lower(r["text"])), None]
    train = [ends(r) for r in rows if fake(r["doc_id"], 5) != 1]
    c, pair, triple = Counter(w for d in train for w in d[1:]), Counter(), Counter()
    for d in train:
        pair.update(zip(d, d[1:]))
        triple.update(zip(d, d[1:], d[2:]))
    after = [Counter(k[:-1] for k in counted) for counted in (pair, triple)]
    n, v = sum(c.values()), len(c)
    discounts = []
    for counted in (pair, triple):
        once, twice = (sum(x == k for x in counted.values()) for k in (1, 2))
        discounts.append(min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95))
    for r in rows:
        d, score = ends(r), 0.0
        for i in range(1, len(d)):
            p = (c[d[i]] + 0.5) / (n + 0.5 * (v + 1))
            if seen := c[d[i - 1]]:
                p = max(pair[d[i - 1], d[i]] - discounts[0], 0) / seen + discounts[0] * after[0][d[i - 1],] / seen * p
            if i > 1 and (seen := pair[d[i - 2], d[i - 1]]):
                p = max(triple[d[i - 2], d[i - 1], d[i]] - discounts[1], 0) / seen + discounts[1] * after[1][d[i - 2], d[i - 1]] / seen * p
            score += math.log10(p)
        yield r["doc_id"], len(d) - 1, score


def test_trigram_lm(spark, docs, tmp_path):
    key = lambda r: (str(r[0]), r[1], r[2])
    rows = rows_of(docs)
    got = sorted(((r["doc_id"], r["n_tokens"], r["score"]) for r in ngram_lm.score(docs, ngram_lm.build(spark, docs, order=3)).collect()), key=key)
    want = sorted(brute_trigram_scores(rows), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) <= 2e-4 * a[1], (a, b)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    query = {(r["doc_id"], r["n_tokens"]): r["score"] for r in ngram_lm.op10(spark, str(tmp_path)).collect()}
    assert all(abs(query[a[:2]] - a[2]) < 1e-6 for a in got)


def test_counts_beyond_a_byte():
    counts = np.array([1, 254, 255, 256, 3, 10**6, 2], np.uint32)
    raw = np.frombuffer(b"".join(ngram_lm._small(counts)), np.uint8)
    assert ngram_lm._at(raw, np.array([6, 5, 1, 2, 0, 3, 3])).tolist() == [2, 10**6, 254, 255, 1, 256, 256]


def test_ngram_lm_without_training_rows(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(200) if fake(i, 5) == 1][:3], "doc_id long, text string")
    got = ngram_lm.score(docs, ngram_lm.build(spark, docs)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(3, 0, 0, 0.0, 0.0)] * 3


def test_license_scan(spark, docs):
    assert license_scan.scan_licenses(spark, docs).count() == 0
    mit = license_scan.TEMPLATES["MIT-permission"]
    edited = mit.replace("free of charge", "without charge").replace("copies of the Software", "some copies of all the Software")
    rows = [(1, "Intro words. " + edited + " end of it " * 500 + "Released under the MIT licence, no: Released under the MIT License."), (2, mit[:200]), (3, None), (4, "released UNDER the (mit) license"), (4, "released UNDER the (mit) license")]
    got = license_scan.scan_licenses(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["license"]) for r in got)[(4, "MIT-statement")] == 2
    first = [r for r in got if r["doc_id"] == 1]
    whole = next(r for r in first if r["license"] == "MIT-permission")
    assert 0.85 < whole["coverage"] < 1 and rows[0][1][whole["start_char"] : whole["end_char"]] == edited
    assert [r["coverage"] for r in first if r["license"] == "MIT-statement"] == [0.8, 1.0]
    assert not [r for r in got if r["doc_id"] in (2, 3)]


def test_alignment_finds_what_an_unbanded_one_finds():
    import random

    r = random.Random(5)
    for _ in range(30):
        template = [r.randint(1, 9) for _ in range(12)]
        text = [r.randint(0, 9) for _ in range(5)] + [w for w in template if r.random() > 0.1] + [r.randint(0, 9) for _ in range(5)]
        assert license_scan.align(template, text, -1, 11)[0] >= license_scan.align(template, text, -100, 100)[0] - 1


def test_licenses_against_an_alignment_at_all_places(spark, tmp_path):
    """Edited templates amid prose, and prose alone: what the query reports is what an alignment of every template with every whole text finds."""
    import random

    r = random.Random(11)
    filler = "river stone the of and software to license under winter copy".split()
    chosen = {n: license_scan.TEMPLATES[n] for n in ("MIT-statement", "CC-BY-4.0-statement", "CC-BY-SA-4.0-statement", "GPL-3.0-statement", "MPL-2.0-notice", "ISC", "BSD-2-Clause-statement")}
    rows = []
    for i in range(60):
        words = chosen[r.choice(list(chosen))].split()
        for _ in range(r.randint(0, max(1, len(words) // 12))):
            words[r.randrange(len(words))] = r.choice(["changed", ""])
        around = [" ".join(r.choice(filler) for _ in range(r.randint(0, 30))) for _ in range(2)]
        rows.append((i, f"{around[0]} {' '.join(words) if i % 6 else ''} {around[1]}"))
    index = license_scan.Index(chosen)
    want = {}
    for i, text in rows:
        numbers = [index[w] for w in WORDS.findall(text)]
        for t, name in enumerate(index.names):
            matched, start, end = license_scan.align(index.templates[t], numbers, -(10**6), 10**6)
            if matched >= 0.8 * len(index.templates[t]):
                want[i, name] = (matched / len(index.templates[t]), start, end)
    got = defaultdict(list)
    for m in license_scan.scan_licenses(spark, spark.createDataFrame(rows, "doc_id long, text string"), chosen).collect():
        got[m["doc_id"], m["license"]].append((m["coverage"], m["start_word"], m["end_word"]))
    assert all(k in want and want[k] in v for k, v in got.items())
    for i, name in want.keys() - got.keys():  # a better match of another template holds it
        assert any(j == i and o != name and c >= want[i, name][0] and s <= want[i, name][1] and want[i, name][2] <= e for (j, o), (c, s, e) in want.items())
    assert len(got) > 30


def test_ids_that_do_not_fit_are_an_error(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(Exception, match="don't fit"):
        separator_scan.write_flat(spark, docs, end=1 << 16)


OPERATORS = {
    "pareto_mix": lambda s, d: pareto_mix.pareto_mix(s, d),
    "mixed": lambda s, d: pareto_mix.mixed(s, d),
    "content_sort": lambda s, d: content_sort.content_sort(d),
    "best_fit": lambda s, d: best_fit.pack(s, d),
    "identify": lambda s, d: language_id.identify(s, d),
    "known_language": lambda s, d: language_id.known_language(s, d),
    "near_dedup": lambda s, d: simhash.near_dedup(s, d),
    "one_of_each": lambda s, d: simhash.one_of_each(s, d),
    "ngram_lm": lambda s, d: ngram_lm.score(d, ngram_lm.build(s, d)),
    "license_scan": lambda s, d: license_scan.scan_licenses(s, d),
    "separator_scan": lambda s, d: separator_scan.scan(s, separator_scan.write_flat(s, d).select("path", "file", "tokens")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, no_docs, name):
    assert OPERATORS[name](spark, no_docs).collect() == []
