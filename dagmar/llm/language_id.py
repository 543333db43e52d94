"""Language identification by word-first backoff.

A word is a run of letters, in lower case; training and prediction part texts
by the same function. A word that training has seen counts with its log
frequency in each language. An unseen word falls back to its character n-grams,
with the word's ends marked: the longest n (5 down to 1) of which any n-gram is
known gives the mean of those n-grams' log frequencies. A text's language has
the largest sum over its words. The frequency of a key with count c in a
language is (c + 0.5) / (total of the language + 0.5 * (keys + 1)), over the
words or over the n-grams of one length. ``score`` is the best language's share
of exp(sum / sqrt(words)) over all languages, so that it doesn't reach 1 by
length alone.

Training counts all words of a sample of labelled documents: at most about
``SAMPLE_DOCS`` documents and ``SAMPLE_BYTES`` bytes of text per language, drawn
by a hash of the id. Nothing else bounds the model: all words of the sample and
all their n-grams are in it, each language's alike. It is one file per level in
the shared folder, of sorted 64-bit hashes of keys with counts by language, which
workers memory-map. Prediction reads whole texts.

Defined cases: a null text and one without a letter get ``und`` and score 0; so
does every text if no row can be learned from (``known_language`` then keeps
those with a letter); ties go to the language that is first by name; rows of a
null lang are predicted but not learned from; repeated rows are predicted each;
an empty table gives an empty result; of docs only doc_id, text and lang are
looked at, and lang only in training.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagmar.llm.common import id_crc32, map_bytes, materialise, release, shared_dir, slices, table, write_bytes

SAMPLE_DOCS, SAMPLE_BYTES, LONGEST = 4000, 64 << 20, 5
#: Words remembered by a worker, times languages; bytes of text read at a time; length of a very long word.
MEMO_CELLS, SLICE, LONG = 1 << 19, 4 << 20, 64
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}+")
_LETTER = regex.compile(r"\p{L}")
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def held_out(doc_id):
    return id_crc32(doc_id) % 5 == 0


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def grams(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of marked words and the place of each one's word; the whole marked word, if it is shorter, is none."""
    marked = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    if not len(sizes) or sizes.max() < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(words)), sizes)
    h = np.full(len(points) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ points[i : i + len(h)]) * MIX[0]
        h = (h ^ (h >> np.uint64(29))) * MIX[1]
    h ^= h >> np.uint64(32)
    inside = of[: len(h)] == of[n - 1 :]
    if n == 1:  # a mark alone says nothing
        ends = np.cumsum(sizes)
        inside[ends - 1] = inside[ends - sizes] = False
    return h[inside], of[: len(h)][inside]


def digests(words: list[str]) -> np.ndarray:
    """Hashes of whole words: the n-gram that is the marked word, or XXH64 for a very long one."""
    out = np.zeros(len(words), np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(np.minimum(sizes, LONG)):
        own = np.nonzero(np.minimum(sizes, LONG) == n)[0]
        some = [words[i] for i in own]
        out[own] = grams(some, int(n) + 2)[0] if n < LONG else [xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in some]
    return out


class Level:
    """Sorted hashes of keys, each with counts by language, as arrays in a file."""

    def __init__(self, raw: np.ndarray, langs: int):
        keys, entries = (int(x) for x in raw[:16].view(np.int64)) if len(raw) else (0, 0)
        self.totals = raw[16 : 16 + 8 * langs].view(np.int64) if len(raw) else np.zeros(langs, np.int64)
        at = 16 + 8 * langs
        self.keys, at = raw[at : at + 8 * keys].view(np.uint64), at + 8 * keys
        self.first, at = raw[at : at + 8 * (keys + 1)].view(np.int64), at + 8 * (keys + 1)
        self.counts, at = raw[at : at + 8 * entries].view(np.int64), at + 8 * entries
        self.langs = raw[at : at + 4 * entries].view(np.int32)
        self.none = np.log(0.5 / (self.totals + 0.5 * (keys + 1)))

    @staticmethod
    def chunks(keys: np.ndarray, langs: np.ndarray, counts: np.ndarray, n_langs: int) -> list[bytes]:
        """The file of entries, which have a row for each key and language."""
        order = np.lexsort((langs, keys))
        keys, langs, counts = keys[order], langs[order], counts[order]
        first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)
        totals = np.bincount(langs, counts, n_langs).astype(np.int64)
        return [np.array([len(first), len(keys)], np.int64).tobytes(), totals.tobytes(), keys[first].astype(np.uint64).tobytes(), np.append(first, len(keys)).astype(np.int64).tobytes(), counts.astype(np.int64).tobytes(), langs.astype(np.int32).tobytes()]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def logs(self, at: np.ndarray) -> np.ndarray:
        """Log frequencies of known keys, by language."""
        out = np.tile(self.none, (len(at), 1))
        sizes = self.first[at + 1] - self.first[at]
        row = np.repeat(np.arange(len(at)), sizes)
        entry = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.first[at], sizes)
        out[row, self.langs[entry]] += np.log(2.0 * self.counts[entry] + 1)  # (c + 0.5) / 0.5
        return out


class Model:
    """The levels of a model: words at 0, n-grams of each length at that length."""

    def __init__(self, langs: list[str], levels: list[np.ndarray]):
        self.langs, self.levels = langs, [Level(raw, len(langs)) for raw in levels]

    @classmethod
    def opened(cls, at: dict) -> Model:
        return cls(at["langs"], [map_bytes(f"{at['folder']}/level-{n}") for n in range(LONGEST + 1)] if at["langs"] else [])

    @classmethod
    def of(cls, words: list[tuple[str, str, int]], grams_: list[tuple[str, str, int]]) -> Model:
        """From (lang, key, count), n-grams with the marks < and > in place."""
        langs = sorted({lang for lang, _, _ in words})
        at = {lang: i for i, lang in enumerate(langs)}
        level = lambda rows, key: np.frombuffer(b"".join(Level.chunks(np.array([key(k) for _, k, _ in rows], np.uint64), np.array([at[lang] for lang, _, _ in rows], np.int64), np.array([n for *_, n in rows], np.int64), len(at))), np.uint8)
        whole = lambda k: gram_digest(k)
        return cls(langs, [level(words, lambda k: digests([k])[0]), *(level([r for r in grams_ if len(r[1]) == n], whole) for n in range(1, LONGEST + 1))])

    def logs(self, words: list[str]) -> np.ndarray:
        """Each word's log frequencies, by language; zeros if nothing of it is known."""
        out = np.zeros((len(words), len(self.langs)))
        at = self.levels[0].find(digests(words))
        out[at >= 0] = self.levels[0].logs(at[at >= 0])
        todo = np.nonzero(at < 0)[0]
        for n in range(LONGEST, 0, -1):
            if not len(todo):
                break
            hashes, of = grams([words[i] for i in todo], n)
            at = self.levels[n].find(hashes)
            known = at >= 0
            distinct, back = np.unique(at[known], return_inverse=True)
            found = np.bincount(of[known], minlength=len(todo))
            rows = self.levels[n].logs(distinct)
            sums = np.stack([np.bincount(of[known], rows[back, lang], len(todo)) for lang in range(len(self.langs))], axis=1)
            out[todo[found > 0]] = sums[found > 0] / found[found > 0, None]
            todo = todo[found == 0]
        return out


def gram_digest(gram: str) -> np.uint64:
    """The hash of one n-gram, its marks included."""
    h = np.full(1, len(gram), np.uint64)
    for c in gram:
        h = (h ^ np.uint64(ord(c))) * MIX[0]
        h = (h ^ (h >> np.uint64(29))) * MIX[1]
    return (h ^ (h >> np.uint64(32)))[0]


class Predictor(dict):
    """word -> row of its log frequencies, for a bounded number of words at a time."""

    def __init__(self, model: Model):
        self.model, self.most = model, max(1024, MEMO_CELLS // max(1, len(model.langs)))
        self.rows, self.new = np.zeros((0, len(model.langs))), []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        if not self.model.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self) > self.most:
            self.clear()
            self.rows = self.rows[:0]
        ids = [list(map(self.__getitem__, words_of(t))) for t in texts]
        if self.new:
            self.rows, self.new = np.concatenate([self.rows, self.model.logs(self.new)]), []
        out = []
        for own in ids:
            if not own:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.rows[own].sum(axis=0)
            best = int(total.argmax())
            odds = np.exp((total - total[best]) / len(own) ** 0.5)
            out.append((self.model.langs[best], float(1 / odds.sum())))
        return out


def _sample(docs: DataFrame, most_docs: int, most_bytes: int) -> DataFrame:
    """Of the learnable rows of each language at most about as many, and as many bytes, as given."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # one row per language
    rates = {r["lang"]: min(1.0, 0.9 * most_docs / r["n"], most_bytes / max(1, r["bytes"])) for r in sizes}
    if not rates:
        return rows.limit(0)
    rate = F.element_at(F.create_map(*(x for k, v in rates.items() for x in (F.lit(k), F.lit(v)))), F.col("lang"))
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 24)) < rate * (1 << 24))


def count_words(batches):
    """(lang, word, n) of batches of lang and text, summed over a slice at a time."""
    for some in slices(batches, 1, SLICE):
        counts: Counter[tuple[str, str]] = Counter()
        for lang, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
            for word in words_of(text):
                counts[lang, word] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.string()), pa.array([w for _, w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])


def count_keys(batches):
    """(level, key, lang, n): words at level 0 and their n-grams at the others, an n-gram once per word, of batches of lang, word and n."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 15):
            some = batch.slice(at, 1 << 15)
            words, lang, n = some.column(1).to_pylist(), np.asarray(some.column(0), np.int64), np.asarray(some.column(2), np.int64)
            for level in range(LONGEST + 1):
                hashes, of = (digests(words), np.arange(len(words))) if not level else grams(words, level)
                if level:
                    order = np.lexsort((hashes, of))
                    hashes, of = hashes[order], of[order]
                    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])])[: len(hashes)]
                    hashes, of = hashes[new], of[new]
                order = np.lexsort((lang[of], hashes))
                hashes, own, times = hashes[order], lang[of][order], n[of][order]
                if not len(hashes):
                    continue
                first = np.nonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])]))[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), level), pa.int32()), pa.array(hashes[first].view(np.int64)), pa.array(own[first], pa.int32()), pa.array(np.add.reduceat(times, first))], ["level", "key", "lang", "n"])


def train(spark: SparkSession, docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict:
    """Where the model's files are, and its languages."""
    folder = shared_dir(spark)
    counted = _sample(docs, sample_docs, sample_bytes).select("lang", "text").mapInArrow(count_words, "lang string, word string, n long")
    words = materialise(spark, counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    if not langs:
        return {"folder": folder, "langs": []}
    number = F.element_at(F.create_map(*(x for i, k in enumerate(langs) for x in (F.lit(k), F.lit(i)))), F.col("lang"))

    def level_file(tab: pa.Table) -> pa.Table:
        level = tab["level"][0].as_py()
        chunks = Level.chunks(np.asarray(tab["key"], np.int64).view(np.uint64), np.asarray(tab["lang"], np.int64), np.asarray(tab["n"], np.int64), len(langs))
        write_bytes(f"{folder}/level-{level}", *chunks)
        return pa.table({"level": pa.array([level], pa.int32())})

    keys = words.select(number.alias("lang"), "word", "n").mapInArrow(count_keys, "level int, key long, lang int, n long")
    # a level is a group that the sample bounds, whatever the corpus
    made = {r["level"] for r in keys.groupBy("level", "key", "lang").agg(F.sum("n").alias("n")).groupBy("level").applyInArrow(level_file, "level int").collect()}
    for level in set(range(LONGEST + 1)) - made:
        write_bytes(f"{folder}/level-{level}", *Level.chunks(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), len(langs)))
    release(words)
    return {"folder": folder, "langs": langs}


def identify(spark: SparkSession, docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    model = train(spark, docs.select("doc_id", "text", "lang"), sample_docs, sample_bytes)

    def run(batches):
        predictor = Predictor(Model.opened(model))
        for some in slices(batches, 2, SLICE):
            found = predictor.predict(some.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def known_language(spark: SparkSession, docs: DataFrame, languages: list[str] | None = None, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """The rows of docs, whole, whose predicted language is one of `languages` (all learned ones by default).

    Those without a letter go, and those of which nothing is known: every
    language is then as likely as any other. If there is no language to learn
    from, those with a letter stay.
    """
    model = train(spark, docs.select("doc_id", "text", "lang"), sample_docs, sample_bytes)
    at_text = docs.columns.index("text")

    def run(batches):
        predictor = Predictor(Model.opened(model))
        wanted, blind = set(languages or model["langs"]), 1.0 / max(2, len(model["langs"]))
        for some in slices(batches, at_text, SLICE):
            texts = some.column(at_text).to_pylist()
            stays = [lang in wanted and score > blind for lang, score in predictor.predict(texts)] if model["langs"] else list(map(has_letter, texts))
            yield some.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6(spark, sf_dir: str) -> DataFrame:
    return identify(spark, table(spark, sf_dir, "documents"))
