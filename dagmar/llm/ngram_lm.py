"""N-gram language-model scoring over an Elias-Fano trie.

The model has absolute discounting and is of order three (or two, by parameter),
interpolated with the smoothed unigram of the contract:

    P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))
    P(w | u) = max(c(u w) - D, 0) / c(u) + D T(u) / c(u) * P(w)
    P(w | t u) = max(c(t u w) - E, 0) / c(t u) + E T(t u) / c(t u) * P(w | u)

T(u) is the number of distinct tokens after u, D = n1 / (n1 + 2 n2) from the
numbers of bigrams seen once and twice, E the same of trigrams. The context of a
text's first token is the end token, that of its second the end token and the
first; a context without a count leaves the shorter one's probability. Over all
known tokens and one unknown these sum to 1.

Counts are gathered over all training documents: every task counts its own
tokens and sends sorted blocks of counts to the model's shards. There are three
levels, each in flat files below the shared folder that workers memory-map:

* words: a shard holds a range of 64-bit hashes of words, Elias-Fano coded, and
  their counts. A word's number is its rank among all hashes;
* bigrams: a shard holds the sorted numbers of its contexts, monotone pointers
  to where each one's successors begin, the successors themselves (made
  monotone by the context's rank), the quantised log10 of each smoothed
  probability and of each context's backoff weight, in 16 bits. A bigram is
  found by a successor search within its context's range;
* trigrams: in the shard of their first two tokens, whose rank among the shard's
  bigrams is their context: pointers, successors and counts, from which P is
  computed when a text is scored.

A context with a large share of all tokens is spread over the bigram shards by
its successors. A shard is built by one task; shards hold a fixed amount of
training text, so that there are more of them, not larger ones, for more text.
Words stand for their 64-bit hashes: counts are exact unless two words share one.

Defined cases: a null text counts as empty and has the end token alone; a null
id counts as an empty id text; without training documents every token is
unknown and scores 0 (N = V = 0 gives probability 1 to the unknown); repeated
rows count and are scored each; an empty table gives an empty result; of docs
only doc_id and text are looked at.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagmar.llm.common import id_crc32, map_bytes, shared_dir, slices, table, write_bytes
from dagmar.llm.elias_fano import EliasFano

#: Bytes of training text for each shard of either level; bytes of text read at a time; words or token pairs held before they are sent.
WORD_SHARD, PAIR_SHARD, SLICE, HELD_WORDS, HELD_PAIRS = 64 << 20, 24 << 20, 4 << 20, 1 << 20, 1 << 21
#: log10 of a probability in [-FLOOR, 0] is kept in steps of FLOOR / 65535.
FLOOR = 16.0
#: Successors of a hot context are spread over so many groups.
SPREAD = 64
#: A bigram's place is its shard's number times 2 ** PLACE and its rank there.
PLACE = 40


def held_out(doc_id):
    return id_crc32(doc_id) % 5 == 1


def quantise(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-logs * (65535 / FLOOR)), 0, 65535).astype(np.uint16)


def unquantise(codes: np.ndarray) -> np.ndarray:
    return codes * (-FLOOR / 65535)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many words each text has, all words in a row as places in the distinct ones, and those; A-Z in lower case. Arrow's ASCII white space is exactly what parts words."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat, sizes = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    there = np.asarray(pc.binary_length(flat)) > 0  # white space at either end leaves an empty part there
    if not there.all():
        upto = np.concatenate([[0], np.cumsum(there)])
        ends = np.cumsum(sizes)
        sizes = upto[ends] - upto[ends - sizes]
        flat = flat.filter(pa.array(there))
    coded = flat.dictionary_encode()
    return sizes, np.asarray(coded.indices).astype(np.int64), coded.dictionary


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers: multiply and xor-shift by turns."""
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


def digests(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, which is not empty: the sum of its bytes, each times a random number of its place, mixed with the length."""
    if not len(words):
        return np.zeros(0, np.uint64)
    kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
    offsets = np.frombuffer(words.buffers()[1], kind)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    places = _mixed(np.arange(1, int(sizes.max()) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    terms = (raw.astype(np.uint64) + np.uint64(1)) * places[np.arange(len(raw)) - np.repeat(starts, sizes)]
    return _mixed(np.add.reduceat(terms, starts) + sizes.astype(np.uint64))


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place of each key among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(keys)]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[new], back


def _pad(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


def _runs(sorted_keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    if not len(sorted_keys):
        return sorted_keys, counts
    first = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
    return sorted_keys[first], np.add.reduceat(counts, np.nonzero(first)[0])


def _block(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted distinct keys as an Elias-Fano sequence from the first on, and counts in as few bytes as they take."""
    base = int(keys[0])
    coded = EliasFano.of(keys - np.uint64(base), int(keys[-1]) - base + 1)
    wide = np.min_scalar_type(int(counts.max()))
    return b"".join([np.array([base], np.uint64).tobytes(), *(p.tobytes() for p in coded.parts())]), bytes([np.dtype(wide).itemsize]) + counts.astype(wide).tobytes()


def _unblock(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(keys, np.uint8)
    base = raw[:8].view(np.uint64)[0]
    coded, _ = EliasFano.opened(raw[8:])
    return coded.get(np.arange(coded.n)) + base, np.frombuffer(counts[1:], f"<u{counts[0]}").astype(np.int64)


def _merged(tab: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    pairs = [_unblock(k.as_py(), c.as_py()) for k, c in zip(tab["keys"], tab["counts"], strict=True)]
    keys, counts = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    order = np.argsort(keys, kind="stable")
    return _runs(keys[order], counts[order])


def _small(counts: np.ndarray) -> tuple[bytes, ...]:
    """Counts in a byte each, those of 255 and more also in full."""
    large = np.nonzero(counts >= 255)[0]
    return np.array([len(large)], np.int64).tobytes(), large.tobytes(), counts[large].astype(np.int64).tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes()


def _at(raw: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The counts at some places of those written by _small."""
    n = int(raw[:8].view(np.int64)[0])
    large, full, small = raw[8 : 8 + 8 * n].view(np.int64), raw[8 + 8 * n : 8 + 16 * n].view(np.int64), raw[8 + 16 * n :]
    out = small[where].astype(np.int64)
    if n:
        over = out == 255
        out[over] = full[np.searchsorted(large, where[over])]
    return out


def _fitting(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits, or an error if one is beyond that."""
    if len(counts) and int(counts.max()) >= 1 << 32:
        raise OverflowError("an n-gram occurs more than 2**32 times")
    return counts.astype(np.uint32)


def _discount(once: int, twice: int) -> float:
    return min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95)


def _triples(tab: pa.Table, pairs: np.ndarray, vocabulary: int, slices: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams, as rank of the bigram in pairs * vocabulary + token, and their counts; merged by ranges of rank, which need less memory."""
    blocks, v = [], np.uint64(vocabulary)
    for k, n, c in zip(tab["keys"], tab["next"], tab["next_counts"], strict=True):
        if not len(n.as_py()):
            continue
        raw = np.frombuffer(k.as_py(), np.uint8)
        own, _ = EliasFano.opened(raw[8:])
        rank = np.searchsorted(pairs, own.get(np.arange(own.n)) + raw[:8].view(np.uint64)[0]).astype(np.uint64)
        keys, counts = _unblock(n.as_py(), c.as_py())
        blocks.append((rank[(keys // v).astype(np.int64)] * v + keys % v, counts.astype(np.uint32)))
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.uint32))]
    edges = [np.uint64(len(pairs) * i // slices) * v for i in range(slices + 1)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        cuts = [(*np.searchsorted(k, np.array([lo, hi], np.uint64)), k, c) for k, c in blocks]
        if cuts:
            keys, counts = np.concatenate([k[a:b] for a, b, k, _ in cuts]), np.concatenate([c[a:b] for a, b, _, c in cuts])
            order = np.argsort(keys, kind="stable")
            out.append(_runs(keys[order], counts[order]))
    return np.concatenate([k for k, _ in out]), np.concatenate([c for _, c in out])


class Words:
    """The word level: number and count of a word by its hash."""

    def __init__(self, folder: str, sizes: list[int]):
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.shards = []
        for s in range(len(sizes)):
            coded, rest = EliasFano.opened(map_bytes(f"{folder}/words-{s:05d}"))
            self.shards.append((coded, rest[: 8 * coded.n].view(np.int64)))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        where = shard_of(hashes, len(self.shards))
        for s in np.unique(where):
            own = np.nonzero(where == s)[0]
            lo = shard_start(int(s), len(self.shards))
            at = self.shards[s][0].find(hashes[own] - np.uint64(lo))
            out[own] = np.where(at >= 0, at + self.first[s], -1)
        return out

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        where = np.searchsorted(self.first, numbers, "right") - 1
        for s in np.unique(where[numbers >= 0]):
            own = (where == s) & (numbers >= 0)
            out[own] = self.shards[s][1][numbers[own] - self.first[s]]
        return out


def shard_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The range of hashes, of n about equal ones."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def shard_start(s: int, n: int) -> int:
    return -(-(s << 32) // n) << 32


def read(words: Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many words each text has, and all words' numbers (-1: unknown) and counts in a row."""
    sizes, at, distinct = words_of(texts)
    numbers = words.numbers(digests(distinct))
    return sizes, numbers[at], words.counts(numbers)[at]


def with_ends(sizes: np.ndarray, values: np.ndarray, end) -> np.ndarray:
    """values with one more entry behind those of each text."""
    out = np.full(len(values) + len(sizes), end, values.dtype)
    own = np.ones(len(out), bool)
    own[np.cumsum(sizes + 1) - 1] = False
    out[own] = values
    return out


def contexts(tokens: np.ndarray, end: int) -> np.ndarray:
    """The token before each token; the end token before a text's first."""
    return np.concatenate([[end], tokens[:-1]]) if len(tokens) else tokens


def route(context: np.ndarray, token: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """The shard of a bigram: by its context, and for hot contexts also by its token."""
    part = np.where(np.isin(context, hot), 1 + token % SPREAD, 0).astype(np.uint64)
    x = context.astype(np.uint64) * np.uint64(SPREAD + 1) + part
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of golden-ratio hashing
    return ((x >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


class Pairs:
    """The bigram level."""

    def __init__(self, folder: str, n: int, hot: np.ndarray, hot_backoff: np.ndarray, vocabulary: int):
        self.hot, self.hot_backoff, self.vocabulary = hot, hot_backoff, vocabulary
        self.shards = []
        for s in range(n):
            raw = map_bytes(f"{folder}/pairs-{s:05d}")
            if not len(raw):
                self.shards.append(None)
                continue
            context, raw = EliasFano.opened(raw)
            pointer, raw = EliasFano.opened(raw)
            successor, raw = EliasFano.opened(raw)
            backoff = raw[: 2 * context.n].view(np.uint16)
            raw = raw[-(-2 * context.n // 8) * 8 :]
            self.shards.append((context, pointer, successor, backoff, raw[: 2 * successor.n].view(np.uint16)))

    def logs(self, context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 P(token | context) where the bigram is known, else NaN; log10 of the context's backoff weight, 0 if it has none; the bigram's place, -1 if it is unknown."""
        known, backoff, place = np.full(len(context), np.nan), np.zeros(len(context)), np.full(len(context), -1, np.int64)
        where = route(context, np.maximum(token, 0), self.hot, len(self.shards))
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(len(self.shards) + 1))
        for s, shard in enumerate(self.shards):
            own = order[cuts[s] : cuts[s + 1]]
            if shard is None or not len(own):
                continue
            contexts_, pointer, successor, weights, probabilities = shard
            distinct, back = _ranked(context[own])
            ranks = contexts_.find(distinct.astype(np.uint64))
            ends = pointer.get(np.concatenate([np.maximum(ranks, 0), np.maximum(ranks, 0) + 1])).astype(np.int64).reshape(2, -1)
            rank = ranks[back]
            has = rank >= 0
            own, rank, back = own[has], rank[has], back[has]
            backoff[own] = unquantise(weights[rank])
            has = token[own] >= 0
            own, rank, back = own[has], rank[has], back[has]
            if len(own):
                at = successor.find((rank * self.vocabulary + token[own]).astype(np.uint64), ends[0][back], ends[1][back])
                own, at = own[at >= 0], at[at >= 0]
                known[own], place[own] = unquantise(probabilities[at]), (s << PLACE) + at
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            is_hot = self.hot[at] == context
            backoff[is_hot] = self.hot_backoff[at[is_hot]]
        return known, backoff, place


class Triples:
    """The trigram level."""

    def __init__(self, folder: str, n: int, discount: float, vocabulary: int):
        self.discount, self.vocabulary = discount, vocabulary
        self.shards = []
        for s in range(n):
            raw = map_bytes(f"{folder}/triples-{s:05d}")
            if not len(raw):
                self.shards.append(None)
                continue
            pointer, raw = EliasFano.opened(raw)
            successor, raw = EliasFano.opened(raw)
            pairs, rest = EliasFano.opened(map_bytes(f"{folder}/counts-{s:05d}"))
            self.shards.append((pointer, successor, raw, rest[: 4 * pairs.n].view(np.uint32)))

    def parts(self, place: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the trigram itself adds to P(token | bigram at place), and the weight of the probability by the shorter context."""
        own_part, weight = np.zeros(len(place)), np.ones(len(place))
        where = place >> PLACE
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(len(self.shards) + 1))
        for s, shard in enumerate(self.shards):
            own = order[cuts[s] : cuts[s + 1]]
            if shard is None or not len(own):
                continue
            pointer, successor, counts, seen = shard
            rank = place[own] & ((1 << PLACE) - 1)
            distinct, back = _ranked(rank)
            lo, hi = pointer.get(np.concatenate([distinct, distinct + 1])).astype(np.int64).reshape(2, -1)[:, back]
            has = hi > lo
            own, rank, lo, hi = own[has], rank[has], lo[has], hi[has]
            total = seen[rank].astype(np.float64)
            weight[own] = self.discount * (hi - lo) / total
            known = token[own] >= 0
            own, rank, lo, hi, total = own[known], rank[known], lo[known], hi[known], total[known]
            if len(own):
                at = successor.find((rank * self.vocabulary + token[own]).astype(np.uint64), lo, hi)
                found = at >= 0
                own_part[own[found]] = (_at(counts, at[found]) - self.discount) / total[found]
        return own_part, weight


def count_words(batches, shards: int):
    """Blocks (shard, keys, counts) of the words of text batches, their hashes sorted."""
    keys, counts, fresh = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def merged():
        k, c = np.concatenate([keys, *(x[0] for x in fresh)]), np.concatenate([counts, *(x[1] for x in fresh)])
        fresh.clear()
        order = np.argsort(k)
        return _runs(k[order], c[order])

    def flush():
        where = shard_of(keys, shards)
        cuts = np.searchsorted(where, np.arange(shards + 1))
        blocks = [(s, *_block(keys[a:b], counts[a:b])) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
        return pa.RecordBatch.from_arrays([pa.array([b[0] for b in blocks], pa.int32()), pa.array([b[1] for b in blocks], pa.binary()), pa.array([b[2] for b in blocks], pa.binary())], ["shard", "keys", "counts"])

    for some in slices(batches, 0, SLICE):
        _, at, distinct = words_of(some.column(0))
        fresh.append((digests(distinct), np.bincount(at, minlength=len(distinct))))
        if sum(len(k) for k, _ in fresh) > HELD_WORDS:
            keys, counts = merged()
            if len(keys) > HELD_WORDS:
                yield flush()
                keys, counts = keys[:0], counts[:0]
    keys, counts = merged()
    if len(keys):
        yield flush()


def _some(function):
    """function for all rows of a partition, unless there are none."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        return function(held) if held else iter(())

    return run


def build(spark: SparkSession, docs: DataFrame, order: int = 2) -> dict:
    """The model of docs' training rows, of order two or three: where its files are and its few global numbers."""
    if order not in (2, 3):
        raise ValueError(f"order {order} is neither 2 nor 3")
    folder = shared_dir(spark)
    train = docs.where(~held_out(F.col("doc_id"))).select(F.coalesce("text", F.lit("")).alias("text"))
    size, texts = train.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    size, texts = size or 0, texts or 0
    word_shards, pair_shards = max(4, -(-size // WORD_SHARD)), max(4, -(-size // PAIR_SHARD))

    def word_file(batches):
        tab = pa.Table.from_batches(batches)
        s = tab["shard"][0].as_py()
        hashes, counts = _merged(tab)
        lo, hi = shard_start(s, word_shards), shard_start(s + 1, word_shards)
        coded = EliasFano.of(hashes - np.uint64(lo), hi - lo)
        write_bytes(f"{folder}/words-{s:05d}", *(p.tobytes() for p in coded.parts()), counts.tobytes())
        edge = max(1, int(counts.sum()) // (4 * pair_shards))
        frequent = np.nonzero(counts > edge)[0]
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(hashes)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([frequent.tolist()], pa.list_(pa.int64())), pa.array([counts[frequent].tolist()], pa.list_(pa.int64()))], ["shard", "n", "total", "at", "c"])

    counted = train.mapInArrow(lambda batches: count_words(batches, word_shards), "shard int, keys binary, counts binary")
    # one shard to a task; one row per shard comes back, with at most 4 * pair_shards words
    made = counted.repartitionById(word_shards, "shard").mapInArrow(_some(word_file), "shard int, n long, total long, at array<long>, c array<long>").collect()
    sizes, total = [0] * word_shards, texts
    for r in made:
        sizes[r["shard"]], total = r["n"], total + r["total"]
    for s in range(word_shards):
        if not sizes[s]:
            write_bytes(f"{folder}/words-{s:05d}", *(p.tobytes() for p in EliasFano.of(np.zeros(0, np.uint64), 1).parts()))
    first = np.concatenate([[0], np.cumsum(sizes)])
    end = int(first[-1])  # the end token's number, behind all words
    edge = max(1, total // (4 * pair_shards))
    hot = sorted([*(int(first[r["shard"]] + a) for r in made for a, c in zip(r["at"], r["c"], strict=True) if c > edge), *([end] if texts > edge else [])])
    model = {"folder": folder, "order": order, "sizes": sizes, "texts": texts, "total": total, "end": end, "vocabulary": end + (texts > 0), "pair_shards": pair_shards, "hot": hot, "hot_backoff": [0.0] * len(hot)}
    vocabulary = model["vocabulary"]
    hots = np.array(hot, np.int64)

    def count_pairs(batches):
        def flush():
            keys, after = np.concatenate(held), np.concatenate(nexts) if order > 2 else np.zeros(0, np.int64)
            held.clear()
            nexts.clear()
            if order > 2:
                keys, rank = _ranked(keys)
                counts = np.bincount(rank, minlength=len(keys))
                follows = after >= 0
                triples, triple_counts = np.unique(rank[follows] * vocabulary + after[follows], return_counts=True)
            else:
                keys, counts = np.unique(keys, return_counts=True)
                triples = triple_counts = after
            where = route(keys // vocabulary, keys % vocabulary, hots, pair_shards)
            by, above = np.argsort(where, kind="stable"), triples // vocabulary
            there = where[above]
            by3 = np.argsort(there, kind="stable")
            cuts, cuts3 = (np.searchsorted(x, np.arange(pair_shards + 1)) for x in (where[by], there[by3]))
            local = np.empty(len(keys), np.int64)
            for s in range(pair_shards):
                own, mine = by[cuts[s] : cuts[s + 1]], by3[cuts3[s] : cuts3[s + 1]]
                if not len(own):
                    continue
                local[own] = np.arange(len(own))
                k, c = _block(keys[own].astype(np.uint64), counts[own])
                n, m = _block((local[above[mine]] * vocabulary + triples[mine] % vocabulary).astype(np.uint64), triple_counts[mine]) if len(mine) else (b"", b"")
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([k]), pa.array([c]), pa.array([n]), pa.array([m])], ["shard", "keys", "counts", "next", "next_counts"])

        words, held, nexts = Words(folder, sizes), [], []
        for some in slices(batches, 0, SLICE):
            lengths, at, distinct = words_of(some.column(0))
            tokens = with_ends(lengths, words.numbers(digests(distinct))[at], end)
            held.append(contexts(tokens, end) * vocabulary + tokens)
            if order > 2:
                nexts.append(np.where(tokens != end, np.append(tokens[1:], -1), -1))  # nothing follows the end token
            if sum(map(len, held)) > HELD_PAIRS:
                yield from flush()
        if held:
            yield from flush()

    def pair_file(batches):
        tab = pa.Table.from_batches(batches)
        s = tab["shard"][0].as_py()
        keys, counts = _merged(tab)
        write_bytes(f"{folder}/counts-{s:05d}", *(p.tobytes() for p in EliasFano.of(keys, vocabulary * vocabulary).parts()), _fitting(counts).tobytes())
        context = (keys // np.uint64(vocabulary)).astype(np.int64)
        mine, n = np.unique(context[np.isin(context, hots)], return_counts=True)
        once, twice = int((counts == 1).sum()), int((counts == 2).sum())
        del context, counts
        triples, triple_counts = _triples(tab, keys, vocabulary) if order > 2 else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        if order > 2:
            ends = np.cumsum(np.bincount((triples // np.uint64(vocabulary)).astype(np.int64), minlength=len(keys)))
            write_bytes(
                f"{folder}/triples-{s:05d}",
                *(p.tobytes() for p in EliasFano.of(np.concatenate([[0], ends]), len(triples) + 1).parts()),
                *(p.tobytes() for p in EliasFano.of(triples, len(keys) * vocabulary).parts()),
                *_small(triple_counts),
            )
        once3, twice3 = int((triple_counts == 1).sum()), int((triple_counts == 2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([x], pa.int64()) for x in (once, twice, once3, twice3)), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (mine, n))], ["shard", "once", "twice", "once3", "twice3", "hot", "types"])

    counted = train.mapInArrow(count_pairs, "shard int, keys binary, counts binary, next binary, next_counts binary")
    pairs = counted.repartitionById(pair_shards, "shard").mapInArrow(_some(pair_file), "shard int, once long, twice long, once3 long, twice3 long, hot array<long>, types array<long>").collect()  # one row per shard
    model["discount"] = discount = _discount(sum(r["once"] for r in pairs), sum(r["twice"] for r in pairs))
    model["discount3"] = _discount(sum(r["once3"] for r in pairs), sum(r["twice3"] for r in pairs))
    types = dict.fromkeys(hot, 0)
    for r in pairs:
        for c, n in zip(r["hot"], r["types"], strict=True):
            types[c] += n

    def trie_file(batches):
        for batch in batches:
            for s in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([write_trie(s)], pa.int64())], ["shard", "n"])

    def write_trie(s: int) -> int:
        words = Words(folder, sizes)
        coded, rest = EliasFano.opened(map_bytes(f"{folder}/counts-{s:05d}"))
        keys, counts = coded.get(np.arange(coded.n)), rest[: 4 * coded.n].view(np.uint32).astype(np.float64)
        context, token = (keys // np.uint64(vocabulary)).astype(np.int64), (keys % np.uint64(vocabulary)).astype(np.int64)
        own, start, n = np.unique(context, return_index=True, return_counts=True)
        rank = np.repeat(np.arange(len(own)), n)
        seen = np.where(own == end, texts, words.counts(np.where(own == end, -1, own))).astype(np.float64)
        kinds = n.astype(np.float64)
        if len(hots):
            at = np.minimum(np.searchsorted(hots, own), len(hots) - 1)
            is_hot = hots[at] == own
            kinds[is_hot] = np.array([types[c] for c in hot], np.float64)[at[is_hot]]
        weight = discount * kinds / seen
        c = np.where(token == end, texts, words.counts(np.where(token == end, -1, token)))
        base = (c + 0.5) / (total + 0.5 * (vocabulary + 1))
        smoothed = np.maximum(counts - discount, 0) / seen[rank] + weight[rank] * base
        write_bytes(
            f"{folder}/pairs-{s:05d}",
            *(p.tobytes() for p in EliasFano.of(own, vocabulary).parts()),
            *(p.tobytes() for p in EliasFano.of(np.concatenate([start, [len(keys)]]), len(keys) + 1).parts()),
            *(p.tobytes() for p in EliasFano.of(rank * vocabulary + token, len(own) * vocabulary).parts()),
            _pad(quantise(np.log10(weight)).tobytes()),
            _pad(quantise(np.log10(smoothed)).tobytes()),
        )
        return len(keys)

    shards = [r["shard"] for r in pairs]
    if shards:
        spark.createDataFrame([(s,) for s in shards], "shard int").repartition(len(shards)).mapInArrow(trie_file, "shard int, n long").collect()
    for s in set(range(pair_shards)) - set(shards):
        write_bytes(f"{folder}/pairs-{s:05d}")
        write_bytes(f"{folder}/triples-{s:05d}")
    seen = {int(first[r["shard"]] + a): c for r in made for a, c in zip(r["at"], r["c"], strict=True)} | {end: texts}
    model["hot_backoff"] = [float(np.log10(discount * types[c] / seen[c])) for c in hot]
    return model


class Scorer:
    def __init__(self, model: dict):
        self.model = model
        self.words = Words(model["folder"], model["sizes"])
        self.pairs = Pairs(model["folder"], model["pair_shards"], np.array(model["hot"], np.int64), np.array(model["hot_backoff"]), max(1, model["vocabulary"]))
        self.triples = Triples(model["folder"], model["pair_shards"], model["discount3"], max(1, model["vocabulary"])) if model["order"] > 2 else None

    def score(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score and score of each text."""
        m = self.model
        lengths, numbers, counts = read(self.words, texts)
        trained = m["texts"] > 0
        tokens = with_ends(lengths, numbers, m["end"] if trained else -1)
        counts = with_ends(lengths, counts, m["texts"])
        base = np.log10((counts + 0.5) / (m["total"] + 0.5 * (m["vocabulary"] + 1)))
        context = contexts(tokens, m["end"] if trained else -1)
        logs = base.copy()
        used = np.nonzero(context >= 0)[0]
        if trained and len(used):
            width = m["vocabulary"] + 1
            pairs, back = _ranked(context[used] * width + tokens[used] + 1)
            known, backoff, places = self.pairs.logs(pairs // width, pairs % width - 1)
            logs[used] = np.where(np.isnan(known[back]), backoff[back] + base[used], known[back])
            if self.triples:
                place, pair = np.full(len(tokens), -1, np.int64), np.full(len(tokens), -1, np.int64)
                place[used], pair[used] = places[back], back
                third = 1 + np.nonzero((place[:-1] >= 0) & (tokens[:-1] != m["end"]))[0]
                triples, back = _ranked(pair[third - 1] * width + tokens[third] + 1)
                own, weight = self.triples.parts(places[triples // width], triples % width - 1)
                logs[third] = np.log10(own[back] + weight[back] * 10.0 ** logs[third])
        sizes = lengths + 1
        starts = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
        return sizes, add((counts > 0).astype(np.int64)), add(base), add(logs)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""

    def run(batches):
        scorer = Scorer(model)
        for some in slices(batches, 2, SLICE):
            n, known, base, logs = scorer.score(some.column(2))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(list(repeat(model["total"], len(n))), pa.int64()), pa.array(base, pa.float64()), pa.array(logs, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, build(spark, docs, order=3))
