"""Fuzzy repeated passages by collinear chaining of shared seeds (operator 6).

Equal texts come first: all but the one of the smallest id are passages as a
whole. Of the rest, seeds are windows of five words (lower-cased A-Z), of which every run of
WINDOW neighbours keeps the one with the least hash: passages that agree on
WINDOW + 4 words in a row share a seed. A seed that a document has again is
matched with its occurrence before in that document; the first one of each
document is joined with the first document that has it (smallest id), so a
seed of many documents gives as many matches as documents, not pairs.

What the passages found so leave uncovered (EDGE words at their ends included) is
followed further: to the first document in which the seed is uncovered too, and by
longer keys where seeds are frequent: every stretch of MIN_WORDS words
that fewer than two rarer seeds lead into is matched with its first occurrence, so
no exact repeat of MIN_WORDS words is lost to frequent phrases; and pairs of seeds up
to LAGS seeds apart, with whatever stands between, are joined with their first two
documents, which finds edited passages made of frequent phrases. The matches of a document with one
earlier document are chained: ordered in both texts, with a cost for gaps, best
predecessors found through a Fenwick tree over the places in the earlier text.
Chains are then aligned word by word on the texts themselves; aligned stretches of at
least MIN_WORDS words whose five-word shingles agree to 0.8 or more are
passages. Their later copy is the repeat.

Defined cases: null counts as empty; texts without five words have no seeds; a
passage may repeat inside one document (its copies may overlap, but no word is its own copy); rows with a null id come after all
others, rows of one id with different texts are ordered by the texts' checksum, and equal rows of
one id are one document; an empty table gives no passages; extra columns pass
through ``remove_passages`` and are not read elsewhere. Texts are read whole.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdetect.llm.common import IS_SPACE, LOWER, RangeHash, Words, as_long, lean, mix, ngram_hashes, slices, stored, stream, text_buffer, text_slices
from flowdetect.llm.suffix_dedup import LAST, cut_ranges
from flowdetect.session import remove_path

SHINGLE = 5
WINDOW = 10
MIN_WORDS = 50
SIMILARITY = 0.8
#: Chain score: one per seed, less this for every word of gap in either text; neighbouring seeds, at most WINDOW words apart, always chain.
WORD_COST = 0.02
#: Seeds in a chain at least. A passage of MIN_WORDS words that agrees to SIMILARITY has a run of 24 equal words (one edit in its middle);
#: these hold two windows of WINDOW seeds without a common one, so two seeds.
MIN_SEEDS = 2
#: Occurrences of a seed that its matches with two documents cover whole.
FEW = 3
#: Pairs of seeds up to so many repeated seeds apart are keys too.
LAGS = 8
#: So many seeds that begin MIN_WORDS - SHINGLE + 1 words or more after a seed make keys with it: no phrase below MIN_WORDS words holds these.
FAR = 2
#: Words at a found passage's ends whose seeds are followed further.
EDGE = 20
#: Words around a chain that alignment may use: a stretch of MIN_WORDS around its seeds whole.
MARGIN = MIN_WORDS
#: Largest number of words skipped in one text to go on with the alignment.
MAX_SKIP = 30
#: Equal words that end a skip.
RESYNC = 3
#: Alignment stops when its score falls this far below its best.
DROP = 40

#: Of a shingle's words, in a sum that no other shingle has but by chance.
GRAM_FACTOR = stream(101 + SHINGLE, SHINGLE) | np.uint64(1)

SEEDS = "hash long, id long, spot long, before long"
KEYS = "hash long, id long, spot long, other long, pair boolean"


def seeds(data: np.ndarray, offsets: np.ndarray, roll: RangeHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, hash) of the seeds of some texts."""
    words = Words(LOWER[data], offsets, roll)
    key, at = ngram_hashes(words.hash, words.doc, SHINGLE)
    n = len(key)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), key
    doc = words.doc[at]
    low = (key & ~np.uint64(0xFFFFFFF)) | np.arange(n, dtype=np.uint64)
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    count = np.diff(np.append(begin, n))
    chosen = [np.minimum.reduceat(low, begin)[count < WINDOW]]
    if n >= WINDOW:
        least, have = low, 1
        while 2 * have <= WINDOW:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        rest = WINDOW - have
        least = np.minimum(least[: len(least) - rest], least[rest:])
        chosen.append(least[doc[: len(least)] == doc[WINDOW - 1 :]])
    place = np.unique((np.concatenate(chosen) & np.uint64(0xFFFFFFF)).astype(np.int64))
    return doc[place], at[place] - words.first[doc[place]], key[place]


def seed_rows(texts: DataFrame) -> DataFrame:
    """(hash, id, spot, before): spot holds the text's checksum and the word where the seed begins, before the text's spot of the same seed before."""

    def run(batches):
        roll = RangeHash()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, data, offsets in text_slices(batch.column(1)):
                doc, word, key = seeds(data, offsets, roll)
                tags = np.array([zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], dtype=np.uint32)
                spot = as_long(tags[doc].astype(np.uint64) << np.uint64(32) | word.astype(np.uint64))
                order = np.lexsort((word, key, doc))
                before, first = np.zeros(len(doc), dtype=np.int64), np.ones(len(doc), dtype=bool)
                same = (doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1])
                before[order[1:][same]] = spot[order[:-1][same]]
                first[order[1:][same]] = False
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(key)), pa.array(ids[row + doc]), pa.array(spot), pa.array(before, mask=first)], ["hash", "id", "spot", "before"]
                )

    return texts.select("id", "text").mapInArrow(lean(run), SEEDS)


def long_keys(words: Words, frequent: np.ndarray, rare: np.ndarray) -> tuple[tuple, tuple]:
    """Keys around frequent seeds (hash, word, other word): of stretches of MIN_WORDS words, and of pairs of seeds. ``frequent``, ``rare``: words where
    repeated seeds begin, ascending."""
    n, grams = len(words.hash), MIN_WORDS - SHINGLE + 1
    key, at = ngram_hashes(words.hash, words.doc, SHINGLE)
    frequent, rare = (p[np.isin(p, at)] for p in (frequent, rare))  # else of another text with the same id and checksum
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    known = np.sort(np.concatenate([frequent, rare]))
    if len(known) < 2:
        return none, none
    seed = key[np.searchsorted(at, known)]
    stretches = none
    if n >= MIN_WORDS:
        count = lambda at: np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))])
        all_, few = count(known), count(rare)
        # a window of seeds without a repeated one has one that stands nowhere else
        alone = np.concatenate([[0], np.cumsum(all_[WINDOW:] == all_[:-WINDOW])])
        start = np.arange(n - MIN_WORDS + 1)
        good = (few[start + grams] - few[start] < MIN_SEEDS) & (alone[start + grams - WINDOW + 1] == alone[start])
        if good.any():
            key, at = ngram_hashes(words.hash, words.doc, MIN_WORDS)
            key, at = key[good[at]], at[good[at]]
            stretches = key, at, at + 1
    often = np.isin(known, frequent)
    doc = words.doc[known]
    keys, ones, others = [], [], []
    here = np.arange(len(known))
    far = np.searchsorted(known, known + grams)
    for to in [*(np.minimum(here + lag, far) for lag in range(1, LAGS + 1)), *(far + k for k in range(FAR))]:
        use = np.flatnonzero(to < len(known))
        use = use[(doc[to[use]] == doc[use]) & (often[to[use]] | often[use])]
        keys.append(mix(mix(seed[use]) + seed[to[use]]))
        ones.append(known[use])
        others.append(known[to[use]])
    key, one, other = np.concatenate(keys), np.concatenate(ones), np.concatenate(others)
    order = np.lexsort((other, one, key, words.doc[one]))
    key, one, other = key[order], one[order], other[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = (key[1:] != key[:-1]) | (words.doc[one[1:]] != words.doc[one[:-1]])
    return stretches, (key[first], one[first], other[first])


def key_rows(repeats: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of KEYS of the documents with frequent seeds. ``repeats``: id, spot, often of all seeds that stand more than once."""
    place = F.col("spot").bitwiseAND(F.lit(0xFFFFFFFF))
    lists = (
        repeats.groupBy("id", F.shiftrightunsigned("spot", 32).alias("tag"))
        .agg(F.collect_list(F.when(F.col("often"), place)).alias("frequent"), F.collect_list(F.when(~F.col("often"), place)).alias("rare"))
        .where("size(frequent) > 0 and size(frequent) + size(rare) > 1")
    )

    def flat(column, row, n, first):
        """Word places of a run of texts from their lists."""
        part = column.slice(row, n)
        doc = np.repeat(np.arange(n), np.diff(part.offsets.to_numpy()))
        return np.unique(part.flatten().to_numpy() + first[doc])

    def run(batches):
        roll = RangeHash()
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for row, data, offsets in text_slices(batch.column(4)):
                words = Words(LOWER[data], offsets, roll)
                n = len(offsets) - 1
                found = long_keys(words, *(flat(batch.column(k), row, n, words.first) for k in (2, 3)))
                for pair, (key, *places) in enumerate(found):
                    for lo in range(0, len(key), 100_000):
                        one, other = (p[lo : lo + 100_000] for p in places)
                        doc = words.doc[one]
                        spots = [as_long(tags[row + doc] << np.uint64(32) | (p - words.first[doc]).astype(np.uint64)) for p in (one, other)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(as_long(key[lo : lo + 100_000])), pa.array(ids[row + doc]), *map(pa.array, spots), pa.array(np.full(len(one), bool(pair)))],
                            [f.split()[0] for f in KEYS.split(", ")],
                        )

    return lists.join(texts, ["id", "tag"]).select("id", "tag", "frequent", "rare", "text").mapInArrow(lean(run), KEYS)


def heads_of(rows: DataFrame, *places: str) -> DataFrame:
    """hash, sid and the first row's ``places`` (s before each name) of keys that stand more than once."""
    return (
        rows.groupBy("hash").agg(F.min(F.struct("id", *places)).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("hash", F.col("head.id").alias("sid"), *(F.col(f"head.{c}").alias(f"s{c}") for c in places))
    )


def drop(df: DataFrame, paths: list[str]) -> None:
    for path in paths:
        remove_path(df.sparkSession, path)
    paths.clear()


def key_matches(keys: DataFrame, paths: list[str]) -> DataFrame:
    """``keys``: a written table, the last of ``paths``; it goes. id, spot, sid, sspot of what long keys share. Each gives the word after too, so that one key is a chain."""
    used = [paths.pop()]  # of the keys
    first = stored(heads_of(keys, "spot", "other"), "first-keys", release=True, paths=used)
    shared = stored(keys.join(first.hint("shuffle_hash"), "hash").where("id <> sid or spot <> sspot"), "shared-keys", release=True, paths=paths)
    drop(keys, used)
    columns = ["hash", "id", "spot", "other"]
    pairs = shared.where("pair").select(*columns)
    second = stored(heads_of(pairs, "spot", "other"), "second-keys", paths=paths)
    later = pairs.join(second, "hash").where("id <> sid or spot <> sspot")
    both = shared.select("id", "sid", "spot", "other", "sspot", "sother").union(later.select("id", "sid", "spot", "other", "sspot", "sother"))
    one = lambda a, b: F.struct(a.alias("spot"), b.alias("sspot"))
    spots = F.array_distinct(F.array(one(F.col("spot"), F.col("sspot")), one(F.col("spot") + 1, F.col("sspot") + 1), one(F.col("other"), F.col("sother"))))
    return both.select("id", "sid", F.explode(spots).alias("at")).select("id", "at.spot", "sid", "at.sspot")


class PrefixMax:
    """Fenwick tree: largest value at places below a bound, with where it came from."""

    def __init__(self, n: int):
        self.value = [-1e18] * (n + 1)
        self.item = [-1] * (n + 1)

    def put(self, place: int, value: float, item: int) -> None:
        place += 1
        while place < len(self.value):
            if value > self.value[place]:
                self.value[place], self.item[place] = value, item
            place += place & -place

    def best(self, bound: int) -> tuple[float, int]:
        """Over places below ``bound``."""
        value, item = -1e18, -1
        while bound > 0:
            if self.value[bound] > value:
                value, item = self.value[bound], self.item[bound]
            bound -= bound & -bound
        return value, item


def chains(x: np.ndarray, y: np.ndarray, cost: float = 0.003) -> list[np.ndarray]:
    """Seeds (indices) of each chain; ``x`` ascending, ``cost`` for each unit of gap. Chains do not share seeds."""
    # seeds that follow each other on one diagonal are one link of the chain
    new = np.ones(len(x), dtype=bool)
    new[1:] = (np.diff(x) != np.diff(y)) | (np.diff(x) * 2 * cost > 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(x)) - 1
    if len(begin) == 1:
        return [np.arange(len(x))]
    x0, x1, y0, y1 = x[begin].tolist(), x[end].tolist(), y[begin].tolist(), y[end].tolist()
    weight = (end - begin + 1).tolist()
    places = np.unique(y[end])
    put_at = np.searchsorted(places, y[end]).tolist()
    ask_below = np.searchsorted(places, y[begin]).tolist()
    tree = PrefixMax(len(places))
    by_end = np.argsort(x[end], kind="stable").tolist()
    ready = 0
    score, parent = [0.0] * len(begin), [-1] * len(begin)
    for i in range(len(begin)):
        while ready < len(by_end) and x1[by_end[ready]] < x0[i] and by_end[ready] < i:
            j = by_end[ready]
            tree.put(put_at[j], score[j] + cost * (x1[j] + y1[j]), j)
            ready += 1
        value, j = tree.best(ask_below[i])
        score[i] = weight[i]
        gain = value - cost * (x0[i] + y0[i])
        if j >= 0 and gain > 0:
            score[i], parent[i] = weight[i] + gain, j
    used = [False] * len(begin)
    out = []
    for i in sorted(range(len(begin)), key=lambda i: -score[i]):
        links = []
        while i >= 0 and not used[i]:
            used[i] = True
            links.append(i)
            i = parent[i]
        if links:
            out.append(np.concatenate([np.arange(begin[k], end[k] + 1) for k in reversed(links)]))
    return out


CHAINS = "id long, tag long, x0 long, x1 long, sid long, stag long, y0 long, y1 long, xs array<long>, ys array<long>"


def chained(matches: DataFrame) -> DataFrame:
    """Chains of each document with each earlier document. ``matches``: id, spot, sid, sspot."""

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            if not table.num_rows:
                continue
            columns = [table.column(k).to_numpy() for k in range(5)]
            last = np.flatnonzero(columns[0] != columns[0][-1])
            cut = int(last[-1]) + 1 if len(last) else 0  # the last pair may go on in the next batch
            if cut:
                yield from emit(*(c[:cut] for c in columns[1:]))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield from emit(*(held.column(k).to_numpy() for k in range(1, 5)))

    def emit(who, spot, source, source_spot):
        tag, x = spot.view(np.uint64) >> np.uint64(32), (spot & 0xFFFFFFFF)
        stag, y = source_spot.view(np.uint64) >> np.uint64(32), (source_spot & 0xFFFFFFFF)
        order = np.lexsort((y, x, stag, source, tag, who))
        who, tag, x, source, stag, y = (c[order] for c in (who, tag, x, source, stag, y))
        new = np.ones(len(x), dtype=bool)
        same = (who[1:] == who[:-1]) & (tag[1:] == tag[:-1]) & (source[1:] == source[:-1]) & (stag[1:] == stag[:-1])
        again = np.concatenate([[False], same & (x[1:] == x[:-1]) & (y[1:] == y[:-1])])  # repeated rows
        new[1:] = ~same
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(x))
        rows = []
        for a, b in zip(begin.tolist(), end.tolist()):
            if b - a < MIN_SEEDS:
                continue
            own = np.arange(a, b)[~again[a:b]]
            for chain in chains(x[own], y[own], WORD_COST) if len(own) >= MIN_SEEDS else ():
                if len(chain) >= MIN_SEEDS:
                    at = own[chain]
                    rows.append((who[a], int(tag[a]), x[at[0]], x[at[-1]], source[a], int(stag[a]), y[at[0]], y[at[-1]], x[at], y[at]))
        for k in range(0, len(rows), 5_000):
            part = list(zip(*rows[k : k + 5_000]))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([int(v) for v in c], pa.int64()) for c in part[:8]), *(pa.array(c, pa.list_(pa.int64())) for c in part[8:])],
                [f.split()[0] for f in CHAINS.split(", ")],
            )

    # rows of one document and one source meet; a document with many sources, and rows without an id, spread
    pair = F.xxhash64("id", F.shiftrightunsigned("spot", 32), "sid", F.shiftrightunsigned("sspot", 32)).alias("pair")
    rows = matches.select(pair, "id", "spot", "sid", "sspot").repartition("pair").sortWithinPartitions("pair")
    return rows.mapInArrow(lean(run), CHAINS)


def spans(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """Bytes around each wanted range of words (id, tag, s, e), from word ``first`` at byte ``lo`` on: MARGIN words more on both sides, as far as the text
    goes. A range of repeated rows may come more than once."""
    lists = wanted.groupBy("id", "tag").agg(F.collect_set(F.struct("s", "e")).alias("ranges"))
    lists = lists.select("id", "tag", F.col("ranges.s").alias("starts"), F.col("ranges.e").alias("ends"))

    def run(batches):
        roll = RangeHash()
        last = None
        for batch in batches:
            # repeated rows come one after the other where the join sorts
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            batch = batch.filter(pa.array([key != before for key, before in zip(keys, [last, *keys])], pa.bool_()))
            last = keys[-1] if keys else last
            if not batch.num_rows:
                continue
            texts_of = batch.column(4)
            starts, ends = (batch.column(k).to_pylist() for k in (2, 3))
            for row, data, offsets in text_slices(texts_of):
                words = Words(data, offsets, roll)
                out = [[], [], [], [], [], [], []]
                for d in range(len(offsets) - 1):
                    text = data[offsets[d] : offsets[d + 1]]
                    own = slice(words.first[d], words.first[d + 1])
                    begin, end = words.start[own] - offsets[d], words.end[own] - offsets[d]
                    for s, e in zip(starts[row + d], ends[row + d]):
                        if e >= len(begin):  # of another text with the same id and checksum
                            continue
                        a = max(0, s - MARGIN)
                        b = min(len(begin) - 1, e + SHINGLE + MARGIN)
                        lo = int(begin[a])
                        for values, value in zip(out, (batch.column(0)[row + d].as_py(), batch.column(1)[row + d].as_py(), s, e, a, lo, text[lo : int(end[b])].tobytes())):
                            values.append(value)
                for k in range(0, len(out[0]), 2_000):
                    part = [c[k : k + 2_000] for c in out]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c, pa.int64()) for c in part[:6]), pa.array(part[6], pa.binary())], ["id", "tag", "s", "e", "first", "lo", "bytes"]
                    )

    joined = lists.join(texts, ["id", "tag"]).select("id", "tag", "starts", "ends", "text")
    return joined.mapInArrow(lean(run), "id long, tag long, s long, e long, first long, lo long, bytes binary")


def _equal_run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    at, size = 0, 64
    while at < n:
        end = min(n, at + size)
        differ = a[at:end] != b[at:end]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, size = end, 4 * size
    return n


def _skip(a: np.ndarray, b: np.ndarray) -> tuple[int, int] | None:
    """Words to skip in each so that RESYNC equal words follow: the fewest in all, or none."""
    a, b = a[: MAX_SKIP + RESYNC], b[: MAX_SKIP + RESYNC]
    if len(a) < RESYNC or len(b) < RESYNC:
        return None
    # the most frequent cases first, in the order of the words skipped: a word more in one text, a word replaced
    x, y = a[: RESYNC + 1].tolist(), b[: RESYNC + 2].tolist()
    if y[1 : RESYNC + 1] == x[:RESYNC]:
        return 0, 1
    if x[1:] == y[:RESYNC]:
        return 1, 0
    if y[2:] == x[:RESYNC]:
        return 0, 2
    if len(x) > RESYNC and x[1:] == y[1 : RESYNC + 1]:
        return 1, 1
    equal = a[:, None] == b[None, :]
    n, m = len(a) - RESYNC + 1, len(b) - RESYNC + 1
    good = equal[:n, :m] & equal[1 : n + 1, 1 : m + 1]
    for k in range(2, RESYNC):
        good &= equal[k : k + n, k : k + m]
    at = np.flatnonzero(good)
    if not len(at):
        return None
    i, j = np.divmod(at, m)
    best = int((i + j).argmin())
    return int(i[best]), int(j[best])


def extend(a: np.ndarray, b: np.ndarray, gap: float = np.inf, sign: int = 1) -> tuple[int, int, list[tuple[int, int, int]]]:
    """Align the beginnings of two word lists: (words used in a, in b, exact runs as (place in a, in b, length)). ``b`` (``a`` where
    ``sign`` is -1) gets less than ``gap`` words ahead."""
    i = j = 0
    score = best = 0
    best_at = (0, 0, 0)
    runs: list[tuple[int, int, int]] = []
    while True:
        n = _equal_run(a[i:], b[j:])
        if n:
            runs.append((i, j, n))
            i, j, score = i + n, j + n, score + n
            if score > best:
                best, best_at = score, (i, j, len(runs))
        jump = _skip(a[i:], b[j:]) if i < len(a) and j < len(b) else None
        if jump is None:
            break
        i, j = i + jump[0], j + jump[1]
        score -= 4 + max(jump)
        if score < best - DROP or sign * (j - i) >= gap:
            break
    return best_at[0], best_at[1], runs[: best_at[2]]


def _shingles(words: np.ndarray) -> set[int]:
    size = max(0, len(words) - SHINGLE + 1)
    return set(sum(words[k : k + size] * GRAM_FACTOR[k] for k in range(SHINGLE)).tolist())


def _similarity(a: np.ndarray, b: np.ndarray) -> float:
    if np.array_equal(a, b):
        return 1.0 if len(a) >= SHINGLE else 0.0
    sa, sb = _shingles(a), _shingles(b)
    both = len(sa & sb)
    return both / max(1, len(sa) + len(sb) - both)


def alike(a: np.ndarray, b: np.ndarray, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, float]]:
    """Of an alignment's exact ``runs`` (place in a, in b, length), all stretches from one run's begin to another's end that are passages and not part of a longer one."""
    x, y, n = np.array(sorted(runs)).T
    shared = np.concatenate([[0], np.cumsum(np.maximum(0, n - SHINGLE + 1))])
    # (1 + SIMILARITY) * shared shingles - SIMILARITY * all shingles of both, as a difference of what lies before two places
    before = (1 + SIMILARITY) * shared[:-1] - SIMILARITY * (x + y)
    upto = (1 + SIMILARITY) * shared[1:] - SIMILARITY * (x + y + 2 * n) + 2 * SIMILARITY * (SHINGLE - 1)
    out = []
    reached = -1
    most = np.maximum.accumulate(upto[::-1])[::-1].tolist()  # from each run on
    need = before.tolist()
    xs, ys, x_ends, y_ends = x.tolist(), y.tolist(), (x + n).tolist(), (y + n).tolist()
    for s in range(len(xs)):
        lo = max(s, reached + 1, bisect_left(x_ends, xs[s] + MIN_WORDS), bisect_left(y_ends, ys[s] + MIN_WORDS))
        if lo >= len(xs):  # nor does a later one go on for so many words
            break
        if most[lo] - need[s] < -1e-6:
            continue
        for e in (lo + np.flatnonzero(upto[lo:] - need[s] >= -1e-6))[::-1].tolist():
            stretch = xs[s], x_ends[e], ys[s], y_ends[e]
            similarity = _similarity(a[stretch[0] : stretch[1]], b[stretch[2] : stretch[3]])  # repeated shingles count once
            if similarity >= SIMILARITY:
                out.append((*stretch, similarity))
                reached = e
                break
    return out


def aligned(a: np.ndarray, b: np.ndarray, seeds_at: list[tuple[int, int]], shift: int | None = None) -> list[tuple[int, int, int, int, float]]:
    """Passages (first and end word in a, in b, similarity) along a chain of seeds given as word places. Where both are parts of one text, ``a`` begins
    ``shift`` words after ``b``: there, every word is aligned with an earlier one, never with itself."""
    out = []
    used_a = used_b = 0
    for i, j in seeds_at:
        if i < used_a or j < used_b:
            continue
        gap = np.inf if shift is None else i + shift - j
        right_a, right_b, right = extend(a[i:], b[j:], gap)
        left_a, left_b, left = extend(a[used_a:i][::-1], b[used_b:j][::-1], gap, -1)
        a0, a1, b0, b1 = i - left_a, i + right_a, j - left_b, j + right_b
        if right_a:
            used_a, used_b = a1, b1
        if min(a1 - a0, b1 - b0) < MIN_WORDS:
            continue
        similarity = _similarity(a[a0:a1], b[b0:b1])
        if similarity >= SIMILARITY:
            out.append((a0, a1, b0, b1, similarity))
            continue
        # not alike as a whole: parts of it may be
        first_left, first_right = (left[0] if left else None), (right[0] if right else None)
        exact = [(i - x - n, j - y - n, n) for x, y, n in left[1:]] + [(i + x, j + y, n) for x, y, n in right[1:]]
        back = first_left[2] if first_left and first_left[:2] == (0, 0) else 0
        if first_left and not back:
            exact.append((i - first_left[0] - first_left[2], j - first_left[1] - first_left[2], first_left[2]))
        if first_right:
            exact.append((i - back, j - back, back + first_right[2]))
        out += alike(a, b, exact) if exact else []
    return out


PASSAGES = (
    "id long, tag long, start long, end long, n_words long, source_id long, source_start long, source_end long, similarity double, word long"
)


def align_chains(pairs: DataFrame) -> DataFrame:
    """Passages of chains with the bytes around them on both sides (abytes from word afirst and byte alo, bbytes likewise)."""

    def run(batches):
        roll = RangeHash()
        for batch in batches:
            sizes = sum(np.diff(text_buffer(batch.column(batch.schema.get_field_index(c)))[1]) for c in ("abytes", "bbytes"))
            for lo, hi in slices(np.concatenate([[0], np.cumsum(sizes)])):
                yield from part(batch.slice(lo, hi - lo), roll)

    def part(batch, roll):
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        n = batch.num_rows
        sides = []
        for name, places, first, lo in (("abytes", "xs", "afirst", "alo"), ("bbytes", "ys", "bfirst", "blo")):
            data, offsets = text_buffer(column[name])
            words = Words(LOWER[data], offsets, roll)
            upto = column[places].offsets.to_numpy()
            at = column[places].flatten().to_numpy() - np.repeat(column[first].to_numpy(), np.diff(upto))
            shift = column[lo].to_numpy() - offsets[:-1]  # of a byte's place: in the text, less in the buffer
            sides.append((words, words.first.tolist(), at.tolist(), (upto - upto[0]).tolist(), shift.tolist()))
        plain = {c: column[c].to_pylist() for c in ("id", "tag", "sid", "stag", "afirst", "bfirst")}
        (a, a_first, a_at, a_upto, a_shift), (b, b_first, b_at, b_upto, b_shift) = sides
        rows = []
        for r in range(n):
            f, g = a_first[r], b_first[r]
            seeds_at = list(zip(a_at[a_upto[r] : a_upto[r + 1]], b_at[b_upto[r] : b_upto[r + 1]]))
            same = (plain["id"][r], plain["tag"][r]) == (plain["sid"][r], plain["stag"][r])
            shift = plain["afirst"][r] - plain["bfirst"][r] if same else None
            for a0, a1, b0, b1, similarity in aligned(a.hash[f : a_first[r + 1]], b.hash[g : b_first[r + 1]], seeds_at, shift):
                rows.append((plain["id"][r], plain["tag"][r], int(a.start[f + a0]) + a_shift[r], int(a.end[f + a1 - 1]) + a_shift[r], a1 - a0, plain["sid"][r],
                             int(b.start[g + b0]) + b_shift[r], int(b.end[g + b1 - 1]) + b_shift[r], similarity, int(a0) + plain["afirst"][r]))
        columns = list(zip(*rows)) if rows else [()] * 10
        kinds = [pa.int64()] * 8 + [pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [f.split()[0] for f in PASSAGES.split(", ")])

    return pairs.mapInArrow(lean(run), PASSAGES)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.withColumn("tag", F.crc32("text"))


def _aligned_matches(matches: DataFrame, texts: DataFrame, name: str, paths: list[str]) -> DataFrame:
    """Rows of PASSAGES of ``matches`` (a written table, the last of ``paths``; what ``paths`` lists goes)."""
    found = stored(chained(matches), f"{name}-chains", release=True)
    drop(texts, paths)
    one = found.select("id", "tag", F.col("x0").alias("s"), F.col("x1").alias("e"))
    other = found.select(F.col("sid").alias("id"), F.col("stag").alias("tag"), F.col("y0").alias("s"), F.col("y1").alias("e"))
    cuts = stored(spans(one.union(other), texts), f"{name}-spans", release=True, paths=paths)
    a = cuts.toDF("id", "tag", "x0", "x1", "afirst", "alo", "abytes")
    b = cuts.toDF("sid", "stag", "y0", "y1", "bfirst", "blo", "bbytes")
    out = stored(align_chains(found.join(a, ["id", "tag", "x0", "x1"]).join(b, ["sid", "stag", "y0", "y1"])).distinct(), f"{name}-passages", release=True)
    drop(texts, paths)
    return out


def outside(repeats: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``repeats`` (id, spot) whose seed does not lie inside a found passage, EDGE words from its ends."""
    inside = found.where(F.col("n_words") > 2 * EDGE + SHINGLE).select(
        "id", "tag", F.struct((F.col("word") + EDGE).alias("a"), (F.col("word") + F.col("n_words") - EDGE - SHINGLE).alias("b")).alias("range")
    )
    lists = inside.distinct().groupBy("id", "tag").agg(F.collect_list("range").alias("ranges"))
    place = F.col("spot").bitwiseAND(F.lit(0xFFFFFFFF))
    covered = F.exists("ranges", lambda r: (place >= r["a"]) & (place <= r["b"]))
    rows = repeats.withColumn("tag", F.shiftrightunsigned("spot", 32)).join(lists.hint("merge"), ["id", "tag"], "left")
    return rows.where(~F.coalesce(covered, F.lit(False))).drop("tag", "ranges")


def equal_texts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts with each text once, under its smallest id; rows of PASSAGES of the others: their whole text)."""
    keyed = texts.withColumn("digest", F.sha2("text", 256))
    facts = stored(keyed.select("id", "digest"), "text-digests")
    heads = facts.groupBy("digest").agg(F.min("id").alias("source_id"), F.max("id").alias("last_id")).where("source_id < last_id")
    copies = stored(facts.join(heads.select("digest", "source_id"), "digest").where("id <> source_id").distinct(), "copies", release=True)
    # copies grow with the rows: never broadcast
    marked = stored(keyed.join(copies.hint("shuffle_hash"), ["id", "digest"], "left"), "marked-texts", release=True)
    blank = " \t\n\x0b\x0c\r"
    size = lambda c: F.octet_length(c).cast("long")
    start = (size("text") - size(F.ltrim(F.col("text"), F.lit(blank)))).alias("start")
    end = size(F.rtrim(F.col("text"), F.lit(blank))).alias("end")
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words")
    again = marked.where("source_id is not null").select("id", "digest", "tag", start, end, n_words, "source_id").dropDuplicates(["id", "digest"])
    passages = again.where(F.col("n_words") >= MIN_WORDS).select(
        "id", "tag", "start", "end", "n_words", "source_id", F.col("start").alias("source_start"), F.col("end").alias("source_end"),
        F.lit(1.0).alias("similarity"), F.lit(0).cast("long").alias("word"),
    )
    return marked.where("source_id is null").select("id", "text", "tag"), passages


def find_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of PASSAGES: each repeated passage with where its earlier copy stands (bytes).

    Equal texts first: all but one are passages as a whole. Of the others, every
    repeated seed is followed to its first document; what the passages
    found there leave uncovered goes on to the second document and to the longer keys.
    """
    texts, whole = equal_texts(_texts(docs, id_col, text_col))
    paths: list[str] = []
    used: list[str] = []
    seeded = stored(seed_rows(texts), "seeds", paths=used)
    first = stored(
        seeded.groupBy("hash")
        .agg(F.min(F.when(F.col("before").isNull(), F.struct("id", "spot"))).alias("head"), F.count(F.lit(1)).alias("n"), F.count("before").alias("again"))
        .where("n > 1")
        .select("hash", F.col("head.id").alias("sid"), F.col("head.spot").alias("sspot"), ((F.col("n") > FEW) | (F.col("again") > 0)).alias("often")),
        "first-seeds",
        release=True,
        paths=used,
    )
    repeats_at: list[str] = []
    repeats = stored(seeded.join(first.hint("shuffle_hash"), "hash"), "repeated-seeds", release=True, paths=repeats_at)
    drop(docs, used)
    columns = ["id", "spot", "sid", "sspot"]
    within = repeats.where("before is not null").select("id", "spot", F.col("id").alias("sid"), F.col("before").alias("sspot"))
    shared = repeats.where("before is null and (id <> sid or spot <> sspot)")
    near = _aligned_matches(stored(shared.select(*columns).union(within), "matches", release=True, paths=used), texts, "first", used)

    left = stored(outside(repeats, near), "seeds-left", release=True, paths=paths)
    drop(docs, repeats_at)
    open_ = left.where("before is null and (id <> sid or spot <> sspot)")
    # the second document: a passage may begin there that holds a stretch of the first
    second = stored(heads_of(open_.select("hash", "id", "spot"), "spot"), "second-seeds", paths=paths)
    later = open_.select("hash", "id", "spot").join(second, "hash").where("id <> sid or spot <> sspot").select(*columns)
    keys = stored(key_rows(left.select("id", "spot", "often"), texts), "keys", release=True, paths=paths)
    matches = stored(later.union(key_matches(keys, paths)), "more-matches", release=True, paths=used)
    drop(docs, paths)
    return whole.union(near).union(_aligned_matches(matches, texts, "second", used)).select(*[f.split()[0] for f in PASSAGES.split(", ")])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, n_words, source_doc_id, source_start, source_end, similarity of each repeat (byte offsets)."""
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return find_passages(docs, id_col, text_col).select(
        known("id").alias("doc_id"), "start", "end", "n_words", known("source_id").alias("source_doc_id"), "source_start", "source_end", "similarity"
    )


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without their repeats; ``size_col`` (if present) is counted anew. A row left without a word goes."""
    found = stored(find_passages(docs, id_col, text_col), "passages", release=True)
    lists = found.groupBy("id", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    columns = docs.columns
    at, size_at = columns.index(text_col), columns.index(size_col) if size_col in columns else None
    keyed = docs.select(
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)),
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("id"),
        F.crc32(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("tag"),
    )
    plain = [f"c{i}" for i in range(len(columns))]
    joined = keyed.join(lists, ["id", "tag"], "left").select(*plain, "starts", "ends")

    def run(batches):
        for batch in batches:
            arrays = [batch.column(i) for i in range(len(plain))]
            touched = batch.column(len(plain)).is_valid()
            keep = np.ones(batch.num_rows, dtype=bool)
            rows = np.flatnonzero(touched.to_numpy(zero_copy_only=False))
            if len(rows):
                starts, ends = (batch.column(len(plain) + k).take(pa.array(rows)).to_pylist() for k in (0, 1))
                texts = []
                for row, s, e in zip(rows.tolist(), starts, ends):
                    raw = np.frombuffer(arrays[at][row].as_py().encode(), dtype=np.uint8)
                    gone, _ = cut_ranges(raw, np.array(s, dtype=np.int64), np.array(e, dtype=np.int64))
                    rest = raw[~gone]
                    keep[row] = not IS_SPACE[rest].all()
                    texts.append(rest.tobytes().decode())
                arrays[at] = pc.replace_with_mask(arrays[at], touched, pa.array(texts, arrays[at].type))
                if size_at is not None:
                    sizes = pa.array([len(t) for t in texts]).cast(arrays[size_at].type)
                    arrays[size_at] = pc.replace_with_mask(arrays[size_at], touched, sizes)
            yield pa.RecordBatch.from_arrays(arrays, plain).filter(pa.array(keep))

    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    return joined.mapInArrow(lean(run), schema).toDF(*columns)
