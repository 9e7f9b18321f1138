"""Phrase collocations: a minimal perfect hash over safe candidates, counted in arrays that are added up in a tree.

Texts (A-Z lower-cased) are cut at punctuation and line ends into pieces, pieces at blanks into words; a phrase stands
within a piece. All counts are per language (null: `und`). Four scans of the documents:

1. Every task hashes its runs of 1 to N words into buckets and counts them in sorted, packed blobs; slices of the bucket space add
   these up and keep a bit where a bucket reaches LEAST. A run whose bucket does not is rarer than LEAST, for certain.
2. Runs whose own bit and those of all their parts are set are the candidates (a superset of all frequent phrases and their
   parts). Tasks send their names, packed, to shards, each of which makes its part of a minimal perfect hash with the name as the stored key.
3. Every task counts its runs in an array by slot, verified against the stored key; arrays are added up in two
   rounds (by slice of slots and a salt, then by slice). Beside a count goes the smallest mark of a text that holds the phrase.
4. The texts with these marks tell the frequent phrases' words, so that each is told about once, however common it is.

Then a candidate's count and those of both sides of each cut are read by slot. More than BLOCK candidates are taken in blocks of shards,
with one scan of steps 3 and 4 each, so that what is broadcast stays bounded. The bitmap has a bit for each eight bytes of text, 2**30 at most;
larger corpora fill it up, and then get more candidates, not other results.

Defined cases: null, empty and wordless texts hold no phrase; a null language is `und`, together with that name itself; an empty
table gives no row; words and texts may be of any length; repeated rows count each time; other columns are not looked at. Phrases are told apart by
fingerprints of 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDS, Words, chunks, cut, mix, pack, parts, save, scratch, spread, trim, unpack

#: words of a phrase, its least count, percent of a phrase's count at which a longer one covers it, rows of a language
N, LEAST, COVER, TOP = 4, 30, 80, 2000
#: bits of the bitmap at least and at most, and of one of its slices
FEWEST_BITS, MOST_BITS, SLICE_BITS = 20, 30, 18
#: bucket numbers that a task holds before they are packed, and candidates whose names it remembers having told
HELD, TOLD = 1 << 22, 1 << 21
#: candidates of a shard and of a block, about; slots of a slice; salts of the first round of sums
SHARD, BLOCK, SLOTS, SALTS = 1 << 17, 1 << 22, 1 << 16, 64

_U = np.uint64
_NONE = np.iinfo(np.uint32).max
_ALL = np.arange(256, dtype=np.uint8)
_BREAK = np.isin(_ALL, list(b".,;:!?\n\x0b\x0c\r"))
_KIND = ~_BREAK & ~np.isin(_ALL, list(b" \t"))


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Runs:
    """The runs of words of some texts, each named by a fingerprint of its language and words."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, langs: list[str]):
        w = self.words = Words(buf, off, _KIND, True)
        n = len(w.start)
        ends = np.zeros(n, bool)
        if n:
            breaks = np.cumsum(_BREAK[w.buf])
            ends[:-1] = breaks[w.start[1:]] != breaks[w.end[:-1] - 1]
            ends[w.first[1:][w.count > 0] - 1] = True
        last = np.flatnonzero(ends)
        size = np.diff(np.r_[-1, last])
        self.left = np.repeat(last + 1, size) - np.arange(n)
        salts = {x: _salt(x) for x in set(langs)}
        self.salt = np.array([salts[x] for x in langs], _U)[w.text()] if n else np.zeros(0, _U)
        self.sums = WORDS.sums(w.hashes())

    def names(self, at: np.ndarray, k: int | np.ndarray) -> np.ndarray:
        return mix(WORDS.ranges(self.sums, at, at + k) ^ self.salt[at])

    def possible(self, bits: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """k, places and names of the runs that the bitmap lets through with all their parts."""
        mask, able = _U(len(bits) * 8 - 1), None
        for k in range(1, most + 1):
            at = np.flatnonzero(self.left >= k) if able is None else np.flatnonzero(able[:-1] & able[1:] & (self.left[: len(able) - 1] >= k))
            x = self.names(at, k)
            low = x & mask
            on = (bits[low >> _U(3)] >> (low & _U(7)).astype(np.uint8)) & 1 == 1
            at, x = at[on], x[on]
            able = np.zeros(len(self.left), bool)
            able[at] = True
            yield k, at, x

    def marks(self) -> np.ndarray:
        """A number for each word's text, equal for equal texts."""
        w = self.words
        return (WORDS.ranges(self.sums, w.first[:-1], w.first[1:]) >> _U(33)).astype(np.uint32)[w.text()]

    def phrase(self, at: int, k: int) -> bytes:
        w = self.words
        return b" ".join(w.buf[s:e].tobytes() for s, e in zip(w.start[at : at + k].tolist(), w.end[at : at + k].tolist(), strict=True))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Runs, list[str]]]:
    """Of (lang, text) rows."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for a, b, buf, off in chunks(batch.column(1)):
            yield Runs(buf, off, langs[a:b]), langs[a:b]
        trim()


# ------------------------------------------------------------------------------- bitmap


def _sketch(most: int, bits: int, least: int):
    """Packed buckets and their counts, by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            b = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint32)
            ends = cut(b)
            b, n = b[ends[:-1]], np.minimum(np.diff(ends), least).astype(np.uint32)
            by = cut(b >> np.uint32(SLICE_BITS))
            rows = [pack(b[i:j] & np.uint32((1 << SLICE_BITS) - 1), n[i:j]) for i, j in zip(by[:-1], by[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array((b[by[:-1]] >> np.uint32(SLICE_BITS)).astype(np.int32)), pa.array(rows, pa.binary())], names=["slice", "blob"])

        for r, _ in _runs(batches):
            for k in range(1, most + 1):
                x = r.names(np.flatnonzero(r.left >= k), k)
                held.append((x & _U((1 << bits) - 1)).astype(np.uint32))
                size += len(x)
            if size >= HELD:
                yield packed()
                held, size = [], 0
        yield packed()

    return run


def _frequent(least: int):
    """The bits of each slice, all of whose rows this task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b, n = unpack(blob, "u4", "u4")
                sums = found.setdefault(s, np.zeros(1 << SLICE_BITS, np.uint32))
                sums[b] = np.minimum(sums[b] + n, least)
        made = [np.packbits(x >= least, bitorder="little").tobytes() for x in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(made, pa.binary())], names=["slice", "bits"])

    return run


def _bitmap(texts: DataFrame, most: int, least: int) -> bytes:
    octets = texts.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(FEWEST_BITS, int(octets // 8).bit_length()))
    slices = texts.mapInArrow(_sketch(most, bits, least), "slice int, blob binary").repartition(parts(texts.sparkSession), "slice").mapInArrow(_frequent(least), "slice int, bits binary")
    whole, step = bytearray(1 << bits - 3), 1 << SLICE_BITS - 3
    for r in slices.toLocalIterator():  # 2 ** MOST_BITS bits in all
        whole[r["slice"] * step : (r["slice"] + 1) * step] = r.bits
    return bytes(whole)


# ------------------------------------------------------------------ minimal perfect hash


def _place(x: np.ndarray, level: int, size: np.ndarray) -> np.ndarray:
    return (mix(x + _U((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))) % size.astype(_U)).astype(np.int64)


def shard_levels(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bits of each level, in words of 64, and which keys have their place there, in order of place.

    A key has the first level at which no other remaining key falls on its bit.
    """
    left, level = np.arange(len(x)), 0
    while len(left):
        size = -(-2 * len(left) // 64) * 64
        at = _place(x[left], level, np.full(1, size))
        alone = np.bincount(at, minlength=size) == 1
        own = alone[at]
        order = np.argsort(at[own])
        yield np.packbits(alone, bitorder="little").view(_U), left[own][order]
        left, level = left[~own], level + 1


class Slots:
    """Slots of the names of a block of shards: level by level, in a level shard by shard. names holds the key of each slot."""

    def __init__(self, low: int, shift: int, shards: list[list[tuple[np.ndarray, np.ndarray]]]):
        """shards: of each shard from number low on, the bits and the names of its levels."""
        self.low, self.shift, self.count = low, shift, len(shards)
        self.levels, names, before = [], [], 0
        for level in range(max(map(len, shards), default=0)):
            own = [s[level] if level < len(s) else (np.zeros(0, _U), np.zeros(0, _U)) for s in shards]
            size = np.array([64 * len(b) for b, _ in own])
            bits = np.concatenate([b for b, _ in own])
            ones = np.bitwise_count(bits).astype(np.int64)
            self.levels.append((np.cumsum(size) - size, size, bits, (before + np.cumsum(ones) - ones).astype(np.int32)))
            names += [k for _, k in own]
            before += int(ones.sum())
        self.names = np.concatenate(names) if names else np.zeros(0, _U)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The slot of each name, -1 where the slot's key is another."""
        out = np.full(len(x), -1, np.int64)
        shard = (x >> _U(self.shift)).astype(np.int64) - self.low
        i = np.flatnonzero((shard >= 0) & (shard < self.count))
        for level, (begin, size, bits, rank) in enumerate(self.levels):
            s = shard[i]
            i, s = i[size[s] > 0], s[size[s] > 0]
            at = begin[s] + _place(x[i], level, size[s])
            word, bit = bits[at >> 6], (at & 63).astype(_U)
            here = (word >> bit) & _U(1) == 1
            out[i[here]] = rank[at[here] >> 6] + np.bitwise_count(word[here] & ((_U(1) << bit[here]) - _U(1)))
            i = i[~here]
        got = np.flatnonzero(out >= 0)
        out[got[self.names[out[got]] != x[got]]] = -1
        return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs of names, all of a shard in this task and shard after shard, to the levels of each shard."""

    def levels(shard: int, blobs: list[bytes]) -> pa.RecordBatch:
        x = np.zeros(0, _U)
        for i in range(0, len(blobs), 64):
            x = np.unique(np.concatenate([x, *(unpack(b, "u8")[0] for b in blobs[i : i + 64])]))
        rows = [(lv, bits.tobytes(), x[own].tobytes()) for lv, (bits, own) in enumerate(shard_levels(x))]
        return pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int32()), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True))], names=["shard", "level", "bits", "names"])

    here, blobs = None, []
    for batch in batches:
        for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if shard != here and blobs:
                yield levels(here, blobs)
                blobs = []
            here = shard
            blobs.append(blob)
    if blobs:
        yield levels(here, blobs)


# ----------------------------------------------------------------------------- scans


def _candidates(bits, most: int, shift: int):
    """Packed names of candidates, by shard; a task tells each name once, or again after TOLD others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits.value, np.uint8)
        told, held, size = np.zeros(0, _U), [], 0

        def packed() -> pa.RecordBatch:
            nonlocal told, held, size
            x = np.unique(np.concatenate([np.zeros(0, _U), *held]))
            where = np.minimum(np.searchsorted(told, x), max(len(told) - 1, 0))
            new = x[told[where] != x] if len(told) else x
            told = np.sort(np.r_[told, new]) if len(told) < TOLD else new
            held, size = [], 0
            shard = (new >> _U(shift)).astype(np.int32)
            ends = cut(shard)
            return pa.RecordBatch.from_arrays([pa.array(shard[ends[:-1]], pa.int32()), pa.array([pack(new[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["shard", "blob"])

        for r, _ in _runs(batches):
            for _, _, x in r.possible(known, most):
                held.append(np.unique(x))
                size += len(held[-1])
            if size >= HELD:
                yield packed()
        yield packed()

    return run


def _counts(bits, slots, most: int, with_words: bool):
    """Slices of this task's counts by slot and of the smallest mark of a text in which the slot's phrase stands (slice -1: words of a language)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        from pyspark import TaskContext

        known, own = np.frombuffer(bits.value, np.uint8), pickle.loads(slots.value)
        n, words = len(own.names), {}
        sums, first, held, size = np.zeros(n, np.int64), np.full(n, _NONE, np.uint32), [], 0
        for r, langs in _runs(batches):
            for lang, count in zip(langs, r.words.count.tolist(), strict=True):
                words[lang] = words.get(lang, 0) + count
            marks = r.marks()
            for _, at, x in r.possible(known, most):
                slot = own.of(x)
                np.minimum.at(first, slot[slot >= 0], marks[at[slot >= 0]])
                held.append(slot[slot >= 0])
                size += len(held[-1])
            if size >= max(n, HELD):
                sums += np.bincount(np.concatenate(held), minlength=n)
                held, size = [], 0
        if held:
            sums += np.bincount(np.concatenate(held), minlength=n)
        salt = TaskContext.get().partitionId() % SALTS
        rows = [(i // SLOTS, salt, None, 0, pack(sums[i : i + SLOTS], first[i : i + SLOTS])) for i in range(0, n, SLOTS) if sums[i : i + SLOTS].any()]
        rows += [(-1, salt, lang, count, None) for lang, count in words.items() if with_words]
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], names=["slice", "salt", "lang", "n", "blob"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One blob for each (slice, salt), all of whose rows this task has."""
    held: dict[tuple[int, int], list[np.ndarray]] = {}
    for batch in batches:
        for s, salt, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            n, first = unpack(blob, "i8", "u4")
            held[s, salt] = [held[s, salt][0] + n, np.minimum(held[s, salt][1], first)] if (s, salt) in held else [n, first]
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()), pa.array([pack(*v) for v in held.values()], pa.binary())], names=["slice", "salt", "blob"])


def _tree_sum(counts: DataFrame) -> DataFrame:
    n = parts(counts.sparkSession)
    once = counts.where("blob IS NOT NULL").select("slice", "salt", "blob").repartition(n, "slice", "salt").mapInArrow(_added, "slice int, salt int, blob binary")
    return once.withColumn("salt", F.lit(0)).repartition(n, "slice").mapInArrow(_added, "slice int, salt int, blob binary")


def _named(bits, known, most: int, least: int):
    """Frequent phrases of this block, told by the texts with their mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        (own, totals, first), on = pickle.loads(known.value), np.frombuffer(bits.value, np.uint8)
        open_ = totals >= least
        for r, langs in _runs(batches):
            marks = r.marks()
            for k, at, x in r.possible(on, most):
                if k == 1 or not len(totals):
                    continue
                slot = own.of(x)
                mine = np.flatnonzero((slot >= 0) & open_[slot] & (first[slot] == marks[at]))
                slot, i = np.unique(slot[mine], return_index=True)
                open_[slot] = False
                at, x = at[mine[i]], x[mine[i]]
                text = np.searchsorted(r.words.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(x.view(np.int64)), pa.array(np.full(len(x), k, np.int32)), pa.array([langs[t] for t in text.tolist()], pa.string()), pa.array([r.phrase(j, k).decode() for j in at.tolist()], pa.string()), pa.array(totals[slot]),
                ], names=["x", "k", "lang", "phrase", "a"])

    return run


def _cuts(known):
    """Of (x, lang, phrase) rows: x, cut and side with the count of that side, where it is of this block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        own, totals, _ = pickle.loads(known.value)
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for a, b, buf, off in chunks(batch.column(2)):
                r = Runs(buf, off, langs[a:b])
                first, k = r.words.first[:-1], r.words.count
                text = np.repeat(np.arange(len(k)), np.maximum(k - 1, 0))
                at = spread(np.maximum(k - 1, 0)) + 1
                begin = np.r_[first[text], first[text] + at]
                size = np.r_[at, k[text] - at]
                slot = own.of(r.names(begin, size))
                got = np.flatnonzero(slot >= 0)
                row, right = got % max(len(text), 1), got >= len(text)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text[row] + a)), pa.array(at[row].astype(np.int32)), pa.array(right), pa.array(totals[slot[got]] if len(got) else np.zeros(0, np.int64))], names=["x", "at", "right", "n"])

    return run


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (lang, phrase, a) rows: the names of all shorter phrases of two words or more inside, with a."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for a, b, buf, off in chunks(batch.column(1)):
            r = Runs(buf, off, langs[a:b])
            for k in range(2, int(r.words.count.max(initial=0))):
                at = np.flatnonzero((r.left >= k) & (r.words.count[r.words.text()] > k))
                yield pa.RecordBatch.from_arrays([pa.array(r.names(at, k).view(np.int64)), batch.column(2).take(pa.array(r.words.text()[at] + a))], names=["x", "longer"])


# ----------------------------------------------------------------------------- operator


def score(a: Column, rest: Column) -> Column:
    """floor(2000000 * a / rest) without rounding: decimals hold the product."""
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * a.cast("decimal(19,0)"), rest.cast("decimal(20,0)"))


def _hashed(made: DataFrame, shift: int, low: int, high: int) -> Slots:
    shards: list[dict] = [{} for _ in range(high - low)]
    for r in made.where(F.col("shard").between(low, high - 1)).toLocalIterator():  # some 9 bytes a candidate, BLOCK candidates
        shards[r.shard - low][r.level] = np.frombuffer(r.bits, _U), np.frombuffer(r["names"], _U)
    return Slots(low, shift, [[s[i] for i in range(len(s))] for s in shards])


def collocations(docs: DataFrame, *, words: int = N, least: int = LEAST, cover: int = COVER, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    from pyspark import cloudpickle

    spark, n = docs.sparkSession, parts(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    with scratch(spark):
        held = _bitmap(texts, words, least)
        # about one candidate a bit that is set
        some = int(np.bitwise_count(np.frombuffer(held, np.uint8)).sum(dtype=np.int64))
        bits, shift = spark.sparkContext.broadcast(held), 64 - max(1, (some // SHARD).bit_length())
        del held
        made = save(texts.mapInArrow(_candidates(bits, words, shift), "shard int, blob binary").repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_shards, "shard int, level int, bits binary, names binary"))
        many = made.select(F.sum(F.octet_length("names") / 8)).first()[0] or 0
        step = max(1, int((1 << 64 - shift) * block // max(many, 1)))
        frequent, known, counted = None, [], []
        for low in range(0, 1 << 64 - shift, step):
            slots = _hashed(made, shift, low, min(low + step, 1 << 64 - shift))
            sent = spark.sparkContext.broadcast(cloudpickle.dumps(slots))
            counted.append(save(texts.mapInArrow(_counts(bits, sent, words, low == 0), "slice int, salt int, lang string, n long, blob binary")))
            totals, first = np.zeros(len(slots.names), np.int64), np.full(len(slots.names), _NONE, np.uint32)
            for r in _tree_sum(counted[-1]).toLocalIterator():  # 12 bytes a slot
                own = slice(r["slice"] * SLOTS, (r["slice"] + 1) * SLOTS)
                totals[own], first[own] = unpack(r.blob, "i8", "u4")
            known.append(spark.sparkContext.broadcast(cloudpickle.dumps((slots, totals, first))))
            own = texts.mapInArrow(_named(bits, known[-1], words, least), "x long, k int, lang string, phrase string, a long")
            frequent = own if frequent is None else frequent.unionAll(own)
        # copies of a text tell the same phrases
        frequent = save(frequent.groupBy("x").agg(*[F.min(c).alias(c) for c in ("k", "lang", "phrase", "a")]))
        sides = None
        for b in known:
            own = frequent.select("x", "lang", "phrase").mapInArrow(_cuts(b), "x long, at int, right boolean, n long")
            sides = own if sides is None else sides.unionAll(own)
        cuts = sides.groupBy("x", "at").agg(F.max(F.when(~F.col("right"), F.col("n"))).alias("l"), F.max(F.when(F.col("right"), F.col("n"))).alias("r"))
        longer = frequent.where("k > 2").select("lang", "phrase", "a").mapInArrow(_inside, "x long, longer long").groupBy("x").agg(F.max("longer").alias("longer"))
        wide = lambda c, by: F.col(c).cast("decimal(19,0)") * F.lit(by).cast("decimal(3,0)")
        open_ = frequent.join(longer, "x", "left").where(F.col("longer").isNull() | (wide("longer", 100) < wide("a", cover)))
        scored = open_.join(cuts, "x").withColumn("s", score(F.col("a"), F.col("l").cast("decimal(19,0)") + F.col("r")))
        # the lowest-scoring cut, of equal ones the first
        best = scored.groupBy("x").agg(*[F.min(c).alias(c) for c in ("lang", "phrase", "a")], F.min(F.struct("s", "at", "l", "r")).alias("cut"))
        best = best.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.s").alias("score"))
        order = "ORDER BY score DESC, a DESC, phrase"
        # of each part of a language first, so that no language meets in one task
        best = best.withColumn("_r", F.expr(f"row_number() OVER (PARTITION BY lang, pmod(xxhash64(phrase), {min(n, 16)}) {order})")).where(F.col("_r") <= top)
        ranked = best.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})").cast("long")).where(F.col("rank") <= top)
        counts = counted[0].where("slice = -1").groupBy("lang").agg(F.sum("n").alias("n"))
        return save(ranked.join(counts, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), lasting=True)


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


ORACLE_SQL = r"""
WITH piece AS (
  SELECT lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents WHERE text IS NOT NULL)
), words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
size AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
f AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= 30
), candidate AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (
  SELECT lang, phrase, j, CAST(floor(CAST(2000000 AS HUGEINT) * a // (l + r)) AS BIGINT) AS score, l, r FROM (
    SELECT c.lang, c.phrase, j, c.a, x.f AS l, y.f AS r
    FROM (SELECT *, unnest(range(1, k)) AS j FROM candidate) AS c
    JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[: j], ' ') JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1 :], ' '))
), best AS (SELECT lang, phrase, min({'s': score, 'j': j, 'l': l, 'r': r}) AS b FROM cuts GROUP BY ALL),
inside AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM candidate, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY b.s DESC, a DESC, encode(phrase)) AS rank, phrase, a, b.l AS l, b.r AS r, n, b.s AS score
  FROM candidate JOIN best USING (lang, phrase) JOIN size USING (lang) LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT * FROM ranked WHERE rank <= 2000
"""
