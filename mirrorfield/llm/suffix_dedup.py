"""Removal of repeated passages by bucket-pointer refinement over sampled suffixes.

Texts are byte strings; positions are ordered by (doc_id, offset). A byte goes if a string of LENGTH bytes that
covers it also starts earlier. Suffixes are sampled: of each LENGTH-byte window the suffix whose first GRAM bytes
hash lowest, so equal windows hold equal samples at equal offsets and none is missed.

1. Initial buckets: sampled suffixes with the same first GRAM bytes, each with its run, all windows of that sample.
   Buckets of one suffix are closed; so are small ones whose runs are all the same, and runs with the bytes of one
   before in their bucket: what is not the first is a repeat. Each window holds the 40 bytes before its sample or
   the 41 after the sample's first GRAM. Windows of a run are closed too if the hash bits of that longer string are no
   other run's in the bucket: so 20 bytes that many texts have by chance move nothing. A bucket of many suffixes is
   parted by these strings.
2. Refinement: positions of the other buckets' runs start in buckets of equal 8-byte strings and are sorted again and
   again on two identifiers, that of their own bucket and that of the bucket of a later offset; so buckets of
   8 bytes give those of 16, these those of 32, of 64 and of LENGTH, each round using the updated identifiers of the
   one before. Positions alone in their bucket, or before such a one, are closed and sorted no more; so are, before
   the first round, windows whose 64-bit hash no other one has. A last bucket's pointer is its first position; a
   window whose pointer is not its own position is a repeat.
3. Repeats are unions of windows, so what goes of each text is a union of intervals.

Buckets of up to BUCKET_LIMIT suffixes are refined whole in one task. Those of more are refined within each batch of
texts, and the pointer of each refined bucket is dealt out with its bytes, so a passage that a third of all texts
share never meets in one task. The largest buckets are found by counting within each task, and are dealt out before
they meet; suffixes move once, with their hashes.

Refinement starts from bytes, so it is exact; windows that are dealt out are compared byte by byte. A small bucket is
closed at once by a 64-bit hash of whole runs, on top of that of their first GRAM bytes; bytes are not compared there.
The texts themselves move once, compressed, to be looked at and to be cut.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType, _parse_datatype_string

from mirrorfield.llm.common import NULL_KEY, pieces, table, text_bytes

LENGTH = 100
GRAM = 20
#: Bits of a sample's first bytes that tell buckets apart, and of each longer string; a bucket of two strings only costs time.
_SIDE = 16
#: Samples that a task counts at the same time to find the largest buckets.
_COUNTED = 1 << 16
BUCKET_LIMIT = 2048
HEAVY = 1024
#: Suffixes of a large bucket that are dealt out together.
SALT_ROWS = 1024
_BITS = 18
_BUFFER = 1 << _BITS
_LEFT = 7
_RIGHT = 7
#: Bits of a place: first window (texts are of up to 2 ** 31 bytes), distance and length of the run.
_PLACE = 31 + _LEFT + _RIGHT
#: What is to be done with a run: it goes as a whole; it meets its bucket, by its first bytes or by a longer string; its windows are dealt out.
CLOSED, COLD, LEFT, RIGHT, HOT = range(5)
_WHAT = 3
_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


_UP = _powers(_BASE, _BUFFER)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _BUFFER)


def _prefix(raw: np.ndarray) -> np.ndarray:
    """Prefix hashes of at most _BUFFER bytes; they wrap around at 64 bits."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _UP[: len(raw)], out=out[1:])
    return out


def _hashes(prefix: np.ndarray, at: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """Hashes of the strings from at to end, the same wherever they stand."""
    h = (prefix[end] - prefix[at]) * (_DOWN[at] if isinstance(at, np.ndarray) else _DOWN[at.start : at.stop])
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _buffers(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of up to _BUFFER bytes; a window lies in exactly one of those that it could start in, LENGTH - 1 overlap."""
    at, total = 0, int(offsets[-1])
    while at < total:
        yield at, min(at + _BUFFER, total)
        if at + _BUFFER >= total:
            return
        at += _BUFFER - LENGTH + 1


def _side(prefix: np.ndarray, at: np.ndarray, size: int, there: np.ndarray) -> np.ndarray:
    """A few bits of the hashes of these strings, 0 where there is none."""
    at = np.where(there, at, 0)
    bits = _hashes(prefix, at, at + size) >> np.uint64(64 - _SIDE)
    return np.where(there, np.maximum(bits, np.uint64(1)), np.uint64(0)).astype(np.int64)


def sampled(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int, whole: bool = True) -> tuple[np.ndarray, ...]:
    """For each run of windows with the same sample: hash of its first bytes, sample, first and last window, hash of the whole run,
    and bits of the strings that reach further to its left and right; without whole, the last three are empty."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    half = (length - gram) // 2
    out: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
    for lo, hi in _buffers(offsets):
        if hi - lo < length:
            continue
        prefix = _prefix(raw[lo:hi])
        n, w = hi - lo - gram + 1, length - gram + 1
        grams = _hashes(prefix, slice(0, n), slice(gram, gram + n))
        low = np.uint64(_BUFFER - 1)
        keys = (grams & ~low) | np.arange(n, dtype=np.uint64)
        size, least = 1, keys
        while 2 * size <= w:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < w:
            least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
        starts = np.arange(len(least))
        starts = starts[starts + lo + length <= ends[lo : lo + len(least)]]
        if not len(starts):
            continue
        sample = (least[starts] & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, (sample[1:] != sample[:-1]) | (starts[1:] != starts[:-1] + 1)])
        last = np.r_[first[1:], len(starts)] - 1
        # the same bytes with the sample at the same place; a run of another length ends in other bytes or has another hash
        at, a, b = sample[first], starts[first], starts[last]
        found = [grams[at].view(np.int64), at + lo, a + lo, b + lo]
        if whole:
            run = _run_hashes(raw[lo:hi], a, b + length, at - a)
            found += [run.view(np.int64), _side(prefix, at - half, half + gram, at - a >= half), _side(prefix, at, length - half + 1, at - b < half)]
        for have, add in zip(out, found):
            have.append(add)
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in out)


def _run_hashes(raw: np.ndarray, at: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
    digest, view = xxhash.xxh3_64_intdigest, memoryview(np.ascontiguousarray(raw))
    return np.fromiter((digest(view[a:b], s) for a, b, s in zip(at.tolist(), end.tolist(), seed.tolist())), np.uint64, len(at))


def refined(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions whose length bytes stand more than once in raw, and the identifiers of their buckets: equal strings, equal identifiers.

    Exact: the first buckets are those of equal bytes, the others those of equal pairs of identifiers.
    """
    n, width = len(raw), min(8, length)
    raw = np.r_[raw, np.zeros(8, np.uint8)]
    keys = np.empty(n + 8, np.uint64)
    for k in range(8):
        part = np.frombuffer(raw, "<u8", (len(raw) - k) // 8, k)
        keys[k : k + 8 * len(part) : 8] = part
    at = np.arange(max(n - width + 1, 0))
    keys = keys[: len(at)] & np.uint64((1 << 8 * width) - 1)
    ids, open_ = np.zeros(n + 1, np.uint64), np.zeros(n + 1, bool)
    while True:
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.r_[True, ordered[1:] != ordered[:-1], True][: len(ordered) + 1]
        several = ~(new[:-1] & np.r_[new[1:-1], True][: len(ordered)])
        at, bucket = at[order[several]], np.cumsum(new[:-1])[several].astype(np.uint64)
        if width == length:
            return at, bucket.astype(np.int64)
        open_[:] = False
        open_[at], ids[at] = True, bucket
        step = min(width, length - width)
        at = at[at + step + width <= n]
        at = at[open_[at + step]]
        keys = ids[at] << np.uint64(32) | ids[at + step]
        width += step


def again_of(raw: np.ndarray, starts: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows that start there hold the bytes of one before, in the order given. Windows whose hash, in ids, no other
    one has are closed at once; the bytes of the others are refined."""
    order = np.argsort(ids)
    same = ids[order[1:]] == ids[order[:-1]]
    out = np.zeros(len(ids), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    which = np.flatnonzero(out)
    if not len(which):
        return out
    at = np.unique(starts[which])
    # the stretches of raw that these windows cover, one after the other
    first = np.flatnonzero(np.r_[True, np.diff(at) > length])
    begin, end = at[first], at[np.r_[first[1:], len(at)] - 1] + length
    inside, _ = _spread(begin, end - begin)
    shift = begin - (np.cumsum(end - begin) - (end - begin))
    place = starts[which] - shift[np.searchsorted(begin, starts[which], side="right") - 1]
    found, bucket = refined(raw[inside], length)
    of = np.full(len(inside) + 1, -1, np.int64)
    of[found] = bucket
    exact = of[place]
    again = exact >= 0
    again[again] = _repeats(exact[again])
    out[which] = again
    return out


def _owner(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, at, side="right") - 1


def _runs(flags: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of set flags; apart marks where a new run must start."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.r_[True, (at[1:] != at[:-1] + 1) | apart[at[1:]]]
    first = np.flatnonzero(new)
    return at[first], at[np.r_[first[1:], len(at)] - 1]


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start[i], start[i] + 1, ... count[i] of them, and the i of each."""
    which = np.repeat(np.arange(len(count)), count)
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(len(which)), which


def _repeats(ids: np.ndarray) -> np.ndarray:
    """Which of the identifiers also stand earlier."""
    order = np.argsort(ids, kind="stable")
    out = np.zeros(len(ids), bool)
    out[order[1:]] = ids[order[1:]] == ids[order[:-1]]
    return out


def _window_ids(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Identifiers of the windows that start there; raw may be of any size, starts ascend."""
    out = np.empty(len(starts), np.uint64)
    step = _BUFFER - length
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = int(np.searchsorted(starts, lo + step, side="right"))
        part = starts[at:to] - lo
        prefix = _prefix(raw[lo : lo + int(part[-1]) + length])
        out[at:to] = _hashes(prefix, part, part + length)
        at = to
    return out


def _cuts(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """The strings of raw that start there, of these sizes."""
    inside, _ = _spread(at, size)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw[inside]))])


def _batches(arrays: dict[str, pa.Array], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))
    for at in range(0, whole.num_rows, rows):
        yield whole.slice(at, rows)


class _Scheme:
    def __init__(self, length: int, gram: int, limit: int):
        if not 0 < gram <= length < _BUFFER // 4 or length - gram >= 1 << _LEFT:
            raise ValueError("0 < gram <= length and length - gram < 128 must hold")
        self.length, self.gram, self.limit, self.half = length, gram, limit, (length - gram) // 2

    def common(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text) -> (gram, n): the grams of over 1 / (2 * HEAVY) of the task's samples, at least so often; of null, all samples.

        Counts of the rare ones are given up when they are too many, so no gram is counted too often, or too low by over 1 / _COUNTED of all.
        """
        every, ids, n = 0, np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in pieces(batches, 512):
            raw, offsets = text_bytes(batch.column(0))
            now = sampled(raw, offsets, self.length, self.gram, whole=False)[0] >> _SIDE
            every += len(now)
            now, times = np.unique(now, return_counts=True)
            ids, of = np.unique(np.concatenate([ids, now]), return_inverse=True)
            n = np.bincount(of, np.concatenate([n, times]), len(ids)).astype(np.int64)
            if len(n) > 4 * _COUNTED:
                n -= np.partition(n, -_COUNTED)[-_COUNTED]
                ids, n = ids[n > 0], n[n > 0]
        often = n * 2 * HEAVY > every
        yield pa.RecordBatch.from_arrays([pa.array([None, *ids[often].tolist()], pa.int64()), pa.array([every, *n[often].tolist()], pa.int64())], ["gram", "n"])

    def samples(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, rn, text) -> (gram, run, key, rn, place): gram ends in the left side's bits; place packs those of the right side,
        the run's first window, the sample's distance, the run's length."""
        for batch in pieces(batches, 512):
            raw, offsets = text_bytes(batch.column(2))
            gram, sample, first, last, run, left, right = sampled(raw, offsets, self.length, self.gram)
            doc = _owner(offsets, first)
            place = right << _PLACE | (first - offsets[doc]) << (_LEFT + _RIGHT) | (sample - first) << _RIGHT | (last - first)
            gram = gram >> _SIDE << _SIDE | left
            yield from _batches({"gram": pa.array(gram), "run": pa.array(run), "key": batch.column(0).take(pa.array(doc)), "rn": batch.column(1).take(pa.array(doc)), "place": pa.array(place)})

    def buckets(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(salt, gram, run, key, rn, place) sorted by (salt, gram, key, rn, place) -> (key, rn, place) of what is not closed as unique,
        or as its bucket's pointer; place ends in what is to be done with its windows. Salts of 1 and more are parts of the largest buckets."""
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if not len(held[0]):
                continue
            # whole buckets are looked at, the last one once it has ended
            ids = held[1] >> _SIDE
            last = int(np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (held[0][1:] != held[0][:-1])])[-1])
            if last:
                yield from self.judged(*(c[:last] for c in held))
                held = [c[last:] for c in held]
        if held is not None and len(held[0]):
            yield from self.judged(*held)

    def judged(self, salt: np.ndarray, gram: np.ndarray, run: np.ndarray, key: np.ndarray, rn: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = gram >> _SIDE
        starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (salt[1:] != salt[:-1])])
        sizes = np.diff(np.r_[starts, len(gram)])
        bucket, many = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes, sizes) > self.limit
        pure = np.repeat(np.minimum.reduceat(run, starts) == np.maximum.reduceat(run, starts), sizes) & ~many
        first = np.zeros(len(gram), bool)
        first[starts] = True
        side, heavy = (1 << _SIDE) - 1, salt > 0
        right, place = place >> _PLACE, place & ((1 << _PLACE) - 1)
        left, distance, after = gram & side, place >> _RIGHT & ((1 << _LEFT) - 1), place & ((1 << _RIGHT) - 1)
        open_, near = ~pure & ~heavy, []
        at = np.flatnonzero(open_)
        for bits in (left, right):
            _, of, n = np.unique(bucket[at] << _SIDE | bits[at], return_inverse=True, return_counts=True)
            shared = np.zeros(len(gram), np.int64)
            shared[at] = np.where(bits[at] > 0, n[of], 0)
            near.append(shared)
        begin = place >> (_LEFT + _RIGHT)
        # the windows up to the one half before the sample, and those after it
        lefts = begin << (_LEFT + _RIGHT) | distance << _RIGHT | np.minimum(after, distance - self.half)
        skip = np.maximum(distance - self.half + 1, 0)
        rights = (begin + skip) << (_LEFT + _RIGHT) | (distance - skip) << _RIGHT | (after - skip)
        (l, r), few = near, open_ & ~many
        parts = [
            (heavy, place, HOT),
            (pure & ~heavy & ~first, place, CLOSED),
            (few & (l > 1) & (r > 1), place, COLD),
            (few & (l > 1) & (r < 2), lefts, COLD),
            (few & (l < 2) & (r > 1), rights, COLD),
        ]
        for near, part, bucketed in ((l, lefts, LEFT), (r, rights, RIGHT)):
            parts += [(open_ & many & (near > 1) & (near <= self.limit), part, bucketed), (open_ & many & (near > self.limit), part, HOT)]
        rows = [np.flatnonzero(which) for which, _, _ in parts]
        found = np.concatenate([part[at] << _WHAT | what for at, (_, part, what) in zip(rows, parts)])
        rows = np.concatenate(rows)
        yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(rn[rows]), pa.array(found)], ["key", "rn", "place"])

    def windows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, rn, more, packed, places) -> rows of three kinds.

        0: an interval that goes; 1: a run's bytes, for its bucket; 2: a window, by its own identifier.
        """
        for batch in pieces(batches, 512):
            raw, offsets = _unpacked(batch.column(3))
            places = batch.column(4)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))
            places = places.flatten().to_numpy()
            places, what = places >> _WHAT, places & ((1 << _WHAT) - 1)
            places, what, doc = (x[what != CLOSED] for x in (places, what, doc))
            # positions in order: by key, then row, then place
            keys, rns = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rank = np.empty(batch.num_rows, np.int64)
            rank[np.lexsort((rns, keys))] = np.arange(batch.num_rows)
            order = np.lexsort((places, rank[doc]))
            places, what, doc = (x[order] for x in (places, what, doc))
            start = places >> (_LEFT + _RIGHT)
            many = (places & ((1 << _RIGHT) - 1)) + 1
            hot = what == HOT
            out: dict[str, list[np.ndarray]] = {k: [] for k in ("kind", "bucket", "doc", "start", "size")}

            def add(kind: int, bucket: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
                for k, v in zip(out, (np.full(len(doc), kind), bucket, doc, start, size)):
                    out[k].append(np.asarray(v, np.int64))

            spans: list[pa.Array] = []
            cold = np.flatnonzero(~hot)
            sample = offsets[doc[cold]] + start[cold] + (places[cold] >> _RIGHT & ((1 << _LEFT) - 1))
            add(1, self.strings(raw, sample, what[cold]), doc[cold], start[cold], many[cold])
            spans.append(_cuts(raw, offsets[doc[cold]] + start[cold], many[cold] + self.length - 1))
            if hot.any():
                which = np.flatnonzero(hot)
                at, of = _spread(start[which], many[which])
                d = doc[which][of]
                flat = offsets[d] + at
                ascending = np.argsort(flat, kind="stable")
                ids = np.empty(len(flat), np.int64)
                ids[ascending] = _window_ids(raw, flat[ascending], self.length).view(np.int64)
                again = again_of(raw, flat, ids, self.length)
                new = np.r_[True, (at[1:] != at[:-1] + 1) | (d[1:] != d[:-1])]
                a, b = _runs(again, new)
                add(0, _mixed(d[a], a), d[a], at[a], at[b] - at[a] + self.length)
                one = np.flatnonzero(~again)
                add(2, ids[one], d[one], at[one], np.full(len(one), self.length))
                spans += [pa.nulls(len(a), pa.binary()), _cuts(raw, flat[one], np.full(len(one), self.length))]
            got = {k: np.concatenate(v) for k, v in out.items()}
            doc = pa.array(got.pop("doc"))
            yield from _batches({"kind": pa.array(got["kind"]), "bucket": pa.array(got["bucket"]), "key": batch.column(0).take(doc), "rn": batch.column(1).take(doc), "start": pa.array(got["start"]), "size": pa.array(got["size"]), "span": pa.concat_arrays(spans)}, 4096)

    def strings(self, raw: np.ndarray, sample: np.ndarray, what: np.ndarray) -> np.ndarray:
        """The buckets of samples: by their first bytes, or by the longer string to their left or right."""
        out = np.empty(len(sample), np.int64)
        for kind, before, size in ((COLD, 0, self.gram), (LEFT, self.half, self.half + self.gram), (RIGHT, 0, self.length - self.half + 1)):
            which = np.flatnonzero(what == kind)
            at = sample[which] - before
            ascending = np.argsort(at, kind="stable")
            out[which[ascending]] = _window_ids(raw, at[ascending], size).view(np.int64)
        return out

    def refine(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (kind, bucket, key, rn, start) -> intervals (key, rn, a, b) that go.

        Whole buckets of kind 1 are solved as they end; one bucket of at most limit runs is carried on.
        """
        bucket: int | None = None
        seen: set[bytes] = set()
        held: pa.Table | None = None
        names = ["key", "rn", "a", "b"]
        for batch in batches:
            kind = batch.column(0).to_numpy()
            plain = batch.filter(pa.array(kind == 0))
            if plain.num_rows:
                a = plain.column(4).to_numpy()
                yield pa.RecordBatch.from_arrays([plain.column(2), plain.column(3), pa.array(a), pa.array(a + plain.column(5).to_numpy())], names)
            single = batch.filter(pa.array(kind == 2))
            if single.num_rows:
                again = []
                # a bucket is of one hash; its windows are mostly one string, which seen holds
                for own, window in zip(single.column(1).to_pylist(), single.column(6).to_pylist()):
                    if own != bucket:
                        bucket = own
                        seen.clear()
                    again.append(window in seen)
                    seen.add(window)
                gone = single.filter(pa.array(again, pa.bool_()))
                a = gone.column(4).to_numpy()
                yield pa.RecordBatch.from_arrays([gone.column(2), gone.column(3), pa.array(a), pa.array(a + self.length)], names)
            runs = batch.filter(pa.array(kind == 1))
            if runs.num_rows:
                both = pa.Table.from_batches([runs])
                both = pa.concat_tables([held, both]) if held is not None else both
                ids = both.column(1).to_numpy()
                last = int(np.searchsorted(ids, ids[-1]))
                held = both.slice(last)
                if last:
                    yield from self.solved(both.slice(0, last), names)
        if held is not None:
            yield from self.solved(held, names)

    def solved(self, rows: pa.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
        """Intervals of whole buckets. A run with the bytes of one before is a repeat as a whole; the others' windows are refined."""
        raw, offsets = text_bytes(rows.column(6))
        same = rows.column(6).combine_chunks().dictionary_encode().indices.to_numpy()
        again = np.ones(rows.num_rows, bool)
        again[np.unique(same, return_index=True)[1]] = False
        own = np.flatnonzero(~again)
        many = rows.column(5).to_numpy()
        at, of = _spread(offsets[own], many[own])
        new = np.r_[True, of[1:] != of[:-1]]
        a, b = _runs(again_of(raw, at, _window_ids(raw, at, self.length), self.length), new)
        whole = np.flatnonzero(again)
        row = np.r_[own[of[a]], whole]
        begin = np.r_[at[a] - offsets[own[of[a]]], np.zeros(len(whole), np.int64)]
        size = np.r_[at[b] - at[a], many[whole] - 1] + self.length
        if len(row):
            start, take = rows.column(4).to_numpy()[row] + begin, pa.array(row)
            yield pa.RecordBatch.from_arrays([rows.column(2).combine_chunks().take(take), rows.column(3).combine_chunks().take(take), pa.array(start), pa.array(start + size)], names)


def _mixed(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Any spread of numbers, to deal rows out evenly."""
    return ((doc * 1_000_003 + at) * 0x5851F42D4C957F2D % (1 << 61)).astype(np.int64) if len(doc) else doc


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rn, more, text) with texts compressed: they are what moves most."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in pieces(batches):
        texts = batch.column(3).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([pack(t or b"") for t in texts], pa.binary())], ["key", "rn", "more", "packed"])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    texts = [unpack(t) for t in column.to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


def _widened(text: bytes, a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """The spans, up to whole UTF-8 characters."""
    start, end = [], []
    for i, j in zip(a, b):
        while i and text[i] & 0xC0 == 0x80:
            i -= 1
        while j < len(text) and text[j] & 0xC0 == 0x80:
            j += 1
        if end and i <= end[-1]:
            end[-1] = j
        else:
            start.append(i)
            end.append(j)
    return start, end


def _cut(batches: Iterator[pa.RecordBatch], length: int, characters: bool) -> Iterator[pa.RecordBatch]:
    """(key, more, packed, spans of (a, b), places) -> key, more, what is left, and the maximal removed runs. Closed places go too."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in pieces(batches, 256):
        left, n_bytes, starts, ends = [], [], [], []
        for text, spans, places in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
            text = unpack(text)
            x = y = np.empty(0, np.int64)
            if spans.is_valid:
                x, y = spans.values.field(0).to_numpy(), spans.values.field(1).to_numpy()
            if places.is_valid:
                places = places.values.to_numpy()
                closed = places[places & ((1 << _WHAT) - 1) == CLOSED] >> _WHAT
                begin = closed >> (_LEFT + _RIGHT)
                x, y = np.r_[x, begin], np.r_[y, begin + (closed & ((1 << _RIGHT) - 1)) + length]
            a, b = [], []
            if len(x):
                order = np.argsort(x, kind="stable")
                x, y = x[order], np.maximum.accumulate(y[order])
                new = np.flatnonzero(np.r_[True, x[1:] > y[:-1]])
                a, b = x[new].tolist(), y[np.r_[new[1:], len(x)] - 1].tolist()
                if characters:
                    a, b = _widened(text, a, b)
            left.append(b"".join(text[i:j] for i, j in zip([0, *b], [*a, len(text)])))
            n_bytes.append(len(text))
            starts.append(a)
            ends.append(b)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(left, pa.binary()), pa.array(n_bytes, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], ["key", "more", "kept", "n_bytes", "starts", "ends"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_limit: int = BUCKET_LIMIT, keep: Sequence[str] = (), characters: bool = False) -> DataFrame:
    """(doc_id, kept binary, n_bytes, starts, ends) for each row: what is left of its bytes, the runs that went.

    keep: other columns to carry along, of any names. characters: a character that is cut goes as a whole.

    Null texts count as empty. Rows with the same doc_id keep a row each and are ordered by their text; of equal rows
    any one counts as the first. A null doc_id comes before all others. Texts shorter than length stay whole. Columns
    not in keep are ignored; no rows give no rows.
    """
    scheme = _Scheme(length, gram, bucket_limit)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("none")]).alias("more"))
    if docs.groupBy("key").count().where("count > 1").take(1):
        docs = docs.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("text", "more")))
    else:
        docs = docs.withColumn("rn", F.lit(0))
    docs = docs.select("key", "rn", "more", "text")
    # fewer than HEAVY buckets can hold over 1 / HEAVY of the suffixes each: those are dealt out, SALT_ROWS together
    counted = docs.select("text").mapInArrow(scheme.common, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    most = counted.orderBy(F.desc("n"), F.asc_nulls_first("gram")).limit(HEAVY + 1).collect()
    heavy = [(r["gram"], -(-r["n"] // SALT_ROWS)) for r in most if r["gram"] is not None and r["n"] > max(bucket_limit, most[0]["n"] / HEAVY)]
    samples = docs.select("key", "rn", "text").mapInArrow(scheme.samples, "gram long, run long, key long, rn int, place long")
    samples, bucket = samples.withColumn("salt", F.lit(0).cast("long")), F.shiftright("gram", _SIDE)
    if heavy:
        salts = F.broadcast(docs.sparkSession.createDataFrame(heavy, "heavy long, salts long"))
        samples = samples.join(salts, bucket == F.col("heavy"), "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("key", "place"), F.col("salts")) + 1, F.lit(0)))
    samples = samples.select("salt", "gram", "run", "key", "rn", "place").repartition("salt", bucket).sortWithinPartitions("salt", "gram", "key", "rn", "place")
    found = samples.mapInArrow(scheme.buckets, "key long, rn int, place long").groupBy("key", "rn").agg(F.collect_list("place").alias("places"))
    packed = docs.mapInArrow(_pack, StructType([StructField("key", LongType(), False), StructField("rn", IntegerType(), False), docs.schema["more"], StructField("packed", BinaryType())]))
    rows = packed.join(found, ["key", "rn"]).select("key", "rn", "more", "packed", "places")
    rows = rows.mapInArrow(scheme.windows, "kind long, bucket long, key long, rn int, start long, size long, span binary")
    rows = rows.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "key", "rn", "start")
    gone = rows.mapInArrow(scheme.refine, "key long, rn int, a long, b long")
    gone = gone.groupBy("key", "rn").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    cut = packed.join(gone, ["key", "rn"], "left").join(found, ["key", "rn"], "left").select("key", "more", "packed", "spans", "places")
    cut = cut.mapInArrow(partial(_cut, length=length, characters=characters), StructType([StructField("key", LongType()), cut.schema["more"], *_parse_datatype_string("kept binary, n_bytes long, starts array<long>, ends array<long>")]))
    return cut.select(F.nullif("key", F.lit(NULL_KEY)).alias("doc_id"), "kept", "n_bytes", "starts", "ends", *[F.col(f"more.`{c}`") for c in keep])


def removed(starts: str = "starts", ends: str = "ends"):
    return F.aggregate(F.zip_with(ends, starts, lambda b, a: b - a), F.lit(0).cast("long"), lambda x, y: x + y)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", removed().alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
