"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles. Shingles are XOR-hashed into bit
sketches: each flips one bit, so the Hamming distance of two sketches is at most the
symmetric difference of the sets. Sizes are banded; two sets of a band that reach the
similarity differ in at most d shingles (d follows from the band's upper size), so of
d + 1 segments of their sketches one at least is equal: segments are the join keys. A
quarter more segments are made, and those with one shingle or none are left out
where d + 1 others remain. Segments are wide and sparse and are held as the XOR of
32-bit codes of their set bits, equal for equal segments. A set that can also pair with a smaller one of the
band below emits that band's segments too. No link is lost.

Equal sets are one class throughout. Buckets of a key are streamed in sorted order:
each member is paired with the bucket's first one only, and each class keeps a few
partners that it shares most segments with; these pairs are verified and connected.
Dense sketches, folded to one size, turn most false pairs away before the sets meet.
What is left are buckets whose members lie in several components. Their cross pairs
are listed exactly: few at once as pairs, many after a Hamming filter on folded dense
sketches (all that passes, or where that is more than the members, twice a spanning
forest of it, verified and connected, then all that still passes), and buckets with very many are keyed anew by another hash.
Pairs of one component need no look. Every listed pair is verified on the sets.

Hot buckets are split. Keys that a sample of the sets holds most often get their
first member beforehand, by broadcast of at most four rows a shuffle partition, so
their members need not meet. A large bucket is compared by blocks: its largest
component in blocks of ``BLOCK`` members, and what lies outside it in blocks too; each
block of the one meets each of the other in a task of its own, and a member of the
largest component never meets another. Tasks hold at most ``HELD`` numbers of members,
or the sketches of two blocks; nothing is collected to the driver. Sketches, folded
once, go to their blocks in rounds of about the bytes of all sketches and segments, whose shuffle files go before the next one.
Keys go to their buckets in rounds of about that size too, each of which makes them anew.

Defined results: A-Z count as a-z; words are runs without ASCII white space; with
fewer words than a shingle has, the whole sequence is one shingle; null, empty and
blank texts have no shingle and link with nothing; very long texts are read whole, one
at a time; rows that repeat a doc_id are rows of their own; null doc_ids link like
others but never name a component unless it has no other; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, joined_small, release, small_batches, written
from .textscan import Scanner, chunks, mix64, ngrams, utf8

#: Upper sizes of neighbouring bands differ by this factor; it must be at least 1 / similarity.
BAND = 1.4
#: Cross pairs of a bucket that are listed without the filter, with it, and members a task holds.
PLAIN, FILTERED, HELD = 64, 4_000_000, 100_000
#: Members of a block, bytes of the sketches compared in it, and bytes of the products of one step.
BLOCK, FOLD, STEP = 2000, 1 << 14, 8 << 20
#: Bits of the folded sketches by whose products most pairs are turned away; bytes of a round by those of all sketches and segments, and at least; bytes of a member that goes to its bucket.
COARSE, ROOM, LEAST, ROW = 8192, 1, 1 << 28, 20
#: One of so many sets tells which keys are hot, if it meets a key in so many of these.
SAMPLE, HOT = 16, 8
#: Partners of a set that are verified before buckets are listed: at most one of each 64th of the partners, the best of these.
LEADS = 3
#: Edges of a task in the steps of the components, rows of a task where pairs meet their values; at least, so that few don't take all shuffle partitions.
EDGES, SIDES = 50_000, 10_000
_U = np.uint64


def band_tops(den: int, num: int) -> np.ndarray:
    step = max(BAND, den / num + 0.01)
    tops = [1]
    while tops[-1] < 2**40:
        tops.append(max(tops[-1] + 1, int(tops[-1] * step)))
    return np.array(tops, dtype=np.int64)


def set_hashes(w, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of consecutive texts, sorted in each, and the bounds of the texts."""
    n = np.diff(w.first)
    g = ngrams(w.hash, k)
    ok = np.zeros(len(w.hash), dtype=bool)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        ok[a : max(a, b - k + 1)] = True
    counts = np.maximum(n - k + 1, 0)
    out = g[np.flatnonzero(ok)] if len(g) else np.zeros(0, _U)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        one = np.array([ngrams(w.hash[w.first[i] : w.first[i + 1]], int(n[i]))[0] for i in short], dtype=_U)
        out = np.insert(out, np.cumsum(counts)[short], one)
        counts[short] = 1
    bounds = np.concatenate([[0], np.cumsum(counts)])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[a:b].sort()
    text = np.repeat(np.arange(len(counts)), counts)
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    sizes = np.bincount(text[keep], minlength=len(counts))
    return out[keep], np.concatenate([[0], np.cumsum(sizes)])


class Sketcher:
    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.tops = band_tops(den, num)
        #: One more than the differences of two linked sets whose smaller one is in the band, and the segments.
        self.need = np.maximum(self.tops * (den - num) // num + 1, 1)
        self.parts = -(-self.need * 5 // 4)

    def bands(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band of each size, and whether it reaches into the band below."""
        b = np.searchsorted(self.tops, n)
        below = np.maximum(b - 1, 0)
        return b, (b > 0) & (self.num * n <= self.den * self.tops[below])

    def emitted(self, n: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All emissions, those of the sets' own bands first: row, indices of its shingles one after the other, bounds of these, band."""
        band, lower = self.bands(n)
        rows = np.concatenate([np.flatnonzero(n), np.flatnonzero(lower & (n > 0))])
        at = np.concatenate([band[n > 0], (band - 1)[lower & (n > 0)]])
        return rows, _runs(bounds[:-1][rows], n[rows]), np.concatenate([[0], np.cumsum(n[rows])]), at

    def segments(self, x: np.ndarray, bounds: np.ndarray, band: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Segment values (32-bit) of each set for the given band, and their bounds; 0 for segments that are no keys.

        Segments with one shingle or none say little. A set leaves them out if those that
        remain are at least ``need``: a linked set differs in fewer, so one of them is equal.
        """
        parts = self.parts[band]
        base = np.concatenate([[0], np.cumsum(parts)])
        size = np.diff(bounds)
        bit = mix64(x + _U(level * 0x632BE59BD9B4E019 + 0x1F83D9ABFB41BD6B & (2**64 - 1)))
        at = np.repeat(base[:-1], size) + (bit >> _U(24)).astype(np.int64) % np.repeat(parts, size)
        v = np.zeros(int(base[-1]), dtype=np.uint32)
        np.bitwise_xor.at(v, at, (bit * _U(0x9E3779B97F4A7C15) >> _U(32)).astype(np.uint32))
        v[v == 0] = 1
        told = np.bincount(at, minlength=len(v)) > 1
        some = np.add.reduceat(told.astype(np.int64), base[:-1]) if len(band) else np.zeros(0, np.int64)
        v[~told & np.repeat(some >= self.need[band], parts)] = 0
        return v, base

    def keys(self, v: np.ndarray, base: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Join keys of the segments; the caller drops those with v = 0."""
        size = np.diff(base)
        seg = np.arange(len(v)) - np.repeat(base[:-1], size)
        code = v.astype(_U) | seg.astype(_U) << _U(32)
        return mix64(code * _U(0xD6E8FEB86659FD93) + np.repeat(band, size).astype(_U) * _U(0xA24BAED4963EE407)).view(np.int64)


def _runs(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices at[i], at[i] + 1, ... of size[i] each, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _dense(x: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Parity sketches of 2**j >= max(256, 2 * size) bits; a larger one folds to a smaller one by XOR of its parts."""
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        bits = 1 << max(8, int(2 * (b - a) - 1).bit_length())
        p = (x[a:b] & _U(bits - 1)).astype(np.int64)
        out.append(np.packbits((np.bincount(p, minlength=bits) & 1).astype(bool), bitorder="little").tobytes())
    return out


def _profile(num: int, den: int, k: int):
    """doc_id, row, n, h1, h2 and the segments (32 bits each, for the set's band, then for the band below if it reaches there); columns doc_id, text, row."""

    def run(batches):
        scan, sk = Scanner("space"), Sketcher(num, den)
        for b in batches:
            for i, j, data, offs in chunks(b.column(1)):
                x, bounds = set_hashes(scan.scan(data, offs), k)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                h1, h2 = np.zeros(len(n), _U), np.zeros(len(n), _U)
                if len(full):
                    h1[full] = np.add.reduceat(mix64(x ^ _U(0x5851F42D4C957F2D)), bounds[:-1][full])
                    h2[full] = np.bitwise_xor.reduceat(mix64(x + _U(0x14057B7EF767814F)), bounds[:-1][full])
                rows, idx, sizes, band = sk.emitted(n, bounds)
                v, base = sk.segments(x[idx], sizes, band, 0)
                each = np.bincount(rows, weights=np.diff(base), minlength=len(n)).astype(np.int64)
                ends = 4 * np.cumsum(each)
                order = np.argsort(rows, kind="stable")
                raw = v[_runs(base[:-1][order], np.diff(base)[order])].astype("<u4").tobytes()
                parts = [raw[e - 4 * m : e] for e, m in zip(ends.tolist(), each.tolist(), strict=True)]
                cols = [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(n, pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(parts, pa.binary()), pa.array(_dense(x, bounds), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "n", "h1", "h2", "parts", "dense"])

    return run


def _sets(k: int):
    """(rid, set) of the texts whose set has the expected hashes; columns text, n, h1, h2, rid."""

    def run(batches):
        scan = Scanner("space")
        for b in batches:
            for i, j, data, offs in chunks(b.column(0)):
                x, bounds = set_hashes(scan.scan(data, offs), k)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                h1, h2 = np.zeros(len(n), _U), np.zeros(len(n), _U)
                if len(full):
                    h1[full] = np.add.reduceat(mix64(x ^ _U(0x5851F42D4C957F2D)), bounds[:-1][full])
                    h2[full] = np.bitwise_xor.reduceat(mix64(x + _U(0x14057B7EF767814F)), bounds[:-1][full])
                want = [np.asarray(b.column(c).slice(i, j - i)) for c in (1, 2, 3)]
                same = np.flatnonzero((n == want[0]) & (h1.view(np.int64) == want[1]) & (h2.view(np.int64) == want[2]))
                raw = x.tobytes()
                blobs = [raw[8 * bounds[r] : 8 * bounds[r + 1]] for r in same.tolist()]
                yield pa.RecordBatch.from_arrays([b.column(4).slice(i, j - i).take(pa.array(same)), pa.array(blobs, pa.binary())], names=["rid", "set"])

    return run


def _keys_of_parts(num: int, den: int, turns: int = 1, turn: int = 0):
    """(key, rid, and comp if given) of all segments, or of those whose keys have this of several turns; columns rid, n, parts and perhaps comp."""

    def run(batches):
        sk = Sketcher(num, den)
        for b in batches:
            n = b.column(1).to_numpy()
            band, lower = sk.bands(n)
            data, offs = utf8(b.column(2))
            v = np.frombuffer(np.ascontiguousarray(data), dtype="<u4")
            own = sk.parts[band]
            for rows, at, start in ((np.arange(len(n)), band, offs[:-1] // 4), (np.flatnonzero(lower), (band - 1)[lower], (offs[:-1] // 4 + own)[lower])):
                size = sk.parts[at]
                u = v[_runs(start, size)]
                key = sk.keys(u, np.concatenate([[0], np.cumsum(size)]), at)
                told = (u > 0) & (key.view(_U) % _U(turns) == turn)
                if len(key):
                    own_cols = [pa.array(np.repeat(b.column(c).to_numpy()[rows], size)[told]) for c in (0, 3)[: b.num_columns - 2]]
                    yield pa.RecordBatch.from_arrays([pa.array(key[told]), *own_cols], names=["key", "rid", "comp"][: 1 + len(own_cols)])

    return run


def _keys_of_sets(num: int, den: int, level: int):
    """(key, rid, comp) of all segments of another hash, within a bucket; columns rid, set, bucket, comp."""

    def run(batches):
        sk = Sketcher(num, den)
        for b in batches:
            for i, j, data, offs in chunks(b.column(1)):
                rid, bucket, comp = (b.column(c).to_numpy()[i:j] for c in (0, 2, 3))
                x, bounds = np.frombuffer(np.ascontiguousarray(data), dtype=_U), offs // 8
                rows, idx, sizes, band = sk.emitted(np.diff(bounds), bounds)
                v, base = sk.segments(x[idx], sizes, band, level)
                per = np.diff(base)
                key = mix64(sk.keys(v, base, band).view(_U) + np.repeat(bucket[rows], per).view(_U) * _U(0x9FB21C651E98DF25))
                told = v > 0
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)[told]), *(pa.array(np.repeat(x[rows], per)[told]) for x in (rid, comp))], names=["key", "rid", "comp"])

    return run


def _stars(batches):
    """(rid, lead) for all members of a bucket but its lead: the given one, else the first; rows (key, rid, lead) come sorted by key, then rid."""
    last_key = last_lead = None
    for b in batches:
        key, rid = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(key):
            continue
        given = np.asarray(b.column(2).is_valid())
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = last_key is None or key[0] != last_key
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        lead = np.where(at >= 0, rid[np.maximum(at, 0)], last_lead if last_lead is not None else 0)
        last_key, last_lead = key[-1], lead[-1]
        if given.any():
            lead = np.where(given, np.asarray(b.column(2).fill_null(0)), lead)
        w = np.flatnonzero(lead != rid)
        if len(w):
            yield pa.RecordBatch.from_arrays([pa.array(rid[w]), pa.array(lead[w])], names=["rid", "lead"])


def _cross(listed: int):
    """Cross pairs of buckets with several components, as (kind 0, x, y), or their members as (kind 1, key, rid), if more than ``listed`` or hot.

    Columns key, rid, comp, hot, sorted by key.
    """

    def group(key, rid, comp):
        m = len(rid)
        _, c = np.unique(comp, return_counts=True)
        if len(c) < 2:
            return None
        pairs = (m * m - int((c.astype(np.int64) ** 2).sum())) // 2
        if pairs > listed:
            return np.ones(m, np.int8), np.full(m, key), rid
        i, j = np.triu_indices(m, 1)
        w = comp[i] != comp[j]
        x, y = rid[i[w]], rid[j[w]]
        return np.zeros(len(x), np.int8), np.minimum(x, y), np.maximum(x, y)

    def out(parts):
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "x", "y"])

    def run(batches):
        held: list = []
        over, pending = False, 0
        for b in batches:
            key, rid, comp = (b.column(i).to_numpy() for i in range(3))
            hot = np.asarray(b.column(3))
            if hot.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(int(hot.sum()), np.int8)), pa.array(key[hot]), pa.array(rid[hot])], names=["kind", "x", "y"])
                key, rid, comp = key[~hot], rid[~hot], comp[~hot]
            if not len(key):
                continue
            cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            ends = np.append(cut[1:], len(key))
            parts = []
            for a, e in zip(cut.tolist(), ends.tolist(), strict=True):
                if held and held[0][0][0] != key[a]:
                    k, r, c = (np.concatenate(z) for z in zip(*held, strict=True))
                    if over:
                        parts.append((np.ones(len(r), np.int8), k, r))
                    elif (g := group(k[0], r, c)) is not None:
                        parts.append(g)
                    held, over, pending = [], False, 0
                if e < len(key):
                    if not held:
                        if e - a > 1 and (g := group(key[a], rid[a:e], comp[a:e])) is not None:
                            parts.append(g)
                        continue
                held.append((key[a:e], rid[a:e], comp[a:e]))
                pending += e - a
                if pending > HELD:  # a bucket of more members than a task holds: pass them on
                    k, r, c = (np.concatenate(z) for z in zip(*held, strict=True))
                    parts.append((np.ones(len(r) - 1, np.int8), k[1:], r[1:]))
                    held, over, pending = [(k[:1], r[:1], c[:1])], True, 1
            if parts:
                yield out(parts)
        if held:
            k, r, c = (np.concatenate(z) for z in zip(*held, strict=True))
            g = (np.ones(len(r), np.int8), k, r) if over else group(k[0], r, c)
            if g is not None:
                yield out([g])

    return run


def _fold(blob: bytes, size: int) -> np.ndarray:
    a = np.frombuffer(blob, dtype=np.uint8).reshape(-1, size)
    return np.bitwise_xor.reduce(a, axis=0)


def _thin(batches):
    """rid, n and the sketch folded once, down to 256 bits: about as many bits as shingles. Folded ones differ in no more places, so no link is lost, and ``_near`` looks again at the whole ones."""
    for b in batches:
        dense = [_fold(d, max(32, len(d) // 2)).tobytes() for d in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dense, pa.binary())], names=["rid", "n", "dense"])


def _filtered(num: int, den: int, forest: bool):
    """Cross pairs of large buckets that pass the size and Hamming filters; columns key, grp, rid, comp, n, dense, other, sorted by key and grp.

    Rows with ``other`` meet rows without it only, if a group has both.
    ``forest``: of a group with more such pairs than members only those that join parts
    which no pair so far has joined, and a row (key, null) that tells so; else all.
    """

    def coarse(dense, size):
        """Bits of the sketches folded to ``size`` bytes: they differ in no more places than the sketches do."""
        folded = np.bitwise_xor.reduce(dense.view(np.uint8).reshape(len(dense), -1, size), axis=1)
        return np.unpackbits(folded, axis=1).astype(np.float32)

    def near(a, b):
        (ca, na, da, fa), (cb, nb, db, fb) = a, b
        step = max(64, STEP // (8 * da.shape[1]))
        small, large = np.minimum(na[:, None], nb[None]), np.maximum(na[:, None], nb[None])
        ham = fa.sum(axis=1)[:, None] + fb.sum(axis=1)[None] - 2 * (fa @ fb.T)
        w = (ca[:, None] != cb[None]) & (num * large <= den * small)
        i, j = np.nonzero(w & (ham <= (small + large) * (den - num) // (den + num)))
        for s in range(0, len(i), step):
            p, q = i[s : s + step], j[s : s + step]
            ham = np.bitwise_count(da[p] ^ db[q]).sum(axis=1, dtype=np.int64)
            w = ham * (den + num) <= (na[p] + nb[q]) * (den - num)
            yield p[w], q[w]

    def group(key, parts):
        rid, comp, n, other = (np.concatenate([x[i] for x in parts]) for i in range(4))
        blobs = [d for x in parts for d in x[4]]
        size = min(map(len, blobs))
        dense = np.stack([_fold(d, size) for d in blobs]).view(np.uint64)
        up: dict[int, int] = {}

        def find(x):
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        whole, kept = forest, []
        split = other.any() and not other.all()
        rows = np.arange(len(rid))
        width = min(size, COARSE // 8, max(8, (1 << int(n.max() - 1).bit_length()) // 8))  # about as many bits as the sets have shingles
        sides = (rows[~other], rows[other]) if split else (rows, rows)
        for a in range(0, len(sides[0]), 1000):
            for b in range(0 if split else a, len(sides[1]), 1000):
                one, two = sides[0][a : a + 1000], sides[1][b : b + 1000]
                for p, q in near(*((comp[x], n[x], dense[x], coarse(dense[x], width)) for x in (one, two))):
                    p, q = one[p], two[q]
                    if not split:  # a block meets itself both ways
                        p, q = p[p < q], q[p < q]
                    if whole:
                        kept.append((p, q))
                        if sum(len(x) for x, _ in kept) <= len(rid):
                            continue
                        whole = False
                        p, q = (np.concatenate(x) for x in zip(*kept, strict=True))
                    if forest:
                        keep = []
                        for k, (x, y) in enumerate(zip(comp[p].tolist(), comp[q].tolist(), strict=True)):
                            x, y = find(x), find(y)
                            if x != y:
                                up[max(x, y)] = min(x, y)
                                keep.append(k)
                        p, q = p[keep], q[keep]
                    if len(p):
                        x, y = rid[p], rid[q]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["x", "y"])
                if forest and up:
                    comp = np.array([find(c) for c in comp.tolist()])
        if forest:
            p, q = (np.concatenate(x) for x in zip(*kept, strict=True)) if whole and kept else (rows[:0], rows[:0])
            x, y = pa.array(np.minimum(rid[p], rid[q])), pa.array(np.maximum(rid[p], rid[q]))
            if len(p) or not whole:
                yield pa.RecordBatch.from_arrays([x, y] if whole else [pa.array([key]), pa.array([None], pa.int64())], names=["x", "y"])

    def run(batches):
        last, held = None, []
        for b in batches:
            key, grp, rid, comp, n = (b.column(i).to_numpy() for i in range(5))
            if not len(key):
                continue
            other = np.asarray(b.column(6))
            dense = [d if len(d) <= FOLD else _fold(d, FOLD).tobytes() for d in b.column(5).to_pylist()]
            cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (grp[1:] != grp[:-1])))
            for a, e in zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True):
                if held and last != (key[a], grp[a]):
                    yield from group(last[0], held)
                    held = []
                last = key[a], grp[a]
                held.append((rid[a:e], comp[a:e], n[a:e], other[a:e], dense[a:e]))
        if held:
            yield from group(last[0], held)

    return run


def _verify(num: int, den: int):
    """(a, b) of the pairs that link; rows come sorted by pair and rid: x, y, rid, set; both of a pair, and any of them again."""

    def run(batches):
        last = None
        for b in batches:
            xs, ys, rids, sets = *(b.column(i).to_pylist() for i in range(3)), b.column(3)
            got = []
            for x, y, rid, s in zip(xs, ys, rids, sets, strict=True):
                if last is None or last[:2] != (x, y):
                    last = (x, y, rid, s.as_py())
                elif last[2] != rid:
                    p, q = np.frombuffer(last[3], _U), np.frombuffer(s.as_py(), _U)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if den * both >= num * (len(p) + len(q) - both):
                        got.append((x, y))
                    last = (x, y, rid, b"")
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _close(num: int, den: int):
    """(x, y) of the pairs whose dense sketches are near enough; rows come sorted by pair, two a pair: x, y, n, dense."""

    def run(batches):
        last = None
        for b in batches:
            got = []
            for x, y, n, p in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if last is None:
                    last = (n, p)
                    continue
                (m, q), last = last, None
                size = min(len(p), len(q))
                if num * max(n, m) <= den * min(n, m) and int(np.bitwise_count(_fold(p, size) ^ _fold(q, size)).sum()) * (den + num) <= (n + m) * (den - num):
                    got.append((x, y))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)], names=["x", "y"])

    return run


def _sides(pairs: DataFrame, values: DataFrame, cols: list[str]) -> DataFrame:
    """x, y, rid and ``cols`` of ``values`` (by rid) for both of each pair, the rows of a pair in one task and in order; few pairs go to the values."""
    sides = written(pairs.select("x", "y", F.explode(F.array("x", "y")).alias("rid")))
    n = sides.count()
    both = joined_small(values, sides, "rid", n).select("x", "y", "rid", *cols)
    return both.repartition("x", "y").sortWithinPartitions("x", "y", "rid").coalesce(n // SIDES + 1)


def _near(pairs: DataFrame, dense: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) whose sketches are near enough, written."""
    return written(_sides(pairs, dense, ["n", "dense"]).drop("rid").mapInArrow(_close(num, den), "x long, y long"))


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) whose sets link, as (a, b)."""
    return _sides(pairs, sets, ["set"]).mapInArrow(_verify(num, den), "a long, b long")


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, that has at most ``rows`` narrow rows, in no more tasks than they need."""
    return df.coalesce(rows // EDGES + 1)


def _labelled(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, rows["rid"] == comps["id"], "left").select(*rows.columns, F.coalesce("comp", "rid").alias("comp"))


def _hot_keys(sample: DataFrame) -> DataFrame:
    """(key, lead) of the keys that ``sample`` (key, rid) holds most often, at most four a shuffle partition; written.

    By their number, every key that fills a quarter of a mean partition is among them,
    but for chance in the sample: that costs time only.
    """
    most = 4 * int(sample.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = sample.groupBy("key").agg(F.count("*").alias("c"), F.min("rid").alias("lead")).where(F.col("c") >= HOT)
    return written(counts.orderBy(F.desc("c"), "key").limit(most).select("key", "lead"))


def _sampled(rows: DataFrame) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64("rid"), F.lit(SAMPLE)) == 0)


def _by_key(rows: DataFrame, hot) -> DataFrame:
    """Rows of a key in one task and in order, those of hot keys dealt over many."""
    salt = F.when(hot, F.pmod(F.xxhash64("rid"), F.lit(1 << 20))).otherwise(F.lit(0))
    return rows.repartition("key", salt).sortWithinPartitions("key", "rid")


def _blocks(many: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (key, rid, comp) and, for keys with cross pairs, key, main (its largest component), p (cross pairs), na and nb (blocks of that and of the others; 0: one group)."""
    lab = written(_labelled(many, comps).select("key", "rid", "comp"))
    c = F.col("c").cast("double")
    load = lab.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key")
    load = load.agg(F.max(F.struct("c", "comp")).alias("x"), F.sum("c").alias("m"), F.sum(c * c).alias("q"))
    m = F.col("m").cast("double")
    n = lambda size: F.when(F.col("m") <= BLOCK, F.lit(0)).otherwise(F.ceil(size / F.lit(BLOCK))).cast("long")
    load = load.select("key", F.col("x.comp").alias("main"), ((m * m - F.col("q")) / 2).alias("p"), n(F.col("x.c")).alias("na"), n(F.col("m") - F.col("x.c")).alias("nb"))
    return lab, written(_few(load.where("p > 0"), lab.count()))


def _groups(lab: DataFrame, load: DataFrame) -> DataFrame:
    """key, grp, rid, comp, other: every cross pair of a key meets in a group, each of at most two blocks."""
    rows = joined_small(lab, load, "key", load.count())
    out, na, nb = F.col("comp") != F.col("main"), F.greatest("na", F.lit(1)), F.greatest("nb", F.lit(1))
    a, b = F.pmod(F.xxhash64("rid"), na), F.pmod(F.xxhash64("rid", F.lit(1)), nb)
    of_main = F.transform(F.sequence(F.lit(0).cast("long"), nb - 1), lambda y: a * nb + y)
    of_out = F.transform(F.sequence(F.lit(0).cast("long"), na - 1), lambda y: y * nb + b)
    among = F.transform(F.sequence(F.lit(0).cast("long"), nb - 1), lambda y: -1 - (F.least(b, y) * nb + F.greatest(b, y)))
    grp = F.when(F.col("na") == 0, F.array(F.lit(0).cast("long"))).when(out, F.concat(of_out, among)).otherwise(of_main)
    rows = rows.select("key", "rid", "comp", (out & (F.col("na") > 0)).alias("out"), F.explode(grp).alias("grp"))
    return rows.select("key", "grp", "rid", "comp", (F.col("out") & (F.col("grp") >= 0)).alias("other"))


def _rounds(groups: DataFrame, dense: DataFrame, room: int) -> list[DataFrame]:
    """The rows of ``groups`` (written) with n and the sketch, in rounds of about ``room`` bytes of sketches; a group lies in one round."""
    sent = groups.join(dense.select("rid", F.octet_length("dense").alias("o")), "rid").agg(F.sum("o")).first()[0] or 0
    k = max(1, -(-sent // max(room, 1)))
    turn = F.pmod(F.xxhash64("key", "grp"), F.lit(k))
    cols = ["key", "grp", "rid", "comp", "n", "dense", "other"]
    return [groups.where(turn == i).join(dense, "rid").select(*cols) for i in range(k)]


def _component_ids(named: DataFrame) -> DataFrame:
    """h1, h2, comp and component_id of classes (written: rid, comp, doc_id, h1, h2); large components by broadcast, the others by a join on comp."""
    least = written(named.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("c")))
    large = least.where(F.col("c") > BLOCK).select("comp", F.col("component_id").alias("one"), F.lit(True).alias("is_large"))
    rows = joined_small(named, large, "comp", large.count(), "left")
    done = rows.where("is_large").select("h1", "h2", "comp", F.col("one").alias("component_id"))
    rest = rows.where("is_large IS NULL").select("h1", "h2", "comp").join(least.select("comp", "component_id"), "comp")
    return done.union(rest.select("h1", "h2", "comp", "component_id"))


def link_components(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, row, n_shingles, comp (a number of the component's own; null without shingles), component_id.

    Two rows link when den * |intersection| >= num * |union| of their sets of ``shingle``
    words. ``row_col``: a long that tells all rows apart whenever ``docs`` is read; without
    it doc_id and text are written once more, with a number.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cols = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    docs = written(docs.select(*cols, F.monotonically_increasing_id().alias("row"))) if row_col is None else docs.select(*cols, F.col(row_col).alias("row"))
    profile = docs.mapInArrow(_profile(num, den, shingle), "doc_id long, row long, n long, h1 long, h2 long, parts binary, dense binary")
    profile = written(profile.withColumn("rid", F.monotonically_increasing_id()))
    first = F.min(F.struct("rid", "row")).alias("x")
    classes = profile.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), first)
    classes = written(classes.select("h1", "h2", "doc_id", "n", "x.rid", "x.row"))
    dense = profile.select("rid", "n", "dense")
    held = profile.agg(*[F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in ("parts", "dense")]).first()
    room = max(LEAST, ROOM * sum(held))
    turns = -(-held[0] // 4 * ROW // room) or 1

    def keys_of(which: DataFrame, part=lambda rows: rows, *turn: int) -> DataFrame:
        rows = part(profile.select("rid", "n", "parts")).join(which.select("rid"), "rid", "left_semi")
        return rows.mapInArrow(_keys_of_parts(num, den, *turn), "key long, rid long")

    def sets_of(which: DataFrame) -> DataFrame:
        """rid, set; a row number that stands for two rows may give a set twice. Texts stay where they are if few are wanted."""
        which = written(which.select("n", "h1", "h2", "rid", "row"))
        hit = joined_small(docs.select("text", "row"), which, "row", which.count())
        return hit.select("text", "n", "h1", "h2", "rid").mapInArrow(_sets(shingle), "rid long, set binary")

    hot = _hot_keys(keys_of(classes, _sampled))
    stars = None
    for turn in range(turns):
        rows = keys_of(classes, lambda rows: rows, turns, turn).join(F.broadcast(hot), "key", "left").select("key", "rid", "lead")  # at most four rows a partition
        found = _by_key(rows, F.col("lead").isNotNull()).mapInArrow(_stars, "rid long, lead long")
        found = written(found.groupBy("rid", "lead").agg(F.count("*").alias("m")))
        stars = found if stars is None else stars.union(found)
        release(spark)
    if turns > 1:
        stars = written(stars.groupBy("rid", "lead").agg(F.sum("m").alias("m")))
        release(spark)
    involved = stars.select("rid").union(stars.select("lead")).distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = _near(pairs, dense, num, den)
        ids = pairs.select(F.col("x").alias("rid")).union(pairs.select("y")).distinct()
        sets = written(sets_of(classes.join(ids, "rid", "left_semi")))
        release(spark)
        found = written(_linked(pairs, sets, num, den))
        release(spark)
        return found

    # the partners with most common segments
    best = stars.groupBy("rid", F.pmod(F.xxhash64("lead"), F.lit(64))).agg(F.max(F.struct("m", "lead")).alias("b"))
    best = best.groupBy("rid").agg(F.slice(F.reverse(F.array_sort(F.collect_list("b"))), 1, LEADS).alias("b")).select("rid", F.explode("b.lead").alias("lead"))
    links = verified(best.select(F.least("rid", "lead").alias("x"), F.greatest("rid", "lead").alias("y")).distinct())
    comps = written(components(links, EDGES, links.count()))
    release(spark)

    # members get their component before their keys are made
    inside = written(_labelled(involved, comps).select("rid", "comp"))
    rows = joined_small(profile.select("rid", "n", "parts", "dense"), inside, "rid", inside.count())
    thin = written(rows.select("rid", "n", "dense").mapInArrow(_thin, "rid long, n long, dense binary"))
    makes = rows.select("rid", "n", "parts", "comp")
    made = [makes.mapInArrow(_keys_of_parts(num, den, turns, turn), "key long, rid long, comp long") for turn in range(turns)]
    rows = makes.mapInArrow(_keys_of_parts(num, den), "key long, rid long, comp long")
    for level in range(4):
        if level:
            hot = _hot_keys(_sampled(rows))
        if not hot.isEmpty():  # hot keys of one component have no cross pairs; the others go to the blocks
            ends = rows.join(F.broadcast(hot.select("key")), "key").groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"))
            flags = F.broadcast(written(hot.select("key").join(ends, "key").select("key", (F.col("a") < F.col("b")).alias("hot"))))
            told = lambda rows: rows.join(flags, "key", "left").where("hot IS NULL OR hot")  # noqa: B023, E731
        else:
            told = lambda rows: rows.withColumn("hot", F.lit(None).cast("boolean"))
        out = None
        for rows in [rows] if level else made:
            rows = told(rows).select("key", "rid", "comp", F.coalesce("hot", F.lit(False)).alias("hot"))
            found = written(_by_key(rows, F.col("hot")).mapInArrow(_cross(PLAIN), "kind byte, x long, y long"))
            out = found if out is None else out.union(found)
            release(spark)
        pairs = out.where("kind = 0").select("x", "y")
        many = out.where("kind = 1").select(F.col("x").alias("key"), F.col("y").alias("rid"))
        lab, load = _blocks(many, comps)
        huge = load.where(F.col("p") > FILTERED) if level < 3 else load.limit(0)
        load = load.where(F.col("p") <= FILTERED) if level < 3 else load
        for forest in (True, True, False):
            near = pairs
            for rows in _rounds(written(_groups(lab, load)), thin, room):
                rows = rows.repartition("key", "grp").sortWithinPartitions("key", "grp")
                near = near.union(written(rows.mapInArrow(_filtered(num, den, forest), "x long, y long")))
                release(spark)
            listed = near.count()
            found = verified(written(_few(near.where("y IS NOT NULL").distinct(), listed)))
            links = links.union(found)
            if forest:
                comps = written(components(links, EDGES, links.count()))
                links = comps.select(F.col("id").alias("a"), F.col("comp").alias("b"))  # the same parts
                cut = written(_few(near.where("y IS NULL").select(F.col("x").alias("key")).distinct(), listed))
                if cut.isEmpty():
                    break
                pairs, here = pairs.limit(0), joined_small(lab.select("key", "rid"), cut, "key", cut.count(), "left_semi")
                lab, load = _blocks(here, comps)
                if load.isEmpty():
                    break
        if huge.isEmpty():
            break
        more = written(_labelled(many.join(huge.select("key"), "key"), comps).select("key", "rid", "comp"))
        sets = sets_of(classes.join(more.select("rid").distinct(), "rid", "left_semi"))
        rows = written(more.join(sets, "rid").select("rid", "set", "key", "comp").mapInArrow(_keys_of_sets(num, den, level + 1), "key long, rid long, comp long"))

    comps = written(components(links, EDGES, links.count()))
    named = written(_labelled(classes, comps).select("rid", "comp", "doc_id", "h1", "h2"))
    out = profile.select("doc_id", "row", "n", "h1", "h2").join(_component_ids(named), ["h1", "h2"], "left")
    comp = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), "comp", comp.alias("component_id"))


def op5_ngram_join(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    row = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("row")  # two rows with one number do no harm
    docs = docs.select("doc_id", "text", row)
    return link_components(docs, shingle=4, num=85, den=100, row_col="row").select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 4) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE z AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, z.root FROM z JOIN e ON e.a = z.id) SELECT id, min(root) AS root FROM z GROUP BY id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.root AS component_id FROM w JOIN r ON r.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
