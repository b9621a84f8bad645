"""MinHash near-duplicates with odd sketches.

A document is the set of its distinct word shingles. ``BANDS * ROWS`` MinHash samples
are taken of it: the smallest value under as many multiplicative hashes. Two uses:

- Bands of ``ROWS`` samples are the join keys. Two sets of similarity s share none of
  them with probability (1 - s**ROWS)**BANDS, which is below ``MISS`` at the similarity
  asked for; ``bands`` makes as many as that takes.
- All samples are folded into an odd sketch: each flips one of ``BITS`` bits. Samples
  that agree cancel out in the XOR of two sketches, so its population count tells how
  many differ, most precisely where few do. ``sketch_limit`` is the count that two sets
  of the similarity asked for exceed with probability below ``MISS``, from the exact
  distribution. Candidates beyond it are dropped without a look at their sets.

A second, fine sketch of ``FINE_BITS`` bits folds the ``FINE`` smallest hashes of the set
(a MinHash sample without replacement) and is used where buckets hold many near misses.
Up to ``FINE`` shingles it folds the whole set, and the count cannot exceed the symmetric
difference; beyond, ``fine_limit`` adds Bernstein's bound for sampling.

What passes is confirmed on the full shingle sets, so no false link is made; the
chances to miss one are below 10**-9 each for a pair.

Equal sets are one class throughout. In a bucket each member meets the first member
only; each class verifies the one of these partners whose sketch is nearest, and
verified pairs are connected. Pairs of one component need no look. What is left are
buckets whose members lie in several components: few cross pairs are listed, many are
compared by both sketches in blocks of two times ``BLOCK`` members, first for pairs that
join parts, then, after these are verified and connected, for all that remain. Hot keys get
their first member by broadcast and are dealt over many tasks, as in the n-gram join,
whose bucket plumbing this module uses. Nothing of the corpus goes to the driver.

Defined results: A-Z count as a-z; words are runs without ASCII white space; with
fewer words than a shingle has, the whole sequence is one shingle; null, empty and
blank texts have no shingle, link with nothing and are kept; very long texts are read
whole; of rows that repeat a doc_id all have one component and are kept or dropped
together; null ids link like others, never name a component unless it has no other,
and are kept only in that case; ties do not arise, as the smallest id names; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, release, small_batches, written
from .ngramjoin import _blocks, _by_key, _component_ids, _cross, _groups, _hot_keys, _labelled, _linked, _sampled, _stars, set_hashes
from .textscan import Scanner, chunks, mix64

#: Samples of a band, bits of a sketch, and the chance to miss a pair at the similarity asked for.
ROWS, BITS, MISS = 5, 512, 1e-9
#: Cross pairs of a bucket that are listed without comparing sketches first, and members compared at once.
PLAIN, TILE = 64, 256
#: Hashes and bits of a fine sketch.
FINE, FINE_BITS = 1024, 4096
#: Edges that a task takes when components are found; links are few beside the texts.
EDGES = 100_000
_U, _U4 = np.uint64, np.uint32


def bands(s: float) -> int:
    """Bands that two sets of similarity ``s`` all miss with probability below ``MISS``."""
    return math.ceil(math.log(MISS) / math.log1p(-(s**ROWS)))


def sketch_limit(s: float, samples: int) -> int:
    """The population count that the XOR of the sketches of two sets of similarity ``s`` exceeds with probability below ``MISS``."""
    m = np.arange(samples + 1)
    logs = np.array([math.lgamma(x + 1) for x in range(samples + 1)])
    differ = np.exp(logs[-1] - logs[m] - logs[samples - m] + m * math.log(1 - s) + (samples - m) * math.log(s)) if s < 1 else (m == 0).astype(float)
    odd = np.zeros(BITS + 1)  # chance of each number of odd bits, flip by flip
    odd[0] = 1
    k, total = np.arange(BITS + 1), np.zeros(BITS + 1)
    for i in range(samples + 1):
        total += differ[i] * odd
        for _ in range(2):  # a sample that differs flips a bit of either sketch
            nxt = np.zeros(BITS + 1)
            nxt[1:] += (odd * (BITS - k) / BITS)[:-1]
            nxt[:-1] += (odd * k / BITS)[1:]
            odd = nxt
    over = np.cumsum(total[::-1])[::-1]  # chance of at least k odd bits
    return int(np.argmax(over < MISS)) - 1 if (over < MISS).any() else BITS


def multipliers(n: int) -> np.ndarray:
    """Odd 32-bit factors, spread by a mixing function."""
    return (mix64(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) >> _U(32)).astype(_U4) | _U4(1)


def samples(x: np.ndarray, bounds: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash samples, one row a factor and one column a set; all sets have shingles."""
    top, start = (x >> _U(32)).astype(_U4), bounds[:-1]
    out = np.empty((len(factors), len(start)), _U4)
    for i, a in enumerate(factors):
        out[i] = np.minimum.reduceat(top * a, start)
    return out


def band_keys(got: np.ndarray) -> np.ndarray:
    """Keys of the bands of each set: one row a set."""
    n = got.shape[0] // ROWS
    k = np.repeat(np.arange(1, n + 1, dtype=_U)[:, None] * _U(0xA24BAED4963EE407), got.shape[1], axis=1)
    for r in range(ROWS):
        k = mix64(k * _U(0xD6E8FEB86659FD93) + got[r * n : (r + 1) * n])
    return k.T.view(np.int64)


def odd_sketches(got: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples: ``BITS`` / 64 numbers a set."""
    h, m = got.shape
    bit = mix64(got.astype(_U) + (np.arange(1, h + 1, dtype=_U) << _U(32))[:, None]) % _U(BITS)
    at = bit.astype(np.int64) + BITS * np.arange(m)
    odd = (np.bincount(at.ravel(), minlength=BITS * m) & 1).astype(bool)
    return np.packbits(odd.reshape(m, BITS), axis=1, bitorder="little").view("<i8")


def fine_sketches(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the ``FINE`` smallest hashes of each set (``x`` is sorted in each): ``FINE_BITS`` / 64 numbers a set."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    w = np.arange(len(x)) - bounds[:-1][row] < FINE
    out = np.zeros((len(bounds) - 1, FINE_BITS // 64), _U)
    bit = x[w] & _U(FINE_BITS - 1)
    np.bitwise_xor.at(out, (row[w], (bit >> _U(6)).astype(np.int64)), _U(1) << (bit & _U(63)))
    return out.view(np.int64)


def fine_limit(num: int, den: int, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The population count that the XOR of the fine sketches of two linked sets of n and m shingles exceeds never, or beyond ``FINE`` shingles with probability below ``MISS``."""
    small, large = np.minimum(n, m), np.maximum(n, m)
    differ = (n + m) * (den - num) // (den + num)
    share = np.clip(1 - num * (n + m) / ((den + num) * np.maximum(large, 1)), 0, 1)  # of the larger set, that the other lacks
    log = -math.log(MISS)
    drawn = FINE * share + log / 3 + np.sqrt(log * log / 9 + 2 * log * FINE * share * (1 - share))
    return np.where(large <= FINE, differ, np.where(small <= FINE, differ + large - FINE, 2 * np.ceil(drawn).astype(np.int64)))


def _digests(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set."""
    full = np.flatnonzero(np.diff(bounds))
    h1, h2 = np.zeros(len(bounds) - 1, _U), np.zeros(len(bounds) - 1, _U)
    if len(full):
        h1[full] = np.add.reduceat(mix64(x ^ _U(0x2545F4914F6CDD1D)), bounds[:-1][full])
        h2[full] = np.bitwise_xor.reduceat(mix64(x + _U(0x632BE59BD9B4E019)), bounds[:-1][full])
    return h1.view(np.int64), h2.view(np.int64)


_PROFILE = "doc_id long, row long, n long, h1 long, h2 long, keys array<long>, sketch array<long>, fine array<long>"


def _lists(values: np.ndarray) -> pa.Array:
    """One list a row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(np.ascontiguousarray(values).ravel()))


def _profile(n_bands: int, k: int):
    """Size, digests, band keys and odd sketch of each text's set; columns doc_id, text, row."""

    def run(batches):
        scan, factors = Scanner("space"), multipliers(n_bands * ROWS)
        for b in batches:
            for i, j, data, offs in chunks(b.column(1)):
                x, bounds = set_hashes(scan.scan(data, offs), k)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                keys, sketch = np.zeros((len(n), n_bands), np.int64), np.zeros((len(n), BITS // 64), np.int64)
                if len(full):
                    got = samples(x, np.append(bounds[:-1][full], bounds[-1]), factors)
                    keys[full], sketch[full] = band_keys(got), odd_sketches(got)
                h1, h2 = _digests(x, bounds)
                cols = [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2), _lists(keys), _lists(sketch), _lists(fine_sketches(x, bounds))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "n", "h1", "h2", "keys", "sketch", "fine"])

    return run


def _sets(k: int):
    """(rid, set) of the texts whose set has the expected digests; columns text, h1, h2, rid."""

    def run(batches):
        scan = Scanner("space")
        for b in batches:
            for i, j, data, offs in chunks(b.column(0)):
                x, bounds = set_hashes(scan.scan(data, offs), k)
                h1, h2 = _digests(x, bounds)
                same = np.flatnonzero((h1 == b.column(1).slice(i, j - i).to_numpy()) & (h2 == b.column(2).slice(i, j - i).to_numpy()))
                raw = x.tobytes()
                blobs = [raw[8 * bounds[r] : 8 * bounds[r + 1]] for r in same.tolist()]
                yield pa.RecordBatch.from_arrays([b.column(3).slice(i, j - i).take(pa.array(same)), pa.array(blobs, pa.binary())], names=["rid", "set"])

    return run


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).view(_U)


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.bitwise_count(p ^ q).sum(axis=-1, dtype=np.int64)


def _close(num: int, den: int, limit: int):
    """(x, y) of the pairs whose sizes and both sketches allow a link; columns x, y and n, sketch, fine of either side."""

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            n, m = b.column(2).to_numpy(), b.column(5).to_numpy()
            ok = (num * np.maximum(n, m) <= den * np.minimum(n, m)) & (_far(_matrix(b.column(3)), _matrix(b.column(6))) <= limit)
            ok &= _far(_matrix(b.column(4)), _matrix(b.column(7))) <= fine_limit(num, den, n, m)
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(ok)) for i in (0, 1)], names=["x", "y"])

    return run


def _near_in_groups(num: int, den: int, limit: int, forest: bool):
    """Cross pairs (x, y) of groups whose sizes and sketches are near enough; columns key, grp, rid, comp, n, sketch, fine, other, sorted by key and grp.

    Rows with ``other`` meet rows without it only, if a group has both. ``forest``: only
    pairs that join parts of the group, fewer than it has members; else all.
    """

    def pairs(parts):
        rid, comp, n, sketch, fine, other = (np.concatenate(c) for c in zip(*parts, strict=True))
        up: dict[int, int] = {}

        def find(x):
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        split = other.any() and not other.all()
        left, right = (np.flatnonzero(~other), np.flatnonzero(other)) if split else (np.arange(len(rid)),) * 2
        for a in range(0, len(left), TILE):
            for b in range(0 if split else a, len(right), TILE):
                i, j = left[a : a + TILE], right[b : b + TILE]
                near = _far(sketch[i][:, None], sketch[j][None]) <= limit
                small, large = np.minimum(n[i][:, None], n[j][None]), np.maximum(n[i][:, None], n[j][None])
                near &= (num * large <= den * small) & (comp[i][:, None] != comp[j][None])
                p, q = np.nonzero(near)
                p, q = i[p], j[q]
                if not split and a == b:
                    p, q = p[p < q], q[p < q]
                w = np.concatenate([_far(fine[p[k : k + 4096]], fine[q[k : k + 4096]]) for k in range(0, len(p) + 1, 4096)])
                w = w <= fine_limit(num, den, n[p], n[q])
                p, q = p[w], q[w]
                if forest:
                    keep = []
                    for k, (x, y) in enumerate(zip(comp[p].tolist(), comp[q].tolist(), strict=True)):
                        x, y = find(x), find(y)
                        if x != y:
                            up[max(x, y)] = min(x, y)
                            keep.append(k)
                    p, q = p[keep], q[keep]
                    if keep:
                        comp = np.array([find(c) for c in comp.tolist()])
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rid[p], rid[q])), pa.array(np.maximum(rid[p], rid[q]))], names=["x", "y"])

    def run(batches):
        last, held = None, []
        for b in batches:
            key, grp, rid, comp, n = (b.column(i).to_numpy() for i in range(5))
            if not len(key):
                continue
            sketch, fine, other = _matrix(b.column(5)), _matrix(b.column(6)), np.asarray(b.column(7))
            cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (grp[1:] != grp[:-1])))
            for a, e in zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True):
                if held and last != (key[a], grp[a]):
                    yield from pairs(held)
                    held = []
                last = key[a], grp[a]
                held.append((rid[a:e], comp[a:e], n[a:e], sketch[a:e], fine[a:e], other[a:e]))
        if held:
            yield from pairs(held)

    return run


def _distance(a: str, b: str) -> Column:
    """Population count of the XOR of two sketches."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64)), F.lit(0))


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, row, n_shingles, component_id, kept.

    Two rows link when den * |intersection| >= num * |union| of their sets of ``shingle``
    words. ``row_col``: a long that tells all rows apart whenever ``docs`` is read; without
    it doc_id and text are written once more, with a number.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    docs = written(docs.select(*cols, F.monotonically_increasing_id().alias("row"))) if row_col is None else docs.select(*cols, F.col(row_col).alias("row"))
    n_bands = bands(num / den)
    limit = sketch_limit(num / den, n_bands * ROWS)
    profile = written(docs.mapInArrow(_profile(n_bands, shingle), _PROFILE).withColumn("rid", F.monotonically_increasing_id()))
    first = F.min(F.struct("rid", "row")).alias("x")
    classes = profile.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), first)
    classes = written(classes.select("h1", "h2", "doc_id", "x.rid", "x.row"))
    sketches = profile.select("rid", "n", "sketch")

    def keys_of(which: DataFrame) -> DataFrame:
        return profile.select("rid", "keys").join(which.select("rid"), "rid", "left_semi").select(F.explode("keys").alias("key"), "rid")

    def near(pairs: DataFrame) -> DataFrame:
        """(x, y, far) of the pairs whose sketches allow a link."""
        one = sketches.select(F.col("rid").alias("x"), F.col("n").alias("m"), F.col("sketch").alias("p"))
        two = sketches.select(F.col("rid").alias("y"), F.col("n").alias("k"), F.col("sketch").alias("q"))
        both = pairs.join(one, "x").join(two, "y").select("x", "y", _distance("p", "q").alias("far"), F.least("m", "k").alias("small"), F.greatest("m", "k").alias("large"))
        return both.where((F.col("far") <= limit) & (num * F.col("large") <= den * F.col("small"))).select("x", "y", "far")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) that link, as (a, b), confirmed on the full sets."""
        pairs = written(pairs)
        ids = pairs.select(F.col("x").alias("rid")).union(pairs.select("y")).distinct()
        hit = docs.select("text", "row").join(classes.join(ids, "rid", "left_semi").select("h1", "h2", "rid", "row"), "row")
        sets = written(hit.select("text", "h1", "h2", "rid").mapInArrow(_sets(shingle), "rid long, set binary").dropDuplicates(["rid"]))
        release(spark)
        found = written(_linked(pairs, sets, num, den))
        release(spark)
        return found

    # each member of a bucket meets its first one; the nearest of these partners is verified
    rows = keys_of(classes)
    hot = _hot_keys(_sampled(rows))
    stars = _by_key(rows.join(F.broadcast(hot), "key", "left").select("key", "rid", "lead"), F.col("lead").isNotNull())  # at most four rows a partition
    stars = written(stars.mapInArrow(_stars, "rid long, lead long").distinct())
    release(spark)
    best = near(stars.select(F.col("rid").alias("x"), F.col("lead").alias("y"))).groupBy("x").agg(F.min(F.struct("far", "y")).alias("b"))
    links = verified(best.select(F.least("x", "b.y").alias("x"), F.greatest("x", "b.y").alias("y")).distinct())
    comps = written(components(links, EDGES))
    release(spark)

    # buckets whose members lie in several components
    involved = stars.select("rid").union(stars.select("lead")).distinct()
    rows = keys_of(involved)
    ends = _labelled(rows.join(F.broadcast(hot.select("key")), "key"), comps).groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"))
    flags = written(hot.select("key").join(ends, "key").select("key", (F.col("a") < F.col("b")).alias("hot")))
    rows = rows.join(F.broadcast(flags), "key", "left").where("hot IS NULL OR hot")
    rows = _labelled(rows, comps).select("key", "rid", "comp", F.coalesce("hot", F.lit(False)).alias("hot"))
    out = written(_by_key(rows, F.col("hot")).mapInArrow(_cross(PLAIN), "kind byte, x long, y long"))
    release(spark)
    listed, many = out.where("kind = 0").select("x", "y").distinct(), out.where("kind = 1").select(F.col("x").alias("key"), F.col("y").alias("rid"))
    ids = listed.select(F.col("x").alias("rid")).union(listed.select("y")).union(many.select("rid")).distinct()
    both = written(profile.select("rid", "n", "sketch", "fine").join(ids, "rid", "left_semi"))
    one, two = (both.select(F.col("rid").alias(r), F.col("n").alias("n" + r), F.col("sketch").alias("s" + r), F.col("fine").alias("f" + r)) for r in ("x", "y"))
    listed = listed.join(one, "x").join(two, "y").select("x", "y", "nx", "sx", "fx", "ny", "sy", "fy").mapInArrow(_close(num, den, limit), "x long, y long")
    for forest in (True, False):
        lab, load = _blocks(many, comps)
        groups = _groups(lab, load).join(both, "rid").select("key", "grp", "rid", "comp", "n", "sketch", "fine", "other")
        groups = groups.repartition("key", "grp").sortWithinPartitions("key", "grp")
        pairs = groups.mapInArrow(_near_in_groups(num, den, limit, forest), "x long, y long")
        links = comps.select(F.col("id").alias("a"), F.col("comp").alias("b")).union(verified(pairs.union(listed).distinct()))
        comps = written(components(links, EDGES))
        listed = listed.limit(0)
        if load.isEmpty():
            break
    named = written(_labelled(classes, comps).select("rid", "comp", "doc_id", "h1", "h2"))
    out = profile.select("doc_id", "row", "n", "h1", "h2").join(_component_ids(named), ["h1", "h2"], "left")
    comp = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def op12_near_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    row = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("row")  # two rows with one number do no harm
    found = near_duplicates(docs.select("doc_id", "text", row), shingle=3, num=85, den=100, row_col="row")
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP12_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 3) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE z AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, z.root FROM z JOIN e ON e.a = z.id) SELECT id, min(root) AS root FROM z GROUP BY id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.root AS component_id, w.doc_id = r.root AS kept FROM w JOIN r ON r.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
