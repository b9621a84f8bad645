"""Token ids as binary files: frequency-ranked ids in byte-aligned variable-length coding.

Texts are tokenised once and the ids written. Every id is counted over all documents
and ids are ranked by falling count (the table has at most one entry per id of the
vocabulary). Each document's ranks are then encoded in 1 to 4 bytes; a separate
control byte holds the lengths of four of them. Documents go by ranges of (doc_id,
number of ids, hash of the ids) to the tasks that write the files, one file a range, in
ascending order; Spark samples the ranges, so many rows of one doc_id, or without one,
are spread too. A file holds about ``FILE_TOKENS`` tokens, fewer while that would leave
tasks idle.

File format, little-endian. A file is a run of blocks of at most about
``BLOCK_TOKENS`` tokens: header ``<4sIQQQ`` (magic FVB1, documents, tokens, control
bytes, data bytes), doc_ids (int64), null flags of doc_ids (uint8), token counts
(int64), control bytes (each document's padded to four tokens), data bytes.
``ranks.bin`` holds the id of each rank (uint32). Files are written under a name of
the attempt's own and renamed, so that a task that runs twice leaves one whole file.

Decoding looks the lengths of a control byte up in a 256 x 4 table, sums them to
offsets and gathers the bytes of all tokens of a block at once.

Tokens come from the ``tokenizers`` library as it is loaded: strings of added tokens in
a text become their ids; ``special_as_text`` makes them ordinary text. A text is cut at
single spaces between other characters, where a byte-level tokenizer always cuts too,
and the ids of pieces that were seen before come from a table of ``SLOTS`` pieces;
texts with the string of an added token go to the library whole.

Defined results: null text counts as empty and gets the end id only; null doc_ids
come first; rows that repeat a doc_id follow each other in order of the number of their
ids, then a hash of these; very long texts are encoded whole, in memory of one text; an
empty table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, written
from .textscan import Scanner, chunks, mix64

BLOCK_TOKENS = 1 << 20
#: Slots of the table of pieces, and tokens that it holds.
SLOTS, POOL = 1 << 21, 8 << 20
#: Tokens of a file, and tokens below which no more files are made to keep tasks busy.
FILE_TOKENS, LEAST_TOKENS = 1 << 26, 1 << 20
HEADER = "<4sIQQQ"
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def _worker_memory() -> dict:
    """A dictionary that outlives the task in its Python worker; only speeds up."""
    return sys.modules.setdefault("_tessera_worker_memory", types.ModuleType("_tessera_worker_memory")).__dict__


class Encoder:
    """Token ids of whole texts, an end id after each.

    For a byte-level tokenizer without normaliser, texts are cut at single spaces and
    the ids of pieces are kept in a direct-mapped table by the pieces' 64-bit hashes;
    pieces that aren't there are encoded many at a time, joined, and parted again at
    the tokens that begin with a space. Other tokenizers get whole texts.
    """

    def __init__(self, path: str, end_id: int, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.end = end_id
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        kind = json.loads(self.tok.to_str())
        added = [t for t in kind.get("added_tokens") or [] if not (special_as_text and t["special"])]
        self.added = [t["content"].encode() for t in added]
        pre = kind.get("pre_tokenizer") or {}
        self.cuts = kind.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.scan = Scanner("space", lower=False)
        vocab = self.tok.get_vocab()
        self.spaced = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        self.keys = np.zeros(SLOTS, np.uint64)
        self.at = np.zeros(SLOTS, np.int32)
        self.size = np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0

    @classmethod
    def of_worker(cls, path: str, end_id: int, special_as_text: bool = False) -> Encoder:
        memory, key = _worker_memory(), (path, end_id, special_as_text)
        if key not in memory:
            memory[key] = cls(*key)
        return memory[key]

    def pieces(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pieces, and whether each may be joined to others (one space, at its start, and no odd end)."""
        b = np.concatenate([np.zeros(4, np.uint8), data, np.zeros(1, np.uint8)])
        n = len(data)
        at = np.flatnonzero(data == 0x20)
        nxt = b[at + 5]
        p1, p2, p3, p4 = b[at + 3], b[at + 2], b[at + 1], b[at]
        plain = lambda x: (x > 0x20) & (x < 0x7F)
        tail = (p1 >= 0x80) & (((p2 >= 0xC3) & (p2 < 0xE0)) | (p3 == 0xE0) | ((p3 >= 0xE4) & (p3 < 0xF0)) | (p4 >= 0xF0))
        after = plain(nxt) | ((nxt >= 0xC3) & (nxt < 0xE0)) | (nxt == 0xE0) | (nxt >= 0xE4)
        cut = at[(plain(p1) | tail) & after]
        first = np.zeros(n + 1, dtype=bool)
        first[offs[:-1]] = True
        cut = cut[~first[cut]]
        first[cut] = True
        start = np.flatnonzero(first[:n])
        spaces = np.concatenate([[0], np.cumsum(data <= 0x20)])
        end = np.append(start[1:], n)
        simple = (data[start] == 0x20) & (spaces[end] - spaces[start] == 1)
        last = np.append(~np.isin(end[:-1], cut), True)
        return start, simple & ~(last & (data[end - 1] >= 0x7F))

    def _encode_new(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, simple: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces, and for each piece where its ids begin and how many they are."""
        raw = data.tobytes()
        piece = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        first, size = np.zeros(len(piece), np.int64), np.zeros(len(piece), np.int64)
        out, at = [], 0
        joined, single = np.flatnonzero(simple), np.flatnonzero(~simple).tolist()
        groups = [joined[i : i + 256] for i in range(0, len(joined), 256)]
        for g, e in zip(groups, self.tok.encode_batch_fast([b"".join([piece[i] for i in g.tolist()]).decode() for g in groups], add_special_tokens=False), strict=True):
            t = np.array(e.ids, dtype=np.uint32)
            cut = np.flatnonzero(self.spaced[t])
            if len(cut) == len(g) and cut[0] == 0:
                first[g], size[g] = at + cut, np.diff(cut, append=len(t))
                out.append(t)
                at += len(t)
            else:
                single += g.tolist()
        for i, e in zip(single, self.tok.encode_batch_fast([piece[i].decode() for i in single], add_special_tokens=False), strict=True):
            first[i], size[i] = at, len(e.ids)
            out.append(np.array(e.ids, dtype=np.uint32))
            at += len(e.ids)
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), first, size

    def encode(self, column):
        """(first row, last row + 1, ids, number of ids of each row) of slices of a string column."""
        for i, j, data, offs in chunks(column):
            whole = self._whole(data, offs) if self.cuts and len(data) else np.ones(j - i, bool)
            cut = np.flatnonzero(np.append(True, whole[1:] != whole[:-1]))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), j - i], strict=True):
                part, at = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                if not whole[a] and len(part):
                    yield i + a, i + b, *self._chunk(part, at)
                    continue
                raw = part.tobytes()
                texts = [raw[x:y].decode() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                each = [np.array([*e.ids, self.end], np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
                yield i + a, i + b, np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def _whole(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Which texts hold the string of an added token."""
        found, raw = np.zeros(len(offs) - 1, bool), data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                found[int(np.searchsorted(offs, at, side="right")) - 1] = True
                at = raw.find(token, at + 1)
        return found

    def _chunk(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, simple = self.pieces(data, offs)
        end = np.append(start[1:], len(data))
        self.scan._powers(len(data))
        c = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.scan.values[data] * self.scan.pw[: len(data)], out=c[1:])
        h = mix64((c[end] - c[start]) * self.scan.ipw[start] + (end - start).astype(np.uint64))
        h[h == 0] = 1
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != h)
        if len(miss):
            new, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            w = miss[one]
            ids, first, n = self._encode_new(data, start[w], end[w], simple[w])
            if self.used + len(ids) > POOL:
                self.keys[:], self.used = 0, 0
                keep = np.ones(len(h), bool)  # the tokens of this chunk's hits move to the front
                keep[miss] = False
                old = np.flatnonzero(keep)
                hit = self.pool[_spread(at[old], size[old])]
                self._put(hit)
                at[old] = np.cumsum(size[old]) - size[old]
            first = self._put(ids) + first
            at[miss], size[miss] = first[back], n[back]
            s = slot[w]
            self.keys[s], self.at[s], self.size[s] = new, first, n
        base = self._put(np.array([self.end], np.uint32))
        where = np.searchsorted(start, offs[1:])
        ids = self.pool[_spread(np.insert(at, where, base), np.insert(size, where, 1))]
        total = np.concatenate([[0], np.cumsum(size)])
        counts = total[where] - total[np.searchsorted(start, offs[:-1])] + 1
        self.used = base
        return ids, counts

    def _put(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        at, self.used = self.used, self.used + len(ids)
        self.pool[at : self.used] = ids
        return at


def _spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices at[i], at[i] + 1, ... of size[i] each, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of the ranks of one document."""
    r = ranks.astype("<u4")
    code = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    pad = np.zeros(-(-len(r) // 4) * 4, dtype=np.uint8)
    pad[: len(r)] = code
    quad = pad.reshape(-1, 4)
    control = (quad[:, 0] | quad[:, 1] << 2 | quad[:, 2] << 4 | quad[:, 3] << 6).astype(np.uint8)
    four = r.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), four[np.arange(4) <= code[:, None]].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ranks of all documents of a block; ``counts``: tokens of each, whose control bytes are padded to four."""
    lengths = LENGTHS[control].reshape(-1)
    padded = -(-counts // 4) * 4
    ends = np.cumsum(padded)
    real = np.ones(len(lengths), dtype=bool)
    for k in range(1, 4):
        at = (ends - k)[padded - counts >= k]
        real[at] = False
    lengths = lengths[real].astype(np.int64)
    at = np.cumsum(lengths) - lengths
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        w = np.flatnonzero(lengths > k)
        if not len(w):
            break
        out[w] |= data[at[w] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def tokenised(docs: DataFrame, path: str, end_id: int, special_as_text: bool = False) -> DataFrame:
    """doc_id, n, ids (2 bytes each where the vocabulary allows, else 4) of each document."""

    def run(batches):
        enc = Encoder.of_worker(path, end_id, special_as_text)
        kind = _id_type(enc.tok.get_vocab_size(), end_id)
        for b in batches:
            for i, j, ids, n in enc.encode(b.column(1)):
                raw, w = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
                blobs = [raw[w * (e - k) : w * e] for e, k in zip(np.cumsum(n).tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), pa.array(blobs, pa.binary())], names=["doc_id", "n", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, ids binary")


def _id_type(vocabulary: int, end_id: int) -> str:
    return "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"


def _ids(n: int, blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype="<u2" if len(blob) == 2 * n else "<u4")


def token_counts(tokens: DataFrame) -> DataFrame:
    """(token, n) over all documents."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for n, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = np.bincount(_ids(n, x.as_py()), minlength=len(total))
                c[: len(total)] += total
                total = c
        t = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(total[t], pa.int64())], names=["token", "n"])

    return tokens.select("n", "ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, tokenizer: str, out_uri: str, end_id: int = 2, special_as_text: bool = False, file_tokens: int = FILE_TOKENS, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes ranks.bin and the files; returns (file, path, docs, tokens), one row a file."""
    spark = docs.sparkSession
    small_batches(spark)
    tokens = written(tokenised(docs, tokenizer, end_id, special_as_text))
    rows = token_counts(tokens).orderBy(F.desc("n"), "token").collect()
    ids = np.array([r["token"] for r in rows], dtype=np.uint32)
    fs, root = _filesystem(out_uri)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/ranks.bin") as f:
        f.write(ids.astype("<u4").tobytes())
    rank = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=np.uint32)
    rank[ids] = np.arange(len(ids))
    total = sum(r["n"] for r in rows)
    n_files = max(1, -(-total // file_tokens), min(4 * spark.sparkContext.defaultParallelism, total // least_tokens))
    shared = spark.sparkContext.broadcast(rank)

    def save(batches):
        from pyspark import TaskContext

        fs, root = _filesystem(out_uri)
        rank, at = shared.value, None
        for b in batches:
            for d, n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                at = at or _Writer(fs, root, TaskContext.get().partitionId())
                at.add(d, n, encode_ranks(rank[_ids(n, x.as_py())]))
        done = [at.close()] if at is not None else []
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("file", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    order = [F.col("doc_id").asc_nulls_first(), F.col("n"), F.col("h")]
    placed = tokens.withColumn("h", F.xxhash64("ids")).repartitionByRange(n_files, *order).sortWithinPartitions(*order)
    files = placed.select("doc_id", "n", "ids").mapInArrow(save, "file long, path string, docs long, tokens long").collect()
    return spark.createDataFrame(sorted(files), "file long, path string, docs long, tokens long")


class _Writer:
    def __init__(self, fs, root: str, file: int):
        self.fs, self.file, self.path = fs, file, f"{root}/part-{file:08d}.fvb"
        self.tmp = f"{self.path}.{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(self.tmp)
        self.docs = self.tokens = 0
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, doc_id, n: int, coded: tuple[bytes, bytes]) -> None:
        self.rows.append((doc_id, n, *coded))
        self.held += n
        if self.held >= BLOCK_TOKENS:
            self.flush()

    def flush(self) -> None:
        if not self.rows:
            return
        c, d = (b"".join(r[k] for r in self.rows) for k in (2, 3))
        self.out.write(struct.pack(HEADER, b"FVB1", len(self.rows), self.held, len(c), len(d)))
        self.out.write(np.array([i or 0 for i, *_ in self.rows], dtype="<i8").tobytes())
        self.out.write(np.array([i is None for i, *_ in self.rows], dtype=np.uint8).tobytes())
        self.out.write(np.array([n for _, n, *_ in self.rows], dtype="<i8").tobytes())
        self.out.write(c)
        self.out.write(d)
        self.docs, self.tokens = self.docs + len(self.rows), self.tokens + self.held
        self.rows, self.held = [], 0

    def close(self) -> dict:
        from pyarrow import fs as afs

        self.flush()
        self.out.close()
        if self.fs.get_file_info(self.path).type != afs.FileType.NotFound:
            self.fs.delete_file(self.path)
        self.fs.move(self.tmp, self.path)
        return {"file": self.file, "path": self.path, "docs": self.docs, "tokens": self.tokens}


def read_blocks(fs, path: str, ids: np.ndarray):
    """(doc_ids, null flags, token counts, token ids) of each block of a file."""
    with fs.open_input_stream(path) as f:
        while head := f.read(struct.calcsize(HEADER)):
            _, docs, tokens, c, d = struct.unpack(HEADER, head)
            doc_ids = np.frombuffer(f.read(8 * docs), dtype="<i8")
            null = np.frombuffer(f.read(docs), dtype=np.uint8).astype(bool)
            counts = np.frombuffer(f.read(8 * docs), dtype="<i8")
            control, data = np.frombuffer(f.read(c), dtype=np.uint8), np.frombuffer(f.read(d), dtype=np.uint8)
            yield doc_ids, null, counts, ids[decode_ranks(control, data, counts)]


def read_tokens(spark: SparkSession, out_uri: str, files: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document, read from the files: doc_id, start, n_tokens, ids_crc32, and ``ids`` (array of ints) on request."""
    rows = files.orderBy("file").collect()
    start, at = {}, 0
    for r in rows:
        start[r["path"]] = at
        at += r["tokens"]

    def load(batches):
        import zlib

        fs, root = _filesystem(out_uri)
        with fs.open_input_stream(f"{root}/ranks.bin") as f:
            ids = np.frombuffer(f.read(), dtype="<u4")
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for doc_ids, null, counts, t in read_blocks(fs, path, ids):
                    ends = np.cumsum(counts)
                    raw = memoryview(np.ascontiguousarray(t, dtype="<u4")).cast("B")
                    crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                    cols = [pa.array(doc_ids, pa.int64(), mask=null), pa.array(at + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())]
                    at += int(ends[-1])
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(t.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    paths = spark.createDataFrame([(p, s) for p, s in start.items()], "path string, at long")
    paths = paths.repartition(max(1, len(start)))
    return paths.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op1_token_ids(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shared_dir(spark) + "/tokens"
    files = write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), out)
    return read_tokens(spark, out, files)
