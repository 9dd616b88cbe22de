"""Token-id output in training order.

1. Packing. Rows are dealt by hash of id and text to groups of about ``group_docs`` rows, in each of which texts are taken in the order of
   doc_id and hash, encoded, followed by the end-of-text id, and packed end to end into sequences of ``length`` ids (the last one of a
   group is filled up with end-of-text ids). Sequences are numbered group after group. That depends on the rows alone, not on partitions.
2. Order. A keyed Feistel network over the smallest even number of bits that holds all n sequences, walked on until it falls
   below n (cycle-walking), is a permutation of 0 .. n-1: it gives each sequence its global slot.
3. Shards. Slot s belongs to shard s // shard_rows, at byte (s % shard_rows) * stride: every sequence takes the same number of bytes.
   One exchange sends whole shards to range partitions with exact bounds; the tasks that get them sort and write the files, and an index of
   what each slot holds. Readers go through shards in order, and resume at any slot.
"""

from __future__ import annotations

import base64
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, durable, lean, shared_dir, table, tune, vocabulary_file

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _round(half: np.ndarray, key: np.uint64) -> np.ndarray:
    """The finalizer of SplitMix64 over half and key."""
    x = half ^ key
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The slots of indexes below n: a permutation of range(n) chosen by key."""
    half = max(1, ((max(1, n - 1)).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _round(np.arange(1, rounds + 1, dtype=np.uint64), np.uint64(key & (2**64 - 1)))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_round(right, k) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


_ENCODERS: dict[tuple[str, str], object] = {}


def _encoder(path: str, pattern: str):
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        with open(vocabulary_file(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path, pattern]


class Packer:
    """Cuts a stream of texts' ids into sequences of ``length``, and knows which texts each one holds."""

    def __init__(self, length: int, end_id: int, size: np.dtype):
        self.length, self.end_id, self.size = length, end_id, size
        self.rest, self.held = np.zeros(0, size), []

    def add(self, ids: list[np.ndarray], owners: list, last: bool) -> tuple[list[bytes], list[list], list[list[int]]]:
        """The sequences that are full now (with last: all, the end filled up), their texts, and how many ids of each."""
        data, owners = np.concatenate([self.rest, *ids]), self.held + [(o, len(i)) for o, i in zip(owners, ids)]
        count = -(-len(data) // self.length) if last else len(data) // self.length
        texts, sizes, k, left = [], [], 0, owners[0][1] if owners else 0
        for _ in range(count):
            room, some, many = self.length, [], []
            while room and k < len(owners):
                take = min(room, left)
                some.append(owners[k][0])
                many.append(take)
                room, left = room - take, left - take
                if not left:
                    k += 1
                    left = owners[k][1] if k < len(owners) else 0
            texts.append(some)
            sizes.append(many)
        self.held = [(owners[k][0], left), *owners[k + 1 :]] if k < len(owners) else []
        whole, self.rest = data[: count * self.length], data[count * self.length :]
        raw = np.concatenate((whole, np.full(count * self.length - len(whole), self.end_id, self.size))).tobytes()
        step = self.length * self.size.itemsize
        return [raw[i * step : (i + 1) * step] for i in range(count)], texts, sizes


def _width(end_id: int) -> np.dtype:
    return np.dtype("<u2") if end_id < 1 << 16 else np.dtype("<u4")


def pack_sequences(docs: DataFrame, path: str, pattern: str, end_id: int, length: int, group_docs: int = 8192) -> DataFrame:
    """(g, row, tokens, doc_ids, doc_tokens): the sequences of each group, numbered within it.

    tokens: length ids as little-endian 16-bit numbers (32-bit if end_id needs them). doc_ids and
    doc_tokens: the texts that the sequence holds, in order, and how many ids of each (with its end id).
    """
    tune(docs.sparkSession)
    size, kind = _width(end_id), docs.schema["doc_id"].dataType.simpleString()
    groups = max(1, -(-docs.count() // group_docs))

    def encode(batches):
        code = _encoder(path, pattern).encode_ordinary
        for batch in batches:
            ids = [np.array([*code(t or ""), end_id], size).tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], ["doc_id", "h", "g", "ids"])

    def pack(batches):
        packer, group, row = Packer(length, end_id, size), None, 0

        def made(found, kind):
            nonlocal row
            n = len(found[0])
            row += n
            return pa.RecordBatch.from_arrays(
                [pa.array([group] * n, pa.int64()), pa.array(range(row - n, row), pa.int64()), pa.array(found[0], pa.binary()), pa.array(found[1], pa.list_(kind)), pa.array(found[2], pa.list_(pa.int32()))],
                ["g", "row", "tokens", "doc_ids", "doc_tokens"],
            )

        id_type = pa.null()
        for batch in batches:
            id_type = batch.column(0).type
            of = batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)] if len(of) else []
            for a, b in zip(edges, edges[1:]):
                if group is not None and of[a] != group:
                    yield made(packer.add([], [], True), id_type)
                    row = 0
                group = int(of[a])
                ids = [np.frombuffer(x.as_buffer(), size) for x in batch.column(3).slice(a, b - a)]
                yield made(packer.add(ids, batch.column(0).slice(a, b - a).to_pylist(), False), id_type)
        if group is not None:
            yield made(packer.add([], [], True), id_type)

    h = F.xxhash64(F.coalesce("text", F.lit("")))
    named = docs.select("doc_id", h.alias("h"), F.pmod(F.xxhash64("doc_id", h), F.lit(groups)).alias("g"), "text")
    coded = named.mapInArrow(lean(encode), f"doc_id {kind}, h bigint, g bigint, ids binary")
    dealt = coded.repartition("g").sortWithinPartitions("g", "doc_id", "h")
    return dealt.mapInArrow(lean(pack), f"g bigint, row bigint, tokens binary, doc_ids array<{kind}>, doc_tokens array<int>")


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that driver and executors can reach, and the path in it."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_training_order(docs: DataFrame, folder: str, path: str, pattern: str, end_id: int = 50256, length: int = 1024, shard_rows: int = 8192, key: int = 20, group_docs: int = 8192, passes: int = 2) -> DataFrame:
    """Writes folder/shard-<number>.bin and returns their index, a written table: (slot, shard, row, offset, path, doc_ids, doc_tokens), files sorted by slot.

    docs needs doc_id and text; other columns are not read. Null and empty texts are one end id; repeated rows are packed
    each; long texts go on in further sequences. An empty table gives no shards and no rows. row and offset: the sequence's place
    in its shard, in sequences and bytes. The shards hold the same bytes whatever the partitions of docs, and on every run. A file is written under a
    name of its attempt and then renamed, so that a task that is run again leaves whole files. folder: as for store(). The shards are written in
    ``passes`` ranges one after another, each with its own exchange, so that disks hold a part of the exchanged sequences at a time.
    """
    packed = durable(pack_sequences(docs, path, pattern, end_id, length, group_docs), "sequences", "zstd")
    sizes = packed.groupBy("g").agg(F.count(F.lit(1)).alias("n")).orderBy("g").toArrow()  # two numbers for each group_docs rows
    numbers, counts = sizes["g"].to_numpy(), sizes["n"].to_numpy()
    n = int(counts.sum())
    starts = np.cumsum(counts) - counts
    shared = docs.sparkSession.sparkContext.broadcast((numbers, starts))
    stride, shards = length * _width(end_id).itemsize, max(1, -(-n // shard_rows))

    def place(low, high):
        def run(batches):
            numbers, starts = shared.value
            for batch in batches:
                first = starts[np.searchsorted(numbers, batch.column(0).to_numpy())]
                slot = feistel(first + batch.column(1).to_numpy(), n, key)
                found = pa.RecordBatch.from_arrays([pa.array(slot), *batch.columns[2:]], ["slot", "tokens", "doc_ids", "doc_tokens"])
                yield found.filter(pa.array((slot >= low) & (slot < high)))

        return lean(run)

    def write(batches):
        system, base = store(folder)
        system.create_dir(base, recursive=True)
        open_, out, own, name = None, None, "", ""

        def close():
            if out is not None:
                out.close()
                if system.get_file_info(name).type == fs.FileType.NotFound:
                    system.move(own, name)
                else:  # another attempt was first, with the same bytes
                    system.delete_file(own)

        for batch in batches:
            slots, tokens = batch.column(0).to_numpy(), batch.column(1)
            paths = []
            for k, slot in enumerate(slots.tolist()):
                if slot // shard_rows != open_:
                    close()
                    open_ = slot // shard_rows
                    name, own = f"{base}/shard-{open_:08d}.bin", f"{base}/.{open_:08d}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(own)
                out.write(tokens[k].as_buffer())
                paths.append(f"shard-{open_:08d}.bin")
            row = slots % shard_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slots // shard_rows), pa.array(row), pa.array(row * stride), pa.array(paths, pa.string()), *batch.columns[2:]], ["slot", "shard", "row", "offset", "path", "doc_ids", "doc_tokens"])
        close()

    lists = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema if f.name in ("doc_ids", "doc_tokens"))
    edges = sorted({shards * p // passes for p in range(passes + 1)})
    index = []
    for a, b in zip(edges, edges[1:]):
        placed = packed.mapInArrow(place(a * shard_rows, b * shard_rows), f"slot bigint, tokens binary, {lists}")
        parts = min(b - a, 20_000)
        ranged = placed.repartitionById(parts, F.expr(f"CAST((slot div {shard_rows} - {a}) * {parts} div {b - a} AS INT)")).sortWithinPartitions("slot")
        index.append(durable(ranged.mapInArrow(lean(write), f"slot bigint, shard bigint, row bigint, offset bigint, path string, {lists}"), "training-index"))
    discard(packed)
    return reduce(DataFrame.unionByName, index)


def read_training_order(index: DataFrame, folder: str, end_id: int = 50256, length: int = 1024) -> DataFrame:
    """index with tokens, read from the shards at their offsets; a filter on slot resumes anywhere."""
    stride, names = length * _width(end_id).itemsize, index.columns
    place = {c: k for k, c in enumerate(names)}

    def read(batches):
        system, base = store(folder)
        file, name = None, None
        for batch in batches:
            tokens = []
            for path, offset in zip(batch.column(place["path"]).to_pylist(), batch.column(place["offset"]).to_pylist()):
                if path != name:
                    file, name = system.open_input_file(f"{base}/{path}"), path
                tokens.append(file.read_at(stride, offset))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.binary())], [*names, "tokens"])

    return index.mapInArrow(read, index.select("*", F.lit(b"").alias("tokens")).schema)


def read_shard(path: str, length: int, start_row: int = 0, wide: bool = False) -> np.ndarray:
    """The sequences of a shard file from start_row on, memory-mapped."""
    return np.memmap(path, "<u4" if wide else "<u2", "r").reshape(-1, length)[start_row:]


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    index = write_training_order(table(spark, sf_dir, "documents"), folder, "byte_bpe_50k.tiktoken", public_tokenizers.PATTERN)
    return read_training_order(index, folder).select("slot", "shard", "row", "offset", "tokens", "doc_ids", "doc_tokens")
