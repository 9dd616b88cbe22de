"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The vocabulary is a byte-level BPE file of the tokenizers library, named by its path. A text is parted
at added tokens, then by the byte-level pattern; each part is merged on its own. The merge loop keeps
a segment tree whose leaves are the ranks of adjacent pairs (leaf i: symbol i and its right
neighbour). The root holds the smallest (rank, position), which is the leftmost lowest-rank merge;
a merge changes three leaves, each in logarithmic time, until the root holds no mergeable pair.
Parts that recur are kept in a bounded memory of each Python worker.

Null texts count as empty: no ids, the digest of no bytes. Long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import lean, table, tune, vocabulary_file

#: The pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Parts of text that a worker remembers before it starts afresh.
MEMORY = 800_000
_NONE = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: themselves where printable, else from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge(symbols: list[int], ranks: dict[int, tuple[int, int]]) -> list[int]:
    """The symbols after all merges. ranks: left << 32 | right to (rank, merged symbol)."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length()
    tree = [_NONE] * (2 * size)
    get = ranks.get
    left = symbols[0]
    for i in range(n - 1):
        right = symbols[i + 1]
        found = get(left << 32 | right)
        if found:
            tree[size + i] = found[0] << 32 | i
        left = right
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    symbols = symbols[:]
    while (top := tree[1]) != _NONE:
        i = top & 0xFFFFFFFF
        j = after[i]
        symbols[i] = get(symbols[i] << 32 | symbols[j])[1]
        symbols[j] = -1
        k = after[j]
        after[i] = k
        changes = [(j, _NONE)] if j < n - 1 else []
        if k < n:
            before[k] = i
            found = get(symbols[i] << 32 | symbols[k])
            changes.append((i, found[0] << 32 | i if found else _NONE))
        else:
            changes.append((i, _NONE))
        if (h := before[i]) >= 0:
            found = get(symbols[h] << 32 | symbols[i])
            changes.append((h, found[0] << 32 | h if found else _NONE))
        for leaf, value in changes:
            at = size + leaf
            tree[at] = value
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                if b < a:
                    a = b
                if tree[at] == a:
                    break
                tree[at] = a
                at >>= 1
    return [s for s in symbols if s >= 0]


class _Parts(dict):
    """Part of a text to its ids as little-endian 32-bit numbers."""

    def __init__(self, start: dict[int, int], ranks: dict[int, tuple[int, int]]):
        self.start, self.ranks = start, ranks

        self.old: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        if len(self) >= MEMORY // 2:  # what is not asked for again before the next turn is forgotten
            self.old = dict(self)
            self.clear()
        ids = self.old.get(part)
        if ids is None:
            start = self.start
            ids = array("I", merge([start[b] for b in part.encode()], self.ranks)).tobytes()
        if len(part) < 200:
            self[part] = ids
        return ids


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_alphabet()
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = {vocab[a] << 32 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if all(c in letters for c in token)}
        self.bytes |= {i: text.encode() for text, i in self.added.items()}
        self.parts = _Parts({letters[c]: vocab[c] for c in letters if c in vocab}, ranks)
        self.find = regex.compile(PATTERN).findall
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        get = self.parts.__getitem__
        if self.at_added and any(a in text for a in self.added):
            out = []
            for k, piece in enumerate(self.at_added.split(text)):
                out.append(self.added[piece].to_bytes(4, "little") if k % 2 else b"".join(map(get, self.find(piece))))
            return b"".join(out)
        return b"".join(map(get, self.find(text)))

    def decode(self, ids: bytes) -> str:
        get = self.bytes.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """The vocabulary at path, once for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(vocabulary_file(path))
    return _LOADED[path]


def encode_decode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each row of docs (doc_id, text).

    ids is the array of ids, decoded the text made from them again. With digests, ids_sha256 and
    decoded_sha256 (of the ids as little-endian 32-bit numbers and of the UTF-8 text) stand in their
    place, so that only digests leave the Python worker. path may be a file's path or the name of a public tokenizer's file.
    Null texts count as empty; repeated rows are encoded each; an empty table gives an empty result.
    """
    import pyarrow as pa

    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<bigint>, decoded string"

    def run(batches):
        bpe = loaded(path)
        sha = hashlib.sha256
        for batch in batches:
            ids, decoded, counts = [], [], []
            for text in batch.column(1).to_pylist():
                coded = bpe.encode(text or "")
                back = bpe.decode(coded)
                counts.append(len(coded) // 4)
                ids.append(sha(coded).hexdigest() if digests else np.frombuffer(coded, "<u4").astype("i8"))
                decoded.append(sha(back.encode()).hexdigest() if digests else back)
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string() if digests else pa.list_(pa.int64())), pa.array(decoded, pa.string())], names)

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_tokens bigint, {rest}")


#: The vocabulary of the queries.
VOCABULARY = "byte_bpe_50k.json"


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), VOCABULARY, digests=True)
