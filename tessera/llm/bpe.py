"""Byte-level BPE: a minimal perfect hash for pre-tokens that are in the vocabulary, a heap over linked bytes for the rest.

Cases: a null text counts as empty and has no ids; a very long text is encoded by one
task, in time near its length; of equal pairs that could merge the leftmost does first;
repeated rows are encoded each on its own; rows keep their number; other columns of the input are not read, so
none can clash; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import BASE, map_texts, mix, quoted, span_hashes

#: Pre-tokens whose ids a worker remembers, at most, and characters of such a one; longer ones are encoded anew.
REMEMBERED, MAX_REMEMBERED = 200_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _hashes(keys: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(keys), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(k) for k in keys], dtype=np.int64)])
    return span_hashes(raw, at[:-1], at[1:])


class PerfectHash:
    """A minimal perfect hash: n keys, n slots; each bucket of keys has a displacement that sends its keys to free slots.

    A bucket of one key needs no search: its displacement is -1 - slot.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n = n = len(keys)
        self.buckets = max(1, n // per_bucket)
        self.shift = np.zeros(self.buckets, np.int64)
        self.keys: list[bytes] = [b""] * n
        self.slot_of = np.zeros(n, np.int64)
        if not n:
            return
        hashes = _hashes(keys)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(first)
        taken = np.zeros(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            members = order[first[b] : first[b + 1]]
            if len(members) < 2:
                break
            own, d, slots = hashes[members][:, None], 0, None
            while slots is None:  # many displacements at a time
                tried = self._slots(own, np.arange(d, d + 64)[None, :])
                ordered = np.sort(tried, 0)
                fits = np.flatnonzero(~taken[tried].any(0) & (ordered[1:] != ordered[:-1]).all(0))
                if len(fits):
                    d, slots = d + int(fits[0]), tried[:, fits[0]]
                else:
                    d += 64
            taken[slots] = True
            self.shift[b] = d
            self.slot_of[members] = slots
        free = iter(np.flatnonzero(~taken).tolist())
        for b in np.flatnonzero(sizes == 1):
            slot = next(free)
            self.shift[b] = -1 - slot
            self.slot_of[order[first[b]]] = slot
        for i, slot in enumerate(self.slot_of.tolist()):
            self.keys[slot] = keys[i]

    def _slots(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(hashes + (shift.astype(np.uint64) + np.uint64(1)) * BASE) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> list[int]:
        """The slot of each key, or -1 where it is none of the hash's keys."""
        if not keys or not self.n:
            return [-1] * len(keys)
        hashes = _hashes(keys)
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(shift < 0, -1 - shift, self._slots(hashes, np.maximum(shift, 0)))
        own = self.keys
        return [s if own[s] == k else -1 for s, k in zip(slots.tolist(), keys)]


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of least rank merges first, the leftmost of equals, until none is in the vocabulary."""
    n = len(piece)
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0 once it is merged away
    back = list(range(-1, n - 1))  # where the part before starts
    get = ranks.get
    heap = []
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 1, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if end[i] != mid or end[mid] != stop:
            continue  # one of its parts has merged since
        end[i], end[mid] = stop, 0
        if stop < n:
            back[stop] = i
            rank = get(piece[i : end[stop]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, stop, end[stop]))
        j = back[i]
        if j >= 0:
            rank = get(piece[j:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, j, i, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Codec:
    """Encoder and decoder for one vocabulary and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.hash = PerfectHash(list(ranks))
        self.slot_ids = [np.uint32(ranks[k]).tobytes() for k in self.hash.keys]
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._ready()

    def _ready(self) -> None:
        self.split = regex.compile(self.pattern).findall
        self.known: dict[str, bytes] = {}
        self.long: list[str] = []

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "known", "long")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def learn(self, pieces: Iterable[str]) -> None:
        """Puts the packed ids of the pieces into the memory: the perfect hash first, the heap for what it does not have."""
        known = self.known
        new = [p for p in set(pieces) if p not in known]
        raw = [p.encode() for p in new]
        for text, piece, slot in zip(new, raw, self.hash.slots(raw)):
            known[text] = self.slot_ids[slot] if slot >= 0 else np.array(merge_bytes(piece, self.ranks), "<u4").tobytes()
            if len(text) > MAX_REMEMBERED:
                self.long.append(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        get, out = self.known.__getitem__, []
        for text in texts:
            pieces = self.split(text)
            self.learn(pieces)
            out.append(b"".join(map(get, pieces)))
            for piece in self.long:
                del self.known[piece]
            self.long.clear()
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode_documents(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 (of the ids decoded again), and where asked token_ids, the packed ids."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(codec)
    schema = f"{quoted(id_col)} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids binary" * keep_ids

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        packed = own.encode_batch([t or "" for t in part.column(1).to_pylist()])
        lists = [np.frombuffer(p, "<u4").tolist() for p in packed]
        columns = [
            part.column(0),
            pa.array([len(x) for x in lists], pa.int64()),
            pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
            pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in lists], pa.string()),
        ]
        if keep_ids:
            columns.append(pa.array(packed, pa.binary()))
        return pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"][: len(columns)])

    return map_texts(docs.select(quoted(id_col), quoted(text_col)), work, schema, text_col)


def decode_documents(encoded: DataFrame, codec: Codec, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """The texts of packed ids; a null list gives a null text, bytes that are no UTF-8 become U+FFFD."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(codec)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        texts = [None if p is None else own.decode(np.frombuffer(p, "<u4").tolist()).decode("utf-8", "replace") for p in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return map_texts(encoded.select(quoted(id_col), quoted(ids_col)), work, f"{quoted(id_col)} {encoded.schema[id_col].dataType.simpleString()}, text string", ids_col)


def default_codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """The codec of a rank file; by default the installed multilingual vocabulary and its pattern."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    if sys.byteorder != "little":  # packed ids are little-endian, and are made by numpy's own order
        raise RuntimeError("a little-endian machine is needed")
    return Codec(read_ranks(path), pattern)
