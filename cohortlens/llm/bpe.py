"""Operator 6, BPE encoding and decoding with a pair occurrence index.

A task collects the distinct pieces of a block of texts in one array of symbols. The index maps the rank of every
pair that occurs to all its positions. Ranks are taken in ascending order; all occurrences of the pair are joined at
once, left ones first where they overlap, and the lists of the pairs that arise are extended. A joined symbol is
younger than its parts, so new pairs always rank behind the current one and every rank is met once. The result is the
one that piece-by-piece encoding gives.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm import tokenizer as T
from cohortlens.llm.common import text_blocks, texts_of

_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else one of 256, 257, ..."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class PairIndexCodec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str):
        spec = T.read(path)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.size = max(vocab.values()) + 1
        self.base = np.array([vocab[c] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.joined = np.array([vocab[a + b] for a, b in pairs], np.int64)
        born = np.full(self.size, -1, np.int64)
        born[self.joined] = np.arange(len(pairs))
        ranks = np.arange(len(pairs))
        if len(set(self.joined.tolist())) < len(pairs) or (born[self.left] >= ranks).any() or (born[self.right] >= ranks).any():
            raise ValueError(f"{path}: a merge uses a symbol that a later merge makes")
        keys = self.left * self.size + self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.bytes_of = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.pieces = regex.compile(T.PIECES)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, _NONE where there is no merge."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], _NONE)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one behind the other, and where each begins (one entry more)."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begins = np.concatenate([[0], np.cumsum(sizes)])
        symbol = self.base[data]
        after, before = np.arange(1, len(data) + 1, dtype=np.int32), np.arange(-1, len(data) - 1, dtype=np.int32)
        full = begins[:-1][sizes > 0]
        before[full] = -1
        after[(begins[1:] - 1)[sizes > 0]] = -1
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def extend(places: np.ndarray) -> None:
            rank = self.ranks(symbol[places], symbol[after[places]])
            known = rank != _NONE
            places, rank = places[known], rank[known]
            if not len(places):
                return
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, own in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts) if len(cuts) else [places]):
                if r in lists:
                    lists[r].append(own)
                else:
                    lists[r] = [own]
                    heapq.heappush(active, r)

        extend(np.flatnonzero(after >= 0))
        marked = np.zeros(len(data), bool)
        while active:
            rank = heapq.heappop(active)
            found = lists.pop(rank)
            places = np.concatenate(found) if len(found) > 1 else found[0]
            left, right = self.left[rank], self.right[rank]
            follow = after[places]
            alive = (symbol[places] == left) & (follow >= 0) & (symbol[follow] == right)
            places = places[alive]
            if left == right and len(places) > 1:
                places = np.sort(places)
                chained = np.concatenate([[False], after[places[:-1]] == places[1:]])
                number = np.arange(len(places))
                places = places[(number - np.maximum.accumulate(np.where(chained, 0, number))) % 2 == 0]
            if not len(places):
                continue
            follow = after[places]
            symbol[places] = self.joined[rank]
            symbol[follow] = -1
            beyond = after[follow]
            after[places] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = places[inner]
            marked[places] = True
            previous = before[places]
            previous = previous[previous >= 0]
            extend(np.concatenate([previous[~marked[previous]], places[inner]]))
            marked[places] = False
        kept = symbol >= 0
        return symbol[kept], np.concatenate([[0], np.cumsum(kept)])[begins]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, little-endian unsigned 32-bit."""
        parts: dict[str, int] = {}
        numbers = []
        for text in texts:
            cut = T.space_cuts(text)
            own = [parts.setdefault(cut[0], len(parts))] if cut[0] else []
            own.extend([parts.setdefault(" " + p, len(parts)) for p in cut[1:]])
            numbers.append(np.array(own, np.int64))
        pieces: dict[str, int] = {}
        fixed: dict[str, int] = {}
        piece_no, piece_begin = [], [0]
        for part in parts:
            split = self.special_cut.split(part) if self.special_cut and any(s in part for s in self.special) else (part,)
            for k, run in enumerate(split):
                if k % 2:
                    piece_no.append(-1 - self.special[run])
                else:
                    piece_no.extend([pieces.setdefault(p, len(pieces)) for p in self.pieces.findall(run)])
            piece_begin.append(len(piece_no))
        ids, begins = self.encode_pieces([p.encode() for p in pieces])
        # a special string is a piece of one id
        for number in sorted({n for n in piece_no if n < 0}):
            fixed[number] = len(begins) - 1
            ids, begins = np.append(ids, -1 - number), np.append(begins, len(ids) + 1)
        chosen = np.array([fixed[n] if n < 0 else n for n in piece_no] if fixed else piece_no, np.int64)
        part_ids, part_begins = _gather(ids, begins, chosen)
        part_begins = part_begins[np.array(piece_begin, np.int64)]
        return [_gather(part_ids, part_begins, own)[0].astype("<u4") for own in numbers]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _gather(values: np.ndarray, begins: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen runs of values one behind the other, and where each begins."""
    sizes = begins[chosen + 1] - begins[chosen] if len(chosen) else np.zeros(0, np.int64)
    to = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    index = np.arange(to[-1]) + np.repeat(begins[chosen] - to[:-1], sizes) if len(chosen) else np.zeros(0, np.int64)
    return values[index], to


@lru_cache(maxsize=2)
def codec(path: str) -> PairIndexCodec:
    return PairIndexCodec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20,
           ids: bool = True, digests: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, with `ids` the ids, with `digests` ids_sha256 and decoded_sha256.

    The digests are those of the ids as little-endian 32-bit numbers and of the text that is decoded from them. A null
    text is encoded as the empty one (no id). Ids of rows are only passed through: null or repeated ones and
    repeated rows keep their rows; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in text_blocks(batches, "text", block_bytes):
            made = own.encode(texts_of(batch, "text"))
            columns = {"id": batch.column("id"), "n_tokens": pa.array(map(len, made), pa.int64())}
            if ids:
                columns["ids"] = pa.array([i.view("<i4") for i in made], pa.list_(pa.int32()))
            if digests:
                columns["ids_sha256"] = pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in made], pa.string())
                columns["decoded_sha256"] = pa.array([hashlib.sha256(own.decode(i).encode()).hexdigest() for i in made], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = f"id {kind}, n_tokens bigint" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id, text. Null ids give the empty text; ids that are not in the vocabulary fail."""
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.array(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
