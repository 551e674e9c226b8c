"""SentencePiece segmentations of merge type with seeded merge-dropout, and their lossless decoding.

Merges are taken from an agenda, best score first and leftmost among equals, as the library does for this type of model.
With dropout each candidate that comes off the agenda is skipped if a keyed hash says so.  The key is the seed, the document
id, the number of the chunk (a run of spaces with the word after it) in its text and the step of its agenda: hashes give
the gaps between skipped steps, which are as those of a draw at each step.  So a text always has the same segmentation
under the same seed, and each occurrence of a word has draws of its own.

The chunks of a slice of texts go through their agendas together, one step of all of them at a time, in arrays; nothing is
remembered between slices.  Chunks over 48 characters and those with characters that are no pieces go one by one, in a heap.

No piece of the model goes from a word into the space after it (checked on loading), so chunks are independent.  Ids
follow the library; without dropout they are equal to its own, but for a text that holds the model's space mark U+2581
itself: here its three bytes are written, so that it does not come back as a space.

Defined results: a null or empty text has no pieces; a null id counts as 0; repeated rows have equal results; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.words import bounded_batches, mixed, slices

DROPOUT, SEED = 0.1, 1729
_MARK = "▁"
#: Gaps between skipped steps that are looked up at once.
_GAPS = 4096
#: Most symbols of the chunks that share arrays, and how many of them do so at a time.
_WIDTHS, _BLOCK = (4, 6, 8, 10, 13, 18, 28, 48), 1 << 14
_NEVER = 1 << 62
_CHUNK = re.compile(r" *[^ ]+| +")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, model: str, dropout: float = DROPOUT, seed: int = SEED) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self._id: dict[str, int] = {}
        self._rank: dict[str, float] = {}
        self._bytes_id = [0] * 256
        self._plain: list[bytes] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self._bytes_id[value] = i
                self._plain.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self._plain.append(b"")
            else:
                self._id[piece], self._rank[piece] = i, -sp.get_score(i)
                self._plain.append(piece.replace(_MARK, " ").encode())
        if any(_MARK in p.lstrip(_MARK) for p in self._id):
            raise ValueError("the model has pieces that go on after a word; chunks would not be independent")
        self.dropout, self.seed = dropout, seed
        # Gap g: the first value of 64 bits that skips no earlier than after g taken steps, for g = 1, 2 and so on.
        ends = np.arange(1, min(_GAPS, math.ceil(-45 / math.log1p(-dropout)) if 0 < dropout < 1 else 1) + 1)
        self._gaps = np.array([min(int(-math.expm1(g * math.log1p(-dropout)) * 2.0**64) if dropout < 1 else 1 << 64, (1 << 64) - 1) for g in ends.tolist()], np.uint64)
        self._ends = self._gaps.tolist()
        self._tables(n)

    def _tables(self, n: int) -> None:
        """Characters, merges and the order of merges as arrays; piece ``n`` stands for none."""
        self._none = n
        self._char = np.full(0x110000, -1, np.int32)
        for piece, i in self._id.items():
            if len(piece) == 1:
                self._char[ord(piece)] = i
        self._char[ord(" ")], self._char[ord(_MARK)] = self._char[ord(_MARK)], -1
        merges = sorted((a * (n + 1) + b, i) for piece, i in self._id.items() for at in range(1, len(piece)) if (a := self._id.get(piece[:at])) is not None and (b := self._id.get(piece[at:])) is not None)
        self._pair = np.array([*(x for x, _ in merges), _NEVER], np.int64)
        self._merged = np.array([*(i for _, i in merges), n], np.int32)
        self._order = np.full(n + 1, np.iinfo(np.int32).max, np.int32)
        ids = np.fromiter(self._id.values(), np.int64, len(self._id))
        self._order[ids] = np.unique(np.fromiter(self._rank.values(), float, len(self._rank)), return_inverse=True)[1]

    def _next(self, at: int, key: int) -> tuple[int, int]:
        """The next skipped step from step ``at`` on, and the key of the one after it."""
        while (gap := bisect_right(self._ends, key)) == len(self._ends):  # none among so many steps: go on behind them
            at, key = at + gap, _turned(key)
        return at + gap, _turned(key)

    def _ids(self, symbols: list[str]) -> list[int]:
        out = []
        for s in symbols:
            i = self._id.get(s)
            out += [i] if i is not None else [self._bytes_id[b] for b in s.encode()]
        return out

    def segment(self, chunk: str, skips: _Skips) -> list[int]:
        """Ids of one chunk that is written with the space mark."""
        symbols = list(chunk)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        size = [1] * n
        rank, agenda = self._rank, []

        def propose(left: int, right: int) -> None:
            joined = symbols[left] + symbols[right]
            if (r := rank.get(joined)) is not None:
                heapq.heappush(agenda, (r, left, right, size[left] + size[right], joined))

        for i in range(n - 1):
            propose(i, i + 1)
        step, skip = skips.step, skips.skip
        while agenda:
            _, left, right, total, joined = heapq.heappop(agenda)
            if not size[left] or not size[right] or size[left] + size[right] != total or after[left] != right:
                continue
            step += 1
            if step > skip:
                skip = skips.following()
                continue
            symbols[left], size[left], size[right] = joined, total, 0
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
                propose(left, after[right])
            if before[left] >= 0:
                propose(before[left], left)
        skips.step = step
        return self._ids([s for s, k in zip(symbols, size, strict=True) if k])

    def _chunk_bytes(self, chunk: str, skips: _Skips) -> bytes:
        if _MARK in chunk:
            # The mark itself is written in bytes; what stands around it is segmented by itself.
            ids: list[int] = []
            for i, part in enumerate(chunk.split(_MARK)):
                ids += [self._bytes_id[b] for b in _MARK.encode()] if i else []
                ids += self.segment(part.replace(" ", _MARK), skips) if part else []
            return np.array(ids, np.uint32).tobytes()
        return np.array(self.segment(chunk.replace(" ", _MARK), skips), np.uint32).tobytes()

    def encode(self, text: str, doc_key: int = 0) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes, chunk by chunk."""
        chunks = _CHUNK.findall(" " + text) if text else []
        starts = [self._next(0, k) for k in self._keys(doc_key, len(chunks)).tolist()] if self.dropout else [(_NEVER, 0)] * len(chunks)
        return b"".join([self._chunk_bytes(chunk, _Skips(self, *start)) for chunk, start in zip(chunks, starts, strict=True)])

    def _keys(self, doc_key: int, n: int) -> np.ndarray:
        """A key for each chunk of a text."""
        return mixed(np.arange(n, dtype=np.uint64) + np.uint64(xxhash.xxh3_64_intdigest(doc_key.to_bytes(16, "little", signed=True), self.seed)))

    def encode_all(self, texts: list[str], doc_keys: list[int]) -> list[bytes]:
        """What ``encode`` gives for each text, of all chunks together."""
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        ends = np.cumsum(sizes)
        code = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le"), np.uint32)
        # A chunk starts with a run of spaces, or with the text.
        space = code == ord(" ")
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[(ends - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(first)
        lengths = np.diff(starts, append=len(code))
        of_text = np.searchsorted(starts, np.append(0, ends))
        chars = self._char[code]
        skips, keys = np.full(len(starts), _NEVER, np.int64), np.zeros(len(starts), np.uint64)
        if self.dropout and len(starts):
            keys = np.concatenate([self._keys(k, n) for k, n in zip(doc_keys, np.diff(of_text).tolist(), strict=True)])
            skips, keys = self._all_next(np.zeros(len(keys), np.int64), keys)
        odd = lengths > _WIDTHS[-1]
        if len(starts):
            odd |= np.minimum.reduceat(chars, starts) < 0
        counts, pools = np.zeros(len(starts), np.int64), []
        places = np.zeros(len(starts), np.int64)
        held = 0

        def put(which, ids, n):
            nonlocal held
            counts[which], places[which] = n, held + np.cumsum(n) - n
            pools.append(ids)
            held += len(ids)

        for i in np.flatnonzero(odd).tolist():
            chunk = code[starts[i] : starts[i] + lengths[i]].tobytes().decode("utf-32-le")
            ids = np.frombuffer(self._chunk_bytes(chunk, _Skips(self, int(skips[i]), int(keys[i]))), np.uint32).astype(np.int32)
            put([i], ids, np.array([len(ids)]))
        for low, high in zip((0, *_WIDTHS), _WIDTHS):  # noqa: B905
            group = np.flatnonzero((lengths > low) & (lengths <= high) & ~odd)
            for at in range(0, len(group), _BLOCK):
                which = group[at : at + _BLOCK]
                put(which, *self._agendas(chars, starts[which], lengths[which], high, skips[which], keys[which]))
        before = np.append(0, np.cumsum(counts))
        ids = np.concatenate([*pools, np.empty(0, np.int32)])[np.repeat(places - before[:-1], counts) + np.arange(before[-1])].astype(np.uint32)
        cuts = before[of_text].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]  # noqa: B905

    def _all_next(self, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ``_next`` gives for each entry; the arrays are changed in place."""
        open_ = np.arange(len(at))
        while len(open_):
            gaps = np.searchsorted(self._gaps, keys[open_], side="right")
            at[open_] += gaps
            keys[open_] = _turned(keys[open_])
            open_ = open_[gaps == len(self._gaps)]
        return at, keys

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two neighbours merge into, or none."""
        pair = a * np.int64(self._none + 1) + b
        at = np.searchsorted(self._pair, pair)
        return np.where(self._pair[at] == pair, self._merged[at], np.int32(self._none))

    def _agendas(self, chars, starts, lengths, width: int, skips, keys) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after another, and how many each has.

        A row of the arrays is a chunk, a column the place of a symbol's first character; ``ahead`` and ``behind`` lead to
        the neighbouring symbols.  The last column is never filled, so that ends have neighbours that merge with nothing.
        """
        wide, n, last = width + 1, len(starts), np.iinfo(np.int32).max
        filled = np.arange(wide) < lengths[:, None]
        symbols = np.full((n, wide), self._none, np.int32)
        symbols[filled] = chars[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
        joined = np.full((n, wide), self._none, np.int32)
        joined[:, :-1] = self._joined(symbols[:, :-1], symbols[:, 1:])
        order = self._order[joined]
        ahead = np.arange(1, n * wide + 1)
        behind = np.arange(-1, n * wide - 1)
        behind[::wide] += wide
        best_of, alive = order, filled.reshape(-1)
        symbols, joined, order = symbols.reshape(-1), joined.reshape(-1), order.reshape(-1)
        rows, step = np.arange(n), 0
        while len(rows):
            at = rows * wide + (best_of if len(rows) == n else best_of[rows]).argmin(axis=1)
            going = order[at] < last
            if not going.all():
                rows, at = rows[going], at[going]
            skipped = skips[rows] <= step
            if skipped.any():
                these = rows[skipped]
                order[at[skipped]] = last
                skips[these], keys[these] = self._all_next(skips[these] + 1, keys[these])
                at = at[~skipped]
            right = ahead[at]
            beyond = ahead[right]
            symbols[at] = merged = joined[at]
            alive[right], order[right] = False, last
            ahead[at], behind[beyond] = beyond, at
            joined[at] = new = self._joined(merged, symbols[beyond])
            order[at] = self._order[new]
            before = behind[at]
            joined[before] = new = self._joined(symbols[before], merged)
            order[before] = self._order[new]
            step += 1
        return symbols[alive], alive.reshape(n, wide).sum(axis=1)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that was encoded."""
        return b"".join(map(self._plain.__getitem__, np.frombuffer(ids, np.uint32).tolist()))[1:]


class _Skips:
    """The steps that one occurrence of a chunk skips, and how many steps it has taken."""

    def __init__(self, codec: PieceCodec, skip: float, key: int) -> None:
        self._codec, self.skip, self._key = codec, skip, key
        self.step, self.used = 0, []

    def following(self) -> int:
        self.used.append(self.skip)
        self.skip, self._key = self._codec._next(self.skip + 1, self._key)
        return self.skip


def _turned(key):
    """The key of the next gap, of one key or an array: a linear step, then a finaliser."""
    if isinstance(key, np.ndarray):
        x = key * np.uint64(6364136223846793005) + np.uint64(1442695040888963407)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(33))
    x = (key * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 33)


def _prepared(documents: DataFrame) -> DataFrame:
    bounded_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def encode(documents: DataFrame, model: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) for each row of ``documents``."""
    where = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(where, dropout, seed)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            keys = batch.column(0).to_pylist()
            for low, high in slices(texts):
                ids = [np.frombuffer(x, np.int32) for x in codec.encode_all(texts[low:high], [k or 0 for k in keys[low:high]])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _prepared(documents).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` from ``doc_id`` and ``ids``."""
    where = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(where, 0.0)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], np.uint32).tobytes()).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(documents: DataFrame, model: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """For each row: ``doc_id``, ``n_bytes``, ``n_pieces``, ``ids_crc32``, ``decoded_crc32`` and ``lossless``.

    Ids are encoded and decoded in one pass and only their digests leave the task.
    """
    where = model or default_model()
    names = ["doc_id", "n_bytes", "n_pieces", "ids_crc32", "decoded_crc32", "lossless"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(where, dropout, seed)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            keys = batch.column(0).to_pylist()
            for low, high in slices(texts):
                rows = []
                for text, key, ids in zip(texts[low:high], keys[low:high], codec.encode_all(texts[low:high], [k or 0 for k in keys[low:high]]), strict=True):
                    back = codec.decode(ids)
                    plain = text.encode()
                    rows.append((key, len(plain), len(ids) // 4, zlib.crc32(ids), zlib.crc32(back), back == plain))
                kinds = [pa.int64()] * 5 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _prepared(documents).mapInArrow(run, "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, decoded_crc32 long, lossless boolean")
