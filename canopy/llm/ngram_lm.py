"""Language-model scores from a log-frequency Bloom filter.

N-gram counts are quantised, qc(c) = 1 + floor(log2 c), and an n-gram enters the filter once for each level 1..qc.  A
count is read back by probing level after level until one is absent; the expected count of the last level present stands
for it.  Probabilities are interpolated from order to order:

    P(w | h) = (min(c(hw), c(h)) + ALPHA * P(w | shorter h)) / (c(h) + ALPHA),   P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))

*Counting.*  Each task makes its n-grams distinct with counts and deals them out by hash in packed form, so a very common
word pair is one entry of a task.  A destination adds the counts up and lays out its segment of the filter, with ``BITS``
bits for each level of each n-gram, so the filter grows with the input.  Up to ``FILTER_BYTES`` it is sent to all tasks.  A
larger one stays where it is: the distinct n-grams of some ``_CHUNK`` tokens go to the segments, and their levels come back
to the chunk's positions.  Both ways read the same bits.

*The base score* needs exact counts of words.  The commonest ``COMMON`` words go along with the filter; the other words of
each document meet their counts by hash, again packed, and sums return to the documents.

Defined results: a null text is empty (its only token is the end); a null id counts as the empty text for the training
split; rows that repeat an id are scored and counted one by one; without training tokens N and V are 0; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.words import WordMemo, batches_of, bounded_batches, hashed, mixed, route_keys, slices, utf8
from canopy.plans.materialize import parallelism, stage_table

ORDER, ALPHA = 2, 300.0
BITS, PROBES = 10, 5
FILTER_BYTES = 128 << 20
COMMON = 1 << 18
_END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))  # no word has a space
_LEVEL = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0xA0761D6478BD642F)
_HELD = 3_000_000
_SLICE = 1 << 20
_LOW40 = np.uint64((1 << 40) - 1)


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 1) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def _tokens(texts: list[bytes], memo: WordMemo) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, an end after each, and the documents' starts."""
    h, starts = hashed([x.lower().split() for x in texts], memo)
    tokens = np.insert(h, starts[1:], _END)
    return tokens, starts + np.arange(len(starts))


def _ngrams(tokens: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order up to ``order`` the hash of the n-gram that ends at each token; what precedes a text is its end.

    Texts follow one another, so the token before a text's first is the end of the text before it.
    """
    out = [mixed(tokens)]
    before = tokens
    for _ in range(1, order):
        before = np.r_[_END, before[:-1]]
        out.append(mixed(out[-1] * _STEP + before))
    return out


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def _pack(h: np.ndarray, count: np.ndarray, whole: bool) -> bytes:
    """Hashes with their counts: all 64 bits, or the 40 that the destination doesn't settle."""
    low = h & _LOW40
    bits = (h,) if whole else ((low & np.uint64(0xFFFFFFFF)).astype(np.uint32), (low >> np.uint64(32)).astype(np.uint8))
    return b"".join((np.array([len(h), whole], np.int64).tobytes(), *(x.tobytes() for x in bits), count.astype(np.uint32).tobytes()))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, whole = np.frombuffer(data, np.int64, 2).tolist()
    if whole:
        return np.frombuffer(data, np.uint64, n, 16), np.frombuffer(data, np.uint32, n, 16 + 8 * n).astype(np.int64)
    h = np.frombuffer(data, np.uint32, n, 16).astype(np.uint64) | (np.frombuffer(data, np.uint8, n, 16 + 4 * n).astype(np.uint64) << np.uint64(32))
    return h, np.frombuffer(data[16 + 5 * n :], np.uint32, n).astype(np.int64)


_COUNTED = pa.schema([("route", pa.int32()), ("part", pa.int32()), ("order", pa.int32()), ("data", pa.binary())])


def _count(order: int, keys: list[int]):
    parts = len(keys)

    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rows = {"route": [], "part": [], "order": [], "data": []}
        for n, pieces in enumerate(held):
            if not pieces:
                continue
            h, count = np.unique(np.concatenate(pieces), return_counts=True)
            to = _part(h, parts)
            by = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[by], np.arange(parts + 1))
            for k in range(parts):
                own = by[cuts[k] : cuts[k + 1]]
                if len(own):
                    rows["route"].append(keys[k])
                    rows["part"].append(k)
                    rows["order"].append(n)
                    rows["data"].append(_pack(h[own], count[own], n == 0))
            pieces.clear()
        yield from batches_of(rows, _COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, n = WordMemo(), [[] for _ in range(order)], 0
        for batch in batches:
            texts = utf8(batch.column(0))
            for low, high in slices(texts, _SLICE):
                tokens, _ = _tokens(texts[low:high], memo)
                for own, x in zip(held, _ngrams(tokens, order), strict=True):
                    own.append(x)
                n += len(tokens)
                if n >= _HELD:
                    yield from flush(held)
                    n = 0
        yield from flush(held)

    return run


def _levels(count: np.ndarray) -> np.ndarray:
    return np.frexp(count.astype(np.float64))[1]  # 1 + floor(log2)


def _place(g: np.ndarray, probe: int, size) -> np.ndarray:
    """Bit of a probe in a segment of ``size`` bits."""
    step = (g >> np.uint64(32)) | np.uint64(1)
    return ((((g + np.uint64(probe) * step) & np.uint64(0xFFFFFFFF)) * size) >> np.uint64(32)).astype(np.int64)


_SUMMED = pa.schema([("part", pa.int32()), ("route", pa.int32()), ("n", pa.int64()), ("v", pa.int64()), ("bits", pa.binary()), ("counts", pa.binary()), ("common", pa.binary())])


def _sum_up(order: int, keys: list[int], common: int):
    parts = len(keys)
    share = max(1, common // parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[list]] = {}
        for batch in batches:
            for _, part, n, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                got.setdefault(part, [[] for _ in range(order)])[n].append(_unpack(data))
        for part, by_order in got.items():
            grams = []
            for pieces in by_order:
                if not pieces:
                    grams.append((np.empty(0, np.uint64), np.empty(0, np.int64)))
                    continue
                h, count = (np.concatenate(x) for x in zip(*pieces, strict=True))
                pieces.clear()
                by = np.argsort(h)
                h, count = h[by], count[by]
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                grams.append((h[first], np.add.reduceat(count, first)))
            level = [_levels(c) for _, c in grams]
            events = sum(int(x.sum()) for x in level)
            size = max(8, -(-events * BITS // 8) * 8)
            table = np.zeros(size, bool)
            for (h, _), own in zip(grams, level, strict=True):
                for j in range(1, int(own.max(initial=0)) + 1):
                    g = mixed((h[own >= j] & _LOW40) * _LEVEL + np.uint64(j))
                    for probe in range(PROBES):
                        table[_place(g, probe, np.uint64(size))] = True
            h, count = grams[0]
            top = np.argsort(-count, kind="stable")[:share]
            top = np.sort(top)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], f.type) for x, f in zip((part, keys[part], int(count.sum()), len(h), np.packbits(table, bitorder="little").tobytes(), _pack(h, count, True), _pack(h[top], count[top], True)), _SUMMED, strict=True)], schema=_SUMMED
            )

    return run


class LogFrequencyFilter:
    """Segments of the filter, unless it is visited where it is, with the exact counts of the commonest words."""

    def __init__(self, parts: int, segments: list, visited: bool = False) -> None:
        self.parts, self.visited = parts, visited
        self.n, self.v = sum(r["n"] for r in segments), sum(r["v"] for r in segments)
        self.base, self.size = np.zeros(parts, np.int64), np.full(parts, 8, np.uint64)
        blocks, at = [b"\0"], 1
        words, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for r in segments:
            if not visited:
                self.base[r["part"]], self.size[r["part"]] = at * 8, len(r["bits"]) * 8
                blocks.append(bytes(r["bits"]))
                at += len(r["bits"])
            h, count = _unpack(bytes(r["common"]))
            words.append(h)
            counts.append(count)
        self.bytes = np.frombuffer(b"".join(blocks), np.uint8)
        words, counts = np.concatenate(words), np.concatenate(counts)
        by = np.argsort(words)
        self.words, self.counts = words[by], counts[by]

    def exact(self, h: np.ndarray) -> np.ndarray:
        """Counts of common words, -1 for others."""
        if not len(self.words):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.counts[at], -1)

    def _present(self, h, base, size, level: int) -> np.ndarray:
        """Which n-grams have all bits of a level."""
        left = np.arange(len(h))
        g = mixed(h * _LEVEL + np.uint64(level))
        for i in range(PROBES):
            bit = base[left] + _place(g[left], i, size[left])
            left = left[(self.bytes[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
        return left

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The last level that repeated probes find."""
        unique, back = np.unique(h, return_inverse=True)
        part = _part(unique, self.parts)
        low, base, size = unique & _LOW40, self.base[part], self.size[part]
        level, alive = np.zeros(len(unique), np.int64), np.arange(len(unique))
        for j in range(1, 60):
            alive = alive[self._present(low[alive], base[alive], size[alive], j)]
            if not len(alive):
                break
            level[alive] = j
        return level[back]

    def expected(self, h: np.ndarray) -> np.ndarray:
        return _expected(self.levels(h))


def _expected(level: np.ndarray) -> np.ndarray:
    """Expected counts behind levels."""
    level = level.astype(np.int64)
    return np.where(level > 0, (np.exp2(level - 1) + np.exp2(level) - 1) / 2, 0.0)


def _logs(counts: list[np.ndarray], below: float, alpha: float) -> np.ndarray:
    """Logarithms of tokens' probabilities; ``counts`` of each order begin with that of what precedes the first token."""
    p = (counts[0][1:] + 0.5) / below
    for k in range(1, len(counts)):
        # The history of an n-gram is the n-gram that ended at the token before.
        history = counts[k - 1][:-1]
        p = (np.minimum(counts[k][1:], history) + alpha * p) / (history + alpha)
    return np.log10(p)


def _with_start(grams: list[np.ndarray]) -> list[np.ndarray]:
    return [np.r_[_ngrams(np.array([_END]), k + 1)[k], x] for k, x in enumerate(grams)]


#: Tokens whose n-grams visit the segments of a large filter together.
_CHUNK = 1_000_000
_SUM, _PARCEL, _DOC, _ASK, _ANSWER, _BODY = -1, 0, 1, 2, 3, 4
_SCORED = pa.schema(
    [("kind", pa.int32()), ("route", pa.int32()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("part", pa.int32()), ("data", pa.binary())]
)
_SCORED_DDL = "kind int, route int, uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, part int, data binary"


def _score(order: int, alpha: float, keys: list[int], model):
    parts = len(keys)

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The uncommon words, dealt out to their counts."""
        if not held:
            return
        h, uid = (np.concatenate(x) for x in zip(*held, strict=True))
        to = _part(h, parts)
        rows = {f.name: [] for f in _SCORED}
        by = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[by], np.arange(parts + 1))
        for k in range(parts):
            own = by[cuts[k] : cuts[k + 1]]
            if len(own):
                for f in _SCORED:
                    rows[f.name].append(None)
                rows["kind"][-1], rows["route"][-1], rows["part"][-1] = _PARCEL, keys[k], k
                rows["data"][-1] = np.array([len(own)], np.int64).tobytes() + h[own].tobytes() + uid[own].tobytes()
        yield from batches_of(rows, _SCORED)

    def visits(chunk: int, pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
        """A chunk's distinct n-grams for each segment, and a body that tells where their levels belong."""
        if not pieces:
            return
        tokens, sizes = (np.concatenate(x) for x in zip(*pieces, strict=True))
        rows = {f.name: [] for f in _SCORED}

        def add(**values) -> None:
            for name, column in rows.items():
                column.append(values.get(name))

        body = [np.array([len(tokens), len(sizes)], np.int64).tobytes(), sizes.astype(np.int64).tobytes()]
        for n, x in enumerate(_with_start(_ngrams(tokens, order))):
            unique, back = np.unique(x, return_inverse=True)
            to = _part(unique, parts)
            by = np.argsort(to, kind="stable")
            place = np.empty(len(by), np.int32)
            place[by] = np.arange(len(by), dtype=np.int32)
            body.append(place[back].tobytes())
            cuts = np.searchsorted(to[by], np.arange(parts + 1))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                add(kind=_ASK, route=keys[k], uid=chunk, part=k, data=np.array([n], np.int64).tobytes() + unique[by[cuts[k] : cuts[k + 1]]].tobytes())
        add(kind=_BODY, route=_home(chunk, keys), uid=chunk, data=b"".join(body))
        yield from batches_of(rows, _SCORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm: LogFrequencyFilter = model.value
        memo, held, n = WordMemo(), [], 0
        pieces, waiting, chunk = [], 0, 0
        task = TaskContext.get()
        uid = (task.partitionId() if task else 0) << 40
        below = lm.n + 0.5 * (lm.v + 1)
        for batch in batches:
            ids, out = batch.column(0), batch.column(1)
            texts = utf8(batch.column(2))
            for low, high in slices(texts, _SLICE):
                tokens, starts = _tokens(texts[low:high], memo)
                first, own = starts[:-1], np.repeat(np.arange(high - low), np.diff(starts))
                grams = _ngrams(tokens, order)
                exact = lm.exact(grams[0])
                common = exact >= 0
                base = np.where(common, np.log10((np.maximum(exact, 0) + 0.5) / below), 0.0)
                if lm.visited:
                    chunk = chunk if pieces else uid
                    pieces.append((tokens, np.diff(starts)))
                    waiting += len(tokens)
                    score = pa.nulls(high - low, pa.float64())
                else:
                    score = pa.array(np.add.reduceat(_logs([lm.expected(x) for x in _with_start(grams)], below, alpha), first))
                rest = np.flatnonzero(~common)
                if len(rest):
                    held.append((grams[0][rest], uid + own[rest]))
                    n += len(rest)
                size = high - low
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(size, _DOC, np.int32)),
                        pa.array(np.array(keys, np.int32)[(uid + np.arange(size)) % parts]),
                        pa.array(uid + np.arange(size)),
                        ids.slice(low, size),
                        out.slice(low, size),
                        pa.array(np.diff(starts)),
                        pa.array(np.add.reduceat((exact > 0).astype(np.int64), first)),
                        pa.array(np.add.reduceat(base, first)),
                        score,
                        pa.nulls(size, pa.int32()),
                        pa.nulls(size, pa.binary()),
                    ],
                    schema=_SCORED,
                )
                uid += size
                if n >= _HELD:
                    yield from flush(held)
                    held, n = [], 0
                if waiting >= _CHUNK:
                    yield from visits(chunk, pieces)
                    pieces, waiting = [], 0
        yield from flush(held)
        yield from visits(chunk, pieces)

    return run


def _home(chunk: int, keys: list[int]) -> int:
    return keys[int(mixed(np.array([chunk], np.uint64))[0]) % len(keys)]


_ANSWERS = pa.schema([("kind", pa.int32()), ("route", pa.int32()), ("uid", pa.int64()), ("part", pa.int32()), ("data", pa.binary())])


def _answer(keys: list[int]):
    """Levels of the n-grams that visit a segment, which comes before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: dict[int, LogFrequencyFilter] = {}
        for batch in batches:
            rows = {f.name: [] for f in _ANSWERS}
            for kind, uid, part, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if kind < 0:
                    segments[part] = LogFrequencyFilter(1, [{"part": 0, "n": 0, "v": 0, "bits": data, "common": _pack(np.empty(0, np.uint64), np.empty(0, np.int64), True)}])
                    continue
                h = np.frombuffer(data, np.uint64, -1, 8)
                level = segments[part].levels(h) if part in segments else np.zeros(len(h))
                for name, value in zip(rows, (_ANSWER, _home(uid, keys), uid, part, data[:8] + level.astype(np.uint8).tobytes()), strict=True):
                    rows[name].append(value)
            yield from batches_of(rows, _ANSWERS)

    return run


def _combine(order: int, alpha: float, keys: list[int], below: float):
    """Scores by document, from the levels of a chunk and the body behind them."""
    parts = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: list[dict[int, bytes]] = [{} for _ in range(order)]
        for batch in batches:
            rows = {"kind": [], "route": [], "data": []}
            for kind, chunk, part, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if kind == _ANSWER:
                    levels[int(np.frombuffer(data, np.int64, 1)[0])][part] = data[8:]
                    continue
                n, size = np.frombuffer(data, np.int64, 2).tolist()
                sizes = np.frombuffer(data, np.int64, size, 16)
                counts = []
                for k, own in enumerate(levels):
                    found = _expected(np.frombuffer(b"".join(own[x] for x in sorted(own)), np.uint8))
                    counts.append(found[np.frombuffer(data, np.int32, n + 1, 16 + 8 * size + 4 * k * (n + 1))])
                    own.clear()
                score = np.add.reduceat(_logs(counts, below, alpha), np.cumsum(sizes) - sizes)
                uid = chunk + np.arange(size)
                for k in np.unique(uid % parts).tolist():
                    own = uid % parts == k
                    rows["kind"].append(_SUM)
                    rows["route"].append(keys[k])
                    rows["data"].append(np.array([int(own.sum())], np.int64).tobytes() + uid[own].tobytes() + score[own].tobytes())
            yield from batches_of(rows, _SUMS)

    return run


_SUMS = pa.schema([("kind", pa.int32()), ("route", pa.int32()), ("data", pa.binary())])


def _look_up(keys: list[int], below: float):
    """Sums by document of the uncommon words' terms: the counts of a destination come first, then what asks for them."""
    parts = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, tuple] = {}
        uids, known, sums = [], [], []
        for batch in batches:
            for kind, part, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if kind < 0:
                    counts[part] = _unpack(data)
                    continue
                n = int(np.frombuffer(data, np.int64, 1)[0])
                h, uid = np.frombuffer(data, np.uint64, n, 8), np.frombuffer(data, np.int64, n, 8 + 8 * n)
                words, count = counts.get(part, (np.empty(0, np.uint64), np.empty(0, np.int64)))
                c = np.zeros(n, np.int64)
                if len(words):
                    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                    c = np.where(words[at] == h, count[at], 0)
                by = np.argsort(uid, kind="stable")
                first = np.flatnonzero(np.r_[True, uid[by][1:] != uid[by][:-1]])
                uids.append(uid[by][first])
                known.append(np.add.reduceat((c > 0)[by].astype(np.int64), first))
                sums.append(np.add.reduceat(np.log10((c + 0.5) / below)[by], first))
        if not uids:
            return
        uid, n, x = np.concatenate(uids), np.concatenate(known), np.concatenate(sums)
        to = uid % parts
        rows = {"kind": [], "route": [], "data": []}
        for k in np.unique(to):
            own = to == k
            rows["kind"].append(_PARCEL)
            rows["route"].append(keys[k])
            rows["data"].append(np.array([int(own.sum())], np.int64).tobytes() + uid[own].tobytes() + n[own].tobytes() + x[own].tobytes())
        yield from batches_of(rows, _SUMS)

    return run


def _add_up(train_tokens: int):
    out = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, sums, scores = [], None, {}
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for data in batch.column("data").filter(pa.array(kinds == _PARCEL)).to_pylist():
                n = int(np.frombuffer(data, np.int64, 1)[0])
                pieces.append((np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.int64, n, 8 + 8 * n), np.frombuffer(data, np.float64, n, 8 + 16 * n)))
            for data in batch.column("data").filter(pa.array(kinds == _SUM)).to_pylist():
                n = int(np.frombuffer(data, np.int64, 1)[0])
                scores.update(zip(np.frombuffer(data, np.int64, n, 8).tolist(), np.frombuffer(data, np.float64, n, 8 + 8 * n).tolist(), strict=True))
            docs = batch.filter(pa.array(kinds == _DOC))
            if not docs.num_rows:
                continue
            if sums is None:
                uid, known, x = (np.concatenate(c) for c in zip(*pieces, strict=True)) if pieces else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
                by = np.argsort(uid, kind="stable")
                sums = uid[by], np.r_[0, np.cumsum(known[by])], x[by]
            own = docs.column("uid").to_numpy()
            low, high = np.searchsorted(sums[0], own), np.searchsorted(sums[0], own, side="right")
            known = sums[1][high] - sums[1][low]
            terms = np.array([sums[2][a:b].sum() for a, b in zip(low.tolist(), high.tolist(), strict=True)], np.float64)
            yield pa.RecordBatch.from_arrays(
                [docs.column("doc_id"), docs.column("held_out"), docs.column("n_tokens"), pa.array(docs.column("n_known").to_numpy() + known), pa.array(np.full(docs.num_rows, train_tokens, np.int64)), pa.array(docs.column("base_score").to_numpy() + terms), pa.array([scores[u] for u in own.tolist()], pa.float64()) if scores else docs.column("score")],
                names=out,
            )

    return run


def score_documents(documents: DataFrame, is_held_out: Column | None = None, order: int = ORDER, alpha: float = ALPHA, filter_bytes: int = FILTER_BYTES, common: int = COMMON) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``documents``.

    Words are lower-cased in A-Z; each text has one end token.  The model and the exact counts come from all rows that
    are not held out.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    parts = parallelism(spark)
    keys = route_keys(parts)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (held_out() if is_held_out is None else is_held_out).alias("held_out"), "text")
    dealt = rows.where("NOT held_out").select("text").mapInArrow(_count(order, keys), "route int, part int, order int, data binary").repartition(parts, "route")
    summed = stage_table(dealt.mapInArrow(_sum_up(order, keys, common), "part int, route int, n long, v long, bits binary, counts binary, common binary"))
    size = summed.agg(F.sum(F.length("bits"))).first()[0] or 0
    visited = size > filter_bytes
    lm = LogFrequencyFilter(parts, summed.select("part", "n", "v", "common", *([] if visited else ["bits"])).collect(), visited)  # filter_bytes and ``common`` words at most
    model = spark.sparkContext.broadcast(lm)
    scored = stage_table(rows.mapInArrow(_score(order, alpha, keys, model), _SCORED_DDL))
    asking = scored.where(f"kind = {_PARCEL}").select("kind", "part", "data", "route")
    counts = summed.select(F.lit(-1).alias("kind"), "part", F.col("counts").alias("data"), "route")
    sums = counts.unionByName(asking).repartition(parts, "route").sortWithinPartitions("kind").select("kind", "part", "data").mapInArrow(_look_up(keys, lm.n + 0.5 * (lm.v + 1)), "kind int, route int, data binary")
    if visited:
        segments = summed.select(F.lit(-1).alias("kind"), F.lit(None).cast("long").alias("uid"), "part", F.col("bits").alias("data"), "route")
        asked = segments.unionByName(scored.where(f"kind = {_ASK}").select("kind", "uid", "part", "data", "route")).repartition(parts, "route").sortWithinPartitions("kind")
        answers = asked.select("kind", "uid", "part", "data").mapInArrow(_answer(keys), "kind int, route int, uid long, part int, data binary")
        bodies = scored.where(f"kind = {_BODY}").select("kind", "route", "uid", "part", "data")
        home = answers.unionByName(bodies).repartition(parts, "route").sortWithinPartitions("uid", "kind").select("kind", "uid", "part", "data")
        sums = sums.unionByName(home.mapInArrow(_combine(order, alpha, keys, lm.n + 0.5 * (lm.v + 1)), "kind int, route int, data binary"))
    together = scored.where(f"kind = {_DOC}").drop("data").unionByName(sums, allowMissingColumns=True)
    return together.repartition(parts, "route").sortWithinPartitions("kind").mapInArrow(_add_up(lm.n), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
