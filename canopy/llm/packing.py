"""Packing of examples into sequences under several limits at once, by the dot-product heuristic.

An example has a demand on tokens, on segments (itself: one) and on loss-bearing tokens; a sequence has a limit on each.
A sequence is filled by placing, again and again, the example that fits and has the largest dot product of its demand with
what is left of the sequence, each dimension weighted by its mean demand; when none fits, the next sequence is opened.

Examples are dealt by hash into bins' worlds of about ``WORLD`` examples, each packed by itself: a world is bounded, its
last sequence is the only one that is short for want of examples, and no key can gather in one task.

Texts longer than a sequence are cut into whole sequences and a rest.  Conversations are one example each; one over a
limit is cut into its turns, and these at the limit.  Token ids are those of the ``tokenizers`` file; the engine here is
its equal from the same vocabulary, and takes a simpler pattern where no two spaces meet.  A space between two other
characters always starts a new pre-token, so long texts are encoded between such spaces independently.

Defined results: a null text is empty (its only id is the end); a null id passes through; rows that repeat an id are
packed one by one; an empty table gives an empty result; an example over a limit by itself fits nowhere and is set aside:
its sequence and offset are null; columns of examples whose names begin with ``__`` are reserved, others pass through.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.words import bounded_batches, slices, trimmed
from canopy.plans.materialize import parallelism, stage_table

#: Limits of a sequence: tokens, segments, loss-bearing tokens.
LIMITS = (1024, 64, 1024)
WORLD = 4096
END_ID = 0
#: Characters of a text that are encoded at once.
_STRETCH = 1 << 18
_PLAIN_SPACE = re.compile(r"(?<=\S) (?=\S)")
_RUN_OF_SPACE = re.compile(r"\s\s")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable bytes stand for themselves, the rest follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts, as the ``tokenizers`` library gives them, as little-endian unsigned 32-bit bytes.

    A text that holds an added token of the vocabulary (``<|endoftext|>``) goes to the library itself.
    """

    def __init__(self, vocabulary: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(vocabulary, encoding="utf-8") as lines:
            parts = json.load(lines)
        self._vocabulary, self._library = vocabulary, None
        added = {x["content"]: x["id"] for x in parts["added_tokens"]}
        self._added = re.compile("|".join(map(re.escape, added))) if added else None
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in parts["model"]["vocab"].items() if token not in added}
        del parts

        def engine(pattern: str):
            return tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        # Where no two spaces meet, the end of the pattern, which looks ahead, comes to this.
        self._encode = engine(public_tokenizers.PATTERN.replace(r"\s+(?!\S)|\s+", r"\s"))
        self._encode_spaced = lru_cache(maxsize=1)(lambda: engine(public_tokenizers.PATTERN))

    def _whole(self, text: str) -> bytes:
        """Ids by the library, which is loaded when it is first needed."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._vocabulary)
        return np.array(self._library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def ids(self, text: str) -> bytes:
        if self._added and self._added.search(text):
            return self._whole(text)
        return b"".join([np.array((self._encode_spaced() if _RUN_OF_SPACE.search(x) else self._encode)(x), np.uint32).tobytes() for x in _stretches(text)])


def _stretches(text: str) -> Iterator[str]:
    """The text in stretches of bounded size, cut before plain spaces; it is longer only where it has none."""
    low = 0
    while low < len(text):
        cut = _PLAIN_SPACE.search(text, low + _STRETCH)
        high = cut.start() if cut else len(text)
        yield text[low:high]
        low = high


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Encoder:
    """The encoder of this process, which its tasks share one after another."""
    return Encoder(vocabulary)


def document_pieces(documents: DataFrame, max_tokens: int = LIMITS[0], vocabulary: str | None = None) -> DataFrame:
    """Pieces of whole texts: ``doc_id, start, length, ids_crc32, doc_tokens`` and a ``uid`` for each."""
    where = vocabulary or default_vocabulary()
    bounded_batches(documents.sparkSession)
    names = ["doc_id", "uid", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = encoder(where)
        end = np.array([END_ID], np.uint32).tobytes()
        task = TaskContext.get()
        uid = (task.partitionId() if task else 0) << 40
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for low, high in slices(texts):
                rows: list[tuple] = []
                for doc_id, text in zip(ids[low:high], texts[low:high], strict=True):
                    data = engine.ids(text) + end
                    n = len(data) // 4
                    for start in range(0, n, max_tokens):
                        piece = data[4 * start : 4 * (start + max_tokens)]
                        rows.append((doc_id, uid, start, len(piece) // 4, zlib.crc32(piece), n))
                        uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), ", ".join(f"{c} long" for c in names))


def pack_world(demands: np.ndarray, limits: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number (-1: over a limit by itself) and first token of each example of a world, one row of ``demands`` each."""
    d = demands / np.asarray(limits, float)
    n = len(d)
    fitting = (d <= 1).all(axis=1)
    bin_of, offset = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    full = np.flatnonzero(fitting & (demands[:, 0] == limits[0]))
    bin_of[full] = np.arange(len(full))
    bins = len(full)
    weighted = d * d[fitting].mean(axis=0) if fitting.any() else d
    left = np.flatnonzero(fitting & (bin_of < 0))
    # Larger examples first, so that equal dot products go to the larger, then to the earlier.
    left = left[np.argsort(-demands[left, 0], kind="stable")]
    exact = demands[left]
    weighted = weighted[left]
    alive = np.ones(len(left), bool)
    count = len(left)
    while count:
        room = np.asarray(limits, np.int64).copy()
        at = 0
        while count:
            fits = alive & (exact <= room).all(axis=1)
            candidates = np.flatnonzero(fits)
            if not len(candidates):
                break
            pick = candidates[np.argmax(weighted[candidates] @ (room / np.asarray(limits, float)))]
            bin_of[left[pick]], offset[left[pick]] = bins, at
            at += exact[pick, 0]
            room -= exact[pick]
            alive[pick] = False
            count -= 1
        bins += 1
        if count < len(left) // 2:  # forget what is placed
            left, exact, weighted, alive = left[alive], exact[alive], weighted[alive], np.ones(count, bool)
    return bin_of, offset


def pack(examples: DataFrame, limits: Sequence[int] = LIMITS, world: int = WORLD) -> DataFrame:
    """``examples`` (with ``uid`` and demands ``tokens``, ``segments``, ``loss_tokens``) plus ``sequence_id``, ``offset``.

    ``examples`` should be a staged table: it is counted, then dealt into worlds.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = examples.sparkSession
    worlds = max(1, -(-examples.count() // world))
    dealt = examples.withColumn("__world", F.pmod(F.xxhash64("uid"), F.lit(worlds)).cast("long"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in examples.schema) + ", sequence_id long, offset long"
    plain = to_arrow_schema(examples.schema)

    def packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        number = table.column("__world")[0].as_py()
        table = table.sort_by("uid")
        demands = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("tokens", "segments", "loss_tokens")], axis=1)
        bins, offset = pack_world(demands, limits)
        aside = bins < 0
        out = table.select(plain.names).append_column("sequence_id", pa.array((number << 24) + bins, mask=aside)).append_column("offset", pa.array(offset, mask=aside))
        yield from out.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            number = table.column("__world").to_numpy()
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                piece = table.slice(low, high - low)
                if held and held[0].column("__world")[0] != piece.column("__world")[0]:
                    yield from packed(pa.concat_tables(held))
                    held = []
                held.append(piece)
        if held:
            yield from packed(pa.concat_tables(held))

    return dealt.repartition(parallelism(spark), "__world").sortWithinPartitions("__world").mapInArrow(trimmed(run), ddl)


def pack_documents(documents: DataFrame, limits: Sequence[int] = LIMITS, vocabulary: str | None = None) -> DataFrame:
    """Every id of every document in exactly one piece of one sequence.

    In plain documents every token bears loss except a document's first, which nothing precedes.
    """
    pieces = document_pieces(documents, limits[0], vocabulary)
    demands = pieces.withColumns({"tokens": F.col("length"), "segments": F.lit(1).cast("long"), "loss_tokens": F.col("length") - F.when(F.col("start") == 0, 1).otherwise(0)})
    return pack(stage_table(demands), limits).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def conversation_examples(conversations: DataFrame, limits: Sequence[int] = LIMITS, vocabulary: str | None = None) -> DataFrame:
    """Examples from ``conversations(conv_id, turn, role, text)``: ``conv_id, turn, start, uid`` and their demands.

    A turn has its tokens and an end; only the assistant's bear loss.  A conversation within the limits is one example
    (``turn`` and ``start`` null); of a longer one, and where the id is null, each turn is an example, cut at the limit
    on tokens and that on loss.
    """
    where = vocabulary or default_vocabulary()
    spark = conversations.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = encoder(where)
        for batch in batches:
            n = [len(engine.ids(x or "")) // 4 + 1 for x in batch.column(2).to_pylist()]
            loss = [k if role == "assistant" else 0 for k, role in zip(n, batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(loss, pa.int64())], names=["conv_id", "turn", "tokens", "loss_tokens"])

    source = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text", "role")
    turns = stage_table(source.mapInArrow(trimmed(run), "conv_id long, turn long, tokens long, loss_tokens long"))
    totals = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sum("tokens").alias("tokens"), F.sum("loss_tokens").alias("loss_tokens"))
    fits = (F.col("tokens") <= limits[0]) & (F.col("loss_tokens") <= limits[2])
    totals = stage_table(totals)
    one = F.lit(1).cast("long").alias("segments")
    whole = totals.where(fits).select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("long").alias("start"), F.xxhash64("conv_id").alias("uid"), "tokens", one, "loss_tokens")
    most = F.when(F.col("loss_tokens") > 0, F.lit(min(limits[0], limits[2]))).otherwise(F.lit(limits[0]))
    cut = turns.join(totals.where(fits).select("conv_id"), "conv_id", "left_anti").withColumn("most", most.cast("long")).withColumn("start", F.explode(F.expr("sequence(0L, tokens - 1, most)")))
    length = F.least(F.col("most"), F.col("tokens") - F.col("start"))
    pieces = cut.select("conv_id", "turn", "start", F.xxhash64("conv_id", "turn", "start", "tokens").alias("uid"), length.alias("tokens"), one, F.when(F.col("loss_tokens") > 0, length).otherwise(0).cast("long").alias("loss_tokens"))
    return whole.unionByName(pieces)
