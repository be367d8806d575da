"""Language-model scores by deleted interpolation of word pairs.

The probability of a token ``w`` after ``v`` mixes three estimates::

    P(w | v) = a2 c(v w) / c(v) + a1 c(w) / N + a0 / (V + 1)

with counts of the training documents (maximum likelihood) and weights that depend
on how often the context was seen: one set for each power of two of ``c(v)``.
They are learned by expectation-maximisation on deleted documents: of the
training documents one in ``DELETED`` is put aside, its pairs are counted, and the
weights make them likeliest under the counts of the rest.  Scores then use the
counts of all training documents.  An unseen context has no pair estimate; the
uniform part covers the V known tokens and one for all unknown ones, so that P
adds up to 1.  A text's first context is a begin mark, its last token an end.

Counts aren't looked up by token.  Documents are staged in blocks of bounded size,
each of one kind (training, deleted, held out).  A block asks once for each of its
distinct tokens and pairs, whatever their number, in packed runs of sorted hashes
dealt by the hashes' first bits (shards); a shard adds up what training blocks
bring and answers each block in the order it asked; answers meet their block on
its number, and the block scores its documents.  The number of shards grows with
the questions, so a shard's size doesn't, and a frequent token is one question a
block, not one a document.  Nothing is broadcast, and only histogram cells (below)
and totals reach the driver.

The likelihood of a deleted pair depends on its context's power of two and on the
ratios of the two estimates to the uniform one.  Those are rounded to eighths
of a power of two, and the deleted pairs are counted by cell; as counts have at
most 63 bits, the cells are bounded whatever the corpus, and the driver iterates
over them.

A null text counts as empty and has its end alone; a null id counts as the empty
string where documents are dealt, and stays null; repeated rows count again and get
equal rows; a very long text is a block of its own, hashed a piece at a time;
columns besides ``doc_id`` and ``text`` are not read; an empty table gives an
empty result, and without training documents P is 1 for the one unknown token.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, staged, word_hashes

#: One in so many documents is held out, that with this remainder; one in so many training documents is deleted.
HELD_OUT, REMAINDER, DELETED = 7, 2, 10
TRAINING, DELETED_PART, HELD_PART = 0, 1, 2
#: Bytes of text of a block, and that are hashed at a time; questions of a shard, about.
BLOCK_BYTES, PIECE_BYTES, SHARD_KEYS = 4_000_000, 1 << 20, 1 << 20
#: Cells of a power of two, and iterations.
STEPS, ITERATIONS = 8, 60

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_END, _PRIME = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15)
_ONE_PAIR = np.uint64(0x165667B19E3779F9)


def hashes_of(raw: bytes) -> np.ndarray:
    """Hashes of the lower-cased words of a text, taken in pieces that end between words."""
    raw = raw.translate(_LOWER)
    if len(raw) <= PIECE_BYTES:
        return word_hashes(raw)[0]
    out, at = [], 0
    while at < len(raw):
        stop = min(len(raw), at + PIECE_BYTES)
        if stop < len(raw):
            back = max(raw.rfind(c, at, stop) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if back <= at:  # a word longer than a piece
                later = [x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := raw.find(c, stop)) >= 0]
                back = min(later, default=len(raw))
            stop = max(back, at + 1)
        out.append(word_hashes(raw[at:stop])[0])
        at = stop
    return np.concatenate(out)


def part_of(doc_id: int | None) -> int:
    """What a document is for, by the CRC-32 of its id."""
    crc = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if crc % HELD_OUT == REMAINDER:
        return HELD_PART
    return DELETED_PART if crc // HELD_OUT % DELETED == 0 else TRAINING


@dataclass
class Tokens:
    """The tokens of a block's documents: hashes, the documents' ends among them, sorted distinct keys and each token's places there."""

    ends: np.ndarray
    keys: np.ndarray
    times: np.ndarray
    token: np.ndarray
    context: np.ndarray
    pair: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Tokens:
        mark = np.array([_END], np.uint64)
        parts, sizes, some, held = [], [], [], 0
        for raw in [*texts, None]:
            if some and (raw is None or held + len(raw) > PIECE_BYTES):
                # short texts are hashed together, a line break between them
                h, start, _ = word_hashes(b"\n".join(some).translate(_LOWER))
                edge = np.cumsum([len(x) + 1 for x in some])
                n = np.diff(np.searchsorted(start, edge), prepend=0)
                parts.append(np.insert(h, np.cumsum(n), _END))
                sizes.append(n + 1)
                some, held = [], 0
            if raw is not None and len(raw) > PIECE_BYTES:
                own = hashes_of(raw)
                parts += [own, mark]
                sizes.append(np.array([len(own) + 1]))
            elif raw is not None:
                some.append(raw)
                held += len(raw)
        words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        ends = np.cumsum(np.concatenate(sizes)) if sizes else np.empty(0, np.int64)
        # what stands before a first token is a begin mark, which occurs as often as the end
        before = np.concatenate([mark, words[:-1]]) if len(words) else words
        single, place = np.unique(mix(words), return_inverse=True)
        double, pair = np.unique(mix((before * _PRIME + words) ^ _ONE_PAIR), return_inverse=True)
        # a key's last bit tells tokens from pairs
        single, double = single << np.uint64(1), double << np.uint64(1) | np.uint64(1)
        keys = np.concatenate([single, double])
        order = np.argsort(keys, kind="stable")
        at = np.empty(len(keys), np.int64)
        at[order] = np.arange(len(keys))
        times = np.concatenate([np.bincount(place, minlength=len(single)), np.bincount(pair, minlength=len(double))])[order]
        token, pair = at[: len(single)][place], at[len(single) :][pair]
        # keys stand in the order of their hashes; the end of a text before is the begin of the next
        first = token[ends[0] - 1] if len(ends) else 0
        context = np.concatenate([[first], token[:-1]]).astype(np.int64) if len(words) else np.empty(0, np.int64)
        return cls(ends, keys[order], times.astype(np.int64), token, context, pair)


def _planes(x: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def _flat(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the planes of their differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_flat(data, np.uint64), dtype=np.uint64)


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, part, ids, texts): documents of one part, some ``block_bytes`` of them; stage it, since numbers are those of this run."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, made = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list, list]] = {}
        pack = zstandard.ZstdCompressor(level=3)

        def emit(part: int) -> pa.RecordBatch:
            nonlocal made
            ids, texts, _ = held.pop(part)
            made += 1
            sizes = np.array([len(x) for x in texts], np.int64)
            data = pack.compress(sizes.tobytes() + b"".join(texts))
            return pa.record_batch([pa.array([number << 32 | made], pa.int64()), pa.array([part], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([data], pa.binary())], names=["block", "part", "ids", "texts"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py().encode() if text.is_valid else b""
                part = part_of(doc_id)
                if part in held and held[part][2][0] + len(raw) > block_bytes:
                    yield emit(part)
                own = held.setdefault(part, ([], [], [0]))
                own[0].append(doc_id)
                own[1].append(raw)
                own[2][0] += len(raw) + 64
        for part in list(held):
            yield emit(part)

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return texts.mapInArrow(run, "block long, part int, ids array<long>, texts binary")


def unpack_texts(n: int, data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = np.cumsum(np.frombuffer(raw, np.int64, n)) + 8 * n
    return [raw[a:b] for a, b in zip([8 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def questions(held: DataFrame, bits: int) -> DataFrame:
    """(shard, block, part, keys, times): what each block asks of each shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, part, ids, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = Tokens.of(unpack_texts(len(ids), data))
                shard = (own.keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(own.keys), np.int64)
                cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
                rows = [(int(shard[a]), block, part, pack_keys(own.keys[a:b]), _planes(np.minimum(own.times[a:b], 0xFFFFFFFF).astype(np.uint32))) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
                columns = list(zip(*rows, strict=True))
                yield pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.binary())], names=["shard", "block", "part", "keys", "times"])

    return held.mapInArrow(run, "shard int, block long, part int, keys binary, times binary")


_ANSWERS = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("part", pa.int32()), ("kept", pa.binary()), ("known", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("kept_n", pa.int64()), ("kept_v", pa.int64())])


def answers(asked: DataFrame) -> DataFrame:
    """Counts in the order of each question, and a row of totals for each shard (``block`` null).

    ``known`` counts all training documents, ``kept`` those that are not deleted,
    and is given to deleted blocks alone.
    """

    def run(table: pa.Table) -> pa.Table:
        block, part, shard = (table[c].to_pylist() for c in ("block", "part", "shard"))
        keys = [unpack_keys(x) for x in table["keys"].to_pylist()]
        ends = np.cumsum([0, *(len(x) for x in keys)])
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        kept, gone = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        for i, data in enumerate(table["times"].to_pylist()):
            if part[i] != HELD_PART:
                (kept if part[i] == TRAINING else gone)[place[ends[i] : ends[i + 1]]] += _flat(data, np.uint32)
        known = kept + gone
        rows = []
        for i in range(len(block)):
            at = place[ends[i] : ends[i + 1]]
            rows.append((block[i], shard[i], part[i], _planes(kept[at]) if part[i] == DELETED_PART else None, _planes(known[at]), None, None, None, None))
        single = every & np.uint64(1) == 0
        rows.append((None, shard[0], None, None, None, int(known[single].sum()), int((known[single] > 0).sum()), int(kept[single].sum()), int((kept[single] > 0).sum())))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ANSWERS, strict=True)], schema=_ANSWERS)

    return asked.groupBy("shard").applyInArrow(run, "block long, shard int, part int, kept binary, known binary, n long, v long, kept_n long, kept_v long")


def _counts(table: pa.Table, column: str) -> np.ndarray:
    """A block's answers from all shards, in the order of its keys."""
    shard, data = table["shard"].to_numpy(), table[column].to_pylist()
    return np.concatenate([_flat(data[i], np.int64) for i in np.argsort(shard)]) if len(data) else np.empty(0, np.int64)


def power(n: np.ndarray) -> np.ndarray:
    """0 for 0, else one more than the whole part of the binary logarithm."""
    return np.frexp(n.astype(np.float64))[1]


def _by_block(held: DataFrame, replies: DataFrame, run, ddl: str) -> DataFrame:
    return held.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, ddl)


def cells(held: DataFrame, replies: DataFrame, n: int, v: int) -> DataFrame:
    """(context, pair, single, times): deleted tokens by their context's power of two and the rounded ratios of both estimates to the uniform one.

    A ratio is the binary logarithm times ``STEPS``, rounded; null where the estimate is 0.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, data = left["ids"].to_pylist()[0], left["texts"].to_pylist()[0]
        own, kept = Tokens.of(unpack_texts(len(ids), data)), _counts(right, "kept")
        token, context, pair = kept[own.token], kept[own.context], kept[own.pair]
        step = lambda x: np.where(x > 0, np.rint(STEPS * np.log2(np.where(x > 0, x, 1.0))), -1e9).astype(np.int64)
        key = np.stack([power(context), step(pair / np.maximum(context, 1) * (v + 1.0)), step(token / max(n, 1) * (v + 1.0))])
        cell, times = np.unique(key, axis=1, return_counts=True)
        absent = lambda x: pa.array(x, pa.int64(), mask=x == -1_000_000_000)
        return pa.table([pa.array(cell[0], pa.int64()), absent(cell[1]), absent(cell[2]), pa.array(times, pa.int64())], names=["context", "pair", "single", "times"])

    found = _by_block(held.where(F.col("part") == DELETED_PART), replies.where(F.col("part") == DELETED_PART), run, "context long, pair long, single long, times long")
    return found.groupBy("context", "pair", "single").agg(F.sum("times").alias("times"))


def learn(context: np.ndarray, pair: np.ndarray, single: np.ndarray, times: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Weights (pair, single, uniform) for each power of two of a context's count, by expectation-maximisation.

    ``pair`` and ``single`` are ratios to the uniform estimate.  Each context class
    adds one imagined token that is spread like the weights of all classes
    together, and those start from one imagined token for each estimate, so that
    no weight is 0 and a class without tokens has the common weights.  Class 0,
    contexts never seen, has no pair estimate.
    """
    likely = np.stack([pair, single, np.ones(len(pair))], axis=1)
    common = np.full(3, 1 / 3)
    for _ in range(iterations):
        share = likely * common
        share /= share.sum(1, keepdims=True)
        common = (share * times[:, None]).sum(0) + 1
        common /= common.sum()
    weights = np.tile(common, (65, 1))
    weights[0, 0] = 0
    weights[0] /= weights[0].sum()
    prior = weights.copy()
    for _ in range(iterations):
        share = likely * weights[context]
        share /= share.sum(1, keepdims=True)
        new = prior.copy()
        np.add.at(new, context, share * times[:, None])
        weights = new / new.sum(1, keepdims=True)
    return weights


@dataclass
class Model:
    """Staged blocks and answers, totals, and weights by context class."""

    held: DataFrame
    replies: DataFrame
    n: int
    v: int
    weights: np.ndarray


def train(docs: DataFrame, *, block_bytes: int = BLOCK_BYTES, shard_keys: int = SHARD_KEYS) -> Model:
    """Count tokens and pairs of ``docs`` and learn the weights."""
    held = staged(blocks(docs, block_bytes), "blocks", **{"parquet.block.size": str(16 << 20)})
    size = held.agg(F.sum(F.octet_length("texts"))).first()[0] or 0
    # a stored byte gives about a third of a question
    bits = max(0, int(size / 3 / shard_keys)).bit_length()
    replies = staged(answers(questions(held, bits)), "answers")
    total = replies.where("block is null").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "kept_n", "kept_v"))).first()
    replies = replies.where("block is not null")
    cell = cells(held, replies, total["kept_n"], total["kept_v"]).toPandas()
    ratio = lambda x: np.nan_to_num(np.exp2(x.astype("float64").to_numpy() / STEPS))
    weights = learn(cell["context"].to_numpy(np.int64), ratio(cell["pair"]), ratio(cell["single"]), cell["times"].to_numpy(np.float64))
    if not total["n"]:
        weights[:] = [0, 0, 1]
    return Model(held, replies, total["n"], total["v"], weights)


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document that the model was trained with."""
    n, v, weights = model.n, model.v, model.weights

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, data, part = left["ids"].to_pylist()[0], left["texts"].to_pylist()[0], left["part"].to_pylist()[0]
        own, known = Tokens.of(unpack_texts(len(ids), data)), _counts(right, "known")
        token, context, pair = known[own.token], known[own.context], known[own.pair]
        w = weights[power(context)]
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * token / max(n, 1) + w[:, 2] / (v + 1)
        starts = np.concatenate([[0], own.ends[:-1]])
        add = lambda x: np.add.reduceat(x, starts)
        columns = [ids, [part == HELD_PART] * len(ids), own.ends - starts, add((token > 0).astype(np.int64)), [n] * len(ids), add(np.log10((token + 1) / (n + v + 1))), add(np.log10(p))]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _SCORES, strict=True)], schema=_SCORES)

    return _by_block(model.held, model.replies, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def interpolated_scores(docs: DataFrame, *, block_bytes: int = BLOCK_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """The scores of every row of ``docs`` by a model of those that are not held out."""
    return score(train(docs, block_bytes=block_bytes, shard_keys=shard_keys))
