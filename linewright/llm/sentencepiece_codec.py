"""SentencePiece encoding and decoding by a merge-type prefix table.

A BPE piece model gives each text one encoding.  Its prefixes nest: for every
prefix there is exactly one piece that can end its encoding.  The encoder runs
an Aho-Corasick automaton of the pieces over a chunk of text; of the pieces
that match at a position it stores the one that is compatible with the last
piece of the prefix before it.  Two adjacent pieces are compatible if no merge
across their border comes before the merges that built them.  The ids are then
recovered backwards from the table.

No piece holds a space mark after another character, so chunks that start with
the mark are encoded on their own, and a bounded cache keeps what was encoded.
Runs of several space marks, whose pieces share one score, are merged one pair
at a time with a heap; characters that no piece holds become bytes.

Null and empty texts encode to the begin and end ids alone.  Rows keep their
order within a task; repeated rows give equal results; further columns of the
input don't matter.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: Most chunks, and judged pairs of pieces, that a worker keeps (some 250 and 120 bytes each).
CACHE, PAIRS = 300_000, 500_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("linewright-each-byte", _each_byte)


class PieceCodec:
    """Encoder and decoder for one BPE piece model with byte fallback."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        names = [model.id_to_piece(i) for i in range(size)]
        self.byte_id = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        self.score = {names[i]: model.get_score(i) for i in range(size) if i not in special}
        self.id = {names[i]: i for i in range(size) if i not in special}
        #: What each id stands for in a decoded text.
        self.shown = [b"" if model.is_control(i) else names[i].replace(MARK, " ").encode() for i in range(size)]
        self.shown[self.unk] = " ⁇ ".encode()
        for value, i in self.byte_id.items():
            self.shown[i] = bytes([value])
        self._is_byte = np.zeros(size, bool)
        self._is_byte[list(self.byte_id.values())] = True
        # ranks: the order of merges; equal scores occur among runs of marks only
        order = sorted(self.id, key=lambda p: (-self.score[p], self.id[p]))
        self.rank = {self.id[p]: r for r, p in enumerate(order)}
        self.piece = names
        self.split: dict[int, tuple[int, int]] = {}
        self._automaton = ahocorasick.Automaton()
        whole = {c for p in self.id for c in p} <= set(self.id)
        if not whole or any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("every character of a piece must be a piece, and marks must lead")
        for p, i in self.id.items():
            if len(p) == 1:
                self.split[i] = (i, i)
            elif MARK * 2 in p:
                continue
            else:
                ends, built = self._merge(p)
                if ends != [0, len(p)]:
                    continue  # no text encodes to this piece
                self.split[i] = built
            self._automaton.add_word(p, (i, len(p)))
        self._automaton.make_automaton()
        self._fits: dict[int, bool] = {}
        self._cache: dict[str, bytes] = {}
        self._chunks = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
        if any("\n" in p for p in self.id):
            self._chunks = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def _merge(self, text: str) -> tuple[list[int], tuple[int, int]]:
        """Merge pair by pair, the best score first, then the leftmost; the bounds and the last pair."""
        n = len(text)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        score, ids = self.score, self.id
        heap = [(-score[p], i, i + 2) for i in range(n - 1) if (p := text[i : i + 2]) in score]
        heapq.heapify(heap)
        pair = (-1, -1)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if j < 0 or j >= n or end[j] != stop:
                continue
            pair = ids.get(text[i:j], -1), ids.get(text[j:stop], -1)
            end[i], end[j] = stop, -1
            if stop < n:
                before[stop] = i
                if (p := text[i : end[stop]]) in score:
                    heapq.heappush(heap, (-score[p], i, end[stop]))
            if (h := before[i]) >= 0 and (p := text[h:stop]) in score:
                heapq.heappush(heap, (-score[p], h, stop))
        bounds, i = [0], 0
        while i < n:
            i = end[i]
            bounds.append(i)
        return bounds, pair

    def fits(self, left: int, right: int) -> bool:
        """Whether the pieces stay apart when they are adjacent."""
        key = left << 20 | right
        if (known := self._fits.get(key)) is not None:
            return known
        rank, piece, ids, split = self.rank, self.piece, self.id, self.split
        a, b, limit, answer = left, right, 1 << 40, None
        while answer is None:
            joined = ids.get(piece[a] + piece[b])
            if joined is not None and rank[joined] < limit:
                answer = False
                break
            ra = -1 if len(piece[a]) == 1 else rank[a]
            rb = -1 if len(piece[b]) == 1 else rank[b]
            if ra < 0 and rb < 0:
                answer = True
            elif ra > rb:  # undo the later merge; on the left it blocks what ranks with it
                limit, a = ra, split[a][1]
            else:
                limit, b = rb + 1, split[b][0]
        if len(self._fits) < PAIRS:
            self._fits[key] = answer
        return answer

    def _ids(self, text: str) -> list[int]:
        """The ids of a chunk."""
        if text.startswith(MARK * 2):
            bounds, _ = self._merge(text)
            out: list[int] = []
            for i, j in zip(bounds, bounds[1:], strict=False):
                found = self.id.get(text[i:j])
                out += [found] if found is not None else [self.byte_id[x] for x in text[i:j].encode()]
            return out
        n = len(text)
        last, known = [-1] * (n + 1), self._fits
        for end, (piece, length) in self._automaton.iter(text):
            end += 1
            if last[end] < 0:
                before = last[end - length]
                if before < 0:  # at the start, or after a character that became bytes
                    last[end] = piece
                elif (ok := known.get(before << 20 | piece)) or ok is None and self.fits(before, piece):
                    last[end] = piece
        out, end = [], n
        while end:
            piece = last[end]
            if piece < 0:
                out += [self.byte_id[x] for x in reversed(text[end - 1].encode())]
                end -= 1
            else:
                out.append(piece)
                end -= len(self.piece[piece])
        return out[::-1]

    def _packed(self, chunk: str) -> bytes:
        out = np.array(self._ids(chunk), "<u4").tobytes()
        if len(self._cache) < CACHE and len(chunk) < 64:
            self._cache[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        """Begin id, ids and end id of ``text``, as little-endian 32-bit integers."""
        out = [self.bos.to_bytes(4, "little")]
        if text:
            get, packed = self._cache.get, self._packed
            out += [get(c) or packed(c) for c in self._chunks.findall(MARK + text.replace(" ", MARK))]
        out.append(self.eos.to_bytes(4, "little"))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids as packed by :meth:`encode`."""
        shown = self.shown
        listed = np.frombuffer(ids, "<u4").tolist()
        out = b"".join([shown[i] for i in listed])
        first = next((i for i in listed if i not in (self.bos, self.eos)), None)
        if first is not None and not self._is_byte[first] and out.startswith(b" "):
            out = out[1:]
        return out.decode("utf-8", "linewright-each-byte").encode()


_LOADED: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """The codec for a model, loaded once in a worker."""
    if model_path not in _LOADED:
        _LOADED[model_path] = PieceCodec(model_path)
    return _LOADED[model_path]


def encode_documents(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every text; a row of counts and digests for each row.

    ``with_ids`` adds ``ids`` (array of int) and ``decoded`` (the decoded text).
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if with_ids:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    arrow = pa.schema(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            n, ids_hash, text_hash, ids_out, text_out = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text or "")
                decoded = own.decode(ids)
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    ids_out.append(np.frombuffer(ids, "<u4").astype(np.int32))
                    text_out.append(decoded.decode())
            columns = [batch.column(0).cast(pa.int64()), n, ids_hash, text_hash] + ([ids_out, text_out] if with_ids else [])
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    schema = SCHEMA + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
