"""Vector bin packing of token sequences by the dot-product heuristic.

A sequence has three limits: tokens, segments (pieces) and loss-bearing tokens.
An open sequence takes the fitting piece whose demand vector has the largest
weighted dot product with the room left, until none fits.  Where texts may be
cut, a gap is then filled by cutting the largest piece left.

Packing happens where the texts are read: each task packs a bounded pool of
pieces at a time and hands the unfinished sequence's pieces to the next pool,
so nothing is shuffled and one sequence per task is left over.  That one is cut
into power-of-two sequences, which need no padding.

Loss: the tokens of a prompt bear none, and neither does the first token of a
piece, which nothing in its sequence predicts.  A piece that bears as much loss as a
sequence may hold is a sequence of its own.

Segments: by default a sequence may hold as many pieces as tokens, so that short
texts fill it; a lower limit is kept, at the price of padding where texts are short.

Defined cases: null text is an empty text (its end id alone), a null prompt is
none; repeated rows are packed each; an empty table gives no rows; a text of any
length is cut into full sequences and a rest; columns besides those named are
ignored.
"""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .tokens import encoder
from .wordhash import slices

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_loss long"


def pack_vectors(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int], min_cut: int = 0) -> list[list[tuple[int, int, int]]]:
    """Pack pieces into sequences; each is a list of (piece, first token, length), the last one possibly open.

    ``limits``: tokens, segments, loss-bearing tokens of a sequence.  With
    ``min_cut`` > 0 pieces may be cut to fill a gap of at least that many
    tokens; a piece's loss-bearing tokens are then its last ones, and the first
    token after a cut bears none.  A piece that exceeds a limit by itself is an
    error.
    """
    if len(tokens) and (tokens.max() > limits[0] or limits[1] < 1 or loss.max() > limits[2]):
        raise ValueError("a piece exceeds the limits of a sequence")
    tokens, loss = tokens.astype(np.float64), loss.astype(np.float64)
    begin = np.zeros(len(tokens), np.int64)
    cap = np.asarray(limits, np.float64)
    # Weight of a dimension: mean demand over capacity, so that the scarce one counts most.
    weight = np.asarray([tokens.mean(), 1.0, loss.mean()]) / cap / cap if len(tokens) else cap
    alive, left, out = np.ones(len(tokens), bool), len(tokens), []
    while left:
        room, taken = cap.copy(), []
        while left:
            score = np.where(alive & (tokens <= room[0]) & (loss <= room[2]),
                             weight[0] * room[0] * tokens + weight[2] * room[2] * loss, -1.0)
            k = int(score.argmax())
            if room[1] < 1 or score[k] < 0:
                break
            taken.append((k, int(begin[k]), int(tokens[k])))
            room -= (tokens[k], 1, loss[k])
            alive[k], left = False, left - 1
        if left and min_cut and room[0] >= min_cut and room[1] >= 1:
            # Of each piece as much as fits; the piece that fills most of the gap is cut, the longest of equals.
            free = tokens - loss
            fits = np.where(alive, np.minimum(room[0], room[2] + free), -1.0)
            k = int(np.lexsort((tokens, fits))[-1])
            gap = int(fits[k])
            if min_cut <= gap < tokens[k]:
                taken.append((k, int(begin[k]), gap))
                begin[k] += gap
                tokens[k] -= gap
                loss[k] = tokens[k] - max(free[k] - gap, 1)
        out.append(taken)
    return out


class _Packer:
    """One task's pool of pieces; gives rows (doc_id, start, length, crc, doc_tokens, sequence_id, offset)."""

    def __init__(self, first_id: int, limits: tuple[int, int, int], min_cut: int, dtype: np.dtype):
        self.next_id, self.limits, self.min_cut, self.dtype = first_id, limits, min_cut, dtype
        self.pool: list[tuple] = []  # (doc_id, start, ids, doc_tokens, leading tokens without loss)

    def _row(self, piece, begin, length, offset):
        doc_id, start, ids, doc_tokens, free = piece
        crc = zlib.crc32(ids[begin:begin + length].astype("<u4"))
        return doc_id, start + begin, length, crc, doc_tokens, self.next_id, offset, max(0, length - max(free - begin, 1))

    def add(self, doc_id, ids: np.ndarray, prompt: int = 0):
        """Place the full sequences of an example at once and pool its rest; its first ``prompt`` tokens bear no loss."""
        at = 0
        while at < len(ids):
            free = max(prompt - at, 1)
            take = min(self.limits[0], self.limits[2] + free, len(ids) - at)
            if take == self.limits[0] or take - free == self.limits[2]:
                yield self._row((doc_id, 0, ids, len(ids), prompt), at, take, 0)
                self.next_id += 1
            else:
                self.pool.append((doc_id, at, ids[at:at + take].copy(), len(ids), min(free, take)))
            at += take

    def pack(self, last: bool):
        size = np.asarray([len(p[2]) for p in self.pool], np.int64)
        free = np.asarray([p[4] for p in self.pool], np.int64)
        bins = pack_vectors(size, size - free, self.limits, self.min_cut)
        open_bin = bins.pop() if bins else []
        for taken in bins:
            offset = 0
            for k, begin, length in taken:
                yield self._row(self.pool[k], begin, length, offset)
                offset += length
            self.next_id += 1
        self.pool = [(p[0], p[1] + b, p[2][b:b + n], p[3], min(max(p[4] - b, 1), n))
                     for p, b, n in ((self.pool[k], b, n) for k, b, n in open_bin)]
        if last:
            yield from self._powers()

    def _powers(self):
        """The one unfinished sequence as sequences of power-of-two lengths."""
        left, room, offset = sum(len(p[2]) for p in self.pool), 0, 0
        for piece in self.pool:
            at = 0
            while at < len(piece[2]):
                if not room:
                    room, offset = 1 << (min(left, self.limits[0]).bit_length() - 1), 0
                take = min(room, len(piece[2]) - at)
                yield self._row(piece, at, take, offset)
                at, offset, room, left = at + take, offset + take, room - take, left - take
                if not room:
                    self.next_id += 1
        self.pool = []


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                   max_tokens: int = 2048, max_segments: int | None = None, max_loss: int = 2047, pool: int = 1024,
                   min_cut: int = 16, prompt_col: str | None = None) -> DataFrame:
    """Pieces of all texts (ids plus ``end_id``) placed in sequences.

    With ``prompt_col`` an example is the ids of its prompt, then those of its
    text, then ``end_id``; the prompt bears no loss (instruction data).  Without
    ``max_segments`` the number of pieces is bounded by ``max_tokens`` alone.

    Returns id, start, length, ids_crc32, doc_tokens, sequence_id, offset and
    n_loss (loss-bearing tokens).  Sequence ids are unique, not gapless.
    """
    limits = (max_tokens, max_segments or max_tokens, max_loss)
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_loss"]

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc = encoder(tokenizer_path)
        end = np.asarray([end_id], enc.dtype).tobytes()
        packer = _Packer(TaskContext.get().partitionId() << 32, limits, min_cut, enc.dtype)
        kind, rows = pa.int64(), []

        def flush():
            columns = zip(*rows)
            done = pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k else kind) for k, c in enumerate(columns)], names=names)
            rows.clear()
            return done

        for whole in batches:
            kind = whole.schema.field(0).type
            for batch in slices(whole, 1, 1 << 21):
                texts = enc.encode_column(batch.column(1))
                prompts = enc.encode_column(batch.column(2)) if prompt_col else repeat(b"")
                for doc_id, prompt, data in zip(batch.column(0).to_pylist(), prompts, texts):
                    rows += packer.add(doc_id, np.frombuffer(prompt + data + end, enc.dtype), len(prompt) // enc.dtype.itemsize)
                    if len(packer.pool) >= pool:
                        rows += packer.pack(last=False)
                if len(rows) >= 5_000:
                    yield flush()
        rows += packer.pack(last=True)
        if rows:
            yield flush()

    chosen = df.select(*(F.col(c) for c in (id_col, text_col, prompt_col) if c))
    return chosen.mapInArrow(pack, f"`{id_col}` {chosen.schema[0].dataType.simpleString()}, {PIECES}")


def op6_vector_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
