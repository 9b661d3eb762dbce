"""Vector bin packing of token sequences.

Examples take up several limited things at once: tokens, segments of a sequence, and tokens that
bear loss. A sequence is filled with the piece that fits and whose needs, as shares of the limits,
have the largest dot product with what is left; where nothing more fits, a piece is cut.

Documents have prompts: the first lines of a text bear no loss, as a prompt of their own would.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .tokens import encoder

#: Limits of a sequence. Fewer tokens may bear loss than there are, so that no sequence is answers
#: only; what is left is filled with tokens that bear none, if there are any.
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 4096, 256, 4032
#: Packing works on blocks of so many documents or tokens; what doesn't fill a sequence goes on
#: into the next block, and the last block of a partition ends in sequences of powers of two.
BLOCK_DOCS, BLOCK_TOKENS = 4000, 2_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_length long"


class Piece:
    """Ids ``[start, start + length)`` of a document; those from ``loss_from`` on bear loss."""

    __slots__ = ("doc", "start", "length", "loss_from")

    def __init__(self, doc, start: int, length: int, loss_from: int):
        self.doc, self.start, self.length, self.loss_from = doc, start, length, loss_from

    @property
    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.loss_from))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, n, self.loss_from), Piece(self.doc, self.start + n, self.length - n, self.loss_from)

    def fits_first(self, tokens: int, loss: int) -> int:
        """How many of its first ids fit into so many tokens and loss-bearing tokens."""
        free = max(0, self.loss_from - self.start)
        return min(self.length, tokens, free + loss)


def fill(pieces: list[Piece], tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS, last: bool = True) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences of pieces, and the pieces left over (none if ``last``).

    Pieces of equal needs are one class, so a step costs as much as there are classes. Each step
    takes the class with the largest dot product; ties go to the longer, then the smaller loss.
    Pieces without ids are left out, and no pieces give no sequences.
    Sequences are full but for limits on segments or loss; if ``last``, the rest is dealt into
    sequences whose lengths are powers of two.
    """
    classes: dict[tuple[int, int], deque] = defaultdict(deque)
    for p in pieces:
        if p.length:
            classes[p.length, p.loss].append(p)
    need = np.array(sorted(classes, key=lambda k: (-k[0], k[1])), dtype=np.int64).reshape(-1, 2)
    have = np.array([len(classes[tuple(k)]) for k in need.tolist()], dtype=np.int64)
    share = np.stack([need[:, 0] / tokens, np.full(len(need), 1 / segments), need[:, 1] / loss], axis=1) if len(need) else np.zeros((0, 3))
    total = int((need[:, 0] * have).sum())
    done: list[list[Piece]] = []

    def take(i: int) -> Piece:
        have[i] -= 1
        return classes[tuple(need[i].tolist())].popleft()

    rest: list[Piece] = []
    while total > 0:
        target, remain = tokens, total + sum(p.length for p in rest)
        if remain < tokens:
            if not last:
                break
            target = 1 << (remain.bit_length() - 1)
        left = [target, segments, loss]
        here: list[Piece] = []
        while left[0] and left[1] and total + sum(p.length for p in rest):
            if rest:  # the second part of a piece that was cut goes on first
                p = rest.pop()
                total += p.length
                n = p.fits_first(left[0], left[2])
            else:
                ok = (have > 0) & (need[:, 0] <= left[0]) & (need[:, 1] <= left[2])
                if ok.any():
                    score = np.where(ok, share @ np.array([left[0] / tokens, left[1] / segments, left[2] / loss]), -1.0)
                    p = take(int(score.argmax()))
                    n = p.length
                else:  # nothing fits whole: cut the one of which most fits, of equals the shortest
                    part = np.minimum(np.minimum(need[:, 0], left[0]), need[:, 0] - need[:, 1] + left[2])
                    part[have <= 0] = -1
                    if not len(part) or part.max() <= 0:
                        break
                    p = take(len(part) - 1 - int(part[::-1].argmax()))
                    n = p.fits_first(left[0], left[2])
            total -= p.length
            if n <= 0:
                rest.append(p)
                break
            if n < p.length:
                p, more = p.cut(n)
                rest.append(more)
            here.append(p)
            left = [left[0] - p.length, left[1] - 1, left[2] - p.loss]
        done.append(here)
        if not total and rest:  # only cut pieces are left: they are classes again
            again, rest = rest, []
            if not last and sum(p.length for p in again) < tokens:
                return done, again
            more, over = fill(again, tokens, segments, loss, last)
            return done + more, over
    return done, rest + [p for q in classes.values() for p in q]


def pack(docs: DataFrame, tokenizer: str, end_id: int, tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, prompt_lines: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``tokens`` tokens.

    A document is the ids of its whole text (null: empty), then ``end_id``. ``prompt_col`` has the
    text of a prompt that comes first and bears no loss. Without it the first ``prompt_lines`` lines
    of a text of more lines are its prompt: as many of its ids as those lines have bear no loss. Each
    id lies in exactly one piece; ``offset`` is the piece's place in its sequence, without gaps.
    Every partition packs its own rows, so nothing is shuffled; a document longer than a sequence
    is first cut into full ones. ``with_ids`` adds the ids. Repeated rows are packed as often as
    they come, null identifiers stay null, an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared.ready(spark)
    schema = PIECES + (", ids array<int>" if with_ids else "")
    limits = dict(tokens=tokens, segments=segments, loss=loss)

    def run(batches):
        enc = encoder(tokenizer)
        number = TaskContext.get().partitionId() << 32

        def rows(sequences):
            nonlocal number
            cols: list[list] = [[] for _ in range(8 + with_ids)]
            for s in sequences:
                at = 0
                for p in s:
                    doc_id, ids = p.doc
                    own = ids[p.start : p.start + p.length]
                    vals = [doc_id, p.start, p.length, zlib.crc32(own.astype("<u4").tobytes()), len(ids), number, at, p.loss]
                    for c, v in zip(cols, vals + ([own.tolist()] if with_ids else []), strict=True):
                        c.append(v)
                    at += p.length
                number += 1
            kinds = [pa.int64()] * 8 + ([pa.list_(pa.int32())] if with_ids else [])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        pool: list[Piece] = []
        held = 0
        for b in shared.slices(batches):
            full = []
            prompts = b.column(2).to_pylist() if prompt_col else [None] * b.num_rows
            for doc_id, text, prompt in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), prompts, strict=True):
                first = enc.ids(prompt) if prompt else np.zeros(0, enc.dtype)
                ids = np.concatenate([first, enc.ids(text), np.array([end_id], enc.dtype if end_id < 1 << 8 * enc.dtype.itemsize else "<u4")])
                free = len(first)
                if not prompt_col and prompt_lines and text and text.count("\n") >= prompt_lines:
                    free = min(len(ids) - 1, len(enc.ids("\n".join(text.split("\n", prompt_lines)[:prompt_lines]))))
                p = Piece((doc_id, ids), 0, len(ids), free)
                while p.length >= tokens and p.fits_first(tokens, loss) == tokens:
                    part, p = p.cut(tokens)
                    full.append([part])
                while p.length > loss:  # filled up later by tokens that bear no loss
                    part, p = p.cut(p.fits_first(tokens, loss))
                    pool.append(part)
                    held += part.length
                if p.length:
                    pool.append(p)
                    held += p.length
            if full:
                yield rows(full)
            if len(pool) >= BLOCK_DOCS or held >= BLOCK_TOKENS:
                done, pool = fill(pool, last=False, **limits)
                held = sum(p.length for p in pool)
                yield rows(done)
        if pool:
            yield rows(fill(pool, last=True, **limits)[0])

    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    return docs.select(*cols, *([F.col(prompt_col).cast("string").alias("prompt")] if prompt_col else [])).mapInArrow(run, schema)
