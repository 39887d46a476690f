"""Hierarchical packing of documents into sequences of several context sizes.

Each task streams its documents. Whole long windows leave at once; what remains of a document
is routed to the smallest tier that holds it. A window of a tier opens with the longest waiting
piece and its gap is filled with the longest pieces that fit, from its own or shorter tiers; a
last gap is closed by cutting a waiting piece, whose rest goes back to its tier. At the end of a
task the rest splits into powers of two, so no sequence needs padding. Full sequences
are dealt to step groups of equal token counts, longest first to the emptiest group. Tasks share
nothing, so no shuffle and no global state are needed; a sequence id is the task and a count.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import arrow_rows
from fathomline.llm.units import encoder, vocabulary

TIERS = (512, 1024, 2048, 4096)
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, tier long, step_group long"
)


class Packer:
    """Pieces are tuples (length, number, doc_id, start, ids, doc_tokens), ordered by length."""

    def __init__(self, base: int, tiers=TIERS, window: int = 64, step_windows: int = 16):
        self.base, self.tiers = base, tuple(sorted(tiers))
        self.top = self.tiers[-1]
        self.window, self.step = window * self.top, step_windows * self.top
        self.waiting: list[tuple] = []
        self.tokens = self.number = self.sequences = self.steps = 0
        self.ready: list[list[tuple]] = []

    def _piece(self, doc_id, start, ids, total) -> tuple:
        self.number += 1
        return (len(ids) // 4, self.number, doc_id, start, ids, total)

    def _cut(self, piece: tuple, n: int) -> tuple[tuple, tuple]:
        _, _, doc_id, start, ids, total = piece
        return self._piece(doc_id, start, ids[: 4 * n], total), self._piece(doc_id, start + n, ids[4 * n :], total)

    def add(self, doc_id, ids: bytes) -> None:
        total, at, top = len(ids) // 4, 0, 4 * self.top
        while len(ids) - at >= top:
            self.ready.append([self._piece(doc_id, at // 4, ids[at : at + top], total)])
            at += top
        if at < len(ids):
            insort(self.waiting, piece := self._piece(doc_id, at // 4, ids[at:], total))
            self.tokens += piece[0]
        if self.tokens >= self.window or len(self.ready) >= self.window // self.top:
            self.pack()

    def pack(self) -> None:
        """Fill windows until those that wait can't fill another of their tier."""
        waiting = self.waiting
        while waiting:
            opened = [waiting.pop()]
            gap = self.tiers[bisect_left(self.tiers, opened[0][0])] - opened[0][0]
            while gap and waiting:
                if at := bisect_right(waiting, gap, key=lambda p: p[0]):
                    opened.append(waiting.pop(at - 1))
                else:
                    head, rest = self._cut(waiting.pop(0), gap)
                    opened.append(head)
                    insort(waiting, rest)
                gap -= opened[-1][0]
            if gap:
                for p in opened:
                    insort(waiting, p)
                break
            self.ready.append(opened)
        self.tokens = sum(p[0] for p in waiting)

    def finish(self) -> None:
        """Split what is left into sequences whose lengths are powers of two."""
        self.pack()
        rest, self.waiting, self.tokens = self.waiting[::-1], [], 0
        left = sum(p[0] for p in rest)
        while rest:
            room, opened = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                piece = rest.pop(0)
                if piece[0] > room:
                    piece, after = self._cut(piece, room)
                    rest.insert(0, after)
                opened.append(piece)
                room -= piece[0]
            self.ready.append(opened)

    def rows(self) -> dict[str, list]:
        """The full sequences so far, dealt to step groups."""
        out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
        sizes = [sum(p[0] for p in s) for s in self.ready]
        loads = [0] * max(1, -(-sum(sizes) // self.step))
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            group = loads.index(min(loads))
            loads[group] += sizes[k]
            offset = 0
            for n, _, doc_id, start, ids, total in self.ready[k]:
                values = (doc_id, start, n, zlib.crc32(ids), total, self.base + self.sequences, offset, sizes[k], self.base + self.steps + group)
                for name, v in zip(out, values, strict=True):
                    out[name].append(v)
                offset += n
            self.sequences += 1
        self.steps += len(loads) if sizes else 0
        self.ready = []
        return out


def pack(docs: DataFrame, vocab: str = "word_bpe_49k.json", end_id: int = 2, tiers=TIERS) -> DataFrame:
    """Pieces of all documents (doc_id, text), each id of each in one piece.

    A null or empty text is its end id alone. Repeated rows and ids are packed each; a null
    doc_id stays null. An empty table gives no rows. Other columns are ignored.
    """

    def run(batches):
        from pyspark import TaskContext

        encode = encoder(vocabulary(vocab))
        packer = Packer(TaskContext.get().partitionId() << 36, tiers)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                packer.add(doc_id, encode(text) + end)
                if len(packer.ready) >= 2 * packer.window // packer.top:
                    yield packer.rows()
        packer.finish()
        yield packer.rows()

    return arrow_rows(docs.select(F.col("doc_id").cast("long"), "text"), SCHEMA, run)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
