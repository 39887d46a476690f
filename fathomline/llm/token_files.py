"""Token ids in files under a canonical, length-limited Huffman code of their global counts.

Passes: (1) tokenise each document once and keep its ids; (2) sum histograms of tasks and make the
code; (3) encode pieces of documents once, deal them to shards by ranges of doc_id and write
them as blocks. Ranges come from quantiles of doc_id alone: a range exchange would sample, and so
encode everything twice. A block decodes alone: it holds whole pieces, and a
bit-offset checkpoint every ``LANE`` ids lets a table-driven decoder advance all lanes of a block
at once. The files are Parquet rows (shard, block, ...), so Spark's commit protocol guards them
and any store that Spark reads will do. The code table has a row for each id used.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.llm.common import arrow_rows, new_folder, written
from fathomline.llm.units import WINDOW, encoder, vocabulary

LANE = 128
BLOCK_IDS = 1 << 16


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.int64)[order]
    rows, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        at = np.argsort(merged, kind="stable")
        rows.append(at < n)
        merged = merged[at]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    found, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(rows):
        own = int(is_leaf[:take].sum())
        found[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = found
    return out


class Code:
    """Canonical code of ids with given lengths: codes rise with (length, id)."""

    def __init__(self, ids, lengths):
        ids, lengths = np.asarray(ids, np.int64), np.asarray(lengths, np.int64)
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order], lengths[order]
        self.width = int(self.lengths.max(initial=1))
        step = np.int64(1) << (self.width - self.lengths)
        self.first = np.concatenate([[0], np.cumsum(step)[:-1]]).astype(np.int64) if len(ids) else step
        top = int(self.ids.max(initial=0)) + 1
        self.code_of, self.len_of = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code_of[self.ids] = (self.first >> (self.width - self.lengths)).astype(np.uint64)
        self.len_of[self.ids] = self.lengths
        self.table_id = np.zeros(1 << self.width, np.int64)
        self.table_len = np.ones(1 << self.width, np.int64)
        used = int(step.sum())
        self.table_id[:used] = np.repeat(self.ids, step)
        self.table_len[:used] = np.repeat(self.lengths, step)

    def encode(self, parts: list[np.ndarray]) -> list[tuple[bytes, np.ndarray]]:
        """For each part its bits, from a byte's start on, and the bit offset of each lane.

        All parts are laid into one string of bits at once: a code starts in some byte and reaches at
        most four further ones, so five sums of disjoint bits give the bytes.
        """
        counts = np.array([len(p) for p in parts], np.int64)
        if not counts.sum():
            return [(b"", np.zeros(0, np.int64)) for _ in parts]
        ids = np.concatenate(parts)
        n = self.len_of[ids]
        before = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(counts)
        bits = before[ends] - before[ends - counts]
        starts = np.concatenate([[0], np.cumsum(-(-bits // 8))])  # in bytes
        at = before[:-1] + np.repeat(8 * starts[:-1] - before[ends - counts], counts)
        codes = self.code_of[ids] << (40 - n - (at & 7)).astype(np.uint64)
        held = np.zeros(int(starts[-1]) + 5)
        for k in range((self.width + 14) // 8):
            held += np.bincount((at >> 3) + k, (codes >> np.uint64(32 - 8 * k)) & np.uint64(255), len(held))
        raw = held.astype(np.uint8).tobytes()
        out = []
        for k, (end, size) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
            marks = at[end - size : end : LANE] - 8 * starts[k]
            out.append((raw[starts[k] : starts[k + 1]], marks))
        return out

    def decode(self, payload: bytes, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of all lanes in order; lane k starts at bit ``offsets[k]`` and has ``sizes[k]`` ids."""
        raw = np.frombuffer(payload + bytes(5), np.uint8).astype(np.uint64)
        words = (raw[:-4] << 32) | (raw[1:-3] << 24) | (raw[2:-2] << 16) | (raw[3:-1] << 8) | raw[4:]
        at, last = offsets.astype(np.int64), len(words) - 1
        out = np.empty((len(at), int(sizes.max(initial=0))), np.int64)
        for k in range(out.shape[1]):
            window = words[np.minimum(at >> 3, last)] >> (40 - self.width - (at & 7)).astype(np.uint64)
            window = (window & np.uint64((1 << self.width) - 1)).astype(np.int64)
            out[:, k] = self.table_id[window]
            at = at + self.table_len[window]
        return out[np.arange(out.shape[1]) < sizes[:, None]]


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the CRC-32 polynomial, bits reflected."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc_before(crc: int, n_bytes: int) -> int:
    """What a part's crc32 adds to the whole's when ``n_bytes`` follow it; parts combine by xor."""
    factor, power = 1 << 31, 1 << 23
    while n_bytes:
        if n_bytes & 1:
            factor = _times(factor, power)
        power, n_bytes = _times(power, power), n_bytes >> 1
    return _times(factor, crc)


def tokenised(docs: DataFrame, vocab: str, end_id: int) -> DataFrame:
    """(doc_id, row, n, ids): ids of each whole text and the end id, as unsigned 16- or 32-bit bytes."""

    def run(batches):
        encode = encoder(vocabulary(vocab))
        kind = "<u4" if encode.library.get_vocab_size() > 1 << 16 else "<u2"
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()
            for at, size in _grouped(sizes, WINDOW):
                part = b.slice(at, size)
                ids, n = encode.column(part.column("text"), kind)
                ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                ends = (np.append(0, np.cumsum(n)) * ids.itemsize).astype(np.int32)
                held = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), pa.array(n, pa.int64()), held], names=["doc_id", "row", "n", "ids"]
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(run, "doc_id long, row long, n long, ids binary")


def _grouped(sizes: list[int], most: int):
    """(at, how many): runs of neighbours that hold about ``most`` together."""
    at = held = 0
    for k, n in enumerate(sizes):
        held += n
        if held >= most or k + 1 == len(sizes):
            yield at, k + 1 - at
            at, held = k + 1, 0


def _numbers(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u4" if len(ids) == 4 * n else "<u2")


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, count) over all documents, summed in each task before the shuffle."""

    def run(batches):
        total = np.zeros(1, np.int64)
        for b in batches:
            one = np.bincount(np.concatenate([_numbers(x, n) for x, n in zip(b["ids"], b["n"], strict=True)]))
            if len(one) > len(total):
                total = np.pad(total, (0, len(one) - len(total)))
            total[: len(one)] += one
        ids = np.flatnonzero(total)
        yield {"id": ids.tolist(), "count": total[ids].tolist()}

    return arrow_rows(tokens.select("n", "ids"), "id long, count long", run).groupBy("id").agg(F.sum("count").alias("count"))


def write(docs: DataFrame, folder: str, vocab: str = "byte_bpe_50k.json", end_id: int = 0, limit: int = 16) -> None:
    """Write ``docs`` (doc_id, text) in ascending doc_id order under ``folder``/code and /blocks.

    Null and empty texts have the end id alone. Rows that repeat a doc_id each get their ids, in
    the order of their crc32; null ids come first. An empty table gives empty files. Columns
    other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = written(tokenised(docs, vocab, end_id), "tokens")
    counts = id_counts(tokens).toPandas()  # at most a row for each id of the vocabulary
    lengths = code_lengths(counts["count"].to_numpy(), limit)
    table = [(int(i), int(n)) for i, n in zip(counts["id"], lengths, strict=True)]
    spark.createDataFrame(table, "id long, length long").coalesce(1).write.parquet(f"{folder}/code")
    held = spark.sparkContext.broadcast(table)  # bounded by the vocabulary

    cuts = sorted(set(tokens.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.2 / shards)))
    ranges = F.lit(0) if not cuts else F.expr(f"size(filter(array({', '.join(f'{int(c)}L' for c in cuts)}), c -> c < doc_id))")
    tokens = tokens.withColumn("shard", F.when(F.col("doc_id").isNull(), 0).otherwise(ranges).cast("int"))

    def encoded(batches):
        code = Code(*zip(*held.value, strict=True)) if held.value else None
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("shard", "doc_id", "crc", "row", "at", "n", "doc_tokens", "payload", "marks")}
            parts: list[np.ndarray] = []
            for shard, doc, row, n, raw in zip(b["shard"], b["doc_id"], b["row"], b["n"], b["ids"], strict=True):
                ids = _numbers(raw, n)
                crc = zlib.crc32(ids.astype("<u4").tobytes())
                for at in range(0, n, BLOCK_IDS):
                    parts.append(ids[at : at + BLOCK_IDS])
                    for k, v in zip(out, (shard, doc, crc, row, at, len(parts[-1]), n), strict=False):
                        out[k].append(v)
            for at, size in _grouped([len(p) for p in parts], 4 * BLOCK_IDS):
                for payload, marks in code.encode(parts[at : at + size]):
                    out["payload"].append(payload)
                    out["marks"].append(marks.astype("<u4").tobytes())
            yield out

    pieces = arrow_rows(
        tokens, "shard int, doc_id long, crc long, row long, at long, n long, doc_tokens long, payload binary, marks binary", encoded
    )

    def blocks(batches):
        shard, block, first = -1, 0, 0
        held_rows: list[tuple] = []

        def one():
            nonlocal block, first, held_rows
            bytes_before = np.concatenate([[0], np.cumsum([len(r[4]) for r in held_rows])])
            marks = [np.frombuffer(r[5], "<u4") + 8 * int(o) for r, o in zip(held_rows, bytes_before, strict=False)]
            made = {
                "shard": [shard], "block": [block], "first": [first],
                "doc_id": [[r[0] for r in held_rows]], "at": [[r[1] for r in held_rows]],
                "n": [[r[2] for r in held_rows]], "doc_tokens": [[r[3] for r in held_rows]],
                "payload": [b"".join(r[4] for r in held_rows)],
                "marks": [np.concatenate(marks).astype("<u8").tobytes()],
            }
            block, first = block + 1, first + sum(r[2] for r in held_rows)
            held_rows = []
            return made

        size = 0
        for b in batches:
            for of, *r in zip(*(b[k] for k in ("shard", "doc_id", "at", "n", "doc_tokens", "payload", "marks")), strict=True):
                if held_rows and (of != shard or size + r[2] > BLOCK_IDS):
                    yield one()
                    size = 0
                if of != shard:
                    shard, block, first = of, 0, 0
                held_rows.append(r)
                size += r[2]
        if held_rows:
            yield one()

    order = ("shard", "doc_id", "crc", "row", "at")
    arrow_rows(
        pieces.repartitionById(shards, F.col("shard")).sortWithinPartitions(*order),
        "shard int, block int, first long, doc_id array<long>, at array<long>, n array<long>, "
        "doc_tokens array<long>, payload binary, marks binary",
        blocks,
    ).write.option("compression", "none").parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str, what=None, schema: str | None = None) -> DataFrame:
    """Decode the files; a row for each piece: doc_id, start (ids of all documents before its
    document), at (its document's ids before it), n, doc_tokens and ids (unsigned 32-bit bytes).

    ``what`` with ``schema`` may replace ids by columns computed from (ids, at, doc_tokens).
    """
    code_rows = spark.read.schema("id long, length long").parquet(f"{folder}/code")
    table = [tuple(r) for r in code_rows.collect()]  # bounded by the vocabulary
    held = spark.sparkContext.broadcast(table)
    stored = spark.read.schema(
        "shard int, block int, first long, doc_id array<long>, at array<long>, n array<long>, "
        "doc_tokens array<long>, payload binary, marks binary"
    ).parquet(f"{folder}/blocks")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored.groupBy("shard").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("size")).select(
        F.col("shard").alias("s"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")
    )
    what = what or (lambda ids, at, total: (ids.astype("<u4").tobytes(),))
    names = [c.split()[0] for c in (schema or "ids binary").split(", ")]

    def run(batches):
        code = Code(*zip(*held.value, strict=True)) if held.value else None
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "shard", "local", "at", "n", "doc_tokens", *names)}
            for shard, first, docs, ats, ns, totals, payload, marks in zip(
                *(b[k] for k in ("shard", "first", "doc_id", "at", "n", "doc_tokens", "payload", "marks")), strict=True
            ):
                sizes = np.concatenate([np.minimum(LANE, n - np.arange(0, n, LANE)) for n in ns])
                ids = code.decode(payload, np.frombuffer(marks, "<u8"), sizes)
                k = 0
                for doc, at, n, total in zip(docs, ats, ns, totals, strict=True):
                    values = (doc, shard, first + k - at, at, n, total, *what(ids[k : k + n], at, total))
                    for name, v in zip(out, values, strict=True):
                        out[name].append(v)
                    k += n
            yield out

    rows = arrow_rows(
        stored, f"doc_id long, shard int, local long, at long, n long, doc_tokens long, {schema or 'ids binary'}", run
    )
    return rows.join(bases, rows.shard == bases.s).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "at", "n", "doc_tokens", *names
    )


def _crc_part(ids: np.ndarray, at: int, total: int) -> tuple[int]:
    crc, after = zlib.crc32(ids.astype("<u4").tobytes()), total - at - len(ids)
    return (crc_before(crc, 4 * after) if after else crc,)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    parts = read(spark, folder, _crc_part, "crc long")
    return (
        parts.groupBy("start")
        .agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
        .select("doc_id", "start", "n_tokens", "ids_crc32")
    )


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return digests(spark, folder)
