"""Exact deduplication over a cuckoo-filter index of live digests.

Keys are SHA-256 digests of the texts without ASCII white space. They are dealt to buckets by
their first bits, so a bucket's size follows from the bucket count and no group of copies
makes one large: before that shuffle each task folds its own copies into one row per digest.
A bucket keeps a cuckoo filter (4 slots of 16 bits per place) and, beside it, its stored
entries. A key that the filter doesn't know is new; a hit is checked against the entries. When
an insertion finds no place, the filter doubles and is filled again from the stored keys.
Deletion removes the fingerprint of a key whose last copy goes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import arrow_rows, new_folder

#: Documents to a bucket, about; a bucket's filter and entries are then some megabytes.
BUCKET_ROWS = 20_000
FOLDED = 50_000
SLOTS = 4


class CuckooFilter:
    """A set of keys (bytes of 16 or more) with deletion and no false negatives."""

    def __init__(self, places: int = 256, kicks: int = 200):
        self.places = max(2, 1 << (places - 1).bit_length())
        self.kicks, self.size = kicks, 0
        self.table = [[] for _ in range(self.places)]

    def _at(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "big") or 1
        first = int.from_bytes(key[10:16], "big") & (self.places - 1)
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return place ^ (mark * 0x5BD1E995 & (self.places - 1))

    def __contains__(self, key: bytes) -> bool:
        mark, a, b = self._at(key)
        return mark in self.table[a] or mark in self.table[b]

    def insert(self, key: bytes) -> bool:
        """False if no place was found; the filter must then be rebuilt from the stored keys."""
        mark, a, b = self._at(key)
        for place in (a, b):
            if len(self.table[place]) < SLOTS:
                self.table[place].append(mark)
                self.size += 1
                return True
        place = a
        for n in range(self.kicks):
            held = self.table[place]
            mark, held[n % SLOTS] = held[n % SLOTS], mark
            place = self._other(place, mark)
            if len(self.table[place]) < SLOTS:
                self.table[place].append(mark)
                self.size += 1
                return True
        return False

    def delete(self, key: bytes) -> bool:
        mark, a, b = self._at(key)
        for place in (a, b):
            if mark in self.table[place]:
                self.table[place].remove(mark)
                self.size -= 1
                return True
        return False

    def image(self) -> bytes:
        out = np.zeros((self.places, SLOTS), "<u2")
        for i, held in enumerate(self.table):
            out[i, : len(held)] = held
        return out.tobytes()

    @classmethod
    def of_image(cls, image: bytes) -> CuckooFilter:
        out = cls(len(image) // (2 * SLOTS))
        for i, row in enumerate(np.frombuffer(image, "<u2").reshape(-1, SLOTS).tolist()):
            out.table[i] = [m for m in row if m]
        out.size = sum(map(len, out.table))
        return out


class Bucket:
    """Live digests of one bucket: the filter answers first, the entries decide."""

    def __init__(self):
        self.filter = CuckooFilter()
        self.entries: dict[bytes, list] = {}

    def _index(self, digest: bytes) -> None:
        if self.filter.insert(digest):
            return
        places = self.filter.places * 2
        while True:  # from the stored keys, the new one among them
            self.filter = CuckooFilter(places)
            if all(map(self.filter.insert, self.entries)):
                return
            places *= 2

    def insert(self, digest: bytes, length: int, doc_id: int | None, copies: int) -> None:
        """Count ``copies`` rows whose best one is (length, doc_id)."""
        if digest in self.filter and digest in self.entries:
            held = self.entries[digest]
            held[0] = max(held[0], (length, doc_id is not None, -(doc_id or 0)))
            held[1] += copies
            return
        self.entries[digest] = [(length, doc_id is not None, -(doc_id or 0)), copies]
        self._index(digest)

    def remove(self, digest: bytes) -> None:
        """Drop a digest with no live copy; unknown ones are left alone."""
        if digest in self.filter and digest in self.entries:
            del self.entries[digest]
            self.filter.delete(digest)


def normalised(text: Column) -> Column:
    """The text without characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, length, digest): one row per row."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("length"),
        F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"),
    )


def bucket_count(docs: DataFrame) -> int:
    """A power of two from the number of rows."""
    return 1 << max(0, (docs.count() // BUCKET_ROWS).bit_length())


ENTRIES = "kind string, bucket long, digest binary, keep_length long, keep_id long, group_size long, image binary"


def _folded(rows: DataFrame) -> DataFrame:
    """In each task, copies become one row (digest, length, doc_id, copies), some thousands at a time."""

    def run(batches):
        held: dict[bytes, list] = {}

        def out():
            best = [v[0] for v in held.values()]
            return {
                "digest": list(held), "length": [b[0] for b in best],
                "doc_id": [-b[2] if b[1] else None for b in best], "copies": [v[1] for v in held.values()],
            }

        for b in batches:
            for doc_id, length, digest in zip(b["doc_id"], b["length"], b["digest"], strict=True):
                mine = (length, doc_id is not None, -(doc_id or 0))
                v = held.get(digest)
                if v is None:
                    held[digest] = [mine, 1]
                else:
                    v[0] = max(v[0], mine)
                    v[1] += 1
            if len(held) >= FOLDED:
                yield out()
                held = {}
        yield out()

    return arrow_rows(rows, "digest binary, length long, doc_id long, copies long", run)


def _bucket_of(buckets: int) -> Column:
    bits = buckets.bit_length() - 1
    return F.expr(f"shiftrightunsigned(conv(hex(substring(digest, 1, 4)), 16, 10)::bigint, {32 - bits})")


def insert(rows: DataFrame, buckets: int, stored: DataFrame | None = None) -> DataFrame:
    """Index rows after inserting digested ``rows`` into ``stored`` (None: an empty index).

    Entry rows carry a digest, the row to keep and the number of live copies; filter rows carry
    a bucket's filter image.
    """
    new = _folded(rows).select("digest", "length", "doc_id", "copies")
    if stored is not None:
        old = stored.where("kind = 'entry'").select("digest", F.col("keep_length").alias("length"), F.col("keep_id").alias("doc_id"), F.col("group_size").alias("copies"))
        new = old.unionByName(new)
    dealt = new.withColumn("bucket", _bucket_of(buckets))

    def run(batches):
        held: dict[int, Bucket] = {}
        for b in batches:
            for bucket, digest, length, doc_id, copies in zip(*(b[k] for k in ("bucket", "digest", "length", "doc_id", "copies")), strict=True):
                held.setdefault(bucket, Bucket()).insert(digest, length, doc_id, copies)
        for bucket, x in held.items():
            best, n = [v[0] for v in x.entries.values()], len(x.entries)
            yield {
                "kind": ["entry"] * n, "bucket": [bucket] * n, "digest": list(x.entries),
                "keep_length": [v[0] for v in best], "keep_id": [-v[2] if v[1] else None for v in best],
                "group_size": [v[1] for v in x.entries.values()], "image": [None] * n,
            }
            yield {
                "kind": ["filter"], "bucket": [bucket], "digest": [None], "keep_length": [None],
                "keep_id": [None], "group_size": [None], "image": [x.filter.image()],
            }

    return arrow_rows(dealt.repartition("bucket"), ENTRIES, run)


def build(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digested rows, written index) of a table of (doc_id, text)."""
    spark = docs.sparkSession
    rows, path = digested(docs), new_folder(spark, "digest-index")
    insert(rows, bucket_count(docs)).write.partitionBy("kind").parquet(path)
    return rows, spark.read.schema(ENTRIES).parquet(path)


def delete(stored: DataFrame, live: DataFrame, gone: DataFrame, buckets: int) -> DataFrame:
    """Index rows after the documents ``gone`` (doc_id) leave the digested rows ``live``.

    Digests whose last copy goes are removed from entries and filter; for others the row to keep
    is found again among the live copies.
    """
    leaving = gone.select("doc_id").distinct()
    touched = live.join(leaving, "doc_id", "left_semi").select("digest").distinct()
    rest = _folded(live.join(touched, "digest", "left_semi").join(leaving, "doc_id", "left_anti").select("doc_id", "length", "digest"))
    acts = (
        stored.select("kind", "bucket", "digest", "keep_length", "keep_id", "group_size", "image", F.lit(0).alias("act"))
        .unionByName(touched.select("digest", F.lit("entry").alias("kind"), _bucket_of(buckets).alias("bucket"), F.lit(1).alias("act")), allowMissingColumns=True)
        .unionByName(rest.select("digest", F.lit("entry").alias("kind"), _bucket_of(buckets).alias("bucket"), F.col("length").alias("keep_length"), F.col("doc_id").alias("keep_id"), F.col("copies").alias("group_size"), F.lit(2).alias("act")), allowMissingColumns=True)
    )

    def run(batches):
        held: dict[int, Bucket] = {}
        images: dict[int, bytes] = {}
        later = []
        for b in batches:
            for kind, bucket, digest, length, doc_id, copies, image, act in zip(
                *(b[k] for k in ("kind", "bucket", "digest", "keep_length", "keep_id", "group_size", "image", "act")), strict=True
            ):
                if kind == "filter":
                    images[bucket] = image
                elif act == 0:
                    held.setdefault(bucket, Bucket()).entries[digest] = [(length, doc_id is not None, -(doc_id or 0)), copies]
                else:
                    later.append((act, bucket, digest, length, doc_id, copies))
        for bucket, x in held.items():
            x.filter = CuckooFilter.of_image(images[bucket])
        for act, bucket, digest, length, doc_id, copies in sorted(later, key=lambda x: x[:3]):
            if act == 1:
                held[bucket].remove(digest)
            else:
                held[bucket].insert(digest, length, doc_id, copies)
        for bucket, x in held.items():
            best, n = [v[0] for v in x.entries.values()], len(x.entries)
            yield {
                "kind": ["entry"] * n + ["filter"], "bucket": [bucket] * (n + 1), "digest": [*x.entries, None],
                "keep_length": [*(v[0] for v in best), None], "keep_id": [*(-v[2] if v[1] else None for v in best), None],
                "group_size": [*(v[1] for v in x.entries.values()), None], "image": [None] * n + [x.filter.image()],
            }

    return arrow_rows(acts.repartition("bucket"), ENTRIES, run)


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points stays, then the smallest doc_id; a null
    doc_id comes last. Null texts count as empty. Rows that repeat the kept doc_id in one group
    are all marked kept. An empty table gives no rows; other columns are ignored.
    """
    rows, stored = build(docs)
    entries = stored.where("kind = 'entry'").select(F.col("digest").alias("d"), "keep_id", "group_size")
    return rows.join(entries, rows.digest == entries.d).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id NULLS LAST) AS keep_id
  FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay; rows that repeat a kept doc_id and its text stay with it."""
    kept = groups(docs).where("kept").select(F.col("doc_id").alias("k"), F.col("text_sha256").alias("s")).distinct()
    same = docs.doc_id.eqNullSafe(kept.k) & (F.sha2(normalised(docs.text), 256) == kept.s)
    return docs.join(kept, same, "left_semi").select(*docs.columns)
