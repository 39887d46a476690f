"""Benchmark decontamination by spaced seeds, with DataFrame expressions only.

Fixed masks read some word positions of a short window and ignore the others, so a changed word
between them does not hide a copied passage. Hashes of the masked words of documents and of
benchmark items are joined; a hit fixes how the item lies against the document, and the words of
both are compared along the whole item. Up to one word in five may differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import small, written

#: 1: the word counts. Five words each over 5, 7 and 9 positions find all changes of up to a fifth of the words of items of 11 to 15 words
#: (all cases counted) and all of 3,000 drawn for each length up to 60.
MASKS = ("11111", "1101011", "110010101")
#: For items of 5 to 10 words, where those would miss changes: a stretch of three words stays whole beside one change
#: in 6 to 9 words or two in 10, and the second mask sees a changed middle of five.
SHORT_MASKS = ("111", "11011")
SHORTEST, SHORT = 5, 10
SEGMENT = 2048
ALIKE = 0.8
#: A copied part of an item counts from this many words on.
PART = 13


def words(text: Column | str = "text") -> Column:
    """Lower-cased runs of letters and digits."""
    return F.expr(words_sql(text)) if isinstance(text, str) else F.filter(
        F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""
    )


def words_sql(text: str = "text") -> str:
    return f"filter(split(lower(coalesce({text}, '')), r'[^\\p{{L}}\\p{{N}}]+'), w -> w <> '')"


def segments(words: str, length: int, reach: int) -> Column:
    """Overlapping parts (s, words) of an array, as an array.

    A lambda variable holds the words: an expression that stood inside another lambda would be
    evaluated anew for each element.
    """
    return F.expr(
        f"flatten(transform(array({words}), w -> transform(sequence(0, greatest(0, size(w) - 1), {length}), "
        f"s -> struct(s AS s, slice(w, s + 1, {length + reach}) AS words))))"
    )


def _seeds(hashes: str, masks: tuple[str, ...], least: int) -> str:
    """SQL for the array of (at, the masks' hashes) over an array of word hashes, from windows of ``least`` words on."""
    reads = [", ".join(f"get(h, i + {p})" for p, c in enumerate(m) if c == "1") for m in masks]
    each = ", ".join(f"xxhash64('{m}', {r})" for m, r in zip(masks, reads, strict=True))
    return (
        f"flatten(transform(array({hashes}), h -> transform(sequence(0, size(h) - {least}), "
        f"i -> struct(i AS at, array({each}) AS seeds))))"
    )


def _exploded(rows: DataFrame, key: str, words: str, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """(key, at, seed) for every window of every row; long texts are read in segments."""
    reach, least = max(map(len, masks)) - 1, min(map(len, masks))
    parts = rows.select(key, F.explode(segments(words, SEGMENT, reach)).alias("p")).where(f"size(p.words) >= {least}")
    windows = parts.select(key, "p.s", F.explode(F.expr(_seeds("transform(p.words, w -> xxhash64(w))", masks, least))).alias("w"))
    return windows.select(key, (F.col("s") + F.col("w.at")).alias("at"), F.explode("w.seeds").alias("seed"))


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, item_words, share, run): verified overlaps, the best of each pair.

    ``matched`` counts equal words along the alignment, ``share`` is that over the item's words,
    ``run`` the best score of a part (1 for an equal word, -3 for another). A pair counts with a
    share of 0.8 or a run of 13. Items of fewer than five words count where a document has these
    words and no others. Null texts have no words; null ids are matched as such; repeated rows
    count once. Empty tables give no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    item_words = written(items.select(F.col("item_id").cast("long"), words().alias("words")).where("size(words) > 0").distinct(), "items")
    long, brief = item_words.where(f"size(words) > {SHORT}"), item_words.where(f"size(words) BETWEEN {SHORTEST} AND {SHORT}")
    of_items, of_docs = _exploded(long, "item_id", "words"), _exploded(docs, "doc_id", words_sql())
    if brief.limit(1).count():
        of_items = of_items.unionByName(_exploded(brief, "item_id", "words", SHORT_MASKS))
        of_docs = of_docs.unionByName(_exploded(docs, "doc_id", words_sql(), SHORT_MASKS))
    seeds = written(of_items.distinct(), "seeds").withColumnRenamed("at", "item_at")
    hits = written(
        of_docs.join(small(seeds), "seed")
        .select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct(),
        "hits",
    )
    rows = docs.join(small(hits), docs.doc_id.eqNullSafe(hits.doc_id)).select(
        docs.doc_id, "item_id", "shift", "text"
    )
    kept_items = item_words.withColumnRenamed("item_id", "i")
    beside = rows.join(small(kept_items), F.col("item_id").eqNullSafe(F.col("i"))).select("doc_id", "item_id", F.expr(
        f"flatten(transform(array({words_sql()}), own -> transform(words, (w, k) -> "
        "coalesce(shift + k >= 0 AND get(own, CAST(shift + k AS INT)) = w, false))))"
    ).alias("same"))
    scored = beside.select(
        "doc_id", "item_id", F.size("same").alias("item_words"),
        F.expr("size(filter(same, s -> s))").alias("matched"),
        F.expr(
            "aggregate(same, struct(0 AS now, 0 AS best), (a, s) -> struct("
            "greatest(0, a.now + if(s, 1, -3)) AS now, greatest(a.best, a.now + if(s, 1, -3)) AS best), a -> a.best)"
        ).alias("run"),
    ).withColumn("share", F.expr("CAST(matched AS DOUBLE) / item_words"))
    short = (
        docs.select("doc_id", words().alias("own")).where(f"size(own) BETWEEN 1 AND {SHORTEST - 1}")
        .join(kept_items.where(f"size(words) < {SHORTEST}"), F.col("own") == F.col("words"))
        .select("doc_id", F.col("i").alias("item_id"), F.size("words").alias("item_words"), F.size("words").alias("matched"),
                F.size("words").alias("run"), F.lit(1.0).alias("share"))
    )
    found = scored.where(f"share >= {ALIKE} OR run >= {PART}").unionByName(short)
    best = F.max(F.struct("share", "matched", "run", "item_words")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.matched", "b.item_words", "b.share", "b.run")


def op8_leaks(spark, sf_dir: str) -> DataFrame:
    found = overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "item_id", F.col("matched").cast("long"), F.col("item_words").cast("long"), F.round("share", 6).alias("share")
    )


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a verified overlap."""
    bad = overlaps(docs, items).select("doc_id").distinct()
    marked = bad.withColumnRenamed("doc_id", "b")
    return docs.join(marked, docs.doc_id.eqNullSafe(marked.b), "left_anti").select(*docs.columns)


def _sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


#: Without the masks: whatever counts as a match has three equal words in a row at one shift, or two where the item has five words.
OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_sql_words('text')} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_sql_words('text')} AS w FROM benchmark),
dp AS (SELECT doc_id, w, unnest(range(0, len(w) - 1)) AS pos FROM d WHERE len(w) > 1),
bp AS (SELECT item_id, w, unnest(range(0, len(w) - 1)) AS pos FROM b WHERE len(w) >= {SHORTEST}),
ds AS (SELECT doc_id, pos, w[pos + 1] || ' ' || w[pos + 2] AS two, w[pos + 3] AS third FROM dp),
bs AS (SELECT item_id, pos, w[pos + 1] || ' ' || w[pos + 2] AS two, w[pos + 3] AS third, len(w) AS n FROM bp),
hits AS (
  SELECT DISTINCT doc_id, item_id, ds.pos - bs.pos AS shift FROM ds JOIN bs ON ds.two = bs.two AND ds.third = bs.third
  UNION SELECT doc_id, item_id, ds.pos - bs.pos FROM ds JOIN bs ON ds.two = bs.two AND bs.n = {SHORTEST}
),
beside AS (
  SELECT doc_id, item_id, len(b.w) AS item_words, list_transform(range(0, len(b.w)),
    lambda k: CASE WHEN shift + k >= 0 THEN coalesce(d.w[shift + k + 1] = b.w[k + 1], false) ELSE false END) AS same
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)
), scored AS (
  SELECT doc_id, item_id, item_words, len(list_filter(same, lambda s: s)) AS matched,
    list_reduce(list_prepend(0, list_transform(same, lambda s: CASE WHEN s THEN 1 ELSE -3 END)), lambda a, s:
      greatest(a // 100000, greatest(0, a % 100000 + s)) * 100000 + greatest(0, a % 100000 + s)) // 100000 AS run
  FROM beside
)
SELECT doc_id, item_id, max(matched) AS matched, any_value(item_words) AS item_words, round(max(matched) / any_value(item_words), 6) AS share
FROM (SELECT * FROM scored WHERE matched / item_words >= {ALIKE} OR run >= {PART}
  UNION ALL SELECT doc_id, item_id, len(b.w), len(b.w), len(b.w) FROM d JOIN b ON d.w = b.w WHERE len(b.w) BETWEEN 1 AND {SHORTEST - 1})
GROUP BY doc_id, item_id
"""
