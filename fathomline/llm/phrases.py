"""Collocations of two to five words from a weighted de Bruijn graph.

Every place of a text opens a window of up to five words that ends with its piece. Windows of five words
are edges between the overlapping nodes of their first and last four; shorter ones are piece ends. One
aggregation counts them all. A shorter phrase's count is the flow out of its node, that is the sum of the
edges and longer phrases that begin with it, plus the piece ends that are the phrase itself.

A phrase of ``least`` occurrences holds no rarer word and no rarer pair of neighbours, so pieces end there
as well. Both are told by bitmaps whose size follows from the number of frequent words and pairs, up to a
bound; beyond it more windows are counted than needed and the results are the same.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import arrow_rows, small, written

#: Words of the longest phrase.
LONGEST = 5
#: Bits of a bitmap for each key, and at most in all (32 MB).
KEY_BITS, MOST_BITS = 16, 1 << 28
#: Distinct rows that a task holds before it sends them.
HELD = 300_000
#: Parts in which the first rows of a language are looked for.
PARTS = 256
#: Lower case, one mark for all ends of pieces, one space.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz.........\x20")


def words_of(text: bytes | None) -> list[bytes]:
    """The words of all pieces in order, with ``.`` where a piece ends."""
    return (text or b"").translate(PLAIN).replace(b".", b" . ").split()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def _counted(docs: DataFrame, found) -> DataFrame:
    """(lang, gram, f) of what ``found(lang, words)`` names, summed within each task first."""

    def run(batches):
        held: dict[str, Counter] = {}

        def out():
            yield {
                "lang": [k for k, c in held.items() for _ in c], "gram": [g.decode() for c in held.values() for g in c],
                "f": [n for c in held.values() for n in c.values()],
            }
            held.clear()

        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                held.setdefault(lang, Counter()).update(found(lang, words_of(text)))
                if sum(map(len, held.values())) >= HELD:
                    yield from out()
        yield from out()

    return arrow_rows(_texts(docs), "lang string, gram string, f long", run).groupBy("lang", "gram").agg(F.sum("f").alias("f"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, f) of all words."""
    return _counted(docs, lambda lang, words: (w for w in words if w != b"."))


def word_key(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b" " + word) or 1


def pair_keys(keys: np.ndarray) -> np.ndarray:
    """A key for each word and the one after it; zero where either is zero."""
    a, b = keys[:-1], keys[1:]
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) ^ (b >> np.uint64(31)) ^ b) * np.uint64(0xBF58476D1CE4E5B9)
    return np.where((a > 0) & (b > 0), mixed ^ (mixed >> np.uint64(29)), np.uint64(0))


class Bitmap:
    """Keys that may be among those given: two bits for each, without false negatives."""

    def __init__(self, keys: DataFrame):
        """From a table of one long column ``key``; what reaches the driver is the bitmap, MOST_BITS at most."""
        size = 1 << 15
        n = keys.count()
        while size < min(KEY_BITS * n, MOST_BITS):
            size *= 2
        slots = keys.select(F.explode(F.array(*(F.expr(f"(shiftrightunsigned(key, {s}) & {size - 1}L) + 1") for s in (0, 32)))).alias("slot"))
        pages = slots.groupBy(F.expr("bitmap_bucket_number(slot)").alias("page")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
        held = np.zeros(size // 8, np.uint8)
        for r in pages.toLocalIterator():
            held[(r.page - 1) * 4096 : r.page * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
        self.sent = keys.sparkSession.sparkContext.broadcast(held)
        self.mask = size - 1

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for shift in (0, 32):
            slot = ((keys >> np.uint64(shift)) & np.uint64(self.mask)).astype(np.int64)
            found &= (self.sent.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
        return found


class Keys(dict):
    """Word -> key; zero for words that aren't frequent and for ends of pieces. Filled as words come."""

    def __init__(self, lang: str, frequent: Bitmap):
        self.start, self.bits, self.mask = lang.encode() + b" ", memoryview(frequent.sent.value), frequent.mask
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
            self[b"."] = 0
        key = xxhash.xxh64_intdigest(self.start + word) or 1
        a, b = key & self.mask, key >> 32 & self.mask
        found = self[word] = key if self.bits[a >> 3] >> (a & 7) & self.bits[b >> 3] >> (b & 7) & 1 else 0
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _frequent_words(words: DataFrame) -> Bitmap:
    def run(batches):
        for b in batches:
            keys = [word_key(x, w.encode()) for x, w in zip(b["lang"], b["gram"], strict=True)]
            yield {"key": np.array(keys, np.uint64).view(np.int64).tolist()}

    return Bitmap(written(arrow_rows(words.select("lang", "gram"), "key long", run), "word-keys"))


def _frequent_pairs(docs: DataFrame, frequent: Bitmap, least: int) -> Bitmap:
    """The pairs of neighbouring frequent words with ``least`` occurrences. Pairs of one key only stand together."""

    def run(batches):
        known: dict[str, Keys] = {}
        held, n = [], 0

        def out():
            keys, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), [])
            return {"key": keys.view(np.int64), "f": counts}

        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                keys = pair_keys(known.setdefault(lang, Keys(lang, frequent)).of(words_of(text)))
                held.append(keys[keys > 0])
                n += len(held[-1])
                if n >= 8 * HELD:
                    yield out()
                    held, n = [], 0
        yield out()

    pairs = arrow_rows(_texts(docs), "key long, f long", run).groupBy("key").agg(F.sum("f").alias("f"))
    return Bitmap(written(pairs.where(f"f >= {least}").select("key"), "pair-keys"))


def windows(docs: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(lang, gram, f): what begins at each place, up to LONGEST words and to the end of its piece, two words at least.

    ``words`` are the frequent words (lang, gram). Pieces also end at rarer words and between rarer pairs.
    """
    frequent = _frequent_words(words)
    paired = _frequent_pairs(docs, frequent, least)
    known: dict[str, Keys] = {}

    def found(lang, words):
        keys = pair_keys(known.setdefault(lang, Keys(lang, frequent)).of(words))
        open_ = (keys > 0) & paired(keys)
        at, shut = np.flatnonzero(open_), np.r_[np.flatnonzero(~open_), len(open_)]
        ends = np.minimum(at + LONGEST, shut[np.searchsorted(shut, at)] + 1)
        return [b" ".join(words[i:e]) for i, e in zip(at.tolist(), ends.tolist(), strict=True)]

    return _counted(docs, found)


def _size(gram: str = "gram") -> Column:
    return F.expr(f"length({gram}) - length(replace({gram}, ' ', '')) + 1")


def flows(counted: DataFrame) -> dict[int, DataFrame]:
    """Words of a phrase -> (lang, gram, f): each level is the flow out of its nodes, with its piece ends."""
    sized = counted.withColumn("size", _size())
    level = {LONGEST: sized.where(f"size = {LONGEST}").select("lang", "gram", "f")}
    for k in range(LONGEST - 1, 1, -1):
        out = level[k + 1].select("lang", F.substring_index("gram", " ", k).alias("gram"), "f")
        ends = sized.where(f"size = {k}").select("lang", "gram", "f")
        level[k] = written(out.unionAll(ends).groupBy("lang", "gram").agg(F.sum("f").alias("f")), f"flow-{k}")
    return level


def paths(edges: DataFrame) -> DataFrame:
    """(lang, path, f): edges (lang, gram, f) joined where a node has one edge in and one out, of the same weight.

    Each edge finds the first of its path by doubling its steps, so the rounds grow with the logarithm of the longest path.
    Edges that still have one before them when the steps exceed all edges lie on a cycle, and each stays as it is.
    """
    ends = edges.select("lang", "gram", "f", F.substring_index("gram", " ", LONGEST - 1).alias("head"), F.substring_index("gram", " ", 1 - LONGEST).alias("tail"))
    come = ends.groupBy("lang", F.col("tail").alias("node")).agg(F.count("*").alias("in"), F.first("gram").alias("before"), F.first("f").alias("f_in"))
    go = ends.groupBy("lang", F.col("head").alias("node")).agg(F.count("*").alias("out"), F.first("gram").alias("gram"), F.first("f").alias("f_out"))
    step = come.join(go, ["lang", "node"]).where("in = 1 AND out = 1 AND f_in = f_out AND before <> gram").select("lang", "gram", "before")
    at = written(
        edges.select("lang", "gram", "f").join(step, ["lang", "gram"], "left").select(
            "lang", "gram", "f", F.coalesce("before", "gram").alias("first"), F.col("before").isNotNull().cast("long").alias("steps")), "paths")
    most, reached = at.count(), 1
    while reached <= 2 * most and at.where("steps > 0").limit(1).count():
        far = at.select("lang", F.col("gram").alias("first"), F.col("first").alias("further"), F.col("steps").alias("more"))
        next_ = written(
            at.join(far, ["lang", "first"]).select("lang", "gram", "f", F.col("further").alias("first"), (F.col("steps") + F.col("more")).alias("steps")), "paths")
        moved = next_.agg(F.sum("steps")).first()[0] != at.agg(F.sum("steps")).first()[0]
        at, reached = next_, 2 * reached
        if not moved:
            break
    own = F.when(F.col("steps") >= most, F.col("gram")).otherwise(F.col("first"))
    last = F.struct("steps", F.substring_index("gram", " ", -1).alias("word"))
    return at.groupBy("lang", own.alias("first"), "f").agg(F.sort_array(F.collect_list(last)).alias("found")).select(
        "lang", F.concat_ws(" ", "first", F.expr("array_join(transform(slice(found, 2, size(found)), x -> x.word), ' ')")).alias("path"), "f",
    ).select("lang", F.trim("path").alias("path"), "f")


def _held_whole(level: dict[int, DataFrame], edges: DataFrame) -> DataFrame:
    """(lang, gram, f): phrases that lie in a longer one as frequent as f.

    The longer ones that matter have one word more: a phrase between two of one count has that count. Those of four words
    come from paths, each once.
    """
    inner = F.expr(f"transform(sequence(0, size(w) - {LONGEST - 1}), i -> array_join(slice(w, i + 1, {LONGEST - 1}), ' '))")
    found = paths(edges).withColumn("w", F.split("path", " ")).select("lang", F.explode(inner).alias("gram"), "f")
    for k in range(LONGEST - 1, 2, -1):
        both = F.array(F.substring_index("gram", " ", k - 1), F.substring_index("gram", " ", 1 - k))
        found = found.unionAll(level[k].select("lang", F.explode(both).alias("gram"), "f"))
    return found.distinct()


def first_rows(rows: DataFrame, group: str, order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows of each group with their rank: first of each of PARTS parts, then of what is left."""
    part = rows.withColumn("part", F.expr(f"pmod(xxhash64(phrase), {PARTS})"))
    near = part.withColumn("rank", F.row_number().over(Window.partitionBy(group, "part").orderBy(*order))).where(f"rank <= {top}")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(f"rank <= {top}").drop("part")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Pieces end at ``.,;:!?`` and line ends, words at spaces and tabs; A-Z count as a-z. A phrase of ``least`` occurrences or more
    is scored by 1000 * a * n / (l * r) in whole numbers at its worst cut; phrases inside a longer one that is as frequent are left out. A null
    language is ``und``; null and empty texts add nothing; a repeated row counts each time; ids play no part; an empty table gives
    no rows; further columns are ignored. Ties go by count and then by the bytes of the phrase.
    """
    words = written(word_counts(docs), "words")
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(f"f >= {least}")
    level = flows(written(windows(docs, frequent, least), "windows"))
    known = {k: rows.where(f"f >= {least}") for k, rows in level.items()}
    phrases = known[2]
    for k in range(3, LONGEST + 1):
        phrases = phrases.unionAll(known[k])
    phrases = written(phrases, "phrases")
    counts = phrases.unionAll(frequent.select("lang", "gram", "f"))
    inner = _held_whole(known, known[LONGEST])
    left = phrases.join(inner, ["lang", "gram", "f"], "left_anti").withColumn("size", _size())
    cuts = left.select(
        "lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), F.explode(F.expr("sequence(1, int(size) - 1)")).alias("k"),
        "size").select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("one"), F.expr("substring_index(phrase, ' ', int(k - size))").alias("rest"))
    side = lambda name, f: counts.select("lang", F.col("gram").alias(name), F.col("f").alias(f))
    scored = cuts.join(side("one", "l"), ["lang", "one"]).join(side("rest", "r"), ["lang", "rest"]).join(small(total), "lang")
    whole = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"(1000BD * {whole('a')} * {whole('n')}) DIV ({whole('l')} * {whole('r')})")
    worst = scored.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    return first_rows(worst, "lang", order, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM w, unnest(range(1, 6)) AS a(k), unnest(range(1, len(w) - k + 2)) AS b(i)
), f AS (SELECT lang, k, gram, count(*) AS f FROM g GROUP BY lang, k, gram),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, gram, f, string_split(gram, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
inner_ AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + j - 1], ' ') AS gram, f
  FROM c, unnest(range(2, 5)) AS a(j), unnest(range(1, 6)) AS b(i) WHERE j < k AND i + j - 1 <= k
), left_ AS (SELECT c.* FROM c ANTI JOIN inner_ i ON i.lang = c.lang AND i.gram = c.gram AND i.f = c.f),
parts AS MATERIALIZED (
  SELECT lang, gram AS phrase, f AS a, s, array_to_string(w[1:s], ' ') AS one, array_to_string(w[s + 1:k], ' ') AS rest
  FROM left_, unnest(range(1, k)) AS u(s)
), cut AS (
  SELECT p.lang, p.phrase, p.a, x.f AS l, y.f AS r, n.n, s, (1000::HUGEINT * p.a * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM parts p JOIN f x ON x.lang = p.lang AND x.gram = p.one JOIN f y ON y.lang = p.lang AND y.gram = p.rest JOIN n ON n.lang = p.lang
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, s) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
"""
