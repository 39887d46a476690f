"""Token counts from a finite-state reading of a byte-level BPE tokenizer.

Words are read by a deterministic transducer. After each byte its state fixes the last token of
the encoding so far, and the transition carries by how many tokens the count changes; both
follow from the merge table alone. States are made when first reached and whole paths are kept
per piece, so a common piece is one step. A text is read in chunks: a chunk's state map holds
what comes before its first sure cut, the count between, and what follows its last; maps compose
associatively and are scanned pairwise, so no chunk waits for the one before it.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import arrow_rows
from fathomline.llm.units import SURE, Read, vocabulary

CHUNK = 1 << 16
NO_LIMIT = 1 << 60
SHIFT = 20


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 bytes are their own, the
    rest follow from code point 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer(Read):
    """Counts of tokens of byte strings, for a tokenizers JSON file of a byte-level BPE."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or model.get("end_of_word_suffix"):
            raise ValueError("only a byte-level BPE without a normalizer is compiled")
        import ahocorasick

        raw = lambda s: "".join(chr(letters[c]) for c in s)  # noqa: E731  a byte as a Latin-1 letter
        names = [chr(b) for b in range(256)]
        numbers = {c: i for i, c in enumerate(names)}
        self.left, self.right = list(range(256)), list(range(256))
        self.pairs: dict[int, int] = {}
        for m in model["merges"]:
            a, b = map(raw, m.split(" ") if isinstance(m, str) else m)
            if a + b in numbers:
                raise ValueError("a token has two ways to merge")
            i, l, r = len(names), numbers[a], numbers[b]
            names.append(a + b)
            numbers[a + b] = i
            self.left.append(l)
            self.right.append(r)
            self.pairs[l << SHIFT | r] = i
        self.tokens = ahocorasick.Automaton()
        for name, i in numbers.items():
            self.tokens.add_word(name, (len(name), i))
        self.tokens.make_automaton()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.joined: dict[int, bool] = {}
        super().__init__(lambda new: list(map(self.piece, new)), sum)

    def meet(self, a: int, b: int) -> bool:
        """Whether BPE leaves the tokens a and b side by side when their bytes are joined.

        Undo merges at the seam, latest first, on whichever side is later. If at some point the
        two tokens that face each other have a merge earlier than those undone, BPE joins them.
        """
        key = a << SHIFT | b
        if (known := self.joined.get(key)) is not None:
            return known
        left, right, pairs, bound, found = self.left, self.right, self.pairs, NO_LIMIT, True
        while True:
            if pairs.get(a << SHIFT | b, NO_LIMIT) < bound:
                found = False
                break
            if a > b:
                bound, a = (a, right[a]) if a > 255 else (a, -1)
                if a < 0:
                    bound, a = b + 1, bound
                    if b < 256:
                        break
                    b = left[b]
            else:
                bound = b + 1
                if b > 255:
                    b = left[b]
                elif a > 255:
                    bound, a = a, right[a]
                else:
                    break
        if len(self.joined) > 1 << 20:
            self.joined.clear()
        self.joined[key] = found
        return found

    def word(self, text: bytes) -> int:
        """Walk one word. After i bytes the state is its last token, ``count[i]`` the tokens so far.

        The vocabulary's automaton names the tokens that end at each byte, longest first; one of
        them can follow the state at its own start, and that one is the last token.
        """
        last, count, done = [0] * (len(text) + 1), [0] * (len(text) + 1), 0
        known, meet = self.joined, self.meet
        for end, (size, token) in self.tokens.iter(text.decode("latin-1")):
            if end >= done:
                k = end + 1 - size
                if not k or known.get(last[k] << SHIFT | token) or meet(last[k], token):
                    done = end + 1
                    last[done], count[done] = token, count[k] + 1
        return count[-1]

    def piece(self, text: str) -> int:
        total, at = 0, 0
        for m in [*self.at_special.finditer(text), None]:
            end = m.start() if m else len(text)
            total += sum(self.word(w.encode()) for w in self.words.findall(text[at:end])) + bool(m)
            at = m.end() if m else end
        return total

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(before the first sure cut, tokens between, after the last); no cut: (chunk, None, "")."""
        first = SURE.search(chunk)
        if first is None:
            return chunk, None, ""
        end = len(chunk)
        while True:  # the last cut lies in the last stretch that has white space
            start = max(first.start(), end - 256)
            cuts = [m.start() for m in SURE.finditer(chunk, start)]
            if cuts:
                break
            end = start
        return chunk[: first.start()], self.closed(chunk[first.start() : cuts[-1]]), chunk[cuts[-1] :]

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[1] is None and b[1] is None:
            joined = a[0] + b[0]
            return self.chunk_map(joined)
        if a[1] is None:
            head = self.chunk_map(a[0] + b[0])
            return (head[0], b[1], b[2]) if head[1] is None else (head[0], head[1] + self.closed(head[2]) + b[1], b[2])
        if b[1] is None:
            tail = self.chunk_map(a[2] + b[0])
            return (a[0], a[1], tail[0]) if tail[1] is None else (a[0], a[1] + self.closed(tail[0]) + tail[1], tail[2])
        return a[0], a[1] + self.closed(a[2] + b[0]) + b[1], b[2]

    def __call__(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if len(text) <= CHUNK:
            return self.closed(text)
        maps = [self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, between, tail = maps[0]
        return self.closed(head) + (between or 0) + self.closed(tail)


_OPEN: dict[str, Transducer] = {}


def token_counts(docs: DataFrame, vocab: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have no bytes and no tokens. Repeated rows and null ids keep their
    rows. An empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        path = vocabulary(vocab)
        count = _OPEN.get(path) or _OPEN.setdefault(path, Transducer(path))
        for b in batches:
            yield {"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": count.all(b["text"])}

    rows = docs.select(
        F.col("doc_id").cast("long"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )
    counted = arrow_rows(rows, "doc_id long, n_bytes long, n_tokens long", run)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
