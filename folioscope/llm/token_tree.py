"""Edit-aware token counts: a segment tree of pre-tokens per document.

Leaves are short runs of pre-tokens with their character and token counts; inner nodes
hold sums.  An edit finds its place by descent, re-splits only the touched characters
plus a boundary context and stops where the new split meets an old boundary again: the
pattern looks back at nothing, so from there on all pre-tokens are as they were.  Only
new pre-tokens are encoded, and only the sums above the touched leaves change.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import lean, table

#: Characters after its end that decide where a pre-token ends, and one to spare.
CONTEXT = 3
LEAF = 64
CACHE = 200_000

#: What the default edits replace: addresses, keys and long numbers.
EDITS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"),
    (r"\b(?:AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{16,}|gh[pousr]_[A-Za-z0-9]{20,})", "<secret>"),
    (r"\+?\d(?:[ ().-]?\d){6,}", "<number>"),
)


class Counter:
    """Token counts of single pre-tokens, cached."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        one = self.encoding.encode_ordinary
        for p in pieces:
            if p not in known:
                known[p] = len(one(p))
        return [known[p] for p in pieces]


class TokenTree:
    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        pieces = counter.pattern.findall(text)
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.counts = [counter.counts(x) for x in self.leaves]
        self.width = 1
        while self.width < len(self.leaves):
            self.width *= 2
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, x in enumerate(self.leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(map(len, x)), sum(self.counts[i])
        for i in range(self.width - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.encoded = 0

    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join("".join(x) for x in self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """Leaf that holds a character, and the leaf's first character's place."""
        i, base = 1, 0
        while i < self.width:
            i *= 2
            if base + self.chars[i] <= at and self.chars[i + 1]:
                base += self.chars[i]
                i += 1
        return i - self.width, base

    def _update(self, leaf: int) -> None:
        i = self.width + leaf
        self.chars[i], self.tokens[i] = sum(map(len, self.leaves[leaf])), sum(self.counts[leaf])
        while i > 1:
            i //= 2
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters [start, end) of the text as it is now."""
        length = self.chars[1]
        start = max(0, min(start, length))
        end = max(start, min(end, length))
        first, base = self._find(max(0, start - CONTEXT))
        k = 0
        while k < len(self.leaves[first]) and base + len(self.leaves[first][k]) + CONTEXT <= start:
            base += len(self.leaves[first][k])
            k += 1
        # old pre-tokens from here on, as far as needed
        leaf, old, places, at = first, [], [], base
        more = 256

        def read(limit: int) -> None:
            nonlocal leaf, at
            while leaf < len(self.leaves) and at < limit:
                for n, p in enumerate(self.leaves[leaf]):
                    if leaf == first and n < k:
                        continue
                    places.append((at, leaf, n))
                    old.append(p)
                    at += len(p)
                leaf += 1

        while True:
            read(end + more)
            was = "".join(old)
            window = was[: start - base] + new + was[end - base :]
            whole, shift = at >= length, len(new) - (end - start)
            border = {p: i for i, (p, _, _) in enumerate(places) if p >= end}
            pieces, meet, stop = [], None, None
            for m in self.counter.pattern.finditer(window):
                here = base + m.start()
                if here >= start + len(new) and here - shift in border:
                    meet = border[here - shift]
                    break
                if not whole and m.end() + CONTEXT > len(window):
                    stop = True
                    break
                pieces.append(m.group())
            if stop:
                more *= 4
                continue
            if meet is None and not whole:
                more *= 4
                continue
            break
        counts = self.counter.counts(pieces)
        self.encoded += len(pieces)
        if meet is None:
            last, tail = max(first, leaf - 1), None
        else:
            _, last, tail = places[meet]
        rest = ([], []) if tail is None else (self.leaves[last][tail:], self.counts[last][tail:])
        self.leaves[first], self.counts[first] = self.leaves[first][:k] + pieces, self.counts[first][:k] + counts
        for i in range(first + 1, last + (tail is None)):
            self.leaves[i], self.counts[i] = [], []
        if last == first:
            self.leaves[first] += rest[0]
            self.counts[first] += rest[1]
        elif tail is not None:
            self.leaves[last], self.counts[last] = rest
        for i in range(first, last + 1):
            self._update(i)


def edits_of(text: str, patterns) -> list[tuple[int, int, str]]:
    """Places that the patterns find; where they overlap the leftmost wins, of those that begin together the earlier pattern's."""
    found: list[tuple[int, int, str]] = []
    for p, new in patterns:
        for m in p.finditer(text):
            if m.end() > m.start():
                found.append((m.start(), m.end(), new))
    if len(found) > 1:
        rank = sorted(range(len(found)), key=lambda i: found[i][0])
        kept, upto = [], 0
        for i in rank:
            if found[i][0] >= upto:
                kept.append(found[i])
                upto = found[i][1]
        return kept
    return found


@lru_cache(maxsize=2)
def _counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def _run(path: str, pattern: str, edits):
    schema = pa.schema([("doc_id", pa.int64()), ("tokens_before", pa.int64()), ("n_edits", pa.int64()), ("tokens_after", pa.int64()), ("pieces_encoded", pa.int64()), ("chars_after", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, pattern)
        patterns = [(regex.compile(p), new) for p, new in edits]
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                tree = TokenTree(text, counter)
                before, shift, todo = tree.total(), 0, edits_of(text, patterns)
                for a, b, new in todo:
                    tree.edit(a + shift, b + shift, new)
                    shift += len(new) - (b - a)
                rows.append((before, len(todo), tree.total(), tree.encoded, tree.chars[1]))
            if rows:
                yield pa.record_batch([batch.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True))], schema=schema)
        counter.known.clear()  # the worker process may live on, with other work to do

    return run


def token_counts(docs: DataFrame, path: str, pattern: str, edits=EDITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of every whole text before and after its edits, and the work they took.

    A null text counts as empty.  Rows with equal or null ids stay separate; other columns
    are ignored; an empty table gives no rows.
    """
    kind = "doc_id long, tokens_before long, n_edits long, tokens_after long, pieces_encoded long, chars_after long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(_run(path, pattern, edits)), kind)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: Not expressible in SQL; tested against counting edited texts from the start.
QUERIES, ORACLES = {"op1_token_counts": op1_token_counts}, {}
