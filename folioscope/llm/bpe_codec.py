"""BPE encoding and decoding with word-end symbols in batched numpy merge rounds.

The symbols of all new words of a batch lie in one flat array.  A round looks every
adjacent pair up in the sorted keys of the merge table by binary search, takes each
word's lowest rank by a segmented minimum and merges all its occurrences at once, left
to right where they overlap.  Words that can't merge further leave the array.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import lean, table

NONE = np.int64(1 << 40)
#: Words kept between batches of a task; beyond, the cache starts anew.
CACHE = 1 << 16
#: Characters of texts that are encoded at once, and new words that are merged at once.
AT_ONCE, MERGED = 1 << 18, 1 << 13
#: Symbols from which on a word is merged by itself.
LONG = 4096
#: White space as the tokenizer's own pattern language has it.
SPACE = r"\t-\r \x85\xa0  -     　"


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=1)
def _newer() -> tuple[str, dict[int, str], str]:
    """Where the library's Unicode tables differ from this machine's, found by asking the library:
    letters and numbers that it doesn't have, lower-case forms that only it has, and marks
    that it neither orders nor composes with others.

    Only planes that Unicode assigns letters in are asked about.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    points = [chr(c) for c in [*range(0x80, 0xD800), *range(0xE000, 0x40000)]]
    asked = [c for c in regex.findall(r"[\p{L}\p{N}]", "".join(points)) if unicodedata.category(c) == "Cn"]
    # a letter comes with its neighbours, a number alone, anything else in twos
    split = pre_tokenizers.Split(Regex(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), "removed", invert=True)
    pieces = split.pre_tokenize_str(" ".join(f"a{c}{c}" for c in asked))
    whole = {p[1] for p, _ in pieces if len(p) == 3}
    single = {p for p, _ in pieces if len(p) == 1 and p != "a"}
    gone = "".join(c for c in asked if c not in whole and c not in single)
    unknown = [c for c in points if unicodedata.category(c) == "Cn"]
    low = normalizers.Lowercase().normalize_str("".join(unknown))
    plain = normalizers.NFC().normalize_str
    marks = [c for c in points if unicodedata.combining(c)]
    beside = lambda c: "\u0315" + c if unicodedata.combining(c) < 232 else c + "\u0334"  # noqa: E731  (of classes 232 and 1)
    pairs = [(c, unicodedata.decomposition(c)) for c in points]
    pairs = ["".join(chr(int(x, 16)) for x in d.split()) for c, d in pairs if d.count(" ") == 1 and d[0] != "<" and unicodedata.normalize("NFC", c) == c]
    loose = {c for c in marks if plain("a" + beside(c)) != unicodedata.normalize("NFC", "a" + beside(c))}
    loose |= {p[1] for p in pairs if plain(p) == p}
    return gone, {ord(a): b for a, b in zip(unknown, low, strict=True) if a != b} if len(low) == len(unknown) else {}, "".join(sorted(loose))


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Index(dict):
    """Numbers words in the order in which they come up."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordBpe:
    """A tokenizer file with lower-casing, word-end suffix and byte symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.keys, first = np.unique(key, return_index=True)
        self.ranks, self.made = first.astype(np.int64), made[first]
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
        gone, self.lower, loose = _newer()
        self.loose = regex.compile(f"([{loose}])") if loose else None
        self.odd = regex.compile(f"[{gone}]") if gone else None
        self.odd_words = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{gone}]]+|[\p{{N}}--[{gone}]]|(?:[^{SPACE}\p{{L}}\p{{N}}]|[{gone}])+") if gone else self.words
        # the same classes below 256, for the faster engine
        kind = lambda k: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == k)
        self.latin_words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{kind('L')}]+|[{kind('N')}]|[^\t-\r \x85\xa0{kind('L')}{kind('N')}]+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.reset()

    def reset(self) -> None:
        self.index = Index()
        self.flat, self.offsets = np.empty(0, np.int64), np.zeros(1, np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat token ids of all words, and each word's number of them."""
        if any(len(w) >= LONG for w in words):
            some = [i for i, w in enumerate(words) if len(w) < LONG]
            flat, n = self.merge([words[i] for i in some]) if some else (np.empty(0, np.int64), np.zeros(0, np.int64))
            made: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
            for i, part in zip(some, np.split(flat, np.cumsum(n)[:-1]) if some else [], strict=True):
                made[i] = part
            for i, w in enumerate(words):
                if len(w) >= LONG:
                    made[i] = self._merge_long(w)
            return np.concatenate(made), np.array([len(x) for x in made], dtype=np.int64)
        length = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum(length)
        sym = self.inner[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), length)
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), dtype=np.int64)
        new = np.flatnonzero(word[1:] == word[:-1])
        done_sym, done_word = [], []
        while len(sym):
            if len(new):  # pairs that arose in the last round
                key = sym[new] << 20 | sym[new + 1]
                at = np.searchsorted(self.keys, key)
                at[at == len(self.keys)] = 0
                fits = self.keys[at] == key
                rank[new] = np.where(fits, self.ranks[at], NONE)
                made[new] = self.made[at]
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, start)
            count = np.diff(np.append(start, len(sym)))
            if (low == NONE).any():
                out = np.repeat(low == NONE, count)
                done_sym.append(sym[out])
                done_word.append(word[out])
                live = ~out
                sym, word, rank, made = sym[live], word[live], rank[live], made[live]
                low, count = low[low < NONE], count[low < NONE]
            if not len(sym):
                break
            pos = np.flatnonzero(rank == np.repeat(low, count))
            if len(pos) > 1:  # of overlapping pairs every second one, from the left
                head = np.append(True, np.diff(pos) > 1)
                run = np.maximum.accumulate(np.where(head, np.arange(len(pos)), 0))
                pos = pos[(np.arange(len(pos)) - run) % 2 == 0]
            sym[pos] = made[pos]
            live = np.ones(len(sym), dtype=bool)
            live[pos + 1] = False
            sym, word, rank, made = sym[live], word[live], rank[live], made[live]
            pos = pos - np.arange(len(pos))
            rank[pos] = NONE  # the pair is gone; the next may not exist
            near = np.zeros(len(sym) + 1, dtype=bool)
            near[pos] = near[pos - 1] = True  # -1 is the spare last place
            new = np.flatnonzero(near[: len(sym) - 1])
            new = new[word[new] == word[new + 1]]
        if not done_sym:
            return np.empty(0, np.int64), np.zeros(0, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def _merge_long(self, word: bytes) -> np.ndarray:
        """Token ids of one word: in each round the places of the lowest rank, which are kept by rank."""
        data = np.frombuffer(word, dtype=np.uint8)
        sym, n = np.append(self.inner[data], 0), len(data)
        sym[n - 1] = self.last[data[-1]]
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # n is behind the end
        rank, made = np.full(n + 1, NONE), np.zeros(n + 1, dtype=np.int64)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look(at: np.ndarray) -> None:
            """Ranks of the pairs that begin at these places."""
            rank[at] = NONE
            at = at[after[at] < n]
            key = sym[at] << 20 | sym[after[at]]
            k = np.searchsorted(self.keys, key)
            k[k == len(self.keys)] = 0
            fits = self.keys[k] == key
            at, k = at[fits], k[fits]
            rank[at], made[at] = self.ranks[k], self.made[k]
            order = np.argsort(rank[at], kind="stable")
            at = at[order]
            edge = np.flatnonzero(np.append(True, rank[at][1:] != rank[at][:-1])) if len(at) else []
            for part in np.split(at, edge[1:]) if len(at) else []:
                r = int(rank[part[0]])
                if r not in places:
                    places[r] = []
                    heapq.heappush(heap, r)
                places[r].append(part)

        look(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            pos = np.unique(np.concatenate(places.pop(r)))
            pos = pos[rank[pos] == r]
            if not len(pos):
                continue
            # of overlapping pairs every second one, from the left
            head = np.append(True, after[pos[:-1]] != pos[1:])
            run = np.maximum.accumulate(np.where(head, np.arange(len(pos)), 0))
            pos = pos[(np.arange(len(pos)) - run) % 2 == 0]
            sym[pos] = made[pos]
            gone = after[pos]
            rank[gone] = NONE
            after[pos] = after[gone]
            before[after[pos]] = pos
            near = np.concatenate([pos, before[pos]])
            look(np.unique(near[near >= 0]))
        out, at = np.zeros(n, dtype=bool), 0
        while at < n:
            out[at] = True
            at = after[at]
        return sym[:n][out]

    def _learn(self, new: list[str]) -> None:
        made = [self.merge([w.encode("utf-8", "surrogatepass") for w in new[i : i + MERGED]]) for i in range(0, len(new), MERGED)]
        self.flat = np.concatenate([self.flat, *(flat for flat, _ in made)])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(np.concatenate([count for _, count in made]))])

    def normal(self, text: str) -> str:
        if not text.isascii():
            if self.loose and self.loose.search(text):
                text = "".join(unicodedata.normalize("NFC", x) for x in self.loose.split(text))
            else:
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # no final form: letters are lowered one by one
                text = text.replace("Σ", "σ")
            text = text.translate(self.lower) if self.lower else text
        return text.lower()

    def split(self, text: str) -> list[str]:
        if _is_latin(text):  # such texts are in normal form, and their lower case is as short
            return self.latin_words.findall(text.lower())
        text = self.normal(text)
        if _is_latin(text):
            return self.latin_words.findall(text)
        return (self.odd_words if self.odd and self.odd.search(text) else self.words).findall(text)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Token ids of each text.  Texts of some AT_ONCE characters are a good batch."""
        if len(self.index) > CACHE:
            self.reset()
        index = self.index

        def numbered(piece: str) -> np.ndarray:  # the words' own strings go at once
            words = self.split(piece)
            return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

        parts: list[list[np.ndarray | int]] = []
        for text in texts:
            pieces = self.cut.split(text) if self.cut and "<|" in text else [text]
            parts.append([self.special[p] if p in self.special else numbered(p) for p in pieces if p])
        if index.new:
            self._learn(index.new)
            index.new = []
        for part in parts:
            out = []
            for p in part:
                if isinstance(p, int):
                    out.append(np.array([p], dtype=np.int64))
                elif len(w := p):
                    a, n = self.offsets[w], self.offsets[w + 1] - self.offsets[w]
                    shift = np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n)
                    out.append(self.flat[shift + np.arange(len(shift))])
            yield np.concatenate(out) if out else np.empty(0, np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """Token texts joined by blanks: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def _loaded(path: str) -> WordBpe:
    return WordBpe(path)


def _batches(path: str, keep_ids: bool, keep_text: bool):
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * keep_ids + [("decoded", pa.string())] * keep_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path)
        for batch in batches:
            ids, texts = batch.column(0).cast(pa.int64()), batch.column(1)
            i = 0
            while i < batch.num_rows:
                j, size, some = i, 0, []
                while j < batch.num_rows and (j == i or size < AT_ONCE):
                    some.append(texts[j].as_py() or "")
                    size += len(some[-1])
                    j += 1
                rows = []
                for got in bpe.encode(some):
                    text = bpe.decode(got)
                    row = (len(got), hashlib.sha256(got.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                    rows.append(row + (got.astype(np.int32),) * keep_ids + (text,) * keep_text)
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [f.type for f in schema][1:], strict=True)]
                yield pa.record_batch([ids.slice(i, j - i), *columns], schema=schema)
                i = j
        bpe.reset()  # the worker process may live on, with other work to do

    return run


def bpe_roundtrip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep_text: bool | None = None) -> DataFrame:
    """Token ids of every whole text and what they decode to, as digests or in full
    (the text too, unless ``keep_text`` is false).

    A null text counts as empty: no tokens, and the digests of nothing.  Rows with equal
    or null ids stay separate; other columns are ignored; an empty table gives no rows.
    """
    keep_text = keep_ids if keep_text is None else keep_text
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(_batches(path, keep_ids, keep_text)), kind)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe_codec(spark, sf_dir: str) -> DataFrame:
    return bpe_roundtrip(table(spark, sf_dir, "documents"), vocabulary())


#: Not expressible in SQL; tested against the tokenizers library.
QUERIES, ORACLES = {"op10_bpe_codec": op10_bpe_codec}, {}
