"""The merge rounds against the library: every code point, long words, random strings."""

import random
import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from folioscope.llm import bpe_codec


@pytest.fixture(scope="module")
def both():
    path = bpe_codec.vocabulary()
    return bpe_codec.WordBpe(path), Tokenizer.from_file(path)


def differing(both, texts):
    mine, library = both
    want = library.encode_batch(texts, add_special_tokens=False)
    return [t for t, a, b in zip(texts, mine.encode(texts), want, strict=True) if a.tolist() != b.ids]


def test_every_code_point(both):
    """Letters that are newer than the library's tables split as it splits them."""
    points = [c for c in [*range(0x40000), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000]
    assert [hex(ord(t[1])) for t in differing(both, [f"a{chr(c)}{chr(c)}b" for c in points])] == []


def test_long_words(both):
    r = random.Random(6)
    texts = ["".join(r.choice(a) for _ in range(n)) for a in ("ab", "abcdefghijklmnopqrstuvwxyz", "étaoinshr", "a") for n in (4095, 4096, 4097, 9000)]
    texts += ["ab" * 5000, "the" * 3000 + " and " + "x" * 5000, "".join(r.choice("etaoin") for _ in range(60_000))]
    assert differing(both, texts) == []
    whole, flat = both[0]._merge_long(b"banana" * 900), both[0].merge([b"banana" * 600])[0]
    assert both[0].decode(whole).replace(" ", "").startswith("banana") and len(whole) > len(flat)


def test_random_strings(both):
    r = random.Random(9)
    some = [chr(c) for c in range(0x3000) if unicodedata.category(chr(c)) not in ("Cs",)] + list("aeiou '\n\t.,!") * 300
    assert differing(both, ["".join(r.choice(some) for _ in range(r.randrange(40))) for _ in range(4000)]) == []
    marks = [chr(c) for c in range(0x20000) if unicodedata.combining(chr(c))] + list("aeo") * 100
    assert differing(both, ["".join(r.choice(marks) for _ in range(r.randrange(9))) for _ in range(6000)]) == []


def test_decoding_is_the_library_s(both):
    mine, library = both
    for text in ("Hello, world!", "naïve 12½ ΣΑΣ", "<|startoftext|>x<|endoftext|>", ""):
        ids = next(mine.encode([text]))
        assert mine.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)
        assert np.array_equal(ids, library.encode(text, add_special_tokens=False).ids)


def test_memory_of_new_words():
    """Texts full of words that no batch had before take a bounded room in a worker."""
    letters = str.maketrans("0123456789", "etaoinshrd")
    texts = [" ".join(f"{(i * 2000 + k) * 104729 % 999999999989:012}".translate(letters) for k in range(2000)) for i in range(60)]
    batch = pa.record_batch([pa.array(range(60)), pa.array(texts)], names=["doc_id", "text"])
    run = bpe_codec._batches(bpe_codec.vocabulary(), True, False)
    list(run([batch.slice(0, 1)]))  # the tokenizer itself
    tracemalloc.start()
    rows = [x for b in run([batch]) for x in b.column(1).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) == 60 and peak < 40 << 20
