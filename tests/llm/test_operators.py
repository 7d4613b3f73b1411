"""The training-data operators against brute force, and on awkward tables."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import bpe_codec, decontaminate, jaccard_join, language_id, license_scan, quote_links, token_tree, toxicity, url_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, h long, n int, id string, component long, a long"
LONG = " ".join(f"word{i % 977} and" for i in range(120_000))
TEXTS = [None, "", "   ", "one", "the quick brown fox jumps over the lazy dog again and again today", "the quick brown fox jumps over the lazy dog again and again today", LONG, "%%% $$$", "you are an idiot and a clown"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1, 2, 3, "x", 4, 5) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "the quick brown fox", None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, separators):
    return re.findall(separators, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def check_jaccard(spark, texts):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} or {tuple(w)})
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            old, new = sorted((group[i], group[j]))[::-1]
            group = [new if g == old else g for g in group]
    got = jaccard_join.jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), group[i]) for i, s in enumerate(sets)}


def test_jaccard_is_exact(spark):
    r = random.Random(3)
    pool = [[f"w{r.randrange(60)}" for _ in range(40)] for _ in range(6)]
    texts = []
    for _ in range(150):
        w = list(r.choice(pool))
        for _ in range(r.randrange(3)):
            w[r.randrange(40)] = f"x{r.randrange(9)}"
        texts.append(" ".join(w[: r.choice([2, 3, 20, 40, 40, 40])]))
    check_jaccard(spark, texts)


def test_jaccard_chains(spark):
    """Copied leaders whose members reach each other or the other leader only."""
    r = random.Random(8)
    texts = []
    for c in range(12):
        w = [f"c{c}w{k}" for k in range(70)]
        for _ in range(9):
            texts += [" ".join(w)] * r.choice([1, 1, 2, 4])
            for _ in range(r.randrange(1, 3)):
                w[r.randrange(70)] = f"y{r.randrange(10**6)}"
    long = [f"l{r.randrange(10**6)}" for _ in range(3000)]
    texts += [" ".join(long), " ".join(long[150:]), " ".join(long[700:])]
    r.shuffle(texts)
    check_jaccard(spark, texts)


def test_jaccard_awkward(docs, empty):
    got = jaccard_join.jaccard_classes(docs, 4, 85).collect()
    assert len(got) == len(TEXTS) + 2
    by = {r.doc_id: r for r in got}
    assert [by[i].n_shingles for i in (0, 1, 2)] == [0, 0, 0] and by[3].n_shingles == 1
    assert by[5].component_id == 4 and by[1].component_id == 1
    assert jaccard_join.jaccard_classes(empty).collect() == []


def test_copies_by_row(spark):
    """One row of each group stays, and no text goes because another row has its id."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcde")
    rows = [(5, a), (3, a), (3, b), (9, c), (9, c), (None, d), (None, d), (None, e), (2, e), (7, None), (7, None), (1, a + " more")]
    got = jaccard_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got.columns == ["doc_id", "text"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, a + " more"), (3, b), (9, c), (None, d), (2, e), (7, None), (7, None)], key=repr)


def test_language_by_row(spark):
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source").limit(600)
    text = corpus.where("length(text) > 200").first().text
    odd = spark.createDataFrame([(-1, text, "en", "s"), (-1, "%%% $$$", "en", "s"), (None, "12 34", "en", "s"), (None, text, "en", "s")], corpus.schema)
    got = language_id.drop_foreign(corpus.unionByName(odd)).where("doc_id is null or doc_id < 0")
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(-1, text), (0, text)]


def test_decontaminate(docs, empty, spark):
    rx = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    items = spark.createDataFrame([(1, "quick BROWN fox, jumps over the lazy dog again and again"), (2, "lazy dog"), (3, ""), (4, None), (None, "word1 and word2 and word3")], "item_id long, text string")
    windows = {}
    for name, t in (("1", "quick BROWN fox, jumps over the lazy dog again and again"), ("2", "lazy dog"), ("null", "word1 and word2 and word3")):
        w = words(t, rx)
        for k in range(max(1, len(w) - 9)):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(name)
    want = []
    for t in [r.text for r in docs.collect()]:
        w = words(t, rx)
        hit, found = [0] * len(w), set()
        for k in range(len(w)):
            for size in {len(x) for x in windows}:
                owners = windows.get(tuple(w[k : k + size])) if k + size <= len(w) else None
                if owners:
                    found |= owners
                    hit[k : k + size] = [1] * size
        want.append((len(w), sum(hit), sorted(found)))
    got = decontaminate.contamination(docs, items, spans=True).collect()
    assert sorted((r.n_words, r.n_hit, sorted(r["items"])) for r in got) == sorted(want)
    left = decontaminate.clean_documents(docs, items)
    assert left.columns == docs.columns
    assert decontaminate.contamination(left, items).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, items).collect() == []


def test_suffix_index_counts():
    r = np.random.default_rng(5)
    seq = r.integers(0, 4, 3000)
    seq[-1] = 0
    index = decontaminate.FmIndex(seq, 3)
    text = "".join(map(str, seq))
    phrases = np.array([[0] * (6 - k) + list(p) for k in (1, 2, 3) for p in itertools.product((1, 2, 3), repeat=k)])
    lo, hi = index.search(phrases)
    for p, a, b in zip(phrases, lo, hi, strict=True):
        s = "".join(map(str, p[p > 0]))
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [m.start() for m in re.finditer(f"(?={s})", text)]


def test_bpe_equals_library(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_codec.vocabulary())
    got = bpe_codec.bpe_roundtrip(docs, bpe_codec.vocabulary(), keep_ids=True).collect()
    rows = sorted(((r.text or "") for r in docs.collect()), key=len)
    want = []
    for text in rows:
        ids = t.encode(text, add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        want.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert bpe_codec.bpe_roundtrip(empty, bpe_codec.vocabulary()).collect() == []
    b = bpe_codec.WordBpe(bpe_codec.vocabulary())
    for s in ("aaaa" * 99, "<|startoftext|>A<|endoftext|>", "it's ΣΑΣ 12½ ñ ñ", "\x1c\x85\xa0 x", "日本語 テスト", "a" * 3000):
        assert next(b.encode([s])).tolist() == t.encode(s, add_special_tokens=False).ids


def test_token_tree_after_edits(docs, empty):
    import public_tokenizers as p

    c = token_tree.Counter(p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice("ab '\n \tsl1.é") for _ in range(r.randrange(300)))
        tree = token_tree.TokenTree(text, c)
        for _ in range(4):
            a = r.randrange(len(text) + 1)
            e, new = min(len(text), a + r.choice([0, 1, 9, 200])), "".join(r.choice("ab '\n") for _ in range(r.choice([0, 2, 90])))
            tree.edit(a, e, new)
            text = text[:a] + new + text[e:]
            assert tree.text() == text and tree.total() == len(c.encoding.encode_ordinary(text))
    assert token_tree.token_counts(docs, p.path("byte_bpe_50k.tiktoken"), p.PATTERN).count() == len(TEXTS) + 2
    assert token_tree.token_counts(empty, p.path("byte_bpe_50k.tiktoken"), p.PATTERN).collect() == []


def test_urls(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/x?y", "https://www.example.com/en/", "http://com", "http://a.net/fr/b#c", "http://x.org/a?utm_source=q", "http://x.org/a?utm_source=feed", "http://x.org/ads/", "http://x.org/loads/", "http://m.free-bets.org/"]
    got = [r for r in url_rules.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert [r.verdict for r in got] == ["allow", "allow", "allow", "block", "allow", "allow", "block", "block", "allow", "block", "allow", "block"]
    assert [r.rule for r in got][3:7] == ["example.com/en/", "www.example.com/en/", None, "net/fr/"]
    assert (got[3].host, got[3].path, got[0].host, got[2].path) == ("example.com", "/en/x", "", "")


def test_fitted_models(docs, empty, spark):
    sf = "/root/testdata/sf0.01"
    corpus = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(corpus, labels)
    scored = toxicity.score_toxicity(corpus, model).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in scored) >= 0.93 * len(scored)
    assert toxicity.score_toxicity(docs, model).where("score between 0 and 1").count() == len(TEXTS) + 2
    assert toxicity.score_toxicity(empty, model).collect() == []
    found = language_id.identify(language_id.document_rows(corpus), language_id.fit(corpus)).join(corpus.withColumnRenamed("lang", "true"), corpus.doc_id == language_id.F.col("id")).collect()
    assert sum(r.lang == r.true for r in found) >= 0.98 * len(found)
    odd = {r.id: r.rejected for r in language_id.identify(language_id.document_rows(docs), language_id.fit(corpus)).collect()}
    assert odd[0] and odd[1] and odd[7] and not odd[4]
    lic = license_scan.LicenseModel([r.text.split("\n")[0] for r in corpus.limit(200).collect()], rounds=40)
    text = ["Intro line.\nLicensed under the Apache License, Version 2.0.\nMore.", "Released under the MIT License.", "We all like the license of poets and the version of events.", "", None]
    got = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string"), lic).orderBy("doc_id").collect()
    assert [[f.family for f in r.found] for r in got] == [["apache-2.0"], ["mit"], [], [], []] and got[0].found[0].line == 1


def test_foreign_sentences(spark):
    """Other languages in the same letters are rejected, ordinary sentences of the four are not."""
    sf = "/root/testdata/sf0.01"
    own = ["She opened the window because the room was too warm.", "Water boils at a lower temperature in the mountains.", "Nobody knew why the lights had gone out so early.", "Mein Bruder hat letztes Wochenende auf dem Markt ein altes Fahrrad gekauft.", "Niemand wusste, warum das Licht so früh ausgegangen war."]
    own += ["Le comité se réunira de nouveau jeudi pour discuter du budget de l'année prochaine.", "L'eau bout à une température plus basse en montagne.", "El comité se reunirá de nuevo el jueves para discutir el presupuesto del próximo año.", "Los niños deberían aprender a nadar antes de ir al mar."]
    others = ["Il comitato si riunirà di nuovo giovedì per discutere il bilancio del prossimo anno.", "Hän avasi ikkunan, koska huoneessa oli liian kuuma.", "Oda çok sıcak olduğu için pencereyi açtı.", "Otworzyła okno, ponieważ w pokoju było za gorąco.", "Utskottet sammanträder igen på torsdag för att diskutera nästa års budget."]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(own + others)], "doc_id long, text string, source string")
    got = language_id.identify(language_id.document_rows(docs), language_id.fit(spark.read.parquet(f"{sf}/documents.parquet"))).orderBy("id").collect()
    assert [r.rejected for r in got] == [False] * len(own) + [True] * len(others)


def test_short_notice(spark):
    lic = license_scan.LicenseModel(["The river ran past the old mill and the town.", "We met at the station before noon.", "This work took all of the summer."] * 70)
    text = ["All rights reserved.", "Intro line.\nALL RIGHTS RESERVED\nMore.", "Copyright 2020 Example Press. All rights reserved.", "All rights.", "This document", "This work is", "To the.", "All of us reserved seats and the rights of way."]
    got = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string"), lic).orderBy("doc_id").collect()
    assert [[f.family for f in r.found] for r in got] == [["proprietary"]] * 3 + [[]] * 5 and got[1].found[0].line == 1


def test_quotes(spark):
    rows = [(1, 0, "u", "Hello there. How are you?"), (1, 1, "a", "On Monday A wrote:\n> Hello there.\n> How are you?\n\nFine."), (1, 2, "u", ">> Hello there.\n> Fine.\nGood!"), (1, 3, "u", None), (None, None, None, "> x")]
    got = quote_links.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    assert [(r.turn, r.body, r.reply_to) for r in got] == [(None, "", None), (0, "Hello there. How are you?", None), (1, "Fine.", 0), (2, "Good!", 1), (3, "", None)]


def test_quoted_history(spark):
    """A longer nested history doesn't outweigh the message that is answered; alone, it links."""
    rows = [(1, 0, "A1. A2. A3."), (1, 1, "> A1. A2. A3.\nB1."), (1, 2, ">> A1. A2. A3.\n> B1.\nC."), (1, 3, "> said elsewhere.\n>> B1.\n>>> A1. A2. A3.\nD.")]
    rows += [(2, 0, "A1. A2."), (2, 1, "B1. B2."), (2, 2, ">> A1. A2.\n> A1. B1. B2.\nC.")]
    got = quote_links.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string").selectExpr("conv_id", "turn", "'u' as role", "text")).orderBy("conv_id", "turn").collect()
    assert [(r.reply_to, r.n_quoted, r.n_linked, r.quote_depth) for r in got] == [(None, 0, 0, 0), (0, 3, 3, 1), (1, 4, 4, 2), (1, 5, 4, 3), (None, 0, 0, 0), (None, 0, 0, 0), (1, 4, 4, 2)]


def test_reply_order(spark):
    """Replies of any depth stand below what they answer, whole threads by their first turn."""
    rows = [(1, 0, "A."), (1, 1, "B."), (1, 2, "> A.\nC."), (1, 3, "> C.\nD."), (1, 4, "> B.\nE."), (1, 5, "> A.\nF."), (1, 6, "> D.\nG."), (1, 10, "> C.\nH.")]
    rows += [(2, 0, "S0.")] + [(2, k, f"> S{k - 1}.\nS{k}.") for k in range(1, 20)] + [(None, 1, "x"), (3, None, "y"), (1, 10, "> C.\nH.")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, text string").selectExpr("conv_id", "turn", "'u' as role", "text").repartition(3)
    got = quote_links.conversations(quote_links.link_quotes(messages)).collect()
    assert [(r.turn, r.thread, r.body) for r in got if r.conv_id == 1] == [(0, 0, "A."), (2, 0, "C."), (3, 0, "D."), (6, 0, "G."), (10, 0, "H."), (10, 0, "H."), (5, 0, "F."), (1, 1, "B."), (4, 1, "E.")]
    assert [(r.turn, r.path) for r in got if r.conv_id == 2] == [(k, list(range(k + 1))) for k in range(20)]
    assert [(r.turn, r.thread, r.path) for r in got if r.conv_id in (None, 3)] == [(1, 1, [1]), (None, None, None)]


def test_arrow_slices():
    from folioscope.llm.wordhash import Shingler, Words

    texts = ["a b c d e", None, "", "a  b", "a b c d e"] * 5
    sets = [s for _, s, _ in Shingler(4, Words({32, 10})).sets(pa.array(texts)[1:])]
    assert [len(s) for s in sets] == [len({tuple((t or "").split()[i : i + 4]) for i in range(len((t or "").split()) - 3)} or ({1} if t else set())) for t in texts[1:]]
