"""Language, quality, rules and language-model operators against brute force on small tables."""

import collections
import math
import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pytest

from sieveline.llm import common, langfilter, mil, ngram_lm, risk_rules

from .helpers import ODD, documents, prose, remainder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- language filter -----------------------------------------------------------------------------


def _tongue(lang, seed, n):
    parts = {"aa": ["ka", "ti", "mo"], "bb": ["sch", "ung", "ver"], "cc": ["éau", "tre", "çon"]}[lang]
    r = random.Random(seed)
    return " ".join("".join(r.choices(parts, k=r.randint(1, 3))) for _ in range(n))


def test_language_filter(spark):
    rows = [(k, _tongue(lang := ("aa", "bb", "cc")[k % 3], k, 60), lang) for k in range(60)]
    rows += [(None, _tongue("aa", 77, 50), "aa"), (100, None, "aa"), (101, "12 34 !", "bb"), (102, _tongue("cc", 8, 9), None)]
    docs = documents(spark, rows, True)
    model = langfilter.fit(docs.where("doc_id < 45").select("text", "lang"))
    assert model.languages == ["aa", "bb", "cc"]
    got = langfilter.predict(docs, model)
    assert sorted(got.columns) == sorted({*docs.columns, "lang_score"})  # a clashing column is replaced
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert all(by_id[i]["lang_pred"] == lang for i, _, lang in rows[:60])
    assert by_id[None]["lang_pred"] == "aa" and by_id[102]["lang_pred"] == "cc"
    assert (by_id[100]["lang_pred"], by_id[100]["lang_score"]) == ("und", 0.0) == (by_id[101]["lang_pred"], by_id[101]["lang_score"])
    assert all(0 <= r["lang_score"] <= 1 for r in by_id.values())


def _kept(rows, least=langfilter.LEAST, share=langfilter.SHARE):
    """For each language the hashes of its n-grams, by plain counting."""
    counts = collections.defaultdict(collections.Counter)
    for _, t, lang in rows:
        counts[lang].update(langfilter.grams(common.words(langfilter.letters(pa.array([t])))[0])[0].tolist())
    totals = {lang: sum(c.values()) for lang, c in counts.items()}
    most = collections.Counter()
    for lang, c in counts.items():
        for g, n in c.items():
            most[g] = max(most[g], n / totals[lang])
    return {lang: {g for g, n in c.items() if n >= least and n / totals[lang] >= share * most[g]} for lang, c in counts.items()}


@pytest.mark.parametrize("shard_grams", [1 << 19, 40])
def test_bit_slices_hold_exactly_each_language(spark, shard_grams):
    """The filter's answer for an n-gram is each language's own Bloom filter's answer, in one shard or several."""
    rows = [(k, _tongue(lang := ("aa", "bb", "cc")[k % 3], k, 40) + " " + _tongue("bb", k, 2), lang) for k in range(30)]
    docs = documents(spark, rows)
    model = langfilter.fit(docs.select("text", "lang"), n_slots=256, shard_grams=shard_grams)
    kept, n = _kept(rows), len(model.shards)
    assert n == max(1, -(-len(set().union(*kept.values())) // shard_grams)) and (n > 2) == (shard_grams == 40)
    assert any(kept[x] != langfilter.grams(common.words(langfilter.letters(pa.array([t for _, t, y in rows if x == y])))[0])[0].tolist() for x in kept)
    own = {}
    for k, lang in enumerate(model.languages):
        h = np.array(sorted(kept[lang]), np.uint64)
        for s, shard in enumerate(model.shards):
            bits = np.zeros(256, bool)
            bits[langfilter.slots(h[(h >> np.uint64(40)) % np.uint64(n) == s], 256).reshape(-1)] = True
            assert (shard.masks[:, 0] >> k & 1).astype(bool).tolist() == bits.tolist()
            assert shard.false_rate[k] == pytest.approx(bits.mean() ** langfilter.HASHES)
            own[lang, s] = bits
    text = _tongue("aa", 5, 20) + " " + _tongue("bb", 6, 9) + " qwrtz"
    h, _ = langfilter.grams(common.words(langfilter.letters(pa.array([text])))[0])
    want = {}
    for lang in model.languages:
        found = 0.0
        for g in h:
            s = int(g >> np.uint64(40)) % n
            f = own[lang, s].mean() ** langfilter.HASHES
            found += (own[lang, s][langfilter.slots(np.array([g]), 256)[0]].all() - f) / (1 - f)
        want[lang] = min(1, max(0, found / len(h)))
    best = max(sorted(want), key=want.get)
    got = langfilter.predict(documents(spark, [(1, text, "xx"), (2, "", "xx")], True), model).collect()
    by_id = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in got}
    assert by_id[1] == (best, pytest.approx(want[best])) and by_id[2] == ("und", 0.0)


def test_no_ngram_is_left_out_for_being_rare(spark):
    """Many more n-grams than any fixed number: each that was seen twice counts for its language."""
    r = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = list({"".join(r.choices(letters, k=7)) for _ in range(9000)})
    rows = [(k, " ".join(words[k::20]) + " zebra" * 300, "aa") for k in range(20)] + [(100 + k, " ".join(words[k::20]), "aa") for k in range(20)] + [(200, "крокодил жираф " * 9, "bb")]
    model = langfilter.fit(documents(spark, rows).select("text", "lang"))
    assert len(_kept(rows)["aa"]) > 30_000
    rare = " ".join(words[:40])
    assert langfilter.predict(documents(spark, [(1, rare, None)]), model).first()["lang_score"] == pytest.approx(1, abs=1e-6)


def test_too_many_labels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langfilter, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        langfilter.fit(documents(spark, [(k, "word", f"l{k}") for k in range(3)]).select("text", "lang"))


def test_language_filter_without_training_rows(spark):
    docs = documents(spark, [(1, "abc", None)])
    model = langfilter.fit(docs.select("text", "lang"))
    assert [(r["lang_pred"], r["lang_score"]) for r in langfilter.predict(docs, model).collect()] == [("und", 0.0)]
    assert langfilter.predict(documents(spark, []), model).count() == 0
    long = "кот " * 200_000
    model = langfilter.fit(documents(spark, [(1, "кот и пёс", "ru"), (1, "кот и пёс", "ru"), (2, "cat and dog", "en"), (2, "cat and dog", "en")]).select("text", "lang"))
    assert [tuple(r) for r in langfilter.predict(documents(spark, [(9, long), (9, long)]), model).select("doc_id", "lang_pred").collect()] == [(9, "ru")] * 2


# --- attention model -----------------------------------------------------------------------------


def test_gradient_of_the_gated_attention():
    r = np.random.default_rng(3)
    x, n, label = r.normal(size=(12, mil.WIDTH)), np.array([5, 1, 6]), np.array([1.0, 0.0, 1.0])
    m = mil.GatedAttention(seed=1)
    for p in m.p.values():
        p += r.normal(0, 0.1, p.shape)

    def loss():
        y = m.forward(x, n)["y"]
        return -np.mean(label * np.log(y) + (1 - label) * np.log(1 - y))

    for name, g in m.gradient(x, n, label).items():
        flat, own = m.p[name].reshape(-1), g.reshape(-1)
        for k in r.integers(0, len(flat), 4):
            kept = flat[k]
            flat[k] = kept + 1e-5
            up = loss()
            flat[k] = kept - 1e-5
            down = loss()
            flat[k] = kept
            assert own[k] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_attention_weighs_passages():
    x, n = mil.passages(pa.array([prose(1, 200), "", "x " * 64]))
    assert n.tolist() == [4, 1, 1] and not x[4].any()
    f = mil.GatedAttention().forward(x.astype(float), n)
    assert np.allclose(common.segment_sums(f["a"], n), 1)
    assert x[5, -3] == pytest.approx(1 / 64) and x[5, -2] == pytest.approx(63 / 64)


def test_quality_model(spark):
    junk = lambda k: " ".join(f"{w}###" for w in prose(k, 90).split())
    rows = [(k, prose(k, 90) if k % 3 else junk(k)) for k in range(150)] + [(900, None), (901, ""), (None, prose(5, 90))]
    docs = documents(spark, rows, True)
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(100)] + [(None, 1, 0), (7, None, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    model = mil.fit(docs.select("doc_id", "text"), labels)
    got = {r["doc_id"]: r["quality_score"] for r in mil.predict(docs, model).collect()}
    assert all((got[k] >= 0.5) == (k % 3 > 0) for k in range(100, 150))
    assert all(0 <= y <= 1 for y in got.values()) and got[900] == got[901]
    none = mil.fit(docs.select("doc_id", "text"), labels.limit(0))
    assert {r["quality_score"] for r in mil.predict(docs, none).collect()} == {0.5}


def _by_hand(rows, labels, texts, taken=None):
    """Scores of ``texts`` by a model fitted on whole documents without Spark."""
    kinds = collections.defaultdict(set)
    for i, q, _ in labels:
        if i is not None and q is not None:
            kinds[i].add(q)
    known = {i: t for i, t in rows if i is not None and len(kinds[i]) == 1 and (taken is None or i in taken)}
    ids = sorted(known)
    x, n = mil.passages(pa.array([known[i] or "" for i in ids], pa.string()))
    model = mil.GatedAttention().fit(x.astype(np.float64), n, np.array([float(next(iter(kinds[i]))) for i in ids]))
    return model.score(*mil.passages(pa.array([t or "" for t in texts], pa.string())))


def test_every_passage_of_a_document_teaches(spark):
    """The fitted model is that of all passages, also of documents with hundreds of them."""
    telling = lambda k: f"{prose(k, 64 * 90)} {' '.join('BUY!!! now!!!' for _ in range(64))} {prose(900 + k, 64 * 90)}"
    rows = [(k, telling(k) if k % 2 else prose(k, 64 * 120)) for k in range(16)] + [(50, None), (51, "x"), (None, telling(99))]
    labels = [(k, int(k % 2 == 0), 0) for k in range(16)] + [(50, 0, 0), (51, 0, 0), (51, 1, 0), (None, 0, 0)]
    docs, marks = documents(spark, rows, True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["quality_score"] for r in mil.predict(docs, mil.fit(docs.select("doc_id", "text"), marks)).collect()}
    want = _by_hand(rows, labels, [t for _, t in rows])
    assert [got[i] for i, _ in rows] == pytest.approx(want.tolist(), abs=1e-4)
    assert all((got[k] > 0.5) == (k % 2 == 0) for k in range(16))
    # the bound on passages leaves out whole documents
    order = [r[0] for r in spark.createDataFrame([(k,) for k in range(16)], "k long").selectExpr("k", "xxhash64(k) h").orderBy("h").collect()]
    some = mil.fit(docs.where("doc_id < 16").select("doc_id", "text"), marks, most=700)
    lengths = {k: 120 if k % 2 == 0 else 182 for k in range(16)}
    taken, total = [], 0
    for k in order:
        if total + lengths[k] <= 700:
            taken, total = [*taken, k], total + lengths[k]
    got = {r["doc_id"]: r["quality_score"] for r in mil.predict(docs, some).collect()}
    assert [got[i] for i, _ in rows] == pytest.approx(_by_hand(rows, labels, [t for _, t in rows], taken).tolist(), abs=1e-4)


def test_quality_without_documents(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    model = mil.fit(documents(spark, []).select("doc_id", "text"), labels)
    assert mil.predict(documents(spark, []), model).count() == 0
    assert [r["quality_score"] for r in mil.predict(documents(spark, [(4, "a"), (4, "a")]), model).collect()] == [0.5, 0.5]


# --- rules ----------------------------------------------------------------------------------------


def _measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dups, len(covered)


def test_measures(spark):
    r = random.Random(4)
    rows = [*ODD, *((100 + k, "".join(r.choices(["a ", "b ", "c\n", "#", "d|e ", "\n", "\t", "é ", "  ", "A B C\n"], k=r.randint(0, 60)))) for k in range(80))]
    got = risk_rules.measured(documents(spark, rows, True)).collect()
    key = lambda x: str(x)
    mine = sorted(((x["doc_id"], x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) for x in got), key=key)
    want = [(i, *(m := _measures(t)), m[0] < 50 or 100 * m[4] > 50 * m[0]) for i, t in rows]
    assert mine == sorted(want, key=key)


def test_upper_bound_is_exact():
    for x, n, level in ((0, 10, 0.05), (3, 40, 0.01), (9, 200, 0.001)):
        p = risk_rules.upper_bound(x, n, level)
        assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1)) == pytest.approx(level, rel=1e-6)
    assert risk_rules.upper_bound(5, 5, 0.05) == 1.0
    for x, n, p in ((0, 1, 0.3), (2, 7, 0.5), (40, 100, 0.2), (90, 100, 0.95), (3, 5000, 0.001), (12, 3000, 0.0125)):
        assert risk_rules.at_most(x, n, p) == pytest.approx(sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1)), rel=1e-9)
    assert 0 < risk_rules.at_most(1_249_000, 10**8, 0.0125) < 0.5 < risk_rules.at_most(1_251_000, 10**8, 0.0125)  # as fast for many labels


def test_cutoffs_keep_their_promise():
    """Of many holdouts no more than the level's share certify a cutoff whose true rate is too high."""
    r, share, level, n = np.random.default_rng(2), 0.05, 0.1, 300
    rates = np.linspace(0.12, 0.01, 12)  # true rates of an ascending grid; the last four are within the share
    allowed = int(np.argmax(rates <= share))
    wrong = found = 0
    for _ in range(3000):
        u = r.random(n)
        k = risk_rules.certified(n, [int((u < p).sum()) for p in rates], share, level)
        wrong += k is not None and k < allowed
        found += k is not None
    assert wrong / 3000 <= level + 3 * (level * (1 - level) / 3000) ** 0.5
    assert found > 2000
    for x in range(30):
        assert (risk_rules.at_most(x, n, share) <= level) == (risk_rules.upper_bound(x, n, level) <= share)


def test_cutoffs_equal_brute_force(spark, monkeypatch):
    """Labels of copies and repeated label rows count once, a contested document not at all; strata are judged alone."""
    monkeypatch.setattr(common, "HOT_ROWS", 3)  # every stratum is a hot key
    r = random.Random(3)
    noisy = lambda k: " ".join(w + ("#" if r.random() < 0.0006 * (k % 9) else "") for w in prose(k, 60).split())
    rows = [(k, noisy(k), ("en", "de", None)[k % 3]) for k in range(1500)]
    rows += [(5000 + k, "## ".join(prose(1, 60).split()), "en") for k in range(40)]  # one text
    labels = [(k, 1, 0) for k in range(1500)] + [(k, 0, 0) for k in range(0, 90)] + [(k, 1, 0) for k in range(300, 600)] + [(5000 + k, 1, 0) for k in range(40)]
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = risk_rules.measured(docs)
    got = {x["stratum"]: x for x in risk_rules.cutoffs(found, marks, 0.2, 0.2).collect()}
    good = {i for i, *_ in rows} - set(range(90))
    texts = collections.defaultdict(set)
    for i, t, lang in rows:
        if i in good:
            texts["" if lang is None else f"={lang}"].add(t)
    assert set(got) == set(texts) == {"", "=en", "=de"}
    chosen = set()
    for name, own in texts.items():
        shares = [_measures(t)[2] / _measures(t)[0] for t in own]
        want = None
        for cut in reversed(risk_rules.GRID):
            if risk_rules.upper_bound(sum(x > cut for x in shares), len(shares), 0.2 / 12) > 0.05:
                break
            want = cut
        assert got[name]["cut_symbols"] == want
        chosen.add(want)
    assert chosen - {None}
    judged = {x["doc_id"]: x for x in risk_rules.judge(docs, marks, 0.2, 0.2).collect()}
    for i, t, lang in rows:
        m, cut = _measures(t), got["" if lang is None else f"={lang}"]["cut_symbols"]
        assert ("symbols" in judged[i]["broken_rules"]) == (cut is not None and m[2] / m[0] > cut)


def test_rules_reject_junk_and_are_off_without_proof(spark):
    good = [(k, prose(k, 70), "en") for k in range(600)]
    junk = [(1000 + k, " ".join(f"{w} ##" for w in prose(k, 60).split()), "en") for k in range(20)]
    few = [(2000 + k, " ".join(f"{w} ##" for w in prose(k, 60).split()), "de") for k in range(20)]
    docs = documents(spark, good + junk + few + [(3000, None, "en"), (3001, junk[0][1], None)], True)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(600)] + [(2000 + k, 1, 0) for k in range(5)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in risk_rules.judge(docs, labels).collect()}
    assert all(got[i]["kept"] for i, *_ in good) and not any(got[i]["kept"] for i, *_ in junk)
    assert all(got[i]["kept"] for i, *_ in few) and got[3001]["kept"] and not got[3000]["kept"]
    assert "symbols" in got[1000]["broken_rules"]
    assert risk_rules.judge(documents(spark, []), labels.limit(0)).count() == 0


# --- language model ---------------------------------------------------------------------------------


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _expected(rows, least):
    """(n_tokens, n_known, train_tokens, base, score) of each row by plain recursion."""
    seqs = [(i, ["</s>", *WORD.findall(_lower(t)), "</s>"]) for i, t in rows]
    train = [s for i, s in seqs if i is not None and remainder(i, 7) != 2]
    uni = collections.Counter(w for s in train for w in s[1:])
    n, v = sum(uni.values()), len(uni)
    bi = collections.Counter(p for s in train for p in zip(s, s[1:]))
    tri = collections.Counter(p for s in train for p in zip(s, s[1:], s[2:]))
    kept = {w for w, c in uni.items() if c >= least} | {"</s>"}
    bi = {p: c for p, c in bi.items() if c >= least and set(p) <= kept}
    tri = {p: c for p, c in tri.items() if c >= least and p[:2] in bi and p[1:] in bi}
    after, after2 = collections.defaultdict(list), collections.defaultdict(list)
    for a, b in bi:
        after[a].append(b)
    for a, b, c in tri:
        after2[a, b].append(c)

    def p1(w):
        return (uni.get(w, 0) + 1) / (n + v + 1)

    @cache
    def p2(w, a):
        if (a, w) in bi:
            return (bi[a, w] - 0.5) / uni[a]
        left = (1 - sum((bi[a, x] - 0.5) / uni[a] for x in after[a])) / (1 - sum(p1(x) for x in after[a])) if after[a] else 1
        return left * p1(w)

    @cache
    def p3(w, a, b):
        if (a, b, w) in tri:
            return (tri[a, b, w] - 0.5) / bi[a, b]
        own = after2[a, b]
        left = (1 - sum((tri[a, b, x] - 0.5) / bi[a, b] for x in own)) / (1 - sum(p2(x, b) for x in own)) if own else 1
        return left * p2(w, b)

    out = []
    for i, s in seqs:
        score = math.log10(p2(s[1], s[0])) + sum(math.log10(p3(s[k], s[k - 2], s[k - 1])) for k in range(2, len(s)))
        out.append((i, len(s) - 1, sum(uni[w] > 0 for w in s[1:]), n, sum(math.log10(p1(w)) for w in s[1:]), score))
    return out, p3, kept | {"never"}, uni, n + v + 1


def test_automaton_equals_plain_recursion(spark):
    words = "the of and to in cat dog house tree river".split()
    r = random.Random(9)
    rows = [(k, " ".join(r.choices(words, weights=[9, 7, 6, 5, 4, 3, 2, 2, 1, 1], k=r.randint(0, 60)) + r.choices(["Rare%d" % r.randrange(40)], k=1))) for k in range(120)]
    rows += [*ODD, (7000, "The CAT é É")]
    want, p3, vocabulary, uni, scale = _expected(rows, max(2, 0))
    got = sorted(((x["doc_id"], x["n_tokens"], x["n_known"], x["train_tokens"], x["base_score"], x["score"]) for x in ngram_lm.score(documents(spark, rows, True), batch_bytes=2000, range_words=40).collect()), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], abs=1e-9)
    # after any context the probabilities of all words and of an unseen one add up to one
    everything = [*uni, "never"]
    for context in (("the", "of"), ("</s>", "the"), ("cat", "the"), ("rare1", "cat")):
        assert sum(p3(w, *context) for w in everything) == pytest.approx(1)


def test_scores_of_empty_tables(spark):
    assert ngram_lm.score(documents(spark, [])).count() == 0
    held = next(k for k in range(100) if remainder(k, 7) == 2)
    only = ngram_lm.score(documents(spark, [(held, "all held out")])).collect()[0]
    assert (only["n_tokens"], only["n_known"], only["train_tokens"], only["base_score"], only["score"]) == (4, 0, 0, 0.0, 0.0)


def test_kept_ngrams_do_not_depend_on_the_size_of_the_corpus(spark):
    """A pair and a triple seen a few times count however many other words there are."""
    learnt = [k for k in range(20) if remainder(k, 7) != 2][:2]
    rows = [(k, "red blue green") for k in learnt] + [(100 + k, " ".join(f"w{k}x{j}" for j in range(9000))) for k in range(80)]
    assert sum(len(t.split()) for i, t in rows if remainder(i, 7) != 2) > 2 * 2**18
    want, *_ = _expected(rows, 2)
    got = {x["doc_id"]: x["score"] for x in ngram_lm.score(documents(spark, rows)).collect()}
    assert all(got[i] == pytest.approx(score, abs=1e-6) for i, *_, score in want)
