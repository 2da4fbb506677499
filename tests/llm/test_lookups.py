"""URL rules, licence digests, decontamination and the pipeline."""

import hashlib
import random
import textwrap

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from sieveline.llm import bagminhash, common, decontam, langfilter, licenses, mil, queries, urlfilter

from .helpers import ODD, documents, prose
from .test_dedup import _classes
from .test_tokens import WORD, _ids


def _pages(spark, urls, extra=False):
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    return df.withColumns({n: F.lit("x") for n in ("host", "path", "rule", "canon", "hit", "verdict")}) if extra else df


def _judged(df):
    return sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()), key=str)


URLS = [
    "http://a.net/x", "https://example.net/en/1?q=2", "HTTP://WWW.Example.NET/en", "http://example.com/de/3#x", "http://b.example.com/DE/3", "http://c.org/fr/", "http://c.org/fr?x", "http://notnet/x",
    "http://net", "net/abc", None, "", "http://x.org/a/?utm_source=f&ref=z&id=3", "https://www.x.org/a?id=3", "http://x.org:80/a/?id=3#t", "http://m.x.org/a?id=4", "http://x.org/b", "x://y://z/w?a://b", "http://x.org/\nnew/line", "http://é.org/fr/é",
]


@pytest.mark.parametrize("extra", [False, True])
def test_url_verdicts(spark, extra):
    got = _judged(urlfilter.judge(_pages(spark, URLS, extra), spark.createDataFrame([("http://x.org/a?id=3",), (None,), ("junk",)], "url string")))
    by_url = {URLS[r[0]]: r[1:] for r in got}
    assert by_url["http://a.net/x"] == ("a.net", "/x", "net/", "block")
    assert by_url["https://example.net/en/1?q=2"] == ("example.net", "/en/1", "example.net/en/", "allow")
    assert by_url["HTTP://WWW.Example.NET/en"] == ("www.example.net", "/en", "net/", "block")
    assert by_url["http://example.com/de/3#x"][2:] == ("example.com/de/", "block")
    assert by_url["http://b.example.com/DE/3"][2:] == (None, "allow")
    assert by_url["http://c.org/fr/"][2:] == ("org/fr/", "allow") and by_url["http://c.org/fr?x"][2:] == (None, "allow")
    assert by_url["http://notnet/x"][2] is None and by_url["http://net"] == ("net", "", None, "allow")
    assert by_url[None] == ("", "", None, "allow") == by_url["net/abc"]
    assert [by_url[URLS[k]][3] for k in (12, 13, 14, 15, 16)] == ["block", "block", "block", "allow", "allow"]
    assert by_url["x://y://z/w?a://b"][:2] == ("y:", "//z/w")


def test_false_positives_of_the_filter_go(spark):
    urls = [f"http://h{k}.org/p" for k in range(300)]
    listed = spark.createDataFrame([(u,) for u in urls[:100]], "url string")
    pages = _pages(spark, urls)
    ruled = pages.select(F.lit(None).cast("string").alias("verdict"), F.expr(urlfilter.canonical()).alias("canon"))
    passed = lambda f: {r["canon"] for r in urlfilter._marked(ruled, f).where("maybe").collect()}
    assert len(passed(np.full((1, urlfilter.WORDS), -1))) == 300  # a filter that lets everything pass
    tight = passed(urlfilter.build_filter(listed.select(F.expr(urlfilter.canonical()).alias("canon"))))
    assert {f"h{k}.org/p" for k in range(100)} <= tight and len(tight) < 140
    assert sum(v[4] == "block" for v in _judged(urlfilter.judge(pages, listed, max_blocks=1))) == 100
    assert not any(v[4] == "block" for v in _judged(urlfilter.judge(pages, listed.limit(0))))
    assert urlfilter.judge(pages.limit(0), listed).count() == 0


def test_a_url_of_many_pages_and_a_very_long_one(spark):
    long = "http://h.org/" + "a" * 200_000
    urls = ["http://x.org/a"] * 300 + [long, long + "b", None, None] + ["http://y.org/?q=1"] * 90
    got = _judged(urlfilter.judge(_pages(spark, urls), spark.createDataFrame([("http://x.org/a",), (long,), ("http://x.org/a",)], "url string")))
    assert [v[4] for v in sorted(got)] == ["block"] * 301 + ["allow"] * 93


def _oracle(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    e = con.sql(sql)
    return e.columns, e.fetchall()


def test_url_oracle(spark, tmp_path):
    pages = _pages(spark, [u for u in URLS for _ in range(13)])
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    columns, rows = _oracle(urlfilter.ORACLE, pages=pages)
    at = [columns.index(c) for c in ("page_id", "host", "path", "rule", "verdict")]
    assert _judged(queries.op8_url_filter(spark, str(tmp_path))) == sorted((tuple(r[k] for k in at) for r in rows), key=str)


@pytest.mark.parametrize("extra", [False, True])
def test_licences(spark, extra):
    text = dict(licenses.KNOWN)
    mit, isc = licenses._MIT_BODY, licenses._ISC_BODY
    rows = [*ODD, (50, isc), (51, "Copyright (c) 2020 A. Person\n\n" + isc.upper().replace(",", " ;")), (52, "some text\nreleased under the MIT LICENCE\nmore"), (53, licenses._UNLICENSE + " x"), (54, "Licensed under CC BY 4.0.\nReleased under the MIT License.\nreleased under the mit license"), (55, "// SPDX-License-Identifier: MIT\nint x;")]
    rows += [(5, mit), (5, mit), (5, "Released under the MIT License."), (None, isc), (None, None), (56, "a" * 300_000 + "\nReleased under the MIT License.")]
    docs = documents(spark, rows, extra)
    got = [(r["doc_id"], r["digest"], r["license_id"], r["notices"]) for r in licenses.scan(docs).collect()]
    by_id = {r[0]: r[1:] for r in got if r[0] not in (None, 5)}
    assert [by_id[k][1] for k in (50, 51, 52, 53)] == ["ISC", "ISC", None, None]
    assert [by_id[k][2] for k in (52, 54, 55, 56)] == ["MIT", "CC-BY-4.0;MIT", "MIT", "MIT"]
    assert by_id[1] == (None, None, None) and by_id[2][0] == hashlib.sha256(b"").hexdigest()
    assert sorted(str(r[2]) for r in got if r[0] == 5) == ["MIT", "MIT", "MIT", "None", "None"] and sorted(str(r[2]) for r in got if r[0] is None) == ["ISC", "None", "None"]
    columns, want = _oracle(licenses.ORACLE, documents=docs.select("doc_id", "text"))
    at = [columns.index(c) for c in ("doc_id", "digest", "license_id", "notices")]
    assert sorted((tuple(r[k] for k in at) for r in want), key=str) == sorted(got, key=str)
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan and "NestedLoop" not in plan
    assert licenses.scan(documents(spark, [])).count() == 0 and text["GPL-3.0"]


def test_wrapped_licences(spark):
    wrap = lambda text, width: "\n".join(textwrap.fill(x, width, break_on_hyphens=False) for x in text.split("\n"))
    isc, bsd, mit = licenses._ISC_BODY, licenses._BSD_HEAD + licenses._BSD_TAIL, licenses._MIT_BODY
    isc_lines = isc.replace("above copyright", "above\ncopyright").replace("copies.\nTHE", "copies.\n\nTHE")
    assert "\ncopyright notice and this permission notice appear in all copies.\n" in isc_lines
    texts = [(10, "ISC", isc_lines), (11, "ISC", "Copyright (c) 2020, A. Person\n\n" + isc_lines), (12, "BSD-2-Clause", "Copyright (c) 2020, A. Person\nAll rights reserved.\n\n" + wrap(bsd, 79)), (13, "BSD-2-Clause", "All rights reserved.\nCopyright 1999 A. Person\n" + bsd.replace("COPYRIGHT HOLDER OR", "COPYRIGHT\nOWNER OR")), (14, None, isc_lines.replace("copyright notice and this permission notice appear in all copies.", ""))]
    texts += [(15, "MIT", "Copyright Jane Q. Doe\n" + mit), (16, "MIT", "Copyright by Jane Doe, 2020-2024.\n" + mit), (17, "MIT", mit.replace("sublicense", "sub-licence").replace("AUTHORS OR COPYRIGHT", "AUTHORS OR\nCOPYRIGHT")), (18, None, "Copyright Notice\n" + mit)]
    for k, mark in enumerate(("# ", " * ", "// ", "-- ", "; ")):
        texts.append((20 + k, "MIT", "\n".join(mark + x for x in ("MIT License\n\nCopyright (c) 2024 A. Person\n\n" + wrap(mit, 70)).split("\n"))))
    texts += [(100 + k, "MIT", "MIT License\n\nCopyright (c) <year> <holder>\n\n" + wrap(mit, 40 + k)) for k in range(40)]
    whole = [("ISC", isc), ("BSD-2-Clause", bsd), ("Zlib", licenses._ZLIB_BODY), ("Unlicense", licenses._UNLICENSE), ("BSL-1.0", licenses._BOOST)]
    texts += [(200 + k, name, wrap(body, 40 + 7 * k)) for k in range(8) for name, body in whole]
    # paragraphs of the long texts filled anew, but for those with lines that state a copyright
    fill = lambda x, width: x if "opyright (C)" in x or "opyright [" in x else textwrap.fill(" ".join(x.split()), width, break_on_hyphens=False)
    texts += [(250 + k, i, "\n\n".join(fill(x, 45 + 9 * k) for x in t.split("\n\n"))) for k in range(5) for i, t in licenses._stored()]
    texts += [(300, i, t) for i, t in licenses._stored()]
    got = sorted((r["doc_id"], str(r["license_id"])) for r in licenses.scan(documents(spark, [(i, t) for i, _, t in texts])).collect())
    assert got == sorted((i, str(n)) for i, n, _ in texts)


ITEM = "A train leaves Lyon at 9 and travels 120 km to the city where Anna waits for 3 hours before the second train arrives"


@pytest.mark.parametrize("extra", [False, True])
def test_decontamination(spark, extra):
    moved = ITEM.replace("120", "95").replace("Lyon", "Bern").replace("Anna", "Carla").replace("9 and", "seven and").replace("km", "miles")
    broken = "Train leaves Lyon at 9 and it is a long way to go. " * 3
    mixed = "He drove 5 km then 5 km then 5 km and 5 km more until the long road ended there"
    swapped = mixed.replace("5", "8", 1).replace("5", "9", 1)
    rows = [*ODD, (20, f"{prose(1, 30)} {ITEM}. {prose(2, 30)}"), (21, f"{prose(3, 9)}. {moved}!"), (22, broken), (23, prose(4, 200)), (24, f"{prose(5, 9)} {mixed}"), (25, f"{prose(6, 9)} {swapped}"), (26, ITEM.lower().replace(" ", "\n"))]
    benchmark = spark.createDataFrame([(1, ITEM), (2, mixed), (3, None), (None, ITEM), (4, "too short"), (5, ""), (6, ITEM)], "item_id long, text string")
    docs = documents(spark, rows, extra)
    for block in (1 << 20, 60):  # one block, and a pass for each of several
        got = {r["doc_id"]: r for r in decontam.search(docs, benchmark, block_bytes=block).collect()}
        assert len(got) == len({i for i, _ in rows})
        assert got[20]["item_ids"] == [1, 6] and got[20]["changed_ids"] == []
        assert got[21]["item_ids"] == [1, 6] == got[21]["changed_ids"]
        assert got[24]["item_ids"] == [2] and got[25]["item_ids"] == []  # one value can't become two
        assert got[26]["contaminated"]
        assert not any(got[i]["contaminated"] for i in (None, 1, 2, 3, 4, 5, 6, 8, 22, 23))
        clean = decontam.cleaned(docs, benchmark, block_bytes=block)
        assert clean.columns == docs.columns
        assert sorted((r["doc_id"] for r in clean.select("doc_id").collect()), key=str) == sorted((i for i, _ in rows if i not in (20, 21, 24, 26)), key=str)
    assert decontam.search(documents(spark, []), benchmark).count() == 0
    assert not any(r["contaminated"] for r in decontam.search(docs, benchmark.limit(0)).collect())


def test_one_inconsistent_slot_drops_its_own_windows_only():
    words = prose(1, 48).split()
    near = " ".join([*words[:10], "5", *words[10:40], "5", *words[40:]])
    some = "Fill the tank with 3 buckets of water and 5 buckets of milk before you leave for school"
    place = " ".join([*words[:10], "Lyon", *words[10:40], "Lyon", *words[40:]])
    bench = decontam.Benchmark([1, 2, 3], [near, some, place])
    changed = near[: near.rindex("5")] + "7" + near[near.rindex("5") + 1 :]
    moved = place[: place.rindex("Lyon")] + "Bern" + place[place.rindex("Lyon") + 4 :]
    texts = [changed, some.replace("3", "4").replace("5", "4"), some.replace("3", "5"), moved]
    assert decontam.findings(pa.array(texts), bench) == ([[1], [2], [2], [3]], [[], [2], [2], []])


def test_items_dense_in_slots_short_items_and_items_without_id(spark):
    sums, order, short = "What is 48 + 17 x 6 - 92 / 4", "Sort the numbers 41 7 93 12 58 26 77 in ascending order", "Name 3 prime factors"
    bench = decontam.Benchmark([1, 2, 3, 4, 5], [sums, order, short, "", "yes"])
    texts = [
        f"{prose(1, 9)} what is 31 + 25 x 8 - 60 / 5", f"{prose(2, 9)} sort the numbers 5 66 31 80 9 2 14 in ascending order {prose(3, 9)}", f"{prose(4, 9)} name 7 prime factors {prose(5, 9)}", "Yes.", f"{prose(6, 9)} yes",
        "what is 31 + 25 x", "1 2 3 4 5 6 7 8 9", "sort the numbers in ascending order", "prime factors",
    ]
    found, changed = decontam.findings(pa.array(texts), bench)
    assert found == [[1], [2], [3], [5], [], [], [], [], []] and changed == [[1], [2], [3], [], [], [], [], [], []]
    docs = documents(spark, list(enumerate(texts)))
    benchmark = spark.createDataFrame([(None, sums), (2, order), (None, order), (7, short)], "item_id long, text string")
    for block in (1 << 20, 60):
        got = {r["doc_id"]: (r["contaminated"], r["item_ids"]) for r in decontam.search(docs, benchmark, block_bytes=block).collect()}
        assert [got[k] for k in range(4)] == [(True, []), (True, [2]), (True, [7]), (False, [])]
        assert sorted(r["doc_id"] for r in decontam.cleaned(docs, benchmark, block_bytes=block).collect()) == [3, 4, 5, 6, 7, 8]


def test_plain_windows_equal_brute_force():
    items = [prose(k, 20 + k) for k in range(8)]
    texts = [f"{prose(100 + k, 15)} {' '.join(items[k % 8].split()[: 8 + 3 * k])} {prose(200 + k, 15)}" for k in range(12)]
    bench = decontam.Benchmark(list(range(8)), items)
    found, _ = decontam.findings(pa.array(texts), bench)
    for text, got in zip(texts, found, strict=True):
        w = text.split()
        own = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        want = []
        for i, item in enumerate(items):
            x = item.split()
            windows = [tuple(x[j : j + 5]) for j in range(len(x) - 4)]
            if sum(v in own for v in windows) >= 0.8 * len(windows):
                want.append(i)
        assert sorted(got) == want


NUMBER_WORDS, UNIT_WORDS = decontam.NUMBERS, decontam.UNITS


def _template_words(text):
    """Of each word with a letter or digit: what it is without its edge (lower-cased), its kind, whether it is a name, by plain rules."""
    out, before = [], True
    for raw in text.split():
        core = regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", raw)
        closing = regex.search(r"[.!?:;|]\P{L}*$", raw) is not None
        if core:
            low = core.lower()
            kind = "number" if low in NUMBER_WORDS or regex.fullmatch(r"\p{N}[\p{N}.,:/-]*(st|nd|rd|th|%)?", core) else "unit" if low in UNIT_WORDS else None
            out.append((low, kind, kind is None and regex.match(r"\p{Lu}\p{Ll}", core) is not None and not before))
            before = closing
    return out


def _leaked(text, item, similarity=0.8):
    """Whether a document holds an item, its slots consistently replaced, by comparing every place with every place."""
    d, b = _template_words(text), _template_words(item)
    if not b or len(b) == 1:
        return len(b) == 1 and [w for w, _, _ in d] == [b[0][0]]
    size = min(len(b), 5)
    forms = [lambda w: w[1] or w[0], lambda w: w[1] or ("name" if w[2] else w[0]), lambda w: w[0]]
    slotted = [lambda w: w[1] is not None, lambda w: w[1] is not None or w[2]]
    n, covered = len(b) - size + 1, set()
    keyed = lambda f, words: tuple(f(w) if f(w) != w[0] else ("", w[0]) for w in words)

    def finds(p):
        return all(sum(not s(w) for w in b[p : p + size]) >= 2 for s in slotted)

    for shift in range(-len(b), len(d) + 1):
        equal = {}
        for p in range(n):
            i = p + shift
            if 0 <= i and i + size <= len(d):
                same = [keyed(f, d[i : i + size]) == keyed(f, b[p : p + size]) for f in forms]
                ok = [sum(not s(w) for w in d[i : i + size]) >= 2 and sum(not s(w) for w in b[p : p + size]) >= 2 for s in slotted] + [True]
                if any(x and y for x, y in zip(same, ok, strict=True)):
                    equal[p] = same[2]
        if not equal:
            continue
        for p in range(n):
            i = p + shift
            if p not in equal and not finds(p) and 0 <= i and i + size <= len(d) and any(keyed(f, d[i : i + size]) == keyed(f, b[p : p + size]) for f in forms):
                equal[p] = False
        places = sorted({p + k for p in equal for k in range(size)})
        slots = {p: (b[p][0], d[p + shift][0], b[p][1] == "number") for p in places if b[p][1] or b[p][2] or b[p][0] != d[p + shift][0]}
        best = {}
        for a in {a for a, _, _ in slots.values()}:
            votes = [y for x, y, _ in slots.values() if x == a]
            best[a] = max(dict.fromkeys(votes), key=lambda y: (votes.count(y), y == a))
        back = {}
        for y in {y for x, y, number in slots.values() if not number and best[x] == y}:
            votes = [x for x, z, number in slots.values() if z == y and not number and best[x] == z]
            back[y] = max(dict.fromkeys(votes), key=lambda x: (votes.count(x), x == y))
        broken = {p for p, (x, y, number) in slots.items() if best[x] != y or not (number or back[y] == x)}
        covered |= {p for p, exact in equal.items() if exact or broken.isdisjoint(range(p, p + size))}
    return len(covered) >= similarity * n


def test_templates_names_and_slots_equal_brute_force(spark):
    """Random questions, their parameters replaced consistently or not, cut short, renamed or mixed up."""
    r = random.Random(8)
    names, units, plain = ["Anna", "Lyon", "Bern", "Carla", "Oslo"], ["km", "miles", "hours", "kg"], "train leaves city travels with apples sells buys reaches finds how many does left then slowly".split()

    def question():
        return [r.choice([r.choice(plain), r.choice(plain), r.choice(plain), str(r.randrange(2, 99)), r.choice(names), r.choice(units), r.choice(["seven", "nine"])]) for _ in range(r.randrange(2, 22))]

    items = [question() for _ in range(14)]
    texts = []
    for words in items * 9:
        w, how = list(words), r.randrange(5)
        if how in (1, 3):
            to = {x: str(r.randrange(2, 99)) if x.isdigit() else r.choice(names) if x in names else r.choice(units) if x in units else x for x in set(w)}
            w = [to[x] for x in w]
        if how in (2, 3):
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(len(w))] = r.choice([*names, *units, *plain, "5", "61"])
        if how == 4:
            w = w[r.randrange(3) :][: r.randrange(1, 30)]
        if r.random() < 0.3:
            w = [x + r.choice(["", "", ".", ",", "?"]) for x in w]
        texts.append(" ".join([*(r.choice(plain) for _ in range(r.randrange(4))), *w, *(r.choice(plain) for _ in range(r.randrange(4)))]))
    ids = list(range(len(items)))
    want = {k: [i for i in ids if _leaked(t, " ".join(items[i]))] for k, t in enumerate(texts)}
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in zip(ids, items, strict=True)], "item_id long, text string")
    found = {x["doc_id"]: x["item_ids"] for x in decontam.search(documents(spark, list(enumerate(texts))), benchmark).collect()}
    assert found == want
    assert 30 < sum(map(bool, want.values())) < len(texts)


def test_pipeline_equals_its_operators_one_after_the_other(spark, tmp_path):
    languages = {"en": "the of and cat dog".split(), "fr": "éau tre çon les des".split()}
    text = lambda k, lang: prose(k, 80, languages[lang])
    rows = [(k, text(k, lang := ("en", "fr")[k % 2]), lang) for k in range(60)]
    rows += [(100 + k, " ".join(f"{w}###" for w in text(k, "en").split()), "en") for k in range(40)]
    rows += [(200 + k, rows[k][1], "en") for k in range(5)] + [(210, None, "en"), (211, "1234", "en"), (None, text(70, "en"), "en"), (212, f"{text(71, 'en')} {prose(9, 20)}", "en")]
    docs = documents(spark, rows, True)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(100 + k, 0, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(9, 20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "near_dedup", "decontamination", "bpe"]
    kept, left = docs, dict((i, t) for i, t, _ in rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, common.table(stage(spark, kept, str(tmp_path)), name)
        assert kept.columns == docs.columns
        now = {r["doc_id"] for r in kept.collect()}
        if name == "language_id":
            gone = {210, 211}
        elif name == "quality_classifier":
            gone = {100 + k for k in range(40)}
        elif name == "near_dedup":
            gone = {i for i, c in _classes([(i, t) for i, t in left.items()]).items() if i != c}
        else:
            gone = {212}
        left = {i: t for i, t in left.items() if i not in gone}
        assert now == set(left), name
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: (len(x := _ids(WORD, t)), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, t in left.items()}


def test_each_query_is_registered_once():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [n for n in names if n.startswith("op")] == [f.__name__ for f in queries.QUERIES] and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert (langfilter.UND, bagminhash.SIMILARITY, mil.THRESHOLD) == ("und", 0.8, 0.3)
