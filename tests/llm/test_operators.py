"""Operators against brute force, on hard cases: nulls, empty and long texts, ties, repeated rows, extra columns."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("graphloom.llm")

from graphloom.llm import bpe, decontaminate, hmm, html_blocks, jaccard, licenses, page_text, quality_rules, queries, token_counts, url_rules, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, quality string"
WORDS = [f"w{k}" for k in range(400)]


def texts(seed=3, n=60):
    rng = random.Random(seed)
    out = [None, "", " \t\n ", "one", "one two", "a b c d e f g h i j k l", "é É ß Ünï code", "x" * 3000, "all rights reserved " * 3, "it's 12 o'clock <|endoftext|> now", "under the MIT license and under the mit License", "Apache License, Version 2.0; CC-BY-NC"]
    base = [rng.choices(WORDS, k=rng.randint(20, 80)) for _ in range(n // 3)]
    for b in base:
        out.append(" ".join(b))
        near = list(b)
        near[rng.randrange(len(near))] = "changed"
        out += [" ".join(near).upper(), " ".join(b + ["tail"]) + "\nCommon Line here"]
    out += [out[20], out[20], " ".join(rng.choices(WORDS, k=30_000))]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s0" if k % 3 else None, 1, "clash", "clash") for k, t in enumerate(texts())]
    rows += [(None, "null id text of some words here to see", None, None, None, None, None), rows[15], rows[15]]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t, pattern=rb"[^\x20\x09-\x0D]+"):
    low = (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    return re.findall(pattern, low)


LICENCE_WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def test_bpe_is_the_library(docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = bpe.digests(docs, path).collect()
    asked = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        asked[r["doc_id"], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, got)) == asked
    assert bpe.digests(empty, path).count() == 0


def test_token_counts_are_the_library(docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    asked = Counter()
    for r in docs.select("doc_id", "text").collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        asked[r["doc_id"], len((r["text"] or "").encode()), n, n > 2048] += 1
    assert Counter(map(tuple, token_counts.counts(docs, path).collect())) == asked
    assert token_counts.counts(empty, path).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_bpe_on_random_text(name):
    import numpy as np
    from tokenizers import Tokenizer

    path = queries.tokenizer(name)
    library, rng = Tokenizer.from_file(path), random.Random(5)
    letters = [chr(c) for c in (*range(32, 127), 9, 10, 13, 0x1C, 0x85, 0xA0, 0xB2, 0xBD, 0xD7, 0xE9, 0x130, 0x301, 0x3A3, 0x661, 0x2028, 0x2160, 0x4E2D, 0x1F600)]
    some = ["".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(800)] + ["a" * 4000, "ab" * 2000, "<|endoftext|> x<|startoftext|>y"]
    for t, b in zip(some, bpe.encode_all(some, path), strict=True):
        assert np.frombuffer(b, dtype="<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_one_piece_and_many_agree():
    table = bpe.vocabulary(queries.tokenizer("byte_bpe_50k.json"))
    rng = random.Random(1)
    some = ["".join(rng.choices("abcdeth in", k=rng.randint(1, 40))) for _ in range(300)]
    assert [x.tolist() for x in table.encode_pieces(some)] == [table._one(p.encode()) for p in some]


def test_jaccard_components(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    for width, num in ((3, 90), (5, 80)):
        sets = []
        for _, t in rows:
            w = words(t)
            sets.append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
        lead = list(range(len(rows)))

        def root(x, lead=lead):
            while lead[x] != x:
                x = lead[x]
            return x

        for a in range(len(rows)):
            for b in range(a):
                k = len(sets[a] & sets[b])
                if k and 100 * k >= num * (len(sets[a]) + len(sets[b]) - k):
                    lead[root(a)] = root(b)
        least = {}
        for k, (i, _) in enumerate(rows):
            if i is not None:
                least[root(k)] = min(least.get(root(k), i), i)
        asked = Counter((i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))
        assert Counter(map(tuple, jaccard.components(docs, width, num, 100).collect())) == asked
    assert jaccard.components(empty).count() == 0


def test_jaccard_rounds_lose_no_link(spark, monkeypatch):
    """A posting list of many sets that mostly do not link: centres by rounds, and all pairs at the end, agree."""
    rng = random.Random(2)
    base = rng.choices(WORDS, k=40)
    rows = []
    for k in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(30)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few = Counter(map(tuple, jaccard.components(df, 2, 70, 100).collect()))
    monkeypatch.setattr(jaccard, "FEW", 0)
    monkeypatch.setattr(jaccard, "CENTRES", 20)
    assert Counter(map(tuple, jaccard.components(df, 2, 70, 100).collect())) == few
    assert len({c for _, _, c in few}) < 80


def test_jaccard_links_a_set_inside_one_of_one_more(spark):
    """At the boundary: 9 shingles inside 10 with 90 / 100, 4 inside 5 with 80 / 100; one less on both sides does not link."""
    for width, num, n in ((3, 90, 9), (5, 80, 4)):
        rows = []
        for size in (n, n - 1):
            for _ in range(12):
                w = [f"b{len(rows)}x{j}" for j in range(size + width)]
                rows += [" ".join(w[:-1]), " ".join(w if len(rows) % 4 else ["more", *w[:-1]])]
        sets = [frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) for w in (t.split() for t in rows)]
        assert {len(x) for x in sets} == {n - 1, n, n + 1}
        alike = lambda a, b, num=num: 100 * len(a & b) >= num * len(a | b)
        asked = {k: min(j for j, y in enumerate(sets) if alike(x, y)) for k, x in enumerate(sets)}
        df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        assert {r["doc_id"]: r["component_id"] for r in jaccard.components(df, width, num, 100).collect()} == asked
        assert len(set(asked.values())) == 36


def test_one_of_each_keeps_all_columns(docs, empty):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    got = Counter(r["doc_id"] for r in kept.collect())
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.components(docs, 5, 80, 100).collect()}
    assert set(got) == {i for i, c in groups.items() if i is None or i == c}
    assert max(got.values()) == 1
    assert jaccard.one_of_each(empty).count() == 0


def test_decontamination(spark, docs, empty):
    items = [(1, "w1 w2"), (2, None), (3, "..."), (4, " ".join(texts()[12].split()[2:18])), (4, "One"), (None, "o'clock"), (12, "MIT license, and under")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = words(t, LICENCE_WORD)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add("" if i is None else str(i))
    asked = Counter()
    for i, t in docs.select("doc_id", "text").collect():
        w = words(t, LICENCE_WORD)
        hit, found = set(), set()
        for win, names in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= names
        asked[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    assert Counter(map(tuple, decontaminate.report(docs, bench).collect())) == asked
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns
    assert decontaminate.report(empty, bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_by_blocks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(k, " ".join(texts()[12 + k].split()[:15])) for k in range(0, 9, 3)], "item_id long, text string")
    whole = Counter(map(tuple, decontaminate.report(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "NODES", 2 * 13 * 20)
    assert len(list(decontaminate._blocks(bench, "item_id", "text", 13))) == 3
    assert Counter(map(tuple, decontaminate.report(docs, bench).collect())) == whole


def test_spans_map_to_the_original():
    machine = decontaminate.Machine([(1, "big Cat")])
    text = "Ünï a BIG,  cat. é big cat"
    _, spans, _ = machine.scan(text)
    assert [text[a:b] for a, b in decontaminate.char_spans(text, spans)] == ["BIG,  cat", "big cat"]


def quality_brute(t):
    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, docs, empty):
    asked = Counter((i, *quality_brute(t)) for i, t in docs.select("doc_id", "text").collect())
    got = quality_rules.report(docs).collect()
    assert Counter(tuple(r)[:6] for r in got) == asked
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    judged = quality_rules.judge(docs)
    assert judged.columns == [c for c in docs.columns if c != "quality"] + ["quality"]
    assert quality_rules.report(empty).count() == 0
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_frequent_lines_deplete(spark):
    """A line of many texts of a host goes; a document of little else is rejected, but not on another host. Copies count once."""
    rows = [(k, f"{' '.join(WORDS[k : k + 12])}\nShare  this PAGE with all your very good friends", "h") for k in range(30)]
    rows += [(100, "share this page with all your very good friends\nshort one", "h"), (101, "share this page with all your very good friends\nshort one", "i")]
    rows += [(200 + k, "a line of ten words that only copies of it have", "h") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules.report(df).collect()}
    assert not got[100]["kept"] and not got[100]["base_failed"] and got[100]["removed_words"] == 9
    assert got[101]["kept"] and got[101]["removed_words"] == 0
    assert all(got[k]["kept"] and got[k]["removed_words"] == 9 for k in range(30))
    assert all(got[200 + k]["kept"] for k in range(40))


def test_licences(docs, empty):
    asked = Counter()
    for i, t in docs.select("doc_id", "text").collect():
        w = [x.decode() for x in words(t, LICENCE_WORD)]
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            here = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += here
            labels |= {label} if here else set()
        asked[i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))] += 1
    got = licenses.report(docs).collect()
    assert Counter(tuple(r)[:6] for r in got) == asked
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.report(empty).count() == 0


def test_licence_templates_by_the_index(spark):
    """Against all templates at all places, for files whose rare words find them."""
    text = [t for _, t, _ in licenses.TEMPLATES]
    rows = [(k, "some words before, " + t.title() + ". and after") for k, t in enumerate(text)]
    rows += [(100, "redistribution and use in source"), (101, "permission is granted free of any charge to a person"), (102, " ".join(WORDS)), *((200 + k, " ".join(WORDS[k : k + 20])) for k in range(150))]
    got = {r["doc_id"]: r for r in licenses.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[k]["labels"].split(","), label
        assert got[k]["score"] == 1.0
    assert got[100]["labels"] == got[101]["labels"] == got[102]["labels"] == ""
    assert 0 < got[100]["score"] < 1


def licence_labels(text):
    """Of all templates whose mandatory phrases stand in their places anywhere, and of the base phrases."""
    w, out = re.findall("[a-z0-9]+", text.lower()), set()
    for label, body, phrases in licenses.TEMPLATES:
        b = body.split()
        at = [(next(k for k in range(len(b)) if b[k : k + len(p.split())] == p.split()), p.split()) for p in phrases]
        if any(all(o + k >= 0 and w[o + k : o + k + len(p)] == p for k, p in at) for o in range(-len(b), len(w))):
            out.add(label)
    return out | {label for phrase, label in licenses.BASE.items() if f" {phrase} " in f" {' '.join(w)} "}


def test_licences_of_a_file_with_several(spark):
    """No licence takes another's place: all pairs of templates, all of them in one file, and a licence in most of the files."""
    text = [t for _, t, _ in licenses.TEMPLATES]
    some = [f"{a}. x y z {b}" for a in text for b in text] + [" q ".join(text), "All rights reserved. " + text[0], text[0] + " all rights reserved"]
    some += ["a text, all rights reserved"] * 600 + ["Licensed under the MIT License. See the file", "code, by the MIT license"] * 300
    got = {r["doc_id"]: r["labels"] for r in licenses.report(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")).collect()}
    for k, t in enumerate(some):
        assert set(filter(None, got[k].split(","))) == licence_labels(t), t


def test_licences_that_are_alike(spark):
    some = ["permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this", "Licensed under the GNU Affero General Public License v3.0", "SPDX-License-Identifier: GPL-2.0-only", "Licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"]
    rows = [*enumerate(some), *((100 + k, " ".join(WORDS[k : k + 20])) for k in range(100))]
    got = {r["doc_id"]: r["labels"] for r in licenses.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(5)] == ["bsl-1", "mit", "agpl-3", "gpl-2", "cc-by-nc-sa"]


def test_licences_name_a_gpl_version(spark):
    """The short form, as the given tables have it, beside a form without a version."""
    some = ["it is licensed under the GNU General Public License, version 3.", "GNU General Public License version 2 applies", "licensed under the GNU General Public License."]
    rows = [*enumerate(some), *((100 + k, " ".join(WORDS[k : k + 20])) for k in range(150))]
    got = {r["doc_id"]: r["labels"] for r in licenses.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(3)] == ["gpl-3", "gpl-2", ""]


def test_url_rules(spark):
    urls = ["http://A.example.com/en/7x?q#f", "https://x.COM/en/", "x.com/en/", None, "ftp://com", "http://example.net/de/8", "http://b.example.net/de/9", "http://org/es/#/", "http://notorg/es/", "http://a.org?x=/es/", "https://bad.site.info/p/1", "https://good.site.info/p/1", "https://q.info/1?track=5"]
    rows = [(k, u) for k, u in enumerate(urls)] + [(None, urls[0]), (0, urls[0])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumnRenamed("page_id", "page_id")
    labelled = [("https://bad.site.info/p/%d" % k, True) for k in range(30)] + [("https://good.site.info/p/%d" % k, False) for k in range(90)] + [("https://z.info/?track=%d" % k, k % 4 > 0) for k in range(40)] + [(None, True), ("https://bad.site.info/", None)]
    train = spark.createDataFrame(labelled, "url string, block boolean")
    got = {r["page_id"]: r["filter"] for r in url_rules.judge(pages, train).collect()}
    want = {0: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 1: ("x.com", "/en/", "com/en/", "block"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("com", "", None, "allow"), 5: ("example.net", "/de/8", "example.net/de/8", "block"), 6: ("b.example.net", "/de/9", "net/de/", "allow"), 7: ("org", "/es/", "org/es/", "block"), 8: ("notorg", "/es/", None, "allow"), 9: ("a.org", "", None, "allow"), 10: ("bad.site.info", "/p/1", None, "block"), 11: ("good.site.info", "/p/1", None, "allow"), 12: ("q.info", "/1", None, "block")}
    assert {k: tuple(v) for k, v in got.items() if k is not None} == want
    index = url_rules.mine(train).collect()
    sizes = Counter(r["rule"] for r in index)
    assert all(r["size"] == sizes[r["rule"]] == 1 for r in index)  # longer rules are no more confident
    assert url_rules.judge(pages, train.limit(0)).count() == len(rows)
    assert url_rules.judge(pages.limit(0), train).count() == 0


def test_url_rules_of_a_host_among_many_labels(spark):
    """Ten blocked URLs of a host give its rule among 6,000 other labels too; nine do not."""
    other = [(f"http://s{k % 3}.org/{k}", False) for k in range(6000)]
    for n in (9, 10):
        train = spark.createDataFrame(other + [(f"http://bad.info/x/{k}", True) for k in range(n)], "url string, block boolean")
        assert ("domain:bad.info" in {r["token"] for r in url_rules.mine(train).collect()}) == (n == 10)


def test_hmm_base_scores(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    train = Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            train.update([*words(t), None])
    total, size = sum(train.values()), len(train)
    asked = sorted(((str(i), zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, len(words(t)) + 1, sum(train[w] > 0 for w in [*words(t), None]), total, sum(math.log10((train[w] + 0.1) / (total + 0.1 * (size + 1))) for w in [*words(t), None])) for i, t in rows), key=str)
    got = sorted(((str(r["doc_id"]), *tuple(r)[1:6]) for r in hmm.scores(docs).collect()), key=str)
    for a, b in zip(asked, got, strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
    assert hmm.scores(empty).count() == 0


def test_hmm_rare_words_meet_their_counts(docs, monkeypatch):
    whole = {r["doc_id"]: r for r in hmm.scores(docs).collect()}
    monkeypatch.setattr(hmm, "KNOWN", 20)
    monkeypatch.setattr(hmm, "SYMBOLS", 20)
    for r in hmm.scores(docs).collect():
        assert r["n_known"] == whole[r["doc_id"]]["n_known"] and math.isclose(r["base_score"], whole[r["doc_id"]]["base_score"], rel_tol=1e-9)


def test_forward_and_baum_welch_by_hand():
    """Against the sum over all paths of states."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    m = hmm.Model(*(x / x.sum(-1, keepdims=True) for x in (rng.random(2), rng.random((2, 2)), rng.random((2, 5)))))
    some = [np.array(x) for x in ([1, 2, 0], [3, 0], [0], [4, 4, 1, 2, 3, 0])]
    start, moves, emissions = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 5))
    for x, got in zip(some, m.score(some), strict=True):
        weights = {}
        for path in itertools.product(range(2), repeat=len(x)):
            p = m.start[path[0]] * m.emissions[path[0], x[0]]
            for t in range(1, len(x)):
                p *= m.moves[path[t - 1], path[t]] * m.emissions[path[t], x[t]]
            weights[path] = p
        total = sum(weights.values())
        assert math.isclose(got, math.log10(total))
        for path, p in weights.items():
            start[path[0]] += p / total
            for t, s in enumerate(path):
                emissions[s, x[t]] += p / total
                if t:
                    moves[path[t - 1], s] += p / total
    for a, b in zip(m.expected(some), (start, moves, emissions), strict=True):
        assert np.allclose(a, b)


def test_training_raises_held_out_likelihood(spark):
    """Texts of one of two vocabularies: the trained model tells them apart, and beats its start on texts it has not seen."""
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices((("red", "blue", "green"), ("cat", "dog", "cow"))[k % 2], k=40))) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    total = lambda rounds: sum(r["score"] for r in hmm.scores(df, rounds=rounds).collect() if r["held_out"])
    assert total(hmm.ROUNDS) > 0.8 * total(0)  # both are negative


PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="page"><nav><ul><li>Home</ul></nav><div class="ad">Buy!</div>%s<footer>&copy; x</footer>"""


def test_html_blocks_of_an_article():
    page = PAGE % """<article><h1>A &amp;
     B</h1><p><b>One<br>two&nbsp;three<p>Four <i>five</i></p><script>var a="</p>";</script><div class="share">Share</div><form>Mail</form>
     <!-- <p>no</p> --><ul><li>x<li>y</ul><section id="comments"><p>First!</p></section></article><aside>Other</aside>"""
    assert page_text.difference(page_text.read(page), [])["text"].split("\n") == ["A & B", "One two three", "Four five", "x", "y"]
    assert page_text.read(None)["texts"] == page_text.read("")["texts"] == []
    assert html_blocks.blocks("plain <b>text")[0].text == "plain text"


def test_shared_is_a_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = page_text.shared(a, b)
        assert len(got) == table[-1][-1], (a, b)
        at = iter(b)
        assert all(a[k] in at for k in sorted(got))


def test_differencing_deletes_the_template(spark):
    page = "<body><div>Site name</div><div>Menu one</div><p>%s</p><p>%s</p><div>All about us</div></body>"
    rows = [(k, f"http://h{k % 2}.org/a/{k:02}", page % (f"text {k}", f"more {k}")) for k in range(12)] + [(90, "http://h9.org/", page % ("alone", "x")), (91, None, None), (92, "nothing", ""), (None, "http://h0.org/a/02", page % ("text 2", "more 2"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r for r in page_text.extract(df).collect()}
    assert all(got[k]["text"] == f"text {k}\nmore {k}" for k in range(12) if k != 2)
    assert got[90]["text"].startswith("Site name") and got[91]["text"] == got[92]["text"] == "" and got[91]["n_chars"] == 0
    assert len(got) == len(rows)  # page 2 and its copy have other neighbours
    assert "text 2" in got[None]["text"]
    assert page_text.extract(df.limit(0)).count() == 0


def test_differencing_passes_over_copies(spark):
    """A near copy, or an exact one, at the next URL is no partner: the template goes by the other neighbour, the text stays.
    In marked articles boxes that the next page's article has too go as well, but prose stays, and so does what a copy shares."""
    template = "<body><div>Site name</div>%s<div>All about us</div>"
    text = lambda k: f"text {k} of some length, which is a sentence. " * 3
    plain = lambda k, day: template % f"<p>{text(k)}</p><p>{day}</p>"
    article = lambda k, day: template % f"<article><div>Read more here</div><p>{text(k)}</p><p>A paragraph of every page.</p><p>{day}</p></article>"
    rows = []
    for host, page in (("p", plain), ("q", article)):
        rows += [(len(rows) + n, f"http://{host}.org/{n}", page(k, day)) for n, (k, day) in enumerate([(1, "Monday"), (2, "Tuesday"), (2, "Friday"), (3, "Sunday"), (4, "May"), (4, "May"), (5, "June")])]
    got = {r["page_id"]: r["text"] for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    want = [f"{text(k).strip()}\n{day}" for k, day in [(1, "Monday"), (2, "Tuesday"), (2, "Friday"), (3, "Sunday"), (4, "May"), (4, "May"), (5, "June")]]
    assert [got[k] for k in range(7)] == want
    assert [got[k] for k in range(7, 14)] == [x.replace("\n", "\nA paragraph of every page.\n") for x in want]


def page_brute(rows):
    """The texts of pages (id, url, html), by their order in one list."""
    parts = lambda u: re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "") or ("", "", "")
    raw = lambda x: (x is not None, (x or "").encode())
    keyed = sorted(rows, key=lambda r: (parts(r[1])[1].lower().encode(), parts(r[1])[2].encode(), raw(r[1]), (r[0] is not None, r[0] or 0)))
    sides = [{"host": parts(u)[1].lower(), "path": parts(u)[2], **page_text.read(h)} for _, u, h in keyed]
    out = Counter()
    for k, (i, _, h) in enumerate(keyed):
        near = sides[max(0, k - 1) : k] + sides[k + 1 : k + 2]
        near = [s for s in near if s["host"] == sides[k]["host"]]
        near.sort(key=lambda s: -len(os.path.commonprefix([s["path"], sides[k]["path"]])))
        a, text = sides[k]["lines"], None
        own = dict(zip(sides[k]["at"], map(len, sides[k]["texts"]), strict=True))
        both = []
        for s in near:
            b = s["lines"]
            table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for x in range(len(a)):
                for y in range(len(b)):
                    table[x + 1][y + 1] = table[x][y] + 1 if a[x] == b[y] else max(table[x][y + 1], table[x + 1][y])
            x, y, common = len(a), len(b), set()
            while x and y:
                if a[x - 1] == b[y - 1]:
                    x, y = x - 1, y - 1
                    common.add(x)
                elif table[x - 1][y] >= table[x][y - 1]:
                    x -= 1
                else:
                    y -= 1
            both.append(common & set(own))
        gone = set()
        for n, common in enumerate(both):
            lacking = set(own) - both[1 - n] if len(both) == 2 else set()
            if lacking and sum(own[p] for p in lacking & common) > 0.8 * sum(own[p] for p in lacking) or not lacking and common == set(own):
                continue  # a copy
            gone = common
            break
        text = "\n".join(t for p, t, prose in zip(sides[k]["at"], sides[k]["texts"], sides[k]["prose"], strict=True) if prose or p not in gone)
        out[i, text, len(text)] += 1
    return out


def test_short_pages_under_a_large_template(spark):
    """Twenty lines of template and one line of its own a page: the template goes; exact copies among them keep their text's lines."""
    page = "<body>" + "".join(f"<div>Line {k} of the template of this site</div>" for k in range(20)) + "<p>%s</p></body>"
    rows = [(k, f"http://h.org/{k}", page % f"own {k}") for k in range(6)]
    got = {r["page_id"]: r for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k]["text"] for k in range(6)] == [f"own {k}" for k in range(6)] and got[3]["n_shared"] == 20


def test_articles_inside_silent_boxes():
    text = lambda h: page_text.difference(page_text.read(h), [])["text"]
    assert text('<div class="content has-sidebar"><article><p>Body one.</p></article></div>') == "Body one."
    assert text('<form id="aspnetForm"><div>skip</div><article><p>In a form.</p><p class="share-price">9</p><form>Mail</form></article></form>') == "In a form.\n9"
    assert text('<article><p>a</p><div class="comment-list"><article><p>first!</p></article></div><aside>b</aside></article>') == "a"
    assert text('<div class="sidebar"><p>x</p></div><div class="ad-banner bottom">y</div><p>z</p>') == "z"


def test_page_texts_against_brute_force(spark):
    """Pages of few hosts over many tasks: with and without articles, copies, unique and repeated lines (each line once in a
    page, so that the alignment is the only one)."""
    rng = random.Random(11)
    rows = []
    for k in range(160):
        host, lines = rng.randrange(4), rng.sample([f"line {x} of the pool" for x in range(12)], rng.randint(0, 6))
        body = "".join(f"<{t}>{x}</{t}>" for x in ["Top of the site", *sorted(lines), f"only here {k}", "End of the site"] for t in [rng.choice(["p", "div"])])
        page = rng.choice(["<body><nav>Menu</nav>%s</body>", "<body><nav>Menu</nav><article>%s</article><footer>All about</footer></body>"]) % body
        rows.append((k, f"http://h{host}.org/{rng.randrange(9)}/{k % 13}", page))
        if rng.random() < 0.2:
            rows.append((k + 1000, rows[-1][1], page))
    rows += [(None, None, None), (5000, "no url", "<p>x</p>"), (5001, "", ""), rows[3]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in page_text.extract(df.repartition(7)).collect())
    assert got == page_brute(rows)


def test_long_pages(spark):
    """Deep nesting, stray end tags, and very many lines, most of them the template's, which goes at any share."""
    deep = "<article>" + "<div>" * 20_000 + "core" + "</div>" * 20_000 + "</b>" * 20_000 + "</article>"
    many = ["<body>", *(f"<div>line {k}</div>" for k in range(20_000)), "<p>%s</p>" * 2_000, "</body>"]
    page = lambda k: "".join(many) % tuple(f"text {k} {j}" for j in range(2_000))
    rows = [(0, "http://a.org/0", deep), (1, "http://b.org/1", page(1)), (2, "http://b.org/2", page(2))]
    got = {r["page_id"]: r["text"] for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "core"
    assert got[1].split("\n") == [f"text 1 {j}" for j in range(2_000)]
    assert page_text.difference(page_text.read(page(1)), [page_text.read("".join(f"<div>line {k}</div>" for k in range(9_000)))])["n_shared"] == 9_000


def test_warc_round_trip(spark, tmp_path):
    import gzip

    page = "<html lang=fr><head><title>T &amp; t</title></head><body><p>Un <a href='/x?a=1&amp;b=2'>lien</a></p></body></html>".encode()
    http = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=utf-8\r\nX-A: b\r\n\r\n" + page
    head = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://a/"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Block-Digest", "sha1:KEPT"), ("WARC-Payload-Digest", warc.digest(page))]
    data = warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:0>")], b"software: x\r\n") + warc.record(head, http) + warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:2>")], b"")
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data[:-2]) + gzip.compress(data))
    records = warc.read_warc(spark, str(tmp_path))
    assert records.count() == 9
    assert {bytes(r["block"]) for r in records.where("record_id = '<urn:uuid:1>'").collect()} == {http}
    made = warc.derive(records).where("refers_to = '<urn:uuid:1>'").dropDuplicates(["record_id"]).collect()
    by = {r["warc_type"]: r for r in made}
    text = bytes(by["conversion"]["block"]).decode()
    note = bytes(by["metadata"]["block"]).decode()
    assert text == "Un lien" and by["conversion"]["block_digest"] == warc.digest(text.encode()) and by["conversion"]["target_uri"] == "http://a/"
    for line in ("source-record: <urn:uuid:1>", "source-status: HTTP/1.1 404 Not Found", "source-http-header: X-A: b", "source-block-digest: sha1:KEPT", "title: T & t", "language: fr", "outlink: /x?a=1&b=2", f"conversion: {by['conversion']['record_id']}", "source-header: WARC-Date: 2024-01-01T00:00:00Z"):
        assert line + "\r\n" in note, line
    again = list(warc.parse(b"".join(bytes(r["bytes"]) for r in warc.serialised(warc.derive(records)).collect())))
    assert Counter(r["warc_type"] for r in again) == {"metadata": 6, "conversion": 6} and not any(r["cut_off"] for r in again)


def test_warc_of_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (None, None, None), (1, "http://a/", "<p>x</p>")], "page_id long, url string, html string")
    got = warc.derive(warc.responses(pages, "2024-01-01T00:00:00Z"), ("page_id",)).collect()
    assert len(got) == 6 and len({r["record_id"] for r in got}) == 4
    assert warc.derive(warc.responses(pages.limit(0), "x"), ("page_id",)).count() == 0
