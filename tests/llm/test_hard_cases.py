"""Operators of the training-data part against brute force, on sizes, groups and lengths that the other tests do not reach."""

import gzip
import itertools
import math
import random
import zlib
from collections import Counter

import pytest

pytest.importorskip("graphloom.llm")

import numpy as np  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from graphloom.llm import bpe, common, decontaminate, hmm, jaccard, quality_rules, queries, token_counts, url_rules, warc  # noqa: E402
from graphloom.llm import words as words_module  # noqa: E402


def components_brute(texts, width, num):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    lead = list(range(len(sets)))

    def root(x):
        while lead[x] != x:
            lead[x] = lead[lead[x]]
            x = lead[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b]:
            k = len(sets[a] & sets[b])
            if 100 * k >= num * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((root(a), root(b)))
                lead[y] = x
    return {k: (len(s), root(k)) for k, s in enumerate(sets)}


def components_got(spark, texts, width, num):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(df, width, num, 100).collect()}


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80), (1, 50), (2, 100)])
def test_components_of_all_small_sizes(spark, width, num):
    """Texts of 1 to 34 words; each longer by one word at either end, with one word changed, and with one word twice."""
    rng, texts = random.Random(width), []
    for n in range(1, 35):
        w = [f"s{n}w{k}" for k in range(n)]
        other = list(w)
        other[rng.randrange(n)] = "changed"
        texts += [" ".join(x) for x in (w, [*w, "end"], ["begin", *w], other, [*w[: n // 2], *w[max(0, n // 2 - 1) :]], w[1:] or w)]
    assert components_got(spark, texts, width, num) == components_brute(texts, width, num)


@pytest.mark.parametrize("few", [jaccard.FEW, 0])
def test_components_of_a_large_group_of_near_copies(spark, monkeypatch, few):
    """Near copies of one text, of which some link, some not, and a second group that shares a third of the text; with all
    pairs at once, and by many centres."""
    monkeypatch.setattr(jaccard, "FEW", few)
    rng = random.Random(9)
    base = [f"b{k}" for k in range(60)]
    second = base[:20] + [f"c{k}" for k in range(40)]
    texts = []
    for k in range(260):
        w = list(base if k % 3 else second)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        texts.append(" ".join(w))
    texts += texts[:40] + [None, "", "  "]
    want = components_brute(texts, 3, 80)
    got = components_got(spark, texts, 3, 80)
    assert {k: v for k, v in got.items() if v[0]} == {k: v for k, v in want.items() if v[0]}
    assert all(got[k] == (0, k) for k in (300, 301, 302)) and 2 < len({c for _, c in want.values()}) < 200


def test_runs_count_what_is_shared():
    """Sets over several runs and buckets: no shared shingle is missed, and none of a single set is counted in _meet()."""
    rng = random.Random(1)
    pool = np.array([rng.getrandbits(64) & ~1 for _ in range(300)], dtype=np.uint64)
    sets = {k + 1: np.unique(np.array(rng.sample(list(pool), rng.randint(1, 40)), dtype=np.uint64)) for k in range(60)}
    rows = []
    for chunk in (range(1, 25), range(20, 40), range(40, 61)):  # some sets are in two runs, as copies are
        run = jaccard.Run(7)
        for k in chunk:
            run.add(k, sets[k])
        rows += list(run.rows())
    df = Counter(x for s in sets.values() for x in s.tolist())
    got = Counter()
    for b in range(7):
        runs = [r["run"] for r in rows if "run" in r and r["bucket"] == b]
        for s, n in zip(*jaccard._meet(runs), strict=True):
            got[int(s)] += int(n)
    near = {}
    for r in rows:
        if "set" in r:
            near[r["set"]["sig"]] = max(near.get(r["set"]["sig"], 0), r["set"]["near"])
    for k, s in sets.items():
        shared = sum(df[x] > 1 for x in s.tolist())
        assert got[k] + near.get(k, 0) >= shared and got[k] <= shared


def test_one_of_each_with_nulls_and_clashes(spark):
    rows = [(3, "a b c d e f g h i j", "x"), (None, "a b c d e f g h i j", "y"), (1, "A b c d e f g h i j", "z"), (2, None, "n"), (2, None, "n"), (4, "", "e"), (1, "A b c d e f g h i j", "z"), (5, " ".join(["word"] * 60_000), "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sig string").withColumn("key", F.lit("clash")).withColumn("id", F.lit(0))
    got = sorted(((r["doc_id"], r["sig"]) for r in jaccard.one_of_each(df).collect()), key=str)
    assert got == [(1, "z"), (2, "n"), (2, "n"), (4, "e"), (5, "long")]


def test_limit_of_lines_grows_slowly(spark):
    """On a host of 900 texts the limit is 60: a line of 61 goes, one of 60 stays; the words removed are those of brute force."""
    rows = []
    for k in range(900):
        lines = [f"own words of text {k} to keep it going on and on", *(["at the limit of this host"] if k < 60 else []), *(["above the limit"] if k < 61 else []), *(["Above  the LIMIT"] if k < 2 else [])]
        rows.append((k, "\n".join(lines), "h"))
    rows += [(900 + k, "above the limit\nshort", "h") for k in range(3)] + [(910, "above the limit\nshort", "other"), (911, None, None), (912, "\n \n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", F.lit("clash")).withColumn("text_hash", F.lit(1))
    texts = len({t for _, t, h in rows if h == "h"})
    docs = Counter(line for t, h in {(t, h) for _, t, h in rows if h == "h"} for line in {" ".join(x.lower().split()) for x in t.split("\n")})
    frequent = {x for x, n in docs.items() if n > max(20, 2 * math.sqrt(texts))}
    assert frequent == {"above the limit"}
    got = {r["doc_id"]: r for r in quality_rules.report(df).collect()}
    for k, t, h in rows:
        assert got[k]["removed_words"] == (sum(len(x.split()) for x in (t or "").split("\n") if " ".join(x.lower().split()) in frequent) if h == "h" else 0), k
    assert got[911]["n_words"] == got[912]["n_words"] == 0 and not got[911]["kept"]


def test_lines_beyond_a_broadcast(spark, monkeypatch):
    rows = [(k, f"shared by all of them\nown {k} is a line of ten words or more here", f"h{k % 2}") for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, quality_rules.report(df).collect()))
    monkeypatch.setattr(quality_rules, "maybe_broadcast", lambda x, _: x)
    assert sorted(map(tuple, quality_rules.report(df).collect())) == want and all(r[6] == 5 for r in want)


def test_copies_of_a_long_url(spark):
    """A thousand copies of a URL of 60 segments, and as many of variants of it: mining ends, and what is blocked stays blocked."""
    long = "http://a.b.c.d.e.bad.info/" + "/".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(60)) + "?q=1&r=2"
    train = [(long, True)] * 1000 + [(f"http://s{k % 7}.org/{'/'.join('pqrstuvw'[j] * (1 + (k >> j & 1)) for j in range(8))}", k % 3 == 0) for k in range(1000)]
    df = spark.createDataFrame(train, "url string, block boolean")
    items, classes = url_rules.items_of(df)
    assert items.agg(F.max(F.size("items"))).first()[0] <= 20  # the long URL's item is a rule by itself and is not combined
    assert classes.groupBy("item").count().agg(F.max("count")).first()[0] > 60  # the long URL's tokens are one item
    pages = spark.createDataFrame([(0, long), (1, "http://x.bad.info/q"), (2, "http://s1.org/none")], "page_id long, url string")
    got = {r["page_id"]: r["filter"]["verdict"] for r in url_rules.judge(pages, df).collect()}
    assert got[0] == got[1] == "block"


def test_mined_rules_against_enumeration(spark):
    """Every combination of tokens up to the size, counted by hand."""
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        url = f"http://{rng.choice('uv')}.{rng.choice(['com', 'org'])}/{rng.choice('xyz')}/{rng.choice(['m', 'n'])}"
        rows.append((url, rng.random() < 0.2 + 0.5 * ("/x/" in url) * (".org" in url) + 0.2 * ("u." in url)))
    df = spark.createDataFrame(rows, "url string, block boolean")
    tokens = {r["url"]: set(r["t"]) for r in df.select("url", url_rules.tokens_of(F.col("url")).alias("t")).distinct().collect()}
    every = set().union(*tokens.values())
    conf = {}
    for size in range(1, url_rules.SIZE + 1):
        for some in itertools.combinations(sorted(every), size):
            hits = [b for u, b in rows if tokens[u] >= set(some)]
            if sum(hits) >= url_rules.LEAST and sum(hits) >= 0.5 * len(hits):
                conf[frozenset(some)] = sum(hits) / len(hits)
    kept = {s for s, c in conf.items() if not any(t < s and conf[t] >= c for t in conf)}
    blocked = {u for u, t in tokens.items() if any(t >= s for s in kept)}
    pages = df.select("url").distinct().withColumn("filter", F.lit("clash")).withColumn("rule", F.lit("clash"))
    got = {r["url"] for r in url_rules.judge(pages, df, rules=[]).where("filter.verdict = 'block'").collect()}
    assert got == blocked and 0 < len(blocked) < len(tokens)


def enumerated(rows, tokens, size):
    """The URLs that a rule holds for, of all combinations of the tokens of blocked URLs."""
    rules = set()
    for k in range(1, size + 1):
        for some in {c for u, b in rows if b for c in itertools.combinations(sorted(tokens[u]), k)}:
            hits = [b for u, b in rows if tokens[u] >= set(some)]
            if sum(hits) >= url_rules.LEAST and sum(hits) >= 0.5 * len(hits):
                rules.add(frozenset(some))
    return {u for u, t in tokens.items() if any(t >= s for s in rules)}


def test_a_token_behind_twelve_purer_ones(spark):
    """Every token of a URL counts: one that is blocked in 20 of 35 URLs is a rule, though ten of these have twelve purer tokens."""
    pure = "/".join(f"p{chr(97 + k)}x" for k in range(12))
    rows = [(f"http://a{k}.org/{pure}/late", True) for k in range(10)] + [(f"http://b{k}.org/{pure.split('/')[k]}", True) for k in range(12)]
    rows += [(f"http://c{k}.org/late", True) for k in range(10)] + [(f"http://d{k}.org/late", False) for k in range(15)]
    df = spark.createDataFrame(rows, "url string, block boolean")
    page = spark.createDataFrame([(1, "http://new.net/late")], "page_id long, url string")
    assert url_rules.judge(page, df, rules=[]).first()["filter"]["verdict"] == "block"


def test_urls_of_twenty_items(spark):
    """No item of a URL is passed over, by either way of combining."""
    rng = random.Random(8)
    rows = []
    for _ in range(150):
        some = rng.sample("abcdefghijklmnopqrstuvwxyz", rng.choice([3, 5, 20]))
        rows.append((f"http://h.org/{'/'.join(some)}", rng.random() < (0.9 if {"a", "b"} <= set(some) else 0.3)))
    df = spark.createDataFrame(rows, "url string, block boolean")
    tokens = {r["url"]: set(r["t"]) for r in df.select("url", url_rules.tokens_of(F.col("url")).alias("t")).distinct().collect()}
    want = enumerated(rows, tokens, 2)
    pages = df.select("url").distinct()
    for items in (0, 30):
        index = url_rules.mine(df, size=2, items=items if items == 0 else 14)
        assert {r[0] for r in url_rules.matched(pages, index).collect()} == want
    few = df.where("length(url) < 25")
    ways = [{(tuple(r["tokens"]), round(r["confidence"], 9)) for r in f(url_rules.items_of(few, least=3)[0], 3, 0.5, 4).collect()} for f in (url_rules.mined, url_rules.grown)]
    singles = [{t for t, _ in w} for w in ways]
    # growing stops at a rule; what FP-growth lists beyond has a shorter rule in it
    assert ways[1] <= ways[0] and all(any(set(s) <= set(t) for s in singles[1]) for t in singles[0]) and ways[1]


def test_warc_members_piece_by_piece(monkeypatch):
    rng = random.Random(2)
    blocks = [rng.randbytes(n) for n in (0, 1, 70_000, 5, 300_000)]
    records = [warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", f"<{k}>")], b) for k, b in enumerate(blocks)]
    whole, members = b"".join(records), b"".join(map(gzip.compress, records))
    for piece in (1 << 10, 1 << 20):
        monkeypatch.setattr(warc, "PIECE", piece)
        for data in (whole, members, gzip.compress(whole), [whole[k : k + 7] for k in range(0, len(whole), 7)]):
            parts = data if isinstance(data, list) else list(warc.inflated(data, piece))
            got = list(warc.parse(iter(parts)))
            assert [r["block"] for r in got] == blocks and not any(r["cut_off"] for r in got)
    cut = list(warc.parse(members[:-2000]))
    assert [r["block"] for r in cut[:4]] == blocks[:4] and cut[4]["cut_off"] and blocks[4].startswith(cut[4]["block"]) and len(cut[4]["block"]) > 250_000
    assert list(warc.parse(b"")) == list(warc.parse(b"no record")) == [] and next(warc.parse(b"WARC/1.0\r\nWARC-Type: x"))["cut_off"]


def test_scores_are_those_of_the_model(spark, monkeypatch):
    """The score of each text by plain matrix products over symbols, times the shares of shared symbols, with rare words met
    in the join; the model is trained the same way on the driver."""
    monkeypatch.setattr(hmm, "KNOWN", 12)
    monkeypatch.setattr(hmm, "SYMBOLS", 6)
    rng = random.Random(8)
    vocabulary = [f"{'abcdefgh'[k % 8]}{'x' * (k % 5)}{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(40)], k=rng.randint(0, 30)))) for k in range(80)] + [(80, None), (81, "never seen here"), (None, "ax1 bxx2"), (82, " ".join(rng.choices(vocabulary, k=5000)))]
    got = {r["doc_id"]: r for r in hmm.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rounds=2).collect()}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    words = {i: (t or "").lower().split() for i, t in rows}
    c = Counter(w for i, x in words.items() if not held(i) for w in x)
    own = list(words_module.top(spark.createDataFrame(list(c.items()), "word string, n long"), 12))[:6]
    assert sorted((-c[w], w) for w in c)[:5] == [(-c[w], w) for w in own[:5]]
    ends = sum(not held(i) for i in words)
    symbol = lambda w: 1 + hmm.LENGTHS + own.index(w) if w in own else min(len(w), hmm.LENGTHS)
    totals = np.zeros(1 + hmm.LENGTHS + len(own))
    totals[0] = ends
    for w, n in c.items():
        totals[symbol(w)] += n
    distinct = Counter(symbol(w) for w in c)
    sequences = {i: np.array([*map(symbol, x), 0]) for i, x in words.items()}
    model = hmm.Model.fresh(totals)
    for _ in range(2):
        model = hmm.Model.counted(*model.expected([s for i, s in sequences.items() if not held(i)]))
    for i, s in sequences.items():
        alpha, log = model.start * model.emissions[:, s[0]], 0.0
        for x in s[1:]:
            alpha = (alpha @ model.moves) * model.emissions[:, x]
            log, alpha = log + math.log10(alpha.sum()), alpha / alpha.sum()
        log += math.log10(alpha.sum())
        for w in words[i]:
            if w not in own:
                k = symbol(w)
                log += math.log10((c[w] + 0.1) / (totals[k] + 0.1 * (distinct[k] + 1)))
        assert math.isclose(got[i]["score"], log, rel_tol=1e-9), i
        assert got[i]["held_out"] == held(i) and got[i]["n_tokens"] == len(s)


def test_top_words_of_large_levels(spark):
    """Exactly as many as asked for but for a part of the last count's words, and none that is rarer than one left out."""
    rng = random.Random(2)
    counts = {f"w{k}": 1 + int(20 / (1 + rng.random() * 30)) for k in range(9000)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    for most in (0, 1, 37, 2000, 8000, 9000, 20_000):
        got = words_module.top(df, most)
        assert all(counts[w] == n for w, n in got.items()) and most - 40 <= len(got) <= most or len(got) == 9000 <= most
        assert list(got.items()) == sorted(got.items(), key=lambda x: (-x[1], x[0]))
        if got and len(got) < 9000:
            assert min(got.values()) >= max(n for w, n in counts.items() if w not in got)


def test_long_texts_are_trained_on_piece_by_piece(monkeypatch):
    rng = np.random.default_rng(5)
    m = hmm.Model(*(x / x.sum(-1, keepdims=True) for x in (rng.random(3), rng.random((3, 3)), rng.random((3, 6)))))
    texts = [rng.integers(0, 6, n) for n in (500, 33, 32, 1)]
    want = m.expected(texts)
    monkeypatch.setattr(hmm, "CELLS", 32)
    for a, b in zip(m.expected(texts), want, strict=True):
        assert np.allclose(a, b)


def test_caches_forget(monkeypatch):
    """With caches of a few characters, counts and ids stay those of the library's encoder."""
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdé ", k=rng.randint(1, 40))) for _ in range(30)) for _ in range(20)] + [None, "", "x" * 5000]
    monkeypatch.setattr(bpe, "CACHE_CHARS", 50)
    path = queries.tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    bpe.worker_cache.cache_clear()
    for t, b in zip(texts, bpe.encode_all(texts, path), strict=True):
        assert np.frombuffer(b, "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids
    monkeypatch.setattr(token_counts, "CACHE_CHARS", 50)
    path = queries.tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    assert token_counts.Lengths(bpe.vocabulary(path), {}).count(texts) == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_blocks_of_a_benchmark_bound_the_states(spark, monkeypatch):
    """A benchmark of many blocks, with an item longer than a block: the same hits as in one, and no automaton over the bound."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(50)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for k in range(60)] + [(60, " ".join(rng.choices(words, k=900)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(k, " ".join([*rng.choices(words, k=20), *rng.choice(items)[1].split()[-30:], *rng.choices(words, k=20)])) for k in range(30)]
    docs = spark.createDataFrame([*docs, (30, items[60][1]), (31, None)], "doc_id long, text string").withColumn("hits", F.lit("clash"))
    whole = sorted(map(tuple, decontaminate.report(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "NODES", 2 * 13 * 300)
    blocks = list(decontaminate._blocks(bench, "item_id", "text", 13))
    assert len(blocks) > 4 and all(decontaminate.Machine(b).found.get_stats()["nodes_count"] <= 2 * 13 * 301 for b in blocks)
    assert sorted(map(tuple, decontaminate.report(docs, bench).collect())) == whole
    text = items[60][1].upper().replace(" ", " -- ", 3)
    row = decontaminate.find(spark.createDataFrame([("é " + text,)], "text string"), bench).first()["hits"]
    assert [(s["first"], s["end"]) for s in row["words"]] == [(1, 901)] and [("é " + text)[s["first"] : s["end"]] for s in row["chars"]] == [text]


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Session())
    df = common.written(spark.range(3), "x")
    common.discard(df)
    with pytest.raises(Exception, match="x"):
        spark.read.parquet(df._path)


def test_hmm_texts_of_many_batches_are_recursed_on_together(monkeypatch):
    import pyarrow as pa

    column = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int16()))], names=["symbols"])
    batches = [column([[1, 2, 0], [0]]), column([]), column([[3, 0]]), column([[4, 0]])]
    held = list(hmm._together(iter(batches)))
    assert [([b.num_rows for b in some], [t.tolist() for t in texts]) for some, texts in held] == [([2, 0, 1, 1], [[1, 2, 0], [0], [3, 0], [4, 0]])]
    monkeypatch.setattr(hmm, "TOGETHER", 3)
    assert [len(texts) for _, texts in hmm._together(iter(batches))] == [2, 2]
