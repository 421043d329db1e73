"""The pipeline against a brute-force version of its stages, on small tables."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from graphloom.llm import decontaminate, jaccard, quality_rules, queries  # noqa: E402


def test_pipeline(spark, sf_dir):
    from tokenizers import Tokenizer

    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    kept = {r["doc_id"] for r in quality_rules.report(docs).collect() if r["kept"]}
    rows = [r for r in docs.collect() if r["doc_id"] in kept]
    sets = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    lead = list(range(len(rows)))

    def root(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                x, y = root(a), root(b)
                lead[max(x, y, key=lambda z: rows[z]["doc_id"])] = min(x, y, key=lambda z: rows[z]["doc_id"])
    left = [r for k, r in enumerate(rows) if root(k) == k]
    machine = decontaminate.Machine([(r["item_id"], r["text"]) for r in bench.collect()])
    library = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    asked = {}
    for r in left:
        n, spans, _ = machine.scan(r["text"])
        hit = sum(b - a for a, b in spans)
        if not (hit and 20 * hit >= n):
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            asked[r["doc_id"]] = (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == asked
    assert 0 < len(asked) < docs.count()


def test_stages_return_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
    assert jaccard.one_of_each(docs).count() <= docs.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def _quality(rows):
    """The rows that the first stage keeps, by hand."""
    split = lambda t: [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
    lines = lambda t: [x for x in (" ".join(split(y.lower())) for y in (t or "").split("\n")) if x]
    texts, docs = Counter(), Counter()
    for host, t in {(r["source"], r["text"]) for r in rows}:
        texts[host] += 1
        docs.update((host, x) for x in set(lines(t)))
    out = []
    for r in rows:
        w = split(r["text"])
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeated = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        gone = sum(len(x.split()) for x in lines(r["text"]) if docs[r["source"], x] > max(20, 2 * math.sqrt(texts[r["source"]])))
        if len(w) >= 10 and 100 * len(repeated) <= 20 * len(w) and len(w) - gone >= 0.3 * len(w):
            out.append(r)
    return out


def _alone(rows):
    """The rows that the second stage keeps."""
    sets = []
    for r in rows:
        w = (r["text"] or "").lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))))
    lead = list(range(len(rows)))
    order = lambda k: (rows[k]["doc_id"] is None, rows[k]["doc_id"] or 0)

    def root(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((root(a), root(b)), key=order)
                lead[y] = x
    return [r for k, r in enumerate(rows) if root(k) == k]


def _clean(rows, bench):
    """The rows that the third stage keeps."""
    low = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    windows = {tuple(w[k : k + 13]) for w in (low(t) for _, t in bench) if w for k in range(max(1, len(w) - 12))}
    out = []
    for r in rows:
        w = low(r["text"])
        hit = {p for size in {len(x) for x in windows} for k in range(len(w) - size + 1) if tuple(w[k : k + size]) in windows for p in range(k, k + size)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(r)
    return out


def test_pipeline_on_hard_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeated rows, more columns; each stage against brute force."""
    from tokenizers import Tokenizer

    rng = random.Random(12)
    words = [f"{x}{k}" for x in ("Ä", "b", "c") for k in range(200)]
    item = rng.choices(words, k=40)
    rows = []
    for k in range(60):
        w = rng.choices(words, k=rng.randint(8, 60))
        rows.append((k, " ".join(w), "en", f"h{k % 2}", k))
        if k % 4 == 0:
            near = list(w)
            near[rng.randrange(len(near))] = "changed"
            rows += [(100 + k, " ".join(near).upper(), None, None, None), (200 + k, " ".join([*w, "tail"]), "en", "h0", 1)]
        if k % 7 == 0:
            rows.append((300 + k, " ".join([*w, *item[5 : 5 + 13 + k % 3]]), "en", "h1", 1))
    rows += [(400 + k, f"the same line on every page of this host\n{rng.choice(words)}", "en", "h2", 1) for k in range(30)]
    rows += [(None, " ".join(rng.choices(words, k=30)), None, None, None), (500, None, "en", "h0", 0), (501, "", None, "h0", 0), (502, " \n ", None, "h0", 0), (503, " ".join(rng.choices(words, k=40_000)), "en", "h0", 1), rows[0], rows[0], (504, "same five words again and " * 9, "en", "h0", 1), (505, "<|endoftext|> é 日本 🙂 one two three four five six seven", "zz", "h0", 1)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, names).selectExpr("*", "'clash' AS sig", "0 AS id", "'clash' AS host").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    bench = [(1, " ".join(item)), (2, None), (3, "")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    made = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows]
    asked = [_quality, _alone, lambda x: _clean(x, bench)]
    count = lambda some: Counter((r["doc_id"], r["text"]) for r in some)
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:-1], asked, strict=True):
        before = len(made)
        made = brute(made)
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        found = got.collect()
        assert count(found) == count(made), name
        assert all(r["sig"] == r["host"] == "clash" for r in found) and len(made) < before
        got.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    library = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    want = Counter()
    for r in made:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        want[r["doc_id"], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
