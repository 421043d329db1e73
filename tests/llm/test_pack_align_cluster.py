"""Packing, alignment and clustering against brute force, on hard cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("graphloom.llm")

from graphloom.llm import align, hamerly, packing, queries  # noqa: E402

WORD, BYTE, PIECE = (queries.tokenizer(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, length string, id string, task string"
HARD = [None, "", " ", " \t\n ", "a▁b c", "  x  y   z \n \n q <|endoftext|> <s> </s>", "日本語 テキスト 😀 é é", "\x00\x01 \x1c\x1dz\x85 　w", "a" * 3000, "ÄÖ ǰ J̌ İ it's 12'34", "<|STARTOFTEXT|>x <|startoftext|>", "tail   ", "\n lead"]


def texts(n=40, seed=1):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcdeéß-'19", k=rng.randint(1, 9))) for _ in range(300)]
    out = [*HARD, *(" ".join(rng.choices(pool, k=rng.randint(1, 400))) for _ in range(n))]
    return [*out, out[-1], out[-1], rng.choice(pool) + " " + " ".join(rng.choices(pool, k=9000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "clash", "clash", "clash") for k, t in enumerate(texts())] + [(None, "null id", None, None, None)]
    return spark.createDataFrame([*rows, rows[20]], DOCS).repartition(3)


def packed(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    out = []
    for r in docs.collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out += [(r["doc_id"], n, s, len(ids[s : s + 4096]), ids[s : s + 4096].tobytes()) for n, s in enumerate(range(0, len(ids), 4096))]
    return out


def gapless(rows, capacity):
    places = defaultdict(list)
    for sequence, offset, length in rows:
        places[sequence].append((offset, length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_pieces_are_the_library(docs):
    want = packed(docs)
    got = packing.pack(docs, WORD).collect()
    assert Counter((r["id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in got) == Counter(want)
    assert all(r["crc"] == zlib.crc32(r["ids"]) for r in got)
    sequences = gapless([(r["sequence_id"], r["offset"], r["length"]) for r in got], 4096)
    assert sequences == -(-sum(r[3] for r in want) // 4096)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in packing.report(docs, WORD).collect()) == Counter((r[0], zlib.crc32(r[4])) for r in want)
    assert packing.report(docs.limit(0), WORD).count() == 0


def test_sequences_hold_their_pieces(docs):
    made = packing.pack(docs, WORD, capacity=64)
    rows = {(r["sequence_id"], r["offset"]): bytes(r["ids"]) for r in made.collect()}
    for r in packing.sequences(made).collect():
        parts = [rows[r["sequence_id"], at] for at in r["starts"]]
        assert bytes(r["ids"]) == b"".join(parts) and r["n_pieces"] == len(parts) and len(r["ids"]) <= 256


@pytest.mark.parametrize("seed", range(12))
def test_places_hold_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 300])
    counts = {s: rng.choice([0, 1, 5, 400]) for s in rng.sample(range(1, capacity + 1), rng.randint(1, min(40, capacity)))}
    plan = packing.planned(counts, capacity)
    rows, seen = [], Counter()
    runs = sorted(plan.runs)
    for k, (length, rank, sequence, each, offset) in enumerate(runs):
        stop = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == length else counts[length]
        assert rank == seen[length]
        for i in range(stop - rank):
            rows.append((sequence + i // each, offset + i % each * length, length))
            seen[length] += 1
    assert {k: n for k, n in counts.items() if n} == dict(seen)
    n = gapless(rows, capacity)
    assert n == plan.sequences
    room, fit = [], 0  # best fit, longest first
    for length in sorted(rows, key=lambda r: -r[2]):
        fits = [k for k, r in enumerate(room) if r >= length[2]]
        if fits:
            k = min(fits, key=lambda k: room[k])
            room[k] -= length[2]
        else:
            room.append(capacity - length[2])
            fit += 1
    assert n <= fit * 1.02 + 1


def test_configurations_beat_best_fit():
    """Two halves and a bit: longest first pairs 51 with 27 and leaves 26 alone; configurations fill every sequence."""
    assert packing.planned({51: 60, 27: 60, 22: 60}, 100).sequences == 60
    assert packing.planned({1366: 3000, 1365: 3000, 2730: 1000}).sequences == 2750
    assert packing.planned({}).sequences == 0


def aligned(docs):
    """By walking both rows of tokens at once."""
    import sentencepiece
    from tokenizers import Tokenizer

    left, right, (a_bytes, b_bytes) = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE), align.sides(BYTE, PIECE).bytes
    left.encode_special_tokens = True
    rows, counts = [], Counter()
    for r in docs.collect():
        t, a, b = r["text"], [], []
        if t:
            a, b = left.encode(" " + t, add_special_tokens=False).ids, right.encode(t)
            if any(b"".join(side[x] for x in ids) != (" " + t).encode() for side, ids in ((a_bytes, a), (b_bytes, b))):
                a, b = [], []
        groups, i, j, x, y, p, q = [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if x <= y:
                p.append(a[i])
                x, i = x + len(a_bytes[a[i]]), i + 1
            else:
                q.append(b[j])
                y, j = y + len(b_bytes[b[j]]), j + 1
            if x == y:
                groups.append((p, q))
                p, q = [], []
        links = [(u, v) for p, q in groups for u in p for v in q]
        counts.update(set(links))
        rows.append((r["doc_id"], a, b, groups, links))
    best = {}
    for (u, _), n in counts.items():
        best[u] = max(best.get(u, 0), n)
    for i, a, b, groups, links in rows:
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        yield i, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if a else ""


def test_alignment(docs, monkeypatch):
    want = Counter(aligned(docs))
    assert Counter(map(tuple, align.align(docs, BYTE, PIECE).collect())) == want
    # batches of a document, few pairs broadcast, few chunks remembered
    monkeypatch.setattr(align, "CHARS", 1)
    assert Counter(map(tuple, align.align(docs, BYTE, PIECE, most=50).collect())) == want
    assert align.align(docs.limit(0), BYTE, PIECE).count() == 0
    assert Counter(map(tuple, align.align(docs, BYTE, PIECE, most=0).collect())) == want


def test_no_documents_with_tokens(docs):
    none = docs.where("text IS NULL OR text = ''")
    assert {tuple(r)[1:] for r in align.align(none, BYTE, PIECE).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def clustered(rows, clusters=40, rounds=5, size=64):
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return Counter()
    digest = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for j, g in groups.items():
            centroids[j] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    sums = Counter()
    for _, d, j in found:
        sums[j] += d
    return Counter((i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found)


@pytest.mark.parametrize("case", ["mixed", "ties", "few", "large", "none"])
def test_clusters(spark, case):
    rng = random.Random(4)
    vector = {
        "mixed": lambda: [rng.gauss(0, 1) + (k % 5) for k in range(64)],
        "ties": lambda: [float(rng.randrange(2)) if k < 3 else 0.0 for k in range(64)],
        "few": lambda: [rng.random() for _ in range(64)],
        "large": lambda: [rng.choice([1.0, -1.0, 5e4]) * rng.random() for _ in range(64)],
        "none": lambda: [1.0],
    }[case]
    rows = [(k, vector()) for k in range({"mixed": 400, "ties": 300, "few": 7, "large": 150, "none": 3}[case])]
    rows += [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [float("nan")] + [0.0] * 63), (1004, [float("inf")] + [0.0] * 63), (1005, [None] + [0.0] * 63)]
    if case == "mixed":
        rows += [rows[3], rows[3], (None, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).withColumn("id", F.lit("clash")).repartition(3)
    assert Counter(map(tuple, hamerly.report(df).collect())) == clustered(rows)


def test_bounds_keep_most_vectors_from_a_scan():
    rng = np.random.default_rng(3)
    centers = rng.integers(-2000, 2000, (12, 64))
    v = centers[rng.integers(0, 12, 3000)] + rng.integers(-60, 60, (3000, 64))
    before, scanned = centers + rng.integers(-30, 30, centers.shape), []
    cluster, upper, lower = hamerly.Step(before, None).scan(v)
    for _ in range(4):
        after = np.stack([v[cluster == j].sum(0) // max(1, (cluster == j).sum()) for j in range(12)])
        cluster, upper, lower, n = hamerly.Step(after, before).assign(v, cluster, upper, lower)
        assert (cluster == hamerly.squared(v, after).argmin(1)).all()
        d = np.sort(np.sqrt(hamerly.squared(v, after)), axis=1)
        assert (upper >= d[:, 0]).all() and (lower <= d[:, 1]).all()
        scanned.append(n)
        before = after
    assert sum(scanned) < 300


def test_squares_beyond_doubles():
    v = np.array([[1 << 27, -(1 << 27)] * 32, [(1 << 27) - 1, 5] * 32], dtype=np.int64)
    assert hamerly.squared(v, v[::-1]).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in v[::-1]] for x in v]


def test_a_chunk_that_is_not_given_back_costs_the_others_little():
    """Chunks are encoded together; before, one bad one among them had all encoded one by one."""
    both, calls = align.Sides(BYTE, PIECE), []
    learn = both._learn
    both._learn = lambda chunks: calls.append(len(chunks)) or learn(chunks)
    chunks = [f"w{k}" for k in range(1000)] + ["a▁b"]
    both.learn(chunks)
    assert both.known["a▁b"] is None and all(both.known[c] for c in chunks[:-1]) and len(calls) < 30


def test_aligned_rows_are_of_documents(spark):
    """A row holds one document's distinct pairs, not a batch's chunks and all their groups at once."""
    rows = align.described(spark.createDataFrame([(1, "of the of the of"), (2, None)], "doc_id long, text string").coalesce(1), BYTE, PIECE, "text", "doc_id").orderBy("id").collect()
    assert [(len(r["pairs"]), sorted(r["times"]), r["n_links"]) for r in rows] == [(2, [2, 3], 5), (0, [], 0)]
