"""32-bit hashes and seeded numbers against plain Python."""

from pyspark.sql import functions as F

from graphloom.functions import hashing

LOW = 0xFFFFFFFF


def fnv(text):
    h = 2166136261
    raw = text.encode("utf-16-le")
    for k in range(0, len(raw), 2):
        h = (h ^ int.from_bytes(raw[k : k + 2], "little")) * 16777619 & LOW
    return h


def mulberry(seed, n):
    out, a = [], seed
    for _ in range(n):
        a = (a + 0x6D2B79F5) & LOW
        t = (a ^ a >> 15) * (1 | a) & LOW
        t = (t + ((t ^ t >> 7) * (61 | t) & LOW) & LOW) ^ t
        out.append((t ^ t >> 14) / 4294967296)
    return out


def test_hashes(spark):
    texts = ["", "a", "foobar", "file:src/é.ts", "😀 𝒳", "x" * 500]
    got = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", hashing.fnv1a(F.col("t")).alias("h")).collect()}
    assert got == {**{t: fnv(t) for t in texts}, None: None}
    assert got[""] == 2166136261 and got["a"] == 0xE40C292C and got["foobar"] == 0xBF9CF968


def test_seeded_numbers(spark):
    seeds = [0, 1, 2166136261, LOW, 0x80000000]
    rows = spark.createDataFrame([(s,) for s in seeds], "s long").select("s", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("n"))
    got = {(r["s"], r["n"]): r["v"] for r in rows.select("s", "n", hashing.seeded(F.col("s"), F.col("n")).alias("v")).collect()}
    assert got == {(s, k + 1): v for s in seeds for k, v in enumerate(mulberry(s, 50))}
