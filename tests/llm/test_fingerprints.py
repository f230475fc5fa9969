"""Bottom-k fingerprints against sets of shingles, and the edited texts against a plain loop."""

import hashlib
import random
import re
import struct

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from recallgrid.llm import fingerprints as fp

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"



def shingles(text, words=5):
    w = [w for w in re.split("[\x20\x09-\x0D]+", (text or "").lower()) if w]
    h = [struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(x.encode(), 42)))[0] for x in w]
    # xxhash64 of several columns feeds each hash on as the next seed.
    return {mixed_run(h[i:i + words]) for i in range(max(1, len(h) - words + 1))} if h else set()


def mixed_run(run):
    seed = 42
    for v in run:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return struct.unpack("<q", struct.pack("<Q", seed))[0]


def words(n, seed=1, vocabulary=5000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def sketches(spark, texts, k=fp.K):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.s for r in df.select("i", fp.sketch(F.col("text"), k).alias("s")).orderBy("i").collect()]


def test_sketch_is_the_least_hashes(spark):
    texts = ["", None, " \n\t ", "one", "One two", "a b c d e", "a b c d e f", " ".join(words(400)), "x " * 500, "word " * 30_000, "日本語 é Σ"]
    for text, got in zip(texts, sketches(spark, texts)):
        assert got == sorted(shingles(text))[:fp.K], text


def test_merge_of_parts_is_the_sketch_of_the_whole(spark):
    parts = [" ".join(words(200, s, 60)) for s in range(6)]
    df = spark.createDataFrame([(i % 2, p) for i, p in enumerate(parts)], "g int, text string").withColumn("sketch", fp.sketch(F.col("text")))
    got = {r.g: r.sketch for r in fp.merge_groups(df, "g").collect()}
    for g in (0, 1):
        assert got[g] == sorted(set().union(*(shingles(p) for p in parts[g::2])))[:fp.K]
    a, b = sketches(spark, parts[:2])
    pair = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    assert pair.select(fp.merge(F.col("a"), F.col("b"))).first()[0] == sorted(shingles(parts[0]) | shingles(parts[1]))[:fp.K]
    none = fp.merge_groups(df.filter("g = 5"), "g")
    assert none.count() == 0


def test_estimates(spark):
    base = words(2000, 7, 10 ** 6)
    rows = [(" ".join(base), " ".join(base[n:] + words(n, n, 10 ** 6))) for n in (0, 200, 1000, 1900)] + [("", ""), ("a b", ""), ("a b", "A  b")]
    df = spark.createDataFrame(rows, "x string, y string").select("x", "y", fp.sketch(F.col("x")).alias("a"), fp.sketch(F.col("y")).alias("b"))
    for r in df.select("x", "y", fp.resemblance(F.col("a"), F.col("b")).alias("j"), fp.containment(F.col("a"), F.col("b")).alias("c"),
                       fp.distinct_shingles(F.col("a")).alias("n")).collect():
        x, y = shingles(r.x), shingles(r.y)
        assert r.j == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0, abs=0.15)
        assert r.c == pytest.approx(len(x & y) / len(x) if x else 1.0, abs=0.2)
        assert r.n == pytest.approx(len(x), rel=0.3) and (len(x) >= fp.K or r.n == len(x))


def test_text_form_reads_back(spark):
    df = spark.createDataFrame([([-5, 0, 7, 2 ** 62],), ([],)], "s array<long>")
    got = df.withColumn("t", fp.to_text(F.col("s"))).withColumn("back", fp.from_text(F.col("t"))).collect()
    assert all(r.s == r.back for r in got) and got[0].t.startswith("fffffffffffffffb")


def edited(docs):
    """doc_id: sorted (n_chars, hash of the edited text, own set, edited set, next set) by a plain loop."""
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), hashlib.md5(
        (("-" if d[0] is None else str(d[0])) + "|" + (d[1] or "")).encode()).hexdigest()))
    out = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), text, new, after))
    return out


def near(x, y):
    x, y = shingles(x), shingles(y)
    least = sorted(x | y)[:fp.K]
    return sum(h in x and h in y for h in least) / len(least) if least else 1.0


@pytest.mark.parametrize("rows", [1, 3, 1_000_000])
def test_edited_likeness(spark, monkeypatch, rows):
    monkeypatch.setattr(fp, "ORDERED_ROWS", max(rows, 40) if rows == 1 else rows * 40)
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()[:150]
    docs += [(900001, None), (900002, ""), (900003, " \n "), (900004, "one"), (900004, "one"), (900004, "one"), (900005, "one"), (None, "no id 😀😀"),
             (None, "no id either"), (900006, "word " * 20_000), (900007, "x" * 9_999), (docs[0][0], "another text under that id"), docs[1]]
    frame = spark.createDataFrame(docs, SCHEMA).withColumn("key", F.lit("clash")).withColumn("next_key", F.lit(1)).repartition(5)
    got = fp.edited_likeness(frame).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    want = sorted(edited(docs), key=key)
    got = sorted(got, key=lambda r: key((r.doc_id, r.n_chars, r.edited_sha256)))
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in got] == [w[:3] for w in want]
    hexed = lambda t: "".join(f"{h & (2 ** 64 - 1):016x}" for h in sorted(shingles(t))[:fp.K])
    for r, (_, _, _, text, new, after) in zip(got, want):
        assert r.fingerprint == hexed(text) and r.edited_fingerprint == hexed(new)
        assert r.near_edited == pytest.approx(near(text, new)) and r.near_next == pytest.approx(near(text, after))


def test_edited_likeness_of_few_rows(spark):
    assert fp.edited_likeness(spark.createDataFrame([], SCHEMA)).collect() == []
    one = fp.edited_likeness(spark.createDataFrame([(7, "a b c d e f")], SCHEMA)).first()
    assert (one.near_next, one.n_chars, one.edited_sha256) == (1.0, 11, hashlib.sha256(b"a b c a b c"[:6] + b"a b c").hexdigest())
    same = fp.edited_likeness(spark.createDataFrame([(1, "q r")] * 4, SCHEMA)).collect()
    assert len(same) == 4 and {r.near_next for r in same} == {1.0}
    assert fp.fingerprints(spark.createDataFrame([(1, None), (None, "a")], SCHEMA)).count() == 2


def test_no_python_worker(spark):
    df = fp.edited_likeness(spark.createDataFrame([(7, "a b c d e f"), (8, "a")], SCHEMA))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
