"""Pairs of similar word sets against all pairs."""

import random
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.functions.text import token_set
from skein.operators import dedup


def all_pairs(rows, threshold, fresh=lambda i: True):
    sets = {i: set((t or "").lower().split()) for i, t in rows}
    out = {}
    for a in sets:
        for b in sets:
            if a > b and fresh(a) and sets[a] and sets[b]:
                both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
                if Fraction(both, union) > Fraction(threshold):
                    out[a, b] = round(both / union, 9)
    return out


def texts(seed, n=160):
    """Families around common texts, frequent words in all, sizes from one word to many."""
    r = random.Random(seed)
    common = ["the", "of", "and"]
    families = [[f"f{k}w{i}" for i in range(r.choice([1, 3, 19, 20, 21, 40, 100]))] for k in range(12)]
    rows = []
    for i in range(n):
        words = [w for w in r.choice(families) if r.random() < r.choice([1, 0.97, 0.8])] + r.sample(common, r.randint(0, 3)) + [f"own{i}"] * r.randint(0, 1)
        r.shuffle(words)
        rows.append((i, " ".join(words)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "THE of"), (n + 3, "the OF")]


@pytest.mark.parametrize(("seed", "threshold"), [(1, "0.95"), (2, "0.9"), (3, "0.75"), (4, "0.5"), (5, "1")])
def test_pairs_equal_brute_force(spark, seed, threshold):
    rows = texts(seed)
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = {(r.later, r.earlier): round(r.similarity, 9) for r in dedup.near_pairs(df, "id", threshold).collect()}
    assert got == all_pairs(rows, threshold) and (got or threshold == "1")


def test_only_fresh_rows_are_later(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BUCKETS", 4)
    rows = texts(6)
    df = spark.createDataFrame(rows, "id long, text string")
    got = {(r.later, r.earlier) for r in dedup.near_pairs(df, "id", "0.8", fresh=F.col("id") >= 80).collect()}
    assert got == set(all_pairs(rows, "0.8", lambda i: i >= 80)) and got


def kept_in_order(rows, threshold):
    """Rows that go when each row is compared with all kept ones before it."""
    kept, gone = [], set()
    for i, t in rows:
        words = set((t or "").lower().split())
        if any(t == u or (words and v and Fraction(len(words & v), len(words | v)) > Fraction(threshold)) for u, v in kept if t is not None):
            gone.add(i)
        else:
            kept.append((t, words))
    return gone


@pytest.mark.parametrize(("seed", "threshold", "eager"), [(7, "0.95", 4), (8, "0.6", 1), (9, "0.4", 0)])
def test_leaders_equal_one_row_after_another(spark, monkeypatch, seed, threshold, eager):
    monkeypatch.setattr(dedup, "EAGER", eager)
    rows = texts(seed)
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    expected = kept_in_order(rows, threshold)
    got = {r.id for r in dedup.leaders(df, "id", threshold).where("is_duplicate").collect()}
    assert got == expected and got
    cut = 90
    seen = df.where((F.col("id") < cut) & ~F.col("id").isin(list(expected)))
    assert {r.id for r in dedup.leaders(df.where(F.col("id") >= cut), "id", threshold, seen=seen).where("is_duplicate").collect()} == {i for i in expected if i >= cut}


def test_rows_of_equal_words_make_all_their_pairs(spark):
    rows = [(i, ["b a", "a B b", "c d"][i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, text string")
    assert {(r.later, r.earlier) for r in dedup.near_pairs(df, "id", "0.9", fresh=F.col("id") >= 7).collect()} == set(all_pairs(rows, "0.9", lambda i: i >= 7))


@pytest.mark.parametrize("size", [3, 1 << 20])
def test_large_buckets_are_dealt_over_groups(spark, monkeypatch, size):
    """Words go to a group once for each text, however many pairs it is in; all pairs are compared all the same."""
    monkeypatch.setattr(dedup, "GROUP_PAIRS", size)
    rng = random.Random(size)
    base = [f"w{i}" for i in range(30)]
    texts = [" ".join(w for w in base if rng.random() < 0.95) for _ in range(60)] + ["", "é ü", "ü é x", "a", "a a"]
    sets = [set(t.split()) for t in texts]
    want = [(j, i, round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 9)) for j in range(len(texts)) for i in range(j) if sets[i] and len(sets[i] & sets[j]) * 10 > len(sets[i] | sets[j]) * 9]
    got = dedup.near_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "0.9").collect()
    assert sorted((r.later, r.earlier, round(r.similarity, 9)) for r in got) == want and len(want) > 100


@pytest.mark.parametrize("alike", [True, False])
def test_leaders_write_no_pairs_by_the_square(spark, monkeypatch, alike):
    """Neither for a group of alike texts, nor for unlike ones of few words; no table of the job has many more rows than texts have signs."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([*base[: i % 100], f"own{i}", *base[i % 100 + 1 :]] if alike else rng.sample(base, 40)) for i in range(160)]
    written, write = {}, dedup.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(dedup.Scratch, "write", counted)
    rows = list(enumerate(texts))
    got = {r.id for r in dedup.leaders(spark.createDataFrame(rows, "id long, text string"), "id").where("is_duplicate").collect()}
    assert got == kept_in_order(rows, "0.95") and bool(got) == alike
    assert written and max(written.values()) < 16 * len(rows)


@pytest.mark.parametrize("threshold", ["0", "0.3", "0.5", "0.9", "0.95", "0.99"])
def test_sizes_of_similar_sets_and_parts_for_their_differences(threshold):
    limit = Fraction(threshold)
    starts = dedup.size_classes(limit, 130)
    of = [sum(s <= n for s in starts) - 1 for n in range(131)]
    for b in range(1, 131):
        for a in range(b, 131):
            if Fraction(b, a) > limit:
                assert of[a] - of[b] in (0, 1)
                most = max(d for d in range(a - b, a + b + 1) if Fraction(a + b - d, a + b + d) > limit)
                assert dedup.parts_of(limit, starts[of[a] + 1] - 1) > most


def test_seen_rows_take_no_pairs_by_the_square(spark, monkeypatch):
    """Of a second call on rows that are alike, which the first one's are compared with."""
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base[: i % 100], f"own{i}", *base[i % 100 + 1 :]])) for i in range(160)]
    written, write = {}, dedup.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(dedup.Scratch, "write", counted)
    df = spark.createDataFrame(rows, "id long, text string")
    got = dedup.leaders(df.where("id > 0"), "id", seen=df.where("id = 0")).where("is_duplicate").collect()
    assert {r.id for r in got} == kept_in_order(rows, "0.95") and len(got) > 100
    assert written and max(written.values()) < 16 * len(rows)


def test_words_are_split_as_by_the_expression(spark):
    """At every character that Java or Arrow may take for white space."""
    texts = ["a" + chr(i) + "b A" for i in [*range(1, 0x3100), 0xFEFF, 0x1D173]] + ["", " ", " \t", "b a\u3000b", "\u00a0", "\x1c"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {r.id: sorted(r.w) for r in df.select("id", token_set("text").alias("w")).collect()}
    for r in dedup._word_sets(df.withColumn("fresh", F.lit(True))).collect():
        assert (r.words.split(" ") if r.n else []) == want[r.id] and r.n == len(want[r.id]) and r.key
    assert [len(x) for x in dedup._split(pa.array([], pa.string()))] == [0, 0, 0]


def test_two_calls_split_texts_once_and_write_words_of_few_rows_again(spark, monkeypatch):
    """The second call takes what the first one kept as words; only words of rows that meet others are dealt again, in few jobs."""
    rng = random.Random(13)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:30], *base[31:], f"x{i}"] if i % 8 == 0 else [f"{rng.random()}" for _ in range(30)])) for i in range(160)] + [(160, None), (161, ""), (162, " ")]
    df = spark.createDataFrame(rows, "id long, text string")
    dealt, made = [], []
    bucketed, write, sets = dedup.Scratch.write_bucketed, dedup.Scratch.write, dedup._word_sets
    monkeypatch.setattr(dedup.Scratch, "write_bucketed", lambda self, df, n, key: (out := bucketed(self, df, n, key), dealt.append(out.count()))[0])
    monkeypatch.setattr(dedup.Scratch, "write", lambda self, df, name: (made.append(name), write(self, df, name))[1])
    split = []
    monkeypatch.setattr(dedup, "_word_sets", lambda df: (split.append(df.count()), sets(df))[1])
    every = dedup.word_sets(df, "id")
    first = dedup.leaders(every.where("id < 80"), "id", text_col=None)
    second = dedup.leaders(every.where("id >= 80"), "id", text_col=None, seen=first.where(~F.col("is_duplicate")).drop("is_duplicate"))
    found = first.unionByName(second).collect()
    assert {r.id for r in found if r.is_duplicate} == kept_in_order(rows, "0.95") | {162} and len(found) == len(rows)
    assert split == [len(rows)] and dealt and max(dealt) < 24 and len(made) < 30
