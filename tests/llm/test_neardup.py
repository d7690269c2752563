"""Near-duplicate groups and their parts against brute force."""

import collections
import random
import re

import numpy as np

from paperloom.llm import neardup
from paperloom.llm.common import components
from paperloom.llm.shingles import bags, shingle_hashes, word_hashes

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def bag(text):
    words = WORD.findall((text or "").encode())
    if len(words) < 5:
        return collections.Counter([tuple(words)] if words else [])
    return collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def brute_groups(rows, threshold=0.8):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        first.setdefault(t or "", i)
    parent = {i: i for i in first.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids, held = list(parent), {i: bag(t) for t, i in first.items()}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if jaccard(held[i], held[j]) >= threshold:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(first[t or ""]) for i, t in rows}


def words(rng, n, pool=4000):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def test_shingles_agree_with_words():
    texts = [b"", b"  ", b"one", b"a b c d", b"a b c d e", b"a\tb\nc  d e a b c d e", "é ü ñ ß ø é".encode()]
    hashes, n = shingle_hashes(texts)
    assert n.tolist() == [0, 0, 1, 1, 1, 6, 2]
    assert word_hashes(texts)[1].tolist() == [0, 0, 1, 4, 5, 10, 6]
    owner, shingle, weight = bags(texts)
    assert shingle[owner == 4][0] in shingle[owner == 5] and weight[owner == 5].sum() == 6
    assert sorted(weight[owner == 5].tolist()) == sorted(bag(texts[5].decode()).values())


def test_shingles_do_not_depend_on_the_batch():
    rng = random.Random(1)
    texts = [" ".join(words(rng, rng.randrange(60))).encode() for _ in range(40)]
    whole, n = shingle_hashes(texts)
    assert np.array_equal(whole, np.concatenate([shingle_hashes([t])[0] for t in texts]))


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(2)
    errors = []
    for _ in range(60):
        common = words(rng, 60)
        a = common + words(rng, rng.randrange(60)) + common[: rng.randrange(40)]
        b = common * rng.randrange(1, 4) + words(rng, rng.randrange(60))
        one, two = " ".join(a), " ".join(b)
        registers, _ = neardup.signatures([one.encode(), two.encode()], 1024)
        errors.append((registers[0] == registers[1]).mean() - jaccard(bag(one), bag(two)))
    assert abs(np.mean(errors)) < 0.006 and np.std(errors) < 0.025


def test_signatures_do_not_depend_on_the_batch_or_bound():
    texts = [b"a b c d e f g", b"x", b"", b"p q r s t u v w " * 200]
    whole, full = neardup.signatures(texts)
    assert full.tolist() == [True, True, False, True]
    for k in (0, 1, 3):
        assert np.array_equal(neardup.signatures([texts[k]])[0][0], whole[k])
    assert np.isfinite(whole[[0, 1, 3]]).all()


def corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", " ", "one two", "one two", "  one two"]
    for _ in range(12):
        base = words(rng, rng.choice((12, 60, 300)))
        for _ in range(rng.choice((1, 2, 9))):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = f"e{rng.random()}"
            texts.append(" ".join(copy))
    base = words(rng, 120)
    for k in range(60):  # a family whose members are mostly just below the threshold to each other
        copy = list(base)
        for _ in range(2 + k % 4):
            copy[rng.randrange(len(copy))] = f"f{rng.random()}"
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 30
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


def test_groups_equal_brute_force(spark):
    for seed in (3, 4):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, "clash", "x") for i, t in rows], "doc_id long, text string, bucket string, digest string")
        got = {r["doc_id"]: r["group_id"] for r in neardup.near_groups(docs).collect()}
        assert got == brute_groups(rows)
        kept = sorted(r["doc_id"] for r in neardup.keep_one(docs).collect())
        assert kept == sorted(set(got.values())) and neardup.keep_one(docs).columns == docs.columns


def test_small_blocks_lose_no_link(spark):
    rows = [(i, t) for i, t in corpus(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links = neardup.family_links
    try:
        neardup.family_links = lambda *a: links(*a, block=5)
        got = {r["doc_id"]: r["group_id"] for r in neardup.near_groups(docs).collect()}
    finally:
        neardup.family_links = links
    assert got == brute_groups(rows)


def test_nothing_one_and_repeats(spark):
    assert neardup.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "z")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["group_id"]) for r in neardup.near_groups(rows).collect()) == [(1, 1), (1, 1), (2, 2)]
    assert sorted(r["doc_id"] for r in neardup.keep_one(rows).collect()) == [1, 2]


def test_components_of_a_path_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 130)) and got[200] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_repeated_id_loses_no_link(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, c), (4, c), (1, b)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted((r["doc_id"], r["group_id"]) for r in neardup.near_groups(docs).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)]
    kept = sorted((r["doc_id"], r["text"]) for r in neardup.keep_one(docs).collect())
    assert [i for i, _ in kept] in ([1, 2, 4], [1, 3, 4]) and kept[2] == (4, c)


def test_columns_with_the_names_used_inside(spark):
    rng = random.Random(10)
    a = " ".join(words(rng, 40))
    docs = spark.createDataFrame([(1, a, 5, "r", "k"), (2, a, 6, "s", "l")], "doc_id long, text string, key int, row string, id string")
    assert sorted((r["doc_id"], r["group_id"]) for r in neardup.near_groups(docs).collect()) == [(1, 1), (2, 1)]
    assert [tuple(r) for r in neardup.keep_one(docs).collect()] == [(1, a, 5, "r", "k")]
    assert neardup.keep_one(docs.limit(0)).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(11)
    base = words(rng, 60_000, 30_000)
    near = list(base)
    for k in range(0, len(near), 60):
        near[k] = "edited"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(words(rng, 60_000, 30_000))), (4, " ".join(base[:50_000]))]
    assert brute_groups(rows) == {r["doc_id"]: r["group_id"] for r in neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_members_inside_do_not_meet_each_other(spark):
    """One member outside a large component meets all of it, and no other pair is dealt."""
    rng = random.Random(12)
    base = words(rng, 100)
    rows = [(1, " ".join(base))] + [(10 + k, " ".join([*base, f"t{k}"])) for k in range(40)]
    out = list(base)
    for k in range(0, 100, 12):
        out[k] = f"o{k}"
    rows.append((99, " ".join(out)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    close = spark.createDataFrame([(1, k, 0.9, 97) for k in range(10, 50)] + [(1, 99, 0.5, 96)], "a long, b long, similarity double, size_b long")
    groups = spark.createDataFrame([(1, 1)] + [(k, 1) for k in range(10, 50)], "node long, component long")
    scratch = neardup.Scratch(spark)
    links = neardup.family_links(close, groups, docs, 0.8, scratch, block=8).collect()
    dealt = spark.read.parquet(next(p for p in scratch.paths if "/dealt-" in p))
    assert links == []
    assert dealt.filter("doc_id <> 99").count() == dealt.filter("doc_id <> 99").select("unit", "doc_id").distinct().count()
    scratch.drop()
