"""Near copies at a five-word similarity of 0.8, against brute force over all pairs."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from heddle.llm import near_copies, simhash


def brute_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return not a | b or 5 * len(a & b) >= 4 * len(a | b)


def brute_kept(rows):
    sets = {t: brute_shingles(t) for _, t in rows}
    group = {t: t for t in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    texts = list(sets)
    for k, a in enumerate(texts):
        for b in texts[:k]:
            if similar(sets[a], sets[b]):
                group[find(a)] = find(b)
    least = {}
    for i, t in rows:
        if i is not None:
            least[find(t)] = min(i, least.get(find(t), i))
    return {t: least.get(find(t)) for t in texts}


def make_rows():
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(400)]
    rows = []
    for base in range(25):
        words = rnd.choices(vocabulary, k=rnd.choice([6, 30, 150, 700]))
        for copy in range(12):  # from nearly equal to well below the least similarity
            edited = list(words)
            for _ in range(len(words) * copy // 600 + (copy > 0)):
                edited[rnd.randrange(len(edited))] = "zz%d" % rnd.randrange(10**6)
            rows.append((base * 100 + copy, " ".join(edited)))
    return rows + [(9000, ""), (9001, None), (9002, " \n"), (9003, "one two"), (9004, "One  two"), (None, "one two"), (9003, "one two")]


def test_pipeline_stage_drops_near_copies_of_similarity_0_8(spark):
    rows = make_rows()
    rnd = random.Random(3)
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    least = brute_kept(rows)
    assert 25 < len(set(least.values())) < 250  # some copies link and some don't
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(least.values()))
    assert sum(r["doc_id"] is None for r in kept) == 1


def test_different_texts_under_one_id_stay(spark):
    words = [f"w{k}" for k in range(60)]
    a, b, c = " ".join(words), " ".join(reversed(words)), " ".join(words[::2] + words[1::2])
    rows = [(1, a), (5, a), (5, b), (5, b), (5, c), (7, c + " end")]
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([(1, a), (5, b), (5, c)])


def test_simhash_keep_one_tells_texts_of_one_id_apart(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(80)) for c in "ab")
    rows = [(1, a), (5, a), (5, b), (5, b), (7, b)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([(1, a), (5, b)])


def test_simhash_proposes_near_copies_that_are_verified(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BANDS", 1)
    monkeypatch.setattr(near_copies, "band_keys", lambda hashes: __import__("numpy").array([len(hashes)]))
    words = [f"w{k}" for k in range(900)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, " ".join(words[:450]))]
    found = near_copies.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 1, 3: 3}


def edited_group(n):
    """Copies of one text, most some 0.58 alike: five words replaced, or few, or some more on top of another copy."""
    rnd = random.Random(11)
    base = ["w%d" % rnd.randrange(10**6) for _ in range(150)]
    rows, before = [], base
    for k in range(n):
        words = list(before if k % 10 == 9 else base)
        for at in rnd.sample(range(150), 1 if k % 10 in (8, 9) else 5):
            words[at] = "z%d" % rnd.randrange(10**6)
        if k % 7 == 6:
            del words[:2]
        rows.append((k, " ".join(words)))
        before = words
    return rows


def test_crowded_near_copies_meet_by_prefixes(spark, monkeypatch):
    compared, verified = [], near_copies._verified

    def counting(pairs, sets):
        compared.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(near_copies, "_verified", counting)
    rows = edited_group(300)
    found = near_copies.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    least = brute_kept(rows)
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: least[t] for i, t in rows}
    assert 100 < len(set(least.values())) < 280
    assert sum(compared) < 10_000  # 34,395 when all that shared a bucket were compared


def test_prefixes_of_similar_sets_meet():
    rnd = np.random.default_rng(4)
    whole = rnd.integers(0, 2**64, 400, np.uint64)
    sets = []
    for size in (1, 2, 3, 5, 9, 40, 200, 380):
        for _ in range(12):
            base = whole[:size] if rnd.integers(2) else rnd.choice(whole, size, replace=False)
            sets.append(np.unique(np.concatenate([base[rnd.random(size) > rnd.choice([0, 0.05, 0.1])], rnd.integers(0, 2**64, int(size * rnd.choice([0, 0.05, 0.1])), np.uint64)])))
    slots, n = np.unique(np.concatenate([near_copies._slots(x) for x in sets]), return_counts=True)
    slots, counts = slots[n > 1], np.concatenate([[1], n[n > 1]])
    met = []
    for x in sets:
        own, keys = near_copies.prefixes(x, slots, counts)
        met.append((own, set(keys)))
    seen = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(np.intersect1d(x, y))
            if both and 5 * both >= 4 * (len(x) + len(y) - both):
                seen += 1
                (a, p), (b, q) = met[i], met[j]
                assert {s for s, c in p if c == b} & {s for s, c in q if c == a}
    assert seen > 50
