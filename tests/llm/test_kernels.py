"""Kernels against brute force, without Spark."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle.llm import decontaminate, language_id, ngram_lm, packing, quality_rules, simhash, suffix_dedup, toxicity, url_filter
from heddle.llm.elias_fano import EliasFano, quantise

TEXTS = ["", " ", "one", "a b c", "The  CAT\tsat\non the mat", "é ß İ ǅ", "x" * 3000, "a b " * 900, "no\x0bwhite\x0cspace\x1chere\xa0there", "日本語 text", "<|endoftext|> it's 1²3", "é combining"]


@given(st.lists(st.integers(0, 2**63), max_size=200))
@settings(max_examples=60, deadline=None)
def test_elias_fano_access_and_search(values):
    values = np.sort(np.array(values, np.uint64))
    sequence = EliasFano.build(values)
    if len(values):
        assert (sequence[np.arange(len(values))] == values).all()
    asked = np.unique(np.concatenate([values, values + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)]))
    first = {int(v): k for k, v in reversed(list(enumerate(values)))}
    assert sequence.find(asked).tolist() == [first.get(int(v), -1) for v in asked]


def test_quantised_values_stay_close():
    values = np.random.default_rng(0).normal(size=5000)
    codes, book = quantise(values)
    assert np.abs(book[codes] - values).mean() < 0.05


def test_tokens_split_like_the_contract():
    texts = [*TEXTS, None, "", " a", "b \x0b\x0cC\x1cd\u2003E ", "\n"]
    words, codes, sizes = ngram_lm.encoded(pa.array(texts))
    at = 0
    for text, size in zip(texts, sizes):
        lowered = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
        assert [words[k] for k in codes[at : at + size]] == re.findall(rb"[^\x20\x09-\x0D]+", lowered) + [ngram_lm.END]
        at += size


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) & (2**64 - 1) == brute_fingerprint(text)


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    hit = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("text", [*TEXTS, "l1\nl2\nl1\n \n \nl1", "w " * 9, "a b c d e f g h i a b c d e f g h", "a b c d e f g h a b c d e f g h"])
def test_statistics(text):
    s = dict(zip(quality_rules.STATISTICS, quality_rules.statistics_of(text.encode(), len(text))))
    assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"]) == brute_statistics(text)


def test_decision_list_learns_a_threshold_and_leaves_good_rows():
    rng = np.random.default_rng(0)
    table = {name: rng.integers(50, 100, 600) for name in quality_rules.STATISTICS}
    bad = np.arange(600) % 5 == 0
    table["n_symbols"] = np.where(bad, 80, 1)
    rules = quality_rules.learn(table, bad)
    matrix = np.column_stack([f.values(table) for f in quality_rules.FEATURES])
    hit = np.logical_or.reduce([quality_rules._covers(r, matrix) for r in rules])
    assert (hit == bad).all()
    assert quality_rules.learn(table, np.zeros(600, bool)) == []
    assert quality_rules.learn({k: v[:0] for k, v in table.items()}, bad[:0]) == []


def brute_removed(docs):
    seen, out = set(), []
    for text in docs:
        marks = np.zeros(len(text), bool)
        for p in range(len(text) - 99):
            if text[p : p + 100] in seen:
                marks[p : p + 100] = True
            seen.add(text[p : p + 100])
        out.append(marks)
    return out


def local_removed(docs, crowd):
    """The operator's kernels, in one process."""
    ids = np.arange(len(docs))
    keys = suffix_dedup.doc_keys(ids, docs)
    parts = []
    for text, at, low, high, own, triple, check in suffix_dedup.sampled(docs):
        rows = np.empty(len(own), suffix_dedup.SAMPLE)
        for name, values in (("anchor", own), ("triple", triple), ("check", check), ("doc", ids[text]), ("key", keys[text]), ("at", at), ("low", low), ("high", high)):
            rows[name] = values
        parts.append(rows)
    # two tasks settle what they can, then the shard compares the rest
    half = [np.concatenate([np.empty(0, suffix_dedup.SAMPLE), *parts[k::2]]) for k in range(2)]
    rows = np.concatenate(half)
    half = rows[: len(rows) // 2], rows[len(rows) // 2 :]
    sent = [suffix_dedup.combine_triples(h, crowd) for h in half]
    again, unsure = suffix_dedup.compare_triples(np.concatenate([x[0] for x in sent]))
    again, unsure = np.concatenate([again, *[x[1] for x in sent]]), np.concatenate([unsure, *[x[2] for x in sent]])
    strings = []
    for r in unsure:
        text = docs[int(r["doc"])]
        for p in range(r["low"], r["high"] + 1):
            name, check = (suffix_dedup.Names(np.frombuffer(text[p : p + 100], np.uint8), which)(np.array([0]), np.array([100]))[0] for which in (0, 1))
            strings.append((name, check, r["doc"], r["key"], p))
    strings = np.array(strings, suffix_dedup.STRING)
    sent = [suffix_dedup.combine_strings(h) for h in (strings[::2], strings[1::2])]
    more = np.concatenate([suffix_dedup.compare_strings(np.concatenate([x[0] for x in sent])), *[x[1] for x in sent]])
    ranges = np.concatenate([suffix_dedup._ranges(again), suffix_dedup._ranges(more)])
    out = []
    for text, key in zip(docs, keys):
        marks = np.zeros(len(text), bool)
        own = ranges[ranges["key"] == key]
        for a, b in suffix_dedup.united(own["low"], own["high"]) if len(own) else []:
            marks[a:b] = True
        out.append(marks)
    return out


@pytest.mark.parametrize("crowd", [0, 1, 64])
@pytest.mark.parametrize("piece", [350, 1 << 17])
def test_repeated_strings(piece, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rnd = random.Random(3)
    for _ in range(6):
        base = bytes(rnd.choices(b"abcdefgh  ", k=600))
        docs = []
        for _ in range(10):
            text = bytearray(base if rnd.random() < 0.7 else bytes(rnd.choices(b"ab", k=300)))
            for _ in range(rnd.choice([0, 0, 1, 3])):
                text[rnd.randrange(len(text))] = rnd.choice(b"xyz")
            a = rnd.randrange(500)
            text += text[a : a + rnd.choice([0, 99, 100, 101, 150])] + b" " * rnd.choice([0, 99, 100, 250])
            docs.append(bytes(text)[rnd.randrange(100) :])
        docs = [d for k, d in enumerate(docs) if d not in docs[:k]] + [b"", b"x" * 99]
        for got, want in zip(local_removed(docs, crowd), brute_removed(docs)):
            assert (got == want).all()


def test_packing_equals_the_tokenizer():
    words = packing.word_ids(packing.tokenizer_path())
    for text in TEXTS + ["It's the cat's, they'll don't 12ab³ ½x", "tab\tnew\nline   sp", "ünïcödé-ÆØÅ …", "a_b__c", "CAPS'S"]:
        assert words.ids_of(text) == words.whole(text)


def test_packing_equals_the_tokenizer_where_lower_case_leaves_the_range():
    words = packing.word_ids(packing.tokenizer_path())
    for text in ["ƁAƊO YA ZO", "Ɗan kasuwa", "Əli and", "İstanbul", *(f"x{chr(c)}Y z" for c in range(0xA1, 0x250))]:
        assert words.ids_of(text) == words.whole(text), text


def test_packing_equals_the_tokenizer_on_random_strings():
    words, rnd = packing.word_ids(packing.tokenizer_path()), random.Random(5)
    texts = ["Əla gün"]
    for top in (0x7F, 0x250, 0x1F00):
        letters = [chr(c) for c in range(0x20, top)]
        texts += ["".join(rnd.choices(letters, k=rnd.randrange(1, 14))) + " " + "".join(rnd.choices(letters[:224], k=4)) for _ in range(7000)]
    assert [t for t in texts if words.ids_of(t) != words.whole(t)] == []


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
@settings(max_examples=80, deadline=None)
def test_plan_uses_every_piece_once_and_fits(histogram):
    used = {}
    sequences = 0
    for lengths, times in packing.plan(dict(histogram), 64):
        assert 0 < sum(lengths) <= 64 and times > 0
        sequences += times
        for size in lengths:
            used[size] = used.get(size, 0) + times
    assert used == histogram
    total = sum(k * n for k, n in histogram.items())
    assert sequences <= max(1, 2 * -(-total // 64))


def test_plan_replaces_the_smallest_with_two():
    # greedy would take 60 + 3; two pieces of 2 fill the gap of 4 exactly
    patterns = packing.plan({60: 1, 3: 1, 2: 2}, 64)
    assert ([60, 2, 2], 1) in patterns


def test_bloom_has_no_false_negatives_and_few_false_positives():
    keys = [f"k{k}" for k in range(5000)]
    bloom = url_filter.BlockedBloom.build(url_filter.key_hashes(keys))
    assert bloom.may_hold(url_filter.key_hashes(keys)).all()
    assert bloom.may_hold(url_filter.key_hashes([f"x{k}" for k in range(20000)])).mean() < 0.02


def test_containment_search_finds_all_and_only():
    rnd = random.Random(1)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 3, 5, 9, 30, 60])))) for k in range(60)] + [(60, ""), (61, None), (0, "w1")]
    index = decontaminate.ItemIndex(items)
    for _ in range(60):
        words = rnd.choices(vocabulary, k=400)
        for _, text in rnd.sample(items[:60], 4):
            own = text.split()
            if len(own) > 6 and rnd.random() < 0.5:
                own[rnd.randrange(len(own))] = "zz"
            at = rnd.randrange(300)
            words[at : at + len(own)] = own
        text = " ".join(words)
        want = set()
        for item_id, t in set(items):
            q = decontaminate.shingles_of(decontaminate.words_of(t))
            span = len(next(iter(q))) if q else 0
            held = {tuple(words[k : k + span]) for k in range(len(words) - span + 1)}
            if q and 10 * len(q & held) >= 8 * len(q):
                want.add((item_id, len(q), len(q & held)))
        assert set(index.search(text)) == want


def test_language_model_backs_off():
    model = language_id.BackoffModel([("en", "the", 50), ("en", "thing", 9), ("de", "der", 50), ("de", "schön", 9)])
    scorer = language_id.Scorer(model)
    assert scorer.predict("THE thingy")[0] == "en" and scorer.predict("schöner")[0] == "de"
    assert scorer.predict(None) == ("und", 0.0) and scorer.predict("12 !!")[0] == "und"
    assert language_id.Scorer(language_id.BackoffModel([])).predict("x") == ("und", 0.0)


def test_toxicity_generalises_to_misspellings():
    rnd = random.Random(2)
    clean = ["".join(rnd.choices("abdefhiklnrstuw", k=rnd.randrange(2, 9))) for _ in range(600)]
    texts, labels = [], []
    for k in range(500):
        words = rnd.choices(clean, k=rnd.randrange(3, 120))
        if k % 5 == 0:
            words[rnd.randrange(len(words))] = rnd.choice(["grobian", "schurke", "halunke"])
        texts.append(" ".join(words))
        labels.append(int(k % 5 == 0))
    model = toxicity.train(texts[:400], np.array(labels[:400]))
    scorer = toxicity.Scorer(model)
    held = [(scorer.score(t) >= toxicity.THRESHOLD) == bool(y) for t, y in zip(texts[400:], labels[400:])]
    assert np.mean(held) > 0.95
    assert scorer["schurkke"] > max(scorer[w] for w in clean)
    assert 0 <= scorer.score(None) <= 1 and toxicity.Scorer(toxicity.train(["a"], np.array([1]))).score("a") == 0.0
