"""The text operators against brute force, on small and awkward tables."""

import collections
import hashlib
import json
import math
import random
import re
import string
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinshot.llm import containment, html, langid, minhash, quality, queries, secrets, store, substrings, urls, words
from twinshot.llm.bpe import Bpe, encode_decode
from twinshot.llm.components import components
from twinshot.llm.containment import contained_items, decontaminated
from twinshot.llm.tokens import Counter, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
VOCABULARY = queries.vocabulary()


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    store.ship(spark)


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "ou", "re", "st", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base, passage = prose(rng, 200), prose(rng, 60)
    out = [None, "", " \t\n", "word", "two words", "a b c d e", base, base, base.upper(), "  " + base.replace(" ", "\n")]
    for _ in range(12):  # near copies
        w = base.split()
        for _ in range(rng.randint(1, 8)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        out.append(" ".join(w))
    out += [prose(rng, 30) + " " + passage + " " + prose(rng, 40) for _ in range(6)]
    out += ["the same words " * 60, passage, passage + " " + passage, prose(rng, 34), prose(rng, 35), "x" * 5000]
    out += [prose(rng, 5000), prose(rng, 3000) + " " + passage]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "x", i, "y") for i, t in enumerate(texts)]
    # Names that the operators use inside must not clash.
    return spark.createDataFrame(rows, "doc_id long, text string, bands string, a long, packed string").repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def split(t):
    return WORD.findall(t or "")


def shingle_set(t, n):
    w = split((t or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_words_and_shingles(texts):
    column = pa.array(["zero", *texts, "last"]).slice(1, len(texts))
    found = words.Words(column, lower=True)
    doc, h = words.shingles(found, 4)
    assert found.counts.tolist() == [len(split(t)) for t in texts]
    assert np.bincount(doc, minlength=len(texts)).tolist() == [len(shingle_set(t, 4)) for t in texts]
    assert [found.words_of(i).decode() for i in range(len(texts))] == [" ".join(split((t or "").translate(LOWER))) for t in texts]
    long = words.Words(pa.array(["ab " * 800_000 + "c"]))  # longer than a block of the hashes
    hashes = long.hashes()
    assert len(set(hashes[:-1].tolist())) == 1 and len(set(words.ngram_hashes(hashes, 35).tolist())) == 2


def brute_repeats(texts, length):
    count = collections.Counter(tuple(w[p : p + length]) for w in map(split, texts) for p in range(len(w) - length + 1))
    out = []
    for w in map(split, texts):
        gone = set()
        for p in range(len(w) - length + 1):
            if count[tuple(w[p : p + length])] > 1:
                gone.update(range(p, p + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), kept))
    return out


@pytest.mark.parametrize("length", [35, 12])
def test_substring_dedup(docs, texts, none, length):
    got = {r.doc_id: r for r in substrings.remove_repeats(docs, length=length).collect()}
    for i, (n, gone, kept) in enumerate(brute_repeats(texts, length)):
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_text) == (n, gone, kept), i
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert sum(s.stop - s.begin for s in r.repeats) == gone
    assert substrings.remove_repeats(none).count() == 0


def brute_components(texts, n):
    sets = [shingle_set(t, n) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_near_duplicates(spark, docs, texts, none):
    want = brute_components(texts, 4)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, shingle_words=4).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == want
    assert all(got[i].kept == (c == i) for i, (_, c) in enumerate(want))
    assert minhash.near_duplicates(docs.union(docs), shingle_words=4).count() == 2 * len(texts)
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    five = brute_components(texts, 5)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, (_, c) in enumerate(five) if c == i]


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A group whose copies are linked in a chain, compared in blocks and not by a join."""
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 1)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(2)
    w = prose(rng, 120).split()
    texts = []
    for k in range(40):
        if k % 2:
            w[(7 * k) % 120] = f"new{k}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, shingle_words=4).collect()}
    assert [got[i] for i in range(40)] == [c for _, c in brute_components(texts, 4)]


def test_b_bit_estimate():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    for overlap in (300, 1500, 2700):
        y = np.sort(np.r_[x[:overlap], rng.integers(0, 1 << 63, 3000 - overlap, dtype=np.uint64)])
        packed = [minhash.pack(minhash.minima(np.zeros(len(v), int), np.sort(v), 1, minhash.MINIMA)) for v in (x, y)]
        a, b = (p.view(np.uint64)[0] for p in packed)
        assert abs(minhash.estimate(minhash.agreeing(a, b)) - overlap / (6000 - overlap)) < 0.06
    assert minhash.least_agreeing(0.8) < minhash.MINIMA * (0.25 + 0.75 * 0.8)


def test_short_near_copies_are_linked(spark):
    """Texts of 5 to 30 shingles, at the similarity asked for exactly and just below it."""
    rng = random.Random(8)
    texts, linked = [], []
    for i in range(2400):
        shared = 4 * rng.randint(1, 6)
        words_of = [f"w{i}x{k}" for k in range(shared + 3)]
        other = [f"v{i}x{k}" for k in range(shared // 4 + 1)]
        # shared 4-word shingles, and a quarter of them more (or one above that) on one side only
        more = shared // 4 + (i % 2)
        texts += [" ".join(words_of), " ".join(words_of + other[:more])]
        linked.append(100 * shared >= 80 * (shared + more))
        assert len(shingle_set(texts[-1], 4)) == shared + more
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, shingle_words=4).collect()}
    missed = [i for i, want in enumerate(linked) if (got[2 * i + 1] == 2 * i) != want]
    assert 1000 < sum(linked) < 1400 and missed == []


def test_least_agreeing_against_draws():
    """The share of pairs at the similarity that stay below the count is the bound asked for."""
    rng = np.random.default_rng(2)
    c = 2.0**-minhash.BITS
    for similarity, miss in ((0.8, 1e-2), (0.8, 1e-3), (0.9, 1e-2)):
        agreed = rng.binomial(minhash.MINIMA, c + (1 - c) * similarity, 400_000)
        assert np.mean(agreed < minhash.least_agreeing(similarity, miss)) <= miss * 1.2


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7), (1, 0), (1, 0)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_secret_scan(spark):
    base = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
        ("hex", re.compile("[0-9a-f]+"), 0, 16),
    ]
    rng = random.Random(4)
    pieces = ["token=", "Secret: ", "apikey = '", "API_KEY\":\"", "AKIA", "é", " ", "\n", "'", "password", "=", "ABCDEFGH1234", "0123456789abcdef"]
    texts = [None, "", "token=token=abcdefghijkl", "token=secret:abcdefghijklm", "AKIA" + "A" * 13, "AKIA" + "A" * 14, "f" * 15, "f" * 16]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32))
    texts += [f"x {key} y", "id 123e4567-e89b-12d3-a456-426614174000", "snake_case_name_of_2024_report", "example" + key, "ABCDEF0123456789ABCDEF01234"]
    frame = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in secrets.scan(frame).collect()}
    for i, t in enumerate(texts):
        want = sorted(
            (m.start(), k, m.end())
            for k, (_, p, g, least) in enumerate(base)
            for m in p.finditer(t or "")
            if len(m[g]) >= least
        )
        assert [(s.start, s.kind, s.end) for s in got[i].base_spans] == want, t
        assert set(got[i].base_spans) <= set(got[i].spans)
    added = {i: [secrets.KINDS[s.kind] for s in r.spans if s.kind > 2] for i, r in got.items() if len(r.spans) > len(r.base_spans)}
    n = len(texts)
    assert added[n - 5] == ["entropy_base64"] and added[n - 1] == ["entropy_hex"]
    assert not {n - 4, n - 3, n - 2} & set(added)


def test_secret_candidates_of_letters_alone(spark):
    rng = random.Random(6)
    keys = ["".join(rng.choice(string.ascii_letters) for _ in range(40)) for _ in range(40)]
    names = ["getTheNumberOfOpenFileHandles", "THE_LONGEST_CONSTANT_OF_ALL", "internationalization-and-localization", "/usr/local/share/doc/packages", "AbstractSingletonProxyFactoryBean"]
    frame = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(keys + names)], "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in secrets.scan(frame).collect()}
    assert [found[i] for i in range(40)] == [[(4, 44)]] * 40
    assert [found[40 + i] for i in range(len(names))] == [[]] * len(names)


def test_secret_scan_of_very_long_strings(spark):
    """A megabyte of one candidate, or of many, neither overflows the matcher's stack nor takes long."""
    rng = random.Random(7)
    symbols = secrets.CLASSES["entropy_base64"][0]
    long = [
        "ab-1-" * 200_000,
        "a" * 1_000_000,
        "aB" * 500_000,
        "1/" * 500_000,
        "0123456789abcdef" * 62_500,
        "-" * 1_000_000,
        "token=" + "x" * 1_000_000,
        "AKIA" + "A1" * 500_000,
        "".join(rng.choice(symbols) for _ in range(1_000_000)),
        "token = '" * 110_000,
    ]
    frame = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string").repartition(8)
    found = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in secrets.scan(frame).collect()}
    assert [found[i] for i in (0, 2, 3, 5, 9)] == [[]] * 5
    assert found[1] == [(0, 2, 1_000_000)] and found[4] == [(0, 2, 1_000_000)] and found[6] == [(0, 0, 1_000_006)] and found[7] == [(0, 1, 1_000_004)]
    assert found[8] == [(0, 4, 1_000_000)]


def test_peak_entropy(spark):
    symbols = secrets.CLASSES["entropy_base64"][0]
    rng = random.Random(8)
    values = ["".join(rng.choice(symbols[:k]) for _ in range(rng.randint(1, 60))) for k in (2, 5, 20, 60) for _ in range(5)]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    for r in frame.select("v", secrets.peak_entropy(F.col("v"), symbols).alias("bits")).collect():
        windows = [r.v[i : i + secrets.WINDOW] for i in range(len(r.v) - secrets.WINDOW + 1)]
        want = max((-sum(c / len(w) * math.log2(c / len(w)) for c in collections.Counter(w).values()) for w in windows), default=-1)
        assert abs(r.bits - want) < 1e-9


def test_masked(spark):
    rows = [(1, "a token=abcdefghijklmnop b", 26), (2, None, None), (3, "é", 1), (4, "token=0123456789abcdef0", 23)]
    out = secrets.masked(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"))
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "a [SECRET] b", 12), (2, None, None), (3, "é", 1), (4, "[SECRET]", 8)]


def brute_rules(t):
    t = t or ""
    w = split(t)
    count = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    gone = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [line for line in t.split("\n") if WORD.search(line)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(gone)


def test_quality(spark, docs, texts, none):
    extra = ["a\nb\na\n \n \n", "é# *|", "x\ny\nx \nx"]
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    got = {r.doc_id: r for r in quality.rule_counts(more).collect()}
    for i, t in [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(extra))]:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(t), t
    rng = random.Random(3)
    clean = [(i, prose(rng, 80) + ".") for i in range(150)]
    junk = [(200 + i, " ".join(w + "###" for w in prose(rng, 80).split())) for i in range(30)]
    short = [(300, "few words"), (301, None)]
    frame = spark.createDataFrame(clean + junk + short, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 150, 2)] + [(i, 0) for i in range(200, 210)] + [(None, 1), (2, None)], "doc_id long, quality int")
    said = {r.doc_id: r for r in quality.quality_verdicts(frame, labels).collect()}
    assert all(said[i].kept for i, _ in clean) and not any(said[i].kept for i, _ in junk + short)
    assert said[300].base_failed and said[301].base_failed and not said[200].base_failed
    unlabelled = quality.quality_verdicts(frame, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in unlabelled)
    assert quality.quality_verdicts(none, labels).count() == 0


def test_forest_paths_and_score():
    """Path lengths and scores against a walk down every tree, node by node."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    lo, hi = x.min(axis=0) - 1, x.max(axis=0) + 1
    lo[3] = hi[3] = 0.0  # a statistic without a range is never split
    forest = quality.Forest.grow(x[:280], lo, hi)
    assert len(forest.roots) == quality.TREES and not (forest.column[forest.below >= 0] == 3).any()

    def harmonic_path(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    rows = forest.rows
    for row in [*x[::60], hi, lo]:
        depths = []
        for root in forest.roots:
            i, depth = root, 0
            while forest.below[i] >= 0:
                i = forest.below[i] if row[forest.column[i]] < forest.cut[i] else forest.above[i]
                depth += 1
            left_over = forest.leaf[i] - depth
            assert min(abs(left_over - harmonic_path(n)) for n in range(rows + 1)) < 1e-9
            depths.append(forest.leaf[i])
        want = 2 ** (-(sum(depths) / len(depths)) / harmonic_path(rows))
        assert abs(forest.score(row[None])[0] - want) < 1e-12
    far = np.array([hi, lo])
    assert forest.score(far).min() > np.quantile(forest.score(x[:280]), 0.9)


def test_quality_sees_repeated_lines_and_digits(spark):
    """Rows whose only fault is short repeated lines, or a flood of digits, are found."""
    rng = random.Random(8)

    def lines(words):
        return "\n".join(" ".join(words[i : i + 8]) for i in range(0, len(words), 8))

    def stuttered():  # the repeated lines are too short to be repeated windows
        words = prose(rng, 80).split()
        return "\n".join(f"{' '.join(words[i : i + 4])}\nagain" for i in range(0, 80, 4))

    def numbered():
        return lines([f"{rng.randrange(10**4)}" if i % 2 else w for i, w in enumerate(prose(rng, 100).split())])

    clean = [(i, lines(prose(rng, 90).split())) for i in range(300)]
    bad = [(1000 + i, stuttered() if i % 2 else numbered()) for i in range(60)]
    frame = spark.createDataFrame(clean + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 2)] + [(1000 + i, 0) for i in range(20)], "doc_id long, quality int")
    said = {r.doc_id: r for r in quality.quality_verdicts(frame, labels).collect()}
    assert not any(r.base_failed for r in said.values())
    assert sum(not said[i].kept for i, _ in bad) >= 57 and sum(said[i].kept for i, _ in clean) >= 294


def test_language_id(spark, none):
    rng = random.Random(6)
    parts = {"aa": ["the", "ing", "wh", "ou"], "bb": ["sch", "ung", "ei", "ß"], "cc": ["que", "eau", "é", "oi"]}

    def say(k, n):
        return " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    rows = [(i, say(k, rng.randint(20, 120)), k) for i, k in enumerate(list(parts) * 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.learn(frame.where("doc_id % 4 <> 2"))
    held = {r.doc_id: r for r in langid.predict(frame, learned).collect()}
    right = [held[i].lang_pred == k for i, _, k in rows if i % 4 == 2]
    assert sum(right) / len(right) > 0.98 and all(0 <= r.score <= 1 for r in held.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "é"), (5, say("bb", 30000))], "doc_id long, text string")
    said = {r.doc_id: r for r in langid.predict(odd, learned).collect()}
    assert [said[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and said[4].lang_pred != "und" and said[5].lang_pred == "bb"
    assert langid.identified(frame, learned).columns == frame.columns
    assert langid.learn(none).samples == {} and langid.predict(none, learned).count() == 0


def test_language_id_learns_each_language_by_itself(spark, monkeypatch):
    rng = random.Random(8)
    parts = {"aa": ["the", "ing", "wh", "ou"], "bb": ["sch", "ung", "ei", "ß"], "cc": ["que", "eau", "é", "oi"], "dd": ["ska", "jö", "på", "ån"]}

    def say(k, n):
        return " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    plenty = [(i, say(k, 300), k) for i, k in enumerate(["aa", "bb", "cc"] * 60)]
    copied = [say("dd", 100) for _ in range(50)]
    copies = [(1000 + i, copied[i % 50], "dd") for i in range(10000)]
    rare = [(20000 + i, say("aa", 8), "zz") for i in range(3)]
    frame = spark.createDataFrame(plenty + copies + rare, "doc_id long, text string, lang string")
    learned = langid.learn(frame)
    sizes = {k: len(v) for k, v in learned.samples.items()}
    assert set(sizes) == set(parts) and all(sizes[k] == langid.DICTIONARY_BYTES for k in ("aa", "bb", "cc"))
    assert sizes["dd"] == len(" ".join(copied).encode())
    few = spark.createDataFrame(rare, "doc_id long, text string, lang string")
    assert set(langid.learn(few).samples) == {"zz"}
    texts = [t for _, t, _ in plenty[:40]] + copied[:20] + [None, "", "1 2"]
    said = learned.predict(texts)
    assert [n for n, _ in said] == [k for _, _, k in plenty[:40]] + ["dd"] * 20 + ["und"] * 3
    monkeypatch.setattr(langid, "LANGUAGES_AT_ONCE", 3)
    assert langid.Languages(learned.samples).predict(texts) == said


def test_language_id_knows_more_than_128_languages(spark):
    rng = random.Random(9)
    marks = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(4 * 140)]

    def say(k):
        return " ".join("".join(rng.choice(marks[4 * k : 4 * k + 4]) for _ in range(3)) for _ in range(120))

    rows = [(6 * k + i, say(k), f"l{k:03}") for k in range(140) for i in range(6)]
    learned = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(learned.samples) == 140 and [n for n, _ in learned.predict([t for _, t, _ in rows[::6]])] == [f"l{k:03}" for k in range(140)]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def awkward():
    rng = random.Random(11)
    marks = [" ", "  ", "\n", "'ll", "<|endoftext|>", "the", "ing", "é", "12", "    ", "日本", "!", "aaaa", "\u200b"]
    return ["".join(rng.choice(marks) for _ in range(rng.randint(0, 200))) for _ in range(150)] + ["a" * 3000, " " * 999, "<|endo"]


def test_tokens_and_bpe(spark, docs, texts, none, tokenizer):
    bpe = Bpe(VOCABULARY)
    for t in awkward():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert bpe.encode([t])[0].tolist() == ids
        assert bpe.decode(np.array(ids, dtype=np.int64)) == tokenizer.decode(ids, skip_special_tokens=False)
        assert [Counter(VOCABULARY, c, o).long(t) for c, o in ((80, 5), (100, 70), (300, 20))] == [len(ids)] * 3
    assert bpe.decode(np.array([bpe.first_ids[0xC3]])) == "\ufffd"
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    counted = {r.doc_id: r for r in token_counts(docs, VOCABULARY, chunk=4000, overlap=200).collect()}
    coded = {r.doc_id: r for r in encode_decode(docs, VOCABULARY).collect()}
    digests = {r.doc_id: r for r in encode_decode(docs, VOCABULARY, digest=True).collect()}
    for i, t in enumerate(texts):
        blob = np.array(ids[i], dtype="<u4").tobytes()
        assert (counted[i].n_bytes, counted[i].n_tokens) == (len((t or "").encode()), len(ids[i]))
        assert (coded[i].n_tokens, bytes(coded[i].ids), coded[i].decoded) == (len(ids[i]), blob, t or "")
        assert digests[i].ids_sha256 == hashlib.sha256(blob).hexdigest()
    assert token_counts(none, VOCABULARY).count() == 0 and encode_decode(none, VOCABULARY).count() == 0


def test_long_words(tokenizer):
    """Words of any length, by both kinds of rounds, against the library; the time grows with the length."""
    bpe, rng = Bpe(VOCABULARY), random.Random(17)
    alphabets = ["a", "ab", "abcdefghijklmnopqrstuvwxyz", "éßñ日本語", "0123456789", "=-", " "]
    for alphabet in alphabets:
        for n in (1, 2, 3, 255, 257, 1000, 4001):
            t = "".join(rng.choice(alphabet) for _ in range(n))
            ids = tokenizer.encode(t, add_special_tokens=False).ids
            assert bpe.encode([t])[0].tolist() == ids
            both = [m([t, "the", t + t]) for m in (bpe.merge, bpe.merge_long)]
            assert all(np.array_equal(x, y) for x, y in zip(*both))
    word = "".join(rng.choice(alphabets[2]) for _ in range(300_000))
    begin = time.time()
    ids = bpe.encode([word])[0]
    assert time.time() - begin < 30
    assert ids.tolist() == tokenizer.encode(word, add_special_tokens=False).ids


def test_other_vocabulary_files_are_refused(tmp_path):
    spec = json.loads(Path(VOCABULARY).read_text())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"id": 1, "content": "x", "lstrip": True}]}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match=next(iter(change))):
            Bpe(str(path))
        with pytest.raises(ValueError):
            Counter(str(path)).short(["a"])


def test_containment(spark, docs, texts, none):
    rng = random.Random(9)
    w = texts[-1].split()
    items = ["", None, " ".join(w[10:30]), " ".join(w[100:140] + ["other"] * 5), "two words", " ".join(w[:12]).upper(), prose(rng, 50), "the same words the same words"]
    table = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)] + [(None, "x", 0)], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in contained_items(docs, table).collect()}
    want = {}
    for i, t in enumerate(items):
        n = min(5, len(split(t)))
        own = shingle_set(t, 5)
        for d, text in enumerate(texts):
            shared = len(own & shingle_set(text, n)) if n else 0
            if shared and len(split(text)) >= n and 100 * shared >= 80 * len(own):
                want[d, i] = (len(own), shared)
    assert got == want and len(want) > 3
    kept = decontaminated(docs, table)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert contained_items(none, table).count() == 0 and contained_items(docs, table.limit(0)).count() == 0


def test_containment_of_copies_and_classes(spark, monkeypatch):
    """Copies of documents and of items, items of many sizes, and nothing sent to every task."""
    monkeypatch.setattr(containment, "CLASS_ROWS", 0)
    rng = random.Random(21)
    items = [prose(rng, n) for n in (1, 3, 5, 6, 9, 12, 25, 60, 200, 700)]
    items += [items[4], items[6]]  # the same item under two ids
    texts = []
    for t in items[:10]:
        w = t.split()
        for damage in (0, 1, len(w) // 25, len(w) // 20, len(w) // 8):
            v = list(w)
            for i in rng.sample(range(len(v)), min(damage, len(v))):
                v[i] = "changed"
            texts.append(" ".join(prose(rng, rng.randint(0, 400)).split() + v + prose(rng, 30).split()))
    texts += [texts[20]] * 300 + [texts[33]] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    docs = docs.unionByName(docs.where("doc_id = 33"))  # a row that is there twice
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want, known = collections.Counter(), {}
    for d, t in enumerate(texts):
        if t not in known:
            known[t] = {}
            for i, item in enumerate(items):
                own = shingle_set(item, 5)
                shared = len(own & shingle_set(t, min(5, len(split(item)))))
                if 100 * shared >= 80 * len(own):
                    known[t][i] = (len(own), shared)
        for i, counts in known[t].items():
            want[d, i, *counts] += 2 if d == 33 else 1
    got = collections.Counter((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in contained_items(docs, table).collect())
    assert got == want and len({i for _, i, _, _ in got}) == len(items)
    kept = decontaminated(docs.withColumn("text_a", F.lit(1)), table)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, *_ in want}


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><nav><a href=x>Home</a></nav>
<div class="ad">Buy now</div><article><h1>Head &amp; <i>line</i></h1><p>One<b>two</b>&nbsp; three<p>Four<br>five<!-- no -->
<form>Name</form><div id="comments">Nice!</div></article><footer>&copy; us</footer>"""


def test_html(spark):
    assert html.main_text(PAGE) == "Head & line Onetwo three Four five"
    body = "".join(f"<p>{'Sentence of some length here. ' * 3}</p><p>Short.</p>" for _ in range(4))
    plain = f"<body><ul>{'<li><a href=x>A link to follow somewhere</a></li>' * 9}</ul><div>{body}</div><ul><li>end</li></ul></body>"
    assert html.main_text(plain).startswith("Sentence") and html.main_text(plain).count("Short.") == 4 and "link" not in html.main_text(plain)
    frame = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "", ""), (4, "x", "<p"), (5, "y", "a < b")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html.extract(frame).collect()}
    assert [got[i].n_chars for i in (1, 2, 3)] == [len(got[1].text), 0, 0] and len(got) == 5
    assert html.extract(frame.limit(0)).count() == 0


def test_html_surge_and_dive_choose_on_every_page():
    long = "Sentence of some length here. " * 4
    story = "<h1>Title</h1>" + "".join(f"<p>{long}</p><p>Short.</p>" for _ in range(4))
    frame = "<body><div>Our site</div><nav><a href=x>Home</a></nav>{}<footer>us</footer><div>Built by a tool</div></body>"
    marked, plain = (html.main_text(frame.format(f"<{t}>{story}</{t}>")) for t in ("article", "div"))
    assert marked == plain and marked.startswith("Title") and marked.count("Short.") == 4 and marked.endswith("Short.")
    # A mark is a weight and no selector: much text outside is chosen too, little is not.
    teaser = "A teaser of a few words more."
    both = f"<article><p>{teaser}</p></article><div>Menu line</div><nav>x</nav><div>" + f"<p>{long * 3}</p>" * 3 + "</div>"
    assert html.main_text(both).startswith(teaser + " Sentence") and "Menu" not in html.main_text(both)
    assert html.main_text(f"<article><p>{teaser}</p></article><div>{long}</div>") == teaser
    # The mark is a bounded factor: beside longer text, an article of seven characters does not surge.
    assert "Teaser" not in html.main_text(both.replace(teaser, "Teaser."))


def _runs_by_brute_force(weights):
    """The rule as stated: sums over windows that reach over either end, a surge, and the dives around it."""
    at = range(-html.WINDOW + 1, len(weights))
    block = {i: sum(w for j, w in enumerate(weights) if i <= j < i + html.WINDOW) for i in at}
    top = max(block.values(), default=0)
    main = set()
    for i in at:
        if top and block[i] >= min(html.SURGE, top):
            first = last = i
            while block.get(first - 1, 0) > 0:
                first -= 1
            while block.get(last + 1, 0) > 0:
                last += 1
            main |= set(range(first + html.WINDOW - 1, last + 1))
    return main


def test_html_runs_equal_brute_force():
    draw = random.Random(5)
    for _ in range(400):
        weights = [draw.choice([0, 0, 0, 0, 0, draw.randint(1, 60), draw.randint(60, 200) / 4]) for _ in range(draw.randint(0, 30))]
        got = {i for first, end in html.chosen(weights) for i in range(first, end)}
        assert got == _runs_by_brute_force(weights), weights


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><p>Hello world.</p><svg-icon name="x"></svg-icon><p>Rest of text.</p></article>', "Hello world. Rest of text."),
        ('<article><p>Hello world.</p><svg width="1"/><p>Rest of text.</p></article>', "Hello world. Rest of text."),
        ("<article><p>A</p><svg><svg><text>no</text></svg></svg><script-x>B</script-x><scripted>C</scripted></article>", "A BC"),
        ('<body><form id="aspnetForm"><input><article><p>Story.</p></article></form></body>', "Story."),
        ("<body><form><div><p>One here.</p><p>Two here.</p><p>Three here.</p></div></form></body>", "One here. Two here. Three here."),
        ("<article><p>Hi.</p><form><p>Your name</p><input></form><p>End.</article>", "Hi. End."),
        ('<article><p>Hi.</p><div class="cookie-notice">C</div><div class="newsletter">N</div><p>End.</article>', "Hi. End."),
        ('<article><p>Hi.</p><p class="comment">K</p><div id="respond">R</div><ul class="menu"><li>m</ul></article>', "Hi."),
        ('<article class="post tag-cookie"><p>Body.</p><article class="comment-body">Nice!</article></article>', "Body."),
        ('<div class="page has-sidebar"><p data-id="menu">Body.</p></div>', "Body."),
        ('<article><p>A <a "b>c</a></p><p title="x>d</p></article>', "A c d"),
        ("<article><p>A</p></article><script>var a = 1;", "A"),
        ("one <two and three", "one <two and three"),
    ],
)
def test_html_keeps_what_is_text_and_no_more(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    "piece",
    ['<a "', "<a href='", '<a href="x>', "<a ", "<", "</b>", "<!--", "<script>", "<form>", "<a class=", "<![CDATA[", "&amp"],
)
def test_html_time_is_linear_in_what_is_left_open(piece):
    page = "<b><div>" * 2000 + piece * (1_000_000 // len(piece) // 4) + "</b>" * 20_000
    start = time.process_time()
    html.main_text(page)
    assert time.process_time() - start < 5


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div class=c><p>{0}{0}{0}</p><div class=ad>Buy</div><p>Later.</p></div><footer>us</footer>", "{0}{0}{0}Later."),
        ("<body><p>{0}{0}{0}</p><aside>Aside</aside><p>Later.</p></body>", "{0}{0}{0}Later."),
        ("<div><h1>Title</h1><div class=ad>Buy</div><p>{0}</p></div>", "Title {0}"),
        ("<body><p>A short one.</p><p>Ends.</p></body>", "A short one. Ends."),
        ("<article><h1><a href=x>Title</a></h1><p>{0}</p><p><a href=y>Last</a></p></article>", "Title {0}Last"),
        ("<article><p>A</p><ul><li><a>1</a><li><a>2</a><li><a>3</a><li><a>4</a></ul><p>B</p></article>", "A 1 2 3 4 B"),
        ("<html><head><title>T</title><meta name=x><body><p>Text.</p></body>", "Text."),
        ("<html><head><title>T</title><p>Text.</p>", "Text."),
        ("<article><div class='entry-header'><h1>Title</h1></div><div class='widget share-price search'>In</div><p>B</p></article>", "Title In B"),
        ("<article><p>A</p><div class='ad'>Buy</div><div class='share-buttons'>Send</div><div id=comments>Nice</div></article>", "A"),
        ("<body><div class=c><div class='entry-header'><h1>Title</h1></div><p>{0}</p></div></body>", "Title {0}"),
    ],
)
def test_html_keeps_the_whole_article(page, text):
    long = "Sentence of some length to read here and there. "
    assert html.main_text(page.replace("{0}", long)) == text.replace("{0}", long).strip()


def test_urls(spark):
    rules = [*queries.URL_RULES, ("block", "a.org/x"), ("allow", "a.org/x/y"), ("block", "a.org/x/y"), ("allow", "org/")]
    rng = random.Random(1)
    hosts = ["example.com", "WWW.example.com", "a.www.example.com", "xexample.com", "com", "b.net", "a.org", "q.a.org", "net.", "", "casino-win.io", "u@b.net:80"]
    paths = ["", "/", "/en/", "/en", "/en/5?x=/es/", "/es/1#top", "/fr/", "/x", "/xyz", "/x/y/z", "/x/yy", "//en/", "?q", "#f"]
    table = [None, "", "no scheme/en/", "://", "a://b://c/en/"] + [f"{rng.choice(['http', 'https'])}://{h}{p}" for h in hosts for p in paths]
    frame = spark.createDataFrame(list(enumerate(table)), "page_id long, url string")
    for block in (200_000, 2):
        urls.BLOCK_RULES, kept = block, urls.BLOCK_RULES
        got = {r.page_id: r for r in urls.url_verdicts(frame, rules, unwanted=urls.UNWANTED_LABELS).collect()}
        urls.BLOCK_RULES = kept
        for i, u in enumerate(table):
            rest = u.split("://", 1)[1] if u and "://" in u else ""
            host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
            path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
            fits = []
            for verdict, rule in rules:
                h, slash, p = rule.partition("/")
                if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
                    fits.append((len(rule), verdict == "block", rule, verdict))
            best = max(fits)[2:] if fits else (None, "block" if "casino" in host else "allow")
            assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *best), u


def test_pipeline(spark, tmp_path, tokenizer):
    """Every stage against what its operator is for, on a small table."""
    rng = random.Random(12)
    base = [prose(rng, 120) for _ in range(30)]
    item = prose(rng, 40)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[0], "en", "s", 1), (101, base[1] + " more", "en", "s", 1), (102, None, "en", "s", 0), (103, "12 34", "en", "s", 5)]
    rows += [(104, prose(rng, 50) + " " + item, "en", "s", 9), (105, base[2][:200] + " token=0123456789abcdef0", "en", "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = store.stored(stage(spark, docs, str(tmp_path)))
        assert after.columns == docs.columns, name
        docs = after
    left = {r.doc_id: r for r in docs.collect()}
    assert set(left) == {*range(30), 105}
    assert left[105].text.endswith("[SECRET]") and left[105].n_chars == len(left[105].text) and left[3].text == base[3]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(left)
    for i, r in out.items():
        assert r.n_tokens == len(tokenizer.encode(left[i].text, add_special_tokens=False).ids)
        assert r.decoded_sha256 == hashlib.sha256(left[i].text.encode()).hexdigest()
