"""Phrase mining, the conversation trie and the neighbour search against brute force."""

import collections
import hashlib
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinshot.llm import neighbours, phrases, queries, store, trie

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    store.ship(spark)


# ----- phrases ------------------------------------------------------------------------


def brute_phrases(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    out = []
    for lang in n:
        rows = []
        for (where, p), a in f.items():
            if where != lang or len(p) == 1:
                continue
            around = (q for (w, q), b in f.items() if w == lang and b == a and len(q) == len(p) + 1)
            if any(q[:-1] == p or q[1:] == p for q in around):
                continue
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def phrase_rows(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "The", "a", "é", "été", "x" * 40, "b\x01", "\x00", "\x1c", "in", "on", "new", "york", "|", "ü-b"]
    weights = [8, 6, 4, 4, 3, 3, 1, 2, 1, 1, 2, 2, 3, 3, 2, 1]
    rows = [(None, "en"), ("", "de"), (" \t ", "en"), ("...;\n", None), ("one", "fr"), ("a b c d e f", None)]
    for _ in range(n):
        words = rng.choices(vocabulary, weights, k=rng.randint(1, 60))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ; "]) for w in words)
        rows.append((text + rng.choice(["", "new york city hall now", "in the new york"]), rng.choice(["en", "en", "en", "de", None])))
    return rows


@pytest.mark.parametrize("least,budget,top", [(3, phrases.BUDGET, 2000), (5, 200, 2000), (4, 12, 15)])
def test_collocations(spark, least, budget, top):
    """With small budgets prefixes are extended to two, three and four words, and there are many groups."""
    rows = phrase_rows(least, 160) + [("new york city hall now again", "en")] * 60
    docs = spark.createDataFrame([(t, l, 1, "x") for t, l in rows], "text string, lang string, n int, phrase string").repartition(5)
    got = [tuple(r) for r in phrases.collocations(docs, least=least, top=top, budget=budget).collect()]
    assert sorted(got) == brute_phrases(rows, least, top) and len(got) > 20


def test_collocations_of_hash_twins(spark, monkeypatch):
    """Words of one hash stay apart: hashes only deal out the work."""
    rows = phrase_rows(9, 80)
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(2)
    found = phrases.Pieces(*(__import__("pyarrow").array(c) for c in zip(*rows)))
    twins = found.hashes() % np.uint64(5)
    listed = np.arange(len(twins))
    first = np.unique(twins, return_index=True)[1]
    assert not phrases._same_words(found, listed, np.unique(twins, return_inverse=True)[1], first)
    names, code = phrases._by_word(found, listed)
    assert phrases._same_words(found, listed, code, np.unique(code, return_index=True)[1])
    assert [names[c] for c in code.tolist()] == found.strings(listed)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "x")], "text string, lang string")).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([("x", "a b", 10**15, 10**15, 3 * 10**14, 10**16)], "lang string, phrase string, a long, l long, r long, n long")
    e = "cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0)) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))"
    assert rows.selectExpr(f"{e} as s").first().s == 1000 * 10**15 * 10**16 // (10**15 * 3 * 10**14)


# ----- conversations ------------------------------------------------------------------


def brute_trie(convs, rebuilt):
    """Rows by prefix, from {conv_id: [(role, text), ...]}."""
    members, children = collections.defaultdict(list), collections.defaultdict(set)
    for c in convs:
        path = tuple(rebuilt[c])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        leaves = 0 if children[node] else 1
        totals[node] = (leaves + sum(totals[k][0] for k in children[node]), own + sum(totals[k][1] for k in children[node]))
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(rebuilt[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(cs), len(node), parent, len(cs), len(children[node]), *totals[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def brute_rebuilt(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def conversation_rows():
    rng = random.Random(3)
    rows = [(None, 1, "user", "lost"), (700, None, None, None), (700, None, None, None), (-205, 0, "user", "x"), (-200, 0, "user", "y")]
    for c in [*range(0, 260, 3), 1500, 1501, 1507]:
        if c in (102,):
            continue
        for t in range(rng.randint(1, 9)):
            rows.append((c, t if rng.random() > 0.1 else None, rng.choice(["user", "assistant", None]), rng.choice(["hi", "Hello", "é€", "", None, "a longer text"])))
    rows += [(c, t, "user", f"same {t}") for c in range(3000, 3050) for t in range(3)]  # one conversation many times
    rng.shuffle(rows)
    return rows


DDL = "conv_id long, turn long, role string, text string, depth string, k1 int"


def test_conversation_trie(spark, tmp_path):
    rows = conversation_rows()
    spark.createDataFrame([(*r, "x", 1) for r in rows], DDL).repartition(6).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op12_conversation_prefix_trie(spark, str(tmp_path))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rebuilt = brute_rebuilt(rows)
    assert any(not v for v in rebuilt.values())
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == brute_trie(rebuilt, rebuilt)


def test_trie_without_conversations(spark, tmp_path):
    spark.createDataFrame([], DDL).write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.op12_conversation_prefix_trie(spark, str(tmp_path)).count() == 0


def test_trie_in_slices_and_pieces(spark, monkeypatch):
    """Long conversations cross slices, long lists of ids cross pieces and ranges."""
    monkeypatch.setattr(trie, "SLICE", 7)
    monkeypatch.setattr(trie, "PIECE", 40)
    rng = random.Random(5)
    trunk = [("u", f"t{i}") for i in range(25)]
    rebuilt = {c: trunk[: rng.choice([0, 7, 8, 20, 24, 25])] + [("v", rng.choice("ab")) for _ in range(rng.randint(0, 12))] for c in range(400)}
    rebuilt |= {c: trunk[:20] for c in range(1000, 1300)}
    paths = [(c, i + 1, *t) for c, v in rebuilt.items() for i, t in enumerate(v)]
    got = trie.prefix_trie(
        spark.createDataFrame(paths, "conv_id long, at long, role string, text string"), spark.createDataFrame([(c,) for c in rebuilt], "conv_id long")
    )
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == brute_trie(rebuilt, rebuilt)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "caterpillar"])
def test_contraction(spark, shape, monkeypatch):
    rng = random.Random(7)
    n = 60
    up = {
        "chain": lambda i: i - 1,
        "star": lambda i: 0,
        "random": lambda i: rng.randrange(max(0, i - 12), i),
        "caterpillar": lambda i: i - 1 if i % 2 else i - 2,
    }[shape]
    parent = {0: None} | {i: max(up(i), 0) for i in range(1, n)}
    parent[n] = None  # a second root
    kids = collections.Counter(p for p in parent.values() if p is not None)
    total = {i: i * i + 1 for i in parent}
    for i in sorted(parent, reverse=True):
        if parent[i] is not None:
            total[parent[i]] += total[i]
    tree = spark.createDataFrame([(i, p, kids[i], i * i + 1) for i, p in parent.items()], "id long, up long, kids long, v long")
    writes = []
    monkeypatch.setattr(trie, "stored", lambda df, keep=trie.stored: writes.append(1) or keep(df))
    got = {r.id: r.v for r in trie.subtree_totals(tree, ["id"], ["up"], ["v"]).collect()}
    assert got == total
    assert len(writes) < 4 * 22  # rounds follow the logarithm of the nodes


# ----- neighbours ---------------------------------------------------------------------


def brute_neighbours(rows, k):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in ok:
        if q % 20 == 0:
            scored = {}
            for i, y in ok:
                if i != q and len(x) == len(y):
                    s = 0.0
                    for a, b in zip(x.tolist(), y.tolist()):
                        s += a * b
                    scored[i] = max(s, scored.get(i, -np.inf))
            out[q] = sorted((-s, i) for i, s in scored.items())[:k]
    return {q: [(r, i, -s) for r, (s, i) in enumerate(v, 1)] for q, v in out.items()}


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] * 2 + rng.normal(size=8) * (0.1 + i % 3)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(2000 + i, [1.0] * 8) for i in range(150)]  # one vector many times
    rows += [(3000, None), (3020, []), (3040, [0.0] * 8), (3060, [1.0, None] + [0.0] * 6), (3080, [float("nan")] * 8), (None, [1.0] * 8)]
    rows += [(3100, [float("inf")] + [1.0] * 7), (3120, [1.0, 2.0]), (3121, [2.0, 2.0]), (3140, [5.0] * 8), (3140, [5.0] * 8), (3160, [1.0, 2.0, 3.0])]
    return rows


def lists(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("shard,block", [(100, 7), (5000, 4096)])
def test_neighbours_are_exact_with_factor_one(spark, shard, block):
    rows = vectors(1, 900)
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, shard string, dim int").repartition(4)
    got = neighbours.neighbours(df, F.col("vec_id") % 20 == 0, k=20, shard_rows=shard, query_rows=block)
    want = {q: v for q, v in brute_neighbours(rows, 20).items() if v}
    assert lists(got) == want and len(want[3120]) == 1 and 3160 not in want


def test_fewer_candidates_than_asked_for(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {q: len(v) for q, v in lists(neighbours.neighbours(df, F.col("vec_id") < 2, k=20)).items()} == {0: 4, 1: 4}
    assert neighbours.neighbours(df.limit(0), F.col("vec_id") < 2).count() == 0
    assert neighbours.neighbours(df, F.col("vec_id") > 99).count() == 0


def test_pruning_skips_and_relaxing_skips_more(monkeypatch):
    """On clustered vectors exact search skips most leaves, and a factor of 2 skips more at little loss."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16)) * 3
    data = centres[rng.integers(0, 60, 8000)] + rng.normal(size=(8000, 16)) * 0.5
    tree = neighbours.Tree(data)
    ids, at = np.arange(8000), np.arange(0, 8000, 20)
    seen = {}
    plain = neighbours._Best.add
    for factor in (1.0, 2.0):
        work = [0]
        monkeypatch.setattr(neighbours._Best, "add", lambda self, a, rows: (work.__setitem__(0, work[0] + len(a) * len(rows)), plain(self, a, rows))[1])
        q, found, score = tree.search(ids, data[at], ids[at], 10, factor)
        seen[factor] = work[0], {(a, b) for a, b in zip(q.tolist(), found.tolist())}
    scores = data[at] @ data.T
    scores[np.arange(len(at)), at] = -np.inf
    exact = {(i, j) for i, row in enumerate(np.argsort(-scores, axis=1, kind="stable")[:, :10].tolist()) for j in row}
    assert seen[1.0][1] == exact
    assert seen[2.0][0] < seen[1.0][0] < 0.8 * len(at) * 8000
    assert len(seen[2.0][1] & exact) / len(exact) >= 0.9


def test_recall_of_the_registered_search(spark):
    from conftest import TESTDATA

    sf = f"{TESTDATA}/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = brute_neighbours(rows, 20), lists(queries.op13_nearest_neighbours(spark, sf))
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in v}) for q, v in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(len(got[q]) == 20 for q in want)
