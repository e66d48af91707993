"""Near copies and repeated strings against brute force, and the pipeline."""

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import common, near, queries, suffix_dedup, suffixes

SF = "/root/testdata/sf0.001"


def test_suffixes():
    for seed in range(200):
        rng = random.Random(seed)
        t = np.array([rng.randint(1, rng.choice([1, 2, 3, 20])) for _ in range(rng.randint(1, 60))] + [0])
        want = np.empty(len(t), int)
        want[sorted(range(len(t)), key=lambda i: tuple(t[i:]))] = range(len(t))
        for held in (1 << 20, 5):  # in memory and on disk
            assert (np.asarray(suffixes.suffix_ranks(t, held)) == want).all()


def _strings(texts, length):
    return Counter(x[i : i + length] for x in texts for i in range(len(x) - length + 1))


def _removed(texts, length):
    seen = _strings(texts, length)
    out = []
    for x in texts:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize(("length", "held", "span", "hot"), [(12, 1 << 24, 1 << 19, 1 << 23), (12, 50, 64, 1 << 23), (40, 1 << 24, 100, 1 << 23), (12, 1 << 24, 64, 0), (40, 1 << 24, 1 << 19, 300)])
def test_repeats(spark, monkeypatch, length, held, span, hot):
    """hot: 0 deals out the strings of all anchors, 300 those of some."""
    monkeypatch.setattr(suffix_dedup, "SPAN", span)
    rng = random.Random(length)
    passages = ["".join(rng.choice("abcé ") for _ in range(rng.randint(5, 90))) for _ in range(6)]
    texts = [None, "", "short", "ab" * 60, "ab" * 60 + "c", "z" * 50]
    for _ in range(60):
        parts = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randint(0, 60))) for _ in range(3)]
        if rng.random() < 0.6:
            passage = list(rng.choice(passages))
            if rng.random() < 0.5:
                passage[rng.randrange(len(passage))] = "#"
            parts.insert(1, "".join(passage))
        texts.append("".join(parts))
    texts += [texts[10]] * 3
    rows = [(i if i != 12 else None, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (3, "another text of the same id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, begin int")
    got = suffix_dedup.remove_repeats(df, length=length, held=held, hot=hot).collect()
    raw = [(t or "").encode() for _, t, _ in rows]
    want = []
    for (i, _, _), x, gone in zip(rows, raw, _removed(raw, length), strict=True):
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        edges = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(x), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
    assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(want, key=repr)
    assert suffix_dedup.remove_repeats(df.limit(0), length=length).collect() == []


def test_op7(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    raw = [d.text.encode() for d in docs]
    want = {d.doc_id: (len(x), int(g.sum()), hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~g])).hexdigest()) for d, x, g in zip(docs, raw, _removed(raw, 200), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in queries.op7_suffix_dedup(spark, SF).collect()} == want


def _sets(texts, size=5):
    out = []
    for t in texts:
        w = (t or "").split()
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def _links(sets, threshold=0.8):
    n, links = len(sets), defaultdict(set)
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i].add(j)
                links[j].add(i)
    return links


def test_hot_anchor(spark, monkeypatch):
    """A phrase that every document holds in surroundings of its own, some of which recur."""
    monkeypatch.setattr(suffix_dedup, "ROWS", 16)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    around = [(word(150), word(150)) for _ in range(20)]
    texts = [a + "the same phrase in very many different texts" + b for a, b in [(word(180), word(180)) for _ in range(60)] + [(a[30 * (k % 2) :], b[: 150 - k]) for k, (a, b) in enumerate(around * 3)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [int(x.sum()) for x in _removed([t.encode() for t in texts], 200)]
    for hot in (0, 1 << 14, 1 << 23):
        assert [r.n_removed for r in suffix_dedup.remove_repeats(df, hot=hot).orderBy("doc_id").collect()] == want


def _classes(ids, links):
    parent = list(range(len(ids)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, js in links.items():
        for j in js:
            parent[top(i)] = top(j)
    least = {}
    for i in range(len(ids)):
        least[top(i)] = min(least.get(top(i), ids[i]), ids[i])
    return [least[top(i)] for i in range(len(ids))]


def test_jaccard_join(spark):
    rng = random.Random(12)
    vocabulary = [f"v{k}" for k in range(400)]
    texts = [None, "", "  \n", "one two", "one  two", "one two three four five", "one two three four five"]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(4, 160))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, vid string")
    got = {r.doc_id: r for r in near.jaccard_join(df).collect()}
    links = _links(_sets(texts))
    classes = _classes(ids, links)
    assert len(got) == len(texts)
    assert [got[i].class_id for i in ids] == classes
    assert [got[i].n_links for i in ids] == [len(links[k]) for k in range(len(ids))]
    assert near.jaccard_join(df.limit(0)).collect() == []


def test_hot_near_copies(spark, monkeypatch):
    """A third of the rows in one group, all pairs linked; compared in small blocks."""
    monkeypatch.setattr(near, "BLOCK", 8)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(60)] + [" ".join(f"x{k}-{j}" for j in range(20)) for k in range(60)] + ["same words here and there"] * 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.class_id, r.n_links, r.n_copies) for r in near.jaccard_join(df).orderBy("doc_id").collect()]
    assert got == [(0, 59, 1)] * 60 + [(60 + k, 0, 1) for k in range(60)] + [(120, 59, 60)] * 60


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + k, 301 + k) for k in range(40)]
    got = {r.v: r.root for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    links = defaultdict(set)
    ids = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {x: k for k, x in enumerate(ids)}
    for a, b in edges:
        if a != b:
            links[at[a]].add(at[b])
    assert got == dict(zip(ids, _classes(ids, links), strict=True))


def test_recall():
    found = near.depths(0.8)
    reached = 1 - np.prod([1 - 0.8**d for d in found])
    assert len(found) == near.TREES and set(found) == {4, 5} and reached >= near.RECALL > 0.999
    assert 1 - np.prod([1 - 0.8**d for d in [*found[: found.index(5) - 1], *[5] * (near.TREES - found.index(5) + 1)]]) < near.RECALL  # a prefix less shortened isn't enough
    assert near.depths(1.0) == [near.LONGEST] * near.TREES and near.depths(0.01, recall=1) == [1] * near.TREES


def test_pairs_at_the_threshold_meet(spark):
    """Pairs of a similarity just above the threshold, each pair apart from all others."""
    rng = random.Random(5)
    texts = []
    for k in range(600):
        words = [f"{k}-{j}" for j in range(104)]  # 100 shingles
        changed = list(words)
        for at in (20, 60):
            changed[at] = f"{k}-changed-{rng.random()}"
        texts += [" ".join(words), " ".join(changed)]  # 90 shared of 110
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near.jaccard_join(df)
    assert got.where("n_links = 1 and class_id = doc_id - doc_id % 2").count() >= 1198


def test_op9_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    ids, links = [d.doc_id for d in docs], _links(_sets([d.text for d in docs]))
    got = {r.doc_id: r for r in queries.op9_jaccard_join(spark, SF).collect()}
    assert [got[i].class_id for i in ids] == _classes(ids, links)
    assert [got[i].n_links for i in ids] == [len(links[k]) for k in range(len(ids))]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    steps, at = [], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, SF).cache()
        steps.append({r.doc_id for r in at.collect()})
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == docs.columns
    assert all(b <= a for a, b in zip(steps, steps[1:], strict=False))
    texts = {r.doc_id: r.text for r in docs.collect()}
    bare = lambda i: "".join(texts[i].split())
    assert len({bare(i) for i in steps[1]}) == len(steps[1]) and {bare(i) for i in steps[0]} == {bare(i) for i in steps[1]}
    rest = sorted(steps[1])
    classes = _classes(rest, _links(_sets([texts[i] for i in rest])))
    assert steps[2] == {i for i, c in zip(rest, classes, strict=True) if i == c}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [i for i in steps[3] if any(x in texts[i] for x in items)]
    assert steps[4] == steps[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == steps[4]
    assert at.where(F.col("n_tokens") != F.size("ids")).isEmpty()


def test_near_copies_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(21)
    made = lambda: [f"w{rng.randrange(10**6)}" for _ in range(60)]
    like = lambda words: " ".join([*words, f"z{rng.randrange(10**6)}"])
    a, b, c, d = made(), made(), made(), made()
    kept = [(1, like(a), "first"), (4, like(b), "b"), (2, " ".join(made()), "alone"), (None, " ".join(made()), "alone"), (7, None, "null"), (7, "", "empty"), (None, None, "null")]
    gone = [(2, like(a), "a"), (None, like(a), "a"), (4, like(b), "b")]
    either = [(None, like(c), "c"), (None, like(c), "c")]
    twice = [(9, " ".join(d), "d")] * 2
    df = spark.createDataFrame(kept + gone + either + twice, "doc_id long, text string, note string")
    got = Counter(map(tuple, corpus_pipeline.drop_near_copies(spark, df, SF).collect()))
    assert sum(got.values()) == len(kept) + 2 and got[twice[0]] == 1 and got[either[0]] + got[either[1]] == 1
    assert sum(got[x] for x in (kept[1], gone[2])) == 1
    assert all(got[x] == 1 for x in [kept[0], *kept[2:]]) and not any(got[x] for x in gone[:2])


@pytest.mark.parametrize("k", range(5))
def test_stages_keep_columns_of_any_name(spark, k):
    import corpus_pipeline

    extra = ["kept", "keep_id", "group_size", "text_sha256", "Score", "predicted", "leaks", "class_id", "n_links", "n_copies", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).cache()
    stage = corpus_pipeline.STAGES[k][1]
    got = stage(spark, docs.select(*(F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in extra), *docs.columns), SF)
    plain = stage(spark, docs, SF)
    if k < 4:
        assert got.columns == [*extra, *docs.columns]
        assert all(r[j] == f"{c} {r.doc_id}" for r in got.collect() for j, c in enumerate(extra))
    assert sorted(map(repr, got.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))


def _thue_morse(n, swap=False):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word.translate(str.maketrans("ab", "ba")) if swap else word


def test_words_that_collide_under_polynomial_hashes_differ(spark):
    """Modulo 2 ** 64, such a word and its complement have one polynomial hash whatever the base."""
    texts = [_thue_morse(2048), _thue_morse(2048, True), _thue_morse(512), _thue_morse(512, True)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in near.jaccard_join(df).collect()}
    assert all((r.class_id, r.n_links, r.n_copies) == (i, 0, 1) for i, r in got.items())
    around = ["x" * 40 + t + "y" * 40 for t in texts[:2]]
    want = _removed([t.encode() for t in around], 200)
    for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(around)), "doc_id long, text string")).collect():
        assert r.n_removed == int(want[r.doc_id].sum())


def test_recall_on_the_small_tables(spark):
    """Links found against all pairs, over whole texts."""
    docs = [(r.doc_id, (r.text or "").split()) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in docs if w}
    by = defaultdict(list)
    for i, own in sets.items():
        for gram in own:
            by[gram].append(i)
    both = Counter()
    for ids in by.values():
        both.update((a, b) for x, a in enumerate(ids) for b in ids[x + 1 :])
    want = Counter()
    for (a, b), n in both.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            want.update((a, b))
    got = {r.doc_id: r.n_links for r in queries.op9_jaccard_join(spark, "/root/testdata/sf0.01").collect()}
    assert all(n <= want[i] for i, n in got.items())
    assert sum(got.values()) >= 0.99 * sum(want.values()) > 0


ODD = [(1, None, "en", "a", 0), (1, None, "en", "a", 0), (None, "", None, None, None), (2, " \n", "en", "a", 2), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7), (None, "one  two", "en", "b", 8), (4, "w " * 200_000, "en", "b", 400_000)]


@pytest.mark.parametrize("k", range(5))
@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_take_odd_rows(spark, k, rows):
    """Nulls, blanks, repeated rows and ids, a very long text, columns that clash with those made, no rows at all."""
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, kind).selectExpr("*", "'own' AS score", "'own' AS kept", "'own' AS leaks", "'own' AS class_id", "'own' AS n_tokens")
    got = stage(spark, docs, SF)
    found = got.collect()
    if k < 4:
        assert got.columns == docs.columns
        assert all(r.score == r.kept == r.leaks == r.class_id == r.n_tokens == "own" for r in found)
        assert not Counter(found) - Counter(docs.collect())
    want = {1: 3, 2: 6, 3: len(rows), 4: len(rows)}  # texts that differ in more than white space; classes and rows without words; clean rows; all rows
    if rows and k in want:
        assert len(found) == want[k], name
    if not rows:
        assert not found


def _files(spark):
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    return {p.name for p in folder.glob("rdd-*")}


def test_checkpoints_go(spark):
    """A result's own stay, all others go; within scratch all go, also where it fails."""
    df = spark.range(10)
    one = common.cut(df)
    before = _files(spark)
    with common.scratch():
        two = common.cut(df)
        three = common.settled(lambda: common.cut(two).union(common.cut(two)))
        assert len(_files(spark) - before) == 2 and three.count() == 20
    with pytest.raises(ZeroDivisionError), common.scratch():
        common.cut(df)
        1 / 0  # noqa: B018
    assert _files(spark) == before and one.count() == 10
    common.drop(one)
    common.drop(one)
    assert len(before - _files(spark)) == 1


def test_results_outlive_their_checkpoints(spark):
    """Only what a result is read from is left, and the pipeline leaves nothing but its output."""
    import corpus_pipeline

    common.shared_folder(spark)
    for make, most in ((queries.op9_jaccard_join, 3), (queries.op7_suffix_dedup, 2), (queries.op5_line_dedup, 1), (corpus_pipeline.run, 0)):
        before = _files(spark)
        got = make(spark, SF)
        assert len(_files(spark) - before) <= most
        assert got.count() == got.count() > 0


def test_sifted_rows(spark, monkeypatch):
    """All rows sought are marked and few others, whatever their keys; a full table marks more."""
    df = spark.range(40_000).selectExpr("IF(id = 7, NULL, struct(id AS a, IF(id % 3 = 0, NULL, id) AS b)) AS key", "id % 100 = 7 AS sought", "id")
    these = common.cut(df.where("sought"))
    marked = lambda: {r.id for r in common.sifted(df, these, "key").where("__marked").select("id").collect()}
    want, found = set(range(7, 40_000, 100)), marked()
    assert want <= found and len(found) < 40_000 / 16
    monkeypatch.setattr(common, "BITS", 1 << 14)
    assert marked() == want or len(marked()) < len(found)
    assert common.sifted(df, common.cut(these.limit(0)), "key").where("__marked").isEmpty()
    monkeypatch.setattr(common, "MOST", 1 << 16)
    assert want <= marked()


def test_full_tables_of_bits_change_no_result(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    results = lambda: [sorted(map(repr, f(docs).collect())) for f in (suffix_dedup.remove_repeats, near.jaccard_join)]
    want = results()
    full = lambda df, these, *keys: df.withColumn("__marked", F.lit(True))
    monkeypatch.setattr(suffix_dedup, "sifted", full)
    monkeypatch.setattr(near, "sifted", full)
    assert results() == want


@pytest.mark.parametrize("k", range(5))
def test_stages_begin_with_heaps_collected(spark, k):
    """Else an executor holds on to the heap of the stage before while Python workers start beside it."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = [b for b in beans if any(x in b.getName() for x in ("Old", "MarkSweep"))]  # those that collect all of the heap
    before = sum(b.getCollectionCount() for b in whole)
    corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert whole and sum(b.getCollectionCount() for b in whole) > before
