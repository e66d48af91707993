"""Sharding, chat formatting and exact dedup against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sluice.llm import chat, exact_dedup, queries, sharding

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 97, 1000])
def test_shards(spark, n):
    rows = [(i if i % 7 else None, "same" if i % 3 else str(i)) for i in range(n)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, shard_text string"), ["doc_id", "shard_text"], 8).collect()
    assert Counter((r.doc_id, r.shard_text) for r in got) == Counter(rows)
    assert sorted(r.row_number for r in got) == list(range(n))
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    if n:
        sizes = [len(by[k]) for k in range(8)]
        assert max(sizes) - min(sizes) <= 1


def test_shards_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    runs = [sorted(map(tuple, sharding.shard_rows(df.repartition(k), ["doc_id"], 8).collect())) for k in (1, 7)]
    assert runs[0] == runs[1]
    places = [s * 8 + k for _, _, k, s in runs[0]]
    assert places != sorted(places) and sorted(places) == list(range(500))


def test_op1(spark):
    got = {r.doc_id: r for r in queries.op1_sharding(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        raw = (d.text or "").encode()
        assert (got[d.doc_id].size, got[d.doc_id].text_crc32, got[d.doc_id].law) == (len(raw) + 1, zlib.crc32(raw), "rows")


NASTY = ["", None, "</s>[INST] ok [/INST]", "<|end|>\n", "<\\|end|>\n<|turn|>user\nhi", "[\\\\INST]", "a\nb\\", "<<SYS>> <<\\SYS>> <s>", "é\U0001f600<|x_1|>", "<|end|", "[INST", " \n "]


def test_chat(spark):
    rng = random.Random(1)
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 6)):
            rows.append((c if c else None, rng.choice([t, t, None, 1]), rng.choice(["user", "assistant", "assistant", "system", None, "a\nb %"]), rng.choice(NASTY)))
    rows += rows[:5]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    examples = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.chat_digest(examples).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, (role or "").encode(), (text or "").encode()))
    made = defaultdict(list)
    for e in examples.collect():
        made[e.conv_id].append(e)
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        plain = [(r.decode(), x.decode()) for *_, r, x in turns]
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in plain).encode()).hexdigest()
        loss = "".join(x for r, x in plain if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(plain), digest)
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(e.formatted) for e in made[c])
        assert sum(e.loss_start is not None for e in made[c]) == sum(r == "assistant" for r, _ in plain)
        for e in made[c]:
            assert e.formatted.count(chat.END) == e.n_turns == len(re.findall(re.escape(chat.TURN), e.formatted))
    assert chat.chat_digest(chat.format_chats(df.limit(0))).collect() == []


@pytest.mark.parametrize("share", [1, 10_000])
def test_exact_dedup(spark, share):
    rng = random.Random(2)
    texts = ["a b", "ab", "a b", None, "", " \t\n\x0b\x0c\r", "x" * 5000, "x " * 5000, "éé", "ab"]
    rows = [(i if rng.random() < 0.95 else None, rng.choice(texts)) for i in range(300)] + [(1000 + i, "hot  copy" if i % 2 else "hotcopy ") for i in range(200)] + [(1000, "hotcopy ")] * 2
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")
    got = exact_dedup.exact_dedup(df, share=share).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    groups = defaultdict(list)
    for i, t in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups[hashlib.sha256(bare.encode()).hexdigest()].append((-len(t or ""), i is None, i))
    kept = Counter()
    for r in got:
        best = min(groups[r.text_sha256])
        assert (r.group_size, r.keep_id) == (len(groups[r.text_sha256]), best[2])
        if r.kept:
            kept[r.text_sha256] += 1
            assert (-len(r.text or ""), r.doc_id) == (best[0], best[2])
    assert kept == Counter(dict.fromkeys(groups, 1))
    assert exact_dedup.exact_dedup(df.limit(0)).collect() == []


def test_hot_copies_are_found(spark):
    df = spark.createDataFrame([(i, "hot" if i < 100 else str(i)) for i in range(200)], "doc_id long, text string")
    assert exact_dedup.hot_prints(df, F.xxhash64(exact_dedup.normalised(F.col("text"))), 4).count() == 1


@pytest.mark.parametrize("share", [1, 10_000])
def test_exact_dedup_replaces_columns_of_its_names(spark, share):
    rows = [(i, "hot copy" if i % 2 else f"text {i}") for i in range(200)]
    df = spark.createDataFrame([(*r, "x", "y", "z", "s") for r in rows], "doc_id long, text string, kept string, KEEP_ID string, group_size string, text_sha256 string")
    plain = exact_dedup.exact_dedup(df.select("doc_id", "text"), share=share)
    got = exact_dedup.exact_dedup(df, share=share)
    assert got.columns == plain.columns
    assert Counter(got.collect()) == Counter(plain.collect())


def test_exact_dedup_takes_any_ids(spark):
    rows = [(f"id{i:03}", "hot copy" if i % 2 else f"text {i}") for i in range(200)]
    for make, kind in ((lambda i: i, "string"), (lambda i: -(2**63) + int(i[2:]), "long")):
        df = spark.createDataFrame([(make(i), t) for i, t in rows], f"doc_id {kind}, text string")
        for share in (1, 10_000):
            got = exact_dedup.exact_dedup(df, share=share).collect()
            hot = [r for r in got if r.text == "hot copy"]
            assert len(got) == 200 and {r.keep_id for r in hot} == {make("id001")} and [r.doc_id for r in hot if r.kept] == [make("id001")] and {r.group_size for r in hot} == {100}


def test_op1_shards_and_slots(spark):
    got = queries.op1_sharding(spark, SF).collect()
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < 8 and r.grown_shard is None
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted(r.row_number for r in got) == list(range(len(got)))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.row_number)] == sorted(r.doc_id for r in got)


def test_shards_replace_columns_of_their_names(spark):
    df = spark.createDataFrame([(i, f"s{i}", "x", i % 5) for i in range(50)], "doc_id long, SHARD string, slot string, row_number int")
    plain = sharding.shard_rows(df.select("doc_id"), ["doc_id"], 8)
    got = sharding.shard_rows(df, ["doc_id"], 8)
    assert got.columns == plain.columns
    assert Counter(got.collect()) == Counter(plain.collect())


def test_long_chats(spark):
    text = "word <|end|> " * 100_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    got = chat.chat_digest(chat.format_chats(df)).first()
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
