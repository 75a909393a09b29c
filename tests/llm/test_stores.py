"""Token files, prefix tries and ranked search against brute force, on fixtures with nulls, empty and long texts, ties and repeats."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quadspark.llm import lexical_search, prefix_trie, token_store

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")
VOCABULARY = vocabularies.path("word_bpe_49k.json")


def words(rng, n, size=60):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [None, "", " \t\n", "Hello, World's end... A.B é́ naïve ÀÉ,", "<|endoftext|>x <|ENDOFTEXT|>, <|startoftext|>", "x\u001cy\u0085z w İstanbul ΣΑΣ ǅ, 12a3 don't I'LL", "J\u030c H\u0331, E\u0301. I\u0307; Où? OÙ. k.. m., n!? \u2026. »,", "End.", "(x). y.\tz!\n", words(rng, 40_000)]
    out += [words(rng, rng.randrange(1, 200)) for _ in range(40)] + ["same text"] * 30
    out += ["".join(rng.choice("aB,.'é́ ß 語<|>1") for _ in range(60)) for _ in range(200)]
    return out


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, before long").repartition(7)


# ---- 11 token files ------------------------------------------------------------
@functools.cache
def vocabulary():
    return tokenizers.Tokenizer.from_file(VOCABULARY)


def brute_ids(text):
    return [*vocabulary().encode(text or "", add_special_tokens=False).ids, 2]


def test_token_files_hold_the_ids_of_whole_texts(spark, texts, tmp_path):
    for by_word in (True, False):
        store = token_store.TokenStore.write(docs(spark, texts), str(tmp_path / f"t{by_word}"), VOCABULARY, by_word=by_word, bytes_a_shard=20_000)
        start, want = 0, []
        for i, t in enumerate(texts):
            ids = brute_ids(t)
            want.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
            start += len(ids)
        assert sorted(tuple(r) for r in store.checksums().collect()) == want
        assert sorted(tuple(r) for r in store.index().collect()) == [w[:3] for w in want]
        assert {r.doc_id: r.ids for r in store.documents(3, 5).collect()} == {i: brute_ids(texts[i]) for i in (3, 4, 5)}


def test_token_stream_in_parts(spark, texts, tmp_path):
    store = token_store.TokenStore.write(docs(spark, texts), str(tmp_path / "t"), VOCABULARY, bytes_a_shard=20_000)
    whole = [x for t in texts for x in brute_ids(t)]
    assert store.shards().count() > 3
    for a, b in ((0, 5), (10, 10), (3, 90_000), (len(whole) - 7, len(whole) + 9)):
        assert [x for r in store.stream(a, b).orderBy("start").collect() for x in r.ids] == whole[a:b]


def test_token_files_can_be_read_in_parts(spark, texts, tmp_path):
    store = token_store.TokenStore.write(docs(spark, texts), str(tmp_path / "t"), VOCABULARY, bytes_a_shard=30_000, page_bytes=4_096)
    files = sorted((tmp_path / "t").glob("*.parquet"))
    last = None
    for f in files:
        held = pq.ParquetFile(f)
        columns = {held.metadata.row_group(0).column(i).path_in_schema: held.metadata.row_group(0).column(i) for i in range(5)}
        assert all(c.has_column_index and c.has_offset_index for c in columns.values())
        assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        ids = held.read(["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids) and (last is None or not ids or last <= ids[0])
        last = ids[-1] if ids else last
    plan = store.index()._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema", 1)[1].split(">")[0]
    assert "PushedFilters: [IsNotNull(doc_id)" in store.documents(1, 2)._jdf.queryExecution().executedPlan().toString()


def test_token_files_with_one_id_none_and_no_rows(spark, tmp_path):
    rows = [f"a {i}" for i in range(300)] + ["again"] * 300
    for ids in ([None] * 600, [5] * 600):
        store = token_store.TokenStore.write(docs(spark, rows, ids), str(tmp_path / f"t{ids[0]}"), VOCABULARY, bytes_a_shard=500)
        sizes = [r["count"] for r in store.rows().groupBy("shard").count().collect()]
        assert len(sizes) >= 4 and max(sizes) < 400
        got = store.index().orderBy("start").collect()
        assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(600)]
    empty = token_store.TokenStore.write(docs(spark, ["x"]).where("false"), str(tmp_path / "empty"), VOCABULARY)
    assert empty.checksums().collect() == []


# ---- 12 prefix trie ------------------------------------------------------------
def brute_trie(rows, block):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            halves = [int.from_bytes(digest[i : i + 8], "big", signed=True) for i in (0, 8)]
            own[c].append(((turn is not None, turn or 0, *halves), role, text))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        base = c - int(math.fmod(c, block))
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = turns if base == c else own.get(base, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = collections.Counter(seq[:-1] for seq in members if seq)
    leaves, saved = collections.Counter(), collections.Counter()
    for seq, held in members.items():
        for d in range(len(seq) + 1):
            leaves[seq[:d]] += not below[seq]
            saved[seq[:d]] += (len(held) - 1) * len(seq[-1][1]) if seq else 0
    out = []
    for seq, held in members.items():
        ends = ",".join(str(c) for c in sorted(held) if len(rebuilt[c]) == len(seq))
        out.append((min(held), len(seq), min(members[seq[:-1]]) if seq else None, len(held), below[seq], leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(8)
    rows = [(0, t, "user", f"base {t}") for t in range(4)] + [(100, t, "user", f"é{t}") for t in range(9)] + [(300, 0, None, "only")]
    for c in [*range(1, 40), *range(101, 130), *range(301, 310), 250, 251, -5, -120, -100]:
        rows += [(c, rng.choice([None, t]), rng.choice(["user", "assistant", None]), rng.choice(["yes", "no", "", None, "naïve"])) for t in range(rng.randrange(1, 9))]
    rows += [(c, t, "user", f"common {t}") for c in range(500, 580) for t in range(3)]
    rows += [(77, t, "user", f"long {t % 50}") for t in range(700)] + [(178, None, "user", "same")] * 300
    return rows + [(None, 1, "user", "nobody's")] + rows[:3]


@pytest.mark.parametrize("block", [1, 100])
def test_trie_against_brute_force(spark, talks, block):
    df = spark.createDataFrame([(*r, 1) for r in talks], "conv_id long, turn long, role string, text string, depth int").repartition(5)
    for more in ({}, {"rows_a_part": 60, "fan": 3, "stretch": 7, "local_rows": 20}):
        got = prefix_trie.prefix_trie(df, block=block, **more)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(talks, block)


def test_trie_of_an_empty_table_and_of_turnless_conversations(spark):
    shape = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], shape), block=100).count() == 0
    rows = [(c, 0, "user", "x") for c in range(1001, 1012)]  # no base: a conversation loses its first turns
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, shape), block=100)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows, 100)


# ---- 13 ranked search ----------------------------------------------------------
def brute_search(documents, items, k, multiplicity=False):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, split(t)) for i, t in documents]
    held = [(i, w) for i, w in held if w]
    total, length = len(held), sum(len(w) for _, w in held)
    df = collections.Counter(w for _, ws in held for w in set(ws))
    out = []
    for item, text in items:
        wanted = collections.Counter(split(text))
        ranked = []
        for i, ws in held:
            tf, m = collections.Counter(ws), 50 + 50 * len(ws) * total // length
            score = sum((n if multiplicity else 1) * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t, n in wanted.items() if tf[t])
            if score > 0:
                ranked.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(ranked)[:k], 1)]
    return out


def test_search_against_brute_force(spark, texts):
    rng = random.Random(2)
    ids = [None if i % 11 == 4 else i % 90 for i in range(len(texts))]
    items = [(1, words(rng, 30)), (2, "SAME Text same"), (2, "same, text; w1 w2"), (None, "w3é é́ 語 w3 w3 w4"), (4, None), (5, " ,. "), (6, "absent"), (7, words(rng, 200))]
    queries = spark.createDataFrame(items, "item_id long, text string")
    for more in ({}, {"docs_a_block": 9, "part_terms": 20}, {"multiplicity": True, "docs_a_block": 50}):
        got = lexical_search.ranked_search(docs(spark, texts, ids), queries, k=12, **more)
        assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(brute_search(zip(ids, texts, strict=True), items, 12, "multiplicity" in more))


def test_search_in_many_groups_of_tasks(spark):
    rows = [f"a{i % 7} b{i % 5} common" for i in range(400)]
    df = docs(spark, rows).repartition(150)
    items = [(1, "common a1 b2"), (2, "a3")]
    got = lexical_search.ranked_search(df, spark.createDataFrame(items, "item_id long, text string"), k=50)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_search(list(enumerate(rows)), items, 50))


def test_search_of_empty_tables(spark):
    none = docs(spark, ["x"]).where("false")
    items = spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert lexical_search.ranked_search(none, items).count() == 0
    assert lexical_search.ranked_search(docs(spark, ["x", None]), items.where("false")).count() == 0
    assert [tuple(r)[:3] for r in lexical_search.ranked_search(docs(spark, ["x", None]), items).collect()] == [(1, 1, 0)]
