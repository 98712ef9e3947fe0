"""Exact dedup, near dedup, repeated passages, BPE and mixing against plain Python, with awkward rows."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm.bpe import VOCABULARY, decode, encode, encoding, pieces
from fathom.llm.exact_dedup import Trie, dedup_exact, exact_duplicates
from fathom.llm.mixing import mix_sources
from fathom.llm.simhash import drop_near, near_groups
from fathom.llm.suffix_array import common_prefixes, drop_passages, repeated_passages, suffix_array

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, sid bigint, h string, k double, c0 string, row int, owner string, piece int"
EXTRA = ("en", "s", 1, 2, "h", 0.5, "c", 3, "o", 4)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


AWKWARD = [(1, "a b"), (1, "a b"), (2, "a b"), (3, None), (3, None), (4, ""), (5, ""), (None, "a b"), (None, None), (6, "é" * 70000), (7, "é" * 70000), (8, " \t\n"), (9, "...")]


# exact dedup


def test_exact_keeps_least_ids_and_null_texts(spark):
    kept = [(r["doc_id"], r["text"]) for r in dedup_exact(docs(spark, AWKWARD)).collect()]
    count = lambda x: kept.count(x)
    assert count((1, "a b")) == 1 and count((2, "a b")) == 0 and count((None, "a b")) == 0
    assert count((3, None)) == 2 and count((None, None)) == 1
    assert count((4, "")) == 1 and count((5, "")) == 0
    assert count((6, "é" * 70000)) == 1 and count((7, "é" * 70000)) == 0


def test_exact_columns_pass_and_empty_table(spark):
    d = docs(spark, AWKWARD)
    assert dedup_exact(d).schema == d.schema
    assert dedup_exact(docs(spark, [])).count() == 0 and exact_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_exact_row_that_stays_is_defined(spark, limit):
    rows = [("b", "t", k) for k in range(9)] + [("a", "t", 3), ("a", "t", 3), (None, "t", 0), (None, None, 1), (None, None, 1)]
    d = spark.createDataFrame(rows, "doc_id string, text string, `x.own` int").repartition(5)
    kept = [tuple(r) for r in dedup_exact(d, limit=limit).collect()]
    assert sorted(kept, key=str) == sorted([("a", "t", 3), (None, None, 1), (None, None, 1)], key=str)
    same = d.where("doc_id = 'b'")
    assert len({tuple(r) for k in (1, 3, 7) for r in dedup_exact(same.repartition(k), limit=limit).collect()}) == 1


def test_exact_pairs_with_tiny_budget_spill(spark):
    rng = random.Random(1)
    texts = [words(rng, rng.randint(1, 30)) for _ in range(150)]
    rows = [(i, rng.choice(texts)) for i in range(600)]
    least = {}
    for i, t in rows:
        least[t] = min(i, least.get(t, i))
    expect = {(i, least[t]) for i, t in rows if least[t] != i}
    for budget, limit in ((2_000, 0), (2_000, 9_000), (96 << 20, 1 << 20)):
        got = [tuple(r) for r in exact_duplicates(docs(spark, rows), budget=budget, limit=limit).collect()]
        assert len(got) == len(expect) and set(got) == expect


def test_trie_with_and_without_spill(tmp_path):
    rng = random.Random(2)
    keys = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))), i) for i in range(3000))
    least = {}
    for k, i in keys:
        least.setdefault(k, i)
    trie, got = Trie(3_000, f"file://{tmp_path}"), {}
    for k, i in keys:
        r = trie.insert(k, i)
        if r is not None:
            got[i] = r[1]
    assert trie.files
    for _, owner, own, _ in trie.filed():
        got[own] = owner
    assert got == {i: least[k] for k, i in keys}


# near dedup


def planted(rng):
    base = [words(rng, rng.randint(80, 300)) for _ in range(60)]
    rows, group = [], {}
    for b, t in enumerate(base):
        for c in range(rng.choice([1, 1, 2, 4])):
            w = t.split()
            for _ in range(0 if c == 0 else max(1, len(w) // 50)):
                w[rng.randrange(len(w))] = words(rng, 1)
            rows.append((len(rows), " ".join(w)))
            group[len(rows) - 1] = b
    return rows, group


def test_near_copies_are_found_and_others_left(spark):
    rows, group = planted(random.Random(4))
    of = {r["doc_id"]: r["group_id"] for r in near_groups(docs(spark, rows)).collect()}
    mates = defaultdict(list)
    for i, b in group.items():
        mates[b].append(i)
    pairs = [(x, y) for m in mates.values() for x in m for y in m if x < y]
    hit = sum(of.get(x, x) == of.get(y, y) for x, y in pairs)
    assert hit >= 0.9 * len(pairs)
    assert all(group[i] == group[g] for i, g in of.items())


def test_near_awkward_rows(spark):
    d = docs(spark, AWKWARD)
    groups = {tuple(r)[:2] for r in near_groups(d).collect()}
    assert {(1, 1), (2, 1), (6, 6), (7, 6)} <= groups
    assert not {i for i, _ in groups} & {3, 4, 5, 8, 9}
    kept = drop_near(d)
    assert kept.schema == d.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert 2 not in ids and 7 not in ids and {3, 4, 5, 8, 9, None} <= set(ids)
    assert near_groups(docs(spark, [])).count() == 0 and drop_near(docs(spark, [])).count() == 0


def test_near_copies_go_by_document_not_by_id(spark):
    rng = random.Random(9)
    a, b = words(rng, 60), words(rng, 60)
    rows = spark.createDataFrame([("1", a, "x", 1), ("2", a, "y", 2), ("2", b, "z", 3), ("2", b, "z", 3), (None, a, "n", 4), ("3", None, "m", 5)], "doc_id string, text string, `a.b` string, __gone int")
    kept = drop_near(rows)
    assert kept.columns == rows.columns
    assert sorted((r["doc_id"] or "", r["a.b"]) for r in kept.collect()) == [("1", "x"), ("2", "z"), ("2", "z"), ("3", "m")]


def test_thousand_copies_are_one_group(spark):
    t = words(random.Random(5), 100)
    got = near_groups(docs(spark, [(i, t) for i in range(1500)]))
    assert got.count() == 1500 and got.where("group_id <> 0").count() == 0


# repeated passages


def test_suffix_array_and_prefixes_against_sorting():
    rng = np.random.default_rng(0)
    for t in range(300):
        s = rng.integers(0, rng.integers(1, 6), rng.integers(1, 60))
        s = np.tile(s, 3) if t % 3 == 0 else s
        line = s.tolist()
        order = sorted(range(len(line)), key=lambda i: line[i:])
        sa = suffix_array(s)
        assert sa.tolist() == order

        def lcp(a, b):
            n = 0
            while max(a, b) + n < len(line) and line[a + n] == line[b + n]:
                n += 1
            return n

        assert common_prefixes(s, sa).tolist() == [0] + [lcp(a, b) for a, b in zip(order, order[1:])]


WORD = re.compile(rb"[^\x09-\x0d\x1c-\x20!-/:-@\[-`{-~]+")


def brute_passages(rows, least):
    seen, by = defaultdict(set), {}
    for i, t in rows:
        if i is None or t is None:
            continue
        by[i] = WORD.findall(t.encode())
        for k in range(len(by[i]) - least + 1):
            seen[tuple(by[i][k : k + least])].add(i)
    out = set()
    for i, w in by.items():
        cur = None
        for k in range(len(w) - least + 1):
            own = seen[tuple(w[k : k + least])]
            if len(own) > 1:
                if cur and k <= cur[1]:
                    cur[1], cur[2] = k + least, min(cur[2], min(own))
                else:
                    if cur:
                        out.add((i, cur[0], cur[1] - cur[0], cur[2]))
                    cur = [k, k + least, min(own)]
        if cur:
            out.add((i, cur[0], cur[1] - cur[0], cur[2]))
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
@pytest.mark.parametrize("least", [1, 3, 12])
def test_passages_against_all_windows(spark, least, hot):
    rng = random.Random(least)
    shared = [words(rng, rng.randint(least, least + 30)) for _ in range(8)]
    rows = [(i, ", ".join(rng.choice(shared) if rng.random() < 0.4 else words(rng, rng.randint(0, 40)) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    rows += [(100, "x y " * 60), (101, "x y " * 20), (102, "x x x"), (103, None), (None, shared[0]), (104, ""), (105, "é ü. " * 30)]
    got = {tuple(r) for r in repeated_passages(docs(spark, rows + rows[:5]), least=least, hot=hot).collect()}
    assert got == brute_passages(rows, least)


def test_passages_of_empty_and_null_tables(spark):
    assert repeated_passages(docs(spark, [])).count() == 0
    assert repeated_passages(docs(spark, [(None, None), (1, None), (2, "few words")])).count() == 0


def test_one_anchor_with_many_surroundings_is_split(spark):
    """A licence line in every document, each with other words around it, some of which repeat."""
    rng = random.Random(12)
    line = "all rights reserved by the owners of this work and no one else may copy it"
    around = [words(rng, 40) for _ in range(60)]
    rows = [(i, f"{rng.choice(around)} {line} {rng.choice(around)} {words(rng, 30)}") for i in range(300)]
    expect = brute_passages(rows, 50)
    assert len(expect) > 100
    for hot in (20_000, 20):
        assert {tuple(r) for r in repeated_passages(docs(spark, rows), hot=hot).collect()} == expect


def test_words_of_one_hash_are_told_apart(spark):
    """Thue-Morse words and their complements collide in any polynomial hash modulo 2**64."""
    bit = [bin(k).count("1") % 2 for k in range(2048)]
    x, y = ("".join("ab"[b ^ k] for b in bit) for k in (0, 1))
    same = [f"w{k}" for k in range(40)]
    text = lambda w: " ".join([*same[:20], w, *same[20:]])
    got = {tuple(r) for r in repeated_passages(docs(spark, [(1, text(x)), (2, text(y)), (3, text(y))]), least=30).collect()}
    assert got == brute_passages([(1, text(x)), (2, text(y)), (3, text(y))], 30) == {(2, 0, 41, 2), (3, 0, 41, 2)}


def test_dropped_passages_stay_in_the_least_document(spark):
    rng = random.Random(13)
    p, q = words(rng, 20), words(rng, 20)
    own = [words(rng, 5) for _ in range(4)]
    rows = [(3, f"{own[0]} ({p}). {own[1]}"), (1, f"{p}, {own[2]} {q}"), (2, f"{q} {p} {own[3]} é"), (4, None), (5, ""), (None, p)]
    d = docs(spark, rows)
    got = drop_passages(d, least=20)
    assert got.schema == d.schema
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {(3, f"{own[0]} (). {own[1]}"), (1, rows[1][1]), (2, f" {own[3]} é"), (4, None), (5, ""), (None, p)}
    assert drop_passages(docs(spark, []), least=20).count() == 0


# byte-level BPE


def test_bpe_any_chunking_equals_one_pass_and_round_trips(spark):
    rng = random.Random(6)
    texts = [words(rng, 400), "é" * 3000, "a" * 3000, " " * 2000 + "x" + "\n" * 1500, "日本語。" * 500, "don't we'll  \t\r\n" * 200, "", "<|endoftext|> ok", "a 　b " * 300]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, None), (None, "x y"), (0, texts[0])]
    enc = encoding(VOCABULARY)
    for chunk, overlap in ((65_536, 1_024), (97, 23), (50, 49)):
        d = docs(spark, rows)
        coded = encode(d, verify=True, chunk=chunk, overlap=overlap)
        assert coded.columns == [c for c in d.columns if c != "text"] + ["tokens", "round_trip"]
        got = coded.select("doc_id", "tokens", "round_trip").collect()
        assert len(got) == len(rows)
        expect = {i: enc.encode_ordinary(t) if t is not None else None for i, t in rows}
        for r in got:
            assert r["tokens"] == expect[r["doc_id"]] and r["round_trip"] in (True, None)
        back = {r["doc_id"]: r["text"] for r in decode(coded.select("doc_id", "tokens")).collect()}
        assert back == dict(rows)
    assert encode(docs(spark, [])).count() == 0


def test_texts_beyond_the_default_chunk_and_clashing_names(spark):
    rng = random.Random(14)
    texts = [words(rng, 40_000), "a" * 1_000_000, "日本語。" * 60_000, " " * 150_000 + "x", ("é\n" * 70_000) + "'ll"]
    rows = [(i, t, "old", True, i) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id int, text string, tokens string, round_trip boolean, `a.b` int")
    coded = encode(d, verify=True)
    assert coded.columns == ["doc_id", "a.b", "tokens", "round_trip"]
    enc = encoding(VOCABULARY)
    got = {r["doc_id"]: r for r in coded.collect()}
    assert all(got[i]["round_trip"] for i in got) and all(got[i]["tokens"] == enc.encode_ordinary(t) for i, t in enumerate(texts) if i not in (1, 3))
    back = decode(encode(d).withColumn("text", F.lit("stale")))
    assert back.columns == ["doc_id", "round_trip", "a.b", "tokens", "text"]
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(enumerate(texts))


def test_unknown_and_null_tokens_raise(spark):
    for bad in ([10**8], [-1], [None]):
        with pytest.raises(Exception, match="token"):
            decode(spark.createDataFrame([(bad,)], "tokens array<int>")).collect()
    cut = decode(spark.createDataFrame([(encoding(VOCABULARY).encode_ordinary("日")[:1],), ([],), (None,)], "tokens array<int>")).collect()
    assert "\ufffd" in cut[0]["text"] and cut[1]["text"] == "" and cut[2]["text"] is None


def test_pieces_join_to_the_text(spark):
    t = words(random.Random(7), 300)
    rows = pieces(spark.createDataFrame([(1, t)], "row bigint, text string"), 64, 16).orderBy("piece").collect()
    assert len(rows) > 5 and "".join(r["text"] for r in rows) == t


# mixing


def test_mix_keeps_to_budgets_and_whole_epochs(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randint(1, 50)), "en", rng.choice(["a", "b", None])) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = mix_sources(d, alpha=0.5)
    assert got.columns == [*d.columns, "__epoch"]
    n = F.size(F.split("text", " "))
    size = {r[0]: r[1] for r in d.groupBy("source").agg(F.sum(n)).collect()}
    root = {s: v**0.5 for s, v in size.items()}
    taken = {r[0]: r[1] for r in got.groupBy("source").agg(F.sum(n)).collect()}
    for s, v in size.items():
        budget = int(root[s] / sum(root.values()) * sum(size.values()))
        assert budget - 51 <= taken[s] <= budget
        whole = budget // v
        for e in range(whole):
            assert got.where(F.col("source").eqNullSafe(F.lit(s)) & (F.col("__epoch") == e)).count() == sum(r[3] == s for r in rows)


def test_mix_awkward_rows(spark):
    d = docs(spark, AWKWARD)
    got = mix_sources(d)
    assert got.columns == [*d.columns, "__epoch"] and got.count() > 0
    assert mix_sources(docs(spark, [])).count() == 0
    assert mix_sources(docs(spark, [(1, None), (2, "")])).count() == 0
    assert mix_sources(d, targets={"other": 1.0}).count() == 0
