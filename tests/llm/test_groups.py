"""Exact dedup, prefix tries and phrases against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import differences
from pyspark.sql import functions as F

from tidegrid.llm import exact_dedup, phrases, trie
from tidegrid.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_prefix_trie", "op13_phrases"])
def test_queries_equal_their_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), ORACLES[name], SF) == []


# -- exact dedup ---------------------------------------------------------------------------------------------------


def plain_classes(rows):
    """(id, keep, size, kept) of (id, text) rows; of rows that share all, any one is kept."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    found = []
    for ids in groups.values():
        ids.sort(key=lambda i: (i is None, i))
        found += [(i, ids[0], len(ids), at == 0) for at, i in enumerate(ids)]
    return sorted(found, key=repr)


@pytest.mark.parametrize("prefix, bits", [(64, 1 << 24), (1, 1 << 15)])
def test_exact_dedup_of_odd_rows(spark, odd_documents, prefix, bits):
    more = odd_documents.unionByName(odd_documents.withColumn("text", F.concat(F.lit("  "), F.col("text"), F.lit("\n\t"))))
    more = more.unionByName(odd_documents.withColumn("text", F.concat(F.lit(" "), F.regexp_replace("text", " ", "\n"), F.lit(" "))))
    rows = [(r.doc_id, r.text) for r in more.select("doc_id", "text").collect()]
    found = exact_dedup.classes(more, prefix=prefix, bits=bits).select("doc_id", "keep_id", "group_size", "kept")
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_classes(rows)
    stays = exact_dedup.deduplicated(more, prefix=prefix, bits=bits)
    assert stays.columns == more.columns
    kept = [(i, k) for i, _, _, k in plain_classes(rows) if k]
    assert sorted((r.doc_id for r in stays.collect()), key=repr) == sorted((i for i, _ in kept), key=repr)


def test_exact_dedup_of_a_large_group_and_of_nothing(spark, no_documents):
    rows = [(i, "same  text" if i % 3 else f"text {i % 50}") for i in range(3000)]
    found = exact_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert sorted((tuple(r)[:4] for r in found.collect()), key=repr) == plain_classes(rows)
    assert exact_dedup.classes(no_documents).count() == 0
    assert exact_dedup.deduplicated(no_documents).columns == no_documents.columns


def test_only_surviving_groups_are_hashed(spark):
    rows = [(1, "a b"), (2, "a  b"), (3, "a c"), (4, "abcd"), (5, "long " * 30 + "x"), (6, "long " * 30 + "y")]
    hashed = exact_dedup.hashed(spark.createDataFrame(rows, "doc_id long, text string"), [], prefix=3)
    assert {r.id for r in hashed.filter("key IS NOT NULL").collect()} == {1, 2, 5, 6}


# -- prefix tries --------------------------------------------------------------------------------------------------


def plain_nodes(turns, ids):
    """Nodes of (conv_id, place, role, text) rows by dictionaries of paths."""
    listed = defaultdict(list)
    for c, place, role, text in turns:
        if c is not None:
            listed[c].append((place is not None, place or 0, role or "", text or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for c in set(ids) - {None}:
        path = tuple((role, text) for _, _, role, text in sorted(listed[c]))
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = Counter(p[:-1] for p in members if p)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    found = []
    for p, inside in members.items():
        below = [q for q in members if q[: len(p)] == p]
        found.append((
            min(inside), len(p), min(members[p[:-1]]) if p else None, len(inside), children[p],
            sum(1 for q in below if not children[q]), sum((len(members[q]) - 1) * words(q) for q in below),
            hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
        ))
    return sorted(found, key=repr)


def random_turns(seed, conversations=120, deep=7):
    """Conversations over few turns, so that prefixes are shared; one conversation and one beginning are very common."""
    draw, rows, ids = random.Random(seed), [], []
    for c in range(-20, conversations - 20):
        ids.append(c)
        if c % 3 == 0:
            path = ["hello there", "yes", "one two three"]
        else:
            path = ["hello there"] * (c % 2) + [draw.choice(["a", "b b", "", "c c c"]) for _ in range(draw.randrange(deep))]
        rows += [(c, place, "user" if place % 2 else None, text or None) for place, text in enumerate(path)]
    return rows, ids


@pytest.mark.parametrize("shallow, weight", [(2, 4096), (1, 20), (3, 5), (1, 1)])
def test_trie_equals_dictionaries(spark, shallow, weight):
    rows, ids = random_turns(shallow)
    rows += [(None, 1, "user", "no id"), (7, None, "user", "first"), (7, None, "user", "first"), (7, 1, None, "tie"), (7, 1, "a", "tie")]
    turns = spark.createDataFrame(rows, "conv_id long, place long, role string, text string").repartition(5)
    found = trie.nodes(turns, spark.createDataFrame([(i,) for i in [*ids, None, 7]], "conv_id long"), shallow, weight)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_nodes(rows, ids)


def test_trie_of_a_long_and_of_no_conversation(spark):
    rows = [(c, place, "user", f"turn {place if place < 300 else (c, place)}") for c in (1, 2, 3) for place in range(320)]
    schema = "conv_id long, place long, role string, text string"
    ids = spark.createDataFrame([(c,) for c in (1, 2, 3)], "conv_id long")
    for weight in (100_000, 50):
        found = trie.nodes(spark.createDataFrame(rows, schema), ids, weight=weight)
        assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_nodes(rows, [1, 2, 3])
    assert trie.nodes(spark.createDataFrame([], schema), spark.createDataFrame([], "conv_id long")).count() == 0
    alone = trie.nodes(spark.createDataFrame([], schema), spark.createDataFrame([(5,)], "conv_id long")).collect()
    assert [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_leaves) for r in alone] == [(5, 0, None, 1, 1)]


def test_branches_follow_the_ids(spark):
    rows = [(c, t, "user", f"{c}.{t}", "x") for c in (-21, -20, 0, 3, 19, 20, 41) for t in range(5) if c != 41 or t < 1]
    turns, ids = trie.branched(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string"))
    found = defaultdict(list)
    for r in turns.orderBy("conv_id", "place").collect():
        found[r.conv_id].append(r.text)
    own = defaultdict(list)
    for c, _, _, text, _ in rows:
        own[c].append(text)
    for c in own:
        cut, head = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        assert found[c] == own.get(head, [])[:cut] + own[c][cut:]
    assert ids.count() == 7


def test_double_array_holds_what_was_packed():
    draw = np.random.default_rng(1)
    lengths = draw.integers(0, 9, 500)
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    codes = draw.integers(0, 40, lengths.sum()) ** 2 % 37
    array, depths = trie.packed(codes, starts, lengths)
    paths = {tuple(codes[s : s + d]) for s, n in zip(starts, lengths) for d in range(n + 1)}
    assert 1 + (array.check[1:] >= 0).sum() == len(paths)
    for path in paths:
        state = np.zeros(1, np.int64)
        for code in path:
            state = array.step(state, np.array([code]))
        assert state[0] >= 0 and depths[state[0]] == len(path)
        for code in range(38):
            assert (array.step(state, np.array([code]))[0] >= 0) == ((*path, code) in paths)


# -- phrases -------------------------------------------------------------------------------------------------------


def plain_phrases(rows, least, longest=5, top=2000, percent=100, scale=1000):
    counts, totals, small = defaultdict(Counter), Counter(), str.maketrans(phrases.CAPITALS.decode(), phrases.SMALL.decode())
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(small)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    found = []
    for lang, of in counts.items():
        ranked = []
        good = {p: f for p, f in of.items() if f >= least}
        for p, a in good.items():
            if len(p) < 2 or any(
                100 * f >= percent * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, f in good.items()
            ):
                continue
            score, _, left, rest = min((scale * a * totals[lang] // (of[p[:k]] * of[p[k:]]), k, of[p[:k]], of[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, rest))
        for rank, (score, a, p, left, rest) in enumerate(sorted(ranked)[:top], 1):
            found.append((lang, rank, p.decode(), -a, left, rest, totals[lang], -score))
    return sorted(found)


def phrase_texts(seed, n=150):
    draw = random.Random(seed)
    words = ["the", "of", "The", "sea", "é", "côte", "x-y", " z", "tide", "a\x00b", "b\u2028\x85"]
    texts = []
    for _ in range(n):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(draw.randrange(60)))
        texts.append((draw.choice([text, f" {text} the tide of the sea; ", "the tide of the sea"]), draw.choice(["en", "en", "fr", None])))
    return [*texts, (None, "en"), ("", "de"), (" \t\n", None), ("!?", "xx")]


@pytest.mark.parametrize("burst, most, longest, percent", [(16_384, 1_000_000, 5, 100), (3, 1_000_000, 5, 100), (4, 40, 5, 60), (2, 1, 2, 100)])
def test_phrases_equal_plain_counts(spark, burst, most, longest, percent):
    rows = phrase_texts(burst)
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("phrase", F.lit("x")).repartition(4)
    found = phrases.collocations(docs, least=5, longest=longest, top=30, percent=percent, bits=1 << 15, burst=burst, most=most)
    assert sorted(tuple(r) for r in found.collect()) == plain_phrases(rows, 5, longest, 30, percent)


def test_phrases_of_long_texts_and_of_nothing(spark, no_documents):
    rows = [("one two three " * 40_000, "en"), ("four FIVE six " * 300, "en")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in phrases.collocations(docs).collect()) == plain_phrases(rows, 100)
    assert phrases.collocations(no_documents).count() == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Counts of a very large corpus: products pass 64 bits, the result is exact."""
    rows = [("en", "p q", 2, 3_000_000_000_019), ("en", "p", 1, 7_000_000_000_003), ("en", "q", 1, 5_000_000_000_017)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, size int, n long")
    totals = spark.createDataFrame([("en", 90_000_000_000_000_007)], "lang string, total long")
    monkeypatch.setattr(phrases, "frequent", lambda *_: (counts, totals))
    expected = 1000 * rows[0][3] * 90_000_000_000_000_007 // (rows[1][3] * rows[2][3])
    assert [r.score for r in phrases.collocations(None).collect()] == [expected]


def test_hat_trie_counts_and_spills_whole_subtrees():
    draw = np.random.default_rng(0)
    rows = draw.integers(0, 12, (5000, 4))
    tree, found = phrases.HatTrie(4, burst=20), Counter()
    for part in np.array_split(rows, 7):
        tree.add(part)
        spilled = tree.spill(down_to=2000)
        if spilled is not None:
            firsts = set(spilled[0][:, 0].tolist())
            assert firsts.isdisjoint(tree.root)
            found.update({tuple(r): 0 for r in spilled[0].tolist()})
            for r, n in zip(spilled[0].tolist(), spilled[1].tolist()):
                found[tuple(r)] += n
    last = tree.spill()
    for r, n in zip(last[0].tolist(), last[1].tolist()):
        found[tuple(r)] += n
    assert found == Counter(map(tuple, rows.tolist())) and tree.entries == 0
