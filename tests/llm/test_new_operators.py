"""Sharding, collocations and the conversation trie against plain versions, and their odd cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from numweave.llm import collocations, sharding, tries

# ---- 11 sharding


def test_sharding_law(spark, docs, rows):
    got = {r.doc_id: r for r in sharding.placements(docs).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, text, *_ in rows:
        data = (text or "").encode()
        assert (got[i].size, got[i].text_crc32, got[i].law) == (len(data) + 1, zlib.crc32(data), "key")
    for shard in range(8):
        own = sorted((r for r in got.values() if r.shard == shard), key=lambda r: r.doc_id)
        assert [r.slot for r in own] == list(range(len(own)))
    assert all(r.grown_shard in (r.shard, 8) for r in got.values())


def drawn(spark, tree, n=20_000):
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    return np.array(sharding.with_shard(ids, tree).orderBy("doc_id").toPandas()["shard"])


def test_sharding_by_weight_and_what_moves(spark):
    tree = sharding.hash_tree(8)
    before = drawn(spark, tree)
    assert np.abs(np.bincount(before, minlength=8) / len(before) - 1 / 8).max() < 0.01
    after = drawn(spark, sharding.grown(tree, 8))
    moved = before != after
    assert set(after[moved]) == {8} and abs(moved.mean() - 1 / 9) < 0.01
    # a shard of the first rack gets three times the weight, its rack's and region's stay: rows move within that rack only
    (name, weight, [(rack, rack_weight, [a, b]), other]), region = tree
    heavy = [(name, weight, [(rack, rack_weight, [(a[0], 3.0, a[2]), b]), other]), region]
    after = drawn(spark, heavy)
    moved = before != after
    assert set(before[moved]) == {1} and set(after[moved]) == {0}
    share = (after == 0).sum() / np.isin(after, [0, 1]).sum()
    assert abs(share - 0.75) < 0.02
    # a rack is emptied: only its rows move, and stay in the region
    after = drawn(spark, [(name, weight, [(rack, 0.0, [a, b]), other]), region])
    moved = before != after
    assert set(before[moved]) == {0, 1} and set(after[moved]) == {2, 3} and not set(after) & {0, 1}
    assert set(drawn(spark, sharding.hash_tree(3), 300)) == {0, 1, 2}


def test_sharding_odd_tables(spark, empty, awkward, tmp_path):
    assert sharding.placements(empty).count() == 0
    got = sharding.placements(awkward)
    assert got.count() == awkward.count()
    null = got.where("doc_id IS NULL").collect()
    assert len(null) == 1 and null[0].shard is not None
    twice = got.where("doc_id = 0").orderBy("slot").collect()
    assert len(twice) == 2 and twice[0].shard == twice[1].shard and twice[0].slot != twice[1].slot
    same = spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    assert sorted(r.slot for r in sharding.placements(same).collect()) == list(range(500))
    sharding.write_shards(awkward, str(tmp_path / "out"), sharding.hash_tree(8), files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == awkward.count() and set(awkward.columns) < set(back.columns)


# ---- 12 collocations


def plain_collocations(rows, least, top=2000):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        found = []
        for p, a in candidates.items():
            if not (longer[p] and 100 * longer[p] >= 80 * a):
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -score) for r, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def told(df):
    return sorted(tuple(r)[:8] for r in df.collect())


@pytest.mark.parametrize(("part", "words", "bucket"), [(4_000_000, 1 << 18, 1 << 20), (3000, 97, 40)])
def test_collocations_against_plain(docs, rows, monkeypatch, part, words, bucket):
    """Also in small parts and slices, and with buckets so small that pairs and triples of words are split over several."""
    monkeypatch.setattr(collocations, "PART", part)
    monkeypatch.setattr(collocations, "SLICE", words)
    got = told(collocations.collocations(docs, least=4, top=150, bucket=bucket))
    want = plain_collocations([(r[2], r[1]) for r in rows], 4, 150)
    assert got == want and len(want) > 150


def test_collocations_ties_cuts_and_limits(spark):
    """A hot pair with many continuations, pieces ended by each mark, a language that is null, ties ordered by bytes."""
    texts = [(None, "a b c d e\tf"), (None, "A B\nC D; é Z é z"), ("", "à b! à b? b à, à b")]
    rows = [("en", f"of the w{k % 97} x{k % 5} Y. of the w{k % 97}") for k in range(400)] + texts * 31
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for top, bucket in ((2000, 1 << 20), (3, 10)):
        got = told(collocations.collocations(frame, top=top, bucket=bucket))
        assert got == plain_collocations(rows, 30, top)
    assert {r[0] for r in got} == {"", "en", "und"}


def test_collocations_odd_tables(spark, empty, awkward):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None), ("en", ""), ("en", ". ,")], "lang string, text string")).count() == 0
    got = told(collocations.collocations(awkward, least=3))
    assert got == plain_collocations([(r.lang, r.text) for r in awkward.select("lang", "text").collect()], 3)


def test_collocations_compact_unary_paths(spark):
    """A long passage is one path; where it forks, paths end; a ring is a path too."""
    passage = " ".join(f"p{k}" for k in range(12))
    rows = [("en", passage)] * 5 + [("en", "a b c d e f g")] * 5 + [("en", "x b c d e f h")] * 5 + [("en", "r s t r s t r s t r s t")] * 5
    grams = {r.phrase: r.path_words for r in collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=5).collect()}
    whole = {p: n for p, n in grams.items() if len(p.split()) == 4}
    assert {n for p, n in whole.items() if p.startswith("p")} == {12}
    assert whole["b c d e"] == 5 and whole["a b c d"] == whole["x b c d"] == 4 and whole["d e f g"] == 4
    assert {n for p, n in whole.items() if p.startswith(("r ", "s ", "t "))} == {6}
    assert all(n is None for p, n in grams.items() if len(p.split()) < 4)


def test_words_of_very_long_texts_are_cut_between_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "PART", 50)
    text = "é " * 40 + ". one two\nthree " * 20 + "end"
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "fr", None]), pa.array([text, "short", None])], names=["lang", "text"])
    cut = [x.column("text")[0].as_py() for x in collocations.cut_long([batch]) if x.column("lang")[0].as_py() == "en"]
    assert "".join(cut) == text and len(cut) > 5 and all(x[-1] in ".\n" for x in cut[:-1])


# ---- 13 conversation trie


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    members, kids = defaultdict(list), defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    for q in members:
        if q:
            kids[q[:-1]].append(q)
    leaves, saved = {}, {}
    for q in sorted(members, key=len, reverse=True):
        leaves[q] = sum(leaves[k] for k in kids[q]) or 1
        saved[q] = sum(saved[k] for k in kids[q]) + (len(members[q]) - 1) * (len(q[-1][1]) if q else 0)
    ends = lambda q: hashlib.sha256(",".join(str(c) for c in members[q] if len(rebuilt[c]) == len(q)).encode()).hexdigest()
    return sorted((m[0], len(q), members[q[:-1]][0] if q else None, len(m), len(kids[q]), leaves[q], saved[q], ends(q)) for q, m in members.items())


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def talks():
    """Copies of long conversations that part at several depths, blocks with and without their first one, ties and nulls."""
    out = []
    for c in [*range(0, 60), *range(100, 103), 205, 217, 1900, 1912, 50_000]:
        kind = c % 4
        length = (3 + c % 7, 30, 30, 1)[kind]
        for t in range(length):
            text = f"turn {t} of {kind}" if t < 20 + c % 9 and kind in (1, 2) else f"turn {t} of {c % 11}"
            out.append((c, t, "user" if t % 2 == 0 else "assistant", text + "é" * (t % 3)))
    out += [(7, None, None, None), (7, 2, "user", "a tie"), (7, 2, "assistant", "a tie"), (7, 2, "user", "a tie"), (None, 0, "user", "no one's")]
    out += [(300, None, "system", None), (303, 0, None, ""), (303, None, "x", "y")]
    return out


@pytest.mark.parametrize("depth", [6, 1, 3, 12])
def test_trie_against_plain(spark, talks, depth):
    got = tries.prefix_trie(spark.createDataFrame(talks, CONVERSATIONS).repartition(4), shard_depth=depth)
    assert got.columns[:2] == ["conv_id", "depth"]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == plain_trie(talks)


def test_trie_odd_tables(spark, talks):
    assert tries.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    assert tries.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], CONVERSATIONS)).count() == 0
    frame = spark.createDataFrame(talks[:40], CONVERSATIONS).withColumns({c: F.lit("mine") for c in ("c", "k1", "depth", "pos", "p", "len", "m", "code")})
    assert tries.prefix_trie(frame).count() == len(plain_trie(talks[:40]))
    c = next(c for c in range(500, 600) if zlib.crc32(str(c).encode()) % 6 >= 2 and c % 100)
    alone = [(c, 0, "user", "short")]  # its own turn is cut, and no first conversation lends one
    assert [tuple(r) for r in tries.prefix_trie(spark.createDataFrame(alone, CONVERSATIONS)).collect()] == plain_trie(alone)


def test_double_array_holds_each_child_where_base_says():
    rng = np.random.default_rng(2)
    for n in (1, 2, 300):
        parent = np.array([0, *(int(rng.integers(0, k)) for k in range(1, n))])
        used, code = defaultdict(set), np.zeros(n, np.int64)
        for k in range(1, n):
            code[k] = next(c for c in rng.permutation(n) if c not in used[parent[k]])
            used[parent[k]].add(code[k])
        base, check, slot = tries.double_array(parent, code)
        assert len(set(slot.tolist())) == n
        for k in range(1, n):
            assert base[slot[parent[k]]] + code[k] == slot[k] and check[slot[k]] == slot[parent[k]]
        value = np.zeros(len(check), np.int64)
        value[slot] = 1
        tries.subtree_sums(check, value)
        want = np.ones(n, np.int64)
        for k in range(n - 1, 0, -1):
            want[parent[k]] += want[k]
        assert (value[slot] == want).all()
