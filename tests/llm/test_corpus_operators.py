"""Each operator against a plain version, and its odd cases."""

import random
import zlib
from collections import defaultdict

import numpy as np
import plain
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from numweave.llm import classifier, components, embeddings, hashing, lines, mixing, packing, quality, secrets, simhash, substrings, tokens

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---- 1 mixing


def test_mixing_meets_its_targets(docs, labels):
    got = mixing.mix(docs, labels, {"clean": 0.8, "low": 0.15, "toxic": 0.05}).toPandas()
    p = got[["p_clean", "p_low", "p_toxic"]].to_numpy()
    expected = (got.rate * got.tokens).to_numpy() @ p
    assert np.allclose(expected / got.tokens.sum(), [0.8, 0.15, 0.05], atol=1e-3)
    assert (got.rate >= 0).all() and np.allclose(p.sum(1), 1, atol=1e-6)
    assert ((got.copies == np.floor(got.rate)) | (got.copies == np.floor(got.rate) + 1)).all()
    assert len(got) == docs.count()


def test_mixing_odd_tables(spark, docs, labels, empty, awkward):
    assert mixing.mix(empty, labels).count() == 0
    assert mixing.mix(docs, labels.limit(0)).count() == docs.count()
    mixed = mixing.mixed(awkward, labels)
    assert mixed.columns == awkward.columns and mixed.where("x != 'mine x'").count() == 0


# ---- 2 substring dedup


def test_substrings_against_plain(docs, rows):
    got = by_id(substrings.dedup_digest(docs))
    for i, (n, removed, spans, kept) in plain.cut_substrings([r[:2] for r in rows], 50).items():
        assert tuple(got[i])[1:] == (n, removed, spans, plain.sha(kept)), i


def test_substrings_hot_anchors_are_dealt_by_window(spark, docs, rows, monkeypatch):
    want = by_id(substrings.dedup_digest(docs))
    monkeypatch.setattr(substrings, "MOST_HOT", 1 << 60)
    meet = substrings.meet_anchors
    monkeypatch.setattr(substrings, "meet_anchors", lambda x, hot, parts: meet(x, 2, parts))
    assert by_id(substrings.dedup_digest(docs)) == want


def test_substrings_odd_tables(empty, awkward):
    assert substrings.dedup_digest(empty).count() == 0
    got = substrings.dedup_digest(awkward).collect()
    assert len(got) == awkward.count()
    assert [r.n_removed for r in got if r.doc_id is None] == [0]


def test_substrings_of_rows_that_share_an_id(spark):
    """Each row loses what its own text shares with smaller ids; rows of one id take nothing from each other."""
    rng = random.Random(9)
    a, b, c, d = ("".join(rng.choices("abcdefghijklmnop ", k=200)) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, c + b + d), (3, "short"), (4, a[50:150] + c), (4, d + c), (4, None), (5, c), (-7, d[100:])]
    got = sorted(tuple(r) for r in substrings.dedup_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    want = []
    for i, text in rows:
        data, before = (text or "").encode(), [(t or "").encode() for k, t in rows if k < i]
        covered = bytearray(len(data))
        for k in range(len(data) - 49):
            if any(data[k : k + 50] in t for t in before):
                covered[k : k + 50] = b"\1" * 50
        spans = sum(x and not (k and covered[k - 1]) for k, x in enumerate(covered))
        want.append((i, len(data), sum(covered), spans, plain.sha(bytes(x for x, y in zip(data, covered) if not y))))
    assert got == sorted(want)


@given(st.lists(st.text("ab", max_size=150), min_size=1, max_size=6), st.integers(32, 50))
@settings(max_examples=40, deadline=None)
def test_previous_factor_finds_earlier_windows(texts, length):
    data = [t.encode() for t in texts if len(t) >= length]
    if data:
        doc, n = np.arange(len(data)), np.array([len(t) - length + 1 for t in data])
        segment, window = substrings.earlier_windows(doc, n, np.frombuffer(b"".join(data), np.uint8), length)
        want = {(s, w) for s, t in enumerate(data) for w in range(len(t) - length + 1) if any(t[w : w + length] in u for u in data[:s])}
        assert set(zip(segment.tolist(), window.tolist())) == want


# ---- 3 SimHash


def test_simhash_against_plain(docs, rows):
    got = by_id(simhash.near_duplicates(docs))
    prints = {r[0]: plain.simhash(r[1]) for r in rows}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    roots = plain.least_reachable(prints, linked)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", roots[i]) for i in prints}


def test_vantage_trees_find_all_links(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    flip = lambda x, k: x ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, len(x)), dtype=np.uint64))
    points = np.unique(np.concatenate([base, flip(base[:800], 3), flip(np.full(600, base[0]), 2)]))
    a, b = np.nonzero(np.bitwise_count(points[:, None] ^ points[None]) <= 3)
    want = simhash.label(len(points), a, b)
    frame = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long").repartition(3)
    edges = simhash.links(frame, sample=1024, leaf=100).toPandas()
    at = {int(x): k for k, x in enumerate(points.view(np.int64))}
    got = simhash.label(len(points), edges.a.map(at).to_numpy(np.int64), edges.b.map(at).to_numpy(np.int64))
    assert (got == want).all()


def test_simhash_odd_tables(empty, awkward):
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id IS NULL").count() == 1


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}}


# ---- 4 secrets


def test_secrets_against_plain(docs, rows):
    got = by_id(secrets.digest(secrets.scan_secrets(docs)))
    for i, text, *_ in rows:
        want = plain.secrets(text or "")
        assert got[i].base_sha256 == plain.sha(want)
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("key x7Gq9LmZ2kPw4RtY8vBn3 end", "entropy:4:25"),
        ("id 123e4567-e89b-12d3-a456-426614174000", ""),
        ("path some/long/folder/of/words12", ""),
        ("AAAAAAAAAAAAAAAAAAAAAAAA1", ""),
        ("EXAMPLEx7Gq9LmZ2kPw4RtY8vBn3", ""),
        ('ü secret="token" = "abcdefgh"', ""),
        ("Password:'aaaaaa'", "assign:0:16"),
    ],
)
def test_secret_spans(spark, text, spans):
    assert secrets.digest(secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first().spans == spans


def test_entropy_by_counts(spark):
    import math

    from pyspark.sql import functions as F

    rng = random.Random(8)
    texts = ["".join(rng.choice(secrets.ALPHABET[: rng.randint(2, 65)]) for _ in range(rng.randint(20, 60))) for _ in range(20)]
    entropy = lambda w: -sum(c / len(w) * math.log2(c / len(w)) for c in map(w.count, set(w)))
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", secrets.best_entropy(F.col("t"), 20).alias("e"))
    for t, e in frame.collect():
        assert e == pytest.approx(max(entropy(t[k : k + 20]) for k in range(len(t) - 19)))


def test_secrets_odd_tables(empty, awkward):
    assert secrets.digest(secrets.scan_secrets(empty)).count() == 0
    assert secrets.scan_secrets(awkward).count() == awkward.count()


# ---- 5 quality rules


def test_quality_against_plain(docs, rows):
    got = by_id(quality.apply_policy(quality.ledger(docs), 2))
    for i, text, *_ in rows:
        want, r = plain.quality(text or ""), got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_policies_and_ablations(docs, empty, awkward):
    ledger = quality.ledger(docs).persist()
    table = {r.rule: r for r in quality.ablations(ledger, 2).collect()}
    bits = [r.fail_bits & quality.mask(quality.POLICIES[2]) for r in ledger.collect()]
    for rule in quality.POLICIES[2]:
        one = quality.mask([rule])
        assert (table[rule].failed, table[rule].alone) == (sum(b & one != 0 for b in bits), sum(b == one for b in bits))
    assert table["few_words"].n_failed == sum(b != 0 for b in bits)
    strict, loose = (quality.apply_policy(ledger, v).where("kept").count() for v in (2, 1))
    assert strict < loose
    assert quality.ledger(empty).count() == 0 and quality.ledger(awkward).count() == awkward.count()


# ---- 6 classifier


def test_classifier_rejects_junk_and_keeps_prose(docs, rows):
    got = by_id(classifier.classify(docs))
    for i, text, *_ in rows:
        if "HEADING" in (text or ""):
            assert not got[i].kept
        elif i < 100:
            assert got[i].kept, text
        elif not (text or "").split():
            assert not got[i].kept and got[i].score == 0
    kept = {r.doc_id for r in classifier.good_documents(docs).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    m = len(classifier.LABELLERS)
    kind = rng.choice(m + 1, 20_000, p=[0.8] + [0.2 / m] * m)
    votes = np.ones((len(kind), m), np.int64)
    for k in range(m):
        votes[(kind == k + 1) & (rng.random(len(kind)) < 0.95), k] = classifier.BAD
        votes[(kind > 0) & (rng.random(len(kind)) < 0.2), k] = classifier.BAD
    pattern, back, count = np.unique(votes @ 3 ** np.arange(m), return_inverse=True, return_counts=True)
    good, chance = classifier.expectation_maximisation(pattern, count.astype(float))
    assert ((good[back] > 0.5) == (kind == 0)).mean() > 0.99
    assert (chance[:, 1, classifier.BAD] < 0.01).all() and (chance[:, 0, classifier.BAD] > 0.15).all()


def test_classifier_odd_tables(empty, awkward):
    assert classifier.classify(empty).count() == 0
    assert classifier.classify(awkward).count() == awkward.count()
    assert classifier.good_documents(awkward).columns == awkward.columns


@given(st.lists(st.text("ab é\n", max_size=12), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_word_hashes_and_counts(texts):
    data = [t.encode() for t in texts]
    at = np.append(0, np.cumsum([len(t) for t in data]))
    text = np.frombuffer(b"".join(data), np.uint8)
    starts, ends = hashing.spans(hashing.LETTER[text], at)
    words = [bytes(text[a:b]) for a, b in zip(starts, ends)]
    assert words == [w for t in data for w in t.split()]
    hashes = hashing.word_hashes(text, starts, ends)
    assert len(set(hashes.tolist())) == len(set(words))
    assert hashing.features(text, at)[3].tolist() == [len(t.split()) for t in data]


# ---- 7 embeddings


def vectors(spark, n=700):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, 16))
    x[100:160] = x[0] + 0.08 * rng.standard_normal((60, 16))
    x[200:220] = x[1] * 3
    x[300] = x[301] + 0.2 * rng.standard_normal(16)
    rows = [(int(k), [float(c) for c in v]) for k, v in enumerate(x)]
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] + [1.0] * 15), (9003, [1.0] * 3), (9004, [1e30] * 16), (9005, [1e-30] * 16), (9006, [None] + [1.0] * 15), (9007, [float("inf")] * 16)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>"), np.array([v for _, v in rows], np.float32).astype(float)


def test_embeddings_against_all_pairs(spark):
    frame, x = vectors(spark)
    got = by_id(embeddings.near_vectors(frame), "vec_id")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = np.argwhere(np.triu(x @ x.T >= 0.95, 1)).tolist()
    n = np.zeros(len(x), int)
    for a, b in linked:
        n[a] += 1
        n[b] += 1
    found = np.array([got[k].n_links for k in range(len(x))])
    assert (found == n).all()
    roots = plain.least_reachable(range(len(x)), linked)
    assert all(got[k].component_id == roots[k] for k in roots)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert [got[k].n_links for k in (9000, 9001, 9002, 9003, 9004, 9005, 9006, 9007)] == [0, 0, 0, 0, 1, 1, 0, 0]
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


# ---- 8 lines


def test_lines_against_plain(docs, rows, empty, awkward):
    got = by_id(lines.drop_wide_lines(docs, min_sites=4))
    want = plain.wide_lines([(r[0], r[1], r[3]) for r in rows], 4)
    assert sum(n for _, n in want.values()) > 3
    for i, text, *_ in rows:
        assert (got[i].text or "", got[i].n_removed) == want[i]
    assert lines.drop_wide_lines(empty).count() == 0
    kept = lines.drop_wide_lines(awkward, min_sites=2, counts=False)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() and kept.where("n_lines != 'mine n_lines'").count() == 0


# ---- 9 token counts


@given(st.sets(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=12), st.text("abcd", max_size=20))
@settings(max_examples=200, deadline=None)
def test_automaton_counts_like_greedy_pieces(pieces, word):
    n = k = 0
    while k < len(word):
        n += 1
        k += max((len(p) for p in pieces if word.startswith(p, k)), default=1)
    assert tokens.Automaton(pieces).count(word) == n


def test_token_counts_against_pieces(docs, rows, empty, awkward):
    pieces = set(tokens.pieces_of(PIECES))
    longest = max(map(len, pieces))

    def greedy(word):
        n = k = 0
        while k < len(word):
            size = next((m for m in range(min(longest, len(word) - k), 0, -1) if word[k : k + m] in pieces), 0)
            n += 1 if size else len(word[k].encode())
            k += size or 1
        return n

    got = by_id(tokens.count_tokens(docs, PIECES))
    for i, text, *_ in rows:
        words = (text or "").split()
        assert (got[i].n_words, got[i].n_tokens) == (len(words), sum(greedy("▁" + w) for w in words))
    assert tokens.count_tokens(empty, PIECES).count() == 0 and tokens.count_tokens(awkward, PIECES).count() == awkward.count()


# ---- 10 packing


def test_packing_holds_every_id_once(docs, rows, empty, awkward):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    want = {r[0]: np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4") for r in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    got = packing.pack(docs, BPE, buffer_tokens=3000).collect()
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    groups = defaultdict(int)
    for x in sequences.values():
        at = 0
        for r in sorted(x, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == x[0].sequence_size <= 2048 and at & (at - 1) == 0
        groups[x[0].step_group] += at
    assert max(groups.values()) <= 16_384
    assert packing.pack(empty, BPE).count() == 0
    assert {r.doc_id for r in packing.pack(awkward, BPE).collect()} == {r.doc_id for r in awkward.collect()}


def test_packing_is_the_same_again(docs):
    one, two = (sorted(map(tuple, packing.pack(docs, BPE).collect()), key=str) for _ in range(2))
    assert one == two
