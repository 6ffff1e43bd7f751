"""Near duplicates by five-word Jaccard, against all pairs in plain Python."""

import random

import corpus_pipeline
import plain

from numweave.llm import shingles


def test_near_dedup_takes_five_words_at_similarity_of_four_fifths(spark, monkeypatch):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts, base = [], fresh(120)
    for k in range(40):  # changed words, from one at the end to 20: similarities on both sides of 0.8
        words = list(base) if k < 20 else fresh(rng.randint(30, 120))
        for _ in range(k % 20 // 4):
            words[rng.randrange(len(words))] = fresh(1)[0]
        texts += [" ".join(words), " ".join([*words, *fresh(k // 3)])]
    texts += [None, " ", "one two", "One  two", "one two three"]
    frame = spark.createDataFrame([*((i, t) for i, t in enumerate(texts)), (None, texts[0])], "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    roots = plain.least_reachable({i: None for i in range(len(sets))}, links)
    assert 20 < len(set(roots.values())) < len(sets) - 20
    for centres in (3, 1):
        monkeypatch.setattr(shingles, "CENTRES", centres)
        assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect() if r.doc_id is not None) == sorted(set(roots.values()))
    assert corpus_pipeline.near_dedup(spark, frame, "").where("doc_id IS NULL").count() == 1
