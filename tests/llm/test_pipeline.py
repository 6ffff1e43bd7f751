"""The stages on a small table, each against plain Python on its own input, and the registered queries."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import plain
import public_tokenizers
from numweave.llm import mixing, queries
from tokenizers import Tokenizer

from numweave.llm.common import stored


def test_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        now = stored(stage(spark, now, str(tmp_path)), name)
        seen[name] = (before, now.collect())
        if name != "packing":
            assert now.columns == columns, name
    before, after = seen["quality_classifier"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if "HEADING" not in (r.text or "") and (r.text or "").split()} - {r.doc_id for r in before if r.doc_id >= 100} | {r.doc_id for r in after if r.doc_id >= 100}
    before, after = seen["line_dedup"]
    want = plain.wide_lines([(r.doc_id, r.text, r.source) for r in before], 10)
    assert {r.doc_id: r.text for r in after} == {i: t for i, (t, _) in want.items()}
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = seen["near_dedup"]
    sets = {r.doc_id: plain.shingles(r.text, 5) for r in before}
    roots = plain.least_reachable(sets, [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    assert {r.doc_id for r in after} == set(roots.values()) and len(after) < len(before)
    before, after = seen["mixture"]
    rates = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(before, docs.schema), labels, corpus_pipeline.WEIGHTS).collect()}
    assert Counter(r.doc_id for r in after) == Counter({i: r.copies for i, r in rates.items() if r.copies})
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
    before, after = seen["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, got = Counter(), Counter()
    for r in before:  # each copy's ids, piece by piece as the packing cut them
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        for x in {(x.start, x.length) for x in after if x.doc_id == r.doc_id}:
            want[(r.doc_id, *x)] = zlib.crc32(ids[x[0] : x[0] + x[1]].tobytes())
        got[r.doc_id] += len(ids)
    assert all(want[(r.doc_id, r.start, r.length)] == r.ids_crc32 for r in after)
    for i, n in got.items():
        assert sum(r.length for r in after if r.doc_id == i) == n
    sequences = defaultdict(list)
    for r in after:
        sequences[r.sequence_id].append((r.offset, r.length))
    for x in sequences.values():
        assert [a for a, _ in sorted(x)] == [0, *np.cumsum([n for _, n in sorted(x)])[:-1].tolist()] and (n := sum(n for _, n in x)) <= 2048 and n & (n - 1) == 0
    run = corpus_pipeline.run(spark, str(tmp_path))
    totals = lambda rows: Counter({i: sum(r.length for r in rows if r.doc_id == i) for i in {r.doc_id for r in rows}})
    assert totals(run.collect()) == totals(after)


def test_every_stage_takes_odd_tables(spark, empty, awkward, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
        got = stage(spark, awkward, str(tmp_path))
        assert got.count() > 0
        if name != "packing":
            assert got.columns == awkward.columns


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert sorted(int(m[1]) for m in (re.match(r"op(\d+)_", k) for k in queries.QUERIES) if m) == list(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
