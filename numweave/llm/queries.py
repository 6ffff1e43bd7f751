"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, collocations, embeddings, lines, mixing, packing, quality, secrets, sharding, simhash, substrings, tokens, tries
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_digest(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")), version=2)


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy does, and would do alone, from the ledger's bits."""
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents")), version=2)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.drop_wide_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placements(table(spark, sf_dir, "documents"), shards=8)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


def draw_sql(tree: list, key: str) -> str:
    """The shard that a key comes to in a hash tree, in SQL: the least -ln(u) / weight at each level."""
    if len(tree) == 1:
        return str(tree[0][2]) if isinstance(tree[0][2], int) else draw_sql(tree[0][2], key)
    draw = lambda name, weight: f"-ln((CAST('0x' || substr(md5({key} || '/{name}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / {weight}"
    nodes = [(draw(name, weight), str(below) if isinstance(below, int) else draw_sql(below, key)) for name, weight, below in tree]
    cases = " ".join(f"WHEN {k + 1} THEN {below}" for k, (_, below) in enumerate(nodes))
    draws = f"[{', '.join(x for x, _ in nodes)}]"
    return f"CASE list_position({draws}, list_min({draws})) {cases} END"


def crc_sql(data: str) -> str:
    """CRC-32 of bytes in SQL, from table ``crc`` (one row, ``t``: its 256 steps)."""
    return f"xor(list_reduce(list_transform(regexp_extract_all(hex({data}), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda r, x: xor(r >> 8, t[(xor(r, x) & 255) + 1]), 4294967295), 4294967295)"


CRC = "crc AS (SELECT list(list_reduce(range(8), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, k) ORDER BY k) AS t FROM range(256) x(k))"
TREE = sharding.hash_tree(8)

QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_substring_dedup,
        op3_simhash,
        op4_secret_scan,
        op5_quality_rules,
        quality_ablations,
        op6_quality_classifier,
        op7_embedding_dedup,
        op8_line_dedup,
        op9_token_counts,
        op10_packing,
        op11_sharding,
        op12_collocations,
        op13_conversation_trie,
    )
}

ORACLES = {
    "op2_substring_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 49))) AS k FROM d),
        s AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS s FROM w),
        f AS (SELECT s, min(doc_id) AS least FROM s GROUP BY s),
        c AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM s JOIN f USING (s) WHERE least < doc_id),
        r AS (SELECT doc_id, k, count(CASE WHEN p IS NULL OR k - p > 50 THEN 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM c),
        spans AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS b FROM r GROUP BY doc_id, run),
        cuts AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
        parts AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last,
                         string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head
                  FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
               CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN parts USING (doc_id)""",
    "op5_quality_rules": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        l AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
        w AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS k FROM l),
        g AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, array_to_string(words[k:k + 7], ' ')) AS n FROM w),
        r AS (SELECT doc_id, least(8, coalesce(lead(k) OVER (PARTITION BY doc_id ORDER BY k) - k, 8)) AS n FROM g WHERE n > 1),
        c AS (SELECT doc_id, sum(n) AS n FROM r GROUP BY doc_id),
        m AS (SELECT doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                     length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
                     len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
                     length(text) - length(regexp_replace(text, '[A-ZÄÖÜÉÈÊÇÑÁÍÓÚ]', '', 'g')) AS n_capitals
              FROM l LEFT JOIN c USING (doc_id)),
        b AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
                + 8 * (n_dup_lines > 3 AND 2 * n_dup_lines > n_lines)::INT + 16 * (word_chars > 15 * n_words)::INT
                + 32 * (2 * n_capitals > word_chars)::INT AS BIGINT) AS fail_bits FROM m)
        SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits & 63 = 0 AS kept, CAST(2 AS INTEGER) AS policy FROM b""",
    "op8_line_dedup": r"""
        WITH l AS (
          SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line,
                 unnest(range(len(string_split(text, chr(10))))) AS pos
          FROM documents WHERE text IS NOT NULL),
        t AS (SELECT doc_id, site, pos, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS key FROM l),
        w AS (SELECT key, min(doc_id) AS first FROM t WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= 10),
        m AS (SELECT t.*, w.first IS NOT NULL AND w.first <> t.doc_id AS gone FROM t LEFT JOIN w USING (key))
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op11_sharding": f"""
        WITH {CRC}, d AS (
          SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, {crc_sql("encode(coalesce(text, ''))")} AS text_crc32,
                 CAST({draw_sql(TREE, "coalesce(CAST(doc_id AS VARCHAR), '')")} AS INTEGER) AS shard,
                 CAST({draw_sql(sharding.grown(TREE, 8), "coalesce(CAST(doc_id AS VARCHAR), '')")} AS INTEGER) AS grown_shard
          FROM documents, crc)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard,
               row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM d""",
    "op12_collocations": r"""
        WITH RECURSIVE p AS (
          SELECT coalesce(lang, 'und') AS lang,
                 unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
          FROM documents),
        s AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
        g AS (SELECT lang, size, w[i:i + size - 1] AS w FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM s, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size)),
        f AS (SELECT lang, size, w, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
        n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM s GROUP BY lang),
        longer AS (SELECT lang, w, max(f) AS most FROM (SELECT lang, w[:-2] AS w, f FROM f WHERE size > 2 UNION ALL SELECT lang, w[2:], f FROM f WHERE size > 2) GROUP BY ALL),
        cut AS (SELECT lang, size, w, f, unnest(range(1, size)) AS k FROM f WHERE size > 1),
        part AS (SELECT c.lang, c.w, c.k, CAST(2000000 * CAST(c.f AS HUGEINT) // (a.f + b.f) AS BIGINT) AS score, a.f AS l, b.f AS r
                 FROM cut c JOIN f a ON a.lang = c.lang AND a.w = c.w[:c.k] JOIN f b ON b.lang = c.lang AND b.w = c.w[c.k + 1:]),
        best AS (SELECT lang, w, min({'score': score, 'k': k, 'l': l, 'r': r}) AS x FROM part GROUP BY ALL),
        e AS (SELECT row_number() OVER () AS e, lang, w FROM f WHERE size = 4),
        into_ AS (SELECT lang, w[2:] AS v, min(e) AS e FROM e GROUP BY ALL HAVING count(*) = 1), out_ AS (SELECT lang, w[:-2] AS v, min(e) AS e FROM e GROUP BY ALL HAVING count(*) = 1),
        link AS (SELECT i.e AS a, o.e AS b FROM into_ i JOIN out_ o USING (lang, v)),
        reach AS (SELECT e AS a, e AS b FROM e UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM link UNION ALL SELECT b, a FROM link) l ON l.a = r.b),
        path AS (SELECT e.lang, e.w, count(*) + 3 AS path_words FROM reach r JOIN e ON e.e = r.a GROUP BY ALL),
        o AS (SELECT f.lang, array_to_string(f.w, ' ') AS phrase, f.f AS a, x.l AS l, x.r AS r, x.score AS score, path_words
              FROM f JOIN best USING (lang, w) LEFT JOIN longer USING (lang, w) LEFT JOIN path USING (lang, w) WHERE size > 1 AND (most IS NULL OR 100 * most < 80 * f.f)),
        k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
        SELECT lang, rank, phrase, a, l, r, n, score, path_words FROM k JOIN n USING (lang) WHERE rank <= 2000""",
    "op13_conversation_trie": f"""
        WITH {CRC}, t AS (
          SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
                 coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        z AS (SELECT c, count(*) AS n FROM t GROUP BY c),
        h AS (SELECT z.c, z.n, z.c - z.c % 100 AS head, {crc_sql("encode(CAST(z.c AS VARCHAR))")} % 6 AS h FROM z, crc),
        v AS (SELECT h.*, least(h.h, coalesce(z.n, 0)) AS taken FROM h LEFT JOIN z ON z.c = h.head),
        m AS (SELECT v.c, taken + greatest(0, n - h) AS m FROM v),
        u AS (SELECT v.c, t.pos + 1 AS d, t.role, t.text FROM v JOIN t ON t.c = v.head AND t.pos < v.h
              UNION ALL SELECT v.c, t.pos - v.h + v.taken + 1, t.role, t.text FROM v JOIN t ON t.c = v.c AND t.pos >= v.h),
        i AS (SELECT *, dense_rank() OVER (ORDER BY role, text) AS turn FROM u),
        q AS (SELECT c, d, length(text) AS len, md5(CAST(list(turn) OVER (PARTITION BY c ORDER BY d) AS VARCHAR)) AS key FROM i
              UNION ALL SELECT c, 0, 0, '' FROM m),
        node AS (SELECT key, d, min(q.c) AS c, count(*) AS n_convs, max(len) AS len, lower(sha256(coalesce(string_agg(CAST(q.c AS VARCHAR), ',' ORDER BY q.c) FILTER (WHERE m.m = d), ''))) AS ends
                 FROM q JOIN m USING (c) GROUP BY key, d),
        p AS (SELECT node.*, up.c AS parent, up.key AS up FROM node LEFT JOIN q ON q.c = node.c AND q.d = node.d - 1 LEFT JOIN node up ON up.key = q.key AND up.d = q.d),
        k AS (SELECT up AS key, d - 1 AS d, count(*) AS n FROM p WHERE d > 0 GROUP BY ALL),
        w AS (SELECT p.*, coalesce(k.n, 0) AS n_children FROM p LEFT JOIN k ON k.key = p.key AND k.d = p.d),
        sums AS (SELECT q.key, q.d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * len) AS BIGINT) AS saved FROM w JOIN (SELECT c AS qc, key, d FROM q) q ON q.qc = w.c AND q.d <= w.d GROUP BY q.key, q.d)
        SELECT w.c AS conv_id, CAST(w.d AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved AS saved_tokens, ends AS ends_sha256
        FROM w JOIN sums ON sums.key = w.key AND sums.d = w.d""",
}

RULES = list(quality.POLICIES[2])  # in the order of their bits
ORACLES["quality_ablations"] = f"""
    WITH o AS ({ORACLES["op5_quality_rules"]}), r AS (SELECT unnest({RULES}) AS rule, unnest({[1 << k for k in range(len(RULES))]}) AS bit)
    SELECT CAST(2 AS INTEGER) AS policy, count(*) AS n, CAST(count(*) FILTER (WHERE fail_bits <> 0) AS BIGINT) AS n_failed, rule,
           count(*) FILTER (WHERE fail_bits & bit <> 0) AS failed, count(*) FILTER (WHERE fail_bits = bit) AS alone,
           bool_or(fail_bits & bit <> 0) AS ever, bool_and(fail_bits & bit <> 0) AS always
    FROM o, r GROUP BY rule"""
