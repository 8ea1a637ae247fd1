"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnline.llm.common import scan

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burnline.llm.token_files import token_file_digests

    return token_file_digests(scan(spark, sf_dir, "documents"), WORD_BPE)


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burnline.llm.sharding import shard

    return shard(scan(spark, sf_dir, "documents"), 40).drop("group")


def op3_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burnline.llm.embed_dedup import near_duplicate_vectors

    return near_duplicate_vectors(scan(spark, sf_dir, "embeddings"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burnline.llm.minhash import near_duplicates

    return near_duplicates(scan(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burnline.llm.packing import pack

    packed = pack(scan(spark, sf_dir, "documents"), WORD_BPE, 4096)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burnline.llm.warc import archive_round_trip

    return archive_round_trip(scan(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burnline.llm.toxicity import held_out, scored, train

    docs = scan(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scored(docs, train(docs, scan(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burnline.llm.bytebpe import round_trip_digests

    return round_trip_digests(scan(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burnline.llm.exact_dedup import exact_duplicates

    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    rows = exact_duplicates(scan(spark, sf_dir, "documents").select("doc_id", "text", digest.alias("text_sha256")))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burnline.llm.secret_scan import learn, span_digests

    docs = scan(spark, sf_dir, "documents").select("doc_id", "text")
    return span_digests(docs, learn(docs))


def op11_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burnline.llm.streambpe import round_trip_digests

    return round_trip_digests(scan(spark, sf_dir, "documents"), WORD_BPE)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burnline.llm.phrases import collocations

    return collocations(scan(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burnline.llm.filter_audit import audit

    return audit(scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_shards": op2_shards,
    "op3_embedding_near_duplicates": op3_embedding_near_duplicates,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_packing": op5_packing,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_exact_duplicates": op9_exact_duplicates,
    "op10_secrets": op10_secrets,
    "op11_streaming_bpe": op11_streaming_bpe,
    "op12_phrases": op12_phrases,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op3_embedding_near_duplicates": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER () AS r FROM embeddings),
        ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT a, a AS b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
        least AS (SELECT a, min(vec_id) AS component FROM reach JOIN v ON v.r = reach.b GROUP BY a),
        links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(vec_id = coalesce(component, vec_id), false) AS kept
        FROM v LEFT JOIN least ON least.a = v.r LEFT JOIN links ON links.a = v.r""",
    "op4_near_duplicates": """
        WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sets AS (SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
        flat AS (SELECT r, len(s) AS n, unnest(s) AS x FROM sets),
        pairs AS (SELECT a.r AS a, b.r AS b FROM flat a JOIN flat b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
        reach AS (SELECT a, a AS b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
        least AS (SELECT a, min(doc_id) AS component FROM reach JOIN sets ON sets.r = reach.b GROUP BY a)
        SELECT doc_id, len(s) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(doc_id = coalesce(component, doc_id), false) AS kept FROM sets LEFT JOIN least ON least.a = sets.r""",
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top, sha1(coalesce(html, '')) AS h FROM pages),
        bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', substr(h, i, 1))]), '') AS b FROM p)
        SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda k: CAST(substr(b, CAST(5 * i + k AS BIGINT), 1) AS INT) << CAST(5 - k AS INT)))::BIGINT, 1)), '') AS payload_digest,
            CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM bits""",
    "op9_exact_duplicates": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op13_filter_audit": """
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
        said AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, CAST(len(ws) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT)
                + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(w.doc_id > least, false) AS INT) AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN said ON said.doc_id = w.doc_id),
        h AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
        l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(c, bit)),
        o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
        s AS (SELECT filter_order, step, list_sum(list_transform(range(1, step), lambda i: CAST(1 << (ascii(substr(filter_order, i, 1)) - 65) AS INT))) AS before, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit FROM o, (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INT) AS step)),
        c AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (coalesce(before, 0)::BIGINT | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0)::BIGINT = 0 THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0)::BIGINT > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0)::BIGINT = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0)::BIGINT = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM h, s GROUP BY ALL)
        SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
            (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM c""",
    "op12_phrases": """
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
        g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) x(k))),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
        total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
        c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f FROM f WHERE k > 1),
        cuts AS (SELECT c.lang, c.k, c.phrase, c.f, i, array_to_string(w[1:i], ' ') AS p1, array_to_string(w[i + 1:], ' ') AS p2 FROM c, (VALUES (1), (2), (3)) x(i) WHERE i < c.k),
        scored AS (SELECT cuts.lang, cuts.phrase, cuts.f, i, a.f AS l, b.f AS r, (2000000::HUGEINT * cuts.f) // (a.f + b.f) AS score FROM cuts JOIN f a ON a.lang = cuts.lang AND a.phrase = p1 JOIN f b ON b.lang = cuts.lang AND b.phrase = p2),
        best AS (SELECT lang, phrase, any_value(f) AS a, arg_min({'l': l, 'r': r, 'score': score}, score::HUGEINT * 10 + i) AS s FROM scored GROUP BY lang, phrase),
        held AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(f) AS most FROM c, (VALUES (2), (3)) x(n), (VALUES (1), (2), (3)) y(i) WHERE n < k AND i + n - 1 <= k GROUP BY ALL),
        kept AS (SELECT best.* FROM best LEFT JOIN held ON held.lang = best.lang AND held.phrase = best.phrase WHERE coalesce(100::HUGEINT * most < 80::HUGEINT * a, true)),
        ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY s.score DESC, a DESC, encode(phrase)) AS rank, phrase, a, s FROM kept)
        SELECT ranked.lang, rank, phrase, a, s.l::BIGINT AS l, s.r::BIGINT AS r, n, s.score::BIGINT AS score FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000""",
}
