"""Queries of the numbered operators and of the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepiece_codec import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media_columns import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_bundles import archive_pages

    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeated_passages import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .surrogates import secret_key, surrogate_texts

    return surrogate_texts(table(spark, sf_dir, "documents"), secret_key(spark))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import DIGESTS, fill_in_middle

    return fill_in_middle(table(spark, sf_dir, "documents"), columns=DIGESTS)


def op12_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .interpolation import interpolated_scores

    return interpolated_scores(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling_variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_decontamination, op3_near_duplicates, op4_warc_bundles, op5_media_columns, op6_sentencepiece, op7_toxicity, op8_repeated_passages, op9_surrogates, op10_quality, op11_fill_in_middle, op12_deleted_interpolation, op13_spelling_variants, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc_bundles": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
            q AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
            r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS owner FROM q)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM owner AND owner IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to
            FROM r
        """,
        "op8_repeated_passages": """
            WITH w AS (
                SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
            s AS (
                SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
            r AS (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY win) > 1),
            c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
            d AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
            k AS (
                SELECT doc_id, ws, coalesce(len(gone), 0) AS n, list_filter(range(1, len(ws) + 1), lambda x: gone IS NULL OR NOT list_contains(gone, x)) AS stay
                FROM w LEFT JOIN d USING (doc_id))
            SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed,
                   sha256(array_to_string(list_transform(stay, lambda x: ws[x]), ' ')) AS kept_sha256
            FROM k
        """,
        "op11_fill_in_middle": """
            WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
            d AS (
                SELECT doc_id, text, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
                       CAST('0x' || h[17:24] AS BIGINT) % 100 AS p, CAST('0x' || h[25:32] AS BIGINT) % 100 AS q
                FROM t),
            f AS (
                SELECT doc_id, text, n, least(x, y) AS a, greatest(x, y) AS b,
                       CASE WHEN n = 0 OR regexp_matches(text, '<[PSM]>') OR p >= 90 THEN 'plain' WHEN q < 20 THEN 'spm' ELSE 'psm' END AS form
                FROM d)
            SELECT doc_id, CAST(n AS BIGINT) AS n, form,
                   CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
                   CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN text
                                    WHEN 'psm' THEN '<P>' || substring(text, 1, a) || '<S>' || substring(text, b + 1) || '<M>' || substring(text, a + 1, b - a)
                                    ELSE '<S>' || substring(text, b + 1) || '<P>' || substring(text, 1, a) || '<M>' || substring(text, a + 1, b - a) END) AS output_sha256,
                   sha256(text) AS restored_sha256
            FROM f
        """,
        "op3_near_duplicates": r"""
            WITH RECURSIVE d AS (
                SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
            s AS MATERIALIZED (
                SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
            n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            l AS MATERIALIZED (
                SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)
                JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
            e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
            r AS (SELECT a AS doc_id, a AS seen FROM e UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.doc_id WHERE r.seen < e.b),
            m AS (SELECT doc_id, min(seen) AS least FROM r GROUP BY doc_id)
            SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(m.least, d.doc_id), d.doc_id) AS component_id, coalesce(least(m.least, d.doc_id), d.doc_id) = d.doc_id AS kept
            FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
        """,
        "op13_spelling_variants": r"""
            WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (
                SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
            r AS (
                SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
                FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
            b AS (
                SELECT r.*, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS bytes
                FROM r),
            h AS (SELECT run, n, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM b, tab),
            c AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY ALL),
            w AS MATERIALIZED (SELECT word, n FROM c WHERE length(word) >= 5 AND n >= 3),
            d AS MATERIALIZED (SELECT word, i, substring(word, 1, i - 1) || substring(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
            p AS (
                SELECT d.word AS x, w.word AS y FROM d JOIN w ON d.cut = w.word
                UNION SELECT w.word, d.word FROM d JOIN w ON d.cut = w.word
                UNION SELECT a.word, z.word FROM d a JOIN d z ON a.cut = z.cut AND a.i = z.i AND a.word <> z.word),
            f AS (SELECT x AS word, count(*) AS n_near, arg_min(y, (-w.n, y)) AS best, max(w.n) AS best_n FROM p JOIN w ON w.word = p.y GROUP BY x),
            g AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n FROM w LEFT JOIN f USING (word)),
            s AS (SELECT word, form AS root FROM g WHERE form IS NOT NULL UNION ALL SELECT s.word, g.form FROM s JOIN g ON g.word = s.root WHERE g.form IS NOT NULL),
            e AS (SELECT s.word, s.root FROM s JOIN g ON g.word = s.root WHERE g.form IS NULL)
            SELECT g.word, g.form, coalesce(e.root, g.word) AS root, g.n, CAST(g.n_near AS BIGINT) AS n_near, g.form_n FROM g LEFT JOIN e USING (word)
        """,
    }
