"""The corpus operators as queries over the test tables, with SQL where SQL can say the result."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custoria.llm.common import prepare, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, twin: str | None = None):
    def register(function):
        @wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(prepare(spark), folder)

        QUERIES[name] = run
        if twin:
            TWINS[name] = twin
        return run

    return register


@query("op5_packing")
def op5(spark, folder):
    from custoria.llm.packing import pack_documents

    return pack_documents(read(spark, folder, "documents"))


@query(
    "op9_exact_dedup",
    r"""
    WITH rows AS (
      SELECT doc_id, length(coalesce(text, '')) AS n,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
      FROM documents),
    best AS (
      SELECT text_sha256, count(*) AS group_size, arg_max(doc_id, (n, -doc_id)) AS keep_id
      FROM rows GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
    FROM rows JOIN best USING (text_sha256)""",
)
def op9(spark, folder):
    from custoria.llm.exact_dedup import exact_groups

    return exact_groups(read(spark, folder, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(
    "op6_shingle_join",
    r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, list_filter(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
      FROM documents),
    shingles AS (
      SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]
                                   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
        FROM words)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (
      SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common
      FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (
      SELECT u, v FROM shared JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v
      WHERE 100 * common >= 90 * (a.n + b.n - common)),
    reach AS (
      SELECT doc_id AS u, doc_id AS v FROM words
      UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u)
    SELECT words.doc_id, coalesce(n, 0) AS n_shingles, component_id
    FROM words LEFT JOIN sizes USING (doc_id)
         JOIN (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u) USING (doc_id)""",
)
def op6(spark, folder):
    from custoria.llm.shingle_join import shingle_groups

    return shingle_groups(read(spark, folder, "documents"), words=3, percent=90)


@query("op8_language_id")
def op8(spark, folder):
    from custoria.llm.language_id import with_language

    return with_language(read(spark, folder, "documents"))


@query("op7_decontamination")
def op7(spark, folder):
    from custoria.llm.decontamination import find_items

    return find_items(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query("op1_quality")
def op1(spark, folder):
    from custoria.llm.quality import with_quality

    return with_quality(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op10_toxicity")
def op10(spark, folder):
    from custoria.llm.toxicity import with_toxicity

    return with_toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op3_personal_data")
def op3(spark, folder):
    from custoria.llm.personal_data import find_personal_data

    return find_personal_data(read(spark, folder, "documents"))


@query("op2_repeats")
def op2(spark, folder):
    from custoria.llm.repeats import remove_repeats

    return remove_repeats(read(spark, folder, "documents"))


@query("op4_licences")
def op4(spark, folder):
    from custoria.llm.licences import find_licences

    return find_licences(read(spark, folder, "documents"))


@query(
    "op11_fill_in_middle",
    r"""
    WITH texts AS (
      SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
      FROM documents),
    numbers AS (
      SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y,
             ('0x' || h[17:24])::BIGINT % 100 AS share, ('0x' || h[25:32])::BIGINT % 100 AS turn
      FROM texts),
    cuts AS (
      SELECT doc_id, t, n, least(x, y) AS a, greatest(x, y) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR share >= 90 THEN 'plain'
                  WHEN turn < 20 THEN 'spm' ELSE 'psm' END AS form
      FROM numbers),
    pieces AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM cuts)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM pieces""",
)
def op11(spark, folder):
    from custoria.llm.fill_in_middle import digests

    return digests(read(spark, folder, "documents"))


@query(
    "op12_sharding",
    r"""
    WITH RECURSIVE polynomial AS (
      SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
      UNION ALL
      SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM polynomial WHERE k < 8),
    crc AS (SELECT list(c ORDER BY i) AS entry FROM polynomial WHERE k = 8),
    rows AS (
      SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, strlen(coalesce(text, '')) + 16 AS size,
             xor(list_reduce(
               list_prepend(4294967295, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: ('0x' || h)::BIGINT)),
               lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
      FROM documents, crc),
    keys AS (SELECT DISTINCT key FROM rows),
    scores AS (
      SELECT key, s AS shard, -ln((('0x' || sha256(key || ':' || s)[1:13])::BIGINT + 0.5) / 4503599627370496) AS score
      FROM keys, range(41) r(s)),
    homes AS (
      SELECT key, arg_min(shard, (score, shard)) FILTER (shard < 40) AS shard, arg_min(shard, (score, shard)) AS grown_shard
      FROM scores GROUP BY key)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, grown_shard::INT AS grown_shard,
           row_number() OVER (PARTITION BY shard ORDER BY sha256(key)[1:13], doc_id, size, text_crc32) - 1 AS slot
    FROM rows JOIN homes USING (key)""",
)
def op12(spark, folder):
    from custoria.llm.sharding import placed

    return placed(read(spark, folder, "documents"))


@query(
    "op13_filter_audit",
    r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
      FROM documents),
    firsts AS (SELECT coalesce(text, '') AS t, min(doc_id) AS least FROM documents GROUP BY ALL),
    masks AS (
      SELECT doc_id, part,
             [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
              100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
              regexp_matches(t, '[#$%&*|]'), coalesce(least < doc_id, false)] AS fails
      FROM words JOIN firsts USING (t)),
    judged AS (
      SELECT masks.*, EXISTS (FROM labels l WHERE l.doc_id = masks.doc_id AND quality = 1) AS good,
             EXISTS (FROM labels l WHERE l.doc_id = masks.doc_id AND toxic = 1) AS toxic
      FROM masks),
    orders AS (
      SELECT '' AS o UNION ALL
      SELECT o || letter FROM orders, (SELECT unnest(string_split('ABCDE', '')) AS letter) WHERE NOT contains(o, letter)),
    steps AS (
      SELECT o AS filter_order, step::INT AS step, ascii(o[step]) - 64 AS place, list_transform(string_split(o[1:step - 1], ''), lambda x: ascii(x) - 64) AS earlier
      FROM orders, range(1, 6) r(step) WHERE length(o) = 5),
    marked AS (
      SELECT part, filter_order, step, place, good, toxic, fails[place] AS here,
             len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone,
             len(list_filter(fails, lambda f: f)) = 1 AS alone
      FROM judged, steps),
    counted AS (
      SELECT part, filter_order, step, place, count(*) FILTER (NOT here AND NOT gone) AS kept, count(*) FILTER (here AND NOT gone) AS removed,
             count(*) FILTER (here AND gone) AS redundant, count(*) FILTER (here AND alone) AS unique_fails,
             count(*) FILTER (here AND NOT gone AND good) AS good_lost, count(*) FILTER (here AND NOT gone AND toxic) AS toxic_lost
      FROM marked GROUP BY ALL)
    SELECT * EXCLUDE (place), sum(removed) OVER (PARTITION BY part, place)::BIGINT AS shapley FROM counted""",
)
def op13(spark, folder):
    from custoria.llm.filter_audit import audit

    return audit(read(spark, folder, "documents"), read(spark, folder, "labels"))
