"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.tables import table
from lodestone.staging import stage

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return keep


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from lodestone.llm.simhash import near_duplicates

    found = near_duplicates(documents(spark, folder), words=3, radius=2)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op10_licence_scan")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from lodestone.llm.licences import scan

    return scan(documents(spark, folder))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op6_personal_data")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from lodestone.llm.personal_data import KINDS, find

    found = find(documents(spark, folder))
    counts = [
        F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}")
        for k in KINDS
    ]
    return found.select(
        "doc_id", *counts,
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


@query("op9_quality_classifier")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from lodestone.llm.quality import train, with_score

    docs = documents(spark, folder).select("doc_id", "text")
    network = train(docs, table(spark, folder, "labels"))
    scored = with_score(docs, network)
    return scored.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


@query("op8_warc_zip", """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages
    ), f AS (SELECT digest, min(page_id) AS first FROM p GROUP BY digest),
    bits AS (
        SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
            ('0b' || substr(b, 5 * i + 1, 5)) AS INTEGER), 1), '' ORDER BY i) AS payload_digest
        FROM (SELECT page_id, string_agg(lpad(bin(CAST('0x' || c AS INTEGER)), 4, '0'), '' ORDER BY k) AS b
              FROM (SELECT page_id, k, digest[k] AS c FROM p, range(1, 41) r(k)) GROUP BY page_id),
             range(0, 32) q(i)
        GROUP BY page_id
    )
    SELECT p.page_id, strlen(html) AS payload_bytes, payload_digest,
        CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN p.page_id = f.first THEN NULL ELSE f.first END AS refers_to
    FROM p JOIN f USING (digest) JOIN bits USING (page_id)
""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from lodestone.llm.warc_zip import read, write

    return read(write(table(spark, folder, "pages"))).drop("url")


@query("op5_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
        doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from lodestone.llm.exact import mark_duplicates

    docs = documents(spark, folder)
    small = docs.select(
        "doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )
    return mark_duplicates(small).select(
        "row.doc_id", "keep_id", "group_size", "kept", "row.text_sha256"
    )


@query("op7_token_records")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.token_records import read, write

    index = write(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))
    return read(index)


@query("op2_sentencepiece")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.pieces import round_trip

    return round_trip(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


def _decontamination_sql() -> str:
    from lodestone.llm.decontaminate import UNITS

    units = ", ".join(f"'{u}'" for u in UNITS)
    digit = "substr({0}, 1, 1) BETWEEN '0' AND '9'"

    def form(name: str) -> str:
        return (
            f"list_transform(words, lambda w, i: CASE WHEN {digit.format('w')} THEN '<n>' "
            f"WHEN i > 1 AND lower(w) IN ({units}) AND {digit.format('words[greatest(i - 1, 1)]')} "
            f"THEN '<u>' {name}ELSE lower(w) END)")

    def windows(table: str, key: str) -> str:
        return " UNION ALL ".join(
            f"SELECT {key}, {f} AS form, i AS pos, t[i + 1 : i + 8] AS w FROM "
            f"(SELECT {key}, {form(name)} AS t FROM {table}), "
            "LATERAL (SELECT unnest(range(0, len(t) - 7)) AS i)"
            for f, name in ((0, ""), (1, "WHEN lower(w) <> w THEN '<p>' ")))

    split = "list_filter(regexp_split_to_array(coalesce(text, ''), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    return f"""
        WITH d AS (SELECT doc_id, {split} AS words FROM documents),
        b AS (SELECT item_id, {split} AS words FROM benchmark),
        dw AS ({windows('d', 'doc_id')}),
        bw AS (SELECT * FROM ({windows('b', 'item_id')})
               WHERE len(list_filter(w, lambda x: x NOT IN ('<n>', '<u>', '<p>'))) >= 4),
        totals AS (SELECT item_id, count(DISTINCT pos) AS windows FROM bw GROUP BY item_id),
        g AS (SELECT doc_id, item_id, dw.pos - bw.pos AS shift, list(DISTINCT bw.pos) AS places
              FROM dw JOIN bw USING (form, w) GROUP BY ALL),
        e AS (SELECT * FROM g JOIN totals USING (item_id) WHERE len(places) >= 0.5 * windows),
        p AS (SELECT DISTINCT doc_id, item_id, shift, windows, len(places) AS matched, q + k AS place
              FROM e, LATERAL (SELECT unnest(places) AS q), range(0, 8) r(k)),
        v AS (SELECT p.*, lower(b.words[place + 1]) AS x, lower(d.words[place + shift + 1]) AS y
              FROM p JOIN b USING (item_id) JOIN d USING (doc_id)),
        j AS (SELECT doc_id, item_id, shift, windows, matched,
                  count(*) FILTER (WHERE x <> y) AS changed
              FROM v GROUP BY ALL HAVING count(DISTINCT (x, y)) = count(DISTINCT x))
        SELECT doc_id, item_id, unnest(max_by({{'matched': matched, 'windows': windows, 'changed': changed}},
            (matched, -changed))) FROM j GROUP BY doc_id, item_id
    """


@query("op3_benchmark_decontamination", _decontamination_sql())
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from lodestone.llm.decontaminate import contaminated

    return contaminated(documents(spark, folder), table(spark, folder, "benchmark"))


@query("op1_substring_dedup", """
    WITH d AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS words FROM documents
    ), w AS (
        SELECT doc_id, i AS start, sha256(array_to_string(words[i + 1 : i + 50], ' ')) AS h
        FROM d, LATERAL (SELECT unnest(range(0, len(words) - 49)) AS i)
    ), f AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
    gone AS (
        SELECT DISTINCT doc_id, start + k AS place FROM w JOIN f USING (h), range(0, 50) r(k)
        WHERE doc_id > first
    ), g AS (SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id)
    SELECT doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
        sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE list_filter(
            words, lambda x, i: NOT list_contains(places, i - 1)) END, ' ')) AS kept_sha256
    FROM d LEFT JOIN g USING (doc_id)
""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from lodestone.llm.substrings import remove_repeats

    return remove_repeats(documents(spark, folder))


def _crc32(value: str) -> str:
    """Unsigned CRC-32 of the decimal digits of a number, bit by bit from its definition."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split("
        f"CAST({value} AS VARCHAR), ''), lambda c: ord(c)::BIGINT)), lambda s, b: "
        f"xor(s >> 8, list_extract({table}::BIGINT[], 1 + (xor(s, b) & 255)))))")


@query("op11_periodic_runs", f"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, {_crc32('doc_id')} AS h,
            regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents
    ), s AS (
        SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS told,
            CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, (h // 10) % 8 AS k FROM d
    ), words AS (
        SELECT r, doc_id, CASE WHEN told THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1]
            ELSE w[a + (i - a) % (1 + (n - a) // (3 + k)) + 1] END) ELSE w END AS w FROM s
    ), grams AS (
        SELECT r, i, hash(w[i + 1 : i + 16]) AS g FROM words, LATERAL (SELECT unnest(range(0, len(w) - 15)) AS i)
    ), often AS (SELECT r, g FROM grams GROUP BY r, g HAVING count(*) > 1),
    kept AS (SELECT r, i, g FROM grams SEMI JOIN often USING (r, g)),
    pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM kept x JOIN kept y ON x.r = y.r AND x.g = y.g AND y.i > x.i),
    islands AS (SELECT r, i, q, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
    spans AS (SELECT r, min(i) AS start, count(*) + 15 + q AS length, q FROM islands GROUP BY r, q, island),
    runs AS (SELECT r, start, length, min(q) AS period FROM spans
             WHERE length >= 24 AND length >= 3 * q GROUP BY r, start, length),
    told AS (
        SELECT r, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), ''
            ORDER BY start, period)) AS runs_sha256,
            arg_min({{'start': start, 'length': length, 'period': period}},
                    (-length::DOUBLE / period, start, period)) AS best FROM runs GROUP BY r
    ), gone AS (SELECT r, list(DISTINCT i) AS gone FROM runs, LATERAL (
        SELECT unnest(range(start + period, start + length)) AS i) GROUP BY r)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length,
        best.period AS period, 1000 * best.length // best.period AS exponent_milli,
        coalesce(runs_sha256, sha256('')) AS runs_sha256,
        sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(
            w, lambda x, i: NOT list_contains(gone, i - 1)) END, ' ')) AS collapsed_sha256,
        CASE WHEN gone IS NULL THEN len(w) ELSE len(w) - len(gone) END AS n_words_kept
    FROM words LEFT JOIN told USING (r) LEFT JOIN gone USING (r)
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from lodestone.llm.periodic import periodic_runs

    return periodic_runs(documents(spark, folder), planted=True)


@query("op12_prefix_trie", f"""
    WITH t AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place,
            coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    ), c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32('conv_id')} % 9 AS h
             FROM (SELECT DISTINCT conv_id FROM t)),
    rebuilt AS (
        SELECT c.conv_id, place, role, text FROM c JOIN t ON t.conv_id = base AND place < h
        UNION ALL SELECT c.conv_id, place + 1000000, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND place >= h
    ), v AS (SELECT conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY place) FILTER (place IS NOT NULL), [])
                 AS turns FROM c LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id),
    p AS (SELECT conv_id, d AS depth, turns[1 : d] AS key, len(turns) = d AS ends,
              CASE WHEN d = 0 THEN 0 ELSE strlen(turns[d].text) END AS bytes, turns
          FROM v, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)),
    nodes AS (
        SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
            sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), ''))
                AS ends_sha256 FROM p GROUP BY depth, key
    ), children AS (SELECT depth - 1 AS depth, key[1 : depth - 1] AS key, count(*) AS n_children
                    FROM nodes WHERE depth > 0 GROUP BY ALL),
    linked AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children
               FROM nodes LEFT JOIN children USING (depth, key)),
    below AS (
        SELECT d AS depth, key[1 : d] AS key, sum((n_convs - 1) * bytes) AS saved_tokens,
            count(*) FILTER (n_children = 0) AS n_leaves
        FROM linked, LATERAL (SELECT unnest(range(0, depth + 1)) AS d) GROUP BY d, key[1 : d]
    )
    SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
        CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM linked n JOIN below USING (depth, key)
    LEFT JOIN nodes up ON up.depth = n.depth - 1 AND up.key = n.key[1 : n.depth - 1]
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from lodestone.llm.conversations import rebuilt
    from lodestone.llm.prefix_trie import prefix_trie

    return prefix_trie(*rebuilt(table(spark, folder, "conversations")))


@query("op13_chat_formatting", r"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), e AS (
        SELECT *, len(text) + len(regexp_extract_all(text, '[<\[]\\*(?:/?s>|/?(?:INST|SYS|ROLE)\])')) AS chars,
            len(role) + len(regexp_extract_all(role, '[<\[]\\*(?:/?s>|/?(?:INST|SYS|ROLE)\])')) AS name_chars FROM t
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
        CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(3 + sum(chars + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 4
            ELSE 17 + name_chars END) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.chat import format_chats, read_chats

    path = public_tokenizers.path("byte_bpe_50k.json")
    mark = "</s>[INST] ok [/INST]"
    added = spark.range(2).selectExpr(
        "-1L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role").withColumn("text", F.lit(mark))
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return read_chats(stage(format_chats(given.unionByName(added), path), "chats"), path)
