"""Sources, sinks, constraints and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import constraints as K
from lodestone.operators import graph, suites, vectors
from lodestone.plans.tables import table
from lodestone.sources import artefacts, corpus, sinks
from lodestone.staging import new_path, spread, stage

_MARKDOWN_STEPS = [
    ("(?s)<script[^>]*>.*?</script>", ""),
    ("(?s)<style[^>]*>.*?</style>", ""),
    ("<h[1-6][^>]*>", "\n# "),
    ("<footer[^>]*>", "\n# footer\n"),
    ("<p><b>", "\n## "),
    ("</?(?:h[1-6]|p|br|div|li|ul|nav|article|title)[^>]*>", "\n"),
    ("<[^>]*>", ""),
]


def page_markdown(spark, folder):
    """Pages as markdown: heading tags become heading lines, other tags vanish."""
    text = F.col("html")
    for pattern, replacement in _MARKDOWN_STEPS:
        text = F.regexp_replace(text, pattern, replacement)
    return spread(table(spark, folder, "pages")).select("page_id", "url", text.alias("body"))


def page_chunk_rows(spark, folder):
    return corpus.chunk_documents(page_markdown(spark, folder), "page_id")


def page_chunks(spark, folder):
    return page_chunk_rows(spark, folder).select(
        "chunk_id", "document_id", "ordinal", "heading",
        F.md5(F.col("body").cast("binary")).alias("body_digest"), "token_count",
    )


def _kind():
    return F.element_at(
        F.array(*[F.lit(k) for k in ("runbook", "postmortem", "policy", "architecture", "memo")]),
        (F.col("doc_id") % 5 + 1).cast("int"),
    )


def front_matter(spark, folder):
    """Documents written out as corpus files, every ninth one malformed, and parsed."""
    files = table(spark, folder, "documents").select(
        F.format_string("d-%06d.md", "doc_id").alias("source"),
        F.concat(
            F.when(F.col("doc_id") % 9 == 0, F.lit("")).otherwise(F.lit("---\n")),
            F.format_string("id: doc-%06d\n", F.col("doc_id") - F.when(F.col("doc_id") % 50 == 7, 1).otherwise(0)),
            F.when(F.col("doc_id") % 31 == 0, F.lit("Not a field\n")).otherwise(F.lit("")),
            F.lit("kind: "), _kind(), F.lit('\ntitle: "'), F.col("lang"), F.lit(" from "),
            F.col("source"), F.lit('"\n---\n'), F.col("text"),
        ).alias("text"),
    )
    parsed = stage(corpus.parse_front_matter(files), "parsed")
    bad = corpus.rejects(parsed).withColumnRenamed("problem", "reject")
    return parsed.join(bad, "source", "left").select(
        "source", F.when(F.col("reject").isNull(), F.col("id")).alias("id"),
        F.when(F.col("reject").isNull(), F.col("kind")).alias("kind"),
        F.when(F.col("reject").isNull(), F.col("title")).alias("title"),
        F.when(F.col("reject").isNull(), F.length("body")).alias("n_chars"), "reject",
    )


def markdown_tables(spark, folder):
    """Parts written as a markdown table, read back and rolled up by status."""
    lines = table(spark, folder, "part").select(
        F.concat_ws(
            " | ", F.concat(F.lit("| PT-"), F.col("p_partkey")), F.col("p_brand"),
            F.concat(F.lit("**"), F.col("p_size"), F.lit("**")),
            F.when(F.col("p_size") > 25, "Done").otherwise("planned"), F.lit(""),
        ).alias("value")
    )
    header = lines.sparkSession.sql("SELECT '| Id | Brand | Size | Status |' AS value")
    rows = artefacts.markdown_rows(lines.unionByName(header), r"[A-Z]{2}-\d+")
    status = F.lower(F.get("cells", F.lit(3)))
    return rows.groupBy(F.get("cells", F.lit(1)).alias("brand")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status.startswith("done")).alias("done"),
        F.count_if(status.startswith("planned")).alias("planned"),
        F.sum(artefacts.plain_cell(F.get("cells", F.lit(2))).cast("long")).alias("size"),
    )


def number_constants(spark, folder):
    """Source-like lines made from the parts, and the constants found in them."""
    lines = table(spark, folder, "part").select(
        F.concat(
            F.when(F.col("p_partkey") % 7 == 0, "# ").otherwise(""),
            F.lit("LIMIT_"), F.col("p_partkey"),
            F.when(F.col("p_partkey") % 11 == 0, " -> ").otherwise(" = "),
            F.col("p_size"), F.lit("  # size"),
        ).alias("value")
    )
    return artefacts.number_constants(lines)


def event_frames(spark, folder):
    """Events as frames, some malformed, each buffer with a partial tail; decoded."""
    kind, key = F.col("event_type"), F.col("event_id")
    body = F.to_json(F.struct(key.alias("event_id"), F.col("user_id")))
    good = artefacts.encode_event(kind, body)
    broken = artefacts.encode_event(kind, F.concat(F.lit("{"), key.cast("string")))
    nameless = F.concat(F.lit("data: "), body, F.lit("\n\n"))
    buffers = table(spark, folder, "events").select(
        F.concat(
            good, F.when(key % 3 == 0, broken).otherwise(""),
            F.when(key % 4 == 0, nameless).otherwise(""), good, F.lit("event: par"),
        ).alias("buffer")
    )
    decoded = artefacts.decode_events(buffers, "buffer", "event_id long, user_id long")
    return decoded.select("data.event_id", "data.user_id", "kind", "position", "tail")


def upsert_orders(spark, folder):
    """Open orders are loaded again with a new status, and new ones arrive."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )
    again = orders.filter("o_orderstatus = 'O'").withColumn("o_orderstatus", F.lit("X"))
    fresh = orders.filter("o_orderstatus = 'P'").withColumn(
        "o_orderkey", F.col("o_orderkey") + 1_000_000_000
    )
    return sinks.upsert(orders, again.unionByName(fresh), ["o_orderkey"],
                        ["o_orderstatus", "o_totalprice"])


def insert_if_absent(spark, folder):
    orders = table(spark, folder, "orders")
    stored = orders.groupBy("o_custkey").agg(F.lit("stored").alias("origin"))
    offered = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.lit("offered").alias("origin")
    )
    return sinks.insert_if_absent(stored, offered, ["o_custkey"])


def session_touch(spark, folder):
    """Sessions known from clicks are touched by every user's latest event."""
    events = table(spark, folder, "events").select(F.col("user_id").alias("id"), "ts", "event_type")
    known = events.filter("event_type = 'signup'").groupBy("id").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("last_seen_at")
    )
    seen = events.groupBy("id").agg(F.max("ts").alias("created_at"), F.max("ts").alias("last_seen_at"))
    return sinks.touch_sessions(known, seen).select(
        "id", F.unix_micros("created_at").alias("created_us"),
        F.unix_micros("last_seen_at").alias("last_seen_us"),
    )


def orphan_delete(spark, folder):
    """Lines of finished orders that a reload no longer produces are dropped."""
    line_id = (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("line_id")
    stored = table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", line_id)
    loaded = stored.filter("l_returnflag <> 'R' AND l_quantity < 40")
    kept = sinks.delete_orphans(stored, loaded, "l_orderkey", "line_id")
    return kept.select("line_id", "l_returnflag", "l_quantity")


def orphan_lines(spark, folder):
    """Anti join: lines without an order, and orders without a line."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("key"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"))
    return lines.join(orders, "key", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("lines without order").alias("rule"), "n"
    ).unionByName(
        orders.join(lines, "key", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("orders without lines").alias("rule"), "n"
        )
    )


def load_report(spark, folder):
    names = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events"]
    return sinks.seed_report({n: table(spark, folder, n) for n in names})


def constraint_violations(spark, folder):
    t = {n: table(spark, folder, n) for n in
         ("lineitem", "orders", "customer", "part", "supplier", "events", "labels", "documents")}
    parts = [
        K.violations(t["lineitem"], [
            K.Check("line quantity is positive", F.col("l_quantity") > 0),
            K.Check("line discount below 0.05", F.col("l_discount") < 0.05),
            K.Check("line flag is known", F.col("l_returnflag").isin("A", "N")),
            K.Unique("line key is unique", ("l_orderkey", "l_linenumber")),
            K.Reference("line order exists", ("l_orderkey",), t["orders"], ("o_orderkey",)),
            K.Reference("line supplier is a customer", ("l_suppkey",),
                        t["customer"].filter("c_acctbal > 0"), ("c_custkey",)),
        ]),
        K.violations(t["orders"], [
            K.Check("order price at most 300000", F.col("o_totalprice") <= 300000),
            K.Unique("one order per customer and day", ("o_custkey", "o_orderdate")),
            K.Reference("order customer exists", ("o_custkey",), t["customer"], ("c_custkey",)),
        ]),
        K.violations(t["documents"], [
            K.Check("document language is known", F.col("lang").isin("en", "fr", "de")),
            K.Check("document length is right", F.length("text") == F.col("n_chars")),
            K.Unique("document text is unique", ("text",)),
        ]),
        K.violations(t["labels"], [
            K.Check("label is 0 or 1", F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1)),
            K.Reference("labelled document exists", ("doc_id",), t["documents"], ("doc_id",)),
        ]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def migration_drift(spark, folder):
    """Supplier rows as migration files; some renamed, edited or not applied."""
    s = table(spark, folder, "supplier").select(
        F.col("s_suppkey"),
        F.when(F.col("s_suppkey") % 25 == 0, F.format_string("%04d-Bad.sql", "s_suppkey"))
        .otherwise(F.format_string("%04d_add_s.sql", "s_suppkey")).alias("file"),
        F.concat(F.lit("ALTER TABLE t;   \nADD "), F.col("s_name"), F.lit("  \n")).alias("sql"),
    )
    applied = s.filter("s_suppkey % 3 = 0").select(
        F.col("s_suppkey").alias("version"),
        K.migration_checksum(
            F.when(F.col("s_suppkey") % 12 == 0, F.concat("sql", F.lit("x"))).otherwise(
                F.replace("sql", F.lit("   \n"), F.lit("\n"))
            )
        ).alias("checksum"),
    )
    files = s.select("file", "sql")
    problems = K.migration_problems(files, applied)
    pending = K.pending_migrations(files.filter(F.col("file").rlike("_add_")), applied)
    return problems.unionByName(
        pending.select("file", F.concat(F.lit("pending "), F.left("checksum", F.lit(12))).alias("problem"))
    )


def entity_edges(spark, folder):
    """Orders depend on customers, customers and suppliers on nations, nations on regions."""
    def edge(name, up, up_key, down, down_key):
        return table(spark, folder, name).select(
            F.concat(F.lit(up), F.col(up_key)).alias("upstream_id"),
            F.concat(F.lit(down), F.col(down_key)).alias("downstream_id"),
        )

    return (
        edge("nation", "nation:", "n_nationkey", "region:", "n_regionkey")
        .unionByName(edge("customer", "customer:", "c_custkey", "nation:", "c_nationkey"))
        .unionByName(edge("supplier", "supplier:", "s_suppkey", "nation:", "s_nationkey"))
        .unionByName(edge("orders", "order:", "o_orderkey", "customer:", "o_custkey"))
    )


def closure_hops(spark, folder):
    roots = table(spark, folder, "region").select(
        F.concat(F.lit("region:"), F.col("r_regionkey")).alias("root")
    )
    return graph.affected(entity_edges(spark, folder), roots)


def direct_neighbours(spark, folder):
    return graph.neighbours(entity_edges(spark, folder)).select(
        "node", F.col("n_downstream").cast("long").alias("n_downstream"),
        F.col("n_upstream").cast("long").alias("n_upstream"),
    )


def _supply_edges(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("upstream_id"), F.col("l_partkey").alias("downstream_id")
    )


def graph_problems(spark, folder):
    nodes = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("name")
    )
    return graph.graph_problems(nodes, _supply_edges(spark, folder))


def cyclic_core(spark, folder):
    return graph.cyclic_core(_supply_edges(spark, folder))


def cycle_paths(spark, folder):
    """The cycles of the same graph, each with its nodes in order."""
    return graph.cycles(graph.cyclic_core(_supply_edges(spark, folder)))


def _stored_vectors(spark, folder):
    """The given vectors under one model, and half of each second one under another, loaded in
    bulk into a folder per model."""
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("vec"))
    path = new_path(spark, "stored-vectors")
    sinks.write_vectors(rows.withColumn("model", F.lit("table-v1")), path)
    sinks.write_vectors(rows.filter("id % 2 = 0").select(
        "id", F.slice("vec", 1, 32).alias("vec"), F.lit("half-v1").alias("model")), path)
    return spark.read.schema("id long, vec array<float>, model string").parquet(path)


def vectors_by_model(spark, folder):
    return vectors.count_by_model(_stored_vectors(spark, folder))


def vector_dimensions(spark, folder):
    return vectors.dimensions(_stored_vectors(spark, folder))


def chunks_without_vectors(spark, folder):
    """Documents without a vector of the second model, though the first may have one."""
    chunks = table(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    return vectors.without_vector(chunks, _stored_vectors(spark, folder), "half-v1")


def written_report(spark, folder):
    """Each source as a suite of two checks, written as a report and read back."""
    judged = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    shares = judged.groupBy("source").agg(
        F.avg(F.col("quality").cast("double")).alias("good"), F.avg(F.col("toxic").cast("double")).alias("toxic"))
    checks = shares.select("source", F.explode(F.array(
        F.struct(F.lit("mostly_good").alias("name"), (F.col("good") >= 0.8).alias("passed"), F.col("good").alias("value")),
        F.struct(F.lit("hardly_toxic").alias("name"), (F.col("toxic") <= 0.1).alias("passed"), F.col("toxic").alias("value")),
    )).alias("c")).select(F.col("source").alias("suite"), "c.*")
    path = new_path(spark, "report")
    sinks.write_report(suites.report(checks), path)
    return sinks.read_report(spark, path).select("suite", "passed", F.explode("checks").alias("c")).select(
        "suite", "passed", F.col("c.name").alias("name"), F.col("c.passed").alias("holds"),
        F.round("c.value", 6).alias("value"))


QUERIES = {
    f.__name__: f for f in (
        page_chunks, front_matter, markdown_tables, number_constants, event_frames, upsert_orders,
        insert_if_absent, session_touch, orphan_delete, orphan_lines, load_report,
        constraint_violations, migration_drift, closure_hops, direct_neighbours, graph_problems,
        cyclic_core, cycle_paths, vectors_by_model, vector_dimensions, chunks_without_vectors,
        written_report,
    )
}


def _markdown_sql() -> str:
    text = "html"
    for pattern, replacement in _MARKDOWN_STEPS:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return text


_TRIM = "E' \\t\\n\\r\\x0b\\x0c'"
PAGE_CHUNKS_SQL = f"""
    md AS (SELECT page_id, {_markdown_sql()} AS body FROM pages),
    sec AS (
        SELECT page_id, i, parts[i] AS s FROM (
            SELECT page_id, string_split(regexp_replace(body, '\\n#', chr(1) || '#', 'g'), chr(1))
                AS parts FROM md), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
    headed AS (
        SELECT page_id, i,
            CASE WHEN s[1] = '#' THEN trim(ltrim(split_part(s, chr(10), 1), '#'), {_TRIM}) END
                AS heading,
            trim(CASE WHEN s[1] <> '#' THEN s
                WHEN instr(s, chr(10)) = 0 THEN '' ELSE substr(s, instr(s, chr(10))) END, {_TRIM})
                AS txt
        FROM sec),
    blocks AS (
        SELECT page_id, i, heading, CASE WHEN coalesce(heading, '') <> ''
            THEN trim(heading || chr(10) || chr(10) || txt, {_TRIM}) ELSE txt END AS block
        FROM headed WHERE heading IS NOT NULL OR txt <> ''),
    starts AS (
        SELECT *, length(block) >= 200 OR row_number() OVER (PARTITION BY page_id ORDER BY i) = 1
            AS is_start FROM blocks),
    grp AS (
        SELECT *, count(*) FILTER (is_start) OVER (PARTITION BY page_id ORDER BY i) - 1 AS ordinal
        FROM starts),
    page_chunks AS (
        SELECT page_id AS document_id, CAST(ordinal AS INTEGER) AS ordinal,
            printf('%d#%02d', page_id, ordinal) AS chunk_id,
            max(heading) FILTER (is_start) AS heading,
            string_agg(block, chr(10) || chr(10) ORDER BY i) AS body
        FROM grp GROUP BY page_id, ordinal
        HAVING string_agg(block, chr(10) || chr(10) ORDER BY i) <> '')"""

_EDGES = """edges AS (
        SELECT 'nation:' || n_nationkey AS up, 'region:' || n_regionkey AS down FROM nation
        UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
        UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
        UNION SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders)"""

_CHECKSUM = (
    "sha256(array_to_string(list_transform(string_split(trim({0}, E' \\n'), chr(10)), "
    "lambda x: rtrim(x)), chr(10)))"
)

ORACLE = {
    "page_chunks": f"""
        WITH {PAGE_CHUNKS_SQL}
        SELECT chunk_id, document_id, ordinal, heading, md5(body) AS body_digest,
            CAST(greatest(1, floor(len(list_filter(string_split_regex(body, '\\s+'),
                lambda w: w <> '')) * CAST(1.3 AS DOUBLE))) AS INTEGER) AS token_count
        FROM page_chunks""",
    "front_matter": """
        WITH d AS (
            SELECT *, doc_id - CASE WHEN doc_id % 50 = 7 THEN 1 ELSE 0 END AS own,
                (['runbook', 'postmortem', 'policy', 'architecture', 'memo'])[doc_id % 5 + 1] AS kind,
                CASE WHEN doc_id % 9 = 0 THEN 'missing front matter block'
                    WHEN doc_id % 31 = 0 THEN 'front matter line is not key: value'
                    WHEN doc_id % 5 = 4 THEN 'unknown kind'
                    WHEN trim(text, E' \\n\\t') = '' THEN 'front matter but no body' END AS problem
            FROM documents),
        r AS (
            SELECT *, CASE WHEN problem IS NOT NULL THEN problem
                WHEN count(*) FILTER (problem IS NULL) OVER (PARTITION BY own) > 1
                    THEN 'duplicate document id' END AS reject FROM d)
        SELECT printf('d-%06d.md', doc_id) AS source,
            CASE WHEN reject IS NULL THEN printf('doc-%06d', own) END AS id,
            CASE WHEN reject IS NULL THEN kind END AS kind,
            CASE WHEN reject IS NULL THEN lang || ' from ' || source END AS title,
            CASE WHEN reject IS NULL THEN CAST(length(trim(text, E' \\n\\t')) AS INTEGER) END AS n_chars,
            reject FROM r""",
    "markdown_tables": """
        SELECT p_brand AS brand, count(*) AS total, count(*) FILTER (p_size > 25) AS done,
            count(*) FILTER (p_size <= 25) AS planned, CAST(sum(p_size) AS BIGINT) AS size
        FROM part GROUP BY p_brand""",
    "number_constants": """
        SELECT 'LIMIT_' || p_partkey AS name, CAST(p_size AS DOUBLE) AS number FROM part
        WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0""",
    "event_frames": """
        SELECT event_id, user_id, event_type AS kind, CAST(0 AS INTEGER) AS position,
            'event: par' AS tail FROM events
        UNION ALL SELECT event_id, user_id, event_type, CAST(1 + CAST(event_id % 3 = 0 AS INTEGER)
            + CAST(event_id % 4 = 0 AS INTEGER) AS INTEGER), 'event: par' FROM events""",
    "upsert_orders": """
        SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END
            AS o_orderstatus, o_totalprice, o_orderpriority FROM orders
        UNION ALL SELECT o_orderkey + 1000000000, o_orderstatus, o_totalprice, o_orderpriority
        FROM orders WHERE o_orderstatus = 'P'""",
    "insert_if_absent": """
        SELECT DISTINCT o_custkey, 'stored' AS origin FROM orders
        UNION ALL SELECT c_custkey, 'offered' FROM customer
        WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
    "session_touch": """
        SELECT user_id AS id, epoch_us(coalesce(min(ts) FILTER (event_type = 'signup'), max(ts)))
            AS created_us, epoch_us(max(ts)) AS last_seen_us FROM events GROUP BY user_id""",
    "orphan_delete": """
        WITH s AS (SELECT *, l_orderkey * 100 + l_linenumber AS line_id,
            l_returnflag <> 'R' AND l_quantity < 40 AS loaded FROM lineitem),
        m AS (SELECT *, bool_or(loaded) OVER (PARTITION BY l_orderkey) AS in_scope,
            bool_or(loaded) OVER (PARTITION BY line_id) AS kept FROM s)
        SELECT line_id, l_returnflag, l_quantity FROM m WHERE kept OR NOT in_scope""",
    "orphan_lines": """
        SELECT 'lines without order' AS rule, count(*) AS n FROM lineitem
        WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
        UNION ALL SELECT 'orders without lines', count(*) FROM orders
        WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    "load_report": " UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in
        ["documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events"]
    ),
    "constraint_violations": """
        WITH v AS (
            SELECT 'line quantity is positive' AS rule, count(*) AS n FROM lineitem WHERE NOT l_quantity > 0
            UNION ALL SELECT 'line discount below 0.05', count(*) FROM lineitem
                WHERE NOT l_discount < CAST(0.05 AS DOUBLE)
            UNION ALL SELECT 'line flag is known', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
            UNION ALL SELECT 'line key is unique', count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
            UNION ALL SELECT 'line order exists', count(*) FROM lineitem
                WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
            UNION ALL SELECT 'line supplier is a customer', count(*) FROM lineitem
                WHERE l_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
            UNION ALL SELECT 'order price at most 300000', count(*) FROM orders WHERE NOT o_totalprice <= 300000
            UNION ALL SELECT 'one order per customer and day', count(*) - count(DISTINCT (o_custkey, o_orderdate)) FROM orders
            UNION ALL SELECT 'order customer exists', count(*) FROM orders
                WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
            UNION ALL SELECT 'document language is known', count(*) FROM documents WHERE lang NOT IN ('en', 'fr', 'de')
            UNION ALL SELECT 'document length is right', count(*) FROM documents WHERE length(text) <> n_chars
            UNION ALL SELECT 'document text is unique', count(*) - count(DISTINCT text) FROM documents
            UNION ALL SELECT 'label is 0 or 1', count(*) FROM labels
                WHERE NOT (quality IN (0, 1) AND toxic IN (0, 1))
            UNION ALL SELECT 'labelled document exists', count(*) FROM labels
                WHERE doc_id NOT IN (SELECT doc_id FROM documents))
        SELECT rule, n FROM v WHERE n > 0""",
    "migration_drift": f"""
        WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 25 = 0
                THEN printf('%04d-Bad.sql', s_suppkey) ELSE printf('%04d_add_s.sql', s_suppkey) END AS file,
                'ALTER TABLE t;   ' || chr(10) || 'ADD ' || s_name || '  ' || chr(10) AS sql
            FROM supplier),
        good AS (SELECT * FROM s WHERE k % 25 <> 0)
        SELECT file, 'bad file name' AS problem FROM s WHERE k % 25 = 0
        UNION ALL SELECT file, 'gap before this version' FROM good
            WHERE k <> 1 AND k - 1 NOT IN (SELECT k FROM good)
        UNION ALL SELECT printf('%04d', k), 'applied but missing' FROM s WHERE k % 3 = 0 AND k % 25 = 0
        UNION ALL SELECT file, 'edited after it was applied' FROM good WHERE k % 12 = 0
        UNION ALL SELECT file, 'pending ' || left({_CHECKSUM.format('sql')}, 12)
            FROM good WHERE k % 3 <> 0""",
    "closure_hops": f"""
        WITH RECURSIVE {_EDGES},
        walk AS (
            SELECT 'region:' || r_regionkey AS root, 'region:' || r_regionkey AS node, 0 AS hops FROM region
            UNION SELECT root, up, hops + 1 FROM walk JOIN edges ON node = down)
        SELECT root, node, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY root, node""",
    "direct_neighbours": """
        WITH edges AS (
            SELECT 'nation:' || n_nationkey AS up, 'region:' || n_regionkey AS down FROM nation
            UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
            UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
            UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders)
        SELECT node, CAST(sum(d) AS BIGINT) AS n_downstream, CAST(sum(u) AS BIGINT) AS n_upstream
        FROM (SELECT up AS node, 1 AS d, 0 AS u FROM edges UNION ALL SELECT down, 0, 1 FROM edges)
        GROUP BY node""",
    "graph_problems": """
        WITH p AS (
            SELECT 'duplicate name' AS problem, count(*) - count(DISTINCT s_nationkey) AS n FROM supplier
            UNION ALL SELECT 'duplicate id', count(*) - count(DISTINCT s_suppkey) FROM supplier
            UNION ALL SELECT 'unknown upstream', count(*) FROM lineitem
                WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
            UNION ALL SELECT 'unknown downstream', count(*) FROM lineitem
                WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier)
            UNION ALL SELECT 'self edge', count(*) FROM lineitem WHERE l_suppkey = l_partkey
            UNION ALL SELECT 'duplicate edge', count(*) - count(DISTINCT (l_suppkey, l_partkey)) FROM lineitem)
        SELECT problem, n FROM p WHERE n > 0""",
    "cyclic_core": """
        WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS u, l_partkey AS d FROM lineitem),
        reach AS (
            SELECT u, d FROM e UNION SELECT reach.u, e.d FROM reach JOIN e ON reach.d = e.u),
        cyc AS (SELECT u AS c FROM reach WHERE u = d),
        after AS (SELECT d AS v FROM reach JOIN cyc ON u = c UNION SELECT c FROM cyc),
        before AS (SELECT u AS v FROM reach JOIN cyc ON d = c UNION SELECT c FROM cyc)
        SELECT u AS upstream_id, d AS downstream_id FROM e
        WHERE u IN (FROM after) AND u IN (FROM before) AND d IN (FROM after) AND d IN (FROM before)""",
}

_CORE_CTE = """e AS (SELECT DISTINCT l_suppkey AS u, l_partkey AS d FROM lineitem),
        reach AS (
            SELECT u, d FROM e UNION SELECT reach.u, e.d FROM reach JOIN e ON reach.d = e.u),
        cyc AS (SELECT u AS c FROM reach WHERE u = d),
        after AS (SELECT d AS v FROM reach JOIN cyc ON u = c UNION SELECT c FROM cyc),
        before AS (SELECT u AS v FROM reach JOIN cyc ON d = c UNION SELECT c FROM cyc),
        core AS (SELECT u, d FROM e
            WHERE u IN (FROM after) AND u IN (FROM before) AND d IN (FROM after) AND d IN (FROM before))"""
ORACLE |= {
    "cycle_paths": f"""
        WITH RECURSIVE {_CORE_CTE},
        step AS (SELECT u, min(d) AS nxt FROM core GROUP BY u),
        walk AS (
            SELECT u AS root, u AS node, 0 AS i FROM step
            UNION ALL SELECT root, nxt, i + 1 FROM walk JOIN step ON node = u
            WHERE i < (SELECT count(*) FROM step)),
        round AS (SELECT root, min(i) AS size FROM walk WHERE i > 0 AND node = root GROUP BY root),
        least AS (SELECT w.root FROM walk w JOIN round r ON r.root = w.root AND w.i < size
            GROUP BY w.root HAVING min(node) = w.root)
        SELECT w.root AS cycle, CAST(i AS BIGINT) AS position, node
        FROM walk w JOIN round USING (root) JOIN least USING (root) WHERE i < size""",
    "vectors_by_model": """
        SELECT 'table-v1' AS model, count(*) AS n FROM embeddings
        UNION ALL SELECT 'half-v1', count(*) FROM embeddings WHERE vec_id % 2 = 0""",
    "vector_dimensions": """
        SELECT DISTINCT 'table-v1' AS model, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings
        UNION ALL SELECT DISTINCT 'half-v1', CAST(len(embedding[1:32]) AS INTEGER) FROM embeddings WHERE vec_id % 2 = 0""",
    "chunks_without_vectors": """
        SELECT doc_id AS id FROM documents
        WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)""",
    "written_report": """
        WITH s AS (SELECT source, avg(CAST(quality AS DOUBLE)) AS good, avg(CAST(toxic AS DOUBLE)) AS toxic
            FROM labels JOIN documents USING (doc_id) GROUP BY source)
        SELECT source AS suite, good >= 0.8 AND toxic <= 0.1 AS passed, name, holds, round(value, 6) AS value FROM (
            SELECT *, 'mostly_good' AS name, good >= 0.8 AS holds, good AS value FROM s
            UNION ALL SELECT *, 'hardly_toxic', toxic <= 0.1, toxic FROM s)""",
}
