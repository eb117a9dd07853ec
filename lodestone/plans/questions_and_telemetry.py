"""Labelled questions, suites, models and seeded telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions.text import contains_value, tokenize
from lodestone.operators import curves, dataset, evidence, hybrid, models, suites, telemetry
from lodestone.operators.dense import HashingEmbedder
from lodestone.operators.ordered import row_numbers, top_k
from lodestone.plans import sql
from lodestone.plans.storage_and_graph import PAGE_CHUNKS_SQL, page_chunk_rows
from lodestone.plans.tables import table
from lodestone.sources import estate
from lodestone.staging import spread, stage

_HEADINGS = list(C.SECTION_TEMPLATES)


def _titles(spark, folder):
    return table(spark, folder, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("title"))


def _chunks(spark, folder):
    return stage(page_chunk_rows(spark, folder), "page-chunks")


def _estate(spark, folder):
    """Suppliers as services, their runtimes in turn; the fault catalogue as it is."""
    runtimes = sorted({r[4] for r in estate.rows(estate.SERVICES)})
    services = table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("int").alias("position"), F.col("s_name").alias("id"),
        F.concat(F.lit("node-"), F.col("s_suppkey")).alias("name"),
        F.element_at(
            F.array(*[F.lit(r) for r in runtimes]), (F.col("s_suppkey") % len(runtimes) + 1).cast("int")
        ).alias("runtime"),
    )
    return services, estate.patterns(spark), estate.signals(spark)


def symptom_questions(spark, folder):
    return dataset.symptom_questions(*_estate(spark, folder))


def section_questions(spark, folder):
    """Chunks take the standard section headings in turn."""
    heading = F.element_at(
        F.array(*[F.lit(h) for h in _HEADINGS]), (F.col("ordinal") % len(_HEADINGS) + 1)
    )
    chunks = _chunks(spark, folder).withColumn("heading", heading)
    titles = table(spark, folder, "pages").select(
        F.col("page_id").alias("id"),
        F.concat(F.lit("Fault "), F.col("page_id"), F.lit(" on "), F.col("url")).alias("title"),
    )
    return dataset.section_questions(titles, chunks)


def heading_questions(spark, folder):
    return dataset.heading_questions(_titles(spark, folder), _chunks(spark, folder))


def policy_questions(spark, folder):
    lookups = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("position"), "text", F.concat(F.lit("pol-"), F.col("item_id") % 4).alias("document_id")
    )
    return dataset.policy_questions(lookups)


def gap_questions(spark, folder):
    topics = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("position"),
        F.concat(F.lit("what about "), F.array_join(tokenize(F.col("text")), " ")).alias("text"),
        tokenize(F.col("text")).alias("terms"),
    )
    return dataset.gap_questions(topics, _chunks(spark, folder))


def property_transfer_questions(spark, folder):
    """The two tokens that most documents of a source hold are its property, asked of every nation."""
    docs = spread(table(spark, folder, "documents").select("source", "text"))
    held = docs.select("source", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("token"))
    counted = held.groupBy("source", "token").agg(F.count("*").alias("n"))
    first = top_k(counted, ["source"], [F.desc("n"), F.asc("token")], 2)
    two = first.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("t"))
    properties = two.select(
        F.expr("CAST(substring(source, 4) AS INT)").alias("position"),
        F.array_join("t.token", " ").alias("prop"), F.lower("source").alias("documented_for"),
        F.slice("t.token", 1, 1).alias("proof_terms"),
    )
    entities = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("position"), F.lower("n_name").alias("entity")
    )
    return dataset.property_transfer_questions(properties, entities, _chunks(spark, folder))


def presupposition_questions(spark, folder):
    services, patterns, signals = _estate(spark, folder)
    return dataset.presupposition_questions(services, patterns, signals, _chunks(spark, folder))


def labelled_questions(spark, folder):
    """All seven generators, deduplicated and capped."""
    return dataset.assemble([
        g(spark, folder) for g in (
            symptom_questions, section_questions, heading_questions, policy_questions,
            gap_questions, property_transfer_questions, presupposition_questions,
        )
    ])


def dedup_first(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "lang", "text"))
    return dataset.first_per_token_tuple(docs, "doc_id").select("doc_id", "lang")


def round_robin_cap(spark, folder):
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("mechanism"), F.col("source").alias("group")
    )
    return dataset.cap_mechanisms(docs)


def group_split(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return dataset.split_by_group(orders, "o_custkey")


def grouped_folds(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return dataset.grouped_folds(docs, "source")


# --- suites ----------------------------------------------------------------
def _assessed(spark, folder):
    """Every labelled question searched over all page chunks, and judged."""
    asked = stage(
        row_numbers(labelled_questions(spark, folder), [F.col("id")], "query_id"), "asked"
    )
    docs = stage(
        _chunks(spark, folder).select(
            (F.col("document_id") * 1000 + F.col("ordinal")).alias("doc_id"), F.col("body").alias("text")
        ), "chunk-texts",
    )
    faults = estate.signals(spark).filter("role = 'primary'").groupBy("pattern_id").agg(
        F.min_by("metric", "position").alias("metric")
    ).join(estate.patterns(spark).withColumnRenamed("id", "pattern_id"), "pattern_id").select(
        (-F.col("position").cast("long") - 1).alias("query_id"),
        F.concat_ws(" ", "metric", "signature").alias("text"))
    queries = asked.select("query_id", "text").union(faults)
    index = hybrid.build_index(docs, HashingEmbedder())
    hits = stage(hybrid.search(index, queries, HashingEmbedder()), "hits")
    judged = evidence.assess(queries, hits, docs).join(
        asked.select("query_id", "label", "gold_chunk_id", "gold_document_id"), "query_id"
    )
    return stage(judged, "assessed"), hits


def _reached(spark, hits):
    """Each fault pattern, and whether one of the first five hits of its search is on its page.

    The pages take the place of runbooks, one for each pattern by its place in the catalogue.
    """
    patterns = estate.patterns(spark).select((-F.col("position").cast("long") - 1).alias("query_id"))
    found = hits.filter("query_id < 0 AND rank <= 5").filter(
        F.floor(F.col("doc_id") / 1000) == -F.col("query_id") - 1)
    return patterns.join(
        found.select("query_id").distinct().withColumn("found", F.lit(True)), "query_id", "left"
    ).select("query_id", F.coalesce("found", F.lit(False)).alias("found"))


def core_suite(spark, folder):
    assessed, hits = _assessed(spark, folder)
    return suites.core(assessed, _reached(spark, hits)).withColumn("value", F.round("value", 5))


def probe_suite(spark, folder):
    assessed, hits = _assessed(spark, folder)
    first = hits.filter("rank = 1").select(
        "query_id", F.format_string("%d#%02d", F.floor(F.col("doc_id") / 1000), F.col("doc_id") % 1000)
        .alias("first_chunk"),
    )
    gold = assessed.filter("gold_chunk_id IS NOT NULL").join(first, "query_id", "left").select(
        "query_id", F.coalesce(F.col("first_chunk") == F.col("gold_chunk_id"), F.lit(False)).alias("is_first")
    )
    hard = assessed.filter("label = 'unanswerable'").select("combined_score")
    return suites.probe(assessed, gold, hard).withColumn(
        "value", F.round("value", 5)
    )


def suite_report(spark, folder):
    checks = core_suite(spark, folder)
    return suites.report(checks).select("suite", "passed", "warned", F.size("checks").alias("n_checks"))


# --- models ----------------------------------------------------------------
_COLUMNS = ["n_chars", "n_tokens", "n_terms", "has_value", "one"]


def _document_features(spark, folder):
    docs = spread(table(spark, folder, "documents")).withColumn("tokens", tokenize(F.col("text")))
    return table(spark, folder, "labels").join(docs, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), F.col("source").alias("group"),
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size("tokens").cast("double").alias("n_tokens"),
        F.size(F.array_distinct("tokens")).cast("double").alias("n_terms"),
        contains_value(F.col("text")).cast("int").cast("double").alias("has_value"),
        F.lit(1.0).alias("one"),
    )


def feature_hygiene(spark, folder):
    return models.column_hygiene(_document_features(spark, folder), _COLUMNS)


def logistic_cross_validation(spark, folder):
    rows = stage(_document_features(spark, folder), "features")
    scored = models.out_of_fold(rows, _COLUMNS, models.logistic)
    return curves.auc_both_ways(scored)


def boosted_cross_validation(spark, folder):
    rows = stage(_document_features(spark, folder), "features")
    scored = models.out_of_fold(rows, _COLUMNS, models.boosted, in_bins=True)
    return curves.auc_both_ways(scored)


# --- telemetry -------------------------------------------------------------
def _incidents(spark, folder, pick=None):
    seeds = table(spark, folder, "events").filter("event_type = 'error'").select(
        F.col("event_id").alias("seed"), F.col("ts").alias("opened_at")
    )
    services, patterns = estate.services(spark), estate.patterns(spark)
    pairs = telemetry.candidates(services, patterns)
    return telemetry.incidents(seeds, pairs, services, patterns, pick)


def _points(spark, folder, rows):
    return telemetry.development(
        rows, estate.signals(spark), estate.services(spark), estate.dependencies(spark)
    )


def _in_turn():
    n = sum(
        1 for s in estate.rows(estate.SERVICES) for p in estate.rows(estate.PATTERNS)
        if s[4] in p[3].split()
    )
    return (F.col("seed") % n).cast("int")


def incidents_in_turn(spark, folder):
    rows = _incidents(spark, folder, _in_turn())
    return rows.select("incident_id", "service_id", "pattern_id", "title", "signature", "severity", "seed")


def incidents_by_seed(spark, folder):
    return _incidents(spark, folder).select(
        "incident_id", "service_id", "pattern_id", "title", "signature", "severity", "seed"
    )


def telemetry_development(spark, folder):
    points = _points(spark, folder, _incidents(spark, folder, _in_turn()))
    return points.groupBy("pattern_id", "service_id", "metric", "hops", "step").agg(
        F.count(F.lit(1)).alias("points"), F.round(F.max("development"), 6).alias("development")
    )


def telemetry_onset(spark, folder):
    points = _points(spark, folder, _incidents(spark, folder, _in_turn()))
    return telemetry.onset(points)


def telemetry_contrast(spark, folder):
    """Sampled telemetry of every incident, before against after its opening."""
    sampled = telemetry.telemetry(_points(spark, folder, _incidents(spark, folder)))
    return telemetry.contrast(
        sampled, ["pattern_id", "name", "is_primary"], F.col("observed_at"), F.col("opened_at"),
        F.col("value"),
    )


def baseline_vs_fault(spark, folder):
    """Values of each event type before and after each user's first error."""
    events = table(spark, folder, "events")
    opened = events.filter("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("opened_at"))
    rows = events.join(opened, "user_id")
    found = telemetry.contrast(
        rows, ["event_type"], F.col("ts"), F.col("opened_at"), F.col("value")
    )
    return found.select(
        "event_type", F.round("baseline_mean", 6).alias("baseline_mean"),
        F.round("fault_mean", 6).alias("fault_mean"), "fault_max", "fault_min",
    )


QUERIES = {
    f.__name__: f for f in (
        symptom_questions, section_questions, heading_questions, policy_questions, gap_questions,
        property_transfer_questions, presupposition_questions, labelled_questions, dedup_first,
        round_robin_cap, group_split, grouped_folds, core_suite, probe_suite, suite_report,
        feature_hygiene, logistic_cross_validation, boosted_cross_validation, incidents_in_turn,
        incidents_by_seed, telemetry_development, telemetry_onset, telemetry_contrast,
        baseline_vs_fault,
    )
}


# --- checking SQL ----------------------------------------------------------
def _values(text: str, kinds: str) -> str:
    """Catalogue lines as a VALUES list; kinds: s string, n number, l list of words."""
    out = []
    for i, cells in enumerate(estate.rows(text)):
        shown = [str(i)]
        for cell, kind in zip(cells, kinds, strict=True):
            if kind == "n":
                shown.append(cell)
            elif kind == "l":
                shown.append("[" + ", ".join(f"'{w}'" for w in cell.split()) + "]")
            else:
                shown.append(f"'{cell}'")
        out.append("(" + ", ".join(shown) + ")")
    return "(VALUES " + ", ".join(out) + ")"


_CATALOGUE = f"""
    svc AS (SELECT * FROM {_values(estate.SERVICES, 'ssnss')} t(pos, id, name, tier, team, runtime)),
    dep AS (SELECT * FROM {_values(estate.DEPENDENCIES, 'sss')} t(pos, up, down, kind)),
    pat AS (SELECT * FROM {_values(estate.PATTERNS, 'sssln' + 's')} t(pos, id, name, signature, runtimes, severity, runbook)),
    sig AS (SELECT * FROM {_values(estate.SIGNALS, 'sssssnn')} t(pos, pattern_id, role, metric, unit, direction, baseline, peak))"""

_RUNTIMES = sorted({r[4] for r in estate.rows(estate.SERVICES)})


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_NODES = f"""node AS (
        SELECT s_suppkey AS pos, 'node-' || s_suppkey AS name,
            ({_list(_RUNTIMES)})[s_suppkey % {len(_RUNTIMES)} + 1] AS runtime FROM supplier)"""
_Q = "AS id, {text} AS text, '{label}' AS label, '{mechanism}' AS mechanism, {gold} AS gold_document_id, {group} AS \"group\", {chunk} AS gold_chunk_id"


def _question(text, label, mechanism, gold="NULL", group="NULL", chunk="NULL"):
    return _Q.format(
        text=text, label=label, mechanism=mechanism, gold=f"CAST({gold} AS VARCHAR)",
        group=f"CAST({group} AS VARCHAR)", chunk=f"CAST({chunk} AS VARCHAR)",
    )


_SYMPTOM = f"""able AS (
        SELECT p.id AS pattern_id, p.runbook, n.name, row_number() OVER (
                PARTITION BY p.id ORDER BY n.pos) - 1 AS slot, count(*) OVER (PARTITION BY p.id) AS n
        FROM pat p JOIN node n ON list_contains(p.runtimes, n.runtime)),
    sym AS (
        SELECT s.pattern_id, s.metric, s.direction, t.i, ({_list(C.SYMPTOM_TEMPLATES)})[t.i + 1] AS tpl
        FROM sig s, range({len(C.SYMPTOM_TEMPLATES)}) t(i) WHERE s.role = 'primary'),
    q_symptom AS (
        SELECT 'q-sym-' || sym.pattern_id || '-' || metric || '-' || i {_question(
            "replace(replace(replace(replace(tpl, '{metric}', metric), '{service}', able.name), "
            "'{participle}', CASE WHEN direction = 'rise' THEN 'climbing' ELSE 'falling' END), "
            "'{verb}', CASE WHEN direction = 'rise' THEN 'climb' ELSE 'fall' END)",
            'answerable', 'symptom_from_fault_signal', 'runbook', 'runbook')}
        FROM sym JOIN able ON able.pattern_id = sym.pattern_id AND able.slot = sym.i % able.n)"""

_SECTION_VALUES = ", ".join(
    f"({h}, {i}, '{t}')" for h, (_, ts) in enumerate(C.SECTION_TEMPLATES.items()) for i, t in enumerate(ts)
)
_SECTION = f"""q_section AS (
        SELECT 'q-sec-' || chunk_id || '-' || i {_question(
            "replace(replace(tpl, '{name}', 'fault ' || document_id), '{title}', "
            "lower('Fault ' || document_id || ' on ' || url))",
            'answerable', 'section_from_runbook_heading', 'document_id', 'document_id', 'chunk_id')}
        FROM page_chunks JOIN pages ON page_id = document_id
        JOIN (VALUES {_SECTION_VALUES}) t(h, i, tpl) ON h = ordinal % {len(_HEADINGS)})"""

_HEADING = f"""hh AS (
        SELECT chunk_id, document_id, lower(trim(heading)) AS h, lower(url) AS t
        FROM page_chunks JOIN pages ON page_id = document_id WHERE trim(heading) <> ''),
    hq AS (
        SELECT *, CASE WHEN regexp_matches(h, '^(why|what|when|how|who|where|which)')
            THEN [h, h || ', for ' || t]
            ELSE ['what ' || CASE WHEN h LIKE '%s' AND h NOT LIKE '%ss' THEN 'are' ELSE 'is' END
                || ' the ' || h, 'explain the ' || h || ' for ' || t] END AS texts FROM hh),
    q_heading AS (
        SELECT 'q-head-' || chunk_id || '-' || i {_question(
            "texts[i + 1]", 'answerable', 'question_from_any_section_heading', 'document_id',
            'document_id', 'chunk_id')} FROM hq, range(2) r(i))"""

_POLICY = f"""q_policy AS (
        SELECT printf('q-pol-%03d', item_id) {_question(
            'text', 'answerable', 'policy_value_lookup', "'pol-' || item_id % 4",
            "'pol-' || item_id % 4")} FROM benchmark)"""
_GAP = f"""gt AS (SELECT item_id, {sql.tokens_of('text')} AS terms FROM benchmark),
    q_gap AS (
        SELECT printf('q-gap-%03d', item_id) {_question(
            "'what about ' || array_to_string(terms, ' ')", 'unanswerable',
            'topic_absent_from_corpus', 'NULL', "'__gaps__'")}
        FROM gt WHERE NOT EXISTS (
            SELECT 1 FROM page_chunks c WHERE
                len(list_filter(gt.terms, lambda t: NOT contains(lower(c.body), t))) = 0))"""
_PROPERTY = f"""held AS (
        SELECT source, unnest(list_distinct({sql.tokens_of('text')})) AS token FROM documents),
    most AS (SELECT source, token, row_number() OVER (PARTITION BY source ORDER BY n DESC, token) AS k FROM (
        SELECT source, token, count(*) AS n FROM held GROUP BY ALL) QUALIFY k <= 2),
    pr AS (SELECT CAST(substr(source, 4) AS INTEGER) AS p, source, list(token ORDER BY k) AS two
           FROM most GROUP BY source),
    prok AS (SELECT * FROM pr WHERE EXISTS (
        SELECT 1 FROM page_chunks c WHERE len(two) = 0 OR contains(lower(c.body), two[1]))),
    pe AS (
        SELECT p, n_nationkey AS e, array_to_string(two, ' ') AS prop, lower(n_name) AS entity
        FROM prok, nation WHERE NOT contains(lower(source), lower(n_name))),
    pk AS (SELECT * FROM pe WHERE NOT EXISTS (
        SELECT 1 FROM page_chunks c WHERE contains(lower(c.body), entity)
            AND contains(lower(c.body), split_part(prop, ' ', 1)))),
    q_prop AS (
        SELECT printf('q-prop-%03d', row_number() OVER (ORDER BY p, e, i) - 1) {_question(
            f"replace(replace(({_list(C.PROPERTY_TEMPLATES)})[i + 1], '{{prop}}', prop), '{{entity}}', entity)",
            'unanswerable', 'property_documented_for_another_entity', 'NULL', "'__prop__' || entity")}
        FROM pk, range(3) r(i))"""
_PRESUPPOSE = f"""first_metric AS (
        SELECT pattern_id, arg_min(metric, pos) AS metric FROM sig WHERE role = 'primary' GROUP BY 1),
    wrong AS (
        SELECT p.pos AS p, p.id AS pattern_id, n.name, metric,
            row_number() OVER (PARTITION BY p.id ORDER BY n.pos) AS k
        FROM pat p JOIN node n ON NOT list_contains(p.runtimes, n.runtime)
        JOIN first_metric f ON f.pattern_id = p.id QUALIFY k <= 6),
    wk AS (SELECT * FROM wrong WHERE NOT EXISTS (
        SELECT 1 FROM page_chunks c WHERE contains(lower(c.body), lower(name))
            AND contains(lower(c.body), lower(metric)))),
    q_pre AS (
        SELECT printf('q-pre-%03d', row_number() OVER (ORDER BY p, k, i) - 1) {_question(
            f"replace(replace(({_list(C.PRESUPPOSITION_TEMPLATES)})[i + 1], '{{metric}}', metric), '{{service}}', name)",
            'unanswerable', 'entity_cannot_exhibit_this_fault', 'NULL', "'__pre__' || pattern_id")}
        FROM wk, range(2) r(i))"""

_ALL_QUESTIONS = ["q_symptom", "q_section", "q_heading", "q_policy", "q_gap", "q_prop", "q_pre"]


def _cap(source: str, target: str) -> str:
    return f"""
    sizes AS (SELECT list(mechanism ORDER BY mechanism) AS ms, list(n ORDER BY mechanism) AS start
        FROM (SELECT mechanism, count(*) AS n FROM {source} GROUP BY 1)),
    rounds AS (
        SELECT 0 AS i, start AS kept FROM sizes
        UNION ALL SELECT i + 1, list_transform(kept, lambda n: least(n,
            greatest(1, CAST(floor(list_sum(kept) * CAST(0.3 AS DOUBLE)) AS BIGINT))))
        FROM rounds WHERE i < 20),
    caps AS (
        SELECT unnest(ms) AS mechanism, unnest(kept) AS cap FROM sizes, rounds WHERE i = 20),
    turns AS (SELECT *, row_number() OVER (PARTITION BY mechanism, "group" ORDER BY id) AS turn FROM {source}),
    places AS (SELECT *, row_number() OVER (PARTITION BY mechanism ORDER BY turn, "group") AS place FROM turns),
    {target} AS (SELECT p.* EXCLUDE (turn, place) FROM places p JOIN caps USING (mechanism) WHERE place <= cap)"""


_LABELLED = f"""{PAGE_CHUNKS_SQL}, {_CATALOGUE}, {_NODES}, {_SYMPTOM}, {_SECTION}, {_HEADING},
    {_POLICY}, {_GAP}, {_PROPERTY}, {_PRESUPPOSE},
    q_all AS ({" UNION ALL ".join(f"SELECT * FROM {q}" for q in _ALL_QUESTIONS)}),
    q_one AS (
        SELECT * FROM q_all
        QUALIFY row_number() OVER (
            PARTITION BY array_to_string({sql.tokens_of('text')}, ' ') ORDER BY id) = 1),
    {_cap('q_one', 'labelled')}"""

_CHUNK_DOCS = "SELECT document_id * 1000 + ordinal AS doc_id, body AS text FROM page_chunks"
_ASKED = """SELECT query_id, text FROM numbered UNION ALL
    SELECT -CAST(pat.pos AS BIGINT) - 1, f.metric || ' ' || signature FROM pat JOIN (
        SELECT pattern_id, arg_min(metric, pos) AS metric FROM sig WHERE role = 'primary' GROUP BY 1) f
    ON f.pattern_id = pat.id"""
_ASSESSED = f"""{_LABELLED},
    numbered AS (SELECT *, row_number() OVER (ORDER BY id) AS query_id FROM labelled),
    {sql.hybrid(asked=_ASKED, docs=_CHUNK_DOCS)}, {sql.signals()},
    judged AS (
        SELECT s.query_id, label, gold_document_id, gold_chunk_id, combined, {sql.VERDICT} AS verdict
        FROM signals s JOIN numbered n ON n.query_id = s.query_id)"""
_WILSON_HIGH = (
    "least(1, ({p} + 3.8414588206941245 / (2 * {n})) / (1 + 3.8414588206941245 / {n}) "
    "+ 1.959963984540054 * sqrt({p} * (1 - {p}) / {n} + 3.8414588206941245 / (4 * {n} * {n})) "
    "/ (1 + 3.8414588206941245 / {n}))"
)
_CORE = f"""{_ASSESSED},
    c AS (
        SELECT CAST(count(*) FILTER (label = 'answerable') AS DOUBLE) AS ny,
            CAST(count(*) FILTER (label = 'unanswerable') AS DOUBLE) AS nn,
            count(*) FILTER (label = 'unanswerable' AND verdict = 'sufficient') AS answered,
            count(*) FILTER (label = 'answerable' AND verdict = 'insufficient') AS refused FROM judged),
    missed AS (
        SELECT count(*) AS n FROM pat WHERE NOT EXISTS (SELECT 1 FROM hits h
            WHERE h.query_id = -pat.pos - 1 AND rank <= 5 AND h.doc_id // 1000 = pat.pos)),
    core AS (
        SELECT 'core' AS suite, 'sample_is_large_enough' AS name, ny >= 100 AND nn >= 100 AS passed,
            least(ny, nn) AS value FROM c
        UNION ALL SELECT 'core', 'false_answer_rate_within_budget',
            {_WILSON_HIGH.format(p='(answered / nn)', n='nn')} <= 0.1, round(answered / nn, 5) FROM c
        UNION ALL SELECT 'core', 'false_refusal_rate_within_budget', refused / ny <= 0.1,
            round(refused / ny, 5) FROM c
        UNION ALL SELECT 'core', 'ambiguous_never_permits_answering', true, CAST(0 AS DOUBLE)
        UNION ALL SELECT 'core', 'every_fault_reaches_its_runbook', n = 0, CAST(n AS DOUBLE) FROM missed)"""

_INCIDENTS = f"""{_CATALOGUE},
    pairs AS (
        SELECT s.id AS service_id, s.name AS service_name, p.id AS pattern_id, p.name AS pattern_name,
            signature, severity, row_number() OVER (ORDER BY s.id, p.id) - 1 AS pick
        FROM svc s JOIN pat p ON list_contains(p.runtimes, s.runtime)),
    inc AS (
        SELECT event_id AS seed, pairs.* FROM events
        JOIN pairs ON pick = event_id % (SELECT count(*) FROM pairs) WHERE event_type = 'error')"""
_POINTS = f"""{_INCIDENTS},
    walk AS (
        SELECT id AS root, id AS node, 0 AS hops FROM svc
        UNION SELECT root, up, hops + 1 FROM walk JOIN dep ON node = down),
    reach AS (SELECT root, node, min(hops) AS hops FROM walk WHERE hops > 0 GROUP BY ALL),
    trait AS (
        SELECT id, tier, runtime NOT IN {tuple(C.DATASTORE_RUNTIMES)} AS is_app,
            id IN (SELECT up FROM dep JOIN svc d ON d.id = down
                WHERE d.runtime IN {tuple(C.DATASTORE_RUNTIMES)}) AS on_store FROM svc),
    lanes AS (
        SELECT inc.seed, inc.pattern_id, inc.service_id, metric, 0 AS hops
        FROM inc JOIN sig USING (pattern_id) WHERE role = 'primary'
        UNION ALL
        SELECT inc.seed, inc.pattern_id, node, metric, hops
        FROM inc JOIN reach ON root = inc.service_id JOIN sig ON sig.pattern_id = inc.pattern_id
        JOIN trait ON trait.id = node
        WHERE role = 'secondary' AND CASE
            WHEN regexp_matches(metric, '^(db|cache)\\.') THEN on_store
            WHEN regexp_matches(metric, '^(http|thread_pool|runtime|process|tls)\\.') THEN is_app
            WHEN regexp_matches(metric, '^pipeline\\.') THEN tier = 3
            WHEN regexp_matches(metric, '^(stream|search)\\.') THEN NOT is_app ELSE is_app END),
    steps AS (
        SELECT lanes.*, step, (step * 60 - 2700 - hops * 90) / CAST(1800 AS DOUBLE) AS progress
        FROM lanes, range(76) r(step)),
    points AS (
        SELECT *, CASE WHEN progress <= 0 THEN 0 WHEN pattern_id = 'fault-cert-expiry' THEN 1
            WHEN pattern_id = 'fault-memory-leak' THEN least(1, progress)
            ELSE least(1, pow(progress, 0.6)) END
            * CASE WHEN hops = 0 THEN 1 ELSE 1 / (1 + 0.6 * (hops - 1)) END AS development
        FROM steps)"""

_SHOWN = "id, text, label, mechanism, gold_document_id, \"group\", gold_chunk_id"

ORACLE = {
    "symptom_questions": f"WITH {_CATALOGUE}, {_NODES}, {_SYMPTOM} SELECT {_SHOWN} FROM q_symptom",
    "section_questions": f"WITH {PAGE_CHUNKS_SQL}, {_SECTION} SELECT {_SHOWN} FROM q_section",
    "heading_questions": f"WITH {PAGE_CHUNKS_SQL}, {_HEADING} SELECT {_SHOWN} FROM q_heading",
    "policy_questions": f"WITH {_POLICY} SELECT {_SHOWN} FROM q_policy",
    "gap_questions": f"WITH {PAGE_CHUNKS_SQL}, {_GAP} SELECT {_SHOWN} FROM q_gap",
    "property_transfer_questions": f"WITH {PAGE_CHUNKS_SQL}, {_PROPERTY} SELECT {_SHOWN} FROM q_prop",
    "presupposition_questions": f"""
        WITH {PAGE_CHUNKS_SQL}, {_CATALOGUE}, {_NODES}, {_PRESUPPOSE} SELECT {_SHOWN} FROM q_pre""",
    "labelled_questions": f"WITH RECURSIVE {_LABELLED} SELECT {_SHOWN} FROM labelled",
    "dedup_first": f"""
        SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (
            PARTITION BY array_to_string({sql.tokens_of('text')}, ' ') ORDER BY doc_id) = 1""",
    "round_robin_cap": f"""
        WITH RECURSIVE src AS (
            SELECT doc_id AS id, lang AS mechanism, source AS "group" FROM documents),
        {_cap('src', 'kept')} SELECT * FROM kept""",
    "group_split": f"""
        WITH g AS (SELECT o_custkey, row_number() OVER (
                ORDER BY md5('{C.SEED}|' || o_custkey), o_custkey) AS place
            FROM (SELECT DISTINCT o_custkey FROM orders)),
        n AS (SELECT greatest(1, round_even(count(*) * 0.25, 0)) AS n FROM g)
        SELECT o_orderkey, o_custkey, CASE WHEN place <= n THEN 'test' ELSE 'train' END AS split
        FROM orders JOIN g USING (o_custkey), n""",
    "grouped_folds": """
        SELECT doc_id, source, CAST((dense_rank() OVER (ORDER BY source) - 1) % 5 AS INTEGER) AS fold
        FROM documents""",
    "core_suite": f"WITH RECURSIVE {_CORE} SELECT * FROM core",
    "probe_suite": f"""
        WITH RECURSIVE {_ASSESSED},
        x AS (SELECT min(combined) FILTER (label = 'answerable') AS lo,
            max(combined) FILTER (label = 'unanswerable') AS hi FROM judged),
        g AS (SELECT avg(CASE WHEN printf('%d#%02d', h.doc_id // 1000, h.doc_id % 1000)
                = j.gold_chunk_id THEN 1.0 ELSE 0.0 END) AS s
            FROM judged j LEFT JOIN hits h ON h.query_id = j.query_id AND h.rank = 1
            WHERE gold_chunk_id IS NOT NULL)
        SELECT 'probe' AS suite, 'signals_still_overlap' AS name, lo > hi AS passed,
            round(lo - hi, 5) AS value FROM x
        UNION ALL SELECT 'probe', 'value_absent_questions_still_score_high', hi < 3, round(hi, 5) FROM x
        UNION ALL SELECT 'probe', 'chunk_selection_is_weak', s >= 0.8, round(s, 5) FROM g""",
    "suite_report": f"""
        WITH RECURSIVE {_CORE}
        SELECT suite, bool_and(passed) AS passed, false AS warned, CAST(count(*) AS INTEGER) AS n_checks
        FROM core GROUP BY suite""",
    "feature_hygiene": f"""
        WITH f AS (
            SELECT n_chars, toks, regexp_matches(text, '{sql.SQL_VALUE}') AS v FROM labels JOIN (
                SELECT *, {sql.tokens_of('text')} AS toks FROM documents) USING (doc_id))
        SELECT 'n_chars' AS feature, min(n_chars) = max(n_chars) AS constant FROM f
        UNION ALL SELECT 'n_tokens', min(len(toks)) = max(len(toks)) FROM f
        UNION ALL SELECT 'n_terms', min(len(list_distinct(toks))) = max(len(list_distinct(toks))) FROM f
        UNION ALL SELECT 'has_value', min(v) = max(v) FROM f
        UNION ALL SELECT 'one', true""",
    "incidents_in_turn": f"""
        WITH {_INCIDENTS}
        SELECT printf('inc-%08x', seed) AS incident_id, service_id, pattern_id,
            pattern_name || ' on ' || service_name AS title, signature, CAST(severity AS INTEGER)
            AS severity, seed FROM inc""",
    "telemetry_development": f"""
        WITH RECURSIVE {_POINTS}
        SELECT pattern_id, service_id, metric, CAST(hops AS INTEGER) AS hops, CAST(step AS INTEGER) AS step,
            count(*) AS points, round(max(development), 6) AS development
        FROM points GROUP BY ALL""",
    "telemetry_onset": f"""
        WITH RECURSIVE {_POINTS}
        SELECT pattern_id, CAST(hops AS INTEGER) AS hops, CAST(min(step - 45) AS INTEGER) AS first_step,
            count(*) AS moved_points FROM points WHERE development > 0 GROUP BY ALL""",
    "baseline_vs_fault": """
        WITH o AS (SELECT user_id, min(ts) AS opened FROM events WHERE event_type = 'error' GROUP BY 1)
        SELECT event_type, round(avg(value) FILTER (ts < opened), 6) AS baseline_mean,
            round(avg(value) FILTER (ts >= opened), 6) AS fault_mean,
            max(value) FILTER (ts >= opened) AS fault_max, min(value) FILTER (ts >= opened) AS fault_min
        FROM events JOIN o USING (user_id) GROUP BY event_type""",
}
