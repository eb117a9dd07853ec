"""Labelled questions: generation, verification, capping, splitting.

A question row is ``(id, text, label, mechanism, gold_document_id, group,
gold_chunk_id)``; its label follows from how it was built.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions.text import strip, tokenize
from lodestone.operators.absence import stated, stated_together
from lodestone.operators.ordered import ROWS_PER_RANGE, row_numbers, top_k
from lodestone.staging import stage


def fill(template: Column, **values: Column) -> Column:
    """Template with each ``{name}`` replaced by its column."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def literal_list(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def question(
    id_: Column, text: Column, answerable: bool, mechanism: str, gold: Column, group: Column,
    gold_chunk: Column,
) -> list[Column]:
    return [
        id_.alias("id"), text.alias("text"),
        F.lit("answerable" if answerable else "unanswerable").alias("label"),
        F.lit(mechanism).alias("mechanism"), gold.cast("string").alias("gold_document_id"),
        group.cast("string").alias("group"), gold_chunk.cast("string").alias("gold_chunk_id"),
    ]


def _none() -> Column:
    return F.lit(None).cast("string")


def first_per_runtime(services: DataFrame, k: int) -> DataFrame:
    """``(position, name, runtime)`` of the first ``k`` services of each runtime. The first
    ``k`` over several runtimes are among these, so no pattern meets every service."""
    kept = top_k(
        services.select("position", "name", "runtime"), ["runtime"],
        [F.asc("position"), F.asc("name")], k,
    )
    return kept.drop("rank")


def symptom_questions(services: DataFrame, patterns: DataFrame, signals: DataFrame) -> DataFrame:
    """Primary signal times template; template ``i`` names applicable service ``i mod n``.

    Only the first services of a pattern can be named, so each pattern keeps at most
    as many as there are templates, whatever the size of the estate.
    """
    n_templates = len(C.SYMPTOM_TEMPLATES)
    able = patterns.select(F.col("id").alias("pattern_id"), F.explode("runtimes").alias("runtime"))
    sizes = services.groupBy("runtime").agg(F.count(F.lit(1)).alias("n"))
    counts = able.join(sizes, "runtime").groupBy("pattern_id").agg(F.sum("n").alias("n_services"))
    first = first_per_runtime(services, n_templates).join(able, "runtime")
    named = top_k(first, ["pattern_id"], [F.asc("position"), F.asc("name")], n_templates).select(
        "pattern_id", (F.col("rank") - 1).cast("long").alias("slot"), F.col("name").alias("service")
    )
    runbooks = patterns.select(F.col("id").alias("pattern_id"), "runbook_id")
    rows = (
        signals.filter("role = 'primary'")
        .select("pattern_id", "metric", "direction",
                F.posexplode(literal_list(C.SYMPTOM_TEMPLATES)).alias("i", "template"))
        .join(counts, "pattern_id")
        .withColumn("slot", F.col("i") % F.col("n_services"))
        .join(named, ["pattern_id", "slot"])
        .join(runbooks, "pattern_id")
    )
    rising = F.col("direction") == "rise"
    text = fill(
        F.col("template"), metric=F.col("metric"), service=F.col("service"),
        participle=F.when(rising, "climbing").otherwise("falling"),
        verb=F.when(rising, "climb").otherwise("fall"),
    )
    id_ = F.concat_ws("-", F.lit("q-sym"), "pattern_id", "metric", F.col("i").cast("string"))
    return rows.select(*question(
        id_, text, True, "symptom_from_fault_signal", F.col("runbook_id"), F.col("runbook_id"), _none()
    ))


def _with_titles(chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """Headed chunks with the title of their document, or its id for want of one."""
    named = titles.select(F.col("id").alias("document_id"), "title")
    return chunks.filter("heading IS NOT NULL").join(named, "document_id", "left").withColumn(
        "title", F.coalesce("title", F.col("document_id").cast("string"))
    )


def section_questions(
    titles: DataFrame, chunks: DataFrame, templates: dict[str, list[str]] | None = None
) -> DataFrame:
    templates = C.SECTION_TEMPLATES if templates is None else templates
    by_heading = F.create_map(
        *[x for h, t in templates.items() for x in (F.lit(h), literal_list(t))]
    )
    name = F.lower(F.split_part(F.split_part("title", F.lit(" on "), F.lit(1)), F.lit(" after "), F.lit(1)))
    rows = _with_titles(chunks, titles).select(
        "chunk_id", "document_id", "title", name.alias("name"),
        F.posexplode(F.try_element_at(by_heading, F.col("heading"))).alias("i", "template"),
    )
    text = fill(F.col("template"), name=F.col("name"), title=F.lower("title"))
    id_ = F.concat_ws("-", F.lit("q-sec"), "chunk_id", F.col("i").cast("string"))
    return rows.select(*question(
        id_, text, True, "section_from_runbook_heading", F.col("document_id"), F.col("document_id"),
        F.col("chunk_id"),
    ))


def heading_texts(heading: Column, title: Column) -> Column:
    """Two phrasings of a heading as a question."""
    h, t = F.lower(strip(heading)), F.lower(title)
    asks = h.rlike("^(?:" + "|".join(C.WH_WORDS) + ")")
    verb = F.when(h.endswith("s") & ~h.endswith("ss"), "are").otherwise("is")
    return F.when(asks, F.array(h, F.concat(h, F.lit(", for "), t))).otherwise(
        F.array(
            F.concat(F.lit("what "), verb, F.lit(" the "), h),
            F.concat(F.lit("explain the "), h, F.lit(" for "), t),
        )
    )


def heading_questions(titles: DataFrame, chunks: DataFrame) -> DataFrame:
    headed = _with_titles(chunks, titles).filter(strip(F.col("heading")) != "")
    rows = headed.select(
        "chunk_id", "document_id",
        F.posexplode(heading_texts(F.col("heading"), F.col("title"))).alias("i", "text"),
    )
    id_ = F.concat_ws("-", F.lit("q-head"), "chunk_id", F.col("i").cast("string"))
    return rows.select(*question(
        id_, F.col("text"), True, "question_from_any_section_heading", F.col("document_id"),
        F.col("document_id"), F.col("chunk_id"),
    ))


def policy_questions(lookups: DataFrame) -> DataFrame:
    """``lookups(position, text, document_id)``: values a corpus states."""
    return lookups.select(*question(
        F.format_string("q-pol-%03d", "position"), F.col("text"), True, "policy_value_lookup",
        F.col("document_id"), F.col("document_id"), _none(),
    ))


def gap_questions(topics: DataFrame, chunks: DataFrame) -> DataFrame:
    """``topics(position, text, terms)``: kept where no chunk states all terms."""
    named = topics.withColumn("topic", F.col("position"))
    absent = named.join(stated(named, chunks), "topic", "left_anti")
    return absent.select(*question(
        F.format_string("q-gap-%03d", "position"), F.col("text"), False, "topic_absent_from_corpus",
        _none(), F.lit("__gaps__"), _none(),
    ))


#: Entities that ride beside a property as one array.
ENTITY_BLOCK = 10_000


def property_transfer_questions(
    properties: DataFrame, entities: DataFrame, chunks: DataFrame
) -> DataFrame:
    """A property some passage states, asked of every entity it is not stated for.

    ``properties(position, prop, documented_for, proof_terms)``,
    ``entities(position, entity)``. An entity that a passage names together with the first
    word of the property is not asked about; such pairs are read off the passages. The
    questions themselves are one for each other property and entity, so entities are laid
    beside a property in blocks.
    """
    proof = properties.select(F.col("position").alias("topic"), F.col("proof_terms").alias("terms"))
    word = F.lower(F.split_part("prop", F.lit(" "), F.lit(1)))
    documented = stage(properties.join(
        stated(proof, chunks).withColumnRenamed("topic", "position"), "position", "left_semi"
    ).withColumn("word", word), "documented-properties")
    entities = stage(row_numbers(entities, [F.col("position")], "_row"), "entities")
    known = stage(stated_together(
        entities.select(F.lower("entity").alias("term")), documented.select(F.col("word").alias("term")), chunks
    ), "stated-pairs")
    blocks = entities.groupBy(F.floor((F.col("_row") - 1) / ENTITY_BLOCK).alias("block")).agg(
        F.collect_list(F.struct(F.col("position").alias("at"), "entity")).alias("e"))
    n_blocks = blocks.count()
    asked = documented.select(
        "position", "prop", "documented_for", "word",
        F.explode(F.expr(f"sequence(0L, {max(n_blocks, 1) - 1}L)")).alias("block"),
    ).join(blocks, "block").select(
        "position", "prop", "documented_for", "word", F.explode("e").alias("e")
    ).select("position", "prop", "documented_for", "word", "e.at", "e.entity").where(
        ~F.contains(F.col("documented_for"), F.col("entity")) & (F.col("word") != "") & (F.col("entity") != "")
    ).join(
        known, (F.lower("entity") == F.col("a")) & (F.col("word") == F.col("b")), "left_anti"
    ).select(
        "position", "at", "prop", "entity",
        F.posexplode(literal_list(C.PROPERTY_TEMPLATES)).alias("i", "template"),
    )
    numbered = row_numbers(asked, [F.col("position"), F.col("at"), F.col("i")], "n")
    return numbered.select(*question(
        F.format_string("q-prop-%03d", F.col("n") - 1),
        fill(F.col("template"), prop=F.col("prop"), entity=F.col("entity")), False,
        "property_documented_for_another_entity", _none(),
        F.concat(F.lit("__prop__"), F.col("entity")), _none(),
    ))


def presupposition_questions(
    services: DataFrame, patterns: DataFrame, signals: DataFrame, chunks: DataFrame,
    per_pattern: int = C.PRESUPPOSITION_SERVICES,
) -> DataFrame:
    """A fault asked about the first services whose runtime cannot show it.

    A pattern excludes its own runtimes only, so each runtime is paired with the
    patterns it is not listed for; services then join by runtime and each pattern
    keeps the first ``per_pattern`` (published: six).
    """
    first = signals.filter("role = 'primary'").groupBy("pattern_id").agg(
        F.min_by("metric", "position").alias("metric")
    )
    runtimes = services.agg(F.collect_set("runtime").alias("r")).scalar()
    unable = patterns.select(
        F.col("id").alias("pattern_id"), F.col("position").alias("p"),
        F.explode(F.array_except(runtimes, F.col("runtimes"))).alias("runtime"),
    )
    paired = first_per_runtime(services, per_pattern).join(unable, "runtime")
    six = top_k(paired, ["pattern_id"], [F.asc("position"), F.asc("name")], per_pattern)
    rows = stage(six.join(first, "pattern_id"), "wrong-services")
    both = rows.select(
        F.struct("p", "rank").alias("topic"), F.array(F.lower("name"), F.lower("metric")).alias("terms")
    )
    known = stated(both, chunks).select("topic.p", "topic.rank")
    asked = rows.join(known, ["p", "rank"], "left_anti").select(
        "p", "rank", "pattern_id", "metric", "name",
        F.posexplode(literal_list(C.PRESUPPOSITION_TEMPLATES)).alias("i", "template"),
    )
    numbered = row_numbers(asked, [F.col("p"), F.col("rank"), F.col("i")], "n")
    return numbered.select(*question(
        F.format_string("q-pre-%03d", F.col("n") - 1),
        fill(F.col("template"), metric=F.col("metric"), service=F.col("name")), False,
        "entity_cannot_exhibit_this_fault", _none(),
        F.concat(F.lit("__pre__"), F.col("pattern_id")), _none(),
    ))


def first_per_token_tuple(questions: DataFrame, id_: str = "id") -> DataFrame:
    """Keep the smallest id of each token sequence. The key is a digest of the
    sequence and copies are folded before the shuffle, however many there are."""
    key = F.sha2(F.array_join(tokenize(F.col("text")), " "), 256)
    row = F.struct(*questions.columns)
    return questions.groupBy(key.alias("_key")).agg(F.min_by(row, id_).alias("r")).select("r.*")


def capped_sizes(sizes: dict[str, int], max_share: float = C.MAX_MECHANISM_SHARE) -> dict[str, int]:
    """Rows each mechanism keeps when the cap is applied until nothing changes.

    The cap is a share of what is left, and each pass keeps a prefix of the same
    round-robin order, so the passes need the counts only. As published there are
    ``MAX_CAP_ROUNDS`` passes at most; a warning tells when they do not suffice.
    """
    kept = dict(sizes)
    for _ in range(C.MAX_CAP_ROUNDS):
        cap = max(1, int(sum(kept.values()) * max_share))
        after = {m: min(n, cap) for m, n in kept.items()}
        if after == kept:
            break
        kept = after
    else:
        warnings.warn(f"the cap still moves after {C.MAX_CAP_ROUNDS} passes", stacklevel=2)
    return kept


def cap_mechanisms(
    questions: DataFrame, max_share: float = C.MAX_MECHANISM_SHARE, id_: str = "id",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """No mechanism above its share, thinned in turn over its groups.

    Mechanisms are few and their counts are read once. Positions in a group and in
    the turn order come from range-split ranks, so a group or mechanism with a
    third of all rows is not sorted by one task.
    """
    questions = stage(questions, "questions")
    sizes = {r["mechanism"]: r["count"] for r in questions.groupBy("mechanism").count().collect()}
    kept = capped_sizes(sizes, max_share)
    thinned = [m for m in sizes if kept[m] < sizes[m]]
    if not thinned:
        return questions
    whole = questions.filter(~F.col("mechanism").isin(thinned))
    parts = questions.filter(F.col("mechanism").isin(thinned))
    turns = row_numbers(parts, [F.col(id_)], "_turn", ["mechanism", "group"], rows_per_range)
    placed = row_numbers(
        turns, [F.col("_turn"), F.col("group")], "_place", ["mechanism"], rows_per_range
    )
    caps = F.create_map(*[x for m in thinned for x in (F.lit(m), F.lit(kept[m]))])
    return whole.unionByName(
        placed.filter(F.col("_place") <= F.element_at(caps, F.col("mechanism"))).drop("_turn", "_place")
    )


def assemble(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return cap_mechanisms(first_per_token_tuple(out))


def split_by_group(
    rows: DataFrame, group: str, test_fraction: float = C.TEST_FRACTION, seed: int = C.SEED,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add ``split``: whole groups go to test, in the order of a seeded digest."""
    groups = stage(rows.select(group).distinct(), "groups")
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(group).cast("string")).cast("binary"))
    placed = row_numbers(
        groups.withColumn("_order", order), [F.col("_order"), F.col(group)], "_place",
        rows_per_range=rows_per_range,
    )
    n_test = max(1, round(groups.count() * test_fraction))
    split = F.when(F.col("_place") <= n_test, "test").otherwise("train")
    return rows.join(placed.select(group, split.alias("split")), group)


def grouped_folds(rows: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Add ``fold``: groups in id order are dealt to ``k`` folds."""
    placed = row_numbers(rows.select(group).distinct(), [F.col(group)], "_place")
    return rows.join(
        placed.select(group, ((F.col("_place") - 1) % k).cast("int").alias("fold")), group
    )
