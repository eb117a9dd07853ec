import pytest
from pyspark.sql import functions as F

from lodestone.operators import constraints as K
from lodestone.sources import artefacts, corpus, sinks

GOOD = '---\nid: rb-one\nkind: runbook\ntitle: "First"\n\n---\n# First\n\nbody\n'


def write(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_corpus_is_read_below_the_root(spark, tmp_path):
    write(tmp_path, "runbooks/one.md", GOOD)
    write(tmp_path, "policies/two.md", GOOD.replace("rb-one", "pol-two").replace("runbook", "policy"))
    write(tmp_path, "GAPS.md", "not indexed")
    write(tmp_path, "notes.txt", "not markdown")
    rows = {r.id: r for r in corpus.load_corpus(spark, str(tmp_path)).collect()}
    assert set(rows) == {"rb-one", "pol-two"}
    assert rows["rb-one"].source_uri == "corpus/runbooks/one.md"
    assert rows["rb-one"].title == "First" and rows["rb-one"].body == "# First\n\nbody"


@pytest.mark.parametrize("text, problem", [
    ("no block", "missing front matter block"),
    (GOOD.replace("kind: runbook", "Kind runbook"), "not key: value"),
    (GOOD.replace("kind: runbook\n", ""), "missing kind"),
    (GOOD.replace("runbook", "poem"), "unknown kind"),
    ("---\nid: a\nkind: policy\ntitle: t\n---\n\n", "no body"),
])
def test_malformed_files_are_refused(spark, tmp_path, text, problem):
    write(tmp_path, "x/bad.md", text)
    with pytest.raises(corpus.CorpusError, match=problem):
        corpus.load_corpus(spark, str(tmp_path))


def test_duplicate_ids_are_refused(spark, tmp_path):
    write(tmp_path, "a/one.md", GOOD)
    write(tmp_path, "b/two.md", GOOD)
    with pytest.raises(corpus.CorpusError, match="duplicate"):
        corpus.load_corpus(spark, str(tmp_path))


def test_short_blocks_join_the_one_before(spark):
    long = "x" * 250
    body = f"{long}\n## Short\nfew words\n# Long one\n{long}\n#\n\n# Tail"
    docs = spark.createDataFrame([("d", body), ("e", "# Only"), ("f", "   ")], "id string, body string")
    rows = corpus.chunk_documents(docs).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.heading) for r in rows] == [("d#00", None), ("d#01", "Long one"), ("e#00", "Only")]
    assert rows[0].body == f"{long}\n\nShort\n\nfew words"
    assert rows[1].body == f"Long one\n\n{long}\n\n\n\nTail"
    assert rows[2].body == "Only" and rows[2].token_count == 1


def test_frames_survive_a_round_trip(spark):
    df = spark.sql("SELECT 1 AS id, 'a' AS k")
    frame = artefacts.encode_event(F.col("k"), F.to_json(F.struct("id")))
    buffers = df.select(F.concat(frame, F.lit("event: b\ndata: {broken\n\ndata: {}\n\n"), frame, F.lit("eve")).alias("b"))
    rows = artefacts.decode_events(buffers, "b", "id int").collect()
    assert [(r.kind, r.data.id, r.position, r.tail) for r in rows] == [("a", 1, 0, "eve"), ("a", 1, 3, "eve")]


def test_tables_and_constants(spark):
    lines = spark.createDataFrame(
        [("| D-001 | found | **1** |",), ("| Id | x |",), ("LIMIT = 0.74",), ("# LIMIT = 3",), ("NAME = x",)], "value string"
    )
    assert artefacts.markdown_rows(lines, r"D-\d+").first().cells == ["D-001", "found", "**1**"]
    assert [tuple(r) for r in artefacts.number_constants(lines).collect()] == [("LIMIT", 0.74)]


def test_upsert_and_partial_update(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "k int, x string, y int")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"]).collect())) == [(1, "a", 1), (2, None, 9), (3, "c", 3)]
    partial = sinks.upsert(old, new, ["k"], ["y"])
    assert sorted(map(tuple, partial.collect())) == [(1, "a", 1), (2, "b", 9), (3, "c", 3)]
    again = sinks.upsert(partial, new, ["k"], ["y"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, partial.collect()))


def test_orphans_are_deleted_only_in_loaded_documents(spark):
    stored = spark.createDataFrame([("d", "d#0"), ("d", "d#1"), ("e", "e#0")], "doc string, id string")
    loaded = spark.createDataFrame([("d", "d#0")], "doc string, id string")
    kept = sinks.delete_orphans(stored, loaded, "doc", "id")
    assert {r.id for r in kept.collect()} == {"d#0", "e#0"}


def test_vectors_of_two_models_lie_apart(spark, tmp_path):
    path = str(tmp_path / "v")
    for model in ("m1", "m2"):
        sinks.write_vectors(spark.createDataFrame([(1, [1.0], model)], "id int, vec array<double>, model string"), path)
    stored = spark.read.parquet(path).filter("model = 'm1'")
    assert stored.count() == 1
    assert "PartitionFilters: [isnotnull(model" in stored._jdf.queryExecution().toString()


def test_constraints_report_and_pass(spark):
    t = spark.createDataFrame([(1, 5, 1), (1, None, 2), (2, -1, None)], "id int, v int, parent int")
    parents = spark.createDataFrame([(1,)], "pid int")
    rules = [
        K.Check("v is positive", F.col("v") > 0), K.Unique("id", ("id",)),
        K.Reference("parent", ("parent",), parents, ("pid",)), K.Check("fine", F.col("id") > 0),
    ]
    assert {r.rule: r.n for r in K.violations(t, rules).collect()} == {"v is positive": 1, "id": 1, "parent": 1}


def test_migration_edits_are_seen_and_reformatting_is_not(spark):
    files = spark.createDataFrame(
        [("0001_a.sql", "CREATE x;  \nB"), ("0002_b.sql", "B"), ("0004_d.sql", "D"), ("bad.sql", "x")], "file string, sql string"
    )
    digest = {r.file: r.c for r in files.select("file", K.migration_checksum(F.col("sql")).alias("c")).collect()}
    same = spark.range(1).select(K.migration_checksum(F.lit("CREATE x;\nB\n"))).first()[0]
    assert digest["0001_a.sql"] == same
    applied = spark.createDataFrame([(1, same), (2, "other"), (9, "z")], "version int, checksum string")
    got = {tuple(r) for r in K.migration_problems(files, applied).collect()}
    assert got == {
        ("bad.sql", "bad file name"), ("0004_d.sql", "gap before this version"),
        ("0002_b.sql", "edited after it was applied"), ("0009", "applied but missing"),
    }
    assert [r.version for r in K.pending_migrations(files.filter("file <> 'bad.sql'"), applied).collect()] == [4]


def test_every_table_can_be_made_and_checked(spark):
    from lodestone import schemas

    empty = {name: spark.createDataFrame([], ddl) for name, ddl in schemas.TABLES.items()}
    assert len(empty) == 18 and schemas.violations(empty).isEmpty()


def test_broken_rows_are_reported(spark):
    from lodestone import schemas

    def rows(name, *values):
        return spark.createDataFrame(list(values), schemas.TABLES[name])

    tables = {
        "document": rows("document", ("d", "poem", "t", "u", None)),
        "chunk": rows("chunk", ("c", "d", 0, None, "b", 1), ("e", "gone", 0, None, "", 1)),
        "approval": rows("approval", (1, "r", "a", "high", None, "approved", None, None), (2, "r", "a", "low", None, None, None, None)),
    }
    assert {r.rule: r.n for r in schemas.violations(tables).collect()} == {
        "document: kind IN ('runbook', 'postmortem', 'policy', 'architecture')": 1,
        "chunk: length(body) > 0": 1, "chunk: document_id in document": 1,
        "approval: unique run_id": 1, "approval: (decision IS NULL) = (decided_at IS NULL)": 1,
        "approval: (decision IS NULL) = (decided_by IS NULL)": 1,
    }
    with pytest.raises(ValueError, match="unknown"):
        schemas.violations({"nothing": tables["chunk"]})


def test_migrations_after_9999_keep_their_number(spark):
    files = spark.createDataFrame(
        [("9999_add_a.sql", "A;"), ("10000_add_b.sql", "B;"), ("10002_add_c.sql", "C;"),
         ("01000_add_d.sql", "D;"), ("later_add_e.sql", "E;")], "file string, sql string")
    applied = files.filter("file = '10000_add_b.sql'").select(
        F.lit(10000).alias("version"), K.migration_checksum(F.col("sql")).alias("checksum"))
    got = {tuple(r) for r in K.migration_problems(files, applied).collect()}
    assert got == {
        ("01000_add_d.sql", "bad file name"), ("later_add_e.sql", "bad file name"),
        ("9999_add_a.sql", "gap before this version"), ("10002_add_c.sql", "gap before this version"),
    }
    pending = K.pending_migrations(files, applied).collect()
    assert {(r.version, r.file) for r in pending} == {(9999, "9999_add_a.sql"), (10002, "10002_add_c.sql")}
