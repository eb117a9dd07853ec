from pyspark.sql import functions as F

from lodestone.functions import text as T


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in df.select("i", expression(F.col("x"))).orderBy("i").collect()]


def test_tokens_keep_identifiers_whole_and_in_parts(spark):
    assert column(spark, ["The db.pool.wait_ms is 7 HIGH", "a b", "", "x1.y2_z3"], T.tokenize) == [
        ["db.pool.wait_ms", "db", "pool", "wait", "ms", "high"], [], [], ["x1.y2_z3", "x1", "y2", "z3"],
    ]


def test_negations_survive_the_stop_list(spark):
    assert column(spark, ["do not restart, never in the dark"], T.tokenize) == [
        ["do", "not", "restart", "never", "dark"]
    ]


def test_grams(spark):
    assert column(spark, ["rate", "rates"], T.char_ngrams) == [["rate"], ["^rat", "rate", "ates", "tes$"]]


def test_estimates(spark):
    assert column(spark, ["", "one", "one two three four"], T.token_estimate) == [1, 1, 5]


def test_prompts_fold_case_and_space_only(spark):
    assert column(spark, ["  Restart?\n Now  ", "restart!"], T.normalise_prompt) == [
        "restart? now", "restart!"
    ]


def test_marker_after_the_stop_is_its_own_sentence(spark):
    found = column(spark, ["The pool was full today. [1] Done!"], T.sentences)
    assert found == [["The pool was full today.", "[1] Done!"]]


def test_claims(spark):
    texts = [
        "I don't know what the limit is here.", "Policy is silent on all of these matters.",
        "Too short to count.", "The connection pool reached its ceiling.", "Summary: five words are here now.",
    ]
    assert column(spark, texts, T.is_claim) == [False, False, False, True, False]


def test_value_rules(spark):
    assert column(spark, ["Tier 0", "wait 5 ms", "about 30", "é12", "7", "3.5 days"], T.contains_value) == [
        False, True, True, False, False, True
    ]
    assert column(spark, ["How long is it", "what is the timeout", "what is a timeout"], T.demands_value) == [
        True, True, False
    ]


def test_slug(spark):
    assert column(spark, ["Some Name, v2!", "--x--"], T.slug) == ["some-name-v2", "x"]
