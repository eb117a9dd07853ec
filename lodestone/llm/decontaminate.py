"""Benchmark decontamination by template canonicalisation, in column expressions only.

Words become templates: numbers, units after a number and capitalised names turn into
typed placeholders, everything else is lowered. Windows of template words are hashed and
joined with those of the benchmark. Windows of one document that meet an item on one
diagonal are aligned word by word, and the item is found where enough of its windows are
met and its slots are filled consistently: one value of the item, one value of the document.
That finds copies as well as questions with other numbers and names.

A value may have another number of words than the item's: in a third form a run of
numbers, or of names, is one placeholder, and windows on neighbouring diagonals count
together. Windows that are equal word by word count whatever the slots of others hold.

Items that templates do not hold whole (short ones, windows of little but slots, scripts
without spaces) are also sought as they stand, with real numbers and names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import column, with_row_ids
from lodestone.staging import stage

# Words that are units where they follow a number.
UNITS = (
    "mm cm m km inch inches ft foot feet yard yards mile miles mg g kg t oz lb lbs pound pounds "
    "ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour "
    "hours day days week weeks month months year years usd eur dollar dollars euro euros cent cents "
    "percent w kw hz khz mhz v mv a ma k c f"
).split()
NUMBER, UNIT, NAME = "<n>", "<u>", "<p>"

#: Most benchmark windows that are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 500_000

#: Diagonals at most so many words apart belong to one place of a document.
DRIFT = 8

WORDS = "filter(split(coalesce(text, ''), '[^\\\\p{L}\\\\p{N}]+'), w -> w <> '')"

#: A word that starts with 0 to 9: no other letter or number sorts before the colon.
DIGIT = "{0} < ':'"

#: Letters of scripts without spaces between words; each is a word of the form as it stands.
UNSPACED = "[\\\\p{IsHan}\\\\p{IsHiragana}\\\\p{IsKatakana}\\\\p{IsThai}\\\\p{IsLao}\\\\p{IsKhmer}\\\\p{IsMyanmar}]"
AS_IT_STANDS = (
    f"flatten(transform(words, w -> if(w rlike '{UNSPACED}', filter(split(regexp_replace("
    f"lower(w), '({UNSPACED})', ' $1 '), ' '), x -> x <> ''), array(lower(w)))))"
)


def _template(names: bool) -> str:
    """Template words of the column ``words``; with or without placeholders for names."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    name = f"when lower(w) <> w then '{NAME}' " if names else ""
    return (
        f"transform(words, (w, i) -> case when {DIGIT.format('w')} then '{NUMBER}' "
        f"when {DIGIT.format('get(words, i - 1)')} and lower(w) in ({units}) "
        f"then '{UNIT}' {name}else lower(w) end)"
    )


def _collapsed(template: str) -> str:
    """The column ``template`` with each run of numbers or of names as one placeholder."""
    return f"filter({template}, (w, i) -> not {_repeats(template, 'w', 'i')})"


def _repeats(template: str, word: str, at: str) -> str:
    return (f"({word} in ('{NUMBER}', '{NAME}') and {at} > 0 "
            f"and {template}[greatest({at} - 1, 0)] = {word})")


def _templates(frame: DataFrame, *keep: str) -> DataFrame:
    """(keep..., words, t0, t1, t2, t3): form 1 hides names, form 2 also makes a run one
    placeholder, and form 3 is the text as it stands."""
    return frame.select(
        *keep, "words", F.expr(_template(False)).alias("t0"), F.expr(_template(True)).alias("t1")
    ).select(
        *keep, "words", "t0", "t1", F.expr(_collapsed("t1")).alias("t2"),
        F.expr(AS_IT_STANDS).alias("t3"))


def _windows(frame: DataFrame, wanted: list[tuple[int, int]], *keep: str) -> DataFrame:
    """(keep..., form, length, pos, hash) of all template windows of the (form, length) wanted.

    Only ``keep`` travels with the windows, never the text or its words.
    """
    each = F.array(*[
        F.expr(
            f"struct({form} as form, {n} as length, if(size(t{form}) < {n}, array(), "
            f"transform(sequence(0, size(t{form}) - {n}), "
            f"i -> xxhash64({form}, slice(t{form}, i + 1, {n})))) as hashes)"
        )
        for form, n in wanted
    ])
    listed = _templates(frame, *keep).select(*keep, F.explode(each).alias("x"))
    return listed.select(
        *keep, "x.form", "x.length", F.posexplode("x.hashes").alias("pos", "hash"))


#: Words as numbers: 1 to 3 for the placeholders, a hash for all others. Forms 0 to 3.
_CODES = {
    "lowered": "transform(words, w -> lower(w))",
    "h0": f"transform(lowered, (w, i) -> case when {DIGIT.format('w')} then 1L when "
          f"{DIGIT.format('get(lowered, i - 1)')} and w in ({', '.join(repr(u) for u in UNITS)}) "
          "then 2L else xxhash64(w) end)",
    "h1": "zip_with(h0, zip_with(lowered, words, (l, w) -> l <> w), (x, name) -> if(name and x not in (1L, 2L), 3L, x))",
    "h2": "filter(h1, (x, i) -> not (x in (1L, 3L) and i > 0 and h1[greatest(i - 1, 0)] = x))",
}
_CODED = (f"transform({{0}}, x -> case x when '{NUMBER}' then 1L when '{UNIT}' then 2L "
          f"when '{NAME}' then 3L else xxhash64(x) end)")


def _chained(frame: DataFrame, codes: str, lengths: list[int]) -> tuple[DataFrame, dict[int, str]]:
    """Columns with the hash of the window of each length from every place of ``codes`` on.

    A window's hash is that of the hashes of its two halves, so each length costs one pass
    of pairs. Places too near the end for a whole window hold numbers that mean nothing.
    """
    made = {1: codes}

    def need(n: int) -> None:
        nonlocal frame
        if n not in made:
            need(n // 2)
            need(n - n // 2)
            made[n] = f"{codes}_{n}"
            frame = frame.select("*", F.expr(
                f"zip_with({made[n // 2]}, slice({made[n - n // 2]}, {n // 2 + 1}, size({codes})), "
                "(x, y) -> xxhash64(x, y))"
            ).alias(made[n]))

    for n in lengths:
        need(n)
    return frame, made


def _probes(texts: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """(doc_id, probe): hashes of the windows of a text, alike for all forms.

    A window of one form that is equal in another is hashed once: form 1 where it differs
    from form 0, form 2 where a run was collapsed. Form 3 is made if an item asks for it.
    """
    plain = sorted({n for form, n in sizes if form < 3})
    stands = sorted({n for form, n in sizes if form == 3})
    coded = texts.select("doc_id", "words", F.expr(_CODES["lowered"]).alias("lowered"))
    coded = coded.select("*", F.expr(_CODES["h0"]).alias("h0"))
    coded = coded.select("doc_id", "words", "h0", F.expr(_CODES["h1"]).alias("h1"))
    coded = coded.select("doc_id", "words", "h0", F.expr("if(h1 <> h0, h1, array())").alias("h1"),
                         F.expr(_CODES["h2"]).alias("h2"))
    coded = coded.select("doc_id", "words", "h0", "h1", F.expr(
        "if(size(h2) < size(h1), h2, array())").alias("h2"))
    if stands:
        coded = coded.select("*", F.expr(_CODED.format(AS_IT_STANDS)).alias("h3"))
    whole = []
    for codes, lengths in (("h0", plain), ("h1", plain), ("h2", plain), ("h3", stands)):
        if lengths:
            coded, made = _chained(coded, codes, lengths)
            whole += [f"slice({made[n]}, 1, greatest(size({codes}) - {n - 1}, 0))" for n in lengths]
    each = F.flatten(F.array(*[F.expr(x) for x in whole])) if whole else F.expr("array(0L)")
    return coded.select("doc_id", F.explode(each).alias("probe"))


def benchmark_windows(items: DataFrame, window: int, least_words: int, literals: int) -> DataFrame:
    """(item_id, form, length, pos, hash, probe): windows with enough words that are no slots.

    Windows as they stand need no such words. They are made for items that lose a window
    of form 0, have under ``least_words`` words, or hold letters of a script without spaces.
    """
    made = _templates(items.withColumn("words", F.expr(WORDS)), "item_id")
    slots = f"('{NUMBER}', '{UNIT}', '{NAME}')"

    def cut(form: int, template: str) -> DataFrame:
        return made.select(
            "item_id", F.lit(form).alias("form"), F.col(template).alias("template"),
            F.expr(f"least({window}, size({template}))").alias("length"), F.size("words").alias("n"),
            F.expr(f"exists(words, w -> w rlike '{UNSPACED}')").alias("unspaced"),
        ).where("length > 0").select("*", F.posexplode(F.expr(
            "transform(sequence(0, size(template) - length), i -> slice(template, i + 1, length))"
        )).alias("pos", "w"))

    told = f"n >= {least_words} and size(filter(w, x -> x not in {slots})) >= least({literals}, length)"
    lost = cut(0, "t0").where(f"unspaced or not ({told})").select("item_id").distinct()
    found = stage(reduce(DataFrame.union, [cut(form, f"t{form}").where(told) for form in range(3)]).union(
        cut(3, "t3").join(lost, "item_id", "left_semi")
    ).select("item_id", "form", "length", "pos", F.xxhash64("form", "w").alias("hash"),
             F.expr(_CODED.format("w")).alias("codes")), "windows")
    lengths = [r["length"] for r in found.select("length").distinct().collect()]  # at most ``window``
    chained, made = _chained(found, "codes", lengths)
    first = F.coalesce(*[F.when(F.col("length") == n, F.get(made[n], F.lit(0))) for n in lengths], F.lit(0).cast("long"))
    return chained.select("item_id", "form", "length", "pos", "hash", first.alias("probe"))


def _with_values(frame: DataFrame, key: str, name: str) -> DataFrame:
    """(key, system, name): what stands at each place of a text, in lower case.

    System 0 numbers the words, system 2 those of form 2, where a whole run is one value,
    and system 3 those of form 3.
    """
    made = stage(_templates(frame, key), "templates")
    starts = stage(made.where("size(words) > 0").select(key, "words", F.expr(
        f"filter(sequence(0, size(words) - 1), i -> not {_repeats('t1', 't1[i]', 'i')})"
    ).alias("starts")), "run-starts")
    plain = made.select(
        key, F.lit(0).alias("system"), F.expr("transform(words, w -> lower(w))").alias(name))
    runs = starts.select(key, F.lit(2).alias("system"), F.expr(
        "transform(starts, (p, k) -> lower(array_join(slice(words, p + 1, "
        "if(k + 1 < size(starts), starts[least(k + 1, size(starts) - 1)], size(words)) - p), ' ')))"
    ).alias(name))
    stands = made.select(key, F.lit(3).alias("system"), F.col("t3").alias(name))
    return stage(plain.union(runs).union(stands), "values")


def _by_place(hits: DataFrame, items: DataFrame, held: DataFrame, coverage: float,
              totals: DataFrame) -> DataFrame:
    """(rid, item_id, matched, windows, changed) over neighbouring diagonals, in each numbering.

    If a place fills its slots inconsistently, only windows equal word by word count.
    """
    key = ["rid", "item_id", "system"]
    diagonals = hits.groupBy(*key, F.expr("at - pos").alias("shift")).agg(
        F.collect_set("pos").alias("places"), F.max("length").alias("length"))
    order = Window.partitionBy(*key).orderBy("shift")
    clustered = diagonals.withColumn(
        "new", F.coalesce((F.col("shift") - F.lag("shift").over(order) > DRIFT).cast("int"), F.lit(0))
    ).withColumn("place", F.sum("new").over(order))
    # A window that is met on several diagonals of a place counts on the fullest of them.
    chosen = clustered.select(
        *key, "place", "shift", "length", F.size("places").alias("n"), F.explode("places").alias("pos")
    ).groupBy(*key, "place", "pos").agg(
        F.max_by("shift", F.struct("n", "shift")).alias("shift"), F.max("length").alias("length"))
    enough = chosen.groupBy(*key, "place").agg(
        F.collect_list(F.struct("pos", "shift")).alias("met"), F.max("length").alias("length")
    ).join(totals, ["item_id", "system"]).where(F.size("met") >= coverage * F.col("windows"))
    theirs = _with_values(items.withColumn("words", F.expr(WORDS)), "item_id", "theirs")
    ours = _with_values(held, "rid", "ours")
    pairs = stage(enough.join(theirs, ["item_id", "system"]).join(ours, ["rid", "system"]).select(
        *key, "place", "windows", F.expr(
            "transform(met, m -> transform(sequence(0, length - 1), k -> struct(m.pos + k as p, "
            "theirs[m.pos + k] as a, ours[m.pos + m.shift + k] as b)))").alias("met")), "met-places")
    judged = pairs.select(
        "rid", "item_id", "windows", F.size("met").alias("n"),
        F.expr("size(filter(met, w -> not exists(w, x -> x.a <> x.b)))").alias("equal"),
        F.expr("array_distinct(transform(flatten(met), x -> struct(x.a as a, x.b as b)))").alias("kinds"),
        F.expr("size(array_distinct(filter(flatten(met), x -> x.a <> x.b)))").alias("other"),
    ).withColumn("fits", F.expr(
        "size(kinds) = size(array_distinct(transform(kinds, x -> x.a)))"
    )).select(
        "rid", "item_id", F.expr("cast(if(fits, n, equal) as long)").alias("matched"),
        "windows", F.expr("cast(if(fits, other, 0) as long)").alias("changed"))
    return judged.where(F.col("matched") >= coverage * F.col("windows"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = 8, literals: int = 4,
    least_words: int = 5, coverage: float = 0.5,
) -> DataFrame:
    """(doc_id, item_id, matched, windows, changed): one row for each item a document holds.

    ``windows`` counts the item's windows with ``literals`` words or more outside slots,
    ``matched`` those met on the best diagonal (at least the share ``coverage``), and
    ``changed`` the slots of the met windows that hold other values. Where no single diagonal
    holds enough, the three are those of the best place: neighbouring diagonals together,
    words numbered as they are or with runs collapsed. An item shorter than
    the window is one window; items under ``least_words`` words have no template and are
    met only as they stand, by their whole word sequence.
    Words are runs of letters and digits. Null and empty texts hold nothing, null item
    texts are no items; repeated rows are judged alike and reported once; a null id is
    reported as null. Other columns are not read. Texts are read whole.
    """
    spark = docs.sparkSession
    source = docs.select(
        column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    items = benchmark.select(
        column(item_col).cast("long").alias("item_id"),
        column(item_text_col).cast("string").alias("text"),
    ).where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    wanted = stage(benchmark_windows(items, window, least_words, literals), "benchmark-windows")
    sizes = [tuple(r) for r in wanted.select("form", "length").distinct().collect()] or [(0, window)]
    rows = wanted.count()
    probe = wanted.select("probe").distinct()
    if rows <= BROADCAST_ROWS:
        wanted, probe = F.broadcast(wanted), F.broadcast(probe)

    texts = source.withColumn("words", F.expr(WORDS))
    met = stage(
        _probes(texts, sizes).join(probe, "probe", "left_semi").select("doc_id").distinct(), "met-documents")
    again = source.join(
        met.withColumnRenamed("doc_id", "m"), F.expr("doc_id <=> m"), "left_semi")
    held = stage(
        with_row_ids(again.distinct()).select("rid", "doc_id", F.expr(WORDS).alias("words")),
        "met-words")
    hits = stage(_windows(held, sizes, "rid").withColumnRenamed("pos", "at").join(
        wanted.drop("probe"), ["form", "length", "hash"]
    ).withColumn("system", F.expr("if(form < 2, 0, form)")), "window-hits")
    diagonals = hits.where("system = 0").groupBy("rid", "item_id", F.expr("at - pos").alias("shift")).agg(
        F.collect_set("pos").alias("places"), F.max("length").alias("length"))
    totals = stage(wanted.groupBy("item_id", F.expr("if(form < 2, 0, form)").alias("system")).agg(
        F.countDistinct("pos").alias("windows")), "item-windows")
    enough = diagonals.join(totals.where("system = 0").drop("system"), "item_id").where(
        F.size("places") >= coverage * F.col("windows"))
    item_words = items.select("item_id", F.expr(WORDS).alias("theirs"))
    aligned = enough.join(item_words, "item_id").join(held, "rid").select(
        "doc_id", "item_id", "windows", F.size("places").cast("long").alias("matched"),
        F.expr(
            "transform(array_distinct(flatten(transform(places, "
            "p -> sequence(p, p + length - 1)))), "
            "p -> struct(lower(theirs[p]) as a, lower(words[p + shift]) as b))").alias("pairs"))
    # Equal template words are equal but in slots, so only slots can pair different values.
    judged = aligned.withColumn("distinct_pairs", F.array_distinct("pairs")).where(
        "size(distinct_pairs) = size(array_distinct(transform(distinct_pairs, x -> x.a)))"
    ).withColumn("changed", F.expr("cast(size(filter(pairs, x -> x.a <> x.b)) as long)"))
    best = F.max_by(F.struct("matched", "windows", "changed"), F.struct("matched", -F.col("changed")))
    found = stage(judged.groupBy("doc_id", "item_id").agg(best.alias("x")).select(
        "doc_id", "item_id", "x.matched", "x.windows", "x.changed"), "found")
    names = held.select("rid", "doc_id")
    best = F.max_by(F.struct("matched", "windows", "changed"), F.struct(
        F.col("matched") / F.col("windows"), "matched", -F.col("changed")))
    more = _by_place(hits, items, held, coverage, totals).join(names, "rid").groupBy(
        "doc_id", "item_id").agg(best.alias("x")).select(
        "doc_id", "item_id", "x.matched", "x.windows", "x.changed")
    known = found.select(F.col("doc_id").alias("d"), F.col("item_id").alias("i"))
    return found.union(more.join(known, F.expr("doc_id <=> d and item_id = i"), "left_anti"))
