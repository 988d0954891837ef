"""Benchmark decontamination on canonical templates.

Texts become sequences of tokens in which numbers, names and units are typed
placeholders, so that a question asked again with other values has the same
template.  Windows of ``WINDOW`` template tokens of the benchmark are joined
by hash with those of the documents, and the tokens of each hit are compared.
A window with the item's own values is a copy and counts.  In the others the
values that fill the slots must map one to one between item and document over
all windows of one alignment.

Only DataFrame functions are used.  A window is looked up in a Bloom filter of
the benchmark before anything is exploded, so only documents with a likely hit
leave the scan.  The filter is there whatever the size of the benchmark; beyond
FILTER_BITS it passes more, never less.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bits import HashFilter, literal_words
from .columns import shielded
from .storage import materialise, table

#: Template tokens in a window.
WINDOW = 8
#: Fewest tokens of a window (and of an item) that are no placeholders.
MIN_LITERALS = 5
#: Windows of an item that must match, or all if it has fewer: six windows are a run of 13 words.
MIN_WINDOWS = 6
#: Benchmark windows up to which their table (about 0.5 kB a row) is broadcast.
BROADCAST_WINDOWS = 200_000
#: Bits of a filter at most (1 MiB, a constant of the plan).
FILTER_BITS = 1 << 23
#: Ids of leaking documents up to which they are broadcast (8 bytes each).
BROADCAST_IDS = 500_000

NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
_UNITS = "kg|mg|g|lbs?|oz|km|cm|mm|m|miles?|feet|ft|inch(?:es)?|hours?|hrs?|minutes?|min|seconds?|sec|s|days?|weeks?|months?|years?|dollars?|cents?|euros?|usd|eur|percent|liters?|litres?|ml|l|meters?|metres?|mph|kmh|degrees?"
#: Capitalised words that are no names.
_NO_NAMES = (
    "The|An|In|On|At|If|It|Is|Are|Was|Were|As|By|Do|Does|Did|He|She|We|You|They|His|Her|Their|Its|My|Our|Your|This|That|These|Those|There|Here|"
    "What|When|Where|Which|Who|Whom|Whose|Why|How|Each|Every|All|Some|Many|Most|Few|Both|Any|No|Not|Now|Only|Other|Such|Than|"
    "For|From|To|Of|With|Without|And|But|Or|Nor|So|Then|Thus|After|Before|During|While|Since|Until|Because|Although|Though|However|Therefore|"
    "Can|Could|Will|Would|Shall|Should|May|Might|Must|Has|Have|Had|Be|Been|Let|Find|Given|Suppose|Calculate|Compute|Determine|Solve|Show|Write|Choose|Assume|"
    "One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten|First|Second|Next|Last"
)
#: Letters of scripts without spaces, each a token of its own.
_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
_IS_NAME, _IS_UNIT = "\u0001", "\u0002"


def _raw_tokens(text: Column) -> Column:
    """Lower-case words and numbers in order; words used as names or units carry a mark in front.

    A name is a capitalised word at the start of the text, a line, a sentence or
    a quotation, or after a lower-case letter, digit or comma and a space, but
    for _NO_NAMES; a unit stands after a number.
    """
    text = F.coalesce(text, F.lit(""))
    # the capital, which is rare, is looked for first
    named = F.regexp_replace(text, rf"""(?=\p{{Lu}}\p{{Ll}})(?<=[\p{{Ll}}0-9,;:] |[.!?]\s|^|[\n"“«(])(?!(?:{_NO_NAMES})\b)""", _IS_NAME)
    marked = F.when(named.rlike("[0-9]"), F.regexp_replace(named, rf"(?i)(?<=[0-9] ?)(?=(?:{_UNITS})\b)", _IS_UNIT)).otherwise(named)
    # words of plain letters, the most, are told by a small class
    word = rf"[{_IS_NAME}{_IS_UNIT}]?(?:[a-z]+(?![\p{{L}}\p{{M}}&&[^{_ALONE}]])|[{_ALONE}]|[\p{{L}}\p{{M}}&&[^{_ALONE}]]+)"
    return F.regexp_extract_all(F.lower(marked), F.lit(rf"{word}|[0-9]+(?:[.,:/][0-9]+)*"), F.lit(0))


def _template(token: Column) -> Column:
    """A token or its placeholder, told by its first character."""
    first = F.ascii(token)
    return F.when(first > 57, token).when(first == ord(_IS_NAME), NAME).when(first == ord(_IS_UNIT), UNIT).when(first >= 48, NUMBER).otherwise(token)


def _value(token: Column) -> Column:
    return F.ltrim(token, F.lit(_IS_NAME + _IS_UNIT))


def _with_templates(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_raw`` (array of tokens) and ``_th`` (hashes of their templates)."""
    df = df.withColumn("_raw", _raw_tokens(F.col(f"`{text}`")))
    return df.withColumn("_th", F.transform("_raw", lambda t: F.xxhash64(_template(t))))


def _window_hashes(length: int) -> Column:
    """Hash of the templates of the tokens of every window of ``length`` tokens, by its start (from 0).

    Elements are read one by one, as slice() copies its whole array each time.
    """

    def at(i: Column) -> Column:
        return F.xxhash64(*[F.get("_th", i + k) for k in range(length)])

    # the column is named twice, so that its computation is not copied into the lambda
    return F.when(F.size("_th") >= length, F.transform(F.sequence(F.lit(0), F.size("_th") - length), at)).otherwise(F.array().cast("array<bigint>"))


def _value_hash(i: Column, length: int) -> Column:
    """Hash of the values of the tokens of the window of ``length`` tokens at ``i``."""
    return F.xxhash64(*[_value(F.get("_raw", i + k)) for k in range(length)])


def _windows(items: DataFrame) -> DataFrame:
    """One row per window of each item: ``item_id, n_windows, n_literal, at, length, exact, h, v, b_raw, b_tpl``.

    Items of fewer than WINDOW tokens have one window of all their tokens.
    ``h`` is of the template.  Windows of fewer than MIN_LITERALS plain words are
    ``exact``: they match only the same values, whose hash is ``v``.
    """
    tokens = materialise(_with_templates(items, "text").withColumn("length", F.least(F.size("_th"), F.lit(WINDOW))).filter(F.col("length") >= 1))
    parts = [
        tokens.filter(F.col("length") == n)
        .select("item_id", "length", "_raw", F.posexplode(_window_hashes(n)).alias("at", "h"))
        .withColumn("v", _value_hash(F.col("at"), n))
        for n in range(1, WINDOW + 1)
    ]
    windows = functools.reduce(DataFrame.unionByName, parts).select("item_id", "at", "length", "h", "v", F.slice("_raw", F.col("at") + 1, F.col("length")).alias("b_raw")).withColumn("b_tpl", F.transform("b_raw", _template))
    literals = F.size(F.filter("b_tpl", lambda t: ~t.isin(NUMBER, NAME, UNIT)))
    kept = windows.withColumn("exact", literals < MIN_LITERALS)
    of_item = Window.partitionBy("item_id")
    return kept.withColumns({"n_windows": F.count("*").over(of_item).cast("int"), "n_literal": F.sum((~F.col("exact")).cast("int")).over(of_item).cast("int")})


def find_leaks(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per document and benchmark item that it holds.

    ``doc_id, item_id, matched_windows, item_windows, coverage, n_slots``: the
    item's windows found as copies or in a consistent alignment, of how many,
    their share, and how many different slot values they bind.  A document holds
    an item if it matches MIN_WINDOWS windows (all, if the item has fewer), of
    all or of those with MIN_LITERALS plain words.  The other windows, and items
    of fewer tokens, match the same values only.  Null
    and empty texts hold nothing; null ids take no part; repeated items are
    found each under its id, and repeated document rows count once.  Of an id
    that comes with several texts each is judged alone, and the one that matches
    most is returned.  Whole texts are read, however long; an empty table has no
    rows.  Other columns are not returned, whatever their names.
    """
    items = benchmark.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    windows = materialise(_windows(items))
    kinds = {r["exact"]: r["n"] for r in windows.groupBy("exact").agg(F.count("*").alias("n")).collect()}  # two rows
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most WINDOW rows
    small = sum(kinds.values()) <= broadcast_windows
    if not kinds:
        nothing = docs.select("doc_id", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id")).limit(0)
        return nothing.withColumns({"matched_windows": F.lit(0).cast("bigint"), "item_windows": F.lit(0).cast("bigint"), "coverage": F.lit(0.0), "n_slots": F.lit(0).cast("bigint")})

    def filter_of(keys: DataFrame, key: str, n: int) -> tuple[HashFilter, Column]:
        shape = HashFilter.sized(n, most_bits=filter_bits)
        return shape, literal_words(shape.word_rows(keys, key).collect(), shape.words)

    # every window meets the first filter; what passes it, and only that, meets the other two
    any_template = filter_of(windows, "h", sum(kinds.values()))
    templates = filter_of(windows.filter("NOT exact"), "h", kinds[False]) if False in kinds else None
    values = filter_of(windows.filter("exact"), "v", kinds[True]) if True in kinds else None

    def passed(length: int) -> Column:
        def kept(h: Column, i: Column) -> Column:
            return F.when(any_template[0].might_contain(any_template[1], h), F.struct(i.alias("d_at"), h.alias("h")))

        return F.filter(F.transform(f"_w{length}", kept), lambda c: c.isNotNull())

    def candidates(length: int, exact: bool) -> Column:
        shape, words = values if exact else templates

        def kept(c: Column) -> Column:
            key = _value_hash(c["d_at"], length) if exact else c["h"]
            return F.when(shape.might_contain(words, key), F.struct(c["d_at"].alias("d_at"), F.lit(length).alias("length"), F.lit(exact).alias("exact"), key.alias("h")))

        return F.filter(F.transform(f"_p{length}", kept), lambda c: c.isNotNull())

    # _row tells the texts of one id apart
    texts = docs.select("doc_id", F.xxhash64("text").alias("_row"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    found = _with_templates(texts, "text")
    # A filter on an array, which explode() also infers, would be pushed below the projections above and repeat
    # them inside the lambda for every window; explode_outer() and a filter on its rows avoid that.
    # The rows carry only the slices that the comparison needs.
    found = found.withColumns({f"_w{n}": _window_hashes(n) for n in lengths})
    found = found.withColumns({f"_p{n}": passed(n) for n in lengths})
    found = found.withColumn("_c", F.concat(*[candidates(n, exact) for n in lengths for exact in sorted(kinds)]))
    window = F.transform("_c", lambda c: F.struct(c["d_at"].alias("d_at"), c["length"].alias("length"), c["exact"].alias("exact"), c["h"].alias("h"), F.slice("_raw", c["d_at"] + 1, c["length"]).alias("d_raw")))
    found = found.select("doc_id", "_row", F.explode_outer(window).alias("c")).filter("c IS NOT NULL").select("doc_id", "_row", "c.*").withColumn("d_tpl", F.transform("d_raw", _template))
    keyed = windows.withColumn("h", F.when(F.col("exact"), F.col("v")).otherwise(F.col("h")))
    hits = found.join(F.broadcast(keyed) if small else keyed, ["h", "length", "exact"]).filter(F.when(F.col("exact"), F.transform("d_raw", _value) == F.transform("b_raw", _value)).otherwise(F.col("d_tpl") == F.col("b_tpl")))

    slots = F.filter(
        F.transform(F.arrays_zip("b_tpl", "b_raw", "d_raw"), lambda z: F.struct(z["b_tpl"].alias("kind"), _value(z["b_raw"]).alias("b"), _value(z["d_raw"]).alias("d"))),
        lambda s: s["kind"].isin(NUMBER, NAME, UNIT),
    )
    hits = hits.select("doc_id", "_row", "item_id", "n_windows", "n_literal", (F.col("d_at") - F.col("at")).alias("offset"), F.struct("at", "exact", slots.alias("slots")).alias("w"))
    # an alignment of a text has at most as many different windows as its item, which bounds every group below
    aligned = hits.groupBy("doc_id", "_row", "item_id", "offset").agg(F.max("n_windows").alias("n_windows"), F.max("n_literal").alias("n_literal"), F.collect_set("w").alias("ws"))

    def bound(ws: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(ws, lambda w: w["slots"])))

    aligned = aligned.withColumns({"slots": bound(F.filter("ws", lambda w: ~w["exact"])), "n_slots": F.size(bound(F.col("ws")))})
    n_pairs = F.size("slots")

    def distinct(side: str) -> Column:
        return F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s[side]))))

    # a window that holds the item's own values is a copy, whatever becomes of the others
    copied = F.forall("w.slots", lambda s: s["b"] == s["d"])
    aligned = aligned.withColumn("consistent", (distinct("b") == n_pairs) & (distinct("d") == n_pairs)).select("doc_id", "_row", "item_id", "n_windows", "n_literal", "n_slots", "consistent", F.explode("ws").alias("w"))
    found = aligned.filter(F.col("consistent") | F.col("w.exact") | copied)
    literal = F.count_distinct(F.when(~F.col("w.exact"), F.col("w.at")))
    found = (
        found.groupBy("doc_id", "_row", "item_id")
        .agg(F.count_distinct("w.at").alias("matched_windows"), literal.alias("_literal"), F.max("n_windows").cast("bigint").alias("item_windows"), F.max("n_literal").alias("n_literal"), F.max("n_slots").cast("bigint").alias("n_slots"))
        .filter((F.col("matched_windows") >= F.least(F.lit(MIN_WINDOWS), F.col("item_windows"))) | ((F.col("n_literal") > 0) & (F.col("_literal") >= F.least(F.lit(MIN_WINDOWS), F.col("n_literal")))))
    )
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched_windows", "item_windows", "n_slots")).alias("b")).select("doc_id", "item_id", "b.*")
    return best.select("doc_id", "item_id", "matched_windows", "item_windows", (F.col("matched_windows") / F.col("item_windows")).alias("coverage"), "n_slots")


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows with a null id stay, and columns of any name."""
    leaking = materialise(find_leaks(docs, benchmark).select("doc_id").distinct())
    small = leaking.count() <= BROADCAST_IDS
    return shielded(docs, ["doc_id"], lambda d: d.join(F.broadcast(leaking) if small else leaking, "doc_id", "left_anti").select(d.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
