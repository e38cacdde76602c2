"""Benchmark decontamination by template windows, with DataFrame functions only.

Texts become templates: numbers, numbers with a unit, units after a number and names (capitalised words that
do not begin a sentence) turn into typed placeholders, letters are lower-cased, punctuation goes and any white space is one
blank. A window is 13 words of an item (all of a shorter item). A document holds a window if its template words are equal
and the words that the placeholders stand for are consistent: along the run of equal template words that the window lies in, a
value of the item always stands against the same value of the document. So a question asked again with other
numbers or names is found, and a chance meeting of templates is not. Windows that are equal word for word count always,
whatever their template, and they alone where a window has fewer than `literal` words of 13 besides placeholders or
belongs to an item of fewer than `shortest` words.

Every window is registered under the hash of one of its grams: four literal words in a row (two or one where
there are none), the one that the fewest windows of the benchmark hold. Documents look up their grams; an equal one
aligns a document with an item, and only aligned documents are made templates and compared, alignment by alignment. A window that
several items hold (in template and pattern of values) is registered for the smallest item id alone, so that documents
and items that share a passage don't multiply; a document is reported under that item.

Registered grams are broadcast up to `chunk` of them and `chunk_bytes` of benchmark text (about 40 bytes a gram); beyond that, grams
of documents and benchmark are joined by a shuffle of their hashes.

Defined cases: null or empty texts, on either side, match nothing. Rows that repeat a document id are looked at
one by one and reported under that id; null ids are reported as null. Items equal in text are reported under the smallest id,
null last. An item of one word is found wherever the word stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, column, materialize, require

NUMBER, UNIT, NUMBER_UNIT, NAME = "", "", "", ""
# Units of measure, longest alternatives first where one begins another.
UNITS = (
    "percent|kilometers?|kilometres?|centimeters?|centimetres?|millimeters?|millimetres?|meters?|metres?|miles?|inches|inch|feet|foot|yards?|"
    "kilograms?|milligrams?|grams?|pounds?|ounces?|tons?|tonnes?|liters?|litres?|milliliters?|gallons?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|"
    "dollars?|euros?|cents?|usd|eur|gbp|degrees?|watts?|volts?|kwh|kmh|mph|km|cm|mm|kg|mg|lbs?|oz|ml|hz|khz|mhz|ghz|kb|mb|gb|tb|ms|min|hrs?|m|g|l|s|h"
)
_LOOSE = r"[^\s\p{L}\p{N}]*"
#: White space of any kind.
_SPACE = r"[\s\p{Z}]+"
SIZES = (4, 2, 1)


def _fits(col: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(col, F.lit(pattern), F.lit(to))


def template(text: Column) -> Column:
    """Template words of a text. Every step works inside words, so that they stay in line with raw_words()."""
    t = _fits(F.coalesce(text.cast("string"), F.lit("")), rf"[{NUMBER}-{NAME}]+", "")
    t = _fits(t, _SPACE, " ")
    t = _fits(t, r"(?<=[\p{Ll}\p{N},;:)] )\p{Lu}[\p{L}\p{M}'’-]*(?![\p{N}])", NAME)
    t = F.when(
        t.rlike("[0-9]"),
        _fits(
            _fits(
                _fits(t, rf"(?i)(?<!\S){_LOOSE}[0-9][^\s\p{{L}}]*(?:{UNITS})(?=[^\s\p{{L}}\p{{N}}]*(?:\s|$))", NUMBER_UNIT),
                r"(?<!\S)[^\s\p{L}" + NUMBER_UNIT + r"]*[0-9][^\s\p{L}]*(?!\S)",
                NUMBER,
            ),
            rf"(?i)(?<={NUMBER} )(?:{UNITS})(?=[^\s\p{{L}}\p{{N}}]*(?:\s|$))",
            UNIT,
        ),
    ).otherwise(t)
    return _words(_fits(F.lower(t), rf"[^\p{{L}}\p{{M}}\p{{N}}{NUMBER}-{NAME}\s]+", ""))


def raw_words(text: Column) -> Column:
    return _words(_fits(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{M}\p{N}\s\p{Z}]+", ""))


def _words(t: Column) -> Column:
    return F.array_remove(F.split(t, _SPACE), "")


def _is_slot(w: Column) -> Column:
    return (w >= NUMBER) & (w <= NAME) & (F.char_length(w) == 1)


def _gram(words: str, at: Column, size: int) -> Column:
    """Hash of `size` words from place `at` (from 1). Fewer words at the end of a text meet no registered gram."""
    return F.xxhash64(F.lit(size), *[F.get(words, at - 1 + k) for k in range(size)])


def _let(value: Column, body) -> Column:
    """body(value), which is worked out once however often and deep body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def benchmark_items(benchmark: DataFrame, item_col: str, text_col: str, width: int, literal: int, shortest: int) -> DataFrame:
    """(i, key, t, raw, n, w, marks, rich) of every distinct text: i its hash, key its smallest item id (LAST_ID for none), w the width of its
    windows; marks has a 1 for every literal word, rich for every start of a window that is looked for by its template."""
    require(benchmark, item_col, text_col)
    b = benchmark.select(F.coalesce(column(benchmark, item_col).cast("long"), F.lit(LAST_ID)).alias("key"), column(benchmark, text_col).cast("string").alias("text"))
    b = b.groupBy("text").agg(F.min("key").alias("key"))
    b = b.select(F.xxhash64("text").alias("i"), "key", template(F.col("text")).alias("t"), raw_words(F.col("text")).alias("raw")).withColumn("n", F.size("raw")).where("n > 0")
    b = b.withColumn("w", F.least("n", F.lit(width))).withColumn("in_line", F.size("t") == F.col("n")).withColumn("t", F.when(F.col("in_line"), F.col("t")).otherwise(F.col("raw")))
    b = b.withColumn("marks", F.array_join(F.transform("t", lambda w: F.when(_is_slot(w), "0").otherwise("1")), ""))
    literals = lambda o: F.char_length(F.replace(F.substr("marks", o, F.col("w")), F.lit("0"), F.lit("")))
    rich = F.transform(F.sequence(F.lit(1), F.col("n") - F.col("w") + 1), lambda o: F.when((F.col("n") >= shortest) & (literals(o) * width >= F.col("w") * literal), "1").otherwise("0"))
    return b.select("i", "key", "t", "raw", "n", "w", "marks", F.array_join(rich, "").alias("rich"))


def registered(items: DataFrame, width: int) -> DataFrame:
    """(h, size, i, place): for every window that is an item's own, one gram of it and where it stands in the item."""
    x = items.select("i", "key", "t", "raw", "n", "w", "marks", "rich", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("p"))
    own = F.slice("t", F.col("p"), F.col("w"))
    values = F.slice("raw", F.col("p"), F.col("w"))
    # the pattern of a window: which of its places hold equal values
    pattern = F.transform(values, lambda v, k: F.when(_is_slot(F.get(own, k)), F.array_position(values, v)).otherwise(F.lit(0)))
    is_rich = F.substr("rich", F.col("p"), F.lit(1)) == "1"
    window = F.when(F.col("p") + F.col("w") - 1 <= F.col("n"), F.when(is_rich, F.xxhash64(F.lit(1), own, pattern)).otherwise(F.xxhash64(F.lit(0), values)))
    x = x.select("i", "key", "p", is_rich.alias("is_rich"), window.alias("window"), *[F.when(F.col("p") + s - 1 <= F.col("n"), _gram("raw", F.col("p"), s)).alias(f"h{s}") for s in SIZES],
                 *[(F.substr("marks", F.col("p"), F.lit(s)) == "1" * s).alias(f"l{s}") for s in SIZES])
    for s in SIZES:  # the grams that may stand for the window that begins here: the rarest in the benchmark
        x = x.withColumn(f"spread{s}", F.count("*").over(Window.partitionBy(F.coalesce(f"h{s}", F.xxhash64("i", "p")))))
    for s in SIZES:
        inside = Window.partitionBy("i").orderBy("p").rowsBetween(0, width - s)
        gram = F.when(F.col(f"h{s}").isNotNull(), F.struct(F.col(f"spread{s}").alias("spread"), F.col(f"h{s}").alias("h"), F.lit(s).alias("size"), F.col("p").alias("place")))
        x = x.withColumn(f"any{s}", F.min(gram).over(inside)).withColumn(f"literal{s}", F.min(F.when(F.col(f"l{s}"), gram)).over(inside))
    chosen = F.when(F.col("is_rich"), F.coalesce(*[F.col(f"literal{s}") for s in SIZES])).otherwise(F.coalesce(*[F.col(f"any{s}") for s in SIZES]))
    x = x.where(F.col("window").isNotNull()).withColumn("first", F.min(F.struct("key", "i")).over(Window.partitionBy("window")))
    return x.where((F.col("first.key") == F.col("key")) & (F.col("first.i") == F.col("i"))).select(chosen.alias("g"), "i").select("g.h", "g.size", "i", "g.place").distinct()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    return F.coalesce(column(docs, id_col).cast("long"), F.lit(LAST_ID)), F.xxhash64(text), text


def _aligned(rows: DataFrame, grams: DataFrame, chunk: int, chunk_bytes: int, size_of: tuple[int, int]) -> DataFrame:
    """(d, r, text, at): documents that hold registered grams, with the items and shifts that these align them with."""
    sizes = sorted((x[0] for x in grams.select("size").distinct().collect()), reverse=True)  # at most three
    small = size_of[0] <= chunk and size_of[1] <= chunk_bytes
    # explode keeps an optimizer from working out its input again for every use; it is compiled together with the join, so that
    # the words are handed on by reference and texts are copied for matches only
    at = rows.select("d", "r", *(["text"] if small else []), F.explode(F.array(raw_words(F.col("text")))).alias("raw")).where(F.size("raw") > 0)
    at = at.select("*", F.explode(F.sequence(F.lit(1), F.size("raw"))).alias("pos"))
    hashes = [_gram("raw", F.col("pos"), s) for s in sizes or SIZES[:1]]
    at = at.withColumn("h", hashes[0] if len(hashes) == 1 else F.explode(F.array(*hashes)))
    shift = F.struct("i", (F.col("pos") - F.col("place")).alias("shift"))
    if small:  # bounded: at most `chunk` rows
        hit = at.join(F.broadcast(grams.select("h", "i", "place")), "h")
        return hit.groupBy("d", "r").agg(F.first("text").alias("text"), F.collect_set(shift).alias("at"))
    hit = at.select("d", "r", "pos", "h").join(grams.select("h", "i", "place"), "h").groupBy("d", "r").agg(F.collect_set(shift).alias("at"))
    return rows.dropDuplicates(["d", "r"]).join(hit, ["d", "r"])


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    width: int = 13, literal: int = 8, shortest: int = 8, chunk: int = 2_000_000, chunk_bytes: int = 256 << 20,
) -> DataFrame:
    """(d, r, doc_id, item_id, n_windows, n_slots) for every document that holds windows of an item; d is the id
    (LAST_ID for null) and r a hash of the text, which together name a row of docs."""
    require(docs, id_col, text_col)
    items = materialize(benchmark_items(benchmark, item_col, item_text, width, literal, shortest), "decontam-items")
    grams = materialize(registered(items, width), "decontam-grams")
    size_of = grams.count(), items.agg(F.coalesce(F.sum(F.expr("aggregate(raw, 0L, (s, x) -> s + octet_length(x) + 16)")), F.lit(0))).first()[0]
    d, r, text = _keyed(docs, id_col, text_col)
    found = _aligned(docs.select(d.alias("d"), r.alias("r"), text.alias("text")), grams, chunk, chunk_bytes, size_of)
    # written once: the templates are worked out once for all alignments
    found = materialize(found.select("d", "r", template(F.col("text")).alias("dt"), raw_words(F.col("text")).alias("dr"), "at"), "decontam-aligned")
    found = found.select("d", "r", "dt", "dr", F.explode("at").alias("at")).select("d", "r", "dt", "dr", "at.i", "at.shift").join(items, "i")
    # words of the item that stand against equal words of the document, as a text of 1 and 0; a window is w ones
    place, starts = F.sequence(F.lit(0), F.col("n") - 1), F.sequence(F.lit(1), F.col("n") - F.col("w") + 1)
    same = lambda mine, theirs: F.array_join(F.transform(place, lambda k: F.when(F.get(mine, k) == F.get(theirs, k + F.col("shift")), "1").otherwise("0")), "")
    windows = lambda s: _let(s, lambda s: _let(F.repeat(F.lit("1"), F.col("w")), lambda ones: F.filter(starts, lambda o: F.substr(s, o, F.col("w")) == ones)))
    found = found.withColumn("same", F.when(F.size("dt") == F.size("dr"), same("t", "dt")).otherwise(F.repeat(F.lit("0"), F.col("n")))).withColumn("equal", windows(same("raw", "dr")))
    found = found.withColumn("by_template", F.filter(windows(F.col("same")), lambda o: F.substr("rich", o, F.lit(1)) == "1"))
    found = materialize(found.where((F.size("equal") > 0) | (F.size("by_template") > 0)).drop("dt", "t", "raw"), "decontam-windows")
    found = found.join(items.select("i", "t", "raw"), "i")
    # a run of equal template words is named by the number of unequal ones before it; its values have to agree
    run = lambda o: F.char_length(F.replace(F.substr("same", F.lit(1), o), F.lit("1"), F.lit("")))
    slots = F.filter(place, lambda k: (F.substr("marks", k + 1, F.lit(1)) == "0") & (F.substr("same", k + 1, F.lit(1)) == "1"))
    pairs = F.array_distinct(F.transform(slots, lambda k: F.struct(run(k + 1).alias("run"), F.get("t", k).alias("kind"), F.get("raw", k).alias("mine"), F.get("dr", k + F.col("shift")).alias("theirs"))))
    runs = F.array_distinct(F.transform("by_template", run))
    agree = lambda x: F.size(x) == F.size(F.array_distinct(F.transform(x, lambda p: F.struct(p["kind"], p["mine"]))))
    steady = _let(pairs, lambda x: F.filter(F.transform(runs, lambda z: F.struct(z.alias("run"), F.filter(x, lambda p: p["run"] == z).alias("pairs"))), lambda y: agree(y["pairs"])))
    found = found.withColumn("steady", steady)
    found = found.withColumn("kept", _let(F.col("steady.run"), lambda good: F.filter("by_template", lambda o: F.array_contains(good, run(o)))))
    found = found.withColumn("n_slots", F.aggregate("steady", F.lit(0), lambda n, y: n + F.size(y["pairs"])))
    found = materialize(found.select("d", "r", "key", "dr", "shift", "w", "by_template", "kept", "equal", "n_slots"), "decontam-kept")
    kept = found.select("d", "r", "key", F.size(F.array_union("kept", "equal")).alias("windows"), "n_slots")
    # a window that is registered for another item is only lost where values beside it disagree there: such windows are looked up as they are
    lost = F.array_except("by_template", F.array_union("kept", "equal"))
    lost = found.where(F.size(lost) > 0).select("d", "r", F.explode(F.transform(lost, lambda o: F.xxhash64(F.slice("dr", o + F.col("shift"), F.col("w"))))).alias("v"))
    raw = items.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - F.col("w") + 1), lambda o: F.xxhash64(F.slice("raw", o, F.col("w"))))).alias("v")).groupBy("v").agg(F.min("key").alias("key"))
    kept = kept.unionByName(lost.distinct().join(raw, "v").groupBy("d", "r", "key").agg(F.count("*").cast("int").alias("windows"), F.lit(0).alias("n_slots")))
    out = kept.where("windows > 0").groupBy("d", "r", "key").agg(F.sum("windows").alias("n_windows"), F.max("n_slots").cast("long").alias("n_slots"))
    no = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return out.select("d", "r", no("d").alias("doc_id"), no("key").alias("item_id"), "n_windows", "n_slots")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """docs without the rows that leak an item; columns as they were. Up to broadcast_rows leaking rows are broadcast (16 bytes
    each), so that texts are not shuffled; more are joined by a shuffle."""
    found = leaks(docs, benchmark, id_col, text_col, **options).select(F.col("d").alias("_leak_d"), F.col("r").alias("_leak_r")).distinct()
    found = materialize(found, "decontam-found")
    if found.count() <= broadcast_rows:
        found = F.broadcast(found)
    d, r, _ = _keyed(docs, id_col, text_col)
    return docs.join(found, (d == found["_leak_d"]) & (r == found["_leak_r"]), "left_anti")
