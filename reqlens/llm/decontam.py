"""Benchmark decontamination by template windows.

Texts are canonicalised: numbers, units behind a number and names become typed placeholders, other words
are kept in small letters. A name is a run of capitalised words, wherever it stands, without function words;
it is one placeholder. Windows of words are hashed and joined with the windows of the benchmark. A
match of windows with placeholders must also use its slots alike: where the benchmark repeats a value the
document repeats one, and where it has two values the document has two. Only windows that begin with the first two words of some window of the benchmark are
hashed: a table of bytes made from the items tells which, and it may be wrong in one direction only, so no match is lost.
So questions whose numbers or
names were exchanged are caught, and texts of the same outline only are not. A window with more than
``MOST_PLACEHOLDERS`` of placeholders (a name or unit that comes again in it not counted) says too little as a template: it is matched by its own words and values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from reqlens.llm.common import Scratch

WINDOW = 10  # words; a shorter item is one window
MOST_PLACEHOLDERS = 0.4  # share of a window's words
BROADCAST_ROWS = 1_000_000  # rows of small tables (at most about 64 MB) that are broadcast; larger ones are shuffled
START_BYTES = (1 << 16, 1 << 24)  # least and most bytes of the table of first words
# Canonical texts hold no digits but these, which stand for a number, a unit and a name.
NUMBER, UNIT, NAME = "0", "1", "2"
# Words taken for units behind a number.
UNITS = ("mm cm m km in ft yd mi miles mile meters metres meter metre g kg mg lb lbs oz pounds grams s sec seconds min minutes "
         "h hours hour days day weeks week months month years year l ml liters litres usd eur dollars dollar euros euro cents "
         "percent degrees mph kmh").split()
_WORD = r"\p{L}[\p{L}\p{M}]*+"
_NUMBER = r"[0-9]++(?:[.,][0-9]++)*+"
_UNIT = rf"{NUMBER}(\s+)(?i:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{M}}])"
# Words that are no names when capitalised.
FUNCTION_WORDS = ("a an the this that these those it its he she they we you his her their our your my in on at by for from of to with without "
                  "into onto over under after before behind between during through until since about against among and or but nor so yet if "
                  "then than as when while where who whom whose which what why how there here is are was were be been has have had do does did "
                  "can could should would shall must might not no all any both each every either neither some most many much few several "
                  "one two three four five six seven eight nine ten first second also only just now once because although though").split()
_ONE_NAME = rf"(?!(?:{'|'.join(w.capitalize() for w in FUNCTION_WORDS)})(?![\p{{L}}\p{{M}}]))\p{{Lu}}\p{{Ll}}[\p{{L}}\p{{M}}]*+"
# Capitalised words that follow each other; all capitals and single letters are no names.
_NAME = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}]){_ONE_NAME}(?:[ \t'’-]{{1,3}}{_ONE_NAME})*+"
# The words of the form with names, as they stand in the text: a name is one of them.
_NAMED = rf"(?<=[0-9]\s{{0,40}})(?i:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{M}}])|{_NAME}|{_WORD}|{_NUMBER}"


def with_words(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, raw_text, raw, named, plain, typed``: the words of each text. ``raw`` (as they are) is aligned with ``plain``
    (numbers and units as placeholders), ``named`` (as they are, a name in one) with ``typed`` (names as placeholders
    too; null where the text has no name)."""
    numbered = F.when(F.col(text).rlike("[0-9]"), F.regexp_replace(F.regexp_replace(text, _NUMBER, f" {NUMBER} "), _UNIT, f"{NUMBER}$1{UNIT} "))
    canonical = rows.select(key, F.col(text).alias("raw_text"), F.coalesce(numbered, text).alias("plain_text"))
    words = lambda column: F.regexp_extract_all(F.lower(column), F.lit(f"{_WORD}|[{NUMBER}{UNIT}{NAME}]"), F.lit(0))
    return canonical.select(
        key, "raw_text", raw_words(F.col("raw_text")).alias("raw"), F.regexp_extract_all("raw_text", F.lit(_NAMED), F.lit(0)).alias("named"),
        words(F.col("plain_text")).alias("plain"),
        F.when(F.col("plain_text").rlike(_NAME), words(F.regexp_replace("plain_text", _NAME, f" {NAME} "))).alias("typed"))


def raw_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{_WORD}|{_NUMBER}"), F.lit(0))


WINDOWS = "array<struct<typed_form:boolean,exact:boolean,size:int,hash:bigint,place:int>>"


def _hashes(words: str, places: Column, size: int, typed_form: bool = False, exact: bool = False) -> Column:
    """Form, size, hash and place of the windows that begin at ``places``; ``words`` names an array of word hashes."""
    return F.transform(places, lambda i: F.struct(F.lit(typed_form).alias("typed_form"), F.lit(exact).alias("exact"), F.lit(size).alias("size"),
                                                  F.xxhash64(F.slice(words, i, F.lit(size))).alias("hash"), i.alias("place")))


def _first_words(words: str, place: Column, size: int) -> Column:
    """A number of the first two words (of the only one) of a window."""
    first = F.get(words, place - 1)
    return F.xxhash64(first, F.get(words, place)) if size > 1 else F.xxhash64(first)


def start_table(windows: DataFrame, count: int) -> bytes:
    """A byte for each number of first words modulo the table's length; 1 where a window of the benchmark begins so.

    ``count`` windows give a table of 16 bytes for each, within ``START_BYTES``, so its size is bounded; a
    crowded table only lets more windows pass.
    """
    size = min(max(1 << (16 * count).bit_length(), START_BYTES[0]), START_BYTES[1])
    table = bytearray(size)
    for row in windows.select(F.pmod("first_words", F.lit(size)).cast("int").alias("slot")).distinct().toLocalIterator():
        table[row["slot"]] = 1
    return bytes(table)


def most_slots(size: int) -> int:
    """Placeholders that a window matched as a template may hold."""
    return int(MOST_PLACEHOLDERS * size)


def dense_places(words: str, size: int) -> Column:
    """Where windows of ``size`` words with too many placeholders begin: those that hold a placeholder and the
    one so many placeholders later."""
    more = most_slots(size)
    last = F.size(words) - size + 1
    slots = F.filter(F.transform(words, lambda w, i: F.when(w.isin(NUMBER, UNIT, NAME), i + 1)), lambda i: i.isNotNull())

    def of_slots(at: Column) -> Column:
        ends = F.filter(F.zip_with(F.slice(at, F.lit(1), F.greatest(F.size(at) - more, F.lit(0))), F.slice(at, F.lit(more + 1), F.size(at)),
                                   lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda e: e["b"] - e["a"] < size)
        begin = lambda e: F.sequence(F.least(F.greatest(e["b"] - size + 1, F.lit(1)), last), F.least(e["a"], last))
        return F.array_distinct(F.flatten(F.transform(ends, begin)))

    return F.transform(F.array(slots), of_slots)[0]


def window_rows(rows: DataFrame, key: str, text: str, sizes: Sequence[int], starts: bytes | None = None) -> DataFrame:
    """``key, typed_form, exact, size, hash, place`` of every window of ``sizes`` words; the typed form only where it holds
    a name. Windows with too many placeholders come a second time, ``exact``, with a hash of their raw words. With a table
    ``starts`` of first words, other windows that are not exact are left out; without one ``first_words`` is added.

    Words are taken from the texts once, whatever the number of sizes.
    """
    coded = lambda column: F.transform(column, lambda w: F.xxhash64(w))
    name = F.xxhash64(F.lit(NAME))
    none = F.array().cast(WINDOWS)
    # Only windows of the plain form: a window that is dense by its names has its words and values compared there.
    many = {f"many_{size}": F.when((F.size("plain") >= size) & F.array_contains("plain", NUMBER), dense_places("plain", size)) for size in sizes}
    words = with_words(rows, key, text).select(key, "raw_text", coded("plain").alias("plain"), coded("typed").alias("typed"),
                                               *[places.alias(column) for column, places in many.items()])
    dense = reduce(lambda a, b: a | b, [F.coalesce(F.size(column) > 0, F.lit(False)) for column in many])
    raw = F.when(dense, F.transform(raw_words(F.col("raw_text")), lambda w: F.xxhash64(F.lit("raw"), F.lower(w))))

    def begins(form: str, size: int) -> Column:
        places = F.when(F.size(form) > 0, F.sequence(F.lit(1), F.size(form)))
        if starts is None:
            return places
        table = F.lit(starts)
        known = lambda i: F.substring(table, F.pmod(_first_words(form, i, size), F.lit(len(starts))).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")
        return F.filter(places, known)

    # The places of single words and of pairs of words serve all sizes.
    kinds = {min(size, 2) for size in sizes}
    begun = words.select("*", raw.alias("raw"), *[begins(form, kind).alias(f"{form}_{kind}") for form in ("plain", "typed") for kind in kinds])
    parts = []
    for size in sizes:
        fits = lambda form: F.filter(f"{form}_{min(size, 2)}", lambda i: i <= F.size(form) - size + 1)
        named = F.filter(fits("typed"), lambda i: F.array_contains(F.slice("typed", i, F.lit(size)), name))
        parts += [F.coalesce(_hashes("plain", fits("plain"), size), none), F.coalesce(_hashes("typed", named, size, typed_form=True), none),
                  F.coalesce(_hashes("raw", F.col(f"many_{size}"), size, exact=True), none)]
    made = begun.select(key, *(["plain", "typed"] if starts is None else []), F.inline(F.concat(*parts)))
    if starts is None:
        pick = lambda size: F.when(F.col("typed_form"), _first_words("typed", F.col("place"), size)).otherwise(_first_words("plain", F.col("place"), size))
        made = made.withColumn("first_words", F.when(F.col("size") > 1, pick(2)).otherwise(pick(1))).drop("plain", "typed")
    return made


def slot_values(form: Column, raw: Column, place: Column, size: Column) -> Column:
    """The values of the window's slots, in small letters."""
    pairs = F.zip_with(F.slice(form, place, size), F.slice(raw, place, size),
                       lambda w, r: F.when(w.isin(NUMBER, UNIT, NAME), F.lower(r)))
    return F.filter(pairs, lambda v: v.isNotNull())


def slot_pattern(values: Column) -> Column:
    """Slots numbered by the first place of their value; null without slots."""
    return F.when(F.size(values) > 0, F.transform(values, lambda v: F.array_position(values, v)))


def free_slots(values: Column) -> Column:
    """Slots without the names and units that repeat one before: these are as settled as words."""
    number = lambda v: v.rlike("^[0-9]")
    return F.size(F.filter(values, number)) + F.size(F.array_distinct(F.filter(values, lambda v: ~number(v))))


def patterns(windows: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Adds ``pattern`` and ``free`` to windows ``key, typed_form, size, place``; the texts are read again for these keys only.

    Places become those of the plain window that ends where the last word or name of the window begins."""
    words = with_words(rows, key, "text").select(F.col(key).alias("words_key"), "raw", "named", "plain", "typed")
    pick = lambda typed, plain: F.when(F.col("typed_form"), F.col(typed)).otherwise(F.col(plain))
    before = F.size(raw_words(F.array_join(F.slice("named", F.lit(1), F.col("place") + F.col("size") - 2), "\n")))
    return (windows.join(words, windows[key].eqNullSafe(words["words_key"]))
            .withColumn("values", slot_values(pick("typed", "plain"), pick("named", "raw"), F.col("place"), F.col("size")))
            .withColumns({"pattern": slot_pattern(F.col("values")), "free": free_slots(F.col("values")),
                          "place": F.when(F.col("typed_form"), before + 2 - F.col("size")).otherwise(F.col("place"))})
            .drop("words_key", "raw", "named", "plain", "typed", "values"))


def _bounded(df: DataFrame) -> DataFrame:
    """A written table, broadcast if its row count allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def matched_windows(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, size, place, item_id``: windows of documents that match a window of an item, slots alike."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "decontam")
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    texts = documents.select("doc_id", "text").filter(F.col("text").isNotNull())
    # At most ``window`` sizes: an item with fewer words is one window of its own size, in each form.
    length = lambda form: F.least(F.when(F.size(form) > 0, F.size(form)), F.when(F.size(form) > 0, window))
    sized = scratch.keep(with_words(items, "item_id", "text").select("item_id", F.col("raw_text").alias("text"), length("plain").alias("plain_size"),
                                                                     length("typed").alias("typed_size")), "items")
    sizes = sorted(r["size"] for r in sized.select(F.explode(F.array("plain_size", "typed_size")).alias("size")).distinct().collect() if r["size"])
    if not sizes:
        return spark.range(0).selectExpr("id AS doc_id", "CAST(0 AS INT) AS size", "CAST(0 AS INT) AS place", "id AS item_id")
    own_size = F.when(F.col("typed_form"), F.col("typed_size")).otherwise(F.col("plain_size"))
    numbered = sized.withColumn("item_row", F.monotonically_increasing_id())
    rows = scratch.keep(numbered, "rows")
    found = window_rows(rows, "item_row", "text", sizes)
    lengths = rows.select(F.col("item_row").alias("length_row"), "item_id", "plain_size", "typed_size")
    found = found.join(lengths, found["item_row"] == lengths["length_row"]).filter(F.col("size") == own_size).drop("length_row")
    found = patterns(found, rows, "item_row")
    wordy = F.col("exact") | F.col("pattern").isNull() | (F.col("free") <= F.floor(F.lit(MOST_PLACEHOLDERS) * F.col("size")))
    wanted = scratch.keep(found.filter(wordy).select(
        "item_id", "size", "hash", "exact", "first_words", F.when(~F.col("exact"), F.col("pattern")).alias("item_pattern")).distinct(), "windows")
    starts = start_table(wanted.filter(~F.col("exact")), wanted.count())
    item_windows = wanted.select("item_id", F.col("size").alias("item_size"), F.col("hash").alias("item_hash"), "item_pattern").distinct()
    made = window_rows(texts, "doc_id", "text", sizes, starts)
    hits = made.join(_bounded(item_windows), (made["hash"] == item_windows["item_hash"]) & (made["size"] == item_windows["item_size"]))
    hits = scratch.keep(hits.select("doc_id", "typed_form", "size", "place", "item_id", "item_pattern"), "hits")
    # Equal hashes have their placeholders at equal places; only windows with placeholders need more.
    slotted = hits.filter("item_pattern is not null")
    keys = scratch.keep(slotted.select(F.col("doc_id").alias("wanted_id")).distinct(), "keys")
    few = texts.join(_bounded(keys), texts["doc_id"].eqNullSafe(keys["wanted_id"]), "left_semi")
    alike = patterns(slotted, few, "doc_id").filter(F.col("pattern") == F.col("item_pattern"))
    columns = ["doc_id", "size", "place", "item_id"]
    return hits.filter("item_pattern is null").select(*columns).unionAll(alike.select(*columns))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, contaminated, n_windows, items`` of every document, over its whole text.

    ``n_windows`` counts the document's windows that match, ``items`` lists the ids of the items matched
    in ascending order, comma-joined (empty without a match); one match makes a document contaminated.
    Slots are compared within each window. Windows of both forms that end at one word count once. A window with more than
    ``MOST_PLACEHOLDERS`` of placeholders (a name or unit that comes again not counted) is matched by equal words and values only, so copies of it with other values are not found.
    Null and empty texts and texts shorter than every window match nothing. Rows with one id, and rows
    without an id, share their matches. Repeated items count once; items without words and an empty
    benchmark match nothing; items without an id match as well but are not listed. Only ids and texts
    are read from both tables.
    """
    found = (matched_windows(documents, benchmark, window).groupBy("doc_id")
             .agg(F.count_distinct("size", "place").alias("found_windows"), F.array_sort(F.collect_set("item_id")).alias("found_items")))
    own = found.select(F.col("doc_id").alias("found_id"), "found_windows",
                       F.array_join(F.col("found_items").cast("array<string>"), ",").alias("found_items"))
    ids = documents.select("doc_id")
    return (ids.join(own, ids["doc_id"].eqNullSafe(own["found_id"]), "left")
            .select("doc_id", F.col("found_windows").isNotNull().alias("contaminated"),
                    F.coalesce("found_windows", F.lit(0)).cast("bigint").alias("n_windows"),
                    F.coalesce("found_items", F.lit("")).alias("items")))
