"""Word and bigram counts, and clustering of texts the rules left unmatched."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from reqlens.operators import clustering
from reqlens.operators.taxonomy import UNMATCHED
from reqlens.session import cut_lineage

TOKEN = r"(?U)\b(\w\w+)\b"


def english_stop_words() -> list[str]:
    """Spark's own list; pass another one where a stated list matters."""
    return StopWordsRemover.loadDefaultStopWords("english")


def terms_of(text: Column, stop_words: Sequence[str], pattern: str = TOKEN) -> Column:
    """Words of at least two characters without stop words, followed by their bigrams."""
    words = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))
    if stop_words:
        words = F.filter(words, lambda word: ~word.isin(*stop_words))
    return words


def with_bigrams(words: Column) -> Column:
    firsts = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    seconds = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(firsts, seconds, lambda left, right: F.concat(left, F.lit(" "), right))
    return F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))


def _terms(df: DataFrame, text: str, stop_words: Sequence[str] | None, pattern: str, keys: Sequence[str] = (),
           weight: Column | None = None) -> DataFrame:
    """``keys, _w, _terms``: the words and bigrams of each text that is not null.

    Both are exploded from one-element arrays: later steps then read a column, and do not copy the expressions.
    """
    stop_words = english_stop_words() if stop_words is None else stop_words
    weight = F.lit(1).cast("bigint") if weight is None else weight
    rows = df.where(F.col(text).isNotNull()).select(
        *keys, weight.alias("_w"), F.explode(F.array(terms_of(F.col(text), stop_words, pattern))).alias("_words"))
    return rows.select(*keys, "_w", F.explode(F.array(with_bigrams(F.col("_words")))).alias("_terms"))


def _counted(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Occurrences and document frequency of every term.

    The distinct terms of a text travel behind all its terms and are told apart by their place, so both numbers
    come from one map-side combined aggregate, without a shuffle by document, and a term is shuffled once.
    """
    spread = rows.select(*keys, "_w", F.size("_terms").alias("_size"),
                         F.posexplode(F.concat("_terms", F.array_distinct("_terms"))).alias("_at", "ngram"))
    occurs, zero = F.col("_at") < F.col("_size"), F.lit(0).cast("bigint")
    return spread.groupBy(*keys, "ngram").agg(
        F.sum(F.when(occurs, F.col("_w")).otherwise(zero)).alias("count"),
        F.sum(F.when(occurs, zero).otherwise(F.col("_w"))).alias("documents"))


def term_counts(df: DataFrame, text: str, stop_words: Sequence[str] | None = None, weight: Column | None = None,
                keys: Sequence[str] = (), pattern: str = TOKEN) -> DataFrame:
    """Occurrences and document frequency of every term."""
    return _counted(_terms(df, text, stop_words, pattern, keys, weight), keys)


def frequent_candidates(rows: DataFrame, candidates: int, tracked: int) -> tuple[list[str], int]:
    """Terms that may be frequent, and a bound on the occurrences of every other term.

    One mergeable summary of ``tracked`` terms per task; only summaries are shuffled. A term outside a summary
    occurs at most ``3.5 / tracked`` of all occurrences; one inside it, but not returned, no more often than the
    least estimate returned (an estimate is never too low).
    """
    terms = rows.select(F.explode("_terms").alias("term"))
    found = terms.agg(F.expr(f"approx_top_k(term, {candidates}, {tracked})").alias("top"), F.count(F.lit(1)).alias("total")).first()
    top = found["top"] or []
    outside = -(-7 * found["total"] // (2 * tracked))
    least = min((row["count"] for row in top), default=0) if len(top) == candidates else 0
    return [row["item"] for row in top], max(outside, least)


def top_ngrams(df: DataFrame, text: str, n: int = 15, min_documents: int = 5,
               stop_words: Sequence[str] | None = None, pattern: str = TOKEN,
               candidates: int = 1_000, tracked: int = 1 << 16) -> DataFrame:
    """Most frequent terms that occur in enough texts. Sample beforehand if a sample is wanted.

    Candidates come from a bounded summary and are counted exactly in a second pass. Where the summary's bound does
    not set the last of the ``n`` terms apart from all other terms, all terms are counted.
    """
    rows = _terms(df, text, stop_words, pattern)

    def largest(counts: DataFrame) -> DataFrame:
        kept = counts.where(F.col("documents") >= min_documents)
        return kept.orderBy(F.desc("count"), F.asc("ngram")).limit(n).select("ngram", "count")

    names, others = frequent_candidates(rows, candidates, tracked)
    known = rows.withColumn("_terms", F.filter("_terms", lambda term: term.isin(names)))
    first = largest(_counted(known)).collect()
    if len(first) == n and first[-1]["count"] > others:
        return df.sparkSession.createDataFrame(first, "ngram string, count bigint")  # n rows
    return largest(_counted(rows))


# Residual clustering ---------------------------------------------------------

ASSIGNMENT_SCHEMA = T.StructType([
    T.StructField("complaint_type", T.StringType()),
    T.StructField("text_clean", T.StringType()),
    T.StructField("residual_cluster", T.LongType()),
    T.StructField("residual_cluster_label", T.StringType()),
])
PROFILE_SCHEMA = T.StructType([
    T.StructField("complaint_type", T.StringType()),
    T.StructField("residual_cluster", T.LongType()),
    T.StructField("cluster_rows", T.LongType()),
    T.StructField("cluster_share", T.DoubleType()),
    T.StructField("cluster_terms", T.StringType()),
    T.StructField("example_text", T.StringType()),
])


COUNTED = "complaint_type string, ngram string, count bigint, documents bigint"
SLICE = 1 << 20  # words looked at together
TIED = 4  # so many times ``max_terms`` words per family may share the last rank before all terms are counted


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch, np.ndarray, pa.Array]]:
    """Texts of one family with the row of each word, and the words: at most ``SLICE`` of them, or one text."""
    for batch in batches:
        families = batch.column("family").dictionary_encode()
        codes = families.indices.to_numpy(zero_copy_only=False)
        for code, family in enumerate(families.dictionary.to_pylist()):
            part = batch.take(pa.array(np.flatnonzero(codes == code)))
            sizes = pc.list_value_length(part.column("words")).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, start = np.cumsum(sizes), 0
            while start < len(part):
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + SLICE, "right")))
                piece = part.slice(start, stop - start)
                yield family, piece, np.repeat(np.arange(stop - start), sizes[start:stop]), piece.column("words").flatten().cast(pa.string())
                start = stop


def _tallied(family: str, part: pa.RecordBatch, row: np.ndarray, code: np.ndarray, size: int, name: Callable) -> pa.RecordBatch:
    """Occurrences and document frequency of the codes below ``size`` that stand in the given rows; ``name`` makes terms of codes."""
    weight = part.column("rows").to_numpy()
    places, times = np.unique(row * size + code, return_counts=True)
    of = weight[places // size]
    found, at = np.unique(places % size, return_inverse=True)
    sums = [np.bincount(at, weights=w, minlength=len(found)).astype(np.int64) for w in (times * of, of)]
    return pa.RecordBatch.from_arrays([pa.array([family] * len(found), pa.string()), name(found), *map(pa.array, sums)],
                                      names=["complaint_type", "ngram", "count", "documents"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for family, part, row, words in _slices(batches):
        coded = words.dictionary_encode()
        yield _tallied(family, part, row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary)),
                       lambda found: coded.dictionary.take(pa.array(found)))


def _codes(words: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each word among the known ones, or -1."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _pairs(row: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and codes of the bigrams of two known words."""
    left, right = code[:-1], code[1:]
    kept = (row[:-1] == row[1:]) & (left >= 0) & (right >= 0)
    return row[:-1][kept], left[kept] * size + right[kept]


def _leading_terms(texts: DataFrame, stop_words: Sequence[str], pattern: str, min_documents: int, max_terms: int) -> DataFrame:
    """``_vocabulary`` of each family, with bigrams counted only where both words may belong to one.

    A bigram occurs no more often, and in no more texts, than either of its words. So it can be among the most
    frequent terms only if both words are among the most frequent words, those that share the last rank included.
    All terms are counted where very many words do, and where words hold spaces, as a word then may equal a bigram.
    """
    spark, keys = texts.sparkSession, ["complaint_type"]
    tokens = texts.select(F.col("complaint_type").alias("family"), "rows", terms_of(F.col("text_clean"), stop_words, pattern).alias("words"))

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys, "ngram").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))

    words = cut_lineage(summed(tokens.mapInArrow(_count_words, COUNTED)))
    families, spaced = words.agg(F.count_distinct(*keys), F.bool_or(F.contains("ngram", F.lit(" ")))).first()
    most = TIED * max_terms * families
    leading = _vocabulary(words, keys, min_documents, max_terms, ties=True).select(*keys, "ngram").limit(most + 1).collect()
    if spaced or len(leading) > most:
        return _vocabulary(term_counts(texts, "text_clean", stop_words, F.col("rows"), keys, pattern), keys, min_documents, max_terms)
    known: dict[str, list[str]] = {}
    for row in leading:
        known.setdefault(row["complaint_type"], []).append(row["ngram"])
    sent = spark.sparkContext.broadcast(known)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {family: pa.array(own, pa.string()) for family, own in sent.value.items()}
        for family, part, row, words in _slices(batches):
            if family in sets:
                own, size = sets[family], len(sets[family])
                yield _tallied(family, part, *_pairs(row, _codes(words, own), size), size * size, lambda found: pc.binary_join_element_wise(
                    own.take(pa.array(found // size)), own.take(pa.array(found % size)), " "))

    return _vocabulary(words.unionByName(summed(tokens.mapInArrow(count_pairs, COUNTED))), keys, min_documents, max_terms)


def _vocabulary(counts: DataFrame, keys: Sequence[str], min_documents: int, max_terms: int,
                salts: int = 256, ties: bool = False) -> DataFrame:
    """Most frequent terms per key, in two steps: a hot key's terms are first cut per salt. ``ties``: and those that occur as often as the last."""
    order, place = ([F.desc("count")], F.rank()) if ties else ([F.desc("count"), F.asc("ngram")], F.row_number())
    salted = counts.where(F.col("documents") >= min_documents).withColumn(
        "_salt", F.pmod(F.xxhash64("ngram"), F.lit(salts)))
    partial = place.over(Window.partitionBy(*keys, "_salt").orderBy(*order))
    final = place.over(Window.partitionBy(*keys).orderBy(*order))
    kept = salted.withColumn("_rank", partial).where(F.col("_rank") <= max_terms)
    return kept.withColumn("_rank", final).where(F.col("_rank") <= max_terms)


def _cluster_count(rows: int, distinct: int, most: int) -> int:
    wanted = min(most, distinct, max(2, rows // 1000 + 1))
    return max(2, rows - 1) if wanted >= rows else wanted


def _top_terms(center, vocabulary: Sequence[str], n: int) -> str:
    strongest = sorted(range(len(vocabulary)), key=lambda i: (-center[i], vocabulary[i]))
    return ", ".join(vocabulary[i] for i in strongest[:n])


@dataclass
class FamilyVectors:
    """Different texts of each family as TF-IDF vectors of length one, weighted by their rows."""

    points: DataFrame
    vocabulary: dict[str, list[str]]
    rows: dict[str, tuple[int, int]]  # rows and different texts of each family


def family_vectors(df: DataFrame, min_rows: int = 150, max_terms: int = 1500, min_documents: int = 5,
                   stop_words: Sequence[str] | None = None, family: str = "complaint_type", text: str = "text_clean",
                   pattern: str = TOKEN) -> FamilyVectors:
    """Vectors of the unmatched texts of every family with enough rows; written once.

    Equal texts are folded, so a hot family does not repeat its work. Only the vocabulary (at most
    ``max_terms`` per family) reaches the driver.
    """
    spark = df.sparkSession
    residual = df.where((F.col("issue_subtype") == UNMATCHED) & F.col(text).isNotNull() & F.col(family).isNotNull())
    texts = cut_lineage(residual.groupBy(F.col(family).alias("complaint_type"), F.col(text).alias("text_clean")).agg(
        F.count(F.lit(1)).alias("rows")))
    stop_words = english_stop_words() if stop_words is None else stop_words
    sizes = texts.groupBy("complaint_type").agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("distinct")).where(
        (F.col("rows") >= min_rows) & (F.col("distinct") >= 2))
    rows = {row["complaint_type"]: (row["rows"], row["distinct"]) for row in sizes.collect()}
    texts = texts.where(F.col("complaint_type").isin(list(rows)))
    chosen: dict[str, dict[str, int]] = {}
    for row in _leading_terms(texts, stop_words, pattern, min_documents, max_terms).collect():
        chosen.setdefault(row["complaint_type"], {})[row["ngram"]] = row["documents"]
    vocabulary = {name: sorted(chosen[name]) for name in rows if len(chosen.get(name, ())) >= 2}
    weights = {name: (terms, np.array([_smooth_idf(rows[name][0], chosen[name][term]) for term in terms])) for name, terms in vocabulary.items()}
    known = texts.where(F.col("complaint_type").isin(list(vocabulary))).select(
        F.col("complaint_type").alias("family"), F.col("text_clean").alias("point"), F.col("rows").cast("double").alias("weight"),
        terms_of(F.col("text_clean"), stop_words, pattern).alias("words"))
    return FamilyVectors(cut_lineage(known.mapInArrow(_vectors(spark.sparkContext.broadcast(weights)), clustering.POINTS)), vocabulary, rows)


def _vectors(sent) -> Callable:
    """Points of texts; ``sent`` holds the terms of each family and their weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, _Places] = {}
        for family, part, row, words in _slices(batches):
            terms, idf = sent.value[family]
            if family not in tables:
                tables[family] = _places(terms)
            (row, place), width = tables[family].found(row, words), len(terms)
            cells, times = np.unique(row * width + place, return_counts=True)
            row, place = cells // width, cells % width
            values = times * idf[place]
            values /= np.sqrt(np.bincount(row, weights=values ** 2, minlength=len(part)))[row]
            ends = np.concatenate([[0], np.bincount(row, minlength=len(part)).cumsum()])
            cells = [pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((ends * of.itemsize).astype("<i4")), pa.py_buffer(of)])
                     for of in (place.astype("<i4"), values.astype("<f8"))]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("family", "point", "weight")], *cells],
                                             names=["family", "point", "weight", "keys", "numbers"])
    return run


@dataclass
class _Places:
    """Where the terms of a family stand: by word, and by the codes of two words for bigrams."""

    words: pa.Array
    of_word: np.ndarray
    pairs: np.ndarray
    of_pair: np.ndarray

    def found(self, row: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows and places of all terms in the words of the given rows."""
        code = _codes(words, self.words)
        single = np.where(code >= 0, self.of_word[code], -1)
        of, pair = _pairs(row, code, len(self.words))
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        double = np.where(self.pairs[at] == pair, self.of_pair[at], -1)
        return np.concatenate([row[single >= 0], of[double >= 0]]), np.concatenate([single[single >= 0], double[double >= 0]])


def _places(terms: Sequence[str]) -> _Places:
    """A term with a space is a bigram of the words on both sides of any of its spaces."""
    splits = [(term[:i], term[i + 1:], place) for place, term in enumerate(terms) for i, sign in enumerate(term) if sign == " "]
    code = {word: i for i, word in enumerate(dict.fromkeys([*terms, *(word for left, right, _ in splits for word in (left, right))]))}
    of_word = np.full(len(code), -1)
    of_word[[code[term] for term in terms]] = np.arange(len(terms))
    pairs = sorted((code[left] * len(code) + code[right], place) for left, right, place in splits) or [(-1, -1)]
    return _Places(pa.array(list(code), pa.string()), of_word, *(np.array(side, dtype=np.int64) for side in zip(*pairs)))


def residual_clusters(df: DataFrame, min_rows: int = 150, max_clusters: int = 6, max_terms: int = 1500,
                      min_documents: int = 5, label_terms: int = 5, stop_words: Sequence[str] | None = None,
                      seed: int = 42, family: str = "complaint_type", text: str = "text_clean",
                      pattern: str = TOKEN, starts: int = 10, iterations: int = 50) -> tuple[DataFrame, DataFrame]:
    """TF-IDF and K-means inside each family of unmatched texts: (assignments, profiles).

    All families and all ``starts`` are fitted together, the best start of each family counts. The example of
    a profile is the cluster's first text in alphabetical order.
    """
    spark = df.sparkSession
    made = family_vectors(df, min_rows, max_terms, min_documents, stop_words, family, text, pattern)
    sizes = {name: (_cluster_count(*made.rows[name], max_clusters), len(terms)) for name, terms in made.vocabulary.items()}
    sizes = {name: size for name, size in sizes.items() if size[0] >= 2}
    if not sizes:
        return spark.createDataFrame([], ASSIGNMENT_SCHEMA), spark.createDataFrame([], PROFILE_SCHEMA)
    centres = clustering.best_centres(made.points, sizes, starts, seed, iterations)
    placed = cut_lineage(clustering.assign(made.points, centres))
    labels = spark.createDataFrame([(name, k, _top_terms(centre, made.vocabulary[name], label_terms), made.rows[name][0])
                                    for name, own in centres.items() for k, centre in enumerate(own)], "family string, cluster bigint, label string, family_rows bigint")
    assignments = placed.join(labels, ["family", "cluster"]).select(
        F.col("family").alias("complaint_type"), F.col("point").alias("text_clean"),
        F.col("cluster").alias("residual_cluster"), F.col("label").alias("residual_cluster_label"))
    totals = placed.mapInArrow(_cluster_totals, placed.schema).groupBy("family", "cluster").agg(F.sum("weight").alias("weight"), F.min("point").alias("point"))
    profiles = totals.join(labels, ["family", "cluster"]).select(
        F.col("family").alias("complaint_type"), F.col("cluster").alias("residual_cluster"), F.col("weight").cast("bigint").alias("cluster_rows"),
        (F.col("weight") / F.col("family_rows")).alias("cluster_share"), F.col("label").alias("cluster_terms"), F.col("point").alias("example_text"))
    return assignments, profiles


def _cluster_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and first text of each cluster in a batch: one row each, so texts are neither sorted nor shuffled."""
    for batch in batches:
        sums = pa.table(batch).group_by(["family", "cluster"]).aggregate([("point", "min"), ("weight", "sum")])
        yield from sums.select(["family", "point_min", "weight_sum", "cluster"]).rename_columns(["family", "point", "weight", "cluster"]).to_batches()


def _smooth_idf(rows: int, documents: int) -> float:
    from math import log

    return log((1 + rows) / (1 + documents)) + 1.0


def attach_clusters(df: DataFrame, assignments: DataFrame) -> DataFrame:
    """Cluster of every unmatched request, through the digest of its text: whole texts need not be shuffled and sorted."""
    unmatched = F.col("issue_subtype") == UNMATCHED
    other = assignments.select(F.col("complaint_type").alias("_family"), F.sha2("text_clean", 256).alias("_digest"),
                               *[c for c in assignments.columns if c not in ("complaint_type", "text_clean")])
    keyed = df.withColumn("_text_digest", F.sha2("text_clean", 256))
    return keyed.join(
        other, unmatched & (F.col("complaint_type") == F.col("_family")) & (F.col("_text_digest") == F.col("_digest")),
        "left").drop("_family", "_digest", "_text_digest")
