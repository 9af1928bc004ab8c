"""Character 2/3-gram counts, vocabulary, scores and vectors.

Long form ``(row_id, gram, tf)`` throughout; zero counts are implied. Per-row counts are
made inside the row (no shuffle); corpus statistics all come from one small contingency
table ``(gram, tf, label) -> rows`` that map-side combining bounds by the alphabet, not by
the number of texts, so a gram found in every row is no hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlspark import constants as K
from urlspark.functions import text as X
from urlspark.functions.text import CHARS_AT_ONCE, entropy_measure, gram_counter
from urlspark.operators.metrics import weighted_f1
from urlspark.session import BROADCAST_ROWS, fits_broadcast, lookup_join


def normalize(text: Column) -> Column:
    """Lower case, runs of two or more white-space characters become one space."""
    return F.lower(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]{2,}", " "))


OUT_BYTES = 16 << 20  # of counts handed back at once


def ngram_counts(df: DataFrame, text: str = "url", keep: tuple[str, ...] = ("row_id",),
                 sizes: tuple[int, ...] = K.NGRAM_SIZES) -> DataFrame:
    """(keep..., gram, tf): every distinct k-gram (k up to 3) of every text with its count; narrow, no shuffle."""
    staged = df.select(*keep, normalize(F.col(text)).alias("_text"))
    characters, runs, named, slices = gram_counter(CHARS_AT_ONCE)

    def count(batches):
        for batch in batches:
            texts = batch.columns[-1]
            for a, b in slices(texts):
                points, ends = characters(texts.slice(a, b - a))
                for k in sizes:
                    row, gram, tf = runs(points, ends, k)
                    if not len(row):
                        continue
                    row, grams = row + a, named(gram, k)
                    for c, d in by_bytes(batch.columns[:-1], row):  # what is kept stands beside each of its grams
                        kept = [column.take(pa.array(row[c:d])) for column in batch.columns[:-1]]
                        yield pa.RecordBatch.from_arrays(
                            [*kept, grams.slice(c, d - c), pa.array(tf[c:d].astype(np.int32))], names)

    def by_bytes(columns, row):
        sizes = np.full(len(row), 32, np.int64)
        for column in columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)[row]
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // OUT_BYTES)) + 1
        return zip([0, *cuts.tolist()], [*cuts.tolist(), len(row)])

    names = [*keep, "gram", "tf"]
    fields = [*staged.schema.fields[:-1], T.StructField("gram", T.StringType()), T.StructField("tf", T.IntegerType())]
    return staged.mapInArrow(count, T.StructType(fields))


def text_entropies(df: DataFrame, text: str, keep: tuple[str, ...] = ("row_id",), sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(keep..., h1, h2, ...): Shannon entropy in bits over each text's k-grams as it stands; one gram or none give 0, null null."""
    staged = df.select(*keep, F.col(text).alias("_text"))
    characters, _, _, slices = gram_counter(CHARS_AT_ONCE)
    entropy = entropy_measure()

    def measure(batches):
        for batch in batches:
            texts = batch.columns[-1]
            for a, b in slices(texts):
                part = texts.slice(a, b - a)
                points, ends = characters(part)
                gone, out = part.is_null().to_numpy(zero_copy_only=False), []
                for k in sizes:
                    out.append(pa.array(entropy(points, ends, k), mask=gone))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), *out], names)

    names = [*keep, *[f"h{k}" for k in sizes]]
    fields = [*staged.schema.fields[:-1], *[T.StructField(f"h{k}", T.DoubleType()) for k in sizes]]
    return staged.mapInArrow(measure, T.StructType(fields))


def gram_cells(df: DataFrame, text: str = "url", label: str | None = None, classes: list[int] = (),
               sizes: tuple[int, ...] = K.NGRAM_SIZES) -> DataFrame:
    """``contingency`` of the ``ngram_counts`` of ``df``: each slice of texts is summed up before anything is shuffled."""
    staged = df.select(*([F.col(label).cast("long").alias("_label")] if label else []), normalize(F.col(text)).alias("_text"))
    characters, runs, named, slices = gram_counter(CHARS_AT_ONCE)

    def count(batches):
        for batch in batches:
            texts = batch.columns[-1]
            for a, b in slices(texts):
                points, ends = characters(texts.slice(a, b - a))
                own = batch.column(0).slice(a, b - a).to_pandas().to_numpy() if label else None  # a null is no class
                for k in sizes:
                    row, gram, tf = runs(points, ends, k)
                    if not len(row):
                        continue
                    order = np.lexsort((tf, gram))
                    gram, tf = gram[order], tf[order]
                    first = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (tf[1:] != tf[:-1])))
                    sums = [np.diff(np.append(first, len(gram)))]
                    if label:
                        mine = own[row[order]]
                        sums += [np.add.reduceat((mine == c).astype(np.int64), first) for c in classes]
                    yield pa.RecordBatch.from_arrays(
                        [named(gram[first], k), pa.array(tf[first].astype(np.int32)), *(pa.array(n.astype(np.int64)) for n in sums)],
                        ["gram", "tf", *counted])

    counted = ["n", *[f"n_{c}" for c in classes]]
    schema = "gram string, tf int, " + ", ".join(f"`{c}` long" for c in counted)
    return staged.mapInArrow(count, schema).groupBy("gram", "tf").agg(*[F.sum(c).alias(c) for c in counted])


def contingency(counts: DataFrame, label: str | None = None, classes: list[int] = ()) -> DataFrame:
    """(gram, tf, n[, n_<class>...]): rows per gram and count value, in all and per class.

    Zero counts are left out; they follow from the class sizes.
    """
    per_class = [F.count_if(F.col(label) == c).alias(f"n_{c}") for c in classes]
    return counts.groupBy("gram", "tf").agg(F.count(F.lit(1)).alias("n"), *per_class)


def _mi_term(joint: Column, row_total: Column, col_total: int, n_rows: int) -> Column:
    """One cell of a mutual information sum, in nats; empty cells add nothing."""
    p = joint / n_rows
    return F.when(joint > 0, p * F.ln(p * n_rows * n_rows / (row_total * F.lit(col_total)))).otherwise(0.0)


def gram_statistics(cells: DataFrame, n_rows: int, label_totals: dict[int, int] | None = None) -> DataFrame:
    """(gram, df, variance[, mi]) of every gram from the contingency table in one aggregation.

    ``variance`` is the population variance of the count, zeros included. ``mi`` is the
    mutual information (nats) between the count value, zero included, and the label;
    ``label_totals`` holds the rows per class.
    """
    n, tf = F.col("n"), F.col("tf").cast("long")
    totals = label_totals or {}
    aggs = [F.sum("n").alias("df"), F.sum(tf * n).alias("_s"), F.sum(tf * tf * n).alias("_ss")]
    if totals:
        seen = sum((_mi_term(F.col(f"n_{c}"), n, t, n_rows) for c, t in totals.items()), F.lit(0.0))
        aggs += [F.sum(seen).alias("_seen"), *[F.sum(f"n_{c}").alias(f"n_{c}") for c in totals]]
    stats = cells.groupBy("gram").agg(*aggs)
    mean = F.col("_s") / n_rows
    out = [F.col("gram"), F.col("df"), (F.col("_ss") / n_rows - mean * mean).alias("variance")]
    if totals:
        zeros = sum((_mi_term(t - F.col(f"n_{c}"), n_rows - F.col("df"), t, n_rows) for c, t in totals.items()),
                    F.lit(0.0))
        out.append(F.greatest(F.col("_seen") + zeros, F.lit(0.0)).alias("mi"))
    return stats.select(*out)


def vocabulary(stats: DataFrame, n_rows: int, min_df: int = K.NGRAM_MIN_DF, max_df: float = K.NGRAM_MAX_DF) -> DataFrame:
    """Grams within the document-frequency limits."""
    return stats.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_rows))


def variance_filter(vocab: DataFrame, threshold: float = K.NGRAM_MIN_VARIANCE) -> DataFrame:
    return vocab.filter(F.col("variance") > threshold)


def class_totals(rows: DataFrame, label: str = "label") -> dict[int, int]:
    return {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row per class


def labelled_statistics(rows: DataFrame, text: str = "url", label: str = "label", key: str = "row_id"):
    """(statistics of every gram with mi, class totals) of labelled rows."""
    totals = class_totals(rows, label)
    cells = gram_cells(rows, text, label, sorted(totals))
    return gram_statistics(cells, sum(totals.values()), totals), totals


def gram_vectors(df: DataFrame, grams: DataFrame, text: str = "url", keep: tuple[str, ...] = ("row_id",),
                 size: int | None = None, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(keep..., vector): sparse counts of the frozen vocabulary ``grams(gram, idx)``.

    A vocabulary within ``max_rows`` goes to every executor and rows are vectorized where
    they are. A larger one is joined to the counts of the different texts (a group is one
    text's distinct grams), and rows get their text's vector; the columns of ``keep`` take no
    part in that join, so NULLs in them don't matter.
    """
    if fits_broadcast(grams, max_rows):
        words = [r.gram for r in grams.orderBy("idx").collect()]  # at most max_rows
        if not words:
            return df.select(*keep, array_to_vector(F.array().cast("array<double>")).alias("vector"))
        staged = df.withColumn("_text", F.coalesce(normalize(F.col(text)), F.lit("")))
        pieces = F.concat(*[X.grams(F.col("_text"), k) for k in K.NGRAM_SIZES])
        model = CountVectorizerModel.from_vocabulary(words, inputCol="_grams", outputCol="vector", minTF=1.0)
        return model.transform(staged.select(*keep, pieces.alias("_grams"))).select(*keep, "vector")
    size = size or grams.agg(F.max("idx")).first()[0] + 1
    texts = df.select(F.col(text).alias("_text_key")).where(F.col("_text_key").isNotNull()).distinct()
    counts = ngram_counts(texts, "_text_key", ("_text_key",))
    hits = lookup_join(counts, grams.select("gram", "idx"), ["gram"], "inner", max_rows)
    slots = hits.groupBy("_text_key").agg(F.sort_array(F.collect_list(F.struct("idx", "tf"))).alias("_slots"))
    full = df.join(slots, df[text] == slots["_text_key"], "left")
    staged = full.select(*[df[c] for c in keep], F.col("_slots.idx").alias("_idx"), F.col("_slots.tf").alias("_tf"))
    return _sparse(staged, size)


def _sparse(staged: DataFrame, size: int) -> DataFrame:
    """The last two columns, slots and counts (null: none), as one column of sparse vectors: whole Arrow arrays at a time."""
    def build(batches):
        for batch in batches:
            slots, counts = batch.columns[-2:]
            sizes = pc.fill_null(pc.list_value_length(slots), 0).to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
            n = len(batch)
            vectors = pa.StructArray.from_arrays(
                [pa.array(np.zeros(n), pa.int8()), pa.array(np.full(n, size), pa.int32()),
                 pa.ListArray.from_arrays(ends, slots.flatten().cast(pa.int32())),
                 pa.ListArray.from_arrays(ends, counts.flatten().cast(pa.float64()))],
                names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], vectors], names)

    names = [*staged.columns[:-2], "vector"]
    schema = T.StructType([*staged.schema.fields[:-2], T.StructField("vector", VectorUDT())])
    return staged.mapInArrow(build, schema)


def number_grams(vocab: DataFrame) -> DataFrame:
    """(gram, idx) in gram order, numbered without a single-task window.

    Grams are counted per leading character; that table (one row per character) gives
    each character its offset and ranks run inside characters.
    """
    from pyspark.sql import Window

    keyed = vocab.select("gram", F.left("gram", F.lit(1)).alias("_p"))
    offsets = keyed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("gram")))
    return ranked.join(offsets, "_p").select("gram", (F.col("_base") + F.col("_r") - 1).cast("int").alias("idx"))


def fit_l1_logistic(train: DataFrame, n_rows: int, c: float, label: str = "label", vector: str = "vector",
                    max_iter: int = 100):
    """L1 logistic regression; ``c`` weighs the summed log loss against the absolute coefficients."""
    lr = LogisticRegression(
        featuresCol=vector, labelCol=label, elasticNetParam=1.0, regParam=1.0 / (c * n_rows),
        standardization=False, maxIter=max_iter, tol=1e-6,
    )
    return lr.fit(train)


def coefficient_table(model, grams: DataFrame) -> DataFrame:
    """(gram, weight): absolute coefficient per vocabulary entry."""
    spark = grams.sparkSession
    rows = [(i, abs(float(w))) for i, w in enumerate(model.coefficients.toArray())]
    weights = spark.createDataFrame(rows, "idx int, weight double")
    return grams.join(weights, "idx").select("gram", "weight")


def combined_score(scores: DataFrame, key: str = "gram", left: str = "mi", right: str = "weight",
                   left_share: float = 0.5, out: str = "score") -> DataFrame:
    """Weighted sum of two columns, each divided by its maximum (a maximum of 0 counts as 1).

    The two maxima are a scalar subquery: nothing is joined or moved to one task.
    """
    maxima = scores.agg(
        F.struct(
            F.coalesce(F.nullif(F.max(left), F.lit(0.0)), F.lit(1.0)).alias("l"),
            F.coalesce(F.nullif(F.max(right), F.lit(0.0)), F.lit(1.0)).alias("r"),
        ).alias("m")
    ).scalar()
    value = left_share * F.col(left) / maxima["l"] + (1.0 - left_share) * F.col(right) / maxima["r"]
    return scores.withColumn(out, value)


def top_grams(scored: DataFrame, k: int = K.NGRAM_TOP, score: str = "score") -> DataFrame:
    """The k best grams; ties go by gram."""
    return scored.orderBy(F.desc(score), F.asc("gram")).limit(k)


def select_ngrams(train: DataFrame, text: str = "url", label: str = "label", key: str = "row_id",
                  k: int = K.NGRAM_TOP, min_df: int = K.NGRAM_MIN_DF, max_iter: int = 100) -> DataFrame:
    """(gram, score, idx) of the k selected grams, idx 0 the best.

    Vocabulary fit, variance filter, mutual information and L1 weights, combined.
    """
    stats, totals = labelled_statistics(train, text, label, key)
    n_rows = sum(totals.values())
    vocab = variance_filter(vocabulary(stats, n_rows, min_df)).select("gram", "mi").persist()
    grams = number_grams(vocab).persist()
    vectors = gram_vectors(train, grams, text, (key, label)).persist()
    weights = coefficient_table(fit_l1_logistic(vectors, n_rows, K.NGRAM_L1_C, label, max_iter=max_iter), grams)
    best = top_grams(combined_score(vocab.join(weights, "gram")), k)
    rows = [(r.gram, r.score, i) for i, r in enumerate(best.collect())]  # at most k
    for df in (vocab, grams, vectors):
        df.unpersist()
    return train.sparkSession.createDataFrame(rows, "gram string, score double, idx int")


def validate_ngrams(train: DataFrame, validation: DataFrame, selected: DataFrame, text: str = "url",
                    label: str = "label", key: str = "row_id", max_iter: int = 100) -> DataFrame:
    """One row (accuracy, weighted_f1) of an L1 logistic model on the selected grams."""
    vectors = gram_vectors(train, selected, text, (key, label)).persist()
    model = fit_l1_logistic(vectors, vectors.count(), K.NGRAM_VALIDATION_C, label, max_iter=max_iter)
    scored = model.transform(gram_vectors(validation, selected, text, (key, label)))
    vectors.unpersist()
    return weighted_f1(scored.select(F.col(label), F.col("prediction").cast("int")), label, "prediction")


def feature_names(selected: DataFrame) -> DataFrame:
    return selected.select("idx", "gram").orderBy("idx")
