"""Queries of vocabularies, sequences, matrices and vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwatch import schemas
from postwatch.catalog import base as B
from postwatch.catalog.base import query
from postwatch.catalog.sources import vector_words
from postwatch.functions import arrays as A
from postwatch.functions import text as X
from postwatch.operators import features, vectors
from postwatch.plans import classify, stages
from postwatch.session import keep, new_folder

_SEPARATORS = X.TOKENIZER_SEPARATORS[:-2]
_SPACES = " " * len(_SEPARATORS)


def sql_tokenizer(text: str) -> str:
    return f"""list_filter(regexp_split_to_array(translate(lower({text}),
      '{_SEPARATORS}', '{_SPACES}'), '[ \\t\\n]'), lambda w: w <> '')"""


def sql_vocabulary(table: str, num_words: int | None = None) -> str:
    bound = "" if num_words is None else f"LIMIT {num_words - 2}"
    return f"""
  SELECT word, CAST(row_number() OVER (ORDER BY n DESC, word) + 1 AS INTEGER) AS idx, n
  FROM (SELECT word, count(*) AS n
        FROM (SELECT unnest({sql_tokenizer("text")}) AS word FROM {table}) GROUP BY word
        ORDER BY n DESC, word {bound})"""


@query("vocab_fit", sql_vocabulary("documents"))
def vocab_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.fit_vocabulary(B.documents(spark, sf_dir))


SEQUENCES = f"""WITH v AS ({sql_vocabulary("documents", 10000)}),
t AS (SELECT doc_id, {sql_tokenizer("text")} AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM t),
s AS (SELECT doc_id, pos, coalesce(idx, 1) AS idx FROM w LEFT JOIN v USING (word))"""


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = features.kept_words(features.fit_vocabulary(B.documents(spark, sf_dir)), features.NUM_WORDS)
    return features.texts_to_sequences(B.table(spark, sf_dir, "documents"), ["doc_id"], vocabulary)


@query(
    "texts_to_sequences",
    f"""{SEQUENCES}
SELECT doc_id, coalesce(string_agg(CAST(idx AS VARCHAR), ' ' ORDER BY pos), '') AS indices
FROM t LEFT JOIN s USING (doc_id) GROUP BY doc_id""",
)
def texts_to_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).withColumn("indices", B.joined("indices"))


@query(
    "binary_bow",
    f"""{SEQUENCES}
SELECT doc_id, coalesce(string_agg(CAST(idx AS VARCHAR), ' ' ORDER BY idx), '') AS positions
FROM t LEFT JOIN (SELECT DISTINCT doc_id, idx FROM s) USING (doc_id) GROUP BY doc_id""",
)
def binary_bow(spark: SparkSession, sf_dir: str) -> DataFrame:
    bags = features.binary_bag_of_words(_sequences(spark, sf_dir))
    return bags.withColumn("positions", B.joined("positions"))


# Words of the benchmark texts are the known ones: 1 and on in their order, the unknown one last.
KNOWN = f"""known AS (
  SELECT word, CAST(row_number() OVER (ORDER BY word) AS INTEGER) AS idx
  FROM (SELECT DISTINCT unnest({B.WORDS_OF.format("lower(text)")}) AS word FROM benchmark))"""


def known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = B.table(spark, sf_dir, "benchmark")
    words = benchmark.select(F.explode(X.tokenize(F.lower("text"))).alias("word")).distinct()
    return keep(features.with_ordinal(words, "word").select(
        "word", (F.col("ordinal") + 1).cast("int").alias("idx")), "known")


def _unknown(known: DataFrame) -> int:
    return known.count() + 1


MAPPED = f"""WITH {KNOWN},
t AS (SELECT doc_id, {B.WORDS_OF.format("lower(text)")} AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM t),
s AS (SELECT doc_id, pos, coalesce(idx, (SELECT CAST(count(*) AS INTEGER) + 1 FROM known)) AS idx
      FROM w LEFT JOIN known USING (word)),
i AS (SELECT doc_id, coalesce(list(idx ORDER BY pos) FILTER (WHERE idx IS NOT NULL), []) AS indices
      FROM t LEFT JOIN s USING (doc_id) GROUP BY doc_id)"""


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = known_words(spark, sf_dir)
    lowered = B.table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    return features.sentence_to_indices(lowered, ["doc_id"], known, _unknown(known))


@query("sentence_to_indices", f"{MAPPED}\nSELECT doc_id, array_to_string(indices, ' ') AS indices FROM i")
def sentence_to_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).withColumn("indices", B.joined("indices"))


# A length between the shortest and the longest text.
LENGTH = 300


@query(
    "pad_sequences",
    f"""{MAPPED}
SELECT doc_id, rtrim(array_to_string(indices, ' ') || ' '
       || repeat('0 ', greatest({LENGTH} - len(indices), 0))) AS indices FROM i""",
)
def pad_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = A.pad(F.col("indices"), LENGTH)
    return _mapped(spark, sf_dir).withColumn("indices", B.joined(padded))


@query(
    "trim_sequences",
    f"{MAPPED}\nSELECT doc_id, array_to_string(indices[:{LENGTH}], ' ') AS indices FROM i",
)
def trim_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    trimmed = A.trim(F.col("indices"), LENGTH)
    return _mapped(spark, sf_dir).withColumn("indices", B.joined(trimmed))


TURNS = f"""
t AS (SELECT conv_id, turn, {B.WORDS_OF.format("lower(text)")} AS words FROM conversations),
w AS (SELECT conv_id, turn, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM t)"""


@query(
    "pad_to_train_len",
    f"""WITH {KNOWN}, {TURNS},
l AS (SELECT max(n + n % 2) AS n FROM (SELECT len({B.WORDS_OF.format("text")}) AS n FROM benchmark)),
s AS (SELECT conv_id, turn, pos, coalesce(idx, (SELECT CAST(count(*) AS INTEGER) + 1 FROM known)) AS idx
      FROM w LEFT JOIN known USING (word)),
i AS (SELECT conv_id, turn, coalesce(list(idx ORDER BY pos) FILTER (WHERE idx IS NOT NULL), []) AS a
      FROM t LEFT JOIN s USING (conv_id, turn) GROUP BY ALL)
SELECT conv_id, turn, array_to_string((a || list_transform(range(n), lambda x: 0))[:n], ' ') AS indices
FROM i, l""",
)
def pad_to_train_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = known_words(spark, sf_dir)
    length = features.padded_length(B.table(spark, sf_dir, "benchmark"))
    turns = B.table(spark, sf_dir, "conversations").withColumn("text", F.lower("text"))
    padded = classify.padded_indices(turns, ["conv_id", "turn"], known, _unknown(known), length)
    return padded.withColumn("indices", B.joined("indices"))


def _row_sums():
    """Sum, and sum weighted by place, of each row of a matrix, 0 where it is null; needs nothing of this package where it runs."""

    def run(batches):
        for batch in batches:
            vec, pos = batch.column("vec"), batch.column("pos")
            sizes = vec.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            cells, total, placed = vec.flatten(), np.zeros(len(sizes)), np.zeros(len(sizes))
            x, none = cells.to_numpy(zero_copy_only=False), np.zeros(len(sizes), bool)
            widths = set(np.unique(sizes).tolist()) - {0}
            if len(widths) == 1:
                width = widths.pop()
                each = x.reshape(-1, width)
                total[sizes > 0], placed[sizes > 0] = each.sum(axis=1), each @ np.arange(1.0, width + 1)
            elif widths:
                row = np.repeat(np.arange(len(sizes)), sizes)
                column = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
                total, placed = (np.bincount(row, w, len(sizes)) for w in (x, x * column))
            if cells.null_count:
                # A row with a null has no sum.
                row = np.repeat(np.arange(len(sizes)), sizes)
                none[row[cells.is_null().to_numpy(zero_copy_only=False)]] = True
            place = pos.fill_null(0).to_numpy(zero_copy_only=False) + 1
            sums = [pa.array(s, pa.float64(), mask=none) for s in (total, place * placed)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *sums], ["conv_id", "turn", "pos", "n", "total", "placed"])

    return run


@query(
    "sentence_to_matrix",
    f"""WITH {TURNS},
v AS (SELECT word, idx, n FROM ({sql_vocabulary("conversations", 10000)})),
e AS (SELECT word, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec
      FROM v JOIN embeddings ON idx - 2 = vec_id),
l AS (SELECT max(len(words) + len(words) % 2) AS n FROM t),
c AS (SELECT conv_id, turn, pos, unnest(vec) AS x, generate_subscripts(vec, 1) AS d
      FROM w JOIN e USING (word))
SELECT t.conv_id, t.turn, CAST(any_value(l.n) AS INTEGER) AS n_rows, 64 AS n_columns,
       round(coalesce(sum(x), 0), 4) AS total, round(coalesce(sum(x * pos * d), 0), 2) AS placed
FROM t CROSS JOIN l LEFT JOIN c ON t.conv_id = c.conv_id AND t.turn = c.turn
GROUP BY t.conv_id, t.turn""",
)
def sentence_to_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices of all turns; shown by their shape, their sum, and a sum weighted by place."""
    turns = B.table(spark, sf_dir, "conversations").withColumn("text", F.lower("text"))
    # The most frequent words get the stored vectors.
    fitted = features.fit_vocabulary(B.conversations(spark, sf_dir))
    vocabulary = features.kept_words(fitted, features.NUM_WORDS)
    stored = vector_words(spark, sf_dir).drop("word")
    words = vocabulary.join(stored, vocabulary["idx"] - 2 == stored["vec_id"]).select("idx", "word", "vec")
    known = keep(features.with_special_rows(words, ["idx"], seed=None), "word_vectors")
    unknown = known.filter(F.col("word") == features.UNKNOWN_WORD).first()["idx"]
    length = features.padded_length(turns)
    matrices = features.sentence_to_matrix(turns, ["conv_id", "turn"], known, unknown, length)
    # A row of a matrix at a time: few bytes each, whatever the longest turn is.  The sums of a row of zeros are known.
    zeros = F.array_repeat(F.lit(0.0), known.agg(F.max(F.size("vec"))).first()[0])
    rows = matrices.select("conv_id", "turn", F.posexplode_outer("matrix").alias("pos", "vec")).select(
        "conv_id", "turn", "pos", F.size("vec").alias("n"), F.when(F.col("vec") != zeros, F.col("vec")).alias("vec"))
    key = matrices.select("conv_id", "turn").schema
    sums = rows.mapInArrow(_row_sums(), T.StructType([*key.fields, *schemas.fields(
        pos=T.IntegerType(), n=T.IntegerType(), total=T.DoubleType(), placed=T.DoubleType()).fields]))
    whole = F.count("total") == F.count("*")
    return sums.groupBy("conv_id", "turn").agg(
        F.count("pos").cast("int").alias("n_rows"),
        F.max_by("n", "pos").alias("n_columns"),
        F.when(whole, F.round(F.coalesce(F.sum("total"), F.lit(0.0)), 4)).alias("total"),
        F.when(whole, F.round(F.coalesce(F.sum("placed"), F.lit(0.0)), 2)).alias("placed"),
    )


OOV = f"""WITH {KNOWN},
t AS (SELECT doc_id, {B.WORDS_OF.format("text")} AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM t),
o AS (SELECT * FROM w WHERE word NOT IN (SELECT word FROM known))"""


def _oov(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = B.documents(spark, sf_dir)
    return features.unknown_words(documents, "doc_id", known_words(spark, sf_dir))


@query("oov_words", f"{OOV}\nSELECT doc_id, CAST(pos AS INTEGER) AS pos, word FROM o")
def oov_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _oov(spark, sf_dir).select("doc_id", "pos", "word")


@query(
    "oov_per_doc",
    f"""{OOV}
SELECT doc_id, coalesce(string_agg(word, ' ' ORDER BY pos), '') AS words, count(word) AS n_unknown
FROM documents LEFT JOIN o USING (doc_id) GROUP BY doc_id""",
)
def oov_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.unknown_per_text(_oov(spark, sf_dir), B.table(spark, sf_dir, "documents"), "doc_id")


@query("oov_totals", f"{OOV}\nSELECT count(*) AS total, count(DISTINCT word) AS distinct_words FROM o")
def oov_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.unknown_totals(_oov(spark, sf_dir))


SQL_COSINE = """round(list_dot_product({0}, {1})
         / nullif(sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})), 0), 6)"""
DOUBLES = """d AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec
               FROM embeddings)"""


@query(
    "cosine_pairs",
    f"""WITH {DOUBLES}
SELECT u.vec_id AS a, v.vec_id AS b, {SQL_COSINE.format("u.vec", "v.vec")} AS cosine
FROM d u JOIN d v ON v.vec_id = u.vec_id + 1""",
)
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = B.table(spark, sf_dir, "embeddings")
    pairs = embeddings.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    scored = vectors.cosine_of_pairs(pairs, embeddings, "a", "b", "vec_id", "embedding")
    return scored.select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(
    "cosine_topk",
    f"""WITH {DOUBLES},
q AS (SELECT label AS query, arg_min(vec, vec_id) AS qv FROM d GROUP BY label),
s AS (SELECT query, vec_id, {SQL_COSINE.format("qv", "vec")} AS cosine,
             row_number() OVER (PARTITION BY query ORDER BY {SQL_COSINE.format("qv", "vec")[6:-4]}
                                DESC NULLS LAST, vec_id) AS place
      FROM q CROSS JOIN d)
SELECT query, vec_id, cosine, CAST(place AS INTEGER) AS place FROM s WHERE place <= 5""",
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = B.table(spark, sf_dir, "embeddings")
    # The first vector of each label is asked for.
    queries = embeddings.groupBy(F.col("label").alias("query")).agg(
        F.min_by("embedding", "vec_id").alias("embedding")
    )
    near = vectors.most_similar(queries, embeddings, "vec_id", "embedding")
    return near.withColumn("cosine", F.round("cosine", 6))


@query(
    "cosine_topk_many",
    f"""WITH {DOUBLES},
s AS (SELECT q.vec_id AS query, d.vec_id, {SQL_COSINE.format("q.vec", "d.vec")} AS cosine,
             row_number() OVER (PARTITION BY q.vec_id ORDER BY round({SQL_COSINE.format("q.vec", "d.vec")[6:-4]}, 12)
                                DESC NULLS LAST, d.vec_id) AS place
      FROM d q CROSS JOIN d WHERE q.vec_id % 50 = 0)
SELECT query, vec_id, cosine, CAST(place AS INTEGER) AS place FROM s WHERE place <= 10""",
)
def cosine_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of each vector whose id is divisible by 50, among all; in several cells."""
    embeddings = B.table(spark, sf_dir, "embeddings")
    queries = embeddings.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query")
    near = vectors.most_similar(queries, embeddings, "vec_id", "embedding", k=10, cell_vectors=200, cell_queries=8)
    return near.withColumn("cosine", F.round("cosine", 6))


@query("cosine_index")
def cosine_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the index; its recall is measured in the tests."""
    embeddings = B.table(spark, sf_dir, "embeddings")
    queries = embeddings.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query")
    index = vectors.build_index(embeddings, "vec_id", "embedding", per_cell=50)
    near = vectors.search_index(index, queries, "embedding", k=10, probes=8)
    return near.withColumn("cosine", F.round("cosine", 6))


@query(
    "stored_indexer",
    f"""{SEQUENCES},
i AS (SELECT doc_id, coalesce(list(idx ORDER BY pos) FILTER (WHERE idx IS NOT NULL), []) AS a
      FROM t LEFT JOIN s USING (doc_id) GROUP BY doc_id)
SELECT doc_id, array_to_string((a || list_transform(range({LENGTH}), lambda x: 0))[:{LENGTH}], ' ') AS indices FROM i""",
)
def stored_indexer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexer and padder fitted, stored, loaded, and applied as loaded."""
    texts = B.documents(spark, sf_dir, "doc_id", "text")
    folder = new_folder(spark, "pipeline")
    indexer = stages.WordIndexer(inputCol="text", outputCol="indices", key=["doc_id"], numWords=features.NUM_WORDS)
    Pipeline(stages=[indexer, stages.Padder(inputCol="indices", outputCol="padded", length=LENGTH)]).fit(texts).save(folder)
    return PipelineModel.load(folder).transform(texts).select("doc_id", B.joined("padded").alias("indices"))


RANDOM = {"width": 64, "gamma": 0.5 / 64, "size": 32, "seed": 7}


def sql_kernel() -> str:
    """Kernel estimates of neighbouring vectors from the directions as lists."""
    rows = stages.directions(**RANDOM).tolist()
    features_ = "list_transform(w, lambda r: sqrt(2.0 / 32) * cos(list_dot_product(r[:64], vec) + r[65]))"
    return f"""WITH {DOUBLES},
w AS (SELECT {rows} AS w),
f AS (SELECT vec_id, {features_} AS f FROM d, w)
SELECT u.vec_id AS a, v.vec_id AS b, round(list_dot_product(u.f, v.f), 6) AS estimate
FROM f u JOIN f v ON v.vec_id = u.vec_id + 1"""


@query("rbf_kernel", sql_kernel())
def rbf_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = B.table(spark, sf_dir, "embeddings")
    mapped = stages.RandomFeatures(inputCol="embedding", outputCol="features", **RANDOM)
    rows = embeddings.select("vec_id", mapped.column(F.col("embedding")).alias("f"))
    pairs = embeddings.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    a, b = rows.select(F.col("vec_id").alias("a"), F.col("f").alias("u")), rows.select(F.col("vec_id").alias("b"), F.col("f").alias("v"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", F.round(A.dot(F.col("u"), F.col("v")), 6).alias("estimate"))
