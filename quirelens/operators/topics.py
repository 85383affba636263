"""Vocabulary, feature vectors and LDA topic models (Spark ML)."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from threading import Condition

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelens.functions import text as tx
from quirelens.operators.scale import durable, stage, stage_path, term_table
from quirelens.operators.tokens import bag_of_words

# Model seed, and the topic numbers tried by the sweep.
SEED = 100
SWEEP_K = (2, 4, 6, 8, 10, 14, 18, 22, 26, 30, 35, 40, 50)
# Fixed values of the minibatch parameter set.
PASSES = 10
CHUNK = 10_000
# Pages of a chunk that a task takes: each task makes a matrix of topics x vocabulary.
TASK_PAGES = 1_000
# Fixed value: longest vocabulary.
VOCABULARY = 2**18
# Numbers that the scoring of pages works on at a time, and the log of the least double.
ENTRIES = 2**20
_LEAST_LOG = -745.0
# Matrices of topics x vocabulary that the driver makes in an update of a fit.
FIT_MATRICES = 10


def tokenised(pages: DataFrame) -> DataFrame:
    """Pages with text, and their tokens; an empty page counts as one without text."""
    return pages.where(F.col("text") != "").withColumn(
        "tokens", tx.tokenise(F.col("text"))
    )


def fit_vocabulary(
    pages: DataFrame, tokens: str = "tokens", size: int = VOCABULARY, min_pages: int = 1
) -> CountVectorizerModel:
    """The ``size`` most frequent terms of the corpus, ties in term order.

    Counted here rather than by ``CountVectorizer.fit``, which numbers equally
    frequent terms by chance: with a fixed numbering a model can be repeated.
    """
    if min_pages > 1:
        counts = (
            bag_of_words(pages, tokens)
            .groupBy("term")
            .agg(F.sum("n").alias("n"), F.count("*").alias("pages"))
            .where(F.col("pages") >= min_pages)
            .drop("pages")
        )
    else:
        counts = (
            pages.select(F.explode(tokens).alias("term"))
            .groupBy("term")
            .agg(F.count("*").alias("n"))
        )
    first = most_frequent(counts, size).toArrow().to_pylist()
    words = [r["term"] for r in sorted(first, key=lambda r: (-r["n"], r["term"].encode()))]
    return vocabulary_model(pages.sparkSession, words, tokens)


def most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """The ``size`` rows of ``counts(term, n)`` with the largest ``n``, ties in term order.

    Nothing is ranked as a whole: a histogram of ``n`` gives the least count that fits
    whole, and of the terms with the next lower one, sorted over the cluster, each part
    keeps its share by the number of terms in the parts before it.
    """
    counts = durable(counts.select("term", "n"))
    histogram = counts.groupBy("n").agg(F.count("*").alias("terms")).orderBy(F.desc("n")).limit(size)
    above, edge, taken = None, None, 0
    for r in histogram.collect():
        if taken + r["terms"] > size:
            edge = r["n"]
            break
        above, taken = r["n"], taken + r["terms"]
    whole = counts.where(F.col("n") >= above) if above is not None else counts.limit(0)
    if edge is None or taken == size:
        return whole
    ties = stage(
        counts.where(F.col("n") == edge)
        .orderBy("term")
        .select("*", F.monotonically_increasing_id().alias("_at"))
    )
    # the number holds the part and the place in it
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    left, keep = size - taken, F.lit(False)
    for r in ties.groupBy(part.alias("part")).agg(F.count("*").alias("terms")).orderBy("part").collect():
        keep = keep | ((part == r["part"]) & (place < left))
        left -= r["terms"]
        if left <= 0:
            break
    return whole.unionByName(ties.where(keep).select("term", "n"))


def vocabulary_model(spark: SparkSession, words: list[str], tokens: str) -> CountVectorizerModel:
    """``CountVectorizerModel.from_vocabulary``, with the words handed to the JVM in one
    call instead of one call per word."""
    if not words:
        raise ValueError("no page has a term to model")
    jvm = spark._jvm
    # a separator that no word can hold
    mark = uuid.uuid4().hex
    while any(mark in w for w in words):
        mark = uuid.uuid4().hex
    array = jvm.java.util.regex.Pattern.compile(mark).split(mark.join(words), -1)
    model = CountVectorizerModel(jvm.org.apache.spark.ml.feature.CountVectorizerModel(array))
    return model.setInputCol(tokens).setOutputCol("features")


def vectorise(vocabulary: CountVectorizerModel, pages: DataFrame) -> DataFrame:
    return vocabulary.transform(pages)


def vector_terms(features: DataFrame, keys: Sequence[str] = ("volid", "seq")) -> DataFrame:
    """``(keys, term_index, n)``: the non-zero entries of sparse feature vectors."""
    raw = F.unwrap_udt("features")
    pairs = F.arrays_zip(
        raw["indices"].alias("term_index"), raw["values"].alias("value")
    )
    return features.select(*keys, F.explode(pairs).alias("_e")).select(
        *keys,
        F.col("_e.term_index").alias("term_index"),
        F.col("_e.value").cast("long").alias("n"),
    )


def vocabulary_table(spark: SparkSession, vocabulary: CountVectorizerModel) -> DataFrame:
    """``(term_index, term)``; the vocabulary is bounded by its model parameter."""
    return term_table(spark, vocabulary.vocabulary)


def fixed_layout(features: DataFrame, partitions: int | None = None) -> DataFrame:
    """Features in a layout that depends on the keys and on ``partitions`` only.

    LDA with a fixed seed repeats only on identical partitions, so pages are hashed into
    a number of partitions and sorted inside each.  Without ``partitions`` that number is
    the cluster's; give it to repeat a model on another cluster.
    """
    spark = features.sparkSession
    n = partitions or max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    return features.repartition(n, "volid", "seq").sortWithinPartitions("volid", "seq")


def held(features: DataFrame) -> DataFrame:
    """Keep features for the passes of fit, scoring and transform.

    Spills to disk, and lost blocks are rebuilt from lineage.
    """
    return features.persist(StorageLevel.MEMORY_AND_DISK)


def fit_topics(features: DataFrame, k: int, seed: int | None = SEED, **options) -> LDAModel:
    """LDA with ``k`` topics (online optimiser)."""
    lda = LDA(k=k, **options)
    if seed is not None:
        lda = lda.setSeed(seed)
    return lda.fit(features)


def fit_topics_minibatch(
    features: DataFrame,
    k: int,
    seed: int = SEED,
    chunk: int = CHUNK,
    passes: int = PASSES,
    **options,
) -> LDAModel:
    """Second parameter set: ``passes`` over the corpus in chunks of about ``chunk`` pages.

    Pages are dealt into chunks once, by their place in the layout, and written by chunk;
    an update reads its own chunk, so that a pass reads every page once.
    """
    n = features.count()
    chunks = max(1, math.ceil(n / chunk))
    if chunks == 1:
        return fit_topics(features, k, seed, optimizer="online", subsamplingRate=1.0, maxIter=passes, **options)
    lda = ChunkedLDA(k=k, optimizer="online", maxIter=passes * chunks, **options).setSeed(seed)
    lda.passes, lda.parts = passes, dealt_chunks(features.select("features"), chunks, chunk)
    return lda.fit(features)


def dealt_chunks(features: DataFrame, chunks: int, chunk: int = CHUNK) -> list[tuple[DataFrame, int]]:
    """Pages in ``chunks`` parts of a written table, each with its number of pages.

    A part is a file for each task of its update.
    """
    spark = features.sparkSession
    place = F.xxhash64(F.monotonically_increasing_id())
    dealt = features.withColumn("_chunk", F.pmod(place, F.lit(chunks)).cast("int"))
    path = stage_path(spark)
    files = chunk_tasks(spark, chunk)
    (
        dealt.repartition(chunks, "_chunk").sortWithinPartitions("_chunk").write
        # room for a part that is larger than most
        .option("maxRecordsPerFile", math.ceil(1.05 * chunk / files))
        .option("compression", "zstd").partitionBy("_chunk").parquet(path)
    )
    pages = spark.read.schema(dealt.schema).parquet(path).groupBy("_chunk").agg(F.count("*").alias("n"))
    return [
        (spark.read.schema(features.schema).parquet(f"{path}/_chunk={r['_chunk']}"), r["n"])
        for r in sorted(pages.collect(), key=lambda r: r["_chunk"])
    ]


def chunk_tasks(spark: SparkSession, pages: int) -> int:
    return max(1, min(spark.sparkContext.defaultParallelism, round(pages / TASK_PAGES)))


class ChunkedLDA(LDA):
    """The library's online optimiser, given the corpus chunk by chunk.

    ``LDA`` itself samples the pages of every update by a scan of all of them.
    """

    passes = 1
    parts: Sequence[tuple[DataFrame, int]] = ()

    def _fit_java(self, dataset: DataFrame):
        self._transfer_params_to_java()
        spark, own = dataset.sparkSession, self._java_obj
        jvm = spark._jvm
        old = jvm.org.apache.spark.mllib.clustering.LDA()
        old.setK(own.getK()).setSeed(own.getSeed())
        prior = jvm.org.apache.spark.mllib.linalg.Vectors.fromML(own.getOldDocConcentration())
        old.setDocConcentration(prior).setTopicConcentration(own.getOldTopicConcentration())
        rows = getattr(getattr(jvm.org.apache.spark.ml.clustering, "LDA$"), "MODULE$").getOldDataset
        optimizer, n = own.getOldOptimizer(), sum(pages for _, pages in self.parts)
        optimizer.initialize(rows(dataset._jdf, self.getFeaturesCol()), old)
        chunks = [(rows(part._jdf, self.getFeaturesCol()), pages) for part, pages in self.parts]
        for _ in range(self.passes):
            for chunk, pages in chunks:
                optimizer.setMiniBatchFraction(pages / n)
                optimizer.submitMiniBatch(chunk.coalesce(chunk_tasks(spark, pages), False, jvm.scala.Option.empty(), None))
        found = optimizer.getLDAModel(spark.sparkContext._gateway.new_array(jvm.double, 0))
        model = jvm.org.apache.spark.ml.clustering.LocalLDAModel(own.uid(), found.vocabSize(), found, spark._jsparkSession)
        return own.copyValues(model, jvm.org.apache.spark.ml.param.ParamMap()).setParent(own)


def score_topics(model: LDAModel, features: DataFrame) -> tuple[float, float]:
    """Lower bound on the log likelihood, upper bound on the log perplexity.

    The bound of ``LDAModel.logLikelihood``, which takes the exponential of the whole
    topic matrix for every page: pages x vocabulary x topics.  Here a page's topic weights
    come from ``transform``, which takes it once, and its part of the bound from its own
    terms.  The perplexity is the bound per token, which saves a second pass of the bound.
    """
    sc = features.sparkSession.sparkContext
    topics = model.topicsMatrix().toArray()
    alpha, eta = np.asarray(model.estimatedDocConcentration().toArray()), _topic_concentration(model)
    elog, own = np.empty_like(topics), topic_bound(topics, eta)
    whole = digamma(topics.sum(axis=0))
    for a, b in _slices(*topics.shape):
        elog[a:b] = digamma(topics[a:b]) - whole
    del topics
    shared = sc.broadcast((alpha, elog))
    raw = F.unwrap_udt("features")
    every = F.sequence(F.lit(0), F.size(raw["values"]) - 1)
    pages = model.transform(features.select("features")).select(
        vector_to_array("topicDistribution").alias("share"),
        # a dense vector has no list of indices
        F.when(F.size(raw["values"]) > 0, F.coalesce(raw["indices"], every)).alias("indices"),
        raw["values"].alias("counts"),
    )

    def bounds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "bound": pa.array([page_bound(*shared.value, batch)], pa.float64()),
                "tokens": pa.array([_flat(batch["counts"]).sum()], pa.float64()),
            })

    try:
        found = pages.mapInArrow(bounds, "bound double, tokens double").agg(F.sum("bound"), F.sum("tokens")).first()
    finally:
        shared.unpersist()
    likelihood, total = (found[0] or 0.0) + own, found[1]
    return likelihood, -likelihood / total if total else float("nan")


def _topic_concentration(model: LDAModel) -> float:
    """The prior of the topics' terms: as set, or what the optimiser takes without it."""
    if model.isSet("topicConcentration"):
        return model.getTopicConcentration()
    return 1.1 if model.getOptimizer() == "em" else 1.0 / model.getK()


def topic_bound(topics: np.ndarray, eta: float) -> float:
    """The topics' part of the bound; ``topics`` is terms x topics, taken some terms at a time."""
    terms, k = topics.shape
    whole, own = digamma(topics.sum(axis=0)), -terms * k * math.lgamma(eta)
    for a, b in _slices(terms, k):
        part = topics[a:b]
        own += float(np.sum((eta - part) * (digamma(part) - whole)) + np.sum(lgamma(part)))
    return own + k * math.lgamma(terms * eta) - float(np.sum(lgamma(topics.sum(axis=0))))


def page_bound(alpha: np.ndarray, elog: np.ndarray, batch: pa.RecordBatch) -> float:
    """The part in the bound of a batch of pages ``(share, indices, counts)``.

    A page's variational parameters sum to its tokens and ``alpha``, so its shares give
    them back.  The entries are taken some at a time, whatever a page holds.
    """
    k = len(alpha)
    share, term, n = _flat(batch["share"]).reshape(-1, k), _flat(batch["indices"]), _flat(batch["counts"])
    page = np.repeat(np.arange(len(batch)), np.diff(batch["counts"].offsets.to_numpy()))
    # a term whose weights are all below the least double adds nothing to its page
    known = np.concatenate([(elog[term[a:b]] > _LEAST_LOG).any(axis=1) for a, b in _slices(len(term), k)] or [term])
    tokens = np.bincount(page, weights=n * known, minlength=len(batch))
    full = share.sum(axis=1) > 0
    gamma = np.where(full[:, None], share * (tokens + alpha.sum())[:, None], 1.0)
    whole = gamma.sum(axis=1)
    expected = digamma(gamma) - digamma(whole)[:, None]
    own = ((alpha - gamma) * expected + lgamma(gamma)).sum(axis=1) - lgamma(whole)
    own += math.lgamma(alpha.sum()) - sum(map(math.lgamma, alpha))
    total = float(own[full].sum())
    for a, b in _slices(len(term), k):
        logs = elog[term[a:b]] + expected[page[a:b]]
        top = logs.max(axis=1)
        total += float(np.dot(n[a:b] * full[page[a:b]], top + np.log(np.exp(logs - top[:, None]).sum(axis=1))))
    return total


def _flat(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _slices(n: int, k: int) -> list[tuple[int, int]]:
    step = max(1, ENTRIES // k)
    return [(a, min(n, a + step)) for a in range(0, n, step)]


def digamma(x: np.ndarray) -> np.ndarray:
    """Logarithmic derivative of the gamma function, for positive numbers."""
    x = np.asarray(x, float)
    below = sum(1.0 / (x + i) for i in range(10))
    x = x + 10
    y = 1.0 / (x * x)
    series = y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
    return np.log(x) - 0.5 / x - series - below


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function, for positive numbers."""
    x = np.asarray(x, float)
    below = sum(np.log(x + i) for i in range(10))
    x = x + 10
    y = 1.0 / (x * x)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - below


def assign_topics(model: LDAModel, features: DataFrame) -> DataFrame:
    """Topic distribution per page; a page without a known term gets zeros."""
    return model.transform(features)


def fit_room(spark: SparkSession) -> int:
    """Bytes of the driver's heap for the matrices of the fits under way."""
    return spark._jvm.java.lang.Runtime.getRuntime().maxMemory() // 2


def sweep_k(
    features: DataFrame,
    ks: Sequence[int] = SWEEP_K,
    seed: int | None = None,
    side_by_side: int = 4,
    **options,
) -> DataFrame:
    """Fit and score a model per ``k`` over the same held features: ``(k, log_likelihood, log_perplexity)``.

    A fit is a chain of short jobs with work on the driver in between, so
    up to ``side_by_side`` fits share the cluster, largest ``k`` first, each in a scheduler
    pool of its own.  The driver holds some topic matrices of every fit, so a fit waits
    until those under way leave it room; scores do not depend on it.
    """
    kept = held(features.select("features"))
    spark = features.sparkSession
    room, taken, changed = fit_room(spark), 0, Condition()

    def one(k: int) -> tuple[int, float, float]:
        nonlocal taken
        need = FIT_MATRICES * 8 * k * terms
        with changed:
            changed.wait_for(lambda: taken == 0 or taken + need <= room)
            taken += need
        try:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"sweep-{k}")
            return (k, *map(float, score_topics(fit_topics(kept, k, seed, **options), kept)))
        finally:
            with changed:
                taken -= need
                changed.notify_all()

    try:
        # held before the fits start, so that none of them makes it again
        raw = F.unwrap_udt("features")
        terms = kept.agg(F.max(F.coalesce(raw["size"], F.size(raw["values"])))).first()[0] or 0
        with ThreadPoolExecutor(max(1, side_by_side)) as pool:
            work = inheritable_thread_target(spark)(one)
            rows = list(pool.map(work, sorted(ks, reverse=True)))
    finally:
        kept.unpersist()
    return spark.createDataFrame(sorted(rows), "k int, log_likelihood double, log_perplexity double")


def model_info(model: LDAModel) -> dict[str, int]:
    return {"vocabulary_size": model.vocabSize(), "topics": model.getK()}
