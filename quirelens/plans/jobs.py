"""The jobs a user runs: page matches, topic modelling, topics over time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import LDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelens.functions import text as tx
from quirelens.operators import cleaning, coherence as co, inspection as ins, joins, keywords, overtime
from quirelens.operators import pages as pg, phrases as ph, tokens as tk, topics as tp, volumes
from quirelens.operators.scale import BROADCAST_ROWS, dealt_rows, drop_stage, durable, fits_broadcast, stage
from quirelens.sources import writers


def full_page_sentences(
    pages: DataFrame,
    running_lines: bool = True,
    repeats: int = 2,
    within: int = 5,
    abbreviations: tuple[str, ...] = (),
) -> DataFrame:
    """Clean pages, split them into sentences, repair sentences across page breaks."""
    long_volumes = pg.has_long_volumes(pages)
    lines = pages.withColumn("text", tx.normalise_lines(F.col("text")))
    if running_lines:
        lines = pg.strip_running_lines(lines, repeats, within, keep_block=True)
    return pg.stitch_pages(
        pg.sentence_pages(lines, abbreviations), long_volumes=long_volumes
    )


def flat_pages(sentences: DataFrame) -> DataFrame:
    """``(volid, seq, text)`` with tab-joined sentences."""
    return sentences.select(
        "volid", "seq", tx.flatten_sentences(F.col("sentences")).alias("text")
    )


def page_matches(
    pages: DataFrame, patterns: keywords.Patterns | DataFrame, **options
) -> DataFrame:
    """Pages with at least one keyword: ``text, volid, seq`` and a count per keyword.

    A pattern that the regex engine refuses is left out; ``refused_patterns`` names it.
    """
    good, _ = keywords.split_patterns(pages, patterns)
    return keywords.wide_matches(flat_pages(full_page_sentences(pages, **options)), good)


def refused_patterns(pages: DataFrame, patterns: keywords.Patterns | DataFrame) -> DataFrame:
    """Quarantine of ``page_matches``: ``(name, pattern, reason)`` of bad patterns."""
    return keywords.split_patterns(pages, patterns)[1]


def noun_phrase_report(
    pages: DataFrame,
    stop_words: DataFrame | Sequence[str] | None = None,
    lemmas: DataFrame | None = None,
    more_than: int = 10,
) -> DataFrame:
    """``(noun_phrase, count)`` of multi-word phrases, most frequent first."""
    stops = cleaning.stop_list(stop_words)
    # only the text is needed, and one deal serves both look-ups
    pages = pages.select("text")
    tokens = cleaning.page_tokens(dealt_rows(pages) if lemmas is not None or stops is None else pages)
    if lemmas is not None:
        tokens = tk.lemmatise(tokens, lemmas)
    if stops is None:
        # a mark is no word, so it ends a run as a stop word does
        table = cleaning.stop_table(pages, stop_words)
        tokens = tk.mark_words(tokens, table, mark=cleaning.SENTENCE_BREAK, lower=True)
    found = tokens.select(
        F.explode(tx.candidate_phrases(F.col("tokens"), stops or [])).alias("phrase")
    )
    return ph.phrase_counts(found, more_than)


clean_pages = cleaning.preprocess_pages


def outlier_report(pages: DataFrame, min_pages: int, max_pages: int) -> DataFrame:
    """``(token, num_pages)`` of tokens on too few or too many pages."""
    tokens = pages.select(tx.whitespace_tokens(F.col("text")).alias("tokens"))
    return tk.outlier_tokens(tk.page_frequency(tokens), min_pages, max_pages)


def remove_outliers(
    pages: DataFrame, min_pages: int, max_pages: int, in_place: bool = False, **options
) -> DataFrame:
    """Outlier report, then those tokens dropped from every page.

    Rare tokens are most of a vocabulary, so the tokens that stay are the shorter
    list; when they can be broadcast they decide, and with ``in_place`` only they are
    written.  Pages are read twice here: pass a written stage, not a long lineage.
    """
    tokens = pages.select(tx.whitespace_tokens(F.col("text")).alias("tokens"))
    frequency, stay = tk.page_frequency(tokens), F.col("num_pages").between(min_pages, max_pages)
    if in_place:
        kept = stage(frequency.where(stay).select("token"))
        if fits_broadcast(kept, options.get("max_broadcast_rows", BROADCAST_ROWS)):
            return tk.keep_words(pages, kept)
    frequency = durable(frequency)
    outliers = tk.outlier_tokens(frequency, min_pages, max_pages).select("token")
    kept = frequency.where(stay).select("token")
    return tk.remove_words(pages, outliers, kept=kept, in_place=in_place, **options)


@dataclass
class TopicModel:
    vocabulary: CountVectorizerModel
    model: LDAModel
    log_likelihood: float
    log_perplexity: float
    result: DataFrame


def topic_features(
    pages: DataFrame,
    excluded: DataFrame | None = None,
    partitions: int | None = None,
    scratch: Sequence[DataFrame] = (),
    **vocabulary,
) -> tuple[CountVectorizerModel, DataFrame]:
    """Vocabulary, and feature vectors in a layout that depends on the keys only.

    The pages are read once: the vocabulary and the vectors are made from the tokens that
    are written here.  Then the ``scratch`` stages that the pages came from are deleted.
    """
    vocab, vectors = page_vectors(pages, excluded, scratch, **vocabulary)
    return vocab, tp.fixed_layout(vectors, partitions)


def page_vectors(
    pages: DataFrame, excluded: DataFrame | None = None, scratch: Sequence[DataFrame] = (), **vocabulary
) -> tuple[CountVectorizerModel, DataFrame]:
    """Vocabulary, and tokens and feature vectors of the pages where their tokens are written."""
    if excluded is not None:
        pages = joins.exclude_pages(pages, excluded)
    tokens = stage(tp.tokenised(pages).drop("text"))
    for table in scratch:
        drop_stage(table)
    vocab = tp.fit_vocabulary(tokens, **vocabulary)
    return vocab, tp.vectorise(vocab, tokens)


def topic_model(
    pages: DataFrame,
    k: int,
    excluded: DataFrame | None = None,
    seed: int = tp.SEED,
    output: str | None = None,
    minibatch: bool = False,
    vocabulary: dict | None = None,
    partitions: int | None = None,
    scratch: Sequence[DataFrame] = (),
    **options,
) -> TopicModel:
    """Vocabulary, LDA model, scores and topic distribution of all pages.

    ``vocabulary`` goes to ``fit_vocabulary`` (``size``, ``min_pages``); ``partitions``
    fixes the layout that a seed repeats on, whatever the cluster; ``scratch`` has stages
    to delete once the pages are read; ``options`` go to the fit: of LDA, or ``chunk`` and
    ``passes`` of the minibatch one.
    """
    vocab, features = page_vectors(pages, excluded, scratch, **(vocabulary or {}))
    # fit and score read the vectors only, and only the fit asks for a layout
    held = tp.held(tp.fixed_layout(features, partitions).select("features"))
    try:
        fit = tp.fit_topics_minibatch if minibatch else tp.fit_topics
        model = fit(held, k, seed, **options)
        likelihood, perplexity = tp.score_topics(model, held)
    finally:
        held.unpersist()
    result = tp.assign_topics(model, features).drop("text", "features")
    if output is not None:
        writers.save_model(output, vocab, model)
        writers.write_result(result, f"{output}/result")
    return TopicModel(vocab, model, likelihood, perplexity, result)


def topics_over_time(pages: DataFrame, catalogue: DataFrame, labels: DataFrame) -> DataFrame:
    """``(year, topic, norm_weight, topic_terms)`` in order.

    ``pages(htid, seq, weights)``; sums per (year, topic) feed both sides of the
    total join and are small, so they are made once.
    """
    by_topic = overtime.topic_weight_by_year(pages, catalogue)
    return overtime.topics_by_year(by_topic, labels)


def model_coherence(fitted: TopicModel, terms: int = 20, window: int = co.WINDOW) -> DataFrame:
    """``(topic, coherence)`` of a fitted model on the tokens it was fitted on.

    The topics are their ``terms`` heaviest terms; any number will do.
    """
    return co.coherence_cv(fitted.result.select("volid", "seq", "tokens"), heaviest_terms(fitted, terms), window)


def heaviest_terms(fitted: TopicModel, terms: int = 20) -> DataFrame:
    """``(topic, term)`` of the heaviest terms of each topic."""
    found = fitted.model.describeTopics(int(terms)).select("topic", F.explode("termIndices").alias("term_index"))
    words = tp.vocabulary_table(found.sparkSession, fitted.vocabulary)
    return found.join(words, "term_index").select("topic", "term")


def topic_tables(fitted: TopicModel) -> dict[str, DataFrame]:
    """The five tables behind a topic browser, none of which passes through the driver.

    ``topic_terms(topic, term_index, weight)`` with weights summing to 1 per topic,
    ``page_topics(volid, seq, topic, weight)``, ``lengths(volid, seq, doc_length)``,
    ``vocabulary(term_index, term)`` and ``frequency(term_index, term, n)``.
    """
    vocabulary = tp.vocabulary_table(fitted.result.sparkSession, fitted.vocabulary)
    return {
        "topic_terms": ins.topic_term_table(fitted.model),
        "page_topics": ins.page_topic_table(fitted.result),
        "lengths": tk.document_lengths(fitted.result),
        "vocabulary": vocabulary,
        "frequency": tk.term_frequency(fitted.result, vocabulary),
    }


topic_extremes = overtime.representative_pages


def volume_info(ids: DataFrame, files: DataFrame, strict: bool = False) -> DataFrame:
    """``(id, last_seq)`` of the listed volumes, from their metadata files."""
    return volumes.volume_last_seq(volumes.locate_mets(ids, files), strict)
