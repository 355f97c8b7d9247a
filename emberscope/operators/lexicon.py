"""Lexicon loading and lexicon-based text scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.functions.scores import discretise_polarity, token_class, token_polarity
from emberscope.functions.text import clean_for_lexicon, clean_for_terms, tokenize
from emberscope.operators.dedupe import digest

INLINE_WORDS = 20_000
CONTAINS_WORDS = 64
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 48


def last_duplicate_wins(lexicon: DataFrame, order: str = "line_no") -> DataFrame:
    """One polarity per word: the one on its last line."""
    return lexicon.groupBy("word").agg(F.max_by("polarity", order).alias("polarity"))


def discretised(lexicon: DataFrame) -> DataFrame:
    """Graded polarity to +1 or -1; near-neutral words are dropped."""
    return lexicon.withColumn("polarity", discretise_polarity(F.col("polarity"))).filter(
        F.col("polarity") != 0
    )


def words_by_polarity(lexicon: DataFrame, max_words: int) -> dict[float, list[str]] | None:
    """Driver copy of a lexicon, for use as literals; None if it has more than ``max_words``."""
    rows = lexicon.select("word", F.col("polarity").cast("double").alias("p")).limit(max_words + 1).collect()
    if len(rows) > max_words:
        return None
    out: dict[float, list[str]] = {}
    for row in rows:
        out.setdefault(row["p"], []).append(row["word"])
    return {p: sorted(words) for p, words in sorted(out.items())}


def one_per_word(lexicon: DataFrame) -> DataFrame:
    """The last polarity of every word, by ``line_no`` where there is one."""
    order = "line_no" if "line_no" in lexicon.columns else F.monotonically_increasing_id()
    placed = lexicon.where("word IS NOT NULL").select("word", "polarity", (F.col(order) if isinstance(order, str) else order).alias("_line"))
    return placed.groupBy("word").agg(F.max_by("polarity", "_line").alias("polarity"))


def shards(lexicon: DataFrame, max_bytes: int = BROADCAST_BYTES) -> list[DataFrame]:
    """The lexicon in shares by hash of the word, as many as it takes for each to have at most ``max_bytes``.

    One aggregate counts rows and bytes, so every share that is broadcast is of proven size (but for chance, half as
    many again).
    """
    size = lexicon.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-(size["n"] * ROW_BYTES + size["bytes"]) // max_bytes))
    if parts == 1:
        return [lexicon]
    return [lexicon.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == i) for i in range(parts)]


def _by_text(posts: DataFrame, text: str) -> DataFrame:
    """The posts with the digest of their text, by which the score of a text finds all posts that have it."""
    first, second = digest([text], ("_t1", "_t2"))
    return posts.withColumns({"_t1": first, "_t2": second})


def _with_scores(posts: DataFrame, text: str, scores: DataFrame) -> DataFrame:
    keyed, found = _by_text(posts, text), scores.withColumnsRenamed({"_t1": "_s1", "_t2": "_s2"})
    same = (keyed["_t1"] == found["_s1"]) & (keyed["_t2"] == found["_s2"])
    return keyed.join(found, same, "left").drop("_t1", "_t2", "_s1", "_s2")


def _one_of(words: list[str]) -> Callable[[Column], Column]:
    return lambda token: token.isin(words)


def _weight(tokens: Column, by_polarity: dict[float, list[str]], positive: bool) -> Column:
    parts = [
        F.size(F.filter(tokens, _one_of(words))).cast("double") * abs(p)
        for p, words in by_polarity.items()
        if words and ((p > 0) if positive else (p < 0))
    ]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def token_weights(
    posts: DataFrame,
    lexicon: DataFrame,
    text: str,
    tokenizer: Callable[[Column], Column] = tokenize,
    inline_words: int = INLINE_WORDS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Positive weight, negative weight and token count per post.

    A lexicon of proven small size becomes literal word sets: every post is
    scored where it was read, without a join or a shuffle.  A larger one is
    broadcast in shares of proven size and probed by the tokens where the posts
    are read; only tokens of the lexicon are summed up, per text.  Either way
    every row gets its own score.  A word listed twice counts once, a null text
    has no tokens.
    """
    tokens = F.coalesce(tokenizer(clean_for_lexicon(F.col(text))), F.array().cast("array<string>"))
    lexicon = one_per_word(lexicon)
    by_polarity = words_by_polarity(lexicon, inline_words)
    if by_polarity is not None:
        listed = posts.withColumn("_tokens", tokens)
        return listed.withColumns(
            {
                "positive_score": _weight(F.col("_tokens"), by_polarity, True),
                "negative_score": _weight(F.col("_tokens"), by_polarity, False),
                "word_count": F.size("_tokens").cast("bigint"),
            }
        ).drop("_tokens")
    # No token is empty, so an empty one per post finds a row without polarity and counts the posts that share a text.
    exploded = _by_text(posts, text).select("_t1", "_t2", F.explode(F.array_append(tokens, F.lit(""))).alias("word"))
    marker = posts.sparkSession.sql("SELECT '' AS word, CAST(NULL AS DOUBLE) AS polarity")
    p = F.col("polarity")
    sums = [
        exploded.join(F.broadcast(share.select("word", p.cast("double").alias("polarity")).unionByName(marker)), "word")
        .groupBy("_t1", "_t2")
        .agg(F.sum(F.when(p > 0, p)).alias("up"), F.sum(F.when(p < 0, -p)).alias("down"), F.count_if(p.isNull()).alias("posts"))
        for share in shards(lexicon.where("word <> '' AND polarity IS NOT NULL"), max_bytes)
    ]
    scores = reduce(DataFrame.unionByName, sums)
    if len(sums) > 1:
        scores = scores.groupBy("_t1", "_t2").agg(F.sum("up").alias("up"), F.sum("down").alias("down"), F.max("posts").alias("posts"))
    return _with_scores(posts, text, scores).withColumns(
        {
            "positive_score": F.coalesce(F.col("up") / F.col("posts"), F.lit(0.0)),
            "negative_score": F.coalesce(F.col("down") / F.col("posts"), F.lit(0.0)),
            "word_count": F.size(tokens).cast("bigint"),
        }
    ).drop("up", "down", "posts")


def with_token_sentiment(
    posts: DataFrame,
    lexicon: DataFrame,
    text: str = "content",
    tokenizer: Callable[[Column], Column] = tokenize,
    inline_words: int = INLINE_WORDS,
) -> DataFrame:
    """Token-level dictionary sentiment: every occurrence counts."""
    scored = token_weights(posts, lexicon, text, tokenizer, inline_words)
    scored = scored.withColumn(
        "polarity", token_polarity(F.col("positive_score"), F.col("negative_score"))
    )
    return scored.withColumn("sentiment", token_class(F.col("polarity")))


def _grams(text: Column, length: int) -> Column:
    """Distinct substrings of ``length`` characters."""
    pattern = rf"(?s)(?![\uDC00-\uDFFF])(?=(.{{{length}}}))"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))


def substring_score(
    posts: DataFrame,
    lexicon: DataFrame,
    text: str = "content",
    contains_words: int = CONTAINS_WORDS,
    inline_words: int = INLINE_WORDS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Sum of the polarities of all lexicon words found anywhere in the text.

    Each word counts once per post.  A handful of words is tested with
    ``contains``; a larger lexicon is looked up among the distinct substrings
    of its word lengths; one too large for literals is indexed by its words'
    first two characters (see ``indexed_hits``).  Empty words are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lexicon = one_per_word(lexicon).where("word <> ''")
    known = words_by_polarity(lexicon, inline_words)
    size = sum(map(len, known.values())) if known is not None else None
    if size is not None and size <= contains_words:
        terms = [
            F.when(F.contains(body, F.lit(word)), F.lit(p)).otherwise(F.lit(0.0))
            for p, words in known.items()
            for word in words
        ]
        score = reduce(lambda a, b: a + b, terms, F.lit(0.0))
        return posts.withColumn("sentiment_score", score.cast("bigint"))
    if known is not None:
        by_length: dict[int, dict[float, list[str]]] = {}
        for p, words in known.items():
            for word in words:
                by_length.setdefault(len(word), {}).setdefault(p, []).append(word)
        out = posts
        score = F.lit(0.0)
        for length, by_polarity in sorted(by_length.items()):
            out = out.withColumn(f"_grams{length}", _grams(body, length))
            for p, words in by_polarity.items():
                hits = F.filter(F.col(f"_grams{length}"), _one_of(words))
                score = score + F.size(hits) * F.lit(p)
        return out.withColumn("sentiment_score", score.cast("bigint")).drop(
            *[f"_grams{n}" for n in by_length]
        )
    texts = _by_text(posts, text).select("_t1", "_t2", body.alias("body"))
    hits = reduce(DataFrame.unionByName, [indexed_hits(texts, share) for share in shards(lexicon, max_bytes)])
    scores = hits.groupBy("_t1", "_t2").agg(F.sum("polarity").cast("bigint").alias("sentiment_score"))
    scored = _with_scores(posts, text, scores)
    return scored.withColumn("sentiment_score", F.coalesce("sentiment_score", F.lit(0).cast("bigint")))


def indexed_hits(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(_t1, _t2, word, polarity): the words found in each text, once each; ``words`` is small enough to broadcast.

    Each position of a text is probed by its first two characters in an index of the lengths that words with this
    beginning have; only the substrings of those lengths are then looked up among the words, where the text is
    read.  Nothing but hits is shuffled.
    """
    beginning = F.substring("word", 1, 2)
    index = words.groupBy(beginning.alias("_begin")).agg(F.collect_set(F.char_length("word")).alias("_lengths"))
    longest = words.agg(F.coalesce(F.max(F.char_length("word")), F.lit(1))).first()[0]
    ahead = rf"(?s)(?![\uDC00-\uDFFF])(?=(.{{1,{longest}}}))"
    ahead = F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(ahead), 1))).alias("_ahead")
    places = texts.select("_t1", "_t2", ahead)
    # A word of one character begins with itself alone.
    begins = F.explode(F.array_distinct(F.array(F.substring("_ahead", 1, 2), F.substring("_ahead", 1, 1))))
    probed = places.withColumn("_begin", begins).join(F.broadcast(index), "_begin")
    lengths = F.explode(F.filter("_lengths", lambda n: n <= F.char_length("_ahead")))
    found = probed.select("_t1", "_t2", "_ahead", lengths.alias("_n")).select(
        "_t1", "_t2", F.col("_ahead").substr(F.lit(1), F.col("_n")).alias("word")
    )
    return found.join(F.broadcast(words.select("word", "polarity")), "word").select("_t1", "_t2", "word", "polarity").distinct()


def with_negative_flag(posts: DataFrame, score: str = "sentiment_score") -> DataFrame:
    return posts.withColumn("is_negative", F.col(score) < 0)


def term_frequency(
    posts: DataFrame,
    text: str = "content",
    order: str = "row_pos",
    tokenizer: Callable[[Column], Column] = tokenize,
) -> DataFrame:
    """Occurrences of each term and where it was first seen.

    The first position is one decimal number (post order, then offset), so
    both aggregates update in place and combine before the shuffle.
    """
    tokens = tokenizer(clean_for_terms(F.col(text)))
    exploded = posts.select(F.col(order).alias("_row"), F.posexplode(tokens).alias("_pos", "word"))
    place = (
        F.col("_row").cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
        + F.col("_pos").cast("decimal(10,0)")
    ).cast("decimal(32,0)")
    return exploded.groupBy("word").agg(
        F.count(F.lit(1)).alias("count"), F.min(place).alias("first_seen")
    )


def top_terms(posts: DataFrame, n: int = 30, **kwargs) -> DataFrame:
    """The ``n`` most frequent terms; ties go to the term seen first."""
    return (
        term_frequency(posts, **kwargs)
        .orderBy(F.desc("count"), F.asc("first_seen"))
        .limit(n)
        .select("word", "count")
    )
