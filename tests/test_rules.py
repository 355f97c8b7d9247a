"""Hand-made frames for each rule, with literal expected rows."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from emberscope.functions import composites as comp
from emberscope.functions import scores as sc
from emberscope.functions import text as tx
from emberscope.functions import times as tm
from emberscope.functions.columns import finite_or_zero, require_columns, resolve_column
from emberscope.operators import cleaning as cl
from emberscope.operators import dedupe as dd
from emberscope.operators import features as feat
from emberscope.operators import labels as lab
from emberscope.operators import lexicon as lex
from emberscope.operators import metrics as met
from emberscope.operators import reports as rep
from emberscope.operators import series as ser
from emberscope.operators import sizing as siz
from emberscope.operators import splits as sp
from emberscope.sources import posts as src

C = F.col


def at(day, hour=0, minute=0, second=0):
    return dt.datetime(2024, 1, day, hour, minute, second)


def one(spark, value, schema="string"):
    return spark.createDataFrame([(value,)], f"x {schema}")


def evaluate(spark, column, value, schema="string"):
    return one(spark, value, schema).select(column(C("x"))).first()[0]


def timed(spark, rows, schema):
    return spark.createDataFrame(rows, f"topic string, timestamp timestamp_ntz, {schema}")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_time_parsing(spark):
    local = lambda s: evaluate(spark, tm.to_local, s)
    assert local("2023-01-29T14:25:37.000Z") == dt.datetime(2023, 1, 29, 23, 25, 37)
    assert local("2023-01-29 14:25:37") == dt.datetime(2023, 1, 29, 23, 25, 37)
    assert local("2023-01-29 14:25:37+09:00") == dt.datetime(2023, 1, 29, 14, 25, 37)
    assert local("2023-01-29T14:25:37-0130") == dt.datetime(2023, 1, 30, 0, 55, 37)
    assert local("2023-01-29") == dt.datetime(2023, 1, 29, 9)
    assert local("not a date") is None and local(None) is None


def test_counts_are_coerced(spark):
    got = [evaluate(spark, cl.to_count, v) for v in ("abc", "7.9", None, "-3.2", "12", "NaN", "inf")]
    assert got == [0, 7, 0, -3, 12, 0, 0]


def test_missing_columns_become_null(spark):
    raw = spark.createDataFrame([("1", "a\nb\rc")], "id string, content string")
    out = cl.standardize_posts(raw).first()
    assert (out.tweet_id, out.content, out.url, out.like_count, out.timestamp) == ("1", "a bc", None, 0, None)


def test_undated_posts_are_counted_and_dropped(spark):
    df = spark.createDataFrame([(at(1),), (None,)], "timestamp timestamp_ntz")
    assert cl.drop_undated(df).count() == 1
    assert tuple(cl.undated_count(df).first()) == (2, 1)


def test_text_cleaning(spark):
    assert evaluate(spark, tx.clean_for_terms, "RT @abc_1 見て http://x.y/z\tすごい\n") == " 見て  すごい ".replace("RT ", "")
    assert evaluate(spark, tx.clean_for_lexicon, "@名前 #タグ 良い https://t.co/あ") == "  良い "
    assert evaluate(spark, tx.collapse_spaces, "　a \n b ") == "a b"
    assert evaluate(spark, tx.collapse_spaces, None) == ""
    assert evaluate(spark, tx.tokenize, "né_1, 松本!") == ["né_1", "松本"]


def test_file_names(spark):
    names = {
        "tweets_foo_20251112_093317.csv": "foo",
        "tweets_foo_bar_1.csv": "foo_bar",
        "tweets_123.csv": "tweets_123",
        "other_9.csv": "other_9",
    }
    for name, want in names.items():
        assert evaluate(spark, src.query_from_file_name, name) == want
    paths = {
        "data/original/松本/x.csv": "松本",
        "a/outputs/topic/x.csv": "topic",
        "data/original/foo_sentiment_1h.csv": "foo",
        "x/foo_20240101_stance.csv": "foo",
        "x/2024.csv": "unknown",
    }
    for path, want in paths.items():
        assert evaluate(spark, src.topic_from_path, path) == want


def test_column_choice(spark):
    df = spark.createDataFrame([(1, "a")], "body int, text string")
    assert resolve_column(df, ["content", "text", "body"]) == "text"
    assert resolve_column(df, ["content"], fall_back_to_first=True) == "body"
    for bad in (lambda: resolve_column(df, ["content"]), lambda: require_columns(df, ["content"])):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError("expected ValueError")


def test_finite_or_zero(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (None,), (1.5,)], "x double")
    assert [r[0] for r in df.select(finite_or_zero(C("x"))).collect()] == [0, 0, 0, 0, 1.5]


def test_labels_and_bands(spark):
    df = spark.createDataFrame([(0.4, 0.2, 0.4), (0.2, 0.4, 0.4), (0.1, 0.2, 0.7)], "p double, u double, n double")
    label = sc.argmax_label([("POSITIVE", C("p")), ("NEUTRAL", C("u")), ("NEGATIVE", C("n"))])
    assert [r[0] for r in df.select(label).collect()] == ["POSITIVE", "NEUTRAL", "NEGATIVE"]
    cut = sc.threshold_label(C("n"), C("p"))
    assert [r[0] for r in df.select(cut).collect()] == ["NEGATIVE", "NEGATIVE", "NEGATIVE"]
    levels = [(0.999, 99, "critical"), (0.6, 60, "high"), (0.4, 40, "medium"), (0.2, 20, "low"), (0.199, 19, "normal")]
    for p, score, level in levels:
        s = one(spark, p, "double").select(sc.percent_score(C("x")).alias("s")).select("s", sc.score_level(C("s"))).first()
        assert tuple(s) == (score, level)
    for polarity, want in ((0.1, "neutral"), (0.11, "positive"), (-0.1, "neutral"), (-0.2, "negative")):
        assert evaluate(spark, sc.token_class, polarity, "double") == want
    for polarity, want in ((0.5, 0), (-0.5, 0), (0.51, 1), (-0.51, -1)):
        assert evaluate(spark, sc.discretise_polarity, polarity, "double") == want


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([(900, 0), (0, 0), (3, 5)], "p int, n int")
    probs = sc.softmax({"p": C("p"), "u": F.lit(0), "n": C("n")})
    for r in df.select(*probs.values()).collect():
        assert math.isclose(sum(r), 1.0)


LEXICON = [("良い", 1, 1), ("悪い", -1, 2), ("良い", -1, 3), ("い", 1, 4), ("とても良い", 1, 5)]


def lexicon(spark):
    return lex.last_duplicate_wins(spark.createDataFrame(LEXICON, "word string, polarity int, line_no int"))


def test_last_duplicate_wins(spark):
    assert {r.word: r.polarity for r in lexicon(spark).collect()}["良い"] == -1


def test_substring_scores_agree(spark):
    texts = ["とても良い。良い良い", "悪い悪い", "", None, "😀い", "無"]
    posts = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "tweet_id string, content string")
    words = {r.word: r.polarity for r in lexicon(spark).collect()}
    want = [sum(p for w, p in words.items() if w in (t or "")) for t in texts]
    large = {"contains_words": 0, "inline_words": 0}
    for limits in ({}, {"contains_words": 0}, large, {**large, "max_bytes": 100}):
        got = lex.substring_score(posts, lexicon(spark), **limits).orderBy("tweet_id").collect()
        assert [r.sentiment_score for r in got] == want, limits


def test_token_scores_agree(spark):
    texts = ["良い 悪い 悪い x", "い い", "none", None, ""]
    posts = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "tweet_id string, content string")
    want = [(0.0, 3.0, 4), (2.0, 0.0, 2), (0.0, 0.0, 1), (0.0, 0.0, 0), (0.0, 0.0, 0)]
    for limits in ({}, {"inline_words": 0}, {"inline_words": 0, "max_bytes": 100}):
        out = lex.token_weights(posts, lexicon(spark), "content", **limits)
        got = out.orderBy("tweet_id").select("positive_score", "negative_score", "word_count").collect()
        assert [tuple(r) for r in got] == want, limits
    assert len(lex.shards(lexicon(spark), 100)) > 1


def test_substring_index_against_python(spark):
    """Random words, also of one character and beyond the text's end, over texts that repeat."""
    rng = random.Random(4)
    words = {"".join(rng.choice("ab😀良") for _ in range(rng.randint(1, 6))): rng.choice([-2, -1, 1, 2]) for _ in range(80)}
    texts = ["".join(rng.choice("ab😀良 ") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    posts = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:20], None])], "n int, content string").repartition(3)
    table = spark.createDataFrame([(w, p) for w, p in words.items()] + [("", 5)], "word string, polarity int")
    want = [sum(p for w, p in words.items() if w in (t or "")) for t in [*texts, *texts[:20], None]]
    for size in (lex.BROADCAST_BYTES, 1500):
        scored_ = lex.substring_score(posts, table, contains_words=0, inline_words=0, max_bytes=size).orderBy("n")
        assert [r.sentiment_score for r in scored_.collect()] == want
    tokens = [" ".join(rng.choice([*list(words)[:30], "x"]) for _ in range(12)) for _ in range(20)] * 3
    posts = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "n int, content string").repartition(3)
    plain = {w: p for w, p in words.items() if w in list(words)[:30]}
    table = spark.createDataFrame(list(plain.items()), "word string, polarity int")
    pair = [
        [tuple(r) for r in lex.token_weights(posts, table, "content", tokenizer=lambda c: F.split(c, " "), **limits).orderBy("n").collect()]
        for limits in ({}, {"inline_words": 0}, {"inline_words": 0, "max_bytes": 500})
    ]
    assert pair[0] == pair[1] == pair[2]


def test_top_terms_ties_go_to_first_seen(spark):
    posts = spark.createDataFrame([(1, "b a a"), (2, "b c d")], "row_pos long, content string")
    got = [tuple(r) for r in lex.top_terms(posts, 3).collect()]
    assert got == [("b", 2), ("a", 2), ("c", 1)]


def test_keep_first_with_null_ids(spark):
    data = [("b", 1, None), ("a", 2, None), ("a", 1, "x"), ("b", 0, "x"), ("b", 3, "y")]
    random.Random(1).shuffle(data)
    posts = spark.createDataFrame(data, "source_file string, row_pos int, tweet_id string").repartition(3)
    got = sorted(dd.dedupe_posts(posts).collect(), key=str)
    assert {(r.tweet_id, r.source_file, r.row_pos) for r in got} == {(None, "a", 2), ("x", "a", 1), ("y", "b", 3)}
    assert tuple(dd.removed_count(posts, ["tweet_id"]).first()) == (5, 3, 2)


def test_gap_fill_and_sparse(spark):
    posts = timed(spark, [("t", at(1, 0, 5), 1), ("t", at(1, 3, 59), 1), ("t", at(1, 3, 0), 1), ("u", at(2), 1)], "n int")
    got = rows(ser.post_counts(posts), "topic", "timestamp")
    assert got == [("t", at(1, 0), 1), ("t", at(1, 1), 0), ("t", at(1, 2), 0), ("t", at(1, 3), 2), ("u", at(2), 1)]
    sparse = rows(ser.by_window(posts).agg(F.count("n")), "topic", "timestamp")
    assert sparse == [("t", at(1, 0), 1), ("t", at(1, 3), 2), ("u", at(2), 1)]


def test_rates_can_exceed_one_and_zero_count_is_null(spark):
    posts = timed(
        spark,
        [("t", at(1), "x", "POSITIVE"), ("t", at(1), None, "POSITIVE"), ("t", at(2), None, "NEGATIVE")],
        "content string, bert_label string",
    ).withColumns({f"bert_{s}": F.lit(0.5) for s in ("positive", "neutral", "negative")})
    got = ser.hourly_sentiment(posts).orderBy("timestamp").collect()
    assert (got[0]["count"], got[0].positive_rate) == (1, 2.0)
    assert (got[1]["count"], got[1].negative_rate) == (0, None)


def test_deltas_and_changes(spark):
    df = timed(spark, [("t", at(1, h), v) for h, v in ((0, 0.0), (1, 0.0), (5, 4.0), (6, 6.0))] + [("u", at(1), 9.0)], "volume double")
    out = ser.with_first_difference(df, ["volume"]).withColumns(
        {"rate": ser.relative_change("volume"), "eps": ser.relative_change_eps("volume")}
    )
    got = [(r.delta_volume, r.rate) for r in out.orderBy("topic", "timestamp").collect()]
    assert got == [(0, 0), (0, 0), (4, 0), (2, 0.5), (0, 0)]
    assert math.isclose(out.filter("volume = 4").first().eps, 4 / 1e-6)
    assert out.filter("topic = 'u'").first().eps == 0


def test_outer_join_fills_only_what_it_should(spark):
    sentiment = timed(spark, [("t", at(1, 0), 2, 0.5, 0.25)], "count long, avg_score double, negative_rate double")
    stance = timed(spark, [("t", at(1, 1), 1.0)], "stance_against_rate double")
    for s in ("favor", "neutral"):
        stance = stance.withColumn(f"stance_{s}_rate", F.lit(0.0))
    for s in ("against", "favor", "neutral"):
        stance = stance.withColumn(f"stance_{s}_mean", F.lit(0.1))
    for k in ("like", "retweet", "reply"):
        stance = stance.withColumns({f"{f}_{k}_count": F.lit(v) for f, v in (("avg", 1.0), ("max", 2), ("total", 3))})
    got = feat.feature_table(feat.join_series(sentiment, stance)).orderBy("timestamp").collect()
    assert (got[0].volume, got[0].stance_against_rate, got[0].avg_engagement, got[0].engagement_rate) == (2, 0, None, 0)
    assert (got[1].volume, got[1].negative_rate, got[1].total_engagement, got[1].engagement_rate) == (0, 0, 9, 0)
    assert got[1].delta_engagement == 0 and got[1].delta_volume == -2


def test_intervals(spark):
    raw = spark.createDataFrame(
        [
            ("t", 1, "2024-01-01 01:00:00", "2024-01-01 03:00:00", None, None),
            ("t", 2, "2024-01-01 02:00:00", "2024-01-01 04:00:00", "b", "x"),
            ("t", 3, "2024-01-09 00:00:00", "2024-01-08 00:00:00", "c", None),
            ("t", 4, "2024-01-09 00:00:00", None, "d", None),
            ("u", 1, "never", "2024-01-08 00:00:00", "e", None),
        ],
        "topic string, position int, start string, end string, label string, description string",
    )
    good = lab.usable_intervals(raw)
    assert sorted(r.label for r in good.collect()) == ["b", "period_1"]
    df = timed(spark, [("t", at(1, h), h) for h in range(6)] + [("u", at(1, 2), 9)], "h int")
    got = rows(lab.apply_intervals(df, good).select("h", "is_controversy"), "h")
    assert got == [(0, 0), (1, 1), (2, 1), (3, 1), (4, 1), (5, 0), (9, 0)]
    zoned = rows(lab.apply_intervals(df, good, interval_zone="Asia/Tokyo").select("is_controversy"), "h")
    assert [r[0] for r in zoned] == [0] * 7


def test_interval_sweep_against_brute_force(spark):
    """Overlaps, long periods, equal ends, moments, rows without topic or time."""
    rng = random.Random(11)
    start = dt.datetime(2023, 12, 28)
    periods = []
    for _ in range(60):
        a = start + dt.timedelta(hours=rng.randrange(24 * 60))
        periods.append((rng.choice(["t", "u", None]), a, a + dt.timedelta(hours=rng.choice([0, 0, 1, 5, 24, 24, 200, -3]))))
    periods += [periods[0]] * 5 + [("t", start, start + dt.timedelta(days=1)), ("w", start, dt.datetime(2024, 12, 31))]
    df = [(rng.choice(["t", "u", "w", None]), rng.choice([None, *[start + dt.timedelta(hours=rng.randrange(24 * 70)) for _ in range(9)]]), i) for i in range(400)]
    frame = spark.createDataFrame(df, "topic string, timestamp timestamp_ntz, n int").repartition(4)
    bounds = spark.createDataFrame(periods, "topic string, start timestamp_ntz, end timestamp_ntz")
    got = {r.n: r.is_controversy for r in lab.apply_intervals(frame, bounds).collect()}
    want = {n: int(any(t is not None and t == p and x is not None and a <= x <= b for p, a, b in periods)) for t, x, n in df}
    assert got == want and 0 < sum(want.values()) < 400


def test_keep_first_plans_no_sort_of_rows(spark):
    data = [(f"f{i % 3}", i % 50, None if i % 7 == 0 else f"k{i % 9}", f"text {i % 5}", i) for i in range(400)]
    data = [(f, n * 10 + i // 40, k, t, i) for f, n, k, t, i in data]
    posts = spark.createDataFrame(data, "source_file string, row_pos long, tweet_id string, content string, n int").repartition(5)
    for got, key in ((dd.dedupe_posts(posts), 2), (dd.dedupe_content(posts), 3)):
        best = {}
        for row in sorted(data):
            best.setdefault(row[key], row[:2])
        assert sorted((r[key], r[0], r[1]) for r in got.collect() if r[key]) == sorted((k, *v) for k, v in best.items() if k)
        assert len(got.collect()) == len(best)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "SortMergeJoin" not in plan and "HashAggregate" in plan
    series = [("t", at(1), 1, "b"), ("t", at(1), 2, "a"), ("t", at(1), 2, "a"), (None, at(2), 3, "a"), (None, None, 4, "b"), (None, None, 5, "c")]
    frame = spark.createDataFrame(series, "topic string, timestamp timestamp_ntz, n int, source_file string").repartition(3)
    merged = dd.merge_hourly(frame)
    assert sorted((r.n for r in merged.collect())) == [2, 3, 4]
    assert "SortAggregate" not in merged._jdf.queryExecution().executedPlan().toString()
    two = spark.createDataFrame([("a", 5, 9, "x"), ("a", 7, 1, "x"), ("a", 5, 8, "x"), ("b", 0, 0, "x")], "f string, o long, r long, k string")
    assert tuple(dd.keep_first(two, ["k"], ["f", "o", "r"]).first()) == ("a", 5, 8, "x")


def test_summaries_of_widths_that_do_not_nest(spark):
    posts = timed(spark, [("t", at(1, 0, 2), 1), ("t", at(1, 0, 16), 1), ("t", at(1, 5, 59), 1)], "n int")
    got = {r.width: (r.windows, r.max_count, r.min_count) for r in ser.resolution_summary(posts, ("10 minutes", "15 minutes", "7 hours")).collect()}
    assert got == {"10 minutes": (36, 1, 0), "15 minutes": (24, 1, 0), "7 hours": (1, 3, 3)}


def test_long_gap_is_cut_into_pieces(spark):
    posts = timed(spark, [("t", dt.datetime(1974, 1, 1), 1), ("t", at(1), 1), ("t", at(1, 1), 1), ("u", at(3), 1)], "n int")
    filled = ser.post_counts(posts, "10 minutes")
    hours = (at(1, 1) - dt.datetime(1974, 1, 1)).days * 144 + 6
    total = filled.groupBy("topic").agg(F.count("*").alias("n"), F.sum("count").alias("s"), F.countDistinct("timestamp").alias("d"))
    assert {r.topic: (r.n, r.s, r.d) for r in total.collect()} == {"t": (hours + 1, 3, hours + 1), "u": (1, 1, 1)}
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 2


def test_dataset_summary_lists_are_bounded(spark):
    rows_ = [("t", at(1 + i % 3), f"f{i % 2}", f"q{i % 40:02d}") for i in range(200)] + [("u", at(1), "f", None), (None, at(1), "f", "q")]
    posts = spark.createDataFrame(rows_, "topic string, timestamp timestamp_ntz, source_file string, query string")
    got = {r.topic: r for r in rep.topic_dataset_summary(posts, most_listed=3).collect()}
    assert (got["t"].n, got["t"].files, got["t"].query_count, got["t"].queries, got["t"].days) == (200, 2, 40, "q00,q01,q02", 3)
    assert (got["u"].queries, got["u"].query_count, got[None].queries) == ("", 0, "q")


def test_close_windows(spark):
    df = timed(spark, [("t", at(1, 0), 1), ("t", at(1, 2), 1), ("t", at(1, 4, 0, 1), 1), ("u", at(1), 1)], "n int")
    got = rows(ser.join_close_windows(df, 7200), "topic", "period")
    assert got == [("t", 1, at(1, 0), at(1, 2), 2), ("t", 2, at(1, 4, 0, 1), at(1, 4, 0, 1), 1), ("u", 1, at(1), at(1), 1)]


def test_encoding(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "topic string")
    got = {r.topic: r.topic_encoded for r in ser.with_encoded(df).collect()}
    assert got == {"a": 0, "b": 1, None: 2}
    codes = ser.encoder(df.filter("topic = 'b'"))
    assert {r.topic: r.topic_encoded for r in ser.encode_with(df, codes).collect()} == {"a": -1, "b": 0, None: -1}


def test_peaks_take_the_earliest(spark):
    df = timed(spark, [("t", at(1, 1), 5.0), ("t", at(1, 0), 5.0), ("t", at(1, 2), 1.0)], "volume double")
    assert rep.peaks(df, ["volume"]).first().at_volume == at(1, 0)


def scored(spark, pairs, topic="t"):
    data = [(topic, at(1, 0, 0, i), label, float(p)) for i, (label, p) in enumerate(pairs)]
    return spark.createDataFrame(data, "topic string, timestamp timestamp_ntz, label int, probability double")


def brute_auc(pairs):
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_against_all_pairs(spark):
    rng = random.Random(7)
    for grid in (3, 1000, 10**9):
        pairs = [(rng.randint(0, 1), min(1.0, max(0.0, rng.randrange(-2, grid + 2) / grid))) for _ in range(50)]
        pairs += [(1, 1e-9), (0, 2e-9), (1, 1 - 1e-12)]
        got = met.roc_auc(scored(spark, pairs)).first().roc_auc
        assert math.isclose(got, brute_auc(pairs)), grid
    assert met.roc_auc(scored(spark, [(1, 0.5), (1, 0.7)])).first().roc_auc is None


def test_thresholds_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 1), rng.randrange(20) / 20) for _ in range(60)]

    def f1(t):
        tp = sum(y == 1 and p >= t for y, p in pairs)
        fp = sum(y == 0 and p >= t for y, p in pairs)
        total = sum(y for y, _ in pairs)
        pr, rc = tp / (tp + fp), tp / total
        return (2 * pr * rc / (pr + rc) if tp else 0.0), rc

    for need in (0.0, 0.8):
        options = [(f1(t)[0], -t) for t in {p for _, p in pairs} if f1(t)[1] >= need]
        got = met.best_threshold(scored(spark, pairs), min_recall=need).first()
        assert (got.best_f1, -got.best_threshold) == max(options)
    assert met.best_threshold(scored(spark, [(0, 0.3), (0, 0.4)])).first().best_threshold == 0.5


def test_metrics_with_no_predicted_positive(spark):
    m = met.binary_metrics(scored(spark, [(1, 0.1), (0, 0.2)])).first()
    assert (m.precision, m.recall, m.f1, m.accuracy) == (0, 0, 0, 0.5)


def test_exact_quantiles(spark):
    import numpy as np

    rng = random.Random(5)
    values = [rng.choice([0.0, -3.5, 2.0, rng.random() * 1e6, -rng.random()]) for _ in range(101)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    got = siz.exact_quantiles(df, "x", {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    want = np.quantile(values, [0.25, 0.5, 0.9])
    assert np.allclose([got.a, got.b, got.c], want)


def many(spark, n=500):
    return spark.range(n).select(
        F.concat(F.lit("t"), (C("id") % 3).cast("string")).alias("topic"),
        F.timestamp_add("HOUR", C("id").cast("int"), F.lit(at(1)).cast("timestamp_ntz")).alias("timestamp"),
        (C("id") % 10 == 0).cast("int").alias("label"),
        C("id").cast("double").alias("volume"),
        (C("id") % 7).cast("double").alias("negative_rate"),
    )


def test_ranks_and_splits_do_not_depend_on_partitions(spark):
    a = sp.stratified_split(many(spark), "label")
    b = sp.stratified_split(many(spark).repartition(13, "volume"), "label")
    key = lambda df, c: {(r.topic, r.timestamp): r[c] for r in df.collect()}
    assert key(a, "is_test") == key(b, "is_test")
    sizes = {r.label: r.n for r in a.groupBy("label").agg(F.sum("is_test").alias("n")).collect()}
    assert sizes == {0: 90, 1: 10}
    folds = sp.stratified_folds(many(spark), 5, "label").groupBy("label", "fold").count().collect()
    for label, n in ((0, 90), (1, 10)):
        assert [r["count"] for r in folds if r.label == label] == [n] * 5
    ranked = siz.hash_rank(many(spark), ["topic", "timestamp"])
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 501))


def test_controversy_score_of_an_empty_topic(spark):
    df = timed(spark, [("t", at(1), 0.0, 1.0, 1.0)], "volume double, negative_rate double, stance_against_rate double")
    assert ser.with_controversy_score(df).first().controversy_score == 0


def test_z_score_without_deviation(spark):
    df = timed(spark, [("t", at(1), 2.0), ("t", at(2), 2.0)], "volume double")
    assert {r.volume_spike_ratio for r in ser.with_z_score(df).collect()} == {0.0}


def test_interval_end_defaults_to_the_last_day(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 2), None, None)], "last date, day date, hour int")
    assert df.select(tm.interval_end(C("day"), C("hour"), C("last"))).first()[0] == at(2, 23)


def test_virtual_engagement_is_reproducible(spark):
    df = many(spark).withColumns({"flame_score": F.lit(2.0), "stance_against_rate": F.lit(0.1)})
    key = F.concat_ws("|", "topic", C("timestamp").cast("string"))
    a = comp.with_virtual_engagement(df, key).agg(F.sum("avg_engagement"), F.min("avg_engagement"), F.max("avg_engagement")).first()
    b = comp.with_virtual_engagement(df.repartition(5), key).agg(F.sum("avg_engagement")).first()
    assert math.isclose(a[0], b[0]) and 1.0 <= a[1] and a[2] < 3.0


def test_width_that_does_not_divide_a_day(spark):
    posts = timed(spark, [("t", at(1, 5), 1), ("t", at(1, 23), 1), ("t", at(2, 3), 1), ("u", at(2, 3), 1)], "n int")
    got = rows(ser.by_window(posts, "7 hours").agg(F.count("n")), "topic", "timestamp")
    assert got == [("t", at(1, 0), 1), ("t", at(1, 21), 2), ("u", at(2, 0), 1)]


def test_lexicon_paths_agree_on_odd_rows(spark):
    from emberscope.operators import lexicon as lex

    posts = spark.createDataFrame(
        [("1", "bad bad"), ("1", "good"), (None, "good bad day"), (None, None), ("2", ""), ("3", "none")], "tweet_id string, content string"
    )
    words = spark.createDataFrame([("bad", 1.0, 0), ("bad", -1.0, 1), ("good", 1.0, 2), ("day", 1.0, 3)], "word string, polarity double, line_no long")

    def rows(df):
        return sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))

    tokens = [rows(lex.with_token_sentiment(posts, words, inline_words=n)) for n in (100, 0)]
    assert tokens[0] == tokens[1] and len(tokens[0]) == 6
    inside = [rows(lex.substring_score(posts, words, contains_words=c, inline_words=n)) for c, n in ((64, 100), (0, 100), (0, 0))]
    assert inside[0] == inside[1] == inside[2] and len(inside[0]) == 6


def test_hour_floor_keeps_rows_without_time(spark):
    from emberscope.functions import times as tm

    frame = spark.sql("SELECT * FROM VALUES (timestamp_ntz'2024-01-05 10:59:59'), (NULL) AS t(ts)")
    assert sorted(str(r.h) for r in frame.select(tm.hour_floor(frame.ts).alias("h")).collect()) == ["2024-01-05 10:00:00", "None"]
