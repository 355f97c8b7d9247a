"""Invariants of the fitted parts and of the file and stream jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberscope.operators import metrics as met
from emberscope.operators import modelling as mo
from emberscope.operators import scoring as sco
from emberscope.operators import series as ser
from emberscope.operators import stance as st
from emberscope.plans.bindings import Tables
from emberscope.plans.queries_models import hit_scorer, stance_rows
from emberscope.schemas import FEATURES_10
from emberscope.sources import posts as src

C = F.col
FEATURES = ["volume", "negative_rate"]


@pytest.fixture(scope="module")
def separable(spark):
    """Rows whose label follows the first feature."""
    return mo.materialise(
        spark.range(240).select(
            F.concat(F.lit("t"), (C("id") % 4).cast("string")).alias("topic"),
            F.timestamp_add("HOUR", C("id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("timestamp"),
            (C("id") % 6 == 0).cast("int").alias("label"),
            (F.when(C("id") % 6 == 0, 10.0).otherwise(0.0) + (C("id") % 5)).alias("volume"),
            (C("id") % 7).cast("double").alias("negative_rate"),
        ),
        "separable",
    )


@pytest.mark.parametrize("name", list(mo.PRESETS))
def test_presets_learn(separable, name):
    preset = mo.with_rounds(mo.PRESETS, 5)[name]
    scored = mo.predict(mo.fit(separable, FEATURES, preset), separable, FEATURES)
    bounds = scored.agg(F.min("probability"), F.max("probability")).first()
    assert 0 <= bounds[0] <= bounds[1] <= 1
    assert met.roc_auc(scored).first()["roc_auc"] > 0.99  # 0.5 for a model that says the same of every row


def test_oversampling_balances_inside_segments(separable):
    out = mo.oversample_minority(separable, FEATURES)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0: 200, 1: 200}
    minority = np.array([[r.volume, r.negative_rate] for r in separable.filter("label = 1").collect()])
    new = np.array([[r.volume, r.negative_rate] for r in out.filter("synthetic = 1").collect()])
    assert len(new) == 160
    assert (new >= minority.min(0) - 1e-9).all() and (new <= minority.max(0) + 1e-9).all()
    for p in new[:40]:
        a, b = minority[:, None, :], minority[None, :, :]
        d = b - a
        n = (d * d).sum(-1)
        w = np.where(n > 0, ((p - a) * d).sum(-1) / np.where(n > 0, n, 1), 0).clip(0, 1)
        assert (np.abs(a + w[..., None] * d - p).sum(-1) < 1e-6).any()


def test_cross_topic_sizes(separable):
    presets = {"m": mo.PRESETS["logistic"]}
    got = mo.cross_topic(separable, FEATURES, presets).collect()
    assert {(r.topic, r.n_train, r.n_test) for r in got} == {(f"t{i}", 180, 60) for i in range(4)}
    few = separable.filter("topic <> 't0' or volume > 13.5")
    assert "t0" not in {r.topic for r in mo.cross_topic(few, FEATURES, presets, min_rows=30).collect()}


def test_permutation_importance_finds_the_feature(separable):
    model = mo.fit(separable, FEATURES, mo.PRESETS["logistic"])
    got = {r.feature: r.importance for r in mo.permutation_importance(model, separable, FEATURES, 3).collect()}
    assert got["volume"] > 0.05 > abs(got["negative_rate"])


def test_train_and_compare(separable):
    trained = mo.train_all(separable, FEATURES, {"logistic": mo.PRESETS["logistic"]})
    row = mo.compare(trained).first()
    assert row.tp + row.fp + row.fn + row.tn == 48 and row.f1 > 0.8 and row["rank"] == 1
    assert abs(row.weighted_recall - row.accuracy) < 1e-9 and 0 < row.weighted_f1 <= 1


def test_current_score_of_an_empty_topic(spark):
    seen = spark.sql("SELECT 'a' topic, timestamp_ntz'2024-01-01' timestamp, 3 score, 'normal' level")
    topics = spark.sql("SELECT * FROM VALUES ('a'), ('b') AS t(topic)")
    got = {r.topic: (r.score, r.level) for r in sco.current_score(seen, topics).collect()}
    assert got == {"a": (3, "normal"), "b": (0, "unknown")}


def test_batch_scorer_equals_column_scorer(spark, sf_dir):
    docs = spark.createDataFrame([(1, "and to is"), (2, "que"), (3, None), (4, "x")], "doc_id int, content string")
    got = sco.score_posts(docs, hit_scorer, ["POSITIVE", "NEUTRAL", "NEGATIVE"], "bert", batch_size=3)
    labels = {r.doc_id: r.bert_label for r in got.collect()}
    assert labels == {1: "POSITIVE", 2: "NEGATIVE", 3: "POSITIVE", 4: "POSITIVE"}
    for r in got.collect():
        assert abs(r.bert_positive + r.bert_neutral + r.bert_negative - 1) < 1e-9


def test_stance_model_names_travel(spark, sf_dir):
    rows = stance_rows(Tables(spark, sf_dir))
    model = st.train_stance(rows)
    assert st.class_names(model) == ["AGAINST", "FAVOR", "NEUTRAL"]
    scored = st.predict_stance(model, rows)
    total = C("stance_against") + C("stance_favor") + C("stance_neutral")
    assert scored.filter(F.abs(total - 1) > 1e-6).count() == 0
    best = F.greatest("stance_against", "stance_favor", "stance_neutral")
    assert scored.filter((C("stance_label") == "FAVOR") & (C("stance_favor") < best)).count() == 0
    majority = scored.groupBy("label").count().agg(F.max("count")).first()[0] / scored.count()
    assert scored.filter(C("label") == C("stance_label")).count() / scored.count() > majority + 0.05


def test_raw_csv_rules(spark, tmp_path):
    folder = tmp_path / "original" / "松本"
    folder.mkdir(parents=True)
    head = "date,id,url,content,user,user_displayname,reply_count,retweet_count,like_count\n"
    (folder / "a.csv").write_text(
        "# 検索クエリ: 松本 人志\n# 取得日時: 2025-01-01\n# 取得件数: x\n" + head
        + '2023-01-29T14:25:37.000Z,1,u,"line\n# one, ""q""",a,A,1,2,3\n'
        + "2023-01-29,2,u,see #tag here,a,A,1,2,3\n"
        + "2023-01-29,3,u,too,many,columns,a,A,1,2,3\n",
        encoding="utf-8",
    )
    raw = src.read_raw_posts(spark, str(tmp_path / "original"))
    got = {r.id: (r.content, r.topic, r.source_file) for r in raw.collect()}
    assert got == {"1": ('line\n# one, "q"', "松本", "a.csv"), "2": ("see #tag here", "松本", "a.csv")}
    assert raw.count() == 2
    kept = src.read_raw_posts(spark, str(tmp_path / "original"), keep_bad_rows=True)
    assert kept.filter("bad_row").count() == 1
    meta = src.read_comment_metadata(spark, str(tmp_path / "original")).first()
    assert (meta.topic, meta.query, meta.collected_at, meta.original_count) == ("松本", "松本 人志", "2025-01-01", None)


def test_reader_unites_headers_and_fills_short_rows(spark, tmp_path):
    deep = tmp_path / "original" / "松本 x" / "sub"
    deep.mkdir(parents=True)
    full = "date,id,url,content,user,user_displayname,reply_count,retweet_count,like_count\n"
    (deep / "a.csv").write_text(full + '2023-01-29,1,u,"x, ""y"", z"\n2023-01-29,2,u,t,a,A,1,2,3,\n2023-01-29,3,u,t,a,A,1,2,3\n', encoding="utf-8")
    (deep.parent / "a.csv").write_text("# note\n\ufeffid,content,date,lang\n4,hello,2023-01-29,en\n", encoding="utf-8")
    for multi_line in (True, False):
        raw = src.read_raw_posts(spark, str(tmp_path / "original"), multi_line=multi_line)
        got = {r.id: (r.date, r.content, r.like_count, r.topic) for r in raw.collect()}
        assert got == {
            "1": ("2023-01-29", 'x, "y", z', None, "松本 x"),
            "3": ("2023-01-29", "t", "3", "松本 x"),
            "4": ("2023-01-29", "hello", None, "松本 x"),
        }
        assert raw.select("source_path").distinct().count() == 2


def test_lines_know_their_quotes():
    import pyarrow as pa

    from emberscope.sources.csv_records import line_steps, states

    def end(line, inside):  # one character after the other
        at_start, i = not inside, 0
        while i < len(line):
            c = line[i]
            if inside:
                if c == '"' and line[i + 1 : i + 2] == '"':
                    i += 1
                elif c == '"':
                    inside = False
            elif c == '"' and at_start:
                inside = True
            at_start = c == "," and not inside
            i += 1
        return int(inside)

    rng = np.random.default_rng(1)
    lines = ["".join(rng.choice(list('aa,,""')) for _ in range(rng.integers(0, 9))) for _ in range(4000)]
    odd = [x for x in lines if '"""' not in x.replace('""""', "")]
    out, into = line_steps(pa.array(odd))
    assert out.tolist() == [end(x, False) for x in odd] and into.tolist() == [end(x, True) for x in odd]
    for start in (0, 1):
        state, want = start, []
        for x in odd:
            state = end(x, bool(state))
            want.append(state)
        assert states(out, into, start).tolist() == want


def test_large_csv_files_are_read_by_many_tasks(spark, tmp_path):
    folder = tmp_path / "original" / "t"
    folder.mkdir(parents=True)
    rng = np.random.default_rng(3)
    pieces = ["a", 'x ""y""', "line\nbreak", "# no comment", "\n\n", "é,日本", '5"" tv', "\n# neither\n", ""]
    head = "date,id,url,content,user,user_displayname,reply_count,retweet_count,like_count\n"
    want = {}
    for f in range(3):
        body = ["# about\n" + head]
        for i in range(400):
            text = "".join(rng.choice(pieces) for _ in range(rng.integers(1, 12)))
            want[f"{f}-{i}"] = text.replace('""', '"')
            body.append(f'2023-01-29,{f}-{i},u,"{text}",a 5" b,A,1,2,3\n')
            if i % 50 == 0:
                body.append('# a "comment\n')
        (folder / f"f{f}.csv").write_text("".join(body), encoding="utf-8")
    long = "\n".join(["word, word"] * 3000)
    (folder / "long.csv").write_text(head + f'2023-01-29,l,u,"{long}",a,A,1,2,3\n2023-01-29,m,u,x,a,A,1,2,3', encoding="utf-8")
    want |= {"l": long, "m": "x"}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        results = []
        for size in ("128m", "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            raw = src.read_raw_posts(spark, str(tmp_path / "original"))
            rows = raw.select("id", "content", "user", "like_count", "source_file", "topic", "file_offset", "row_pos").collect()
            assert {r.id: r.content or "" for r in rows} == want and len(rows) == len(want)
            assert {(r.like_count, r.topic) for r in rows} == {("3", "t")} and {r.user for r in rows} == {'a 5" b', "a"}
            results.append(sorted((r.source_file, r.file_offset, r.row_pos, r.id) for r in rows))
        assert len({r[1] for r in results[0]}) == 1 and len({r[1] for r in results[1]}) > 10
        for rows in results:  # the order of the file
            for f in range(3):
                assert [r[3] for r in rows if r[0] == f"f{f}.csv"] == [f"{f}-{i}" for i in range(400)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_times_in_other_formats(spark):
    from emberscope.functions.times import parse_utc

    want = {
        "2024/01/05 10:00:00": "2024-01-05 10:00:00", "Sun Jan 29 14:25:37 +0900 2023": "2023-01-29 05:25:37",
        "Jan 5, 2024": "2024-01-05 00:00:00", "January 5 2024 09:05": "2024-01-05 09:05:00", "20240105": "2024-01-05 00:00:00",
        "2024-01-05 10:00 UTC": "2024-01-05 10:00:00", "2024-01-05T10:00:00+09:00": "2024-01-05 01:00:00",
        "2024-01-05T10:00:00.000Z": "2024-01-05 10:00:00", "Jam 5, 2024": None, "": None, "20241399": None,
    }
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", parse_utc(F.col("t")).alias("at")).collect()
    assert {r["t"]: r["at"] and str(r["at"]) for r in rows} == want


def test_importance_of_indented_metadata(spark, tmp_path):
    from emberscope.sources import tables as tab

    for name in ("m1", "m2"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.json").write_text('{\n "model_name": "%s",\n "feature_importance": {\n  "volume": 0.5\n }\n}' % name)
    got = {tuple(r) for r in tab.read_importances(spark, str(tmp_path)).collect()}
    assert got == {("m1", "volume", 0.5), ("m2", "volume", 0.5)}


@pytest.mark.parametrize("encoding", ["cp932", "utf-8"])
def test_polarity_dictionary_encodings(spark, tmp_path, encoding):
    path = tmp_path / "pn.dic"
    path.write_bytes("良い:よい:形容詞:0.9\n悪い:わるい:形容詞:-0.51\n並:なみ:名詞:0.5\n変:へん:名詞:x\nbad line\n".encode(encoding))
    got = {r.word: r.polarity for r in src.read_polarity_dictionary(spark, str(path)).collect()}
    assert got == {"良い": 1, "悪い": -1}


def test_stream_equals_batch_over_empty_windows(spark, tmp_path):
    """Windows in several batches, with gaps inside a batch and between batches."""
    from emberscope.streaming import windows as win

    def hour(day, h):
        return f"2024-01-{day:02d} {h:02d}:00:00"

    batches = [
        [("a", hour(1, 0), 4, 0.5), ("a", hour(1, 3), 2, 0.25), ("b", hour(1, 1), 1, None)],
        [("a", hour(1, 6), 6, 0.75), ("b", hour(1, 2), 3, 0.5)],
        [("a", hour(1, 7), 1, 0.0), ("b", hour(1, 9), 2, 1.0), ("c", hour(1, 9), 2, 1.0)],
    ]
    schema = "topic string, timestamp timestamp_ntz, volume long, negative_rate double, stance_favor_rate double, stance_against_rate double, stance_neutral_rate double"
    rows = [[(t, None if x is None else x, v, n, 0.2, 0.3, 0.5) for t, x, v, n in b] for b in batches]
    import datetime as dt

    for k, batch in enumerate(rows):
        typed = [(t, dt.datetime.fromisoformat(x), *rest) for t, x, *rest in batch]
        spark.createDataFrame(typed, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    everything = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")

    def run(name, **options):
        stream = win.read_stream(spark, f"{tmp_path}/in", everything.schema, recursiveFileLookup="true", maxFilesPerTrigger="1", latestFirst="false")
        return win.stream_to_table(lambda: win.with_previous_window(stream, **options), f"{tmp_path}/{name}", f"{tmp_path}/{name}-log")

    filled = ser.gap_fill(everything, "1 hour", {"volume": 0})
    batch = ser.with_first_difference(filled, ["volume", "negative_rate"])
    columns = ["topic", "timestamp", "volume", "negative_rate", "delta_volume", "delta_negative_rate", "stance_favor_rate"]
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert key(run("plain")) == key(batch)
    forgetful = {(r.topic, r.timestamp.hour): (r.volume, r.delta_volume) for r in run("short", expire="3 hours").collect()}
    assert forgetful["a", 6] == (6, 4.0 + 2.0) and forgetful["a", 4] == (0, -2.0)  # a gap of three hours is still filled
    assert forgetful["b", 9] == (2, 0.0) and ("b", 5) not in forgetful  # a longer one begins anew
    eager = {(r.topic, r.timestamp.hour): r.volume for r in run("eager", idle_windows=2, lateness="1 hour").collect()}
    assert {k: v for k, v in eager.items() if k[0] == "a"}.items() >= {("a", h): v for h, v in ((0, 4), (1, 0), (2, 0), (3, 2), (6, 6), (7, 1))}.items()


def test_alerts_of_the_stream_equal_the_batch(spark, sf_dir):
    from emberscope.plans.queries_models import scoring_model
    from emberscope.plans.queries_stream import feature_stream
    from emberscope.schemas import OPTIMIZED_FEATURES
    from emberscope.streaming import windows as win

    t = Tables(spark, sf_dir)
    model, _ = scoring_model(t)
    table, root = feature_stream(t)
    final = win.read_stream(spark, f"{root}/features", table.schema)
    alerts = win.stream_to_table(lambda: win.streaming_alerts(final, model, OPTIMIZED_FEATURES, expire="3650 days"), f"{root}/alerts", f"{root}/alerts-log")
    filled = ser.with_first_difference(ser.gap_fill(table, "1 hour", {"volume": 0}), ["volume", "negative_rate"])
    full = filled.withColumns(
        {"flame_score": C("volume") * C("negative_rate"), "against_count": C("volume") * C("stance_against_rate"),
         "sentiment_polarity": C("stance_against_rate") - C("stance_favor_rate")}
    )
    want = sco.score_windows(full, model, OPTIMIZED_FEATURES)
    pair = [sorted((r.topic, r.timestamp, r.score, r.level, round(r.probability, 9)) for r in df.collect()) for df in (alerts, want)]
    assert pair[0] == pair[1] and len(pair[0]) > 5


def test_calibrated_probabilities_beat_the_margin(spark):
    """The sigmoid's log-loss on rows that the machine has not seen is below that of the bare margin."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 2))
    y = (rng.random(900) < 1 / (1 + np.exp(-(2.5 * (x**2).sum(1) - 5)))).astype(int)
    rows = spark.createDataFrame([("t", int(i), float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "topic string, i int, volume double, negative_rate double, label int")
    train, test = rows.filter("i < 600"), rows.filter("i >= 600")
    model = mo.fit(train, FEATURES, mo.PRESETS["rbf_svm"])
    assert mo.importances(mo.Trained("m", model, FEATURES, 0.5, 0.0, None)) is None
    scored = np.array([(r.probability, r.label) for r in mo.predict(model, test, FEATURES, keep=["label"]).collect()])
    margins = model.transform(test).select(mo.vector_to_array("rawPrediction")[1].alias("m"), "label").collect()
    bare = np.array([(1 / (1 + np.exp(-r.m)), r.label) for r in margins])

    def loss(p):
        q = np.clip(p[:, 0], 1e-12, 1 - 1e-12)
        return -np.mean(p[:, 1] * np.log(q) + (1 - p[:, 1]) * np.log(1 - q))

    assert loss(scored) < loss(bare) - 0.01 and loss(scored) < 0.55


def test_nearest_neighbours_against_all_pairs(spark, monkeypatch):
    from emberscope.operators import neighbours as nb

    rng = np.random.default_rng(8)
    points = np.round(np.concatenate([rng.normal(size=(150, 3)), rng.normal(size=(60, 3)) * 0.05 + 3, np.zeros((30, 3)), rng.integers(0, 3, size=(60, 3))]), 3)
    distinct, copies = np.unique(points, axis=0, return_counts=True)
    want = {}
    for p, n in zip(distinct, copies):
        gaps = nb._gaps(p[None, :], distinct)[0]
        order = sorted((g, tuple(q), int(c)) for g, q, c in zip(gaps, distinct, copies) if tuple(q) != tuple(p))
        near, have = [], 0
        for g, q, c in order:
            if have >= 5:
                break
            near.append((g, q, c))
            have += c
        want[tuple(p)] = (int(n), near)
    monkeypatch.setattr(nb, "CHUNK", 40)
    for parts, pivots in ((3, 1024), (7, 5)):
        monkeypatch.setattr(nb, "MOST_PIVOTS", pivots)
        frame = spark.createDataFrame([(list(map(float, p)),) for p in points], "x array<double>").repartition(parts)
        got = {tuple(r.x): (r.copies, [(n.gap, tuple(n.y), n.copies) for n in r.near]) for r in nb.nearest(frame, 5, 3).collect()}
        assert got == want


def test_oversampling_touches_training_rows_only(separable):
    from emberscope.plans import jobs

    preset = mo.Preset("logistic", {"C": 1.0, "maxIter": 50}, scaled=True)
    rows = separable.withColumn("is_controversy", C("label"))
    plain, more = (jobs.train_unified(rows, FEATURES, preset, oversample=o) for o in (False, True))
    for result in (plain, more):
        row = result["metrics"].first()
        assert row.tp + row.fp + row.fn + row.tn == 48 and row.tp + row.fn == 8  # the hold-out keeps its own balance
    a, b = (r["probabilities"].agg(F.avg("probability")).first()[0] for r in (plain, more))
    assert b > a  # balanced training rows raise the scores


def test_order_of_partitions_does_not_matter(spark, sf_dir):
    class Shuffled(Tables):
        def table(self, name):
            return super().table(name).repartition(7)

    a = sorted(map(str, Tables(spark, sf_dir).labelled.select("topic", "timestamp", "volume", "delta_volume", "is_controversy").collect()))
    b = sorted(map(str, Shuffled(spark, sf_dir).labelled.select("topic", "timestamp", "volume", "delta_volume", "is_controversy").collect()))
    assert a == b


def test_one_pass_equals_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    from emberscope.operators import features as feat

    joined = feat.feature_table(
        feat.join_series(feat.sentiment_input(ser.hourly_sentiment(t.scored)), ser.hourly_stance(t.scored))
    )
    cols = ["topic", "timestamp", *FEATURES_10[:7]]
    both = [sorted(str(r) for r in df.select(*[F.round(c, 9) if c not in ("topic", "timestamp") else C(c) for c in cols]).collect()) for df in (joined, t.features)]
    assert both[0] == both[1]
