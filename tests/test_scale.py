"""What keeps the work of larger tables in proportion."""

import threading
from datetime import datetime
from pathlib import Path

import pandas as pd
import pyarrow.parquet as pq
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF
from pyspark.sql import functions as F

from emberscope.operators import stance as st
from emberscope.plans import queries_models as qm
from emberscope.plans.bindings import Tables
from emberscope.plans.catalog import QUERIES
from emberscope.plans.queries_clean import PIECE_CHARACTERS, word_tokenizer


def test_words_leave_the_tokenizer_in_pieces():
    """No piece of words stands for more than the limit and one text, and none is lost."""
    texts = ["ab cd " * 500, None, "", "x" * 5] * 500
    parts = list(word_tokenizer.func(iter([pd.Series(texts), pd.Series([], dtype=object), pd.Series([None, None])])))
    assert [words for part in parts for words in part] == [(t or "").split() for t in texts] + [[], []]
    longest = max(len(t or "") for t in texts)
    assert all(sum(len(w) + 1 for words in part for w in words) <= PIECE_CHARACTERS + longest + len(part) for part in parts)


def joins(plan):
    """The joins of an optimised plan, outermost first."""
    found = [plan] if plan.nodeName() == "Join" else []
    children = plan.children()
    return found + [j for i in range(children.size()) for j in joins(children.apply(i))]


def test_texts_are_not_shuffled_with_the_posts(spark, tmp_path):
    """Posts are told apart by their whole text, yet the join that keeps the first ones moves no text."""
    texts = ["same", "same", "other", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    events = [(i, datetime(2024, 1, 1, i), i, "view", 1.0, '{"k": 1}') for i in (3, 0, 8, 1, 6, 2, 9)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(events, schema).write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["a18_dedupe_content"](spark, str(tmp_path))
    digests = {None: None, "same": "51037a4a37730f52c8732586d3aaa316", "other": "795f3202b17cb6bc3d4b771d8c6c9eaf", "": "d41d8cd98f00b204e9800998ecf8427e"}
    assert sorted((r.tweet_id, r.content_md5) for r in out.collect()) == [
        ("0", digests["same"]), ("2", digests["other"]), ("3", digests[None]), ("9", digests[""])
    ]
    kept = [j for j in joins(out._jdf.queryExecution().optimizedPlan()) if j.joinType().toString() == "LeftSemi"]
    assert len(kept) == 1 and "content#" not in kept[0].left().output().toString()


def test_statistics_of_windows_do_not_go_back_to_the_posts(spark, sf_dir, monkeypatch):
    """What whole-table statistics and codes of the ablations read are written windows, not posts and texts."""
    read, with_z_score = [], qm.ser.with_z_score
    monkeypatch.setattr(qm.ser, "with_z_score", lambda df: read.extend(df.inputFiles()) or with_z_score(df))
    rows = qm.wide_rows(Tables(spark, sf_dir))
    assert read and not [f for f in read if "events" in f or "documents" in f or "labels" in f]
    windows = Tables(spark, sf_dir).labelled
    assert rows.count() == windows.count()
    compared = ["topic", "timestamp", "volume", "negative_rate", "flame_score", "is_controversy"]
    assert rows.select(*compared).exceptAll(windows.select(*compared)).count() == 0


def test_stance_fits_hold_one_set_of_rows_at_a_time(spark, monkeypatch):
    """The settings share the weights of their rows, and no two fits keep rows in memory at once."""
    weights, running, most, lock = [], [0], [0], threading.Lock()
    fit_weights, fit_model = IDF._fit, LogisticRegression._fit

    def counted(self, rows):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        try:
            return fit_model(self, rows)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(IDF, "_fit", lambda self, rows: weights.append(1) or fit_weights(self, rows))
    monkeypatch.setattr(LogisticRegression, "_fit", counted)
    words = F.concat_ws(" ", F.when(F.col("id") % 2 == 0, "good fine").otherwise("bad poor"), F.col("id").cast("string"))
    rows = spark.range(60).select(words.alias("content"), F.when(F.col("id") % 2 == 0, "FAVOR").otherwise("AGAINST").alias("label"))
    scored = st.predict_stance(st.train_stance(rows, buckets=64, max_iter=5), rows)
    assert scored.filter("label = stance_label").count() == 60
    assert (len(weights), most[0]) == (2, 1)


def test_stance_fits_bound_what_a_task_holds(spark, tmp_path, monkeypatch):
    """Rows come back in small row groups, and what Spark keeps of a share of them, 100 blocks, is bounded as well."""
    fits, fit_model = [], LogisticRegression._fit
    monkeypatch.setattr(st, "shared_dir", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(LogisticRegression, "_fit", lambda self, rows: fits.append(self) or fit_model(self, rows))
    words = F.expr("transform(sequence(1, 400), i -> conv(abs(xxhash64(id, i)), 10, 36))")
    rows = spark.range(0, 3000, 1, 1).select(
        F.concat_ws(" ", words).alias("content"), F.when(F.col("id") % 3 == 0, "FAVOR").otherwise("AGAINST").alias("label")
    )
    st.train_stance(rows, max_iter=1)
    groups = [
        meta.row_group(i) for f in Path(tmp_path, "stance-counts").glob("*.parquet")
        for meta in [pq.ParquetFile(f).metadata] for i in range(meta.num_row_groups)
    ]
    assert sum(g.num_rows for g in groups) == 3000
    assert max(g.total_byte_size for g in groups) <= 4 << 20 < sum(g.total_byte_size for g in groups)
    assert len(fits) == 3 and max(100 * f.getMaxBlockSizeInMB() for f in fits) <= 64
