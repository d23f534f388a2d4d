"""Streams against their batch results: learning adds each batch once, sessions close behind a watermark."""

from datetime import datetime, timedelta

from decks import deck
from test_decks import read
from test_learn_corpus import page

from tallyframe import streaming


def test_learning_by_stream_equals_one_batch(spark, tmp_path):
    files = [deck([page(k, 4) for k in range(4)]), deck([page(k, 4, "'quoted'") for k in range(4)]), deck([page(k, 3, "'said'") for k in range(3)])]
    (tmp_path / "in").mkdir()
    got = []

    def take(rows, number):
        got.append(sorted(map(str, rows.collect())))

    def run():
        streaming.learn_from(spark, str(tmp_path / "in"), str(tmp_path / "state"), take, str(tmp_path / "ck"), 1).awaitTermination(240)

    for k, f in enumerate(files[:2]):
        (tmp_path / "in" / f"{k}.pptx").write_bytes(f)
    run()
    assert len(got) == 2
    (tmp_path / "in" / "2.pptx").write_bytes(files[2])
    run()
    assert len(got) == 3 and got[-1] == sorted(map(str, streaming.learned(streaming.observed(read(spark, *files))).collect()))
    # the last batch once more, as after a failure: it takes its own place
    counts = spark.read.schema(streaming.COUNTS).parquet(str(tmp_path / "state"))
    before = counts.count()
    streaming.append_once(streaming.observed(read(spark, files[2])), str(tmp_path / "state"), 2)
    assert spark.read.schema(streaming.COUNTS).parquet(str(tmp_path / "state")).count() == before


def test_sessions_by_stream(spark, tmp_path):
    begin = datetime(2024, 1, 1)
    schema = "user_id long, ts timestamp"

    def put(k, *rows):
        spark.createDataFrame([(u, begin + timedelta(minutes=m)) for u, m in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = streaming.keep_sessions(streaming.sessions(events, ["user_id"], "ts", "30 minutes", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "ck"))
        query.awaitTermination(240)
        return streaming.late_rows(query)

    put(0, (1, 0), (1, 20), (1, 45), (2, 5))
    put(1, (1, 200), (2, 210))
    assert run() == 0
    put(2, (2, 6), (2, 215), (3, 400))  # the first is long past
    assert run() == 1
    put(3, (3, 800))
    run()
    minutes = lambda x: int((x - begin).total_seconds() // 60)
    got = sorted((r.user_id, minutes(r.started), minutes(r.ended), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 0, 75, 3), (1, 200, 230, 1), (2, 5, 35, 1), (2, 210, 245, 2), (3, 400, 430, 1)]
