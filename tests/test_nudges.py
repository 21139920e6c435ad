from datetime import datetime, timedelta

from recollect.streaming import flows, nudges

T0 = datetime(2024, 1, 1)


def events(spark, folder, batches):
    for i, batch in enumerate(batches):
        rows = [(u, i * 100 + k, T0 + timedelta(hours=h), kind) for k, (u, h, kind) in enumerate(batch)]
        spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("user_id long, event_id long, ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(folder)


def told(out):
    return sorted((r.user_id, (r.due - T0).total_seconds() / 3600, r.calls, r.saves) for r in out.collect())


def test_only_the_timer_can_tell_of_users_who_stay_away(spark, tmp_path):
    batches = [
        [(1, 0, "purchase"), (2, 0, "view"), (3, 0, "purchase"), *[(4, 0.1 * k, "view") for k in range(7)], (5, 0, "purchase")],
        [(3, 5, "purchase"), (5, 30, "view"), (9, 40, "view")],  # the watermark passes what users 1 to 4 had due
        [(9, 200, "view")],
        [(9, 201, "view")],
    ]
    stream = events(spark, f"file://{tmp_path}/in", batches)
    got = told(flows.drain(nudges.nudges(stream, idle="6 hours", late="1 hour"), f"file://{tmp_path}/out"))
    # 1: a save, then nothing. 2: too few calls. 3: saved again within the interval. 4: many calls, no save. 5: came back too late.
    assert got == [(1, 6.0, 0, 1), (3, 11.0, 0, 2), (4, 6.0, 7, 0), (5, 6.0, 0, 1)]
    # 1, 3 and 4 have no rows after the first two batches, and their rows stand in later ones
    epochs = flows.epochs(spark, f"file://{tmp_path}/out")
    first = spark.read.schema(nudges._OUT).parquet(f"file://{tmp_path}/out/out/{epochs[0]}")
    assert first.isEmpty() and len(epochs) >= 4


def test_late_rows_and_a_restart_repeat_nothing(spark, tmp_path):
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    run = lambda stream: told(flows.drain(nudges.nudges(stream, idle="6 hours", late="3 hours"), out))
    assert run(events(spark, folder, [[(1, 0, "purchase")], [(1, 2, "view"), (2, 4, "view")]])) == []
    more = events(spark, folder, [[(1, 1.5, "purchase"), (7, 20, "view")], [(7, 21, "view")], [(1, 3, "purchase"), (7, 22, "view")], [(7, 60, "view")]])
    # the save at 1.5 is late but within three hours; that at 3 comes once the watermark has passed it and is dropped
    assert run(more) == [(1, 7.5, 1, 2)]
    assert run(more) == [(1, 7.5, 1, 2)]


def test_duplicates_within_a_watermark_shorter_than_the_data(spark, tmp_path):
    batches = [[(1, 0, "a"), (2, 0, "a")], [(1, 1, "a"), (3, 100, "a")], [(9, 105, "a")], [(1, 106, "a"), (1, 2, "a")], [(9, 200, "a")], [(3, 300, "a")]]
    kept = flows.drain(flows.deduplicated(events(spark, f"file://{tmp_path}/in", batches), ["user_id"], "3 hours"), f"file://{tmp_path}/out")
    got = sorted((r.user_id, (r.ts - T0).total_seconds() / 3600) for r in kept.collect())
    # a user comes again once the watermark has passed its first event by three hours and a batch has gone by; the row at 2 is too late
    assert got == [(1, 0.0), (1, 106.0), (2, 0.0), (3, 100.0), (3, 300.0), (9, 105.0)]
