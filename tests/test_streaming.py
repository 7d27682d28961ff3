from lodestone.streaming import stations as S

HEAD = "station_id,ts,x_m,y_m,z_m,g,unit\n"


def test_stations_arrive_in_files(spark, tmp_path):
    folder, table, marks = tmp_path / "in", f"file://{tmp_path}/table", f"file://{tmp_path}/marks"
    folder.mkdir()
    line = "S{0},2024-01-01T00:{0:02d}:00,{0},0,{0},{0}.5,{1}\n".format
    (folder / "a.csv").write_text(HEAD + "".join(line(i, "mGal") for i in range(10)) + line(3, "mGal") + line(11, "parsec") + "S,2024-01-01T00:00:00,NaN,0,1,1,mGal\n")
    run = lambda: S.keep_profiled(S.valid_stations(S.read_stations(spark, f"file://{folder}")), table, marks).awaitTermination()
    run()
    assert spark.read.parquet(table).count() == 10
    (folder / "b.csv").write_text(HEAD + "".join(line(i, "uGal") for i in range(8, 14)))
    run()  # from the checkpoint: only what is new, and places seen before count once
    kept = spark.read.parquet(table)
    assert kept.count() == 14 and kept.select("x_m").distinct().count() == 14
    row = S.profile_of(kept).first()
    assert row.n == 14 and row.x_span == 13.0


def test_late_rows_are_left_out(spark, tmp_path):
    rows = "event_id long, ts timestamp, event_type string, value double"
    (tmp_path / "in").mkdir()
    for name, lines in (("1", "1,2024-01-01T00:00:10,a,1\n2,2024-01-01T02:00:00,a,1\n"), ("2", "3,2024-01-01T00:00:20,a,1\n4,2024-01-01T02:00:30,a,1\n")):
        (tmp_path / "in" / f"{name}.csv").write_text(lines)
        events = spark.readStream.schema(rows).csv(f"file://{tmp_path}/in")
        out = S.request_windows(events).writeStream.outputMode("append").format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/marks").trigger(availableNow=True).start()
        out.awaitTermination()
    got = [(str(r.window_start), r.requests) for r in spark.read.parquet(f"file://{tmp_path}/out").orderBy("window_start").collect()]
    assert got == [("2024-01-01 00:00:00", 1)]
