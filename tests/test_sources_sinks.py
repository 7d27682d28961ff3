import json

import pyarrow as pa
import pytest

from lodestone.plans import registry  # noqa: F401
from lodestone.sinks import export
from lodestone.sources import adapters, runs, stations

HEAD = "station_id,x_m,y_m,z_m,g,unit,gravity_type"


def _file(tmp_path, text):
    p = tmp_path / "s.csv"
    p.write_text(text, encoding="utf-8")
    return f"file://{p}"


def _rows(n=12, unit="mGal", kind="bouguer_anomaly", g="{}.5"):
    return "".join(f"S{i},{i * 10},0,{i * 7},{g.format(i)},{unit},{kind}\n" for i in range(n))


@pytest.mark.parametrize(
    ("text", "reasons"),
    [
        (f"{HEAD}\n{_rows()}", []),
        (f"﻿{HEAD}\n{_rows()}", []),
        (f"{HEAD}\n{_rows()}".replace(",", ";"), []),
        (f"{HEAD}\n{_rows(unit='')}", ["unit missing", "too few stations"]),
        (f"{HEAD}\n{_rows(unit='mgals')}", ["unit unsupported", "too few stations"]),
        (f"{HEAD}\n{_rows(kind='')}", ["gravity_type missing", "too few stations"]),
        (f"{HEAD}\n{_rows(3)}", ["too few stations"]),
        (f"{HEAD}\n{_rows(g='0')}", ["no signal"]),
        (f"{HEAD}\n{_rows(6)}{_rows(6)}", ["too few stations"]),
        (f"{HEAD}\n{_rows(11)}S,1,2,3,NaN,mGal,bouguer_anomaly\n", ["gravity missing"]),
        (f"{HEAD}\n{_rows(11)}S,1,2,3,4,uGal,bouguer_anomaly\n", ["units mixed"]),
        (f"{HEAD}\n{_rows(11)}S,1,2,3,4,uGal,bouguer_anomaly,more,fields\n", []),
        (f"{HEAD}\n{_rows()}".replace(",g,", ",g_raw,"), ["gravity missing", "too few stations"]),
    ],
)
def test_station_files(spark, tmp_path, text, reasons):
    got, why = stations.import_stations(spark, _file(tmp_path, text))
    assert why == reasons
    if not reasons:
        assert got.count() >= 11 and got.where("g_ms2 IS NULL").count() == 0


def test_raw_gravity_when_allowed(spark, tmp_path):
    path = _file(tmp_path, f"{HEAD}\n{_rows()}".replace(",g,", ",g_raw,"))
    assert stations.import_stations(spark, path, allow_raw=True)[1] == []


def test_names_and_quotes(spark, tmp_path):
    path = _file(tmp_path, '"Station_ID","LON","LAT","g_mgal","unit","gravity_type"\n' + "".join(f'"","-70.{i}","-30.{i}","{i}.25","µGal","bouguer_anomaly"\n' for i in range(10, 24)))
    got, why = stations.import_stations(spark, path)
    rows = got.orderBy("src_row").collect()
    assert why == [] and len(rows) == 14
    assert rows[0].station_id.startswith("ST_") and rows[0].coord_type == "latlon" and rows[0].x_m == -70.1
    assert rows[0].g_ms2 == pytest.approx(10.25e-8)


def test_layouts():
    assert stations.resolve(["Easting", "Northing", "g"]).kind == "utm"
    assert stations.resolve(["x", "z", "y", "cba", "g"]).gravity == "cba"
    assert stations.resolve(["a", "b"]).kind is None


def test_empty_file(spark, tmp_path):
    assert stations.read_delimited(spark, _file(tmp_path, "")).count() == 0


def test_run_folders(spark, tmp_path):
    for p, r, f, text in (("a", "r1", "report.json", '{"score": 1.5}'), ("a", "r1", "bad.json", "{nope"), ("a", "r2", "status.json", '{"score": 2}'), ("b", "r1", "notes.txt", "x")):
        (tmp_path / p / r).mkdir(parents=True, exist_ok=True)
        (tmp_path / p / r / f).write_text(text)
    root = f"file://{tmp_path}"
    got = {(r.project, r.run): r for r in runs.runs(runs.catalog(spark, root)).collect()}
    assert got[("a", "r1")].files == 2 and got[("a", "r1")].has_json and not got[("b", "r1")].has_json
    payloads = {(r.project, r.run, r.file): r for r in runs.artefacts(spark, root, "score: double").collect()}
    assert payloads[("a", "r2", "status.json")].payload.score == 2.0
    assert payloads[("a", "r1", "bad.json")].error and payloads[("a", "r1", "bad.json")].payload is None


def test_model_contract(spark, tmp_path):
    v = adapters.voxels(spark, "/root/testdata/sf0.001")
    export.write_model(v, f"file://{tmp_path}/m", "gravity")
    model = spark.read.parquet(f"file://{tmp_path}/m")
    assert runs.model_problems(model) == [] and model.count() == v.count()
    assert runs.model_problems(model.drop("density")) == ["missing density"]
    assert runs.model_problems(v) == ["missing run_type", "missing schema_version"]


def _lines(folder):
    return [x for p in sorted(folder.glob("part-*")) for x in p.read_text().splitlines()]


def test_text_grids(spark, tmp_path):
    v = adapters.voxels(spark, "/root/testdata/sf0.001")
    rows = v.orderBy("voxel_id").collect()
    export.write_gslib(v, f"file://{tmp_path}/g", ["x", "density"])
    assert _lines(tmp_path / "g") == [f"{r.x} {r.density}" for r in rows]
    export.write_ubc_model(v, f"file://{tmp_path}/u", "grade")
    assert _lines(tmp_path / "u") == [str(r.grade) for r in sorted(rows, key=lambda r: (r.ix, r.iy, -r.iz))]
    assert export.gslib_header("t", ["a", "b"]) == "t\n2\na\nb\n"
    assert export.ubc_mesh(2, 3, 4, (0.0, 0.0, 0.0), 25.0).splitlines()[0] == "2 3 4"


def test_viewer_payloads(spark):
    v = adapters.voxels(spark, "/root/testdata/sf0.001")
    table = pa.ipc.open_stream(export.arrow_bytes(v, ["voxel_id", "density"], 50)).read_all()
    assert table.num_rows == 50 and table.schema.field("density").type == pa.float32()
    text = export.rectilinear_grid(v, "density", 20, 10, 1, 25.0)
    assert text.count("<DataArray") == 4 and len(text.split('Name="density" format="ascii">')[1].split("<")[0].split()) == 200
    with pytest.raises(ValueError, match="cells"):
        export.rectilinear_grid(v, "density", 1000, 1000, 1000, 1.0)


def test_kernel_batches(spark, tmp_path):
    k = spark.createDataFrame([(i, j, float(i + j)) for i in range(10) for j in range(3)], "obs_id long, voxel_id long, val double")
    export.write_kernel(k, f"file://{tmp_path}/k", batch=4)
    assert sorted(p.name for p in (tmp_path / "k").glob("obs_batch=*")) == ["obs_batch=0", "obs_batch=1", "obs_batch=2"]
    assert json.dumps(spark.read.parquet(f"file://{tmp_path}/k").where("obs_batch = 1").count()) == "12"


def test_coordinates_by_file_order_and_ids_without_gaps(spark, tmp_path):
    """Of two names for a coordinate the file's first counts; ids go on from 1 over all partitions."""
    path = tmp_path / "s.csv"
    path.write_text("longitude,lon,latitude,lat,g,unit,gravity_type\n" + "".join(f"{-70 - i / 100},{i},{-30 + i / 100},{-i},{i + 1},mGal,bouguer_mgal\n" for i in range(40)))
    layout = stations.resolve(["longitude", "lon", "latitude", "lat", "g"])
    assert (layout.x, layout.z) == ("longitude", "latitude")
    rows = stations.checked(stations.read_delimited(spark, str(path)).repartition(3)).collect()
    assert sorted(r.station_id for r in rows) == [f"ST_{i:06d}" for i in range(1, 41)]
    e = stations.extent(spark, str(path)).first()
    assert (e.n, e.x_max, e.z_min) == (40, -70.0, -30.0)


def test_run_bundle_and_model_of_run(spark, tmp_path):
    import hashlib
    import io
    import json
    import zipfile

    from lodestone.sinks import export
    from lodestone.sources import runs

    for project, run, name, text in (("p", "r1", "block_model.parquet", "one"), ("p", "r1", "report.json", "{}"), ("old", "x", "block_model_001.parquet", "two")):
        folder = tmp_path / "data" / project / run
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    files = runs.catalog(spark, f"{tmp_path}/data")
    assert runs.model_of_run(files, "p", "r1") == "p/r1/block_model.parquet" and runs.model_of_run(files, "p", "r2") is None
    assert runs.model_of_run(files, None, None) == "old/x/block_model_001.parquet"
    with pytest.raises(ValueError):
        runs.model_of_run(files, None, None, strict=True)
    with zipfile.ZipFile(io.BytesIO(export.run_bundle(spark, f"{tmp_path}/data/p/r1"))) as z:
        assert sorted(z.namelist()) == ["block_model.parquet", "manifest.json", "report.json"]
        listed = {f["file"]: f["sha256"] for f in json.loads(z.read("manifest.json"))["files"]}
    assert listed["block_model.parquet"] == hashlib.sha256(b"one").hexdigest()
    with pytest.raises(ValueError):
        export.run_bundle(spark, f"{tmp_path}/data/p/r1", most_bytes=3)
