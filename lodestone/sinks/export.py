"""Block models as files: partitioned Parquet, Arrow bytes, text grids in the orders that other programs read.

Text is written by Spark as part files whose names follow the order of the rows; join them by name after the header.
"""

from __future__ import annotations

import io
import json
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.blockmodel import header_stats
from lodestone.sources.runs import manifest

NO_DATA = -9999.0


def write_model(model: DataFrame, path: str, run_type: str, schema_version: str = "3.0") -> None:
    """Parquet with the contract's columns; Spark's commit makes the folder whole or absent."""
    model.withColumns({"run_type": F.lit(run_type), "schema_version": F.lit(schema_version)}).write.mode("overwrite").parquet(path)


def write_kernel(kernel: DataFrame, path: str, batch: int = 500) -> None:
    """(obs_id, voxel_id, val) in a folder for each batch of observations; a reader of one batch prunes the others."""
    kernel.withColumn("obs_batch", F.expr(f"obs_id DIV {batch}")).repartition("obs_batch").write.mode("overwrite").partitionBy("obs_batch").parquet(path)


def gslib_header(title: str, names: list[str]) -> str:
    return "\n".join([title, str(len(names)), *names]) + "\n"


def write_gslib(model: DataFrame, path: str, names: list[str], order: str = "voxel_id") -> None:
    """A line for each cell in that order, null and NaN as NO_DATA."""
    value = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(NO_DATA)), F.lit(NO_DATA)).cast("string")
    model.orderBy(order).select(F.concat_ws(" ", *map(value, names))).write.mode("overwrite").text(path)


def ubc_mesh(nx: int, ny: int, nz: int, origin: tuple[float, float, float], size: float) -> str:
    return f"{nx} {ny} {nz}\n{origin[0]} {origin[1]} {origin[2]}\n{nx}*{size}\n{ny}*{size}\n{nz}*{size}\n"


def write_ubc_model(model: DataFrame, path: str, value: str) -> None:
    """A value for each line, the vertical index fastest and downward."""
    model.orderBy("ix", "iy", F.desc("iz")).select(F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(NO_DATA)), F.lit(NO_DATA)).cast("string")).write.mode("overwrite").text(path)


def arrow_payload(model: DataFrame, columns: list[str], limit: int, size: float) -> tuple[bytes, dict[str, str]]:
    """arrow_bytes() and, as text by name, the statistics of the whole model (blockmodel.header_stats()) that go with them."""
    stats = header_stats(model, size).first()
    return arrow_bytes(model, columns, limit), {k: str(v) for k, v in stats.asDict().items() if v is not None}


def arrow_bytes(model: DataFrame, columns: list[str], limit: int) -> bytes:
    """An Arrow stream of at most `limit` rows by voxel_id, doubles as 32-bit floats: what a viewer takes in one response."""
    small = {"double": "float", "bigint": "int"}
    kinds = dict(model.dtypes)
    table = model.orderBy("voxel_id").limit(limit).select(*[F.col(c).cast(small.get(kinds[c], kinds[c])) for c in columns]).toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def run_bundle(spark: SparkSession, folder: str, most_bytes: int = 64 << 20) -> bytes:
    """A ZIP of a run's files and their manifest, for a download; of at most most_bytes, a size that is checked before anything is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if size > most_bytes:
        raise ValueError(f"{size} bytes; a bundle has {most_bytes} at most")
    listed = [r.asDict() for r in manifest(spark, folder).orderBy("file").collect()]
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as out:
        for r in files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").orderBy("file").collect():
            out.writestr(r["file"], bytes(r["content"]))
        out.writestr("manifest.json", json.dumps({"files": listed}, indent=1))
    return sink.getvalue()


def rectilinear_grid(model: DataFrame, value: str, nx: int, ny: int, nz: int, size: float, most_cells: int = 200_000) -> str:
    """A VTK rectilinear grid as XML; for grids of at most most_cells, a size that is checked."""
    if nx * ny * nz > most_cells:
        raise ValueError(f"{nx * ny * nz} cells; a viewer's grid has {most_cells} at most")
    cells = model.select((F.col("ix") + F.col("iy") * nx + F.col("iz") * nx * ny).alias("at"), F.coalesce(F.nanvl(F.col(value), F.lit(NO_DATA)), F.lit(NO_DATA)).alias("v")).collect()
    values = [NO_DATA] * (nx * ny * nz)
    for r in cells:
        values[r["at"]] = r["v"]
    axis = lambda n: " ".join(str(i * size) for i in range(n + 1))
    array = lambda name, text: f'<DataArray type="Float64" Name="{name}" format="ascii">{text}</DataArray>'
    extent = f"0 {nx} 0 {ny} 0 {nz}"
    return (
        f'<?xml version="1.0"?>\n<VTKFile type="RectilinearGrid" version="0.1" byte_order="LittleEndian"><RectilinearGrid WholeExtent="{extent}"><Piece Extent="{extent}">'
        f'<CellData Scalars="{value}">{array(value, " ".join(map(str, values)))}</CellData><Coordinates>{array("x", axis(nx))}{array("y", axis(ny))}{array("z", axis(nz))}</Coordinates></Piece></RectilinearGrid></VTKFile>\n'
    )
