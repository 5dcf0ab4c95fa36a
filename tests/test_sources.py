import struct
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from modalweave.config import Config, check_pairwise
from modalweave.operators import raster as R
from modalweave.sources import images, sinks, tables


def png(path, width, height, rgb):
    """A minimal RGB picture file."""

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\x00" + bytes(v for x in range(width) for v in rgb(x, y)) for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    )


def test_csv_tables(spark, tmp_path):
    (tmp_path / "meta.csv").write_text("cell_id,day,donor,technology,cell_type\na,2,31800,cite,BP\nb,,13176,multi,MoP\n")
    (tmp_path / "prot.csv").write_text("cell_id,CD3,CD.4\na,0.5,1\nb,2.25,-3\n")
    meta = tables.read_metadata(spark, str(tmp_path / "meta.csv"))
    assert [tuple(r) for r in meta.collect()] == [("a", 2, 31800, "cite", "BP"), ("b", None, 13176, "multi", "MoP")]
    rows, names = tables.read_modality(spark, str(tmp_path / "prot.csv"))
    assert names == ["CD3", "CD.4"]
    assert {r["cell_id"]: r["features"] for r in rows.collect()} == {"a": [0.5, 1.0], "b": [2.25, -3.0]}


def test_columns_are_matched_by_name(spark, tmp_path):
    folder = tmp_path / "rna"
    folder.mkdir()
    (folder / "1.csv").write_text("cell_id,g1,g2\na,1,2\n")
    (folder / "2.csv").write_text("g2,cell_id,g1\n20,b,10\n")
    (folder / "3.csv").write_text("cell_id,g1,g2\nc,5,\n")
    rows, names = tables.read_modality(spark, str(folder))
    assert names == ["g1", "g2"]
    got = {r["cell_id"]: r["features"] for r in rows.collect()}
    assert got == {"a": [1.0, 2.0], "b": [10.0, 20.0], "c": [5.0, None]}
    (folder / "4.csv").write_text("cell_id,g1,g3\nd,1,2\n")
    with pytest.raises(ValueError, match="other columns"):
        tables.read_modality(spark, str(folder))


def test_images_end_to_end(spark, tmp_path):
    folder = tmp_path / "img"
    folder.mkdir()
    png(folder / "one.png", 8, 4, lambda x, y: (255 if x < 4 else 0, 0, 51))
    png(folder / "two.png", 4, 4, lambda x, y: (0, 255, 0))
    (tmp_path / "manifest.csv").write_text("cell_id,file\na,one.png\nb,sub/two.png\nc,gone.png\nd,bad.png\n")
    (folder / "bad.png").write_bytes(b"no image")
    manifest = tables.read_manifest(spark, str(tmp_path / "manifest.csv"))
    joined = tables.attach_images(manifest, tables.read_images(spark, str(folder)))
    vectors = {r["cell_id"]: r["features"] for r in images.image_vectors(joined, size=2, patch=None).collect()}
    assert set(vectors) == {"a", "b", "c", "d"}
    assert vectors["c"] is None and vectors["d"] is None
    assert {r["cell_id"] for r in tables.rejected_images(joined).collect()} == {"c", "d"}
    with pytest.raises(ValueError, match="2 manifest rows"):
        tables.require_images(joined)
    joined = joined.where("cell_id IN ('a', 'b')")
    tables.require_images(joined)
    assert vectors["a"] == pytest.approx([1, 0, 1, 0, 0, 0, 0, 0, 0.2, 0.2, 0.2, 0.2])
    assert vectors["b"] == pytest.approx([0] * 4 + [1] * 4 + [0] * 4)
    whole = images.image_vectors(joined, size=64, patch=8).first()["features"]
    assert len(whole) == 8 * 8 * 3
    flipped = [images.image_vectors(joined, 2, None, True, e).where("cell_id = 'a'").first()["features"][:4] for e in range(8)]
    assert [1, 0, 1, 0] in flipped and [0, 1, 0, 1] in flipped


def test_focal_sum_returns_every_output(spark):
    px = pixel_frame(spark, 3, 3, lambda y, x: 3 * y + x)
    got = as_grid(R.focal_sum(px, [(1, 1, 0, 0, 1.0)], (3, 3), bias=[0.5]))
    assert len(got) == 9 and sorted(got.values()) == sorted([4.5, 5.5, 7.5, 8.5] + [0.5] * 5)
    assert len(as_grid(R.focal_sum(px, [(1, 1, 0, 0, 1.0)], (3, 3), stride=2, bias=[0.5]))) == 4


def test_manifest_needs_one_file_column(spark, tmp_path):
    (tmp_path / "m.csv").write_text("cell_id,a,b\nx,1,2\n")
    with pytest.raises(ValueError):
        tables.read_manifest(spark, str(tmp_path / "m.csv"))


def test_keep_first_in_file_order(spark, tmp_path):
    lines = ["cell_id,day,donor,technology,cell_type"]
    lines += [f"c{i % 400},{9000 - i},{i % 3},t,{'zyx'[i % 3]}" for i in range(4000)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "m" / "b.csv").write_text(lines[0] + "\n" + "c0,1,7,u,aa\n" + "new,1,7,u,aa\n" + "new,0,0,u,a\n")
    split = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "0"}
    for k, v in split.items():
        spark.conf.set(k, v)
    try:
        meta = tables.read_metadata(spark, str(tmp_path / "m"), positions=True)
        assert meta.rdd.getNumPartitions() > 5
        got = {r["cell_id"]: tuple(r)[1:] for r in tables.first_in_file(meta.repartition(7), ["cell_id"]).collect()}
    finally:
        for k in split:
            spark.conf.unset(k)
    assert len(got) == 401 and got["new"] == (1, 7, "u", "aa")
    assert all(got[f"c{i}"] == (9000 - i, i % 3, "t", "zyx"[i % 3]) for i in range(400))


def test_header_pass_reads_the_first_lines_only(spark, tmp_path):
    (tmp_path / "w").mkdir()
    row = ",".join(["1.5"] * 50)
    for name, n in (("a", 5), ("b", 40_000)):
        head = "" if name == "a" else "\n  \n"
        (tmp_path / "w" / f"{name}.csv").write_text(head + "cell_id," + ",".join(f"f{i}" for i in range(50)) + "\n" + f"{name},{row}\n" * n)
    tracker = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext.setJobGroup("heads", "")
    found = tables.header_index(spark, str(tmp_path / "w"))
    spark.sparkContext.setJobGroup("rest", "")
    assert len(found) == 1 and [len(files) for files in found.values()] == [2]
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("heads")
    stages = [s for j in jobs for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds]
    read = sum(tracker.lastStageAttempt(s).inputRecords() for s in stages)
    assert read < 1000, read
    df, names = tables.read_modality(spark, str(tmp_path / "w"))
    assert len(names) == 50 and df.count() == 40_005


def test_durable_table_has_no_lineage(spark):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    kept = sinks.durable(df, "t")
    assert sorted(tuple(r) for r in kept.collect()) == sorted(tuple(r) for r in df.collect())
    assert "Range" not in kept._jdf.queryExecution().optimizedPlan().toString()


def pixel_frame(spark, h, w, f):
    rows = [(0, y, x, 0, float(f(y, x))) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "img int, y int, x int, c int, v double")


def as_grid(df):
    return {(r["y"], r["x"]): r["v"] for r in df.collect()}


@pytest.mark.parametrize("size,new", [((4, 4), (6, 6)), ((2, 3), (5, 7)), ((6, 6), (4, 4)), ((16, 16), (64, 64))])
def test_nearest_resize(spark, size, new):
    got = as_grid(R.nearest_upsample(pixel_frame(spark, *size, lambda y, x: y * 100 + x), size, new))
    want = {(y, x): (y * size[0] // new[0]) * 100.0 + x * size[1] // new[1] for y in range(new[0]) for x in range(new[1])}
    assert got == want


def test_focal_sum_with_zero_border(spark):
    kernel = [(dy, dx, 0, 0, 1.0) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    got = as_grid(R.focal_sum(pixel_frame(spark, 3, 3, lambda y, x: 1), kernel, (3, 3)))
    assert got[1, 1] == 9.0 and got[0, 0] == 4.0 and got[0, 1] == 6.0 and len(got) == 9


def test_flip_keeps_pixels_and_can_be_limited(spark):
    px = pixel_frame(spark, 2, 3, lambda y, x: y * 3 + x)
    grids = [as_grid(R.flip(px, (2, 3), epoch=e)) for e in range(8)]
    assert len({tuple(sorted(g.items())) for g in grids}) == 4
    assert all(as_grid(R.flip(px, (2, 3), epoch=e, only=F.lit(False))) == as_grid(px) for e in range(4))


def test_config_checks():
    assert Config(modalities=("a", "b", "c"), hidden_dims=(7,)).hidden == (7, 7, 7)
    for bad in (
        dict(hidden_dims=(1, 2, 3)),
        dict(modality_weights=(1, 2, 3)),
        dict(model="other"),
        dict(keep="first"),
        dict(dropout=1.0),
        dict(modalities=()),
    ):
        with pytest.raises(ValueError):
            Config(**bad)
    with pytest.raises(ValueError):
        check_pairwise(["a", "b", "c"])
    for change in (dict(epochs=3), dict(dropout=0.1), dict(seed=1), dict(keep="last"), dict(val_fraction=0.3)):
        assert Config().with_(**change).run_name != Config().run_name
    assert Config(results="elsewhere").run_name == Config().run_name


def test_rows_of_megabytes_are_read_written_and_handed_on_few_at_once(spark, tmp_path):
    """A batch for Python and a row group of a file had as many blocks as a task has, up to 64 and 128 MB."""
    held = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(held)
    noise = "unhex(array_join(transform(sequence(1, 24000), i -> sha2(string(id * 100000 + i), 256)), ''))"
    rows = spark.range(0, 60, 1, 1).selectExpr("id", f"{noise} AS vectors")
    rows = sinks.durable(rows, "blocks", blocks=True)
    groups = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata for f in rows.inputFiles()]
    sizes = [g.row_group(i).total_byte_size for g in groups for i in range(g.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 60 and max(sizes) < 24 << 20

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    got = sinks.durable(rows.mapInArrow(run, "n long, size long"), "sizes", blocks=True).collect()
    assert sum(r["n"] for r in got) == 60 and max(r["size"] for r in got) < 8 << 20
    assert spark.conf.get(held) == before
