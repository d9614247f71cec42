"""Files in and out: tiles, curves in tar files and folders, clusters, streams."""

from __future__ import annotations

import io
import tarfile

from pyspark.sql import functions as F

from nearfold.operators.sums import gram
from nearfold.sources.curves import read_curve_folder
from nearfold.sources.features import as_vectors, padded, read_tiles, write_partitioned, write_tiles
from nearfold.sources.text import bezier_points, read_tree
from nearfold.sources.tiles import members, read_curve, read_tar_tiles, write_tar_tiles
from nearfold.streaming.merge import feed_gram, merged_gram

CURVE = "# object\n# survey\nmjd mag err\n1.0 17.5 0.1\n2.5 17.25 0.2\n"


def test_tiles_by_field_and_tile(spark, tmp_path):
    for field, tile in ((1, 10), (1, 11), (2, 10)):
        (tmp_path / f"F_{field}_{tile}.csv").write_text(f"id,a,b\n{field}.{tile}.1,1.5,2\n{field}.{tile}.2,,nan\n")
    rows = read_tiles(spark, str(tmp_path), columns=["a", "b"])
    assert rows.count() == 6 and read_tiles(spark, str(tmp_path), field=1, columns=["a", "b"]).count() == 4
    assert {(r.field, r.tile) for r in read_tiles(spark, str(tmp_path), tile=10, columns=["a", "b"]).collect()} == {(1, 10), (2, 10)}
    assert as_vectors(rows, ["a", "b"]).filter("id = '1.10.1'").first().vec == [1.5, 2.0]
    write_tiles(rows, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 6


def test_padding_is_by_name(spark):
    rows = spark.createDataFrame([("1.1.1", 3.0)], "id string, Std double")
    out = padded(rows).first()
    assert len(out) == 65 and out.Std == 3.0 and out.StetsonJ == 0.0


def test_tar_tiles_survive_a_bad_curve(spark, tmp_path):
    with tarfile.open(tmp_path / "tile.tar", "w") as tar:
        for name, text in (("lc_1.2.3.B.mjd", CURVE), ("lc_1.2.3.R.mjd", CURVE + "oops\n"), ("readme.txt", "x"), ("lc_1.2.4.B.mjd", "")):
            info = tarfile.TarInfo(f"tile/{name}")
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))
    rows = read_tar_tiles(spark, str(tmp_path / "*.tar")).collect()
    assert sorted((r.id, r.band, r.mag) for r in rows if r.problem is None) == [("1.2.3", "B", 17.25), ("1.2.3", "B", 17.5), ("1.2.3", "R", 17.25), ("1.2.3", "R", 17.5)]
    assert [(r.id, r.band) for r in rows if r.problem] == [("1.2.3", "R")]


def some_curves(spark, n=30):
    rows = [(f"t{i % 3}", f"1.{i % 3}.{i}", b, float(j), 10.0 + i + j / 8, 0.5) for i in range(n) for b in "BR" for j in range(1 + i * 7 % 50)]
    return spark.createDataFrame(rows, "tile string, id string, band string, t double, mag double, err double").repartition(5)


def curve_rows(df):
    return sorted((r.tile, r.id, r.band, r.t, r.mag, r.err) for r in df.collect())


def test_tiles_are_written_by_many_tasks_and_read_by_ranges(spark, tmp_path):
    """Every member comes once, whatever the ranges; a tile has a file from each task."""
    rows, path = some_curves(spark), f"file://{tmp_path}/tiles"
    write_tar_tiles(rows, path, 4)
    files = sorted(p.name for p in (tmp_path / "tiles").iterdir())
    assert len([f for f in files if f.startswith("t1.")]) > 1 and all(f.endswith(".tar") for f in files)
    want = curve_rows(rows)
    for split in (512, 3_000, 1 << 20):
        back = read_tar_tiles(spark, path, split)
        assert curve_rows(back) == want and back.filter("problem IS NOT NULL").count() == 0
    assert read_tar_tiles(spark, path, 512).rdd.getNumPartitions() > 100
    with tarfile.open(tmp_path / "tiles" / files[0]) as tar:
        assert all(m.name.startswith("lc_1.") for m in tar)


def test_one_curve_is_read_by_its_own_bytes(spark, tmp_path):
    rows, path = some_curves(spark), f"file://{tmp_path}/tiles"
    write_tar_tiles(rows, path, 2)
    assert curve_rows(read_curve(spark, path, "1.2.17", "R", 2_000)) == curve_rows(rows.filter("id = '1.2.17' AND band = 'R'"))
    assert read_curve(spark, path, "9.9.9", "B").count() == 0

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out

    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as out:
        for i in range(40):
            info = tarfile.TarInfo(f"lc_1.1.{i}.B.mjd")
            info.size = 100_000
            out.addfile(info, io.BytesIO(b"1 2 3\n" * 16_667))
    file = Counting(tar.getvalue())
    assert len(list(members(file, 0, len(tar.getvalue())))) == 40 and file.taken < 60 * 512  # headers only
    whole = [m for a in range(0, len(tar.getvalue()), 70_000) for m in members(io.BytesIO(tar.getvalue()), a, min(a + 70_000, len(tar.getvalue())))]
    assert [m[0] for m in whole] == [f"lc_1.1.{i}.B.mjd" for i in range(40)]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = some_curves(spark).withColumn("mag", F.when(F.col("id") == "1.2.17", F.raise_error(F.lit("no"))).otherwise(F.col("mag")))
    try:
        write_tar_tiles(bad, f"file://{tmp_path}/tiles", 3)
    except Exception:  # noqa: BLE001
        pass
    assert not list((tmp_path / "tiles").glob("*.tar")) if (tmp_path / "tiles").exists() else True
    assert read_tar_tiles(spark, f"file://{tmp_path}/tiles").count() == 0


def test_curve_folder_gives_the_class(spark, tmp_path):
    for name in ("QSO", "RRL"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"lc_1.2.{len(name)}{name[0]}.B.mjd").write_text(CURVE)
    rows = read_curve_folder(spark, str(tmp_path)).collect()
    assert {(r["class"], r.id, r.band) for r in rows} == {("QSO", "1.2.3Q", "B"), ("RRL", "1.2.3R", "B")} and len(rows) == 4


def test_partitioned_write_prunes(spark, tmp_path):
    write_partitioned(spark.range(100).withColumn("k", F.col("id") % 4), str(tmp_path / "p"), "k", order=("id",))
    read = spark.read.parquet(str(tmp_path / "p")).filter("k = 2")
    assert read.count() == 25 and "PartitionFilters: [isnotnull(k" in read._jdf.queryExecution().toString()


def test_tree_file_and_path(spark, tmp_path):
    (tmp_path / "tree.txt").write_text("Var. 0 > 1: f(x)=2\nVar. 0 <= 1: f(x)=3\n")
    assert read_tree(spark, str(tmp_path / "tree.txt"))["left"] == {"density": 3.0}
    out = bezier_points(spark.createDataFrame([(1, "M 0 0 Q 1 2 2 0")], "id long, path string"), 3).orderBy("i").collect()
    assert [(r.x, r.y) for r in out] == [(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)]


def test_stream_adds_up_and_goes_on(spark, tmp_path):
    rows = spark.range(40).select(F.array(F.col("id").cast("double"), (F.col("id") % 7).cast("double")).alias("vec"))
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    rows.limit(25).write.parquet(source)
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    feed_gram(stream(), state).awaitTermination()
    rows.exceptAll(rows.limit(25)).write.mode("append").parquet(source)
    feed_gram(stream(), state).awaitTermination()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(merged_gram(spark, state)) == key(gram(rows))
