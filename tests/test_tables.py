import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packsight.operators import icons, metadata, ranking, tables
from packsight.operators.package import IconOptions, Package
from packsight.plans import queries as relational
from packsight.sources.archive import MANIFEST, write_archive
from packsight.sources.chunks import write_xml
from packsight.sources.pushdown import PackageEntries
from packsight.sources.samples import corpus, element, package
from packsight.streaming.ingest import arriving, ingest

BAD = [("bad", b"no archive"), ("cut", package(3)[:300]), ("empty", b"")]


@pytest.fixture(scope="module")
def packages(spark):
    return tables.containers_of(spark, corpus(10) + BAD)


def test_entries_and_errors(packages):
    rows = tables.entries(packages).collect()
    assert {r.container_id for r in rows if r.error} == {"bad", "cut", "empty"}
    assert sum(r.path == MANIFEST for r in rows) == 10


def test_failfast_raises(packages):
    with pytest.raises(Exception, match="end of central directory"):
        tables.entries(packages, mode="FAILFAST").count()


def test_metadata_of_a_known_manifest(spark):
    perm = lambda n, tag="uses-permission", **a: element(tag, name=f"android.permission.{n}", **a)
    manifest = element(
        "manifest", element("uses-sdk", minSdkVersion=26, targetSdkVersion=34), perm("INTERNET"), perm("CAMERA", maxSdkVersion=32, required=False),
        perm("ACCESS_FINE_LOCATION", "uses-permission-sdk-23"), perm("INTERNET", maxSdkVersion=5), element("application", label="Example", icon="@mipmap/ic_launcher"),
        package="com.example.app", versionCode=42, versionName="1.2.3",
    )
    libs = [(f"lib/{a}/x.so", b"", 0) for a in ("armeabi-v7a", "arm64-v8a", "arm64-v8a/deep", "unknown")]
    row = metadata.metadata(tables.containers_of(spark, [("p", write_archive([(MANIFEST, write_xml(manifest), 8), *libs]))])).first()
    assert (row.package_name, row.version_code, row.version_name, row.min_sdk, row.target_sdk, row.application_label) == ("com.example.app", 42, "1.2.3", 26, 34, "Example")
    assert row.architectures == ["arm64-v8a", "armeabi-v7a"] and row.launcher_icon_ref == "@mipmap/ic_launcher"
    assert [(p.name[19:], p.max_sdk_version, p.required) for p in row.permissions] == [("ACCESS_FINE_LOCATION", None, True), ("CAMERA", 32, False), ("INTERNET", None, True)]


def test_metadata_floors_and_fallbacks(spark):
    cases = {
        "none": element("manifest", package=" "),
        "zero": element("manifest", package="a", versionCode=0, minSdkVersion=7),
        "text": element("manifest", element("application", label=("ref", 0x7F0A0000)), package="a", versionCode="12"),
    }
    df = tables.containers_of(spark, [(n, write_archive([(MANIFEST, write_xml(m), 0)])) for n, m in cases.items()])
    rows = {r.container_id: r for r in metadata.metadata(df).collect()}
    assert set(rows) == {"zero", "text"}
    assert (rows["zero"].version_code, rows["zero"].min_sdk, rows["zero"].target_sdk) == (1, 7, 7)
    assert rows["text"].version_code == 12 and rows["text"].application_label is None and rows["text"].permissions == []


def test_order_and_partitions_do_not_matter(spark):
    df = tables.containers_of(spark, corpus(10))
    a = metadata.metadata(df).orderBy("container_id").collect()
    b = metadata.metadata(df.orderBy(F.desc("container_id")).repartition(7)).orderBy("container_id").collect()
    assert a == b


def test_labels_resolve_through_references(packages):
    rows = {r.container_id: r.application_label for r in metadata.metadata(packages).collect()}
    assert rows["app1.apk"] == "Label 1" and rows["app2.apk"] == "App 2"


def test_relational_ranking_agrees_with_the_procedure(packages):
    got = {r.container_id: r.path for r in ranking.best_raster(tables.last_duplicates(tables.entries(packages))).collect()}
    assert got == {name: Package(data).raster_candidates()[0] for name, data in corpus(10)}
    ranks = ranking.raster_candidates(tables.entries(packages)).where("container_id = 'app5.apk'").orderBy("rank").collect()
    assert [r.path for r in ranks] == Package(package(5)).raster_candidates()


def test_lookup_by_name(spark, packages):
    refs = spark.createDataFrame([("app1.apk", "drawable", "ic_launcher"), ("app2.apk", "drawable", "alias"), ("app2.apk", "color", "alias")], "container_id string, res_type string, res_name string")
    got = {(r.container_id, r.path) for r in ranking.by_name(refs, tables.entries(packages)).collect()}
    assert got == {("app1.apk", p) for p in Package(package(1)).named("drawable", "ic_launcher")} | {("app2.apk", "res/drawable-hdpi/alias.jpg")}


def test_references_relational_and_procedural_agree(packages):
    got = metadata.resolve_references(tables.res_values(packages)).where("container_id = 'app0.apk' AND root = 2130837505").orderBy("route").collect()
    assert [r.str for r in got] == [v.text for v in Package(package(0)).table.resolve(0x7F020001)]


def test_icons_inspection_preview_and_session(packages):
    shown = icons.icons(packages, sizes=(16, 32)).collect()
    assert len(shown) == 26 and all(r.width == r.height == r.size for r in shown if r.png) and sum(r.png is None for r in shown) == 6
    assert {r.container_id: (r.icon_ref, r.resolved_path) for r in icons.inspect(packages).where("error IS NULL").collect()} == {n: Package(d).inspect() for n, d in corpus(10)}
    assert icons.preview(packages, IconOptions(size=8)).where("png IS NOT NULL").count() == 10
    session = icons.Session(packages)
    assert session.record() is session.record(IconOptions(size=9)) and session.icons(sizes=(4,)).where("png IS NOT NULL").count() == 10
    session.close()


@pytest.mark.parametrize("name", ["q_package_paths", "q_resource_references", "q_metadata_tables", "q_bundles"])
def test_tables_that_python_made_are_not_broadcast(spark, name):
    """Spark takes their size from the table that they are made from: 900,000 customers are 4 MB, their entries are not."""
    df = relational.queries()[name](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_last_duplicates_with_counts(spark):
    df = tables.entries(tables.containers_of(spark, [("a", write_archive([(MANIFEST, b"", 0), ("res/x.png", b"1", 0), ("res/x.png", b"345", 0)])), *BAD]))
    got = tables.last_duplicates(df, F.count(F.lit(1)).alias("n")).collect()
    assert {(r.container_id, r.path, r.cd_index, r.usize, r.n) for r in got} == {("a", MANIFEST, 0, 0, 1), ("a", "res/x.png", 2, 3, 2)}
    assert tables.last_duplicates(df).columns == df.columns[:-1]


def test_large_packages_cross_over_a_few_at_a_time(spark):
    """Both ways: 30 packages of a megabyte are neither one batch in nor, as base members, one batch out."""
    big = F.expr("repeat('x', 1000000)").cast("binary")
    df = spark.range(0, 30, 1, 1).select(F.col("id").cast("string").alias("container_id"), big.alias("content"))
    out = tables.flat_map(df, lambda data: [(bytes(data),)], "container_id string, content binary")
    count = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)
    for found in (df, out):
        sizes = [r.n for r in found.mapInArrow(count, "n long").collect()]
        assert sum(sizes) == 30 and max(sizes) <= 6


def test_rows_go_back_before_they_are_many_bytes():
    seen = []

    class Plan:
        sparkSession = None
        select = lambda self, *c: self
        mapInArrow = lambda self, run, schema: run

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tables, "ship_for_packages", lambda spark: seen.append(spark))
        run = tables.flat_map(Plan(), lambda data: [(data,), (None,)], "container_id string, content binary")
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(30)]), pa.array([b"x" * 1_000_000] * 30)], ["container_id", "content"])
    sizes = [b.num_rows for b in run(iter([batch]))]
    assert sum(sizes) == 60 and max(sizes) <= 10 and seen == [None]


def test_stage_report(spark):
    row = icons.stage_report(spark.createDataFrame([("a", float(i)) for i in range(10)], "stage string, ms double")).first()
    assert (row.n, row.total_ms, row.p50_ms, row.p95_ms, row.max_ms) == (10, 45.0, 4.0, 8.0, 9.0)


def test_files_pushdown_and_streaming(spark, tmp_path):
    for name, data in corpus(4):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "copy.apk").write_bytes(package(1))
    assert tables.entries(tables.containers(spark, str(tmp_path))).where(F.col("path") == MANIFEST).count() == 5
    spark.dataSource.register(PackageEntries)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source = spark.read.format("package_entries").load(str(tmp_path))
    assert source.where("path LIKE 'lib/%' AND usize > 0").count() == source.where("usize > 0").collect().__len__() - source.where("NOT path LIKE 'lib/%' AND usize > 0").count()
    assert "StartsWith(path" not in source.where("path LIKE 'lib/%'")._jdf.queryExecution().executedPlan().toString()
    run = ingest(arriving(spark, str(tmp_path)), tables.entries, str(tmp_path / "out"), str(tmp_path / "log"))
    run.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("path") == MANIFEST).count() == 4


def test_command_line(spark, tmp_path, capsys):
    from packsight.__main__ import main, stages

    (tmp_path / "a.apk").write_bytes(package(1))
    main(["inspect", str(tmp_path)])
    assert "ic_launcher.png" in capsys.readouterr().out
    main(["render", str(tmp_path), "--size", "16", "--out", str(tmp_path / "icons")])
    assert spark.read.parquet(str(tmp_path / "icons")).first().width == 16
    assert stages(tables.containers(spark, str(tmp_path)), 1).count() == 5


def test_calls_by_path_bytes_and_table(spark, tmp_path):
    from packsight import api

    (tmp_path / "a.apk").write_bytes(package(2))
    given = [("a", package(2))]
    for packages_ in (str(tmp_path), given, api.packages(spark, given)):
        assert api.inspect_icons(spark, packages_).first().icon_ref == "@drawable/alias"
    assert api.extract_png(spark, given).columns == ["container_id", "png"] and api.extract_png(spark, given).first().png[:4] == b"\x89PNG"
    assert api.metadata(spark, given).first().package_name == "com.example.app2" and api.permissions(spark, given).count() == 3
    assert api.preview(spark, given).first().png and api.open_session(spark, given).metadata().count() == 1
    bundle = write_archive([("base.apk", package(2), 0)])
    assert bytes(api.base_packages(spark, [("b", bundle)]).first().content) == package(2) and api.metadata(spark, [("b", bundle)]).count() == 1


def test_labels_by_tables_and_on_the_spot_agree(packages):
    by_tables = metadata.metadata_of(tables.manifest_rows(packages), tables.entries(packages), metadata.texts_of(tables.res_values(packages)))
    assert sorted(map(str, by_tables.collect())) == sorted(map(str, metadata.metadata(packages).collect()))


def test_order_statistics_of_one_large_group(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ACCURACY", 1000)
    n = 200_000
    df = spark.range(n).select(F.lit(None).cast("string").alias("g"), ((F.col("id") * 7919) % n).cast("double").alias("v")).unionByName(spark.createDataFrame([("few", 3.0), ("few", 1.0), ("few", None), ("none", None)], "g string, v double"))
    for p in (0.0, 0.001, 0.5, 0.95, 1.0):
        got = {r.g: r.v for r in ranking.order_statistic(df, "g", "v", p).collect()}
        assert got == {None: float(int((n - 1) * p)), "few": 3.0 if p == 1 else 1.0}


def test_metadata_by_one_pass_and_by_tables_agree(spark):
    odd = element("manifest", element("uses-sdk", minSdkVersion="x", targetSdkVersion="21"), element("application", label="@0x7f010000", icon=" "), element("activity-alias", icon="@a/b", enabled="false"), package=" p ", versionCode="-3")
    df = tables.containers_of(spark, corpus(25) + BAD + [("odd", write_archive([(MANIFEST, write_xml(odd), 8)]))])
    by_tables = metadata.metadata_of(tables.manifest_rows(df), tables.entries(df), metadata.texts_of(tables.res_values(df)))
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert key(metadata.metadata(df).collect()) == key(by_tables.collect())
    plan = metadata.metadata(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    plan = icons.preview(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_whatever_a_parser_raises_is_a_row(spark, monkeypatch):
    def broken(data):
        yield 1 / 0

    rows = tables.flat_map(tables.containers_of(spark, corpus(2)), broken, "container_id string, x int").collect()
    assert [r.error.startswith("ZeroDivisionError") for r in rows] == [True, True]


def test_unreadable_packages_have_a_row_in_the_data_source(spark, tmp_path):
    (tmp_path / "good.apk").write_bytes(package(1))
    (tmp_path / "bad.apk").write_bytes(b"no archive")
    spark.dataSource.register(PackageEntries)
    df = spark.read.format("package_entries").load(str(tmp_path))
    assert [r.container_id.endswith("bad.apk") for r in df.where("error IS NOT NULL").collect()] == [True]
    assert df.where(f"path = '{MANIFEST}'").count() == 1


def test_icons_as_files(spark, tmp_path, capsys):
    from packsight.__main__ import main

    (tmp_path / "in").mkdir()
    for name, data in corpus(3):
        (tmp_path / "in" / name).write_bytes(data)
    main(["dump", str(tmp_path / "in"), "--size", "24", "--out", str(tmp_path / "out")])
    assert len(list((tmp_path / "out" / "adaptive").glob("*.png"))) == 3 and len(list((tmp_path / "out" / "raster").glob("*.png"))) == 3
    assert "6 icons" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["dump", str(tmp_path / "in")])


def test_stage_report_as_text(spark):
    text = icons.report_text(icons.stage_report(spark.createDataFrame([("a", 1.0), ("b", 3.0)], "stage string, ms double")))
    assert [line.split()[0] for line in text.split("\n")] == ["stage", "b", "a"] and "75.0%" in text


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    from packsight import session

    class Conf:
        get = staticmethod(lambda name, default=None: default)

    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

    class Cluster:
        conf, sparkContext = Conf, Context

    class Nothing:
        isDefined = staticmethod(lambda: False)

    monkeypatch.setattr(Context, "_jsc", type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: Nothing)}))}))
    with pytest.raises(ValueError, match="checkpoint.dir"):
        session.shared_dir(Cluster)


def test_scratch_tables_can_be_removed(spark):
    import os

    from packsight import session

    scratch = session.Scratch(spark, "t")
    assert scratch.keep(spark.range(5), "x").count() == 5
    root = scratch.root.removeprefix("file://")
    assert os.path.isdir(root)
    session.clean(spark)
    assert not os.path.exists(root)
