"""Plans never give two files one name, nor a name that is there."""

from framelake.plans import actions


def plan(spark, paths, existing=()):
    photos = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "key long, path string")
    held = spark.createDataFrame([("/out", n) for n in existing], "dir string, name string") if existing else None
    return [x.dst[5:] for x in actions.export_plan(photos, photos, "/out", held).orderBy("key").collect()]


def test_own_names_are_taken(spark):
    assert plan(spark, ["/x/n.jpg", "/y/n.jpg", "/z/n_1.jpg"]) == ["n.jpg", "n_2.jpg", "n_1.jpg"]


def test_names_of_the_folder_are_taken(spark):
    assert plan(spark, ["/x/n.jpg", "/y/n.jpg", "/z/m"], ["n.jpg", "n_1.jpg", "m", "m_2"]) == ["n_2.jpg", "n_3.jpg", "m_1"]


def test_numbered_names_repeat(spark):
    got = plan(spark, ["/a/n_1.jpg", "/b/n_1.jpg", "/c/n.jpg", "/d/n.jpg", "/e/n_01.jpg"], ["n_2.jpg"])
    assert got == ["n_1.jpg", "n_1_1.jpg", "n.jpg", "n_3.jpg", "n_01.jpg"] and len(set(got)) == 5
