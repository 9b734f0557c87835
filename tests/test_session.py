from pathlib import Path

from querytide.session import drop_stored, shared_folder, stored


def test_stored_tables_are_dropped(spark):
    drop_stored(spark)
    table = stored(spark.range(3).toDF("a"), "some-table")
    folder = Path(shared_folder(spark).removeprefix("file://"))
    assert table.count() == 3 and list(folder.glob("some-table-*"))
    assert drop_stored(spark) == 1 and not list(folder.glob("some-table-*"))
    assert drop_stored(spark) == 0
