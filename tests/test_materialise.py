"""Stored tables: their files, and who has to start processes for them."""

from glob import glob

from seqlake.plans import materialise


def test_stored_parts_have_no_checksum_files(spark):
    out = materialise.stored(spark.range(0, 100, 1, 5), "plain")
    folder = out.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert sorted(r["id"] for r in out.collect()) == list(range(100))
    assert len(glob(f"{folder}/part-*")) == 5 and not glob(f"{folder}/.*.crc")
    plain = f"{folder}-checked"
    spark.range(3).write.parquet(plain)  # writes of others are as they were
    assert glob(f"{plain}/.*.crc")
