"""Archives on file systems that Hadoop and Arrow name differently, or that need an opener of their own."""

import pytest

from burnline.llm import warc


@pytest.mark.parametrize(
    ("path", "uri"),
    [("/x/y", "file:///x/y"), ("file:/x/y", "file:/x/y"), ("file:///x", "file:///x"), ("s3a://b/x", "s3://b/x"), ("s3n://b/x", "s3://b/x"), ("s3://b/x", "s3://b/x"), ("hdfs://h:8020/x", "hdfs://h:8020/x"), ("dbfs:/x/y", "file:///dbfs/x/y"), ("dbfs:///x", "file:///dbfs/x")],
)
def test_names_of_file_systems(path, uri):
    assert warc.arrow_uri(path) == uri


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}"])
def test_local_paths_in_every_form(spark, tmp_path, form):
    path = form.format(tmp_path / "archives")
    pages = spark.createDataFrame([(1, "u", "a"), (2, "v", "a"), (3, None, None)], "page_id bigint, url string, html string")
    written = warc.write_archives(pages, path).collect()
    got = warc.read_archives(spark, path, [r.archive for r in written]).collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {(1, "revisit", 2), (2, "response", None), (3, "response", None)}


def test_an_opener_of_ones_own(spark, tmp_path):
    root = str(tmp_path)

    def opener(path):
        from pyarrow import fs

        return fs.SubTreeFileSystem(root, fs.LocalFileSystem()), path.removeprefix("box://")

    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id bigint, url string, html string")
    written = warc.write_archives(pages, "box://in/here", opener=opener).collect()
    assert list((tmp_path / "in" / "here").glob("*.warc.gz"))
    got = warc.read_archives(spark, "box://in/here", [r.archive for r in written], opener=opener).collect()
    assert {(r.page_id, bytes(r.payload)) for r in got} == {(i, f"page {i}".encode()) for i in range(20)}
