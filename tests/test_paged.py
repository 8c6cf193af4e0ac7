"""The data source of paged documents."""

import hashlib

import pytest
from pyspark.sql import functions as F

from skein.sources import documents, paged


class FormFeeds:
    """Texts whose pages end with form feeds; the first line is title and author."""

    def open(self, file):
        head, _, body = file.read().decode().partition("\n")
        if not head.startswith("%DOC"):
            raise ValueError("not a document")
        pages = body.split("\f")

        class Doc:
            num_pages = len(pages)

            def details(self):
                title, _, author = head[4:].strip().partition("/")
                return title or None, author or None, None, False

            def page(self, number):
                if "broken" in pages[number]:
                    raise OSError("unreadable")
                return pages[number]

        return Doc()


@pytest.fixture
def shelf(spark, tmp_path):
    paged.register(spark)
    (tmp_path / "sub").mkdir()
    (tmp_path / "large.doc").write_text("%DOC Large/Someone\n" + "\f".join(f"page {i} " + "x" * 1000 for i in range(100)))
    for i in range(10):
        (tmp_path / "sub" / f"{i}.doc").write_text(f"%DOC\nonly page {i}\fbroken")
    (tmp_path / "junk.doc").write_text("junk")
    (tmp_path / "other.txt").write_text("%DOC\nnot asked for")
    return tmp_path


def read(spark, where, **options):
    reader = spark.read.format("skein-pages").option("parser", f"{__name__}:FormFeeds").option("suffix", ".doc")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(str(where))


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_a_large_file_is_parsed_by_several_tasks(spark, shelf, scheme):
    got = read(spark, f"{scheme}{shelf}", partitionBytes=20_000).withColumn("task", F.spark_partition_id()).cache()
    large = got.where("filename = 'large.doc'")
    assert [r.page_num for r in large.orderBy("page_num").collect()] == list(range(100))
    assert all(r.text.startswith(f"page {r.page_num} ") and (r.num_pages, r.title, r.author) == (100, "Large", "Someone") for r in large.collect())
    assert large.select("task").distinct().count() == 6
    assert got.where("path LIKE '%/sub/%'").select("task").distinct().count() == 1
    small = {(r.filename, r.page_num): (r.text, r.success, r.error) for r in got.where("path LIKE '%/sub/%'").collect()}
    assert small[("3.doc", 0)] == ("only page 3", True, None) and small[("3.doc", 1)] == ("", False, "OSError: unreadable") and len(small) == 20
    junk = got.where("filename = 'junk.doc'").collect()
    assert len(junk) == 1 and junk[0].error == "ValueError: not a document" and junk[0].num_pages == 0
    assert got.where("filename = 'other.txt'").count() == 0


def test_files_without_their_pages(spark, shelf):
    got = {r.filename: r for r in read(spark, shelf, what="files", partitionBytes=1000).collect()}
    assert len(got) == 12 and got["large.doc"].num_pages == 100 and got["junk.doc"].error
    assert got["large.doc"].content_hash == hashlib.sha256((shelf / "large.doc").read_bytes()).hexdigest()
    assert got["large.doc"].file_size_bytes == (shelf / "large.doc").stat().st_size


def test_blank_pages_and_missing_folders(spark, shelf, tmp_path):
    (shelf / "blank.doc").write_text("%DOC\n \ftext")
    shown = documents.shown(read(spark, shelf / "blank.doc"))
    assert {r.page_num: r.text for r in shown.collect()} == {0: "[Image-only page 1]", 1: "text"}
    assert documents.shown(read(spark, shelf / "sub"), skip_failed=True).count() == 10
    empty = tmp_path / "none"
    empty.mkdir()
    assert read(spark, empty).count() == 0
    with pytest.raises(Exception, match="FileNotFoundError|not there"):
        read(spark, tmp_path / "not there").count()


def test_shares_cover_each_file_once():
    shares = [s for part in paged.dealt([("a", 10), ("b", 100), ("c", 45), ("d", 0), ("e", 30)], 50, False) for s in part]
    assert sorted((s.path, s.part) for s in shares) == [("a", 0), ("b", 0), ("b", 1), ("c", 0), ("d", 0), ("e", 0)]
    assert all(sum(s.size for s in part) <= 50 for part in paged.dealt([(str(i), i) for i in range(50)], 50, True))
