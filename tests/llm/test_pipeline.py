from pathlib import Path

import corpus_pipeline as C
from skein import session
from skein.llm import near_dedup
from tests.llm.test_packing import check
from tests.llm.test_suffix_dedup import brute

SF = "/root/testdata/sf0.001"


def test_every_stage(spark, tmp_path):
    df, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in C.STAGES:
        stage(spark, df, SF).write.parquet(str(tmp_path / name))
        before, df = df, spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert df.columns == C.COLUMNS
        kept[name] = (before, df)
    before, after = kept["language_id"]
    assert {r[0] for r in before.select("doc_id").subtract(after.select("doc_id")).collect()} <= {r[0] for r in before.where("text is null or not text rlike '[a-zA-Z]{3}'").select("doc_id").collect()}
    before, after = kept["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lost = before.join(labels, "doc_id").join(after.select("doc_id"), "doc_id", "left_anti")
    # Some fifty labels teach little; how well toxic texts are found is tested on the larger tables.
    assert lost.where("toxic = 0").count() == 0 and lost.where("toxic = 1").count() > 0
    before, after = kept["near_dedup"]
    assert after.count() == near_dedup.classes(before).select("class_id").distinct().count()
    before, after = kept["suffix_dedup"]
    want = brute([(r["doc_id"], r["text"]) for r in before.collect()], 50)
    import hashlib

    got = {r["doc_id"]: r["text"] for r in after.collect()}
    sums = {i: next(iter(x)) for i, x in want.items()}
    assert all(len(got[i].encode()) <= sums[i][0] - sums[i][1] for i in got)
    assert all(hashlib.sha256(got[i].encode()).hexdigest() == sums[i][3] for i in got if got[i].isascii() and sums[i][0] - sums[i][1] == len(got[i]))
    before, after = kept["packing"]
    check([(r["doc_id"], r["text"]) for r in before.collect()], after.collect())


def test_run(spark):
    folder = Path(session.shared_dir(spark).removeprefix("file://"))
    tables = lambda: {x for d in folder.glob("skein-*") for x in d.iterdir() if x.is_dir()}
    before = tables()
    assert C.run(spark, SF).count() > 0
    # Only the last stage's table stays.
    assert len(tables() - before) == 1


def test_edges_of_every_stage(spark, docs, edges, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, columns with clashing names; and no rows at all."""
    sf = str(tmp_path / "sf")
    rows = [*edges, (8, None), (2**60, "the same words as in another document of this table here"), (11, "the same words as in another document of this table here")]
    spark.createDataFrame([(4, None, 1), (5, None, 0), (None, None, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    for name, df in (("some", docs(rows)), ("none", docs(rows).limit(0))):
        for stage, function in C.STAGES:
            out = function(spark, df, sf)
            out.write.parquet(str(tmp_path / f"{name}-{stage}"))
            out = spark.read.parquet(str(tmp_path / f"{name}-{stage}"))
            if name == "none":
                assert out.count() == 0
            if stage != "packing":
                assert out.columns == C.COLUMNS
                own = docs(rows).select(*C.COLUMNS).limit(0 if name == "none" else 1000)
                assert out.select("doc_id").exceptAll(own.select("doc_id")).count() == 0
            got = sorted((r["doc_id"] for r in out.collect()), key=repr)
            if name == "some" and stage == "near_dedup":
                # Of equal texts one row; null ids, null texts and texts without words stay, each for itself.
                assert got == sorted([1, 2, 3, 4, None, 6, 7, 8, 8, 11], key=repr)
            if name == "some" and stage == "suffix_dedup":
                assert len(got) == len(rows)
                assert {r["doc_id"]: r["text"] for r in out.collect()}[2**60] == ""
            if name == "some" and stage == "packing":
                assert len(set(got)) == len({i for i, _ in rows})
