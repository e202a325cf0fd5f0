"""Row numbers of the pipeline hold from job to job."""

import corpus_pipeline as P


def test_rows_keep_their_numbers_when_scans_are_planned_anew(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "en", "s", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s", 0) for i in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(20).write.parquet(f"{tmp_path}/d")
    link = P.link_components
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def linked(*args, **kwargs):
        found = P.cut(link(*args, **kwargs), "found")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")  # a file a partition, as with more cores
        return found

    monkeypatch.setattr(P, "link_components", linked)
    try:
        out = P.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/d"), "")
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == list(range(60))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
