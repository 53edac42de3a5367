"""The pipeline's stages, each against what its operator says of its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import exact_dedup, near_dedup, secret_scan

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        kept.append((docs, spark.read.parquet(str(tmp_path / str(k)))))
        docs = kept[-1][1]
    counts = [b.count() for _, b in kept]
    assert counts[0] >= 0.98 * kept[0][0].count()
    ids = lambda d: {r[0] for r in d.select("doc_id").collect()}
    assert ids(kept[1][1]) == ids(exact_dedup.exact_groups(spark, kept[1][0]).where("kept"))
    assert ids(kept[2][1]) == ids(near_dedup.near_groups(spark, kept[2][0], 5, 80).where("kept"))
    assert counts[3] == counts[2]
    assert secret_scan.digest(kept[3][1]).agg(F.sum(F.col("n_assign") + F.col("n_access") + F.col("n_hex"))).first()[0] == 0
    assert ids(kept[4][1]) == ids(kept[3][1])
