"""Extra columns of odd names and kinds go through every stage untouched."""

import corpus_pipeline as cp
from cases import SF
from pyspark.sql import functions as F


def test_odd_columns(spark):
    docs = spark.createDataFrame([(1, "some words here", "en", "s", 15), (2, None, None, None, None), (3, "ein Text", "de", "s", 8)],
                                 "doc_id long, text string, lang string, source string, n_chars long").withColumns({
        "a b": F.lit(1), "key": F.array(F.lit("x")), "_row": F.lit("r"), "lang_pred": F.create_map(F.lit("k"), F.lit(1)), "score": F.struct(F.lit(2).alias("x y")),
        "row_key": F.lit(None).cast("double"), "component_id": F.lit("c"), "doc": F.lit(b"b"), "places": F.lit(0), "fp": F.lit(1.5)})
    names = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names, name
        assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == [1, 3]
    assert docs.where("doc_id = 1").select(F.col("score")["x y"].alias("v")).first().v == 2
