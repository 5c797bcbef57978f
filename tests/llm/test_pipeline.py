import corpus_pipeline as cp
from cases import SF
from test_decontamination import slow as slow_contamination
from test_line_dedup import slow as slow_lines
from test_packing import check
from test_simhash import slow_groups

from panelspark.llm import tokens
from panelspark.session import materialize


def test_every_stage_against_brute_force(spark, small):
    docs = small
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == small.columns
            out = materialize(out)
        after = out.collect()
        if name == "language":
            assert {r.doc_id for r in after} == {d for d, r in before.items() if r.text and any(c.isalpha() for c in r.text)}
        elif name == "line_dedup":
            want = slow_lines([(d, r.text) for d, r in before.items()])
            assert {r.doc_id: r.text for r in after} == {d: t for d, (t, _, _) in want.items()}
            assert all(r.n_chars == (before[r.doc_id].n_chars if r.text == before[r.doc_id].text else len(r.text)) for r in after)
        elif name == "near_dedup":
            assert sorted(r.doc_id for r in after) == sorted({c for _, _, c in slow_groups([(d, r.text) for d, r in before.items()])})
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            judged = slow_contamination([(d, r.text) for d, r in before.items()], items)
            assert sorted(r.doc_id for r in after) == sorted(d for d, *_, bad in judged if not bad) and len(after) < len(before)
        else:
            encode = tokens.encoder(tokens.BYTE_BPE).document
            check(after, [(d, encode(r.text.encode())) for d, r in before.items()])
        docs = out


def test_run_and_odd_tables(spark):
    assert cp.run(spark, SF).count() > 0
    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (1, "a b", None, None, None, 3), (1, "a b", None, None, None, 3), (2, "123", "de", "", 3, 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp int"
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, stage in cp.STAGES:
            docs = materialize(stage(spark, docs, SF))
        assert docs.count() == (1 if some else 0)
