import zlib

import numpy as np
from cases import ODD_TEXTS
from hypothesis import given
from hypothesis import strategies as st

from panelspark.llm import token_files, tokens


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=70))
def test_round_trip_of_ranks(ranks):
    control, data = token_files.encode_ranks(np.array(ranks, dtype="<u4"))
    assert len(control) == -(-len(ranks) // 4)
    assert token_files.decode_ranks(control, data, len(ranks)).tolist() == ranks


def expected(rows):
    encode, out, start = tokens.encoder(tokens.WORD_BPE).document, [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = encode(None if text is None else text.encode())
        out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def by_start(df):
    return [tuple(r) for r in df.orderBy("start").collect()]


def test_round_trip(spark, docs, tmp_path):
    rows = [*enumerate(ODD_TEXTS), (3, "\n\n"), (None, "no id"), (-4, "negative")]
    df = docs([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, shard string, block int").repartition(3)
    token_files.write(df, str(tmp_path / "a"), block=100)
    assert by_start(token_files.digest(token_files.read(spark, str(tmp_path / "a")))) == expected(rows)
    ranks = spark.read.parquet(str(tmp_path / "a" / "ranks")).orderBy("rank").collect()
    assert [r.n for r in ranks] == sorted((r.n for r in ranks), reverse=True)


def test_whole_table_and_empty(spark, small, docs, tmp_path):
    token_files.write(small, str(tmp_path / "b"))
    assert by_start(token_files.digest(token_files.read(spark, str(tmp_path / "b")))) == expected([(r.doc_id, r.text) for r in small.collect()])
    token_files.write(docs([]), str(tmp_path / "c"))
    assert token_files.read(spark, str(tmp_path / "c")).collect() == []
