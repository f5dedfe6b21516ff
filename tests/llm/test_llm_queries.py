from collections import Counter

import pytest

from compare import check, database
from seqloom.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    if name in SQL:
        check(con, df, SQL[name])
    else:
        rows, again = (Counter(map(repr, x.collect())) for x in (df, QUERIES[name](spark, data)))
        assert rows and rows == again and len(df.columns) == len(set(df.columns))


def test_pieces_are_those_of_the_rule(spark, data):
    """The whole table, cut by the recursive rule in plain Python."""
    import re

    from seqloom.llm.queries import LIMIT, OVERLAP, _sequences
    from test_operators import brute_cuts

    texts = {r.seq_id: r.seq for r in _sequences(spark, data).collect() if r.seq and len(r.seq) > LIMIT}
    want = set()
    for i, s in texts.items():
        bounds = [(m.end(), m.end() - m.start()) for m in re.finditer("N{10,}", s) if m.start() and m.end() < len(s)]
        cuts = [0, *brute_cuts(len(s), bounds, LIMIT, OVERLAP), len(s)]
        want |= {(i, k, max(0, a - OVERLAP) if k else 0, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    got = QUERIES["p3_pieces"](spark, data).collect()
    assert {(x.seq_id, x.piece_no, x.piece_start - 1, x.piece_end) for x in got} == want
    assert all(x.piece == texts[x.seq_id][x.piece_start - 1 : x.piece_end] for x in got)


def test_ids_are_those_of_the_plain_tokenizer(spark, data):
    from seqloom.llm import tokens

    plain = tokens.encoder(*tokens._settings(None, None)).plain
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: list(r.ids) for r in QUERIES["p7_ids"](spark, data).collect()} == {i: plain.encode_ordinary(t or "") for i, t in text.items()}
