import random

from hypothesis import given
from hypothesis import settings
from hypothesis import strategies as st

from pathweave.sources import badrows as b

HEADERS = ["s,p,o", "e1,e2", "s,n", "class,n", "s,label,d", "e1,p,e2,score", "o"]


def record(r: random.Random) -> str:
    pick = ["http://k/a", '"http://k/a"', "12", '"12"', "2020-02-29", "2021-02-29", "1.5e-3", "x", '"a, b"', '"a ""q"" b"', 'a"b', '"a"b', '"a', "", '""', " ", "http://k/ a", "é", '"a\nb"', "a\nb", '"a,"b', "-7", "+.5", "http://"]
    text = ",".join(r.choice(pick) for _ in range(r.choice([1, 2, 3, 3, 4])))
    return text + r.choice(["", "", "\n", "\r\n", "\r", "\n\n"])


def test_blocks_agree_with_strict_diagnosis():
    r = random.Random(4)
    for header in HEADERS:
        texts = [record(r) if r.random() < 0.9 else r.choice([None, "", "  \r\n", "\r\n\n", "a\0b", "0000-01-01"]) for _ in range(800)]
        assert b.parse_block(header, texts) == [b.diagnose(header, t) for t in texts]
        good, _ = b.read_block(header.split(","), texts)
        assert good == [k for k, t in enumerate(texts) if b.diagnose(header, t)[0] is None and "\0" not in t]  # all others go through the columnar reader


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet='ab",\n\r 1é\0', max_size=8), max_size=12))
def test_any_text_gives_the_same_on_both_paths(texts):
    for header in ("o,label", "o"):
        assert b.parse_block(header, texts) == [b.diagnose(header, t) for t in texts]


def test_reasons():
    d = lambda t, h="s,n": b.diagnose(h, t)[0]
    assert d("http://k/a,1") is None and d('"http://k/a","1"\r\n') is None
    assert d(None) == d("") == d(" \n") == d("\r\n") == d("  ", "o") == "column_count"
    assert d("\n\n") == d("\r\n\n", "o") == d(" \r ") == "quoting"  # cannot be split, which comes first
    assert d("http://k/a") == d("http://k/a,1,2") == "column_count"
    assert d('"http://k/a,1') == d('http://k/a,1"') == d('"a"x,1') == d("a\nb,1") == "quoting"
    assert d("http://k/a,-1") == d("ftp://k/a,1") == d("http://,1") == d("http://k/a ,1") == "invalid_value"
    assert b.diagnose("d", "2023-02-29")[0] == "invalid_value" and b.diagnose("d", "2024-02-29")[0] is None
    assert b.diagnose("score", "1.")[0] == "invalid_value" and b.diagnose("score", "-1.0E+3")[0] is None
    assert b.diagnose("o", '"a ""b"" c"')[1] == ['a "b" c']


def test_frames(spark):
    rows = [(1, "s,n", "http://k/a,1", "x"), (2, "s,n", None, None), (3, None, "a", "y"), (4, "o", '"x', "z"), (1, "s,n", "http://k/a,1", "x")]
    df = spark.createDataFrame(rows, "line_id long, header string, texto string, extra string")
    out = b.load_records(df)
    assert out.columns == ["line_id", "header", "texto", "extra", "reason", "fields"]
    got = {(r.line_id, r.reason) for r in out.collect()}
    assert got == {(1, None), (2, "column_count"), (3, "column_count"), (4, "quoting")}
    assert out.where("line_id = 1").first().fields == {"s": "http://k/a", "n": "1"}
    assert b.load_records(df.where("false")).count() == 0


def test_clashing_columns_are_refused(spark):
    import pytest

    with pytest.raises(ValueError):
        b.load_records(spark.createDataFrame([("s", "a", "r")], "header string, texto string, reason string"))
