from pyspark.sql import functions as F

from loomdex.functions import scalars, text
from loomdex.operators import snippets


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


def test_tokens(spark):
    cases = {
        "A PostgreSQL 검색엔진 x 한 中國": ["postgresql", "검색", "색엔", "엔진", "한", "中國"],
        "a b cd": ["cd"],
        "ABC abc_123 é中日語 カタカナ 한글 𠀀": ["abc", "abc", "123", "中日", "日語", "カタ", "タカ", "カナ", "한글"],
        "K1 kelvin\u212a": ["k1", "kelvin"],
        "": [],
        "하하하 The the THE them 日 日日日日": ["하하", "하하", "the", "the", "the", "them", "日", "日日", "日日", "日日"],
    }
    for t, want in cases.items():
        assert one(spark, text.tokens(F.col("t")), t=t) == want
        assert [x for x, _, _ in snippets.spans(t)] == want
        assert one(spark, text.token_count(F.col("t")), t=t) == len(want)
        for term in {*want, "zz", "가나", "가"}:
            assert one(spark, text.term_count(F.col("t"), term), t=t) == want.count(term), (t, term)
    assert one(spark, text.tokens(F.lit(None).cast("string"))) is None
    assert one(spark, text.term_key(F.col("t")), t="x" * 2001).startswith(text.LONG_TERM_PREFIX)


def test_chunks(spark):
    got = one(spark, text.chunks(F.col("t"), 4, 1), t="A🙂BCDEFG")
    assert [(c.char_start, c.char_end) for c in got] == [(0, 4), (3, 7), (6, 8)]
    assert one(spark, text.chunks(F.col("t"), 4, 1), t="") == []
    assert [(c.char_start, c.char_end) for c in one(spark, text.chunks(F.col("t"), 9, 2), t="abc")] == [(0, 3)]


def test_metadata_helpers(spark):
    assert one(spark, text.media_type(F.col("t")), t=" Text/HTML ; charset=x") == "text/html"
    assert one(spark, text.url_host(F.col("t")), t="https://u:p@Ex.COM.:80/a") == "ex.com"
    assert one(spark, text.url_host(F.col("t")), t="no url") is None
    assert one(spark, text.languages(F.col("t")), t=" EN, fr-CA ,,") == "en,fr-ca"
    assert one(spark, text.has_language(F.col("t"), "FR-ca"), t="en,fr-ca")
    assert one(spark, text.normalised(F.col("t")), t="　a\x1c\x85 b\n") == "a b"


def test_scalars(spark):
    top = 2**31 - 1
    assert one(spark, scalars.add_numbers(F.col("a"), F.col("b")), a=top, b=1) == top
    assert one(spark, scalars.fibonacci(F.col("n")), n=10) == 55
    assert one(spark, scalars.fibonacci(F.col("n")), n=92) == 7540113804746346429
    assert one(spark, scalars.fibonacci(F.col("n")), n=93) == one(spark, scalars.fibonacci(F.col("n")), n=10**6) == 2**63 - 1
    assert one(spark, scalars.fibonacci(F.col("n")), n=-1) == 0
    assert one(spark, scalars.array_sum(F.array(F.lit(top), F.lit(1), F.lit(-1)))) == top - 1
    assert one(spark, scalars.shout(F.col("t")), t="straße") == "STRASSE!"
    assert one(spark, scalars.word_count(F.col("t")), t="a　b\x85c ") == 3
    assert one(spark, scalars.double_or_none(F.col("n")), n=-(2**31)) == -(2**31)
    assert one(spark, scalars.double_or_none(F.lit(None).cast("int"))) is None
    assert one(spark, scalars.is_even(F.col("n")), n=-3) is False
    assert "20" in one(spark, scalars.greeting(F.lit("x")))
    scalars.register(spark)
    assert spark.sql("select add_numbers(2147483647, 5) a, is_even(4) b, shout('x') c, double_or_none(null) d").first() == (top, True, "X!", None)


def test_snippets():
    s = snippets.snippet("x" * 300 + " <검색엔진> tail", frozenset(["검색", "색엔"]), 60)
    assert len(s["excerpt"]) == 60 and "&lt;<mark>검색엔</mark>진&gt;" in s["html"]
    assert snippets.snippet("short & text", frozenset(), 240)["html"] == "short &amp; text"
