"""Every core query beside its SQL in DuckDB over the smallest data, and the column functions on hand-made cases."""

import pandas as pd
import pytest

import verify
from pyspark.sql import functions as F
from quillstream import plans
from quillstream.functions import sums
from quillstream.functions import text as T

DATA = "/root/testdata/sf0.001"
FOUND, SQL = plans.registered()


@pytest.fixture(scope="module")
def duck():
    return verify.connect(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_beside_its_sql(spark, duck, name):
    df = FOUND[name](spark, DATA)
    rows = pd.DataFrame([r.asDict(recursive=True) for r in df.collect()], columns=df.columns)
    result = duck.execute(SQL[name])
    want = pd.DataFrame(result.fetchall(), columns=[d[0] for d in result.description])
    assert sorted(rows.columns) == sorted(want.columns)
    assert verify.canonical(rows) == verify.canonical(want)


def one(spark, function, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(function(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize(
    "function, given, wanted",
    [
        (T.one_line, "<p>a <b>b</b></p><p>c&amp;lt;</p><script>x</script>", "a b c&lt;"),
        (T.one_line, "<li>one</li><li>two</li>&#x27;", "one two '"),
        (T.discussion_text, 'one<p>two <i>x</i> <a href="https:&#x2F;&#x2F;a.b&#x2F;c" rel="nofollow">https:&#x2F;&#x2F;a.b...</a>', "one\n\ntwo x https://a.b/c"),
        (T.discussion_text, '<a href="https://a.b">label</a>', "label (https://a.b)"),
        (T.redact_urls, "see https://u:p@a.b/c?d=e#f now", "see https://a.b/c now"),
        (T.redact, "Bearer abc api_key=xyz sk-12_a token: t", "Bearer [REDACTED] api_key=[REDACTED] [REDACTED] token:[REDACTED]"),
        (T.media_type, " Text/HTML; charset=x", "text/html"),
        (T.fnv1a, "", "811c9dc5"),
        (T.fnv1a, "a", "e40c292c"),
        (T.fnv1a, "foobar", "bf9cf968"),
        (T.fallback_id, "", "entry-" ),
        (T.one_line, None, None),
    ],
)
def test_functions(spark, function, given, wanted):
    got = one(spark, function, given)
    assert got.startswith(wanted) if wanted == "entry-" else got == wanted


@pytest.mark.parametrize("given, wanted", [("2025-02-06T23:50:00.000Z", "2025-02-06 23:50:00"), ("2025-03", "2025-03-01 00:00:00"), ("2024", "2024-01-01 00:00:00"), ("13 Feb 2025", "2025-02-13 00:00:00"), ("yesterday", None), ("2025-02-30", None), (None, None)])
def test_dates(spark, given, wanted):
    got = one(spark, T.iso_time, given)
    assert (got and str(got)) == wanted


def test_running_sum_over_blocks(spark):
    rows = [("a", i * 37, 1 + i % 5) for i in range(2_000)] + [(None, 5, 2), (None, 9_000, 3)]
    frame = spark.createDataFrame(rows, "g string, o bigint, v bigint")
    got = {(r.g, r.o): r.total for r in sums.running_sum(frame, "g", "o", F.col("v"), "total").collect()}
    total, want = 0, {}
    for g, o, v in rows[:2_000]:
        want[g, o] = total = total + v
    assert got == {**want, (None, 5): 2, (None, 9_000): 5}
