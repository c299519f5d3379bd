"""Members of payloads by kind and type."""

from pyspark.sql import functions as F

from cairnlake.functions import variants


def test_members(spark):
    texts = [
        '{"n": 7, "s": "x", "b": true, "a": [1, 2], "o": {"k": 1.5}}', '{"n": "7", "s": 7, "b": "true", "a": {"x": 1}, "o": [1]}', '{"n": null, "s": null, "b": null, "a": null, "o": null}', "{}", "[1]", "7", "not json", None,
        '{"n": 99999999999999999999, "s": "", "b": false, "a": [], "o": {}}', '{"n": 1e300, "o": {"k": "1.5"}}',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("v", variants.parsed(F.col("t")))
    fields = {"n": ("$.n", "long"), "s": ("$.s", "string"), "b": ("$.b", "boolean"), "a": ("$.a", "array<long>"), "k": ("$.o.k", "double")}
    columns, wrong = variants.members(F.col("v"), fields)
    rows = df.select("i", *(c.alias(n) for n, c in columns.items()), wrong.alias("wrong"), *(variants.kind(F.col("v"), f"$.{c}").alias(f"kind_{c}") for c in "nsbao")).orderBy("i").collect()
    got = [tuple(r)[1:7] for r in rows]
    none = (None,) * 5
    assert got[0] == (7, "x", True, [1, 2], 1.5, []) and got[1] == (*none, ["a", "b", "n", "s"]) and got[2] == got[3] == (*none, [])
    assert got[4] == got[5] == (*none, []) and got[8] == (None, "", False, [], None, ["n"]) and got[9] == (*none, ["k", "n"])
    assert [r[7:] for r in map(tuple, rows)][:4] == [("number", "string", "boolean", "array", "object"), ("string", "number", "string", "object", "array"), ("null",) * 5, ("missing",) * 5]
    assert tuple(rows[6])[1:6] == none and rows[6].kind_n is None and rows[7].kind_n is None
