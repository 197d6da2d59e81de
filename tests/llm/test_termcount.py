from collections import Counter

from gneiss.llm import termcount


def _brute(records, n):
    occurrences, holding = Counter(), Counter()
    for terms in records:
        terms = [t for t in terms or [] if t is not None]
        grams = [tuple(terms[i : i + k]) for i in range(len(terms)) for k in range(1, n + 1) if i + k <= len(terms)]
        occurrences.update(grams)
        holding.update(set(grams))
    return {g: (c, holding[g]) for g, c in occurrences.items()}


def test_against_brute_force(spark):
    records = [["a", "b", "a", "b", "c"], ["b", "a"], ["a"] * 7, [], None, ["c", None, "a"], ["a", "b", "a", "b", "c"], ["x"] + ["a", "b"] * 400]
    records += [["hot", str(i % 3)] for i in range(50)]
    df = spark.createDataFrame([(i, r, "k") for i, r in enumerate(records)], "id int, terms array<string>, gram string")
    for n in (1, 2, 3):
        got = {tuple(r["gram"]): (r["occurrences"], r["records"]) for r in termcount.sequence_counts(df.repartition(3), "terms", n).collect()}
        assert got == _brute(records, n)


def test_marks(spark):
    rows = [(i, "tcp" if i < 60 else "udp", "=odd" if i < 3 else None) for i in range(100)]
    rows += [(0, "tcp", "=odd"), (1, "other", None), (None, "tcp", None)]
    df = spark.createDataFrame(rows, "row_id bigint, protocol string, flags string")
    got = {(r["cat_col"], r["cat_value"]): (r["records"], r["mark"]) for r in termcount.value_marks(df, "row_id", ["protocol", "flags"]).collect()}
    assert got == {("protocol", "tcp"): (60, "common"), ("protocol", "udp"): (40, None), ("protocol", "other"): (1, "rare"), ("flags", "=odd"): (3, "rare")}
    assert termcount.value_marks(df.limit(0), "row_id", ["protocol", "flags"]).count() == 0
