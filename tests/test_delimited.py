from hypothesis import given, settings
from hypothesis import strategies as st

from gneiss.sources import delimited

COLUMNS = ["key", "n1", "n2", "name"]


def _reference(text):
    """A character-by-character reader: the fields, or None for broken quoting."""
    text = text or ""
    text = text[:-1] if text.endswith("\r") else text
    out, field, i, state = [], "", 0, "start"
    while i < len(text):
        c = text[i]
        if state == "quoted":
            if c == '"' and text[i + 1 : i + 2] == '"':
                field, i = field + '"', i + 1
            elif c == '"':
                state = "closed"
            else:
                field += c
        elif c == ",":
            out.append(field)
            field, state = "", "start"
        elif state == "closed" or (c == '"' and state == "plain"):
            return None
        elif c == '"':
            state = "quoted"
        else:
            field, state = field + c, "plain"
        i += 1
    return None if state == "quoted" else [*out, field]


def _reason(text):
    import re

    fields = _reference(text)
    if fields is None:
        return "broken_quoting"
    if len(fields) != len(COLUMNS):
        return "column_count"
    ok = all(re.fullmatch(r"|[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:-?inf|nan)", f.strip(" ")) for f in fields[1:3])
    return None if ok else "invalid_value"


def _run(spark, texts):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "line_id bigint, raw_text string, name string, reason string")
    loaded, rejects = delimited.split_load(df.repartition(3), COLUMNS, ["n1", "n2"])
    return {r["line_id"]: r for r in loaded.collect()}, {r["line_id"]: r["reason"] for r in rejects.collect()}


FIXED = [None, "", "\r", "a,1,2,b", 'a,"1",2,"b,c"', 'a,1,2,"say ""x"""', 'a,1,2,"', 'a,1,2,b"', 'a,1,2,"b"c', 'a, "1",2,b', "a,5.,.5,b", "a,+inf,1,b", "a,-INF,NaN,b",
         "a,1e5, 2 ,b", "a,,,", "a,1,2", "a,1,2,b,c", "a,1_0,2,b", "a,١,2,b", '"","","",""', '"""",1,2,""""""', "a,1,2,\x01,\x010", 'a,1,2,"\x01,\x011"', "a,1,2," + '"' + '""' * 20000 + '"', "a,1,2," + "x," * 9000, "a,1,2,b\r\r",
         *(f"a,{v},2,b" for end in "\r\n\x85\u2028\u2029\x0b\x0c\t\xa0" for v in (end, "1" + end, end + "1", f'"1{end}"'))]


def test_fixed_cases(spark):
    loaded, rejects = _run(spark, FIXED)
    for i, t in enumerate(FIXED):
        assert rejects.get(i) == _reason(t), (t or "")[:40]
        assert (i in loaded) == (_reason(t) is None)
        if i in loaded:
            assert [loaded[i]["key"], loaded[i]["name"]] == [_reference(t)[0] or None, _reference(t)[3] or None]
    assert loaded[4]["n1"] == 1.0 and loaded[12]["n1"] == float("-inf") and loaded[14]["n1"] is None
    assert _run(spark, []) == ({}, {})


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet='a1",. \r\n\u2028', max_size=14), min_size=120, max_size=300))
def test_random_lines(spark, texts):
    loaded, rejects = _run(spark, texts)
    assert [rejects.get(i) for i in range(len(texts))] == [_reason(t) for t in texts]
    assert set(loaded) | set(rejects) == set(range(len(texts)))
