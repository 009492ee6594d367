import json

import pytest
from brute import resolve
from corpus import lines
from pyspark.sql import functions as F

from maskwell.functions.catalog import custom_pattern
from maskwell.functions.lists import apply
from maskwell.operators.documents import is_json_sql, scrub_files, scrub_json_column, tokenize_files
from maskwell.operators.nested import scrub_nested_columns
from maskwell.plans.policy import Policy


def walk(node, tokens, style, found):
    if isinstance(node, str):
        text, rows = resolve(node, style=style, tokens=tokens)
        found += rows
        return text
    if isinstance(node, dict):
        return {k: walk(v, tokens, style, found) for k, v in node.items()}
    if isinstance(node, list):
        return [walk(v, tokens, style, found) for v in node]
    return node


DOCS = [
    {"a@b.com": "a@b.com", "n": 1.50, "l": ["10.0.0.1", None, True, {"x": "say \"a@b.com\" \\ \n é"}], "e": {}},
    ["x", ["4111-1111-1111-1111", {"k": ["a@b.com", "c@d.org"]}]],
    "just a@b.com",
    17,
    None,
    {"api_key": "s3cr3tP4ssw0rd1234567890", "deep": {"a": {"b": {"c": "Bearer  tok\u0001en 😀 x@y.zz"}}}},
]


@pytest.mark.parametrize("style", ["partial", "token"])
def test_json_text(spark, style):
    docs = DOCS + [{"v": v, "w": [v, "a@b.com"]} for v in lines(120, seed=3)]
    texts = [json.dumps(d, ensure_ascii=bool(i % 2), indent=(None, 2, "\t")[i % 3]) for i, d in enumerate(docs)]
    texts.append('{"k": "' + r"line a@b.com\n\"q\" " * 20000 + '"}')
    docs.append(json.loads(texts[-1]))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for row in scrub_json_column(df, "t", Policy(mask_style=style)).collect():
        found = []
        expect = walk(docs[row.i], {}, style, found)
        assert json.loads(row.t) == expect
        assert [tuple(f) for f in row.t_found] == found
        if not found:
            assert row.t == texts[row.i]


def test_json_layout_and_fallback(spark):
    texts = ['{ "b" : 1.0e5,\n  "a" : "a@b.com" }\n', "{not json a@b.com", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.t for r in scrub_json_column(df, "t").collect()}
    assert got == {0: '{ "b" : 1.0e5,\n  "a" : "a***@b.com" }\n', 1: "{not json a***@b.com", 2: "", 3: None}


def valid(text):
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def test_what_is_json(spark):
    cases = [*'{"a":1,"a":2}|[NaN,-Infinity,Infinity]|-NaN|--Infinity|"x"|1 2|nu ll|[1,]|{"a":1,}|{k:1}|{1:2}|["x", ":"]|["a":1]|01|1.|-|1e5'.split("|")]
    cases += [*'[1.5e-3, -0]|1}|1},{"b":2|[]]|[[]|| {} |"\\q"|"\\u12"|"\\ud800"|"a""b"|true1|[1 ,2]|{"":""}|{"a"}|{"a":1}{"b":2}|"a":1|1,"v":1'.split("|")]
    cases += ['["\n"]', '["a\n b"]', "\x01:1", "{\x01:1}", "{'a':1}", "\ufeff{}", "[" * 900 + "]" * 900]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = {r.i: r.ok for r in df.select("i", apply(F.col("t"), "_t", is_json_sql("_t")).alias("ok")).collect()}
    assert {cases[i]: ok for i, ok in got.items()} == {c: valid(c) for c in cases}


def test_json_beyond_the_limits_of_a_parser(spark):
    one = """concat('{"a@b.co":"', repeat('x', 21000000), '\\\\n mail a@b.co"}')"""
    many = """concat('[', repeat(concat('"', repeat('y', 1200000), '",'), 20), '"c@d.co"]')"""
    df = spark.range(1).select(F.expr(one).alias("one"), F.expr(many).alias("many"))
    out = scrub_json_column(scrub_json_column(df, "one"), "many")
    row = out.select(F.left("one", F.lit(10)), F.right("one", F.lit(19)), F.right("many", F.lit(14))).first()
    assert tuple(row) == ('{"a@b.co":', '\\n mail a***@b.co"}', 'y","c***@d.co"]'[-14:])


def test_equal_keys_and_nan(spark):
    df = spark.createDataFrame([('{"a@b.co": "a@b.co", "a@b.co": "c@d.co", "n": NaN}',)], "t string")
    assert scrub_json_column(df, "t").first().t == '{"a@b.co": "a***@b.co", "a@b.co": "c***@d.co", "n": NaN}'


def test_nested_columns(spark):
    df = spark.sql(
        """
        select 1 i, named_struct('mail', 'a@b.com', 'n', 5, 'in', named_struct('ip', '10.0.0.1', 'none', cast(null as string)),
          'list', array(named_struct('p', '212-555-1234'), null, named_struct('p', 'c@d.org')),
          'map', map('a@b.com', 'e@f.net', 'k', null)) v
        union all select 2, null
        """
    )
    rows = {r.i: r for r in scrub_nested_columns(df, ["v", "absent"]).collect()}
    v = rows[1].v
    assert v.mail == "a***@b.com" and v.n == 5 and v["in"].ip == "10.0.*.*" and v["in"].none is None
    assert [x and x.p for x in v.list] == ["***-***-1234", None, "c***@d.org"]
    assert v.map == {"a@b.com": "e***@f.net", "k": None}
    assert [f.pattern for f in rows[1].v_found] == ["email", "ipv4", "phone", "email", "email"]
    assert rows[2].v is None and rows[2].v_found == []


def test_map_keys_and_types_survive(spark):
    df = spark.range(1).select(F.create_map(F.lit("k"), F.array(F.lit("a@b.com"), F.lit("x"))).alias("m"))
    out = scrub_nested_columns(df, ["m"])
    assert out.schema["m"].dataType.simpleString() == "map<string,array<string>>"
    assert out.first().m == {"k": ["a***@b.com", "x"]}


def test_one_numbering_per_value(spark):
    df = spark.sql(
        """
        select 1 i, named_struct('l', array('a@b.co', 'c@d.co', null), 's', 'e@f.net a@b.co', 'n', 1,
          'd', array(map('k', array('c@d.co'), 'o', array()), null, map('k', array('x', 'g@h.co'))),
          'v', parse_json('{"a@b.co": ["i@j.co", 1.5, "e@f.net"]}'), 'z', 'i@j.co') v
        union all select 2, null
        """
    )
    rows = {r.i: r for r in scrub_nested_columns(df, ["v"], Policy(mask_style="token")).collect()}
    v = rows[1].v
    assert v.l == ["[PII-001]", "[PII-002]", None] and v.s == "[PII-003] [PII-001]" and v.n == 1
    assert v.d == [{"k": ["[PII-002]"], "o": []}, None, {"k": ["x", "[PII-004]"]}]
    assert v.v.toPython() == {"a@b.co": ["[PII-005]", 1.5, "[PII-003]"]} and v.z == "[PII-005]"
    assert [f.original[0] for f in rows[1].v_found] == [*"aceacgiei"] and rows[2].v is None


def test_python_masks_in_nested_columns(spark):
    own = custom_pattern("employee_id", r"EMP-\d{6}", "pii", py_mask=lambda s: s[::-1].lower())
    df = spark.sql("select array(named_struct('a', 'id EMP-123456', 'b', 'a@b.co'), null) v")
    out = scrub_nested_columns(df, ["v"], Policy(extra_patterns=(own,))).first().v
    assert out[0].a == "id 654321-pme" and out[0].b == "a***@b.co" and out[1] is None


CSV = 'name,mail,"note, ""a@b.com"""\nbob,a@b.com,"say ""c@d.org"", ok\n10.0.0.1"\r\n,,\nx"y,"",4111 1111 1111 1111\n'


def csv_expect(text, style, tokens):
    import csv
    import io

    rows = list(csv.reader(io.StringIO(text, newline="")))
    found = []
    out = [rows[0]]
    for row in rows[1:]:
        done = [resolve(cell, style=style, tokens=tokens) for cell in row]
        out.append([d[0] for d in done])
        found += [f for d in done for f in d[1]]
    return out, found


@pytest.mark.parametrize("style", ["partial", "token"])
def test_csv_text(spark, style):
    import csv
    import io

    df = spark.createDataFrame([("a.csv", "csv", CSV), ("b.csv", "csv", None)], "source string, format string, text string")
    rows = {r.source: r for r in scrub_files(df, Policy(mask_style=style)).collect()}
    expect, found = csv_expect(CSV, style, {})
    assert list(csv.reader(io.StringIO(rows["a.csv"].text, newline=""))) == expect
    assert [tuple(f) for f in rows["a.csv"].findings] == found
    assert rows["b.csv"].text is None


def test_files_share_one_token_map(spark):
    files = [
        ("c.txt", "text", "z@z.com then a@b.com"),
        ("a.json", "json", '{"k": "a@b.com", "l": ["q\\n@x", "c@d.org"]}'),
        ("b.csv", "csv", CSV),
        ("d.json", "json", "{broken 10.0.0.1"),
    ]
    df = spark.createDataFrame(files, "source string, format string, text string").repartition(3)
    got = {r.source: r.text for r in tokenize_files(df).rows.collect()}
    tokens = {}
    assert json.loads(got["a.json"]) == walk(json.loads(files[1][2]), tokens, "token", [])
    import csv
    import io

    assert list(csv.reader(io.StringIO(got["b.csv"], newline=""))) == csv_expect(CSV, "token", tokens)[0]
    assert got["c.txt"] == resolve(files[0][2], style="token", tokens=tokens)[0]
    assert got["d.json"] == resolve(files[3][2], style="token", tokens=tokens)[0]


def test_files_are_measured_only_while_a_broadcast_is_possible(spark, monkeypatch):
    from maskwell.operators import documents as D
    from maskwell.plans import scratch

    files = [
        ("a.json", "json", '{"m":\r\n ["a@b.com", "c\\n@d.org", "plain"], "a@b.com": "10.0.0.1"}'),
        *((f"b{i}.csv", "csv", end.join(("h@h.com,x", "a@b.com,1", '"c@d.org' + end + 'e@f.io",2', ""))) for i, end in enumerate(("\n", "\r", "\r\n"))),
        ("c.txt", "text", "a@b.com and 10.0.0.1"),
        ("d.txt", "text", None),
    ]
    df = spark.createDataFrame(files, "source string, format string, text string")
    calls, real = [], D.measured
    monkeypatch.setattr(D, "measured", lambda *a: calls.append(a) or real(*a))
    small = tokenize_files(df)
    want = {r.source: r.text for r in small.rows.collect()}
    assert len(calls) == 2
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 0)
    large = tokenize_files(df)
    # replacements that are too many are not weighed again by reading all files with a finding
    assert len(calls) == 3
    assert {r.source: r.text for r in large.rows.collect()} == want
    assert sorted(large.tokens.collect()) == sorted(small.tokens.collect())
    tokens = dict(small.tokens.select("original", "token").collect())
    first, ip, second, third = (tokens[v] for v in ("a@b.com", "10.0.0.1", "c@d.org", "e@f.io"))
    assert len(tokens) == 4
    assert want["a.json"] == f'{{"m":\r\n ["{first}", "c\\n@d.org", "plain"], "a@b.com": "{ip}"}}'
    for i, end in enumerate(("\n", "\r", "\r\n")):
        assert want[f"b{i}.csv"] == end.join(("h@h.com,x", f"{first},1", f'"{second}{end}{third}",2', ""))
    assert want["c.txt"] == f"{first} and {ip}" and want["d.txt"] is None
