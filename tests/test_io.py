"""Sources, sinks, policies as data, audit and streams."""

import json
import os
import zlib

import pytest
from brute import resolve
from pyspark.sql import functions as F

from maskwell.operators import audit as A
from maskwell.operators import reports as R
from maskwell.operators.documents import scrub_files
from maskwell.operators.scrub import findings, scrub_columns
from maskwell.plans import policy as PO
from maskwell.plans.policy import Policy
from maskwell.sources import readers as RD
from maskwell.sources import writers as WR
from maskwell.streaming import streams as ST


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def test_tree(spark, tmp_path):
    root = str(tmp_path / "in put")
    put(f"{root}/a/x.LOG", b"bob\xff a@b.com\r\nnext 10.0.0.1\r")
    put(f"{root}/y.json", '{"m": "a@b.com"}')
    put(f"{root}/b/z.csv", "m,n\na@b.com,1\n")
    put(f"{root}/b/x.env", "api_key=" + "a1" * 12)
    put(f"{root}/no.bin", "a@b.com")
    put(f"{root}/in put/deep.txt", "plain")
    got = {r.rel_path: r for r in scrub_files(RD.read_tree(spark, root)).collect()}
    assert sorted(got) == ["a/x.LOG", "b/x.env", "b/z.csv", "in put/deep.txt", "y.json"]
    assert got["a/x.LOG"].text == "bob� a***@b.com\nnext 10.0.*.*\n"
    assert got["y.json"].text == '{"m": "a***@b.com"}' and got["y.json"].format == "json"
    assert got["b/z.csv"].text == "m,n\na***@b.com,1\n"
    out = str(tmp_path / "out")
    WR.write_tree(scrub_files(RD.read_tree(spark, root)), out)
    assert spark.read.parquet(out).where("format = 'json'").first().rel_path == "y.json"
    one = RD.read_text_file(spark, f"{root}/y.json", "text").first()
    assert one.format == "text" and one.text == '{"m": "a@b.com"}'
    assert RD.read_lines(spark, f"{root}/a/x.LOG").count() == 2


def test_unreadable_files(spark, tmp_path):
    root = str(tmp_path / "tree")
    for name in ("a.txt", "b/c.log", "b/d.txt", "e.txt"):
        put(f"{root}/{name}", "mail a@b.com")
    put(f"{root}/b/.c.log.crc", b"crc\0" + (512).to_bytes(4, "big") + b"\1\2\3\4")  # a checksum that does not fit
    put(f"{root}/long.txt", "x" * 5000)
    with pytest.raises(Exception, match="(?i)checksum|read"):
        RD.read_tree(spark, root).collect()
    listing = RD.list_tree(spark, root)
    assert {r.rel_path: r.length for r in listing.collect()} == {"a.txt": 12, "b/c.log": 12, "b/d.txt": 12, "e.txt": 12, "long.txt": 5000}
    files = RD.read_tree(spark, root, unreadable="skip")
    os.remove(f"{root}/e.txt")
    limit = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 4000)
    try:
        rows = {r.rel_path: (r.text, r.error, r.format) for r in RD.read_tree(spark, root, unreadable="keep").collect()}
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", limit)
    fine, lost = ("mail a@b.com", None, "text"), (None, "unreadable", "text")
    assert rows == {"a.txt": fine, "b/c.log": lost, "b/d.txt": fine, "long.txt": lost}
    done = scrub_files(files)
    listed = spark.createDataFrame([(f"file:{root}/{n}",) for n in ("a.txt", "b/c.log", "b/d.txt", "e.txt", "long.txt")], "source string")
    assert tuple(A.batch_totals(done, F.size("findings"), listing=listed).first()) == (3, 2, 2)
    per_row = RD.read_tree(spark, root, unreadable="keep")
    totals = A.batch_totals(scrub_files(per_row), F.when(F.col("error").isNull(), F.size("findings")))
    assert tuple(totals.first()) == (3, 2, 1)
    with pytest.raises(ValueError, match="unreadable"):
        RD.read_tree(spark, root, unreadable="maybe")


def test_lookup_maps_and_profiles(spark, tmp_path):
    put(f"{tmp_path}/allow.csv", 'value,by\n" 10.0.0.1 ",x\n,second\n10.0.0.1,y\n')
    assert [r.value for r in RD.read_allowlist(spark, f"{tmp_path}/allow.csv").collect()] == ["10.0.0.1"]
    put(f"{tmp_path}/first.csv", "who,by\nbob,x\n")
    assert RD.read_allowlist(spark, f"{tmp_path}/first.csv").first().value == "bob"
    assert RD.read_allowlist(spark, f"{tmp_path}/none.csv").count() == 0
    put(f"{tmp_path}/map.json", json.dumps({"a@b.com": "[PII-001]", "é": "odd"}))
    assert dict(RD.read_tokens(spark, f"{tmp_path}/map.json").collect()) == {"a@b.com": "[PII-001]", "é": "odd"}
    assert RD.read_tokens(spark, f"{tmp_path}/missing").count() == 0
    put(f"{tmp_path}/p/one.json", json.dumps({"name": "Mine", "disabled_patterns": ["ssn"]}, indent=1))
    row = RD.profile_rows(RD.read_profiles(spark, f"{tmp_path}/p"))[0]
    assert row == PO.normal_profile({"name": "Mine", "disabled_patterns": ["ssn"]})
    merged = PO.merged_by_name(PO.profiles_frame(spark), PO.profiles_frame(spark, [{"name": "GDPR", "mask_style": "full"}]))
    assert {r.name: r.mask_style for r in merged.collect()} == {
        "GDPR": "full", "HIPAA": "token", "SOC2": "partial", "Minimal": "partial",
    }


def test_standards(spark):
    defs = RD.standards_from({"PCI": {"patterns": " email , ipv4 "}, "every": {"patterns": "*"}, "no": {"patterns": ""}})
    assert PO.allowed_by("pci", defs) == {"email", "ipv4"}
    assert PO.allowed_by("every", defs) is None and PO.allowed_by("no", defs) == frozenset()
    assert PO.allowed_by("??") == PO.STANDARDS["gdpr"]
    table = spark.createDataFrame([("A", "x, y"), ("B", "")], "standard string, patterns string")
    assert sorted(tuple(r) for r in RD.standards_table(table).collect()) == [("a", "x"), ("a", "y")]
    ref = [tuple(r) for r in R.pattern_reference(spark, "pci").collect()]
    assert ref == [
        ("generic_credential", "credentials"), ("credit_card", "financial"), ("iban", "financial"),
        ("url_credentials", "network"),
    ]
    assert R.pattern_reference(spark, "other").count() == 0


def test_precedence():
    p = PO.resolve_explicit("HIPAA", mask_char="#", allowlist=["x"])
    assert (p.mask_style, p.mask_char, p.allowlist) == ("token", "#", {"x"})
    assert p.disabled_patterns == {"ipv4", "url_credentials"}
    config = {"mask_style": "label", "min_confidence": 0.7}
    args = dict(standard="pci", mask_style="full", min_confidence_pct=90, config=config)
    p = PO.resolve_event_policy(**args)
    assert (p.mask_style, p.min_confidence) == ("label", 0.7)
    p = PO.resolve_event_policy(**args, config_wins=False)
    assert (p.mask_style, p.min_confidence) == ("full", 0.9)
    p = PO.resolve_event_policy({"default_report_findings": "0", "default_allowlist": "a, b,"}, lookup_allowlist=["c"])
    assert not p.report_findings and p.allowlist == {"a", "b", "c"}
    p = Policy().overlay({"custom_patterns": [{"name": "x"}, {"name": "y", "regex": "y+"}]})
    assert [e.name for e in p.extra_patterns] == ["y"] and len(p.warnings) == 1
    with pytest.raises(ValueError):
        Policy(mask_style="other")
    with pytest.raises(KeyError):
        Policy.from_profile("nobody")


def test_typed_json_with_mixed_arrays(spark):
    docs = spark.createDataFrame([('{"a": [1, "a@b.com"], "b": null}',), ("bad",), ('{"c": {"d": "10.0.0.1"}}',)], "j string")
    from maskwell.operators.nested import scrub_nested_columns

    ddl = RD.json_schema_of(docs, "j")
    typed = docs.where(F.expr("try_parse_json(j) is not null")).select(F.from_json("j", ddl).alias("v"))
    out = scrub_nested_columns(typed, ["v"]).select(F.to_json("v").alias("j"), F.size("v_found").alias("n"))
    assert sorted(tuple(r) for r in out.collect()) == [
        ('{"a":[1,"a***@b.com"]}', 1), ('{"c":{"d":"10.0.*.*"}}', 1),
    ]


def test_audit(spark):
    df = spark.createDataFrame([("s'1", "mail a@b.com"), ("s2", "10.0.0.1 c@d.org")], "source string, t string")
    found = findings(df, "source", "t")
    flat = A.audit_rows(found, "source", "T", include_original=True)
    assert tuple(flat.columns) == A.AUDIT_COLUMNS
    assert "original" not in A.audit_rows(found).columns
    assert A.audit_rows(found).first().timestamp.endswith("+00:00")
    assert {r.category: r.findings for r in A.audit_summary(found).collect()} == {"pii": 2, "network": 1, None: 3}
    lines = [r.line for r in A.report_lines(found, "T", include_original=True).orderBy("section", "rank").collect()]
    assert lines[4:7] == ["  Total findings : 3", f"    {'network':<20} 1", f"    {'pii':<20} 2"]
    assert "  [email] (pii, conf=100%)  →  'a***@b.com'  original: 'a@b.com'  @ s'1+5" in lines
    assert "  [ipv4] (network, conf=70%)  →  '10.0.*.*'  original: '10.0.0.1'  @ s2+0" in lines
    quotes = spark.createDataFrame([("it's",), ('say "x"',), ("both ' and \"",), ("tab\t\\",)], "v string")
    assert [r[0] for r in quotes.select(A.quoted(F.col("v"))).collect()] == [repr(r.v) for r in quotes.collect()]


def test_summary_event_skips_empty_values(spark):
    df = spark.createDataFrame([(1, "", None, "x")], "a int, b string, c string, d string")
    assert WR.summary_events(df).first().event == 'a="1" d="x"'


def test_missing_fields_and_null_values(spark):
    df = spark.createDataFrame([("a@b.com", 5), (None, 6), ("", 7)], "t string, n int")
    out = scrub_columns(df, "absent,t,n", Policy())
    rows = [tuple(r) for r in out.orderBy("n").collect()]
    assert rows == [
        ("a***@b.com", "5", "email", 1, None, None), (None, "6", None, None, None, None),
        ("", "7", None, None, None, None),
    ]


def test_token_stream_over_batches_and_replay(spark, tmp_path):
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    values = ["a@b.com x", "c@d.org a@b.com", "10.0.0.1 c@d.org", "e@f.net a@b.com"]
    for i, v in enumerate(values):
        spark.createDataFrame([(i, v)], "id int, t string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id int, t string").parquet(src)
        ST.run(ST.token_stream(stream, "id", "t", Policy(mask_style="token"), out, f"{tmp_path}/state"))
    tokens = {}
    expect = [resolve(v, style="token", tokens=tokens)[0] for v in values]
    rows = spark.read.parquet(f"{out}/rows").orderBy("id").collect()
    assert [r.t for r in rows] == expect
    assert dict(ST.stored_tokens(spark, f"{out}/tokens").collect()) == tokens
    before = dict(ST.stored_tokens(spark, f"{out}/tokens", before=2).collect())
    assert before == {"a@b.com": "[PII-001]", "c@d.org": "[PII-002]"}


def test_schema_of_odd_keys(spark):
    from maskwell.sources.readers import json_schema_of

    df = spark.createDataFrame([('{"VOIDED_BY": "x", "VOID": null, "OBJECT<": {"OBJECT": null}, "a`:VOID": 1}',)], "t string")
    schema = json_schema_of(df, "t")
    got = df.select(F.from_json("t", schema).alias("v")).first().v.asDict(recursive=True)
    assert got == {"VOIDED_BY": "x", "VOID": None, "OBJECT<": {"OBJECT": None}, "a`:VOID": 1}


def test_very_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    rows = spark.range(1400).select(F.col("id").alias("key"), F.concat(F.lit("mail a@b.io "), "id").alias("text"))
    root = str(tmp_path / "many")
    WR.write_folders(rows, "key", "text", root)
    most = 4 * spark.sparkContext.defaultParallelism
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    tree, below = RD.read_tree(spark, root), RD.read_text_file(spark, root, "text", recursive=True)
    assert spark.conf.get(setting) == before
    for files in (tree, below, RD.list_tree(spark, root)):
        assert files.count() == 1400
        assert files.rdd.getNumPartitions() <= most
    assert {r.rel_path: r.text for r in tree.collect()} == {f"key={i}/part.txt": f"mail a@b.io {i}\n" for i in range(1400)}


def test_the_driver_does_not_hold_the_listing_of_a_tree(spark, tmp_path):
    rows = spark.range(1400).select(F.col("id").alias("key"), F.lit("mail a@b.io").alias("text"))
    root = str(tmp_path / "many")
    WR.write_folders(rows, "key", "text", root)
    for files in (RD.list_tree(spark, root), RD.read_tree(spark, root), RD.read_tree(spark, root, unreadable="skip"), RD.read_text_file(spark, root, "text", recursive=True)):
        # files that plans name: stored listings, not the tree
        assert len(files.inputFiles()) < 50 and files.count() == 1400
    totals = A.source_totals(RD.read_tree(spark, root).select("source"))
    assert len(totals.inputFiles()) < 50 and totals.where("findings = 1").count() == 1400


def test_a_tree_is_read_as_by_spark(spark, tmp_path):
    root = str(tmp_path / "a b%20c")
    for name in ("x.txt", "a+b.txt", "é.md", "deep/er/and/y.log", "_k=1/z.txt", "_hidden/z.txt", ".hid/z.txt", "_metadata/z.txt", "_h.txt", "_h=1.txt", ".h.txt", "h.txt._COPYING_", "no.bin"):
        put(f"{root}/{name}", f"mail a@b.com {name}\r\n" * 60)
    put(f"{root}/empty.txt", "")
    put(f"{tmp_path}/other/o.txt", "elsewhere")
    os.symlink(f"{tmp_path}/other", f"{root}/linked")
    os.symlink(f"{root}/x.txt", f"{root}/same.txt")
    os.symlink(f"{root}/nowhere", f"{root}/broken.txt")
    spark.createDataFrame([("sums " * 500,)], "v string").coalesce(1).write.text(f"{root}/spark")
    theirs = {r.path: bytes(r.content) for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).collect()}
    theirs[f"file:{root}/é.md"] = "mail a@b.com é.md\r\n".encode() * 60  # Java reads such names only in a locale that has them
    assert len(theirs) == 11 and any("/spark/part-" in p for p in theirs)
    want = {p: b.decode().replace("\r\n", "\n") for p, b in theirs.items()}
    one = RD.read_text_file(spark, f"file://{root}/", recursive=True)
    assert one.count() == len(want) and {r.source: r.text for r in one.collect()} == want
    some = {p: t for p, t in want.items() if not p.endswith(".bin")}
    tree = RD.read_tree(spark, f"{root}/").collect()
    assert {r.source: r.text for r in tree} == some and len(tree) == len(some)
    assert {r.rel_path for r in tree} == {p.removeprefix(f"file:{root}/") for p in some}
    assert {r.source: r.length for r in RD.list_tree(spark, root).collect()} == {p: len(theirs[p]) for p in some}
    assert [r.rel_path for r in RD.read_tree(spark, f"{root}/deep").collect()] == ["er/and/y.log"]
    os.mkdir(f"{tmp_path}/none")
    assert RD.read_tree(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        RD.read_tree(spark, f"{tmp_path}/gone").collect()
    tree = RD.read_tree(spark, root)
    os.remove(f"{root}/a+b.txt")
    with pytest.raises(Exception, match=r"a\+b.txt"):
        tree.collect()


def test_checksums_next_to_files_are_heeded(spark, tmp_path):
    root, data = str(tmp_path / "tree"), b"0123456789" * 100
    sums = b"crc\0" + (512).to_bytes(4, "big") + b"".join(zlib.crc32(data[i : i + 512]).to_bytes(4, "big") for i in (0, 512))
    for name, stored in {"fits": sums, "other": b"no checksums", "less": sums[:-4], "wrong": sums[:-1] + b"?"}.items():
        put(f"{root}/{name}.txt", data)
        put(f"{root}/.{name}.txt.crc", stored)
    assert {r.rel_path for r in RD.read_tree(spark, root, unreadable="skip").collect()} == {"fits.txt", "other.txt"}
    theirs = spark.read.format("binaryFile").option("ignoreCorruptFiles", True).load(root).select("path", "content").collect()
    assert {r.path.rsplit("/", 1)[1] for r in theirs} == {"fits.txt", "other.txt"}
    with pytest.raises(Exception, match="(?i)checksum"):
        RD.read_text_file(spark, root, recursive=True).collect()
    with RD._setting(spark, "spark.sql.files.ignoreCorruptFiles", "true"):
        assert RD.read_text_file(spark, root, recursive=True).count() == 2


def test_folders_hold_the_rows_of_a_key(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ä"), (2, None), (1, "b"), (None, "c"), (3, "")], "key long, text string")
    root = str(tmp_path / "folders")
    WR.write_folders(rows, "key", "text", root)
    got = {r.rel_path: sorted(r.text.split("\n")) for r in RD.read_tree(spark, root).collect()}
    assert got == {
        "key=1/part.txt": ["", "b", "ä"],
        "key=2/part.txt": ["", ""],
        "key=3/part.txt": ["", ""],
        "key=__HIVE_DEFAULT_PARTITION__/part.txt": ["", "c"],
    }
    with pytest.raises(ValueError):
        WR.write_folders(rows, "text", "text", str(tmp_path / "other"))


def test_an_input_is_spread_by_its_rows(spark):
    rows = spark.range(0, 1000, 1, 10)
    assert RD.spread(rows).rdd.getNumPartitions() == 10
    spread = RD.spread(rows, 30)
    assert spread.rdd.getNumPartitions() == 34
    assert spread.agg(F.sum("id")).first()[0] == 499_500
