"""Files in, tables out."""

import json

import pytest
from pyspark.sql import functions as F

from mailsift.operators import features, lines
from mailsift.sources import csv, eml, load, sinks, textmail
from mailsift.sources.tables import require_columns


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "Enron.csv").write_text("subject,body,label\nhi,first body,0\nhi,too,many,fields\nwin,prize,1\nshort\n", "latin-1")
    (tmp_path / "Nazario.csv").write_text("sender,receiver,date,subject,body,urls,label\na@x.org,me,2024,s,caf\xe9,u,1\n", "latin-1")
    (tmp_path / "phishing_email.csv").write_text("text,class\nsome text,1\n,1\n", "latin-1")
    (tmp_path / "other.csv").write_text("Mail Subject,content,is_spam\nA,  b   c ,ham\nA,b c,ham\n,,ham\nB,x,what\n", "latin-1")
    (tmp_path / "sub" / "phish1.eml").write_bytes(
        b"From: Bad <bad@x.ru>\r\nReply-To: r@y.com\r\nSubject: =?utf-8?q?Caf=C3=A9?=\r\nContent-Type: text/html\r\n\r\n<b>Pay</b> now\r\n"
    )
    (tmp_path / "notes.doc").write_text("ignored")
    return str(tmp_path)


def test_load_messages(spark, folder):
    rows = {(r["subject"], r["body"]): r for r in load.load_messages(spark, [folder, folder + "/missing"]).collect()}
    assert set(rows) == {("hi", "first body"), ("win", "prize"), ("s", "café"), ("", "some text"), ("A", "b c"), ("Café", "Pay now")}
    assert rows[("hi", "first body")]["label"] == "legitimate"
    assert rows[("s", "café")]["from"] == "a@x.org"
    assert rows[("Café", "Pay now")]["label"] == "phishing"


def test_wide_columns_survive_loading(spark, tmp_path):
    (tmp_path / "phishing_email.csv").write_text("text,class,url_score,note,note\nbody one,1,0.7,n1,n2\nbody two,0\nbody one,1,0.9,x,y\n,1,0.1,a,b\n")
    (tmp_path / "plain.csv").write_text("subject,body,label,date,colour\ns,b,spam,2024,red\n")
    rows = {r["body"]: r for r in load.load_messages(spark, [str(tmp_path)]).collect()}
    assert set(rows) == {"body one", "body two", "b"}
    assert rows["body one"]["extras"] == {"text": "body one", "class": "1", "url_score": "0.7", "note": "n1", "note_4": "n2"}
    assert rows["body two"]["extras"] == {"text": "body two", "class": "0"} and rows["body two"]["label"] == "legitimate"
    assert rows["b"]["date"] == "2024" and rows["b"]["extras"] == {"colour": "red"}


def test_manifest_isolates_damaged_files(spark, tmp_path):
    (tmp_path / "good.csv").write_text("subject,body,label\nhi,there,spam\n\nlast,row,ham")
    (tmp_path / "empty.csv").write_bytes(b"")  # Spark's readers don't list files of no bytes
    (tmp_path / "binary.csv").write_bytes(b"PK\x03\x04\x00\x00\xff\xfe subject,body\n\x00\x01\n" * 40)
    (tmp_path / "phish dump.csv").write_text("Subject: one\nFrom: a@b.c\nfirst line, with a comma\nmore\n\nSubject: two\nbody\n")
    (tmp_path / "odd.csv").write_text("a,b\n1,2\n")
    (tmp_path / "Enron.csv").write_text("x,y,z\npos,body,1\n")
    got = {r["file"].replace("%20", " "): (r["layout"], r["state"]) for r in load.manifest(spark, [str(tmp_path)]).collect()}
    assert got == {
        "good.csv": ("csv", "ok"), "binary.csv": (got["binary.csv"][0], "damaged"),
        "phish dump.csv": ("dump", "ok"), "odd.csv": ("unknown", "ok"), "Enron.csv": ("positional", "ok"),
    }
    rows = {(r["subject"], r["body"]): r for r in load.load_messages(spark, [str(tmp_path)]).collect()}
    assert set(rows) == {("hi", "there"), ("last", "row"), ("one", "first line, with a comma more"), ("two", "body"), ("pos", "body")}
    assert rows[("one", "first line, with a comma more")]["from"] == "a@b.c" and rows[("two", "body")]["label"] == "phishing"
    assert rows[("pos", "body")]["label"] == "phishing"


def test_first_of_equal_rows_stays_by_place(spark, tmp_path):
    lines_ = [f"s,b,{'spam' if k else 'ham'}" for k in range(50)]
    (tmp_path / "a.csv").write_text("subject,body,label\n" + "\n".join(lines_) + "\n")
    got = load.load_messages(spark, [str(tmp_path)]).collect()
    assert [(r["subject"], r["label"]) for r in got] == [("s", "legitimate")]


def test_dedup_moves_no_text_through_sorts(spark):
    from mailsift.operators import clean

    rows = [(k, f"s{k % 7}", "x" * (k % 3), None if k % 5 else "f") for k in range(60)] + [(100, None, None, None), (99, None, "", None), (98, "", None, None)]
    df = spark.createDataFrame(rows, "msg_id long, subject string, body string, `from` string").repartition(5)
    got = {r.msg_id for r in clean.dedup(df, ["subject", "body"]).collect()}
    first = {}
    for r in sorted(rows):
        first.setdefault(r[1:3], r[0])
    assert got == set(first.values())
    plan = clean.dedup(df, ["subject", "body"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort [" not in plan


def test_many_files_and_numeric_wide_labels(spark, tmp_path):
    for k in range(120):
        (tmp_path / f"m {k}.csv").write_text(f"{'subject,body' if k % 2 else 'body,subject'},label\nleft {k},right {k},spam\n")
    (tmp_path / "phishing_email.csv").write_text("text,class\nwide one,1.00\nwide two,0.00\n")
    rows = load.load_messages(spark, [str(tmp_path)]).collect()
    assert len(rows) == 122
    assert {(r["body"], r["label"]) for r in rows if r["body"].startswith("wide")} == {("wide one", "phishing"), ("wide two", "legitimate")}
    assert all(r["subject"].startswith("left" if int(r["subject"].split()[1]) % 2 else "right") for r in rows if r["subject"])


def test_load_nothing(spark, tmp_path):
    assert load.load_messages(spark, [str(tmp_path)]).columns[:5] == ["from", "reply_to", "subject", "body", "label"]


def test_quoted_multiline(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('subject,body,label\n"a, b","two\nlines",spam\n')
    row = load.load_messages(spark, [str(tmp_path)], quoting=True).head()
    assert (row["subject"], row["body"]) == ("a, b", "two lines")


def test_eml_policies(spark, tmp_path):
    (tmp_path / "m.eml").write_bytes(
        b'From: a@b.c\r\nSubject: s\r\nContent-Type: multipart/mixed; boundary="B"\r\n\r\n--B\r\nContent-Type: text/html\r\n\r\n<i>h</i>\r\n'
        b"--B\r\nContent-Type: text/plain\r\n\r\none\r\n--B\r\nContent-Type: text/plain\r\nContent-Disposition: attachment\r\n\r\nno\r\n--B--\r\n"
    )
    (tmp_path / "broken.eml").write_bytes(b"Content-Type: text/plain; charset=nope\r\nContent-Transfer-Encoding: base64\r\n\r\n!!!\r\n")
    first = eml.read_eml(spark, [str(tmp_path)]).where("subject = 's'").head()
    assert first["body"].strip() == "one"
    both = {r["source_file"].rsplit("/", 1)[-1]: r for r in eml.read_eml(spark, [str(tmp_path)], "concat").collect()}
    assert both["m.eml"]["body"].strip() == "<i>h</i>one"
    assert "broken.eml" in both


def test_undecodable_part_keeps_its_payload(spark, tmp_path):
    (tmp_path / "p.eml").write_bytes(
        b'Subject: s\r\nContent-Type: multipart/mixed; boundary="B"\r\n\r\n--B\r\nContent-Type: text/plain\r\n\r\nok\r\n'
        b"--B\r\nContent-Type: text/plain; charset=nope\r\n\r\nraw\r\n--B--\r\n"
    )
    assert eml.read_eml(spark, [str(tmp_path)], "concat").head()["body"] == "okb'raw'"


def test_read_mail_by_suffix(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Subject: Hi\n\nbody\nfrom: x@y.z\nFrom: last@y.z\n")
    row = load.read_mail(spark, str(tmp_path / "a.txt")).head()
    assert (row["subject"], row["from"], row["reply_to"]) == ("Hi", "last@y.z", "")
    assert row["body"].startswith("body\n")
    (tmp_path / "a.csv").write_text('subject,body\ns0,b0\ns1,"b,1"\n')
    assert load.read_mail(spark, str(tmp_path / "a.csv"), 1).head()["body"] == "b,1"
    assert load.read_mail(spark, str(tmp_path / "a.csv"), 9).head()["subject"] == "s0"


DUMP = """From: ghost

Subject: one
From: a@b
body 1
To: late
body 2
more

Subject: two

Date: today
only body
"""


def test_assemble_from_disk(spark, tmp_path):
    (tmp_path / "dump.txt").write_text(DUMP)
    rows = textmail.read_lines(spark, [str(tmp_path / "dump.txt")])
    got = lines.assemble(rows).orderBy("rec").collect()
    assert [(r["subject"], r["from"], r["receiver"], r["date"], r["body"]) for r in got] == [
        ("one", "a@b", "late", None, "body 2 more"),
        ("two", None, None, None, ""),
        ("", None, None, "today", "only body"),
    ]
    kept = lines.assemble(rows, late_header="append", with_date=False).orderBy("rec").collect()
    assert [r["body"] for r in kept] == [" body 1 body 2 more", "", " Date: today only body"]


def test_assemble_over_many_splits(spark, tmp_path):
    text = "".join(f"Subject: s{i}\nFrom: f{i}\nline a{i}\nline b{i}\n\n" for i in range(400))
    (tmp_path / "dump.txt").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = textmail.read_lines(spark, [str(tmp_path / "dump.txt")])
        assert rows.select("block").distinct().count() > 10
        for boundary in ("blank", "subject"):
            got = lines.assemble(rows, boundary).orderBy("rec").collect()
            assert [(r["subject"], r["from"], r["body"]) for r in got] == [
                (f"s{i}", f"f{i}", f"line a{i} line b{i}") for i in range(400)
            ]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_headers_and_roles():
    assert csv.header_names(["", "7", " a "]) == ["column_0", "column_1", "a"]
    assert csv.infer_roles(["Title", "msg_text", "body2", "spam"]) == {"subject": "Title", "body": "body2", "label": "spam"}


def test_required_columns(spark):
    with pytest.raises(ValueError, match="body"):
        require_columns(spark.createDataFrame([("a",)], "subject string"), ["subject", "body"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "msg_id long, body string, source_file string")
    path = str(tmp_path / "t")
    sinks.write_processed(df, path)
    sinks.write_processed(df, path, mode="append")
    back = spark.read.parquet(path)
    assert back.count() == 4 and back.where("source_file = 'x'").count() == 2
    mails = spark.createDataFrame([(f"/in/{k}.eml", "b") for k in range(9)], "source_file string, body string")
    sinks.write_processed(mails, path + "m")
    assert [r[0] for r in spark.read.parquet(path + "m").select("source").distinct().collect()] == ["eml"]
    sinks.write_table(df, path + "c", "csv")
    assert spark.read.option("header", True).csv(path + "c").count() == 2
    m = spark.createDataFrame([(0.5, 3, "note")], "accuracy double, n long, note string")
    assert sinks.scalar_metrics(m).columns == ["accuracy", "n"]


def test_json_sink(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "a@b", "s", "phishing", 0.97, 1, 2, 3, 0.5, 1)],
        "msg_id long, `from` string, subject string, prediction_label string, p double, url_count int, word_count int, urgency_hits int, sentiment_compound double, spoof_flag int",
    )
    sinks.write_json_results(df, str(tmp_path / "j"), verbose=True)
    got = json.loads(spark.read.text(str(tmp_path / "j")).head()[0])
    assert got["confidence"] == "high" and got["spoof_flag"] == 1 and got["from"] == "a@b"


def test_features_run_on_a_stream(spark, tmp_path):
    schema = "msg_id long, `from` string, reply_to string, subject string, body string"
    spark.createDataFrame([(1, "a@b.ru", None, "urgent", "see www.x.com")], schema).write.json(str(tmp_path / "in"))
    stream = features.numeric_features(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("feat").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    row = spark.sql("select * from feat").head()
    assert (row["spoofing"], row["url_count"], row["urgency_count"]) == (1, 1, 2)


def test_dispatch_of_lines(spark):
    df = spark.createDataFrame([("a,b,c",), ("a",), ("a,,",)], "line string")
    got = csv.parse_lenient(df, "line", ["x", "y"], []).collect()
    assert [tuple(r) for r in got] == [("a", None)]
    assert df.select(csv.delimiter_vote(F.col("line")).alias("d")).head()["d"] == ","


def test_messages_are_parsed_a_few_at_a_time(spark, monkeypatch):
    """Slices of two: damaged messages and carried columns stay in place."""
    monkeypatch.setattr(eml, "SLICE", 2)
    rows = [(i, None if i in (3, 4) else bytearray(f"Subject: s{i}\r\n\r\nb{i}\r\n".encode())) for i in range(7)]
    df = spark.createDataFrame(rows, "id bigint, content binary").coalesce(1)
    first = {r.id: (r.subject, r.body.strip()) for r in eml.parse_eml(df, "content", {"id": "bigint"}).collect()}
    assert first == {i: (f"s{i}", f"b{i}") for i in (0, 1, 2, 5, 6)}
    both = {r.id: r.subject for r in eml.parse_eml(df, "content", {"id": "bigint"}, "concat").collect()}
    assert both == {i: "" if i in (3, 4) else f"s{i}" for i in range(7)}
