"""Messages, features, pseudonyms, sources and sinks."""

import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mailloom.functions import mime
from mailloom.operators import anonymize, features
from mailloom.sources import mails as src

RAW = 'From: A <a@x.test>\nTo: "Zipp, Loth" <l.zipp@uni.example>\nSubject: =?utf-8?B?w5xiZXI=?=\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b1"\n\n--b1\nContent-Type: text/plain; charset="iso-8859-1"\nContent-Transfer-Encoding: quoted-printable\n\nf=FCr http://example.com/abc\n--b1\nContent-Type: text/html; charset="utf-8"\nContent-Transfer-Encoding: base64\n\nPGI+aGk8L2I+\n--b1\nContent-Type: application/zip; name="a.tar.gz"\nContent-Disposition: attachment\n\n[content removed, 70000 bytes]\n--b1--\n'


def mails(spark, *raws):
    return src.parsed(spark.createDataFrame([(f"m{i}", r) for i, r in enumerate(raws)], "mail_id string, raw string"))


def test_parse_and_features(spark):
    m = mails(spark, RAW, "", None, "no header at all", RAW.replace("--b1--", ""), "Subject: s\n\n", "Subject: s\n\nbody")
    rows = {r.mail_id: r for r in m.collect()}
    assert [rows[k].error is None for k in sorted(rows)] == [True, False, False, False, False, True, True]
    assert rows["m0"].headers["Subject"] == "Über" and rows["m0"].headers["Sender"] is None and sorted(r.ord for r in rows.values()) == list(range(7))
    assert [(p.content_type, p.encoding, p.charset) for p in rows["m0"].payloads] == [("PLAINTEXT", "QUOTEDPRINTABLE", "iso-8859-1"), ("HTMLTEXT", "BASE64", "utf-8")]
    assert src.rejects(m).count() == 4
    f = {r.mail_id: r for r in features.extracted(m.unionByName(m)).collect()}
    assert set(f) == {"m0", "m5", "m6"}
    x = f["m0"]
    assert (x.subject, x.text_payloads, x.html_payloads, x.payload_types, x.uri_amount, x.schemes_string, x.hosts_string) == ("Über", "für http://example.com/abc", "<b>hi</b>", "texthtml", "1", "http", "example.com/ab")
    assert (x.html_skeletons, x.total_attachment_size, x.attachment_fil_extensions, x.attachment_names) == ("<b></b>", "131072", ".gz", "a.tar.gz")
    assert f["m5"].text_payloads == "" and f["m5"].total_attachment_size == "65536"
    with pytest.raises(KeyError):
        features.selected(features.extracted(m), without=("nothing",))
    assert features.selected(features.extracted(m), non_categorical=False).columns == ["mail_id", *[c for c in features.FEATURES if c in features.CATEGORICAL]]


def test_links(spark):
    cases = {"http://example.com/abc": "example.com/ab", "https://a.de": "a.d", "http://h.de:80/x": "h.de:80", "mailto:joe@x.de": "None", "": "", "x" * 200_000: ""}
    got = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string").select("want", features.hosts(F.col("t")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    two = spark.createDataFrame([("http://a.test/x http://a.test/x ftp://b.test/y",)], "t string").select(features.uri_amount(F.col("t")).alias("n"), features.schemes(F.col("t")).alias("s"), features.hosts_clean(F.col("t")).alias("h")).first()
    assert (two.n, two.s, two.h) == ("3", "ftphttp", ["a.test", "b.test"])


def test_buckets_and_extensions(spark):
    sizes = spark.createDataFrame([(0, "65536"), (65535, "65536"), (65536, "131072"), (16777216, "16777216"), (10 ** 12, "16777216")], "n bigint, want string").select("want", features.size_bucket(F.col("n")).alias("got")).collect()
    assert all(r.want == r.got for r in sizes)
    names = ["a.txt", "a.tar.gz", ".profile", "..x", "a.", "dir/.x", "dir.d/file", "noext", "", "a/b.c", "...a.b"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", features.extension(F.col("n")).alias("e")).collect()
    assert all(r.e == os.path.splitext(r.n)[1] for r in got)


def test_codecs():
    for enc in ("BASE64", "QUOTEDPRINTABLE", "UNDEFINED"):
        assert mime.decoded(mime.encoded("grün = ok\n".encode(), enc), enc) == "grün = ok\n".encode()
    assert mime.text_of("=FF=FCx", "QUOTEDPRINTABLE", "utf-8") == "x" and mime.text_of("a", None, "no-such") == "a"
    assert mime.decoded("!!!", "BASE64") == b"" and mime.decoded("YWJ", "BASE64") == b"ab"
    assert mime.skeleton_of("<style>p{}</style><p>a &amp; b</p>") in ("<style>p{}</style><p></p>",)
    assert mime.payloads_of("Content-Type: multipart/mixed\n\nx") == []
    deep = "".join(f'Content-Type: multipart/mixed; boundary="b{i}"\n\n--b{i}\n' for i in range(40)) + "x"
    deep += "\n" + "\n".join(f"--b{i}--" for i in range(39, -1, -1))
    assert [p["content"] for p in mime.payloads_of(deep.replace("\nx\n", "\nContent-Type: text/plain\n\nx\n"))] == ["x"]  # forty levels down


def test_skeleton_takes_out_the_longest_string_at_each_place():
    assert mime.skeleton_of("") == "" and mime.skeleton_of("<br>") == "<br>" and mime.skeleton_of("plain") == ""
    assert mime.skeleton_of('<p class="red">red</p><b>red car</b>') == '<p class=""></p><b></b>'
    assert mime.skeleton_of("<i>a &lt; b</i>") == "<i></i>"
    began = time.time()
    assert mime.skeleton_of("".join(f"<p>text {i}</p>" for i in range(30_000))) == "<p></p>" * 30_000 and time.time() - began < 20


def test_update_content(spark):
    m = mails(spark, RAW)
    new = m.select(mime.update_content("raw", "payloads", F.array(F.lit("Größe"), F.lit("<i>x</i>"))).alias("raw")).first().raw
    again = mime.payloads_of(new)
    assert [mime.text_of(p["content"], p["encoding"], p["charset"]).strip() for p in again] == ["Größe", "<i>x</i>"]


def test_pseudonyms(spark):
    m = mails(spark, RAW, RAW.replace("uni.example", "other.test"), "")
    got = {r.mail_id: r for r in anonymize.anonymized(m, ["uni.example"]).collect()}
    assert "zipp" not in got["m0"].raw.lower() and "l.zipp@" not in got["m0"].headers["To"] and got["m0"].headers["Sender"] is None
    assert got["m2"].error is not None
    words = spark.createDataFrame([('"Zipp, Loth" <l.zipp@uni.example>',), ("Single <x@y.test>",), (None,), ("",)], "t string").select(anonymize.recipient_words(F.col("t")).alias("w")).collect()
    assert words[0].w == ["Zipp", "Loth", "l.zipp", "l", "zipp"] and words[2].w in (None, []) and words[3].w == []
    stable = spark.range(2).select(anonymize.pseudonym(F.lit("A@x.test"), "email").alias("a"), anonymize.pseudonym(F.lit("a@X.test"), "email").alias("b")).distinct().collect()
    assert len(stable) == 1 and stable[0].a == stable[0].b
    assert anonymize.anonymized(m.limit(0), []).count() == 0


def test_files(spark, tmp_path):
    box = "From a Mon\nSubject: 1\n\nx\n>From y\n\nFrom b Tue\nSubject: 2\n\nz\n"
    (tmp_path / "box").write_text(box)
    got = src.read_mbox(spark, str(tmp_path / "box")).orderBy("number").collect()
    assert [r.raw for r in got] == ["Subject: 1\n\nx\nFrom y\n", "Subject: 2\n\nz\n"]
    # by byte ranges: many small splits give what one gives
    many = "".join(f"From a Mon\nSubject: {i}\n\nx{i} grün\n>From y\n\n" for i in range(3000)) + "From b Tue\nSubject: last"
    (tmp_path / "many").write_text(many)
    (tmp_path / "junk").write_text("no mailbox at all\n\nFrom a Mon\nSubject: 1\n\nx\n")
    whole = [tuple(r) for r in src.read_mbox(spark, str(tmp_path / "many")).orderBy("number").collect()]
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        parts = src.read_mbox(spark, str(tmp_path / "many"))
        assert [tuple(r) for r in parts.orderBy("number").collect()] == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert len(whole) == 3001 and whole[7][1:] == (7, "Subject: 7\n\nx7 grün\nFrom y\n") and whole[-1][1:] == (3000, "Subject: last")
    assert [r.raw for r in src.read_mbox(spark, str(tmp_path / "junk")).collect()] == ["Subject: 1\n\nx\n"]
    with pytest.raises(ValueError, match="stands 2 times"):
        src.export_links(spark.createDataFrame([("k", "/a/x"), ("k", "/b/x")], "cluster_id string, member string"), str(tmp_path / "twice"))
    src.write_eml(spark.createDataFrame([("u.eml", RAW)], "mail_id string, raw string"), f"file://{tmp_path}/by_uri")
    assert (tmp_path / "by_uri" / "u.eml").read_text() == RAW
    src.write_eml(spark.createDataFrame([("a.eml", RAW), ("b.eml", None), (None, "x")], "mail_id string, raw string"), str(tmp_path / "out"))
    back = src.read_eml(spark, str(tmp_path / "out")).collect()
    assert [(r.mail_id, r.raw) for r in back] == [("a.eml", RAW)]
    (tmp_path / "domains.txt").write_text(" a.test \n\nb.test\na.test\n")
    assert sorted(r.domain for r in src.read_block_list(spark, str(tmp_path / "domains.txt")).collect()) == ["a.test", "b.test"]
    for d in ("t/c1/x", "t/c1/y", "t/c2/d/z", "t/c2/beside"):
        p = tmp_path / d
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    leaves = src.leaf_clusters(src.tree(spark, str(tmp_path / "t"))).collect()
    assert Counter(r.cluster_id.rsplit("/t/", 1)[1] for r in leaves) == {"c1": 2, "c2/d": 1}
    c = spark.createDataFrame([("k", str(tmp_path / "t/c1/x"))], "cluster_id string, member string")
    src.export_links(c, str(tmp_path / "links"))
    assert (tmp_path / "links/k/x").read_text() == "x"
    src.write_clusters(c, str(tmp_path / "clusters"))
    assert spark.read.parquet(str(tmp_path / "clusters")).count() == 1


def test_file_names(spark):
    rows = [("Thu, 04 Jan 2024 12:49:13 +0100", "<m>", "t"), ("Thu, 4 Jan 2024 12:49:13 +0100 (CET)", None, None), (None, "<m>", "t"), ("bad", "<m>", "t")]
    got = [r.n for r in spark.createDataFrame(rows, "d string, m string, t string").select(src.eml_file_name(F.col("d"), F.col("m"), F.col("t")).alias("n")).collect()]
    assert got[0].startswith("2024-01-04-12:49:13_") and got[1].startswith("2024-01-04-12:49:13_") and got[2] is None and got[3] is None
