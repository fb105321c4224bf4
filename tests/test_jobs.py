"""The command line on small folders."""

from pyspark.sql import functions as F

from mailloom.__main__ import COMMANDS, main
from mailloom.functions import mime
from mailloom.operators import compare

MAIL = 'From: a@x.test\nTo: "Zipp, Loth" <l.zipp@uni.example>\nSubject: {}\nMessage-ID: <{}@x>\nDate: Thu, 04 Jan 2024 12:49:13 +0100\nContent-Type: text/plain; charset="utf-8"\n\nDear Loth, call +49 69 90009 422 {}\n'


def test_commands(spark, tmp_path, capsys):
    box = tmp_path / "box"
    box.write_text("\n".join("From x Thu\n" + MAIL.format(s, i, "x" * i) for i, s in enumerate("aab")))
    assert main(["split", str(box), str(tmp_path / "mails")], spark) == 0
    folder = tmp_path / "mails" / "box"
    names = sorted(p.name for p in folder.iterdir() if p.suffix == ".eml")
    assert len(names) == 3 and all(n.startswith("2024-01-04-12-49-13_") for n in names)
    (folder / "broken.eml").write_text("nothing")
    assert main(["features", str(folder), str(tmp_path / "features")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "features")).count() == 3
    (tmp_path / "list").write_text("uni.example\n")
    assert main(["anonymize", str(folder), str(tmp_path / "anon"), str(tmp_path / "list")], spark) == 0
    text = "".join((tmp_path / "anon" / n).read_text() for n in names)
    assert "zipp" not in text.lower() and "90009" not in text
    assert spark.read.parquet(str(tmp_path / "anon" / "_rejects")).count() == 1
    assert main(["cluster", "fptree", str(folder), str(tmp_path / "gold")], spark) == 0
    assert main(["cluster", "clope_observed", str(folder), str(tmp_path / "single"), "5"], spark) == 0
    assert len(list((tmp_path / "single").iterdir())) == 3
    assert main(["diff", str(tmp_path / "gold"), str(tmp_path / "gold")], spark) == 0
    assert "Rand index 1.0" in capsys.readouterr().out
    assert main(["duplicates", str(tmp_path / "single")], spark) == 0
    assert "3 members in 3 clusters" in capsys.readouterr().out
    assert main(["sweep", str(folder), str(tmp_path / "gold"), str(tmp_path / "out")], spark) == 0
    out = capsys.readouterr().out
    assert all(x in out for x in ("clope_r7.5", "ctph_t60", "cctree_t30")) and (tmp_path / "out" / "clope_r20").exists()
    assert main(["show", str(folder)], spark) == 0 and main(["tree", str(tmp_path / "gold")], spark) == 0
    shown = capsys.readouterr().out
    assert "rejected: " in shown and "PLAINTEXT" in shown and "Subject: a" in shown
    assert main([], spark) == 2 and main(["cluster", "unknown", "a", "b"], spark) == 2


def test_commands_print_every_row(spark, capsys, monkeypatch):
    gold = spark.range(10_050).select(F.format_string("g%05d", "id").alias("gold_id"), F.format_string("m%05d", "id").alias("member"))
    other = gold.select(F.lit("other").alias("run_id"), F.translate("gold_id", "g", "c").alias("cluster_id"), "member")
    monkeypatch.setitem(COMMANDS, "diff", lambda spark: compare.diff_report(gold, other))
    assert main(["diff"], spark) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0] == "run_id\tline" and "10050 gold clusters" in lines[1] and "Rand index 1.0" in lines[2]
    assert sorted(x for x in lines[3:]) == [f"other\tg{i:05} matches c{i:05} (Jaccard 1.000)" for i in range(10_050)]


def test_headers_are_put_back():
    raw = "To: =?utf-8?B?w5w=?= <a@b.test>\r\nSubject: x\n y\nX-Other: z\n\nTo: body\n"
    new = mime.with_headers(raw, {"To": "Ü <c@d.test>", "Subject": None, "Sender": "new"})
    assert mime.headers_map(new)["To"] == "Ü <c@d.test>" and "Subject: x\n y" in new and new.endswith("\n\nTo: body\n") and "Sender" not in new
    assert mime.with_headers(raw, mime.headers_map(raw)) == raw
