import zipfile

import pytest
from pyspark.sql import functions as F

from corvidex.sources import files, registry, sinks, transcripts
from corvidex.sources.chatlog import parse_log, parse_logs
from corvidex.sources.worklog import RULE, category, latest_time, parse_worklogs, split_large, split_sections

BAR = "=" * 80


def test_six_dialects():
    log = f"""--- PROMPT LOG ENTRY ---
TIMESTAMP: 2026-01-02 12:30
USER: Look at ABC-12
ASSISTANT: Done looking.
--- END PROMPT LOG ENTRY ---
TIMESTAMP: 2026-01-03 09:15 CEST
USER PROMPT: Plan it
ASSISTANT OUTPUT: Planned.
FINDINGS:
All is well.
{BAR}
=== 2026-01-04 08:00 ===
MODE: PLAN
PROMPT: Apply it
RESPONSE: Applied.
FILES CHANGED:
core/a.txt
{BAR}
[2026-01-05T09:00:00Z] XYZ-7 delivery
USER: Compare ABC-9
ASSISTANT: Compared.
[2026-01-06T09:00:00Z] USER: A pair
[2026-01-06T09:00:00Z] ASSISTANT: Its answer
[2026-01-07 11:00:00] inventory
cluster=one
{BAR}"""
    got = parse_log(log, "x.log")
    assert [e["dialect"] for e in got] == ["Fenced", "Labelled", "Block", "Ticket", "Pair", "Artifact"]
    assert [e["user"] for e in got] == ["Look at ABC-12", "Plan it", "Apply it", "Compare ABC-9", "A pair", ""]
    assert [e["assistant"].split("\n")[0] for e in got[:5]] == ["Done looking.", "Planned.", "Applied.", "Compared.", "Its answer"]
    assert got[1]["sections"] == {"FINDINGS": "All is well."} and got[2]["sections"] == {"FILES CHANGED": "core/a.txt"}
    assert got[0]["tickets"] == ["ABC-12"] and got[3]["tickets"] == ["XYZ-7", "ABC-9"]
    assert got[2]["raw_mode"] == "PLAN" and got[0]["raw_timestamp"] == "2026-01-02 12:30" and got[4]["raw_timestamp"] == "2026-01-06T09:00:00Z"
    for e in got:
        assert log.encode()[e["byte_offset"] :].decode().split("\n")[0].strip() == log.split("\n")[e["start_line"] - 1].strip()


def test_log_edges():
    assert parse_log("") == [] and parse_log("\n\n") == []
    (e,) = parse_log("--- PROMPT LOG ENTRY ---\nUSER: open\nASSISTANT: fence")
    assert e["fence_imbalance"] == "unmatched_opener"
    (e,) = parse_log("TIMESTAMP: 2026-01-01\nUSER: dates\nASSISTANT: see\n2026-01-02-report.md\n2026-01-03 deployment done")
    assert e["assistant"].endswith("deployment done")
    two = parse_log("USER: a\nASSISTANT: b\nUSER: c\nASSISTANT: d")
    assert [(x["user"], x["assistant"]) for x in two] == [("a", "b"), ("c", "d")]


def test_logs_resume(spark):
    text = "USER: a\nASSISTANT: ż\n" + BAR + "\nUSER: c\nASSISTANT: d\n"
    at = len(("USER: a\nASSISTANT: ż\n" + BAR + "\n").encode())
    df = spark.createDataFrame([("p", text, at), ("q", None, None), ("r", "", 5)], "path string, text string, at long")
    (r,) = parse_logs(df, offset="at").collect()
    assert (r.user, r.start_line, r.byte_offset) == ("c", 4, at)
    assert parse_logs(df.limit(0)).count() == 0


def test_worklog(spark):
    text = f"intro\n{RULE}\nSTATUS ABC-1\n{RULE}\n- ok\n- 2026-02-03 10:00 VERIFIED\n{RULE}\nNEXT ACTION\n{RULE}\n1. go\n"
    assert [(h, a, b) for h, a, b, _ in split_sections(text)] == [("TICKET SUMMARY", 1, 1), ("STATUS ABC-1", 2, 6), ("NEXT ACTION", 7, 10)]
    assert split_sections("just text") == [("EVIDENCE", 1, 1, ["just text"])] and split_sections("") == []
    big = ("H", 5, 104, [f"{i}. " + "x" * 50 for i in range(100)])
    parts = split_large(big, 1000)
    assert len(parts) > 4 and [x for p in parts for x in p[3]] == big[3] and parts[0][1] == 5 and parts[-1][2] == 104
    rows = parse_worklogs(spark.createDataFrame([("w/ABC-1-log.md", text)], "path string, text string")).orderBy("source_order").collect()
    assert [(r.category, r.ticket) for r in rows] == [("summary", "ABC-1"), ("status", "ABC-1"), ("next-action", "ABC-1")]
    df = spark.createDataFrame([("FINDING 3",), (None,), ("zzz",)], "h string")
    assert [r[0] for r in df.select(category(F.col("h"))).collect()] == ["findings", "other", "other"]
    t = spark.createDataFrame([(text + "2026-02-05\nnothing 2027-01-01 here",)], "t string").select(latest_time(F.col("t"))).first()[0]
    assert t == 1770332399999999


def test_transcripts(spark, tmp_path):
    lines = ['{"type":"user","sessionId":"s","promptId":"p1","timestamp":"t1","message":{"content":"<user_query>hi</user_query>"}}', '{"type":"assistant","message":{"content":[{"type":"thinking","text":"x"},{"type":"text","text":"a"}]}}', '{"type":"mode"}', "", '{"type":"assistant","message":{"content":"b"}}', "{broken", '{"role":"user","message":{"content":[{"type":"text","text":"unanswered"}]}}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    df = transcripts.read_lines(spark, str(tmp_path / "a.jsonl"))
    (r,) = transcripts.turns(df).collect()
    assert (r.user_text, r.assistant_text, r.prompt_id, r.start_line) == ("hi", "a\nb", "p1", 1)
    (tmp_path / "b.jsonl").write_text('{"type":"surprise"}')
    bad = transcripts.read_lines(spark, str(tmp_path / "*.jsonl"))
    with pytest.raises(transcripts.UnknownFormatError):
        transcripts.turns(bad)
    assert transcripts.turns(bad, fail_on_unknown=False).count() == 1


def test_files_and_archives(spark, tmp_path):
    (tmp_path / "d/sub").mkdir(parents=True)
    (tmp_path / "d/a.txt").write_text("zażółć")
    (tmp_path / "d/sub/b.java").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "d/c.bin").write_bytes(b"ab\0cd")
    (tmp_path / "d/e.docx").write_bytes(b"PK")
    with zipfile.ZipFile(tmp_path / "d/z.zip", "w") as z:
        z.writestr("in/App.java", "class App {}")
        z.writestr("dir/", "")
    (tmp_path / "d/bad.zip").write_bytes(b"nonsense")
    (tmp_path / "d/x.rar").write_bytes(b"Rar!")
    scan = files.dir_scan(spark, str(tmp_path / "d"))
    text = {r.file_name: (r.strategy, r.text) for r in files.extract_text(scan).collect()}
    assert text["a.txt"] == ("TEXT", "zażółć") and text["b.java"] == ("TEXT", "café") and text["c.bin"] == ("BINARY", None)
    assert text["e.docx"] == ("DOCUMENT", "[document e.docx, 2 bytes]") and text["z.zip"][0] == "BINARY"
    got = {(r.archive.rsplit("/", 1)[-1], r.file_name): (bytes(r.content) if r.content else None, r.problem) for r in files.archive_entries(scan.where("extension in ('.zip', '.rar')")).collect()}
    assert got[("z.zip", "App.java")] == (b"class App {}", None) and len(got) == 3
    assert got[("bad.zip", None)][1].startswith("BadZip") and got[("x.rar", None)][1] == "unsupported archive kind"
    cut = spark.createDataFrame([(("ab" + "ż" * 5).encode(),)], "c binary").select(files.decode(F.col("c"), 5)).first()[0]
    assert cut == "abż"


def test_gold(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"qid":"1","class":"K","lang":"en","query":"x","split":"dev","labels":[{"doc":"d","rel":3}]}\n{"qid":"1","class":"Z","lang":"pl","query":" ","split":"dev","labels":[{"doc":"d","rel":9}]}\n')
    g = files.gold_queries(spark, str(tmp_path / "g.jsonl"))
    assert files.gold_labels(g).count() == 2
    assert sorted(r.problem for r in files.gold_problems(g).collect()) == ["grade out of range", "no query", "qid occurs twice", "unknown class"]


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "docs")
    docs = spark.createDataFrame([("m.db", "chat:turns", "a", "x"), ("m.db", "zip one", "b", "y")], "origin_db string, source string, file_path string, content string")
    sinks.insert_documents(docs, p)
    sinks.replace_archives(docs.where("source = 'zip one'").withColumn("content", F.lit("new")), p)
    assert {(r.file_path, r.content) for r in spark.read.parquet(p).collect()} == {("a", "x"), ("b", "new")}
    sinks.purge_archive(spark, p, "chat:turns", ["m.db"])
    spark.catalog.clearCache()
    assert {r.file_path for r in spark.read.parquet(p).collect()} == {"b"}
    chunks = spark.createDataFrame([("m.db", "zip one", "b", 2, "two"), ("m.db", "zip one", "b", 1, "one"), ("m.db", "zip one", "c", 1, "fresh")], "origin_db string, source string, file_path string, chunk_no int, chunk string")
    assert {r.file_path: r.content for r in sinks.append_text(docs, chunks).collect()} == {"a": "x", "b": "y\none\ntwo", "c": "fresh"}
    back = docs.select(sinks.inflate(sinks.deflate(F.col("content"))).alias("c"))
    assert {r.c for r in back.collect()} == {"x", "y"} and sinks.compression_stats(docs).count() == 2
    e = spark.createDataFrame([("h1", 1), ("h1", 2), ("h2", 3)], "turn_hash string, sequence int")
    new, seen = sinks.emit_turns(e, spark.createDataFrame([("h2",)], "turn_hash string"), [F.col("sequence")])
    assert [r.sequence for r in new.collect()] == [1] and sorted(r.sequence for r in seen.collect()) == [2, 3]
    rows = spark.createDataFrame([(2, "t", "u", None), (1, None, "a", "b")], "sequence int, event_time string, user_text string, assistant_text string")
    assert sinks.export_log(rows, 1).first().block.startswith("TIMESTAMP: t\nUSER: u")
    sinks.save_eval_run(spark, str(tmp_path / "runs"), "r", {"k": 1}, rows.select("sequence"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_registry(tmp_path):
    r = registry.Registry(str(tmp_path / "d.json"), ["a.db", "b.db"])
    assert r.databases() == ["a.db", "b.db"]
    r.create("mine", ["a", "c.db", "a"])
    r.use("mine")
    r.add_database("mine", "b")
    r.remove_database("mine", "a.db")
    assert r.heal() == ["c.db"] and r.databases() == ["b.db"]
    r.rename("mine", "ours")
    r.delete("default")
    assert list(r.load()["datasets"]) == ["ours"]
    for bad in (lambda: r.delete("ours"), lambda: r.use("no"), lambda: r.create("../x", []), lambda: registry.safe_path(str(tmp_path), "../etc")):
        with pytest.raises(registry.RegistryError):
            bad()
    (tmp_path / "d.json").write_text("{broken")
    assert r.databases() == ["a.db", "b.db"]
