"""Nothing is lost: appended captures, late files, many per-capture rules,
ties of keywords, and report lines of large captures."""

import os

from frames import frame, raw_df
from pyspark.sql import functions as F

from wirelens import load_rules
from wirelens.operators.classify import classify_hosts
from wirelens.operators.report import report_csv_lines, report_json_lines
from wirelens.operators.rules import apply_rules, rules_frame, validate_rules
from wirelens.sources.pcap import PART_SHIFT, read_pcap, register, write_pcap


def some(n, first=0):
    return [frame("10.0.0.1", "10.0.0.2", 1000 + first + i, 80, payload=b"x" * (first + i)) for i in range(n)]


def test_append_twice_keeps_all_in_order(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "out")
    write_pcap(raw_df(spark, some(6), capture_id="c"), out, partitions=2)
    write_pcap(raw_df(spark, some(2, 6), capture_id="c"), out, partitions=2)
    rows = read_pcap(spark, out).orderBy("seq").collect()
    assert [bytes(r.data) for r in rows] == some(8)
    assert len({r.seq for r in rows}) == 8


def test_overwrite_swaps_at_commit(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "out")
    write_pcap(raw_df(spark, some(4), capture_id="c"), out)
    bad = raw_df(spark, some(2), capture_id="c").withColumn("ts_sec", F.raise_error(F.lit("stop")).cast("long"))
    try:
        write_pcap(bad, out, mode="overwrite")
        raise AssertionError("the job should have failed")
    except Exception as e:
        assert "stop" in str(e)
    assert read_pcap(spark, out).count() == 4
    write_pcap(raw_df(spark, some(3), capture_id="d"), out, mode="overwrite")
    assert {r.capture_id for r in read_pcap(spark, out).collect()} == {"d"} and read_pcap(spark, out).count() == 3


def test_stream_takes_late_files_of_earlier_names(spark, tmpdir_path):
    src, to, ck = (os.path.join(tmpdir_path, d) for d in ("in", "to", "ck"))
    os.makedirs(src)
    register(spark)

    def put(name, n):
        tmp = os.path.join(tmpdir_path, f"tmp-{name}")
        write_pcap(raw_df(spark, some(n), capture_id=name).coalesce(1), tmp, partitions=1)
        folder = os.path.join(tmp, name)
        os.rename(os.path.join(folder, os.listdir(folder)[0]), os.path.join(src, f"{name}.pcap"))

    def run():
        q = (spark.readStream.format("pcap").option("maxFilesPerTrigger", 1).load(src).writeStream.format("parquet")
             .option("checkpointLocation", ck).trigger(availableNow=True).start(to))
        q.awaitTermination()
        return {r[0]: r[1] for r in spark.read.parquet(to).groupBy("capture_id").count().collect()}

    put("m", 2)
    put("b", 1)
    assert run() == {"m": 2, "b": 1}
    put("a", 3)
    put("z", 4)
    for _ in range(3):
        last = run()
    assert last == {"m": 2, "b": 1, "a": 3, "z": 4}


def test_app_rules_of_many_captures(spark):
    raw = rules_frame(spark, apps=["youtube"], capture_id="c0")
    more = spark.range(1, 1500).select(F.lit("app").alias("rule_type"), F.lit("youtube").alias("value"), F.concat(F.lit("c"), "id").alias("capture_id"))
    rules, _ = validate_rules(raw.union(more).union(rules_frame(spark, apps=["netflix"])))
    app = load_rules(spark, apps=["youtube", "netflix"])[0].filter("rule_type = 'app'").select("value" if "value" in rules.columns else "app", "app")
    names = {str(r[0]).lower(): r["app"] for r in app.collect()}
    youtube, netflix = (next(v for k, v in names.items() if w in k) for w in ("youtube", "netflix"))
    rows = [("c7", youtube), ("c1499", youtube), ("c9999", youtube), ("c9999", netflix), ("c7", None)]
    df = spark.createDataFrame([(c, 1, a, "h") for c, a in rows], f"capture_id string, src_ip long, app_state {rules.schema['app'].dataType.simpleString()}, host_state string")
    got = [(r.capture_id, r.app_state, r.blocked) for r in apply_rules(df, rules).collect()]
    assert sorted(got, key=str) == sorted([("c7", youtube, True), ("c1499", youtube, True), ("c9999", youtube, False), ("c9999", netflix, True), ("c7", None, False)], key=str)


def test_keyword_ties_and_null_priority(spark):
    kw = spark.createDataFrame([(1, "abc", "B"), (1, "abc", "A"), (None, "zzz", "C"), (5, "zz", "D"), (2, "q", None)], "priority int, keyword string, app string")
    df = spark.createDataFrame([("c", 1, "x.abc.zzz", 80), ("c", 2, "zzz", 80), ("c", 3, "q", 80), ("c", 4, None, 80)], "capture_id string, seq long, host string, svc_port int")
    got = {r.host: r.named for r in classify_hosts(df, kw).collect()}
    assert got == {"x.abc.zzz": "A", "zzz": "D", "q": None, None: None}


def test_header_only_file_and_one_handle(spark, tmpdir_path):
    """A capture without packets gets a file with a header alone; rows of
    captures in turns end up in one file each."""
    out = os.path.join(tmpdir_path, "out")
    df = raw_df(spark, some(4), capture_id="a").unionByName(raw_df(spark, some(3), capture_id="b"))
    write_pcap(df.filter("capture_id = 'a'"), out, captures=df.select("capture_id"))
    (b,) = os.listdir(os.path.join(out, "b"))
    assert os.path.getsize(os.path.join(out, "b", b)) == 24 and os.path.getsize(os.path.join(out, "a", os.listdir(os.path.join(out, "a"))[0])) > 24
    assert read_pcap(spark, out).count() == 4
    turns = os.path.join(tmpdir_path, "turns")
    (df.select("capture_id", "seq", "ts_sec", "ts_usec", "data").coalesce(1).sortWithinPartitions("seq", "capture_id")
     .write.format("pcap").mode("append").save(turns))
    assert sorted((x, len(os.listdir(os.path.join(turns, x)))) for x in "ab") == [("a", 1), ("b", 1)]
    assert read_pcap(spark, turns).groupBy("capture_id").count().orderBy("capture_id").collect() == [("a", 4), ("b", 3)]


def test_report_lines_stay_in_order_at_large_parts(spark):
    at = 900_000 << PART_SHIFT
    totals = spark.createDataFrame([("c", *[1] * 6)], "capture_id string, total_packets long, total_bytes long, tcp_packets long, udp_packets long, forwarded long, dropped long")
    apps = spark.createDataFrame([("c", "DNS", 1, 100.0, False, "#")], "capture_id string, app string, count long, percentage double, blocked boolean, bar string")
    hosts = spark.createDataFrame([("c", f"h{i}", "DNS", s) for i, s in enumerate((0, 5, at, at + 1))], "capture_id string, host string, app string, first_seq long")
    lines = [r.line for r in report_json_lines(totals, apps, hosts).orderBy("section", "ord", "k").collect()]
    assert [x.strip() for x in lines if '"sni"' in x] == [f'"sni" : "h{i}",' for i in range(4)] and lines[-2:] == ["  } ]", "}"]
    csv = [r.line for r in report_csv_lines(totals, apps, hosts).orderBy("section", "ord", "k").collect()]
    assert csv[-5:] == ["SNI,Application", "h0,DNS", "h1,DNS", "h2,DNS", "h3,DNS"]
