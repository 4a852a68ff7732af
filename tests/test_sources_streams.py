import pytest
from pyspark.sql import functions as F

from msgscreen import route, scan
from msgscreen.plans import registered
from msgscreen.sources.messages import MESSAGE_SCHEMA, corpus, credential_messages, derived_messages, read_messages
from msgscreen.sources.storage import shared_dir
from msgscreen.streaming.stream import start_scan, stream_files


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture()
def table(spark):
    data = [("1", "web", "s1", "mail a@b.co"), ("2", "web", None, "password: x1"), ("3", "app", "s2", "fine"), ("4", "app", "s2", " ")]
    return spark.createDataFrame(data, MESSAGE_SCHEMA)


@pytest.mark.parametrize("format", ["parquet", "json", "csv", "orc"])
def test_formats_round_trip(spark, table, tmp_path, format):
    path = str(tmp_path / format)
    options = {"header": "true"} if format == "csv" else {}
    keep = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"} if format == "csv" else {}
    table.write.options(**options, **keep).format(format).save(path)
    assert rows(scan(read_messages(spark, path, format, **options, **keep))) == rows(scan(table))


def test_text_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("mail a@b.co\nfine\n")
    got = scan(read_messages(spark, str(tmp_path / "a.txt"), "text")).collect()
    assert len({r.msg_id for r in got}) == 2 and sorted(r.source for r in got) == ["a.txt", "a.txt"]


def test_message_keys_are_unique(spark, small_dir):
    df = corpus(spark, small_dir)
    assert df.count() == df.select("msg_id").distinct().count()


def test_only_needed_columns_are_read(spark, small_dir):
    plan = scan(corpus(spark, small_dir))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan
    assert "ReadSchema: struct<c_custkey:bigint>" in plan


def test_corpus_is_dealt_out_only_when_asked(spark, small_dir):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(corpus(spark, small_dir))
    assert corpus(spark, small_dir, partitions=5).rdd.getNumPartitions() == 5


def test_stream_equals_batch_and_resumes(spark, table, tmp_path):
    source = str(tmp_path / "in")
    out, checkpoint = shared_dir(spark, "out"), shared_dir(spark, "checkpoint")
    table.where("msg_id < '3'").write.parquet(source)

    def run():
        query = start_scan(stream_files(spark, source, max_files_per_batch=1), scan, out, checkpoint)
        query.awaitTermination()
        return query

    run()
    assert spark.read.parquet(out).count() == 2
    table.where("msg_id >= '3'").write.mode("append").parquet(source)
    query = run()
    got = spark.read.parquet(out)
    want = route(scan(table))
    assert rows(got.select(*want.columns)) == rows(want)
    seen = [p.observedMetrics["scan"].n_messages for p in query.recentProgress if "scan" in p.observedMetrics]
    assert sum(seen) == 1


def test_stream_partitions_by_route(spark, table, tmp_path):
    source, out = str(tmp_path / "in"), shared_dir(spark, "out")
    table.write.parquet(source)
    start_scan(stream_files(spark, source), scan, out, shared_dir(spark, "checkpoint")).awaitTermination()
    assert {r.route for r in spark.read.parquet(out).select("route").distinct().collect()} == {"forward", "reply"}
    assert spark.read.parquet(out).where(F.col("route") == "reply").first().llm_handoff.violation_type == "secrets"


@pytest.fixture()
def key_tables(spark, tmp_path):
    """Two key tables of one file and one row group each, copies and a null among the keys, beside two small tables in folders."""
    where = tmp_path / "tables"
    keys = "case when id < 300 then 28 when id = 300 then null else id end"
    rows = spark.range(0, 25_000, 1, 1)
    made = {
        "customer": rows.selectExpr(f"{keys} as c_custkey", "'x' as c_name"),
        "part": rows.selectExpr(f"{keys} as p_partkey", "'Brand#1' as p_brand", "concat('lace ', id) as p_name", "'x' as p_type"),
        "documents": spark.createDataFrame([(1, "mail a@b.co", "web"), (2, "fine", "web")], "doc_id long, text string, source string"),
        "conversations": spark.createDataFrame([(1, 0, "hello, Kenji"), (1, 1, "password: x1")], "conv_id long, turn int, text string"),
        "labels": spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int"),
    }
    for name, df in made.items():
        df.write.parquet(str(where / f"{name}.parquet"))
    for name in ("customer", "part"):
        (part,) = (where / f"{name}.parquet").glob("part-*.parquet")
        (where / f"{name}.parquet").rename(where / f"{name}-folder")
        (where / f"{name}-folder" / part.name).rename(where / f"{name}.parquet")
    return str(where)


def most_in_a_task(df, prefix):
    mine = df.select("msg_id", F.spark_partition_id().alias("p")).where(F.coalesce("msg_id", F.lit(prefix)).startswith(prefix))
    return mine.groupBy("p").count().agg(F.max("count")).first()[0]


def test_many_keys_in_one_file_are_scanned_by_many_tasks(spark, key_tables):
    df = corpus(spark, key_tables)
    undealt = derived_messages(spark.read.parquet(f"{key_tables}/customer.parquet"))
    assert rows(df.where("source = 'customer'")) == rows(undealt)
    assert undealt.count() == 25_000 and most_in_a_task(df, "cust-") < 10_000
    plan = scan(df)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Repartition 3") :]
    assert "RLIKE" in plan and "RLIKE" not in below.split("Relation [c_custkey")[0]


def test_many_credential_keys_are_scanned_by_many_tasks(spark, key_tables):
    df = registered.with_credentials(spark, key_tables)
    undealt = credential_messages(spark.read.parquet(f"{key_tables}/part.parquet"))
    assert rows(df.where("source = 'part'")) == rows(undealt)
    assert most_in_a_task(df.where("source = 'part'"), "part-") < 10_000
    found = registered.QUERIES["secret_rules"](spark, key_tables)._jdf.queryExecution().optimizedPlan().toString()
    below = found[found.index("Repartition 3, true", found.index("p_brand")) :]
    assert "regexp_extract_all" in found and "regexp_extract_all" not in below.split("Relation [p_partkey")[0]
    assert "BroadcastHashJoin" not in registered.scan_credentials(spark, key_tables)._jdf.queryExecution().executedPlan().toString()


def test_stream_reads_folders_and_deals_out_keys(spark, key_tables):
    got = registered.stream_scan(spark, key_tables)
    want = route(scan(corpus(spark, key_tables))).select("msg_id", "route")
    assert rows(got.select("msg_id", "route")) == rows(want)
    files = got.where("msg_id like 'cust-%'")
    assert files.select(F.input_file_name()).distinct().count() >= 6
