"""The engine's input tables, derived from the given Parquet tables.

Every view covers its whole source table. ``oracle.py`` states the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faultweave.functions.vectors import md5_embedding
from faultweave.plans.investigate import Knowledge
from faultweave.schemas import FAILURE_TYPES
from faultweave.sources.exports import drop_blank_ids, resolve_headers
from faultweave.sources.store import store_documents as documents_of
from faultweave.sources.store import store_rows

# (log, description) of the incidents made from events; {job} stands for the job name.
TEMPLATES = (
    ("AWSBHV026E stream for {job} not submitted", "predecessor incomplete"),
    ("Plan did not trigger {job}: stream not submitted", "calendar gap"),
    ("Job {job} is in HOLD state", "waiting"),
    ("Job: {job} executor lost, Java heap", "memory"),
    ("Job {job} ABEND RC=126", "Permission denied on helper"),
    ("{job}: SyntaxError near line 3", "see OPS-12 and AB-7"),
    ("job {job} CPU usage 96 percent", "slow"),
    ("{job} exceeded its limit", "SLA breach"),
    ("upstream of {job} did not complete", "late feed"),
    ("{job} ended RC=255", "no output"),
    ("JOBCMD /usr/bin/python /jobs/x.py", "old interpreter"),
    ("room for {job} is full", "cpu fine"),
)
FAILURES = ("oom", "cpu_high", "unknown", "long_running", "python_version", "job_not_trigger", "disk_full", "")
REPO = {"workspace": "ops", "repo": "batch-jobs", "path": "jobs", "branch": "main"}
EMBEDDING_DIM = 8
MANY_JOBS = 6007


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is looked up once, since a query reads some tables often."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _text(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_no and job, five rows."""
    job = F.concat(F.lit("DBS_"), F.translate("r_name", " ", "_"))
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("job_no"), job.alias("job"))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incident per event."""
    e = F.col("event_id")
    log = _pick(tuple(t[0] for t in TEMPLATES), e % 12)
    return (
        table(spark, sf_dir, "events")
        .select("event_id", "props", (F.col("user_id") % 5).alias("job_no"))
        .join(jobs(spark, sf_dir), "job_no")
        .select(
            e.alias("request_id"),
            F.concat(F.lit("INC-"), _text(e)).alias("ticket_id"),
            F.when(e % 7 == 0, F.lit("")).otherwise(F.col("job")).alias("job_name"),
            F.when(e % 4 == 0, F.concat(F.lit("S"), _text(F.expr("event_id div 4 % 20")), F.lit(".py"))).alias(
                "script_name"
            ),
            F.when(e % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("run --id "), _text(e))).alias("command"),
            F.concat(F.replace(log, F.lit("{job}"), F.col("job")), F.lit(" "), F.col("props")).alias("tws_log"),
            _pick(tuple(t[1] for t in TEMPLATES), e % 12).alias("description"),
        )
    )


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents with a given 64-value vector each."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    number = vectors.agg(F.count("*")).scalar()
    return (
        incidents(spark, sf_dir)
        .select("request_id", "job_name", "script_name", (F.col("request_id") % number).alias("vec_id"))
        .join(vectors, "vec_id")
    )


def past_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past incidents with the given 64-value vectors."""
    return (
        table(spark, sf_dir, "embeddings")
        .withColumn("job_no", F.col("label") % 5)
        .join(jobs(spark, sf_dir), "job_no")
        .select(
            "vec_id",
            F.concat(F.lit("H-"), _text("vec_id")).alias("id"),
            F.col("job").alias("job_name"),
            F.concat(F.lit("S"), _text(F.col("vec_id") % 20), F.lit(".py")).alias("script_name"),
            "embedding",
        )
    )


def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the form of an incident export; every eleventh has a blank id."""
    d = F.col("doc_id")
    return (
        table(spark, sf_dir, "documents")
        .withColumn("job_no", d % 5)
        .join(jobs(spark, sf_dir), "job_no")
        .select(
            F.when(d % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("PI-"), _text(d))).alias("INCIDENT_ID"),
            F.col("job").alias("JOB_NAME"),
            F.concat(F.lit("S"), _text(d % 20), F.lit(".py")).alias("SCRIPT_NAME"),
            F.concat(F.lit("python3 /jobs/S"), _text(d % 20), F.lit(".py")).alias("COMMAND"),
            F.when(d % 9 != 0, F.col("source")).alias("SUMMARY"),
            F.col("text").alias("INCIDENT_DETAILS"),
            F.concat(F.lit(" rerun "), F.col("lang"), F.lit(" ")).alias("RESOLUTION"),
            F.concat(F.lit("cause "), _text("n_chars")).alias("ROOT_CAUSE"),
            F.lit("RC-1").alias("RESOLUTION_CODE"),
            F.lit("APP").alias("APPLICATION_CODE"),
            _pick(FAILURES, d % 8).alias("FAILURE_TYPE"),
            F.concat(F.lit("user"), _text(d % 9)).alias("RESOLVED_BY"),
            F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (d % 366).cast("int")), "yyyy-MM-dd").alias(
                "RESOLVED_DATE"
            ),
            (d % 30).cast("int").alias("MTTD"),
            (d % 90).cast("int").alias("MTTR"),
        )
    )


def store_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export as store rows without vectors."""
    return documents_of(drop_blank_ids(resolve_headers(export(spark, sf_dir))))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export as a store with eight-value vectors."""
    return store_rows(drop_blank_ids(resolve_headers(export(spark, sf_dir))), md5_embedding)


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return (
        table(spark, sf_dir, "documents")
        .withColumn("job_no", d % 5)
        .join(jobs(spark, sf_dir), "job_no")
        .select(
            d.alias("seq"),
            F.when(d % 4 != 0, F.concat(F.lit("OPS-"), _text(d))).alias("key"),
            F.when(d % 13 != 0, F.concat(F.lit("TK-"), _text(d))).alias("ticket_key"),
            F.when(d % 3 == 0, F.concat(F.lower("job"), F.lit(" failed"))).otherwise(F.lit("")).alias("summary"),
            F.lit("Resolved").alias("status"),
            F.lit("High").alias("priority"),
            F.col("text").alias("description"),
            F.col("text").alias("root_cause"),
            F.lit(None).cast("string").alias("workaround"),
            F.when(d % 2 == 0, F.concat(F.lit("fix "), F.col("source"))).alias("fix_details"),
            F.when(d % 5 == 0, F.array(F.lit("batch"), F.col("job"))).otherwise(F.array("lang")).alias("labels"),
            F.array(F.struct(F.col("source").alias("author"), F.lit("2024").alias("created"), F.col("lang").alias("body"))).alias(
                "comments"
            ),
        )
    )


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scripts; the first ones carry the names that incidents ask for."""
    d = F.col("doc_id")
    number = F.concat(F.lit("S"), _text(d), F.when(d % 3 == 0, F.lit(".sh")).otherwise(F.lit(".py")))
    name = (
        F.when(d < 20, number)
        .when(d == 20, F.lit("DBS_ASIA.py"))
        .when(d == 21, F.lit("DBS_EUROPE.sh"))
        .otherwise(F.concat(F.lit("doc"), _text(d), F.lit(".py")))
    )
    return table(spark, sf_dir, "documents").select(
        name.alias("name"),
        F.col("text").alias("content"),
        F.when(d % 2 == 0, F.lit("755")).otherwise(F.lit("644")).alias("permissions"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        (s + 1).alias("rank"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("host"), _text(s)).alias("host"),
        (s + 5000).alias("port"),
        F.lit("/opt/jobs//").alias("scripts_path"),
    )


def playbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per failure type from the nations: its own name, and those of its region as actions."""
    nation = table(spark, sf_dir, "nation")
    regions = nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("actions"))
    return (
        nation.where(F.col("n_nationkey") < len(FAILURE_TYPES))
        .join(regions, "n_regionkey")
        .select(
            _pick(FAILURE_TYPES, F.col("n_nationkey")).alias("failure_type"),
            F.concat(F.lit("Runbook of "), "n_name").alias("root_cause"),
            "actions",
        )
    )


def job_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as past incidents of some thousand jobs."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P-"), _text(key)).alias("id"),
        F.concat(F.lit("J"), _text(key % MANY_JOBS)).alias("job_name"),
        F.lit("").alias("script_name"),
        md5_embedding(F.concat("p_name", _text(key))).alias("embedding"),
    )


def job_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as incidents of the same jobs."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("request_id"),
        F.concat(F.lit("J"), _text(key % MANY_JOBS)).alias("job_name"),
        F.lit(None).cast("string").alias("script_name"),
        md5_embedding(F.col("c_name")).alias("embedding"),
    )


def knowledge(spark: SparkSession, sf_dir: str) -> Knowledge:
    return Knowledge(
        store=store(spark, sf_dir),
        tickets=tickets(spark, sf_dir),
        scripts=scripts(spark, sf_dir),
        nodes=nodes(spark, sf_dir),
        embed=md5_embedding,
        dim=EMBEDDING_DIM,
        playbook=playbook(spark, sf_dir),
        repo=REPO,
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("log_name"), F.col("turn").alias("line_no"), F.col("text").alias("line")
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent calls, one per conversation turn."""
    t = F.col("turn")
    file = F.concat(F.lit("jobs/"), F.col("role"), F.lit("/f"), _text(F.col("conv_id") % 7), F.lit(".py"))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"),
        t.alias("seq"),
        _pick(("list_files", "get_repo_file_content", "v2.get_repo_file_content"), t % 3).alias("name"),
        F.when(t % 2 == 1, file).otherwise(F.lit("")).alias("file_path"),
        F.when(t % 4 == 2, F.concat(F.lit("alt/"), file)).alias("path"),
        F.when(t % 5 == 0, F.concat(F.lit("old-"), _text(t))).alias("filePath"),
    )


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    kind = F.when(F.col("role") == "user", F.lit("on_tool_start")).otherwise(F.lit("on_chat_model_end"))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"),
        t.alias("seq"),
        F.when(t % 5 == 4, F.lit("on_tool_end")).otherwise(kind).alias("kind"),
        F.concat(F.lit("tool"), _text(t)).alias("name"),
        F.col("text").alias("input"),
        F.when(t % 4 == 3, F.lit("")).otherwise(F.col("text")).alias("content"),
    )


def trade_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("account_id"),
        F.to_date("o_orderdate").alias("sched_date"),
        F.when(F.col("o_orderstatus") == "P", F.lit("PENDING")).otherwise(F.lit("DONE")).alias("status"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return (
        table(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"),
            F.col("o_custkey").alias("account_id"),
            F.to_date("o_orderdate").alias("trade_date"),
            F.col("l_extendedprice").alias("amount"),
        )
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position_id"),
        F.col("l_partkey").alias("instrument_id"),
        (F.col("l_suppkey") % 10).alias("portfolio_id"),
        F.col("l_returnflag").alias("currency_code"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("notional_value"),
    )


def risk_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No factor for large parts, two for some small ones."""
    part = table(spark, sf_dir, "part").where("p_size < 40")
    weight = (F.col("p_size") * 2).cast("decimal(18,2)")
    first = part.select(F.col("p_partkey").alias("instrument_id"), weight.alias("risk_weight"))
    second = part.where("p_size < 5").select(
        F.col("p_partkey").alias("instrument_id"), (weight + F.lit(1)).cast("decimal(18,2)").alias("risk_weight")
    )
    return first.unionByName(second)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = (
        table(spark, sf_dir, "orders")
        .where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"))
        .groupBy(F.col("o_custkey").alias("customer_id"))
        .agg(F.to_date(F.max("o_orderdate")).alias("last_score_date"))
    )
    return (
        table(spark, sf_dir, "customer")
        .select(F.col("c_custkey").alias("customer_id"), "c_acctbal", "c_nationkey")
        .join(urgent, "customer_id", "left")
    )


def netting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as netting results; a partition is a year start and a currency."""
    gross = F.col("o_totalprice").cast("decimal(18,2)")
    net = (gross * F.lit("0.9").cast("decimal(3,1)")).cast("decimal(18,3)")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("record_id"),
        F.to_date("o_orderdate").alias("run_date"),
        F.date_format(F.trunc("o_orderdate", "year"), "yyyy-MM-dd").alias("date"),
        F.col("o_orderpriority").alias("currency"),
        gross.alias("gross_amount"),
        F.when(F.col("o_orderstatus") != "F", net).alias("net_amount"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file_id"),
        "l_linenumber",
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("a.log")).otherwise(F.lit("a.txt")).alias("name"),
        F.col("l_shipdate").alias("mtime"),
    )


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user as the status text of a job."""
    latest = F.max_by("event_type", F.struct("ts", "event_id"))
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("job"))
        .agg(latest.alias("_type"))
        .select(
            "job",
            F.when(F.col("_type") == "view", F.lit(" incomplete "))
            .when(F.col("_type") == "signup", F.lit("job on Hold"))
            .when(F.col("_type") == "error", F.lit("ABEND rc=1"))
            .when(F.col("_type") == "click", F.lit("running"))
            .otherwise(F.lit(None).cast("string"))
            .alias("status_text"),
        )
    )


def waiting_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per event, waiting for the job two users on (some do not exist)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"), (F.col("user_id") + F.col("event_id") % 40).alias("predecessor")
    )
