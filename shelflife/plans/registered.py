"""The registered queries: every operator over whole driver tables."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shelflife.functions.formats import format_size
from shelflife.functions.messages import session_message
from shelflife.functions.times import as_of_literal, to_utc_wall_clock
from shelflife.operators import detect, footers, policy, prune, purge, retention, scoped, stats
from shelflife.plans import rescan, scan, status
from shelflife.plans.clean import clean_trees, plan_run
from shelflife.session import mounted_path, shared_dir
from shelflife.sources import inventory_source
from shelflife.sources.tables import table_content, table_inventory, union_roots
from shelflife.sources.tree import existing_roots, walk_inventory
from shelflife.streaming.explicit_end import sessions_until_end
from shelflife.streaming.session_end import closed_sessions, run_on_session_end

EVENTS_AT, EVENTS_HOURS = dt.datetime(2024, 1, 31), 168
PRUNE_HOURS, TREE_HOURS = 24, 10
ORDERS_AT, ORDERS_HOURS = dt.datetime(2001, 8, 2), 8760
BATCH_DAYS = ("2024-01-11", "2024-01-21")
SESSION_GAP, WATERMARK_DELAY = "6 hours", "1 hour"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Views over the driver tables.


def events_inventory(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    folder = F.concat("event_type", F.lit("/"), F.col("user_id").cast("string"))
    path = F.concat(folder, F.lit("/"), F.col("event_id").cast("string"), F.lit(".log"))
    events = _table(spark, sf_dir, "events")
    return table_inventory(events, "event_type", path, F.octet_length("props"), "ts", keep)


def _order_size() -> Column:
    """0 bytes to some GB, bounded per row so that sums stay in range at any scale."""
    return F.floor("o_totalprice").cast("bigint") * (F.col("o_orderkey") % 4096)


def orders_inventory(spark: SparkSession, sf_dir: str, dir_name: Column | None = None) -> DataFrame:
    path = F.concat_ws("/", "o_orderpriority", "o_custkey", "o_orderkey")
    root = F.col("o_orderpriority") if dir_name is None else dir_name
    return table_inventory(_table(spark, sf_dir, "orders"), root, path, _order_size(), "o_orderdate")


def by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_inventory(spark, sf_dir, F.col("o_custkey").cast("string"))


def customer_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored policy for most customers, with gaps: NULLs and customers without one, and one unknown column."""
    segment, turn = F.col("c_mktsegment"), F.col("c_custkey") % 4
    return _table(spark, sf_dir, "customer").where(F.col("c_custkey") % 10 != 0).select(
        F.col("c_custkey").cast("string").alias("dir_name"),
        F.when(segment != "MACHINERY", F.floor("c_acctbal").cast("int") * 6).alias("retention_hours"),
        F.when(segment == "BUILDING", False)
        .when(segment != "FURNITURE", True)
        .alias("clean_on_session_end"),
        F.when(segment == "AUTOMOBILE", True).when(segment == "HOUSEHOLD", False).alias("dry_run"),
        F.when(turn == 0, False).when(turn == 1, True).alias("session_end_summary"),
        F.col("c_name").alias("owner"),
    )


def order_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested retention per customer, one per order, some negative."""
    return _table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("dir_name"),
        (F.floor("o_totalprice").cast("int") - 150000).alias("retention_hours"),
        F.col("o_orderkey").alias("updated_at"),
    )


def document_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_content(_table(spark, sf_dir, "documents"), "source", "doc_id", "text")


def content_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.concat_ws("/", "conv_id", "turn")
    tables = {
        "documents": ("documents", F.col("doc_id"), "text"),
        "pages": ("pages", F.col("page_id"), "html"),
        "conversations": ("conversations", turn, "text"),
    }
    return union_roots(
        {
            root: table_content(_table(spark, sf_dir, name), F.lit(root), item, text)
            for root, (name, item, text) in tables.items()
        }
    )


def planted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document followed by one token made from its id; one kind is too short to count."""
    kind = F.col("doc_id") % 6
    digest = F.md5(F.col("doc_id").cast("string"))
    token = (
        F.when(kind == 0, F.concat(F.lit("sk-"), F.substring(digest, 1, 24)))
        .when(kind == 1, F.concat(F.lit("ghp_"), digest, F.lit("abcd")))
        .when(kind == 2, F.concat(F.lit("AKIA"), F.upper(F.substring(digest, 1, 16))))
        .when(kind == 3, F.concat(F.lit("xoxb-"), F.substring(digest, 1, 12)))
        .when(kind == 4, F.concat(F.lit("phc_"), digest))
        .otherwise(F.lit("sk-short"))
    )
    return _table(spark, sf_dir, "documents").withColumn("text", F.concat("text", F.lit("\n"), token))


def planted_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_content(planted_documents(spark, sf_dir), "source", "doc_id", "text")


def document_tree(documents: DataFrame, base: str | None = None) -> dict[str, str]:
    """Every document as a file ``lang/source/id.txt``, a minute old per character; returns the roots.

    The executors write the files to the shared folder, or over those below ``base``. Writing one again gives the
    same file.
    """
    spark = documents.sparkSession
    base = base or mounted_path(shared_dir(spark, "tree"))
    micros = F.unix_micros(as_of_literal(EVENTS_AT, T.TimestampType())) - F.col("n_chars") * 60_000_000

    def write(rows):
        import os

        for path, text, at in rows:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as file:
                file.write(text.encode())
            os.utime(path, ns=(at * 1000, at * 1000))

    path = F.concat(
        F.lit(base + "/"), F.concat_ws("/", "lang", "source", "doc_id"), F.lit(".txt")
    )
    # Rows come to a task a few at a time, in batches of some MB whatever the texts' length.
    documents.select(path.alias("path"), "text", micros.alias("micros")).foreachPartition(write)
    langs = documents.select("lang").distinct().collect()
    return {row["lang"]: f"{base}/{row['lang']}" for row in langs}


def _below(roots: dict[str, str]) -> Column:
    """A path of a tree from the name of its root on."""
    base = next(iter(roots.values())).rsplit("/", 1)[0]
    return F.substring("path", len(base) + 2, 1 << 30)


# A caller's own detectors: an assigned 40-digit token, in plain text and in markup, and any word of 40
# digits with enough different ones, which no pattern can tell.
TOKEN_PATTERN = 'token = (?:"|&quot;)([0-9a-f]{40})'
ASSIGNED_TOKEN = detect.Detector("Assigned tokens", TOKEN_PATTERN, ("token = ",), group=1)
RUN_PATTERN = "[0-9a-f]{40}"
VARIED = re.compile(r"\b[0-9a-f]{40}\b", re.ASCII)


def _varied_tokens(texts):
    return texts.map(lambda text: [word for word in VARIED.findall(text) if len(set(word)) >= 10])


BATCH_TOKEN = detect.BatchDetector("Assigned tokens", _varied_tokens, gate=RUN_PATTERN)


# Inventory, selection, policy.


def inventory(spark, sf_dir):
    return events_inventory(spark, sf_dir)


def multi_root_union(spark, sf_dir):
    return (
        content_roots(spark, sf_dir)
        .groupBy("dir_name")
        .agg(F.count(F.lit(1)).alias("items"), F.sum(F.octet_length("text").cast("bigint")).alias("bytes"))
    )


def stats_missing_root(spark, sf_dir):
    roots = (
        _table(spark, sf_dir, "events")
        .select(F.col("event_type").alias("dir_name"))
        .union(_table(spark, sf_dir, "orders").select("o_orderpriority"))
        .distinct()
    )
    found = stats.dir_stats(events_inventory(spark, sf_dir), EVENTS_AT, EVENTS_HOURS)
    return stats.stats_for_roots(roots, found)


def _with_unreadable(spark, sf_dir):
    """Entries whose stat failed (no size, no time), and some whose size alone is unknown."""
    failed, sizeless = F.col("value") < 10, F.col("value") > 100
    return events_inventory(spark, sf_dir, keep=["value"]).withColumns(
        {
            "size_bytes": F.when(~failed & ~sizeless, F.col("size_bytes")),
            "mtime": F.when(~failed, F.col("mtime")),
            "stat_ok": ~failed,
        }
    )


def unreadable_entries(spark, sf_dir):
    entries = _with_unreadable(spark, sf_dir)
    found = stats.dir_stats(entries, EVENTS_AT, EVENTS_HOURS)
    plan = retention.purge_plan(entries, EVENTS_AT, EVENTS_HOURS, True)
    return found.join(stats.purge_summary(plan, True).drop("message"), "dir_name", "left")


def expired_files(spark, sf_dir):
    return retention.expired_files(events_inventory(spark, sf_dir), EVENTS_AT, EVENTS_HOURS).select(
        "dir_name", "path", "size_bytes", "mtime"
    )


def expired_by_policy(spark, sf_dir):
    gone = retention.expired_by_policy(by_customer(spark, sf_dir), customer_policy(spark, sf_dir), ORDERS_AT)
    return gone.groupBy("dir_name", "retention_hours").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes")
    )


def folder_scopes(spark, sf_dir):
    """Windows of two roots and of every fourth user's folders; of some of these it is not set."""
    events = _table(spark, sf_dir, "events")
    root, user = F.col("event_type"), F.col("user_id")
    roots = events.select(root.alias("scope")).distinct().select("scope", F.when(F.col("scope") == "click", 100).otherwise(600).alias("retention_hours"))
    folders = events.where(user % 4 == 0).select(F.concat(root, F.lit("/"), user.cast("string"), F.lit("/")).alias("scope"), user.alias("user_id")).distinct()
    hours = F.when(F.col("user_id") % 3 != 0, (F.col("user_id") % 28 + 1).cast("int") * 24)
    return roots.where(F.col("scope").isin("click", "error")).union(folders.select("scope", hours))


def expired_by_folder(spark, sf_dir):
    gone = scoped.expired_by_folder(events_inventory(spark, sf_dir), folder_scopes(spark, sf_dir), EVENTS_AT)
    return gone.groupBy("dir_name", "retention_hours").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


def expired_by_dated_policy(spark, sf_dir):
    """Every seventh order sets its customer's window from its date on; some of them say nothing."""
    key = F.col("o_orderkey")
    versions = _table(spark, sf_dir, "orders").where(key % 7 == 0).select(
        F.col("o_custkey").cast("string").alias("dir_name"),
        F.col("o_orderdate").alias("valid_from"),
        F.when(key % 3 != 0, F.floor(F.col("o_totalprice") / 10).cast("int")).alias("retention_hours"),
    )
    gone = scoped.expired_by_dated_policy(by_customer(spark, sf_dir), versions, ORDERS_AT)
    return gone.select("dir_name", "path", "mtime", "retention_hours")


def effective_retention(spark, sf_dir):
    override = (
        F.when(F.col("c_mktsegment") == "MACHINERY", 0)
        .when(F.col("c_mktsegment") == "BUILDING", -1)
        .when(F.col("c_mktsegment") != "FURNITURE", F.col("c_nationkey") + 1)
    )
    configured = F.floor("c_acctbal").cast("int")
    return _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("dir_name"),
        override.alias("override_hours"),
        configured.alias("configured_hours"),
        policy.effective_retention(override, configured).alias("retention_hours"),
    )


def effective_dry_run(spark, sf_dir):
    flag = F.when(F.col("c_nationkey") > 12, True).when(F.col("c_nationkey") > 5, False)
    configured = F.when(F.col("c_mktsegment") == "AUTOMOBILE", True).when(
        F.col("c_mktsegment") == "HOUSEHOLD", False
    )
    return _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("dir_name"),
        policy.effective_dry_run(flag, configured).alias("dry_run"),
    )


def policy_overlay(spark, sf_dir):
    roots = by_customer(spark, sf_dir).select("dir_name").distinct()
    known = policy.policies_for(roots, customer_policy(spark, sf_dir))
    runs = policy.runs_on_session_end(F.col("clean_on_session_end"))
    return known.withColumns(
        {"runs": runs, "prints": runs & policy.shows_summary(F.col("session_end_summary"))}
    )


def policy_upsert(spark, sf_dir):
    return policy.set_retention(customer_policy(spark, sf_dir), order_updates(spark, sf_dir))


def policy_update_outcome(spark, sf_dir):
    return policy.update_outcome(order_updates(spark, sf_dir))


# Purge.


def purge_plan(spark, sf_dir):
    dry_run = policy.effective_dry_run(F.lit(False), F.lit(True))
    return retention.purge_plan(orders_inventory(spark, sf_dir), ORDERS_AT, ORDERS_HOURS, dry_run)


def purge_summary(spark, sf_dir):
    plan = retention.purge_plan(orders_inventory(spark, sf_dir), ORDERS_AT, ORDERS_HOURS)
    return stats.purge_summary(plan, False)


def purge_rollup(spark, sf_dir):
    return stats.purge_rollup(purge_summary(spark, sf_dir).drop("message"))


def purge_total(spark, sf_dir):
    return plan_run(orders_inventory(spark, sf_dir), ORDERS_AT, ORDERS_HOURS).total


def run_message(spark, sf_dir):
    """The four session-end lines per root: a window that finds files and one that finds none."""
    entries = orders_inventory(spark, sf_dir)
    gone = retention.expired_flag(entries, ORDERS_AT, ORDERS_HOURS)
    zero = F.lit(0).cast("bigint")
    found = entries.groupBy("dir_name").agg(
        F.count_if(gone).alias("n"), F.coalesce(F.sum(F.when(gone, F.col("size_bytes"))), zero).alias("size")
    )
    cases = F.array(
        *[
            F.struct(F.lit(dry).alias("dry_run"), files.alias("files"), freed.alias("bytes"))
            for dry in (False, True)
            for files, freed in ((F.col("n"), F.col("size")), (zero, zero))
        ]
    )
    return found.select("dir_name", F.inline(cases)).withColumn(
        "message", session_message(F.col("files"), F.col("bytes"), F.col("dry_run"))
    )


def table_purge_retained(spark, sf_dir):
    return retention.retained_rows(_table(spark, sf_dir, "events"), EVENTS_AT, EVENTS_HOURS, "ts")


def table_purge_partitions(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").withColumn("order_year", F.year("o_orderdate"))
    return purge.partition_actions(orders, "order_year", ORDERS_AT, ORDERS_HOURS, "o_orderdate")


def table_purge_applied(spark, sf_dir):
    """Orders written by year, purged in place, and what is left of them."""
    path = shared_dir(spark, "orders")
    orders = _table(spark, sf_dir, "orders").withColumn("order_year", F.year("o_orderdate"))
    orders.write.partitionBy("order_year").parquet(path)
    purge.purge_table(spark, path, "order_year", ORDERS_AT, ORDERS_HOURS, "o_orderdate")
    return spark.read.parquet(path)


def table_purge_layouts(spark, sf_dir):
    """The same by two-digit month and status, in two appends of which the second has a column more."""
    path = shared_dir(spark, "orders")
    orders = _table(spark, sf_dir, "orders").withColumn("order_month", F.date_format("o_orderdate", "MM"))
    odd = F.col("o_orderkey") % 2 == 1
    for rows in (orders.where(~odd), orders.where(odd).withColumn("note", F.col("o_orderpriority"))):
        rows.write.mode("append").partitionBy("order_month", "o_orderstatus").parquet(path)
    purge.purge_table(spark, path, "order_month", ORDERS_AT, ORDERS_HOURS, "o_orderdate")
    return spark.read.option("mergeSchema", "true").parquet(path)


def table_purge_files(spark, sf_dir):
    """Orders in files by ranges of time: most are kept or dropped by their footers."""
    path = shared_dir(spark, "orders")
    orders = _table(spark, sf_dir, "orders").withColumn("order_half", F.col("o_orderkey") % 2)
    orders.repartitionByRange(16, "o_orderdate").write.partitionBy("order_half").parquet(path)
    footers.purge_by_footers(spark, path, ORDERS_AT, ORDERS_HOURS, "o_orderdate")
    return spark.read.parquet(path).drop("order_half")


def prune_dirs(spark, sf_dir):
    """Files older than a day go; each user folder also has a sub-folder that was empty before.

    The files of one root are moved on by 40 days, so nothing of it is old and it is not swept.
    """
    files = events_inventory(spark, sf_dir)
    later = F.when(F.col("dir_name") == "view", F.col("mtime") + F.expr("INTERVAL 40 DAYS")).otherwise(F.col("mtime"))
    files = files.withColumn("mtime", later)
    folder = F.concat("event_type", F.lit("/"), F.col("user_id").cast("string"))
    empty = (
        _table(spark, sf_dir, "events")
        .select("event_type", folder.alias("folder"))
        .distinct()
        .select(
            F.col("event_type").alias("dir_name"),
            F.concat("folder", F.lit("/archive")).alias("path"),
            F.lit(None).cast("bigint").alias("size_bytes"),
            F.lit(None).cast("timestamp_ntz").alias("mtime"),
            F.lit(True).alias("is_dir"),
            F.lit(True).alias("stat_ok"),
        )
    )
    return prune.prune_plan_at(
        files.unionByName(empty), EVENTS_AT, PRUNE_HOURS, F.col("dir_name")
    )


# File trees made of the documents.


def tree_inventory(spark, sf_dir):
    roots = document_tree(_table(spark, sf_dir, "documents"))
    found = walk_inventory(spark, roots, shared_dir(spark, "walk"))
    # A folder's own time and size are no business of a purge.
    time = F.when(~F.col("is_dir"), to_utc_wall_clock(F.col("mtime")))
    return found.select("dir_name", _below(roots).alias("path"), "size_bytes", time.alias("mtime"), "is_dir", "stat_ok")


def tree_source(spark, sf_dir):
    """The same trees through the data source, asked in SQL for files over a time and under a size."""
    inventory_source.register(spark)
    roots = document_tree(_table(spark, sf_dir, "documents"))
    view = f"tree_{uuid.uuid4().hex}"
    spark.read.format(inventory_source.NAME).option("roots", json.dumps(roots)).load().createTempView(view)
    bound = EVENTS_AT - dt.timedelta(hours=TREE_HOURS)
    found = spark.sql(
        f"SELECT * FROM {view} WHERE NOT is_dir AND mtime < TIMESTAMP '{bound} UTC' AND size_bytes BETWEEN 1000 AND 100000"
    )
    return found.select("dir_name", _below(roots).alias("path"), "size_bytes", to_utc_wall_clock(F.col("mtime")).alias("mtime"))


def tree_status(spark, sf_dir):
    roots = document_tree(_table(spark, sf_dir, "documents"))
    return status.tree_status(spark, roots, EVENTS_AT, TREE_HOURS).stats


def tree_clean(spark, sf_dir):
    """A real purge: per root the files deleted, their bytes, and the folders removed."""
    roots = document_tree(_table(spark, sf_dir, "documents"))
    run = clean_trees(spark, roots, EVENTS_AT, TREE_HOURS)
    removed = run.removed.groupBy("dir_name").agg(F.count_if("removed").alias("folders"))
    return run.summary.join(removed, "dir_name", "left").withColumn(
        "folders", F.coalesce("folders", F.lit(0).cast("bigint"))
    )


def tree_scan(spark, sf_dir):
    roots = document_tree(planted_documents(spark, sf_dir))
    findings = scan.scan_trees(spark, roots).findings
    return findings.withColumnRenamed("item", "path").select(
        "dir_name", _below(roots).alias("path"), "category", "position", "secret"
    )


def tree_scan_parts(spark, sf_dir):
    """The same with files of more than 4 kB read in parts."""
    roots = document_tree(planted_documents(spark, sf_dir))
    findings = scan.scan_trees(spark, roots, split_bytes=4096).findings
    return findings.withColumnRenamed("item", "path").select(
        "dir_name", _below(roots).alias("path"), "category", "position", "secret"
    )


def tree_scan_touching(spark, sf_dir):
    """Files that end in a long run of digits, in which matches touch each other, read in parts shorter than the run."""
    digits = F.repeat(F.md5(F.col("doc_id").cast("string")), 40)
    documents = _table(spark, sf_dir, "documents").withColumn("text", F.concat("text", F.lit("\n"), digits))
    roots = document_tree(documents)
    inventory = walk_inventory(spark, roots, shared_dir(spark, "walk"))
    found = scan.scan_files(
        inventory, existing_roots(spark, roots), shared_dir(spark, "scan"), detect.from_patterns({"Runs": RUN_PATTERN}, span=100), (), 1000
    )
    return found.findings.withColumnRenamed("item", "path").select(
        "dir_name", _below(roots).alias("path"), "category", "position", "secret"
    )


def rescan_changed(spark, sf_dir):
    """Trees scanned, then scanned again after every fifth file lost its token and every ninth got another."""
    before, state = planted_documents(spark, sf_dir), shared_dir(spark, "rescan")
    roots = document_tree(before)
    rescan.rescan_trees(spark, roots, state)
    number = F.col("doc_id")
    token = F.concat(F.lit("\nAKIA"), F.upper(F.substring(F.md5(F.concat(F.lit("new"), number.cast("string"))), 1, 16)))
    plain = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("plain"))
    text = F.when(number % 9 == 0, F.concat("text", token)).otherwise(F.col("plain"))
    later = before.join(plain, "doc_id").where((number % 5 == 0) | (number % 9 == 0))
    document_tree(later.withColumns({"text": text, "n_chars": F.col("n_chars") + 1}).drop("plain"), next(iter(roots.values())).rsplit("/", 1)[0])
    found = rescan.rescan_trees(spark, roots, state).findings
    return found.withColumnRenamed("item", "path").select("dir_name", _below(roots).alias("path"), "category", "position", "secret")


# Reports.


def format_sizes(spark, sf_dir):
    return orders_inventory(spark, sf_dir).select(
        "path", "size_bytes", format_size(F.col("size_bytes")).alias("size_text")
    )


def dir_stats(spark, sf_dir):
    return stats.dir_stats(events_inventory(spark, sf_dir), EVENTS_AT, EVENTS_HOURS)


def dir_stats_orders(spark, sf_dir):
    return stats.dir_stats(orders_inventory(spark, sf_dir), ORDERS_AT, ORDERS_HOURS)


def retention_curve(spark, sf_dir):
    return stats.retention_curve(events_inventory(spark, sf_dir), EVENTS_AT, 24)


def status_report(spark, sf_dir):
    return stats.status_report(dir_stats_orders(spark, sf_dir))


def status_summary(spark, sf_dir):
    return stats.status_summary(dir_stats(spark, sf_dir), EVENTS_HOURS)


# Scan.


def secret_match_flags(spark, sf_dir):
    return detect.match_flags(planted_content(spark, sf_dir))


def secret_findings(spark, sf_dir):
    return detect.find_secrets(planted_content(spark, sf_dir))


def secret_summary(spark, sf_dir):
    return detect.summarize(secret_findings(spark, sf_dir))


def secret_custom_detector(spark, sf_dir):
    return detect.find_secrets(content_roots(spark, sf_dir), [*detect.BUILTIN_DETECTORS, ASSIGNED_TOKEN])


def secret_scanner_union(spark, sf_dir):
    return detect.scan_with(content_roots(spark, sf_dir), [ASSIGNED_TOKEN, BATCH_TOKEN])


def secret_entropy(spark, sf_dir):
    return detect.find_secrets(content_roots(spark, sf_dir), detect.ENTROPY_DETECTORS)


def secret_sketches(spark, sf_dir):
    """Findings of seven scans, summed up one by one, rolled up without the findings."""
    content = planted_documents(spark, sf_dir).withColumn("scan", F.col("doc_id") % 7)
    scans = table_content(content, "source", "doc_id", "text", keep=["scan"])
    return detect.roll_up(detect.summary_sketches(detect.find_secrets(scans), ["scan"]))


def scan_recommendation(spark, sf_dir):
    content = document_content(spark, sf_dir)
    findings = detect.find_secrets(content, [*detect.BUILTIN_DETECTORS, ASSIGNED_TOKEN])
    return detect.recommend(content.select("dir_name").distinct(), findings)


def scan_items(spark, sf_dir):
    content = document_content(spark, sf_dir)
    findings = detect.find_secrets(content, [ASSIGNED_TOKEN])
    return detect.items_concerned(content.select("dir_name", "item"), findings)


# Stream.


def _session_stream(
    spark: SparkSession,
    sf_dir: str,
    retention_pass: Callable | None = None,
    files: str | None = None,
    out_dir: str | None = None,
    sessions_of: Callable[[DataFrame], DataFrame] | None = None,
) -> str:
    """Play the events as a stream to its end; each batch with closed sessions runs the pass.

    ``files`` is a pattern of files to be played instead of the table's; a stream with the ``out_dir`` of another goes
    on where that one ended.
    """
    out_dir = out_dir or shared_dir(spark, "session-end")
    reader = spark.readStream.schema(_table(spark, sf_dir, "events").schema)
    # A pattern, so that the table may be one file or a folder of files.
    activity = reader.parquet(files or f"{sf_dir}/events.parque[t]")
    by_gap = lambda events: closed_sessions(events, "user_id", "ts", SESSION_GAP, WATERMARK_DELAY)
    sessions = (sessions_of or by_gap)(activity)

    def planned(as_of: dt.datetime, run_dir: str) -> DataFrame:
        return plan_run(events_inventory(spark, sf_dir), as_of, EVENTS_HOURS).total

    query = run_on_session_end(sessions, retention_pass or planned, out_dir)
    query.awaitTermination()
    return out_dir


def _session_parts(spark: SparkSession, sf_dir: str, sessions_of: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """The same in three parts by time, each written by as many tasks as it has, and played when it is there."""
    folder, events = shared_dir(spark, "events"), _table(spark, sf_dir, "events")
    days = [F.to_timestamp_ntz(F.lit(day)) for day in BATCH_DAYS]
    at, out_dir = F.col("ts"), None
    for k, part in enumerate([at < days[0], (at >= days[0]) & (at < days[1]), at >= days[1]]):
        events.where(part).write.parquet(f"{folder}/{k}")
        out_dir = _session_stream(spark, sf_dir, files=f"{folder}/*/*.parquet", out_dir=out_dir, sessions_of=sessions_of)
    return out_dir


def session_end_trigger(spark, sf_dir):
    out = spark.read.parquet(f"{_session_stream(spark, sf_dir)}/sessions").drop("batch_id")
    return out.withColumns({n: to_utc_wall_clock(F.col(n)) for n in ("session_start", "session_end")})


def session_end_run(spark, sf_dir):
    out = spark.read.parquet(f"{_session_stream(spark, sf_dir)}/runs").drop("batch_id")
    return out.withColumn("as_of", to_utc_wall_clock(F.col("as_of")))


def session_end_batches(spark, sf_dir):
    """The events in three parts by time: one run for each part that closes sessions."""
    runs = spark.read.parquet(f"{_session_parts(spark, sf_dir)}/runs")
    return runs.drop("batch_id").withColumn("as_of", to_utc_wall_clock(F.col("as_of")))


def session_end_events(spark, sf_dir):
    """Sessions that a purchase ends, or else the gap, over three parts by time."""
    is_end = F.col("event_type") == "purchase"
    ended = lambda events: sessions_until_end(events, "user_id", "ts", is_end, SESSION_GAP, WATERMARK_DELAY)
    out = spark.read.parquet(f"{_session_parts(spark, sf_dir, ended)}/sessions").drop("batch_id")
    return out.withColumns({n: to_utc_wall_clock(F.col(n)) for n in ("session_start", "session_end")})


def session_end_clean(spark, sf_dir):
    """The pass deletes: the run's files and bytes, and how many files the trees still hold."""
    roots = document_tree(_table(spark, sf_dir, "documents"))

    def cleaned(as_of: dt.datetime, run_dir: str) -> DataFrame:
        return clean_trees(spark, roots, as_of, TREE_HOURS, run_dir=run_dir).total

    runs = spark.read.parquet(f"{_session_stream(spark, sf_dir, cleaned)}/runs")
    left = walk_inventory(spark, roots, shared_dir(spark, "walk")).where(~F.col("is_dir")).count()
    return runs.select(
        to_utc_wall_clock(F.col("as_of")).alias("as_of"), "closed_sessions", "files", "bytes", "message",
        F.lit(left).cast("bigint").alias("files_left"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "inventory": inventory,
    "multi_root_union": multi_root_union,
    "stats_missing_root": stats_missing_root,
    "unreadable_entries": unreadable_entries,
    "expired_files": expired_files,
    "expired_by_policy": expired_by_policy,
    "expired_by_folder": expired_by_folder,
    "expired_by_dated_policy": expired_by_dated_policy,
    "effective_retention": effective_retention,
    "effective_dry_run": effective_dry_run,
    "policy_overlay": policy_overlay,
    "policy_upsert": policy_upsert,
    "policy_update_outcome": policy_update_outcome,
    "purge_plan": purge_plan,
    "purge_summary": purge_summary,
    "purge_rollup": purge_rollup,
    "purge_total": purge_total,
    "run_message": run_message,
    "table_purge_retained": table_purge_retained,
    "table_purge_partitions": table_purge_partitions,
    "table_purge_applied": table_purge_applied,
    "table_purge_layouts": table_purge_layouts,
    "table_purge_files": table_purge_files,
    "prune_dirs": prune_dirs,
    "tree_inventory": tree_inventory,
    "tree_source": tree_source,
    "tree_status": tree_status,
    "tree_clean": tree_clean,
    "tree_scan": tree_scan,
    "tree_scan_parts": tree_scan_parts,
    "tree_scan_touching": tree_scan_touching,
    "rescan_changed": rescan_changed,
    "format_size": format_sizes,
    "dir_stats": dir_stats,
    "dir_stats_orders": dir_stats_orders,
    "retention_curve": retention_curve,
    "status_report": status_report,
    "status_summary": status_summary,
    "secret_match_flags": secret_match_flags,
    "secret_findings": secret_findings,
    "secret_summary": secret_summary,
    "secret_custom_detector": secret_custom_detector,
    "secret_scanner_union": secret_scanner_union,
    "secret_entropy": secret_entropy,
    "secret_sketches": secret_sketches,
    "scan_recommendation": scan_recommendation,
    "scan_items": scan_items,
    "session_end_trigger": session_end_trigger,
    "session_end_run": session_end_run,
    "session_end_batches": session_end_batches,
    "session_end_events": session_end_events,
    "session_end_clean": session_end_clean,
}
