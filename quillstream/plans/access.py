"""Permission, visibility, audit and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, metrics, store
from ..session import load
from .registry import query

_ROLES = [("view", ["docs.read"]), ("click", ["tickets.queue", "docs.read"]), ("error", ["console", "tickets.sensitive"]), ("signup", ["iam", "tickets.queue", "console"])]
_ROLE_ROWS = ", ".join(f"('{role}', '{p}')" for role, held in _ROLES for p in held)
_IAM = f"""users(email, role) as (select distinct 'user' || user_id, event_type from events where ts < timestamp '2024-02-01' or event_type <> 'signup'), roles(role, p) as (values {_ROLE_ROWS})"""


def _iam(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The users of ``events``; the types of their events are their roles, of which one ("purchase") is not defined."""
    held = load(spark, d, "events").where("ts < timestamp '2024-02-01' or event_type <> 'signup'").groupBy("user_id").agg(F.collect_set("event_type").alias("roles"))
    return held.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("email"), "roles"), spark.createDataFrame(_ROLES, "name string, permissions array<string>")


@query(f"with {_IAM} select email, string_agg(p, ',' order by p) as permissions, bool_or(p = 'console') and bool_or(p = 'iam') as iam_admin from (select distinct email, p from users join roles using (role)) group by email")
def acl_permission_union(spark: SparkSession, d: str) -> DataFrame:
    held = access.permissions(*_iam(spark, d))
    return held.select("email", F.array_join("permissions", ",").alias("permissions"), access.is_admin(F.col("permissions"), "iam").alias("iam_admin"))


@query(f"with {_IAM} select email, role as name from users where role in (select role from roles)")
def acl_role_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return access.existing_roles(*_iam(spark, d))


@query(
    """select o_orderkey, raised_by, confidential from (select o_orderkey, c_name as raised_by, o_orderpriority = '1-URGENT' as confidential from orders join customer on c_custkey = o_custkey) where not confidential or lower(raised_by) = 'customer#000000007'"""
)
def tickets_visible(spark: SparkSession, d: str) -> DataFrame:
    people = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("raised_by"))
    tickets = load(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderpriority") == "1-URGENT").alias("confidential")).join(people, "o_custkey")
    return access.visible(tickets, "CUSTOMER#000000007", {access.QUEUE}).select("o_orderkey", "raised_by", "confidential")


@query("select c_name as name, c_mktsegment = 'BUILDING' as built_in from customer order by built_in desc, name")
def acl_roles_listed(spark: SparkSession, d: str) -> DataFrame:
    """O-SRT-5 over customers in the place of roles; those of one segment come first."""
    return access.listed(load(spark, d, "customer").select(F.col("c_name").alias("name"), (F.col("c_mktsegment") == "BUILDING").alias("built_in")))


@query("select o_orderkey, status, priority from (select o_orderkey, case o_orderstatus when 'F' then 'resolved' when 'O' then 'open' end as status, case when o_orderpriority = '1-URGENT' then 'critical' else 'normal' end as priority from orders) where status is distinct from 'resolved' and priority = 'critical'")
def tickets_shown(spark: SparkSession, d: str) -> DataFrame:
    """O-FLT-11."""
    status = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "open")
    tickets = load(spark, d, "orders").select("o_orderkey", status.alias("status"), F.when(F.col("o_orderpriority") == "1-URGENT", "critical").otherwise("normal").alias("priority"))
    return access.shown(tickets, "open", sensitive=True)


@query("select conv_id, turn, 'user' as subject, 0 as n_fields, case when length(text) > 300 then left(text, 300) || '…' else text end as question from conversations where role = 'user'")
def audit_access_events(spark: SparkSession, d: str) -> DataFrame:
    """O-SNK-9."""
    none = F.lit(None).cast("string")
    event = store.access_event(F.col("role"), none, F.lit("allowed"), none, F.lit(None).cast("array<string>"), F.col("text"), none).alias("e")
    return load(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", event).select("conv_id", "turn", "e.subject", F.size("e.fields").alias("n_fields"), "e.question")


@query("select user_id, event_id, recent from (select user_id, event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 3599999999 preceding and current row) as recent from events where event_type = 'error') where recent >= 3")
def audit_denial_alerts(spark: SparkSession, d: str) -> DataFrame:
    """O-STM-4 on stored denials: an alert per event, on the outcome that counts."""
    return metrics.alerts(load(spark, d, "events").where("event_type = 'error'"), "user_id", "ts").select("user_id", "event_id", "recent")


@query("select event_id, user_id from events where event_type = 'purchase' order by ts desc, event_id desc limit 200")
def audit_recent_by_action(spark: SparkSession, d: str) -> DataFrame:
    return access.recent(load(spark, d, "events"), "ts", "event_id", None, event_type="purchase").select("event_id", "user_id")


@query(
    """select event_id, user_id, event_type, count(*) over (partition by user_id, event_type order by epoch_us(ts) range between 3599999999 preceding and current row) as recent from events"""
)
def audit_trailing_hour(spark: SparkSession, d: str) -> DataFrame:
    return metrics.trailing_count(load(spark, d, "events"), ["user_id", "event_type"], "ts").select("event_id", "user_id", "event_type", "recent")


@query("select c_custkey, c_name from customer where lower(c_name) in ('customer#000000003', 'customer#000000011') or lower(c_mktsegment) in ('customer#000000003', 'customer#000000011') order by c_name limit 20")
def admin_named_lookup(spark: SparkSession, d: str) -> DataFrame:
    return access.named(load(spark, d, "customer"), ["c_name", "c_mktsegment"], ["Customer#000000003", "CUSTOMER#000000011"]).select("c_custkey", "c_name")


@query(
    """with c as (select distinct user_id from events where event_type = 'click'), p as (select distinct user_id from events where event_type = 'purchase')
 select 'union' as op, count(*) as n, coalesce(sum(user_id), 0)::bigint as total from (select * from c union select * from p) union all select 'except', count(*), coalesce(sum(user_id), 0)::bigint from (select * from c except select * from p) union all select 'intersect', count(*), coalesce(sum(user_id), 0)::bigint from (select * from c intersect select * from p)"""
)
def set_tag_union_except_intersect(spark: SparkSession, d: str) -> DataFrame:
    """O-SET-1 to O-SET-4, with one aggregate per user."""
    flags = load(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "click").alias("c"), F.bool_or(F.col("event_type") == "purchase").alias("p"))
    in_set = {"union": F.col("c") | F.col("p"), "except": F.col("c") & ~F.col("p"), "intersect": F.col("c") & F.col("p")}
    ops = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in in_set.items()]))
    found = flags.select("user_id", F.explode(ops).alias("op")).groupBy("op").agg(F.count("*").alias("n"), F.sum("user_id").alias("total"))
    names = load(spark, d, "region").limit(1).select(F.explode(F.array(*[F.lit(n) for n in in_set])).alias("op"))
    return names.join(found, "op", "left").select("op", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"))
