"""Registry, table access and the stand-in views shared by both engines."""

from __future__ import annotations

import textwrap
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castwise.session import apply_confs
from castwise.sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# view -> (base table, columns). A column written as a pair differs between the
# engines: (Spark SQL, DuckDB).
Column = str | tuple[str, str]
VIEWS: dict[str, tuple[str, list[Column]]] = {
    "content_v": ("part", [
        "p_partkey as id", "p_name as topic", "p_type as category", "p_brand as subcategory",
        "case when p_size <= 30 then 'published' when p_size <= 40 then 'in_review' else 'quality_failed' end as status",
        "p_retailprice as quality_score",
        "case when p_size % 5 = 0 then 'long' else 'short' end as video_format",
        "case p_partkey % 3 when 0 then null when 1 then '' else concat('2. \"', p_name, ' for ', p_type, '\"') end as title",
        ("timestamp_seconds(1704067200 + p_partkey * 60) as created_at",
         "make_timestamp((1704067200 + p_partkey * 60) * 1000000) as created_at"),
    ]),
    "analytics_v": ("lineitem", [
        "l_partkey as video_id", "l_returnflag as platform", "cast(l_quantity as bigint) as views",
        "cast(round(l_discount * 1000) as bigint) as retention", "cast(round(l_tax * 100) as bigint) as ctr",
    ]),
    "memory_v": ("part", [
        "p_partkey as video_id",
        "case p_partkey % 4 when 0 then 'curiosity' when 1 then 'emotion' when 2 then 'shock' else '' end as hook_type",
        "case when p_partkey % 10 = 0 then null else p_size * 2 end as duration",
        "case when p_partkey % 7 = 0 then null else p_size * 2 end as performance_score",
    ]),
    "facts_v": ("lineitem", [
        "l_orderkey as dossier_id", "l_linenumber as pos", "l_quantity * 2 as confidence",
        "case l_returnflag when 'A' then 'public-domain' when 'N' then 'none' else 'general-knowledge' end as license",
        "case when l_linestatus = 'O' then '' else 'catalog' end as source_name",
        "case l_linenumber % 5 when 0 then 'fact' when 1 then 'event' when 2 then 'person' when 3 then 'stat' else 'date' end"
        " as information_type",
        "concat('part ', cast(l_partkey as string), ' from ', cast(l_suppkey as string)) as claim",
        "concat('supplier ', cast(l_suppkey as string)) as detail",
    ]),
    "topics_v": ("orders", [
        "o_orderkey as topic_id", "o_orderpriority as category", "o_orderkey % 51 + 40 as virality",
        "o_orderkey % 13 + 70 as curiosity", "o_orderkey % 41 + 40 as evergreen", "o_orderkey % 36 + 60 as educational",
        "o_orderkey % 46 + 45 as emotional", "o_orderkey % 71 + 20 as competition",
        "o_orderkey % 51 + 40 as demand", "o_orderkey % 71 + 20 as coverage",
        "concat('topic ', cast(o_custkey % 97 as string)) as topic",
        "case when o_orderkey % 5 = 0 then '' else concat("
        "split_part('red,blue,hot,small,cold,great,lost,why', ',', cast(o_orderkey % 8 + 1 as int)), ' ', "
        "split_part('ring,widget,bolt,gear,gizmo,plate,empire,machinery', ',', cast(o_custkey % 8 + 1 as int))) end as angle",
        "case o_orderstatus when 'F' then 'used' when 'P' then 'approved' else 'candidate' end as status",
    ]),
    "runs_v": ("events", [
        "event_id as id", "user_id as run_id", "event_type as agent",
        "case when event_type = 'error' then 'error' else 'success' end as status",
        "cast(floor(value * 10) as bigint) as duration_ms", "ts as created_at",
    ]),
}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    base, columns = VIEWS[name]
    return table(spark, folder, base).selectExpr(*[c if isinstance(c, str) else c[0] for c in columns])


def oracle(body: str, *views: str) -> str:
    """The DuckDB text: the views it uses in front, then ``body`` (which may begin with its own WITH)."""
    ctes = []
    for name in views:
        base, columns = VIEWS[name]
        ctes.append(f"{name} as (select {', '.join(c if isinstance(c, str) else c[1] for c in columns)} from {base})")
    body = textwrap.dedent(body).strip()
    lead = "with "
    for word in ("with recursive ", "with "):
        if body.lower().startswith(word):
            lead, own = word, body[len(word):]
            return lead + ",\n".join([*ctes, own])
    return (lead + ",\n".join(ctes) + "\n" if ctes else "") + body


def query(name: str, sql: str | None = None, views: Sequence[str] = ()):
    """Register ``fn(spark, folder) -> DataFrame`` under ``name``."""

    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            apply_confs(spark)
            return fn(spark, folder)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql, *views)
        return fn

    return keep


def half_up(x: str, digits: int) -> str:
    """DuckDB text that rounds a double by its printed digits, as Spark's ``round`` does."""
    return f"cast(round(cast(cast({x} as varchar) as decimal(30, 18)), {digits}) as double)"


def joined(name: str, separator: str = "|"):
    """An array column as one text, so results compare as plain values."""
    return F.array_join(name, separator).alias(name)
