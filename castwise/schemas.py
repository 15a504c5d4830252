"""Table schemas and landed-JSON schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _table(**fields: T.DataType) -> T.StructType:
    stamps = {"created_at": _TS, "updated_at": _TS}
    return T.StructType([T.StructField(n, t) for n, t in {**fields, **stamps}.items()])


_TEXTS = T.ArrayType(_S)
_OPEN = T.MapType(_S, _S)

TABLES = {
    "content": _table(
        id=_L, topic=_S, category=_S, subcategory=_S, title=_S, keywords=_TEXTS, description=_S, script=_S,
        video_format=_S, status=_S, quality_score=_D, video_path=_S, audio_path=_S, thumbnail_path=_S, published_date=_TS,
    ),
    "content_memory": _table(
        id=_L, video_id=_L, topic=_S, hook=_S, hook_type=_S, story_structure=_S, script_style=_S, duration=_D,
        voice_style=_S, thumbnail_style=_S, visual_style=_S, performance_score=_D,
    ),
    "analytics": _table(
        id=_L, video_id=_L, platform=_S, views=_L, ctr=_D, avg_view_duration=_D, watch_time=_D, retention=_D,
        retention_curve=T.ArrayType(_D), completion_rate=_D, likes=_L, comments=_L, shares=_L, saves=_L,
        subscribers_generated=_L,
    ),
    "topics": _table(
        id=_L, topic=_S, category=_S, subcategory=_S, angle=_S, difficulty=_D, virality_score=_D, curiosity_score=_D,
        evergreen_score=_D, educational_score=_D, emotional_score=_D, competition_score=_D, duplicate_score=_D,
        total_score=_D, status=_S,
    ),
    "sources": _table(
        id=_L, content_id=_L, source_name=_S, url=_S, date_used=_TS, information_type=_S, license=_S, confidence=_D,
    ),
    "ai_memory": _table(id=_L, kind=_S, key=_S, outcome=_S, score=_D, samples=_L, detail=_OPEN),
    "hooks": _table(
        id=_L, content_id=_L, text=_S, hook_type=_S, curiosity=_D, emotion=_D, shock=_D, novelty=_D, clarity=_D,
        total_score=_D, selected=_B, performance_score=_D,
    ),
    "thumbnails": _table(
        id=_L, content_id=_L, version=_S, path=_S, design_style=_S, text_style=_S, ctr=_D, selected=_B,
    ),
    "ceo_reports": _table(id=_L, period=_S, summary=_S, findings=_OPEN, actions=_TEXTS),
    "agent_runs": _table(
        id=_L, run_id=_S, agent=_S, status=_S, duration_ms=_L, attempts=_L, input_summary=_S, output_summary=_S, error=_S,
    ),
}

# Columns that partition a stored table. None of them changes once a row is stored: updates rewrite
# whole partitions, and a row that moved to another one would leave its old copy behind.
# Tables that are joined on the video are cut into the same buckets by it, so joins and per-video sums need no shuffle.
BUCKETED = {"content": "id", "content_memory": "video_id", "analytics": "video_id", "hooks": "content_id", "thumbnails": "content_id", "sources": "content_id"}

PARTITIONS = {"content": ("category",), "analytics": ("platform",), "agent_runs": ("agent",)}

REVIEW_RECORD = T.StructType([
    T.StructField("run_id", _S), T.StructField("status", _S), T.StructField("created_at", _S),
    T.StructField("title", _S), T.StructField("category", _S), T.StructField("format", _S),
    T.StructField("quality_passed", _B), T.StructField("scorecard", T.MapType(_S, _D)),
    T.StructField("video", _S), T.StructField("thumbnail", _S), T.StructField("content_id", _L),
    T.StructField("presenter", _S), T.StructField("reviewed_at", _S), T.StructField("note", _S),
    T.StructField("scheduled_date", _S),
])

CHECKPOINT = T.StructType([
    T.StructField("run_id", _S), T.StructField("category", _S), T.StructField("video_format", _S),
    T.StructField("content_id", _L), T.StructField("completed_stages", _TEXTS), T.StructField("extra", _OPEN),
])

# API payloads as they are landed.
POST_LISTING = "data struct<children:array<struct<data:struct<title:string,ups:bigint>>>>"
FILE_LISTING = (
    "query struct<pages:map<string,struct<title:string,imageinfo:array<struct<thumburl:string,url:string,"
    "extmetadata:struct<LicenseShortName:struct<value:string>,Artist:struct<value:string>>>>>>>"
)
IMAGE_LISTING = "results array<struct<url:string,title:string,license:string,creator:string,source:string>>"


def create_tables(spark: SparkSession, database: str | None = None, reset: bool = False, buckets: int | None = None) -> None:
    """Create the tables that do not exist; with ``reset`` drop them all first.

    Tables in ``BUCKETED`` get ``buckets`` buckets sorted by the video. Take as many as keep a bucket at a few hundred megabytes,
    and not fewer than ``spark.sql.shuffle.partitions`` (the default), or Spark prefers a shuffle to a join of fewer tasks.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    prefix = f"{database}." if database else ""
    for name, schema in TABLES.items():
        if reset:
            spark.sql(f"DROP TABLE IF EXISTS {prefix}{name}")
        parts = PARTITIONS.get(name, ())
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by = f" PARTITIONED BY ({', '.join(parts)})" if parts else ""
        key = BUCKETED.get(name)
        cut = f" CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS" if key else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({columns}) USING parquet{by}{cut}")


def append_rows(rows: DataFrame, name: str, database: str | None = None) -> None:
    """Append rows to one of the tables by column name; columns that ``rows`` lacks are NULL.

    Rows are dealt as the buckets are, so every bucket of a partition gets one file and not one per task.
    """
    spark, full = rows.sparkSession, f"{database}.{name}" if database else name
    schema = spark.table(full).schema
    given = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType) for f in schema]
    told = rows.select(*[c.alias(f.name) for c, f in zip(given, schema)])
    if name in BUCKETED:
        cut = next(int(r["data_type"]) for r in spark.sql(f"DESCRIBE EXTENDED {full}").collect() if r["col_name"] == "Num Buckets")
        told = told.repartition(cut, BUCKETED[name])
    told.write.insertInto(full)
