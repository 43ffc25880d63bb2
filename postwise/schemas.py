"""Fixed schemas of the tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _TS = T.StringType(), T.DoubleType(), T.TimestampType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# One landed payload: a post as delivered by a feed or a keyword search. ``feed`` is ``account`` or
# ``search`` and ``term`` the account or search word, both null where unknown; ``arrival_date`` may be
# the partition column of the landing folder.
PAYLOAD = _schema(
    uri=_S, username=_S, text=_S, created_at=_S, lang=_S, feed=_S, term=_S, arrival_date=T.DateType()
)

POSTS = _schema(
    text=_S, username=_S, created_at=_S, unique_id=_S, utc_saved_at=_TS, category=_S, source_label=_S
)

CLEANED = _schema(
    username=_S, created_at=_S, unique_id=_S, utc_saved_at=_TS, category=_S, source_label=_S,
    normalized_text=_S, style_features=T.ArrayType(_D),
)

CLASSIFIED = _schema(
    unique_id=_S, username=_S, category=_S, source_label=_S, normalized_text=_S,
    fake_news_prob=_D, is_real=T.BooleanType(), cluster=T.IntegerType(), classified_at=_TS,
)

EMOTION = _schema(
    unique_id=_S, username=_S, category=_S, normalized_text=_S, emotion=_S, emotion_score=_D,
    classified_at=_TS,
)

ENERGY = _schema(
    pipeline_name=_S, node_name=_S, run_id=_S, timestamp=_TS, duration_s=_D, energy_kwh=_D,
    cpu_power_w=_D, gpu_power_w=_D, ram_power_w=_D, co2_kg=_D,
    cpu_energy_kwh=_D, gpu_energy_kwh=_D, ram_energy_kwh=_D,
)

REQUESTS = _schema(
    ts=_TS, handler=_S, status=T.IntegerType(), latency_s=_D, retrieval_source=_S,
    probability=_D, context_chars=_D,
)
