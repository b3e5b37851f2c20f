"""pressroom: Spark-native news-page analytics.

Stored page snapshots -> rule-based article extraction -> URL / title-hash keyed,
order-aware upsert into an article change log -> filtered, searched, newest-first,
paged listings with counts, per-source ingest summaries, schema evolution, table
snapshots and a run ledger.  Everything runs as DataFrame / SQL / Structured
Streaming plans; Python workers run only for HTML extraction and the per-component
upsert fold.
"""

from pressroom.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
