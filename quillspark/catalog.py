"""All queries of the library, by name, with their oracles."""

from __future__ import annotations

from quillspark.functions import policies, textops
from quillspark.operators import episodes, evalstats, models, replays, tasks

FLAGSHIP = "partition_counts"
_MODULES = [tasks, textops, policies, episodes, evalstats, models, replays]
QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
