"""claimforge: claim-corpus construction and run analytics as Spark DataFrame operators.

Sub-packages
------------
functions   column-level helpers (seeded draws, template filling, text utilities)
sources     table readers, stand-in task views, result/speed file scans and sinks
operators   sampling, statement builders, corpus assembly, evaluation sets,
            scoring/metrics, run aggregation, reshaping/statistics, ablation sweeps
plans       the query registry used by ``__spark_entry__`` and its DuckDB oracle SQL
"""

from claimforge.session import get_session, ensure_checkpoint_dir, scratch_path

__all__ = ["get_session", "ensure_checkpoint_dir", "scratch_path"]
