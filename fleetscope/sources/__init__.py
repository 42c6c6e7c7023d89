"""Scans, sources and sinks (SRC1-SRC11, SNK1-SNK2): built-in Spark readers, and a Python data source for folders of files."""

from .api import read_metric_samples, read_spans, read_traces  # noqa: F401
from .catalog_source import list_files  # noqa: F401
from .containers import parse_container_stats, read_container_snapshots  # noqa: F401
from .files import read_commits, read_config_kv, read_event_landing, read_file_catalog  # noqa: F401
from .jdbc import read_jdbc_checks  # noqa: F401
from .logs import parse_bracketed_logs, parse_service_lines, read_service_logs  # noqa: F401
from .sinks import export_batch, write_report  # noqa: F401
