"""Files and text columns to typed rows."""

from depot.sources.documents import (
    cuda_catalog,
    cudnn_catalog,
    markers_of,
    parse_feed,
    parse_manifest,
    parse_markers,
    parse_releases,
    parse_snapshots,
    parse_state,
    read_feed,
    read_manifest,
    read_manifest_lines,
    read_marker_log,
    read_markers,
    read_releases,
    read_snapshots,
)
from depot.sources.events import flatten_events, read_events
from depot.sources.lines import read_lines
from depot.sources.locks import lock_rejects, parse_lines, parse_locks, read_locks, read_texts, split_lines

__all__ = [n for n in dir() if not n.startswith("_")]
