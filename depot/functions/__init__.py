"""Column -> Column building blocks."""

from depot.functions import fixed
from depot.functions.envs import (
    classify_spec,
    cuda_suffix,
    env_key,
    index_args,
    index_url,
    is_nightly,
    is_pinned,
    json_fingerprint,
    parse_env,
    resolve_alias,
    snapshot_id,
    snapshot_label,
)
from depot.functions.urls import (
    content_fingerprint,
    host,
    is_presigned,
    normalize_url,
    resolve_dots,
    short_key,
    url_key,
)
from depot.functions.versions import (
    VERSION_TYPE,
    drop_last_part,
    file_version,
    major,
    major_minor,
    parse_version,
    version_literal,
)

__all__ = [n for n in dir() if not n.startswith("_")]
