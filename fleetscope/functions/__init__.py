"""Scalar column builders (SF1-SF15).  All are native Spark expressions."""

from .columns import (  # noqa: F401
    as_of_literal, base_name, epoch_seconds, glob_to_regex, human_size_bytes,
    id_hex, image_parts, json_field, json_path, link, port_rows, relative_age_seconds, setting_value, stamp_from_name,
    strip_tags, tag_version, upper_first, version_key, version_parts, whole_units_between,
)
