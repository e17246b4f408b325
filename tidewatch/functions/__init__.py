"""Column functions: each takes columns and returns a column."""

from tidewatch.functions.draws import hash_draw, hash_shard
from tidewatch.functions.logs import (
    ip_number,
    log_bytes,
    log_minute,
    null_literal,
    valid_ipv4,
)
from tidewatch.functions.maths import (
    abs_diff,
    floor_div,
    from_micros,
    l2_norm,
    min_max,
    to_micros,
)
from tidewatch.functions.metrics import (
    name_matches,
    percentile_label,
    unit_abbreviation,
    unit_factor,
)
from tidewatch.functions.text import (
    ascii_alnum,
    clean_text,
    int_list,
    leading_int,
    parse_bool,
    sentiment_label,
    split_nonempty,
)

__all__ = [
    "abs_diff", "ascii_alnum", "clean_text", "floor_div", "from_micros",
    "hash_draw", "hash_shard", "int_list", "ip_number", "l2_norm",
    "leading_int", "log_bytes", "log_minute", "min_max", "name_matches",
    "null_literal", "parse_bool", "percentile_label", "sentiment_label",
    "split_nonempty", "to_micros", "unit_abbreviation", "unit_factor",
    "valid_ipv4",
]
