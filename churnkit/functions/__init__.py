from churnkit.functions.columns import (  # noqa: F401
    fixed, safe_div, flag_equals, clip_low, as_int, as_long,
)
