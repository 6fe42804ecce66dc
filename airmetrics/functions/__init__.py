from airmetrics.functions.clean import (  # noqa: F401
    hhmm_to_seconds,
    hour_of_day,
    parse_fl_date,
    parse_iso_date,
    route_label,
    seconds_to_hhmmss,
    to_bool,
    to_number,
)
