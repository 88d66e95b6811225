"""Streaming extension: the same windows from a stream and from SQL."""

from quillon.streaming.screens import st_digit_windows

QUERIES = {"st_digit_windows": st_digit_windows}
SQL = {
    "st_digit_windows": """select strftime(date_trunc('day', ts), '%Y-%m-%d') as start, event_type, count(*) as n, count(*) filter (right(value::decimal(18,2)::varchar, 1) in ('0', '5')) as zero_or_five
from events where ts is not null group by 1, 2""",
}
