from marquee.functions.calendar import (
    PARTS,
    WEEKDAYS,
    as_utc,
    date_text,
    days_in_month,
    day_of,
    field,
    hour_from_utc,
    month_start,
    month_text,
    parse_date,
    parse_month,
    parse_timestamp,
    weekday_name,
    weekday_number,
)
from marquee.functions.ids import (
    are_whole_numbers,
    bit_in_word,
    bitmap_of,
    has_bit,
    places_of,
    word_of,
)
from marquee.functions.numbers import (
    Money,
    days_between,
    percentage,
    two_places,
)
from marquee.functions.text import (
    month_label,
    month_label_from_text,
    one_place,
    with_thousands,
)

__all__ = [
    "PARTS",
    "WEEKDAYS",
    "Money",
    "are_whole_numbers",
    "as_utc",
    "bit_in_word",
    "bitmap_of",
    "date_text",
    "day_of",
    "days_between",
    "days_in_month",
    "field",
    "has_bit",
    "hour_from_utc",
    "month_label",
    "month_label_from_text",
    "month_start",
    "month_text",
    "one_place",
    "parse_date",
    "parse_month",
    "parse_timestamp",
    "percentage",
    "places_of",
    "two_places",
    "weekday_name",
    "weekday_number",
    "with_thousands",
    "word_of",
]
