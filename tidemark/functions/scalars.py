"""Scalar helpers as Column expressions: range tokens, file names, durations, scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.clock import col, plus_seconds

# The text form of a date range, and the name of a stored file.
DATE_TOKEN = "yy-MM-dd.HH-mm"
FILE_NAME = r"^(?:(\w+)\.)?(\w+)\.([\d\-.T]+)\.(parquet|feather|zip)$"


def _token_part(token: str | Column, part: int) -> Column:
    """Two-digit years from 69 on are of the last century; the parser puts all of them in this one."""
    read = F.to_timestamp_ntz(F.split_part(col(token), F.lit("T"), F.lit(part)), F.lit(DATE_TOKEN))
    return F.when(F.year(read) >= 2069, read - F.expr("INTERVAL '100' YEAR")).otherwise(read)


def range_start(token: str | Column) -> Column:
    return _token_part(token, 1)


def range_end(token: str | Column) -> Column:
    return _token_part(token, 2)


def range_token(start: str | Column, end: str | Column) -> Column:
    return F.concat(F.date_format(col(start), DATE_TOKEN), F.lit("T"), F.date_format(col(end), DATE_TOKEN))


def morning(date: str | Column) -> Column:
    return F.date_trunc("day", col(date)).cast("timestamp_ntz")


def expand_range(start: Column, end: Column, seconds: int | Column, mode: str = "both") -> tuple[Column, Column]:
    """Move the start back, the end on, or both."""
    s = F.lit(seconds) if isinstance(seconds, int) else seconds
    return (
        plus_seconds(start, -s) if mode in ("start", "both") else start,
        plus_seconds(end, s) if mode in ("end", "both") else end,
    )


def with_file_info(df: DataFrame, name: str, default_symbol: str) -> DataFrame:
    """Symbol, dataset and date range of stored files from their names; names of another form give NULL."""

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(name, FILE_NAME, i), F.lit(""))

    dataset = part(2)
    return df.withColumns(
        {
            "file_symbol": F.when(dataset.isNotNull(), F.coalesce(part(1), F.lit(default_symbol))),
            "file_dataset": dataset,
            "file_range": part(3),
        }
    )


def duration_text(seconds: str | Column) -> Column:
    """`2 days 03:04:05`, without the days when there are none."""
    s = col(seconds).cast("long")
    sign = F.when(s < 0, "-").otherwise("")
    a = F.abs(s)
    days = F.floor(a / 86_400)
    clock = F.format_string(
        "%02d:%02d:%02d", F.floor(a % 86_400 / 3600).cast("int"), F.floor(a % 3600 / 60).cast("int"), (a % 60).cast("int")
    )
    text = F.when(days == 1, "1 day ").when(days > 1, F.concat(days.cast("string"), F.lit(" days "))).otherwise("")
    return F.concat(sign, text, clock)


def scale_text(largest: str | Column, target: float) -> Column:
    """How far a series of largest size `largest` is from `target`, as `x20K` or `/3M`: one leading digit."""
    raw = F.try_divide(F.lit(target), col(largest))
    up = raw > 1
    size = F.when(up, raw).otherwise(1 / raw)
    zeros = F.floor(F.log10(size)).cast("int")
    lead = F.floor(size / F.pow(F.lit(10.0), zeros)).cast("int")
    unit = F.floor(zeros / 3).cast("int")
    names = F.array(F.lit(""), F.lit("K"), F.lit("M"), F.lit("B"))
    return F.concat(
        F.when(up, "x").otherwise("/"), lead.cast("string"), F.repeat(F.lit("0"), zeros - unit * 3),
        F.try_element_at(names, unit + 1),
    )


def normalized_timeframe(c: str | Column) -> Column:
    """Whole-word `1H` to `1h`, for any number of hours."""
    return F.regexp_replace(col(c), r"\b(\d+)H\b", "$1h")


def drawn(*parts: str | Column, part: int = 0) -> Column:
    """A seeded number of 32 bits: eight hex digits of the MD5 of the parts, joined by `|`. `part` 0 to 3 picks the digits."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts]))
    return F.conv(F.substring(digest, 8 * part + 1, 8), 16, 10).cast("long")
