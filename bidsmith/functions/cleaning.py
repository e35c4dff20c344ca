"""Column builders for names, money, dates, identifiers and missing values; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidsmith.config import ADDRESS_MARKS, ERROR_MARKS, SUMMARY_MARKS


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing(c: str | Column, tokens: tuple[str, ...] = ("", "None")) -> Column:
    """Null where the text is one of the tokens."""
    return F.when(~col(c).isin(*tokens), col(c))


def money(c: str | Column) -> Column:
    """Dollar text to double; 0 where it isn't a number."""
    return F.coalesce(money_or_null(c), F.lit(0.0))


def money_or_null(c: str | Column) -> Column:
    """Dollar text to double; null (also for NaN) where it isn't a number."""
    value = F.trim(F.regexp_replace(col(c), "[$,]", "")).try_cast("double")
    return F.when(~F.isnan(value), value)


def truthy(c: str | Column) -> Column:
    return F.coalesce(F.lower(F.trim(col(c))).isin("true", "1", "yes"), F.lit(False))


def yes(c: str | Column) -> Column:
    return F.coalesce(F.upper(F.trim(col(c))) == "YES", F.lit(False))


def whole(c: str | Column) -> Column:
    """Integer part of a number as text; 0 where it isn't one."""
    return F.coalesce(missing(c).try_cast("double").try_cast("int"), F.lit(0))


def any_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether the text holds any phrase, as it stands."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return F.coalesce(out, F.lit(False))


def joined_lower(*columns: str | Column) -> Column:
    return F.concat_ws(" ", *(F.lower(F.coalesce(col(c), F.lit(""))) for c in columns))


def clean_name(c: str | Column) -> Column:
    """Awardee name without an address that follows it; the first rule that fits decides.

    A street number after at least two words; a state and postal code, cut at the first number
    from the third word on; an address mark after ten characters; else as it is.
    """
    name = F.trim(F.coalesce(col(c), F.lit("")))
    street = F.regexp_extract(name, r"^(.+?)\s+\d+\s+[A-Z]", 1)
    words = F.split(name, r"\s+")
    at = F.array_min(F.filter(F.transform(words, lambda w, i: F.when((i >= 2) & w.rlike(r"^\d+$"), i)), lambda i: i.isNotNull()))
    state = F.when(name.rlike(r"^(.+?)\s+[A-Z]{2}\s+USA\s+\d{5}") & at.isNotNull(), F.array_join(F.slice(words, 1, at), " "))
    rules = [F.when((street != "") & (F.size(F.split(F.trim(street), r"\s+")) >= 2), F.trim(street)), state]
    for mark in ADDRESS_MARKS:
        place = F.instr(F.upper(name), mark)
        rules.append(F.when(place > 11, F.trim(F.substring(name, F.lit(1), place - 1))))
    return F.coalesce(*rules, name)


def iso_date(c: str | Column) -> Column:
    """Text whose first ten characters are a date, to a date; null where they aren't."""
    return F.to_date(F.try_to_timestamp(F.substring(F.trim(col(c)), 1, 10), F.lit("yyyy-M-d")))


def signed_days(earlier: str | Column, later: str | Column) -> Column:
    """Days from earlier to later; null where either is missing or no ISO date."""
    tokens = ("None", "nan", "")
    return F.datediff(iso_date(missing(F.trim(col(later)), tokens)), iso_date(missing(F.trim(col(earlier)), tokens)))


def us_date(c: str | Column) -> Column:
    """ISO date text to month/day/year; other text as it is."""
    return F.when(col(c).rlike("^.{4}-"), F.date_format(iso_date(c), "MM/dd/yyyy")).otherwise(col(c))


def iso_text(c: str | Column) -> Column:
    """Month/day/year text to ISO; other text's first ten characters."""
    return F.when(F.contains(col(c), F.lit("/")), F.date_format(F.to_date(F.try_to_timestamp(col(c), F.lit("M/d/yyyy"))), "yyyy-MM-dd")).otherwise(F.substring(col(c), 1, 10))


def mail_date(c: str | Column) -> Column:
    """Mail date header to its wall-clock timestamp; the zone is dropped."""
    bare = F.regexp_replace(F.trim(col(c)), r"^[A-Za-z]{3},\s*", "")
    return F.try_to_timestamp(F.regexp_extract(bare, r"^(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))


def padded(c: str | Column, width: int = 10) -> Column:
    """Zeros in front up to width; longer text stays whole."""
    return F.when(F.length(col(c)) < width, F.lpad(col(c), width, "0")).otherwise(col(c))


def is_cage(c: str | Column) -> Column:
    return F.coalesce(F.upper(F.trim(col(c))).rlike("^[A-Z0-9]{5}$"), F.lit(False))


def is_lei(c: str | Column) -> Column:
    return F.coalesce(F.upper(F.trim(col(c))).rlike("^[A-Z0-9]{20}$"), F.lit(False))


def bare_line(c: str | Column) -> Column:
    """A log line without timestamps and level tags."""
    line = F.regexp_replace(col(c), r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "")
    return F.trim(F.regexp_replace(line, r"\[(?:DEBUG|INFO|WARNING|ERROR|CRITICAL)\]", ""))


def first_filled(*columns: str | Column) -> Column:
    """The first that is neither null nor empty; else the empty text."""
    return F.coalesce(*(F.nullif(col(c), F.lit("")) for c in columns), F.lit(""))


def cache_name(start: str | Column, end: str | Column) -> Column:
    return F.concat(F.lit("awards_"), F.regexp_replace(col(start), "-", ""), F.lit("_"), F.regexp_replace(col(end), "-", ""), F.lit(".json"))


def award_key(name: Column, amount: Column, date: Column) -> Column:
    """The three parts that tell awards apart, as a struct."""
    return F.struct(name.alias("name"), amount.alias("amount"), F.substring(date.cast("string"), 1, 10).alias("date"))


def key_text(key: Column) -> Column:
    """An award key as a JSON array."""
    return F.to_json(F.array(key["name"], key["amount"], key["date"]))


def weekdays_after(start: Column, days: Column | int) -> Column:
    """The n-th Monday-to-Friday strictly after start."""
    n = days if isinstance(days, Column) else F.lit(days)
    ahead = F.filter(F.sequence(F.date_add(start, 1), F.date_add(start, n * 2 + 4)), lambda d: F.weekday(d) < 5)
    return F.get(ahead, n - 1)


def first_or(items: Column, default: Column) -> Column:
    """The first element, or the default where there is none."""
    return F.coalesce(F.get(items, F.lit(0)), default)


def first_listed(hits: Column) -> Column:
    """Of identifier hits (ticker, exchCode), the first with a ticker on an American exchange or none named; null without one."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.get(F.filter(hits, lambda h: ~blank(h["ticker"]) & (blank(h["exchCode"]) | (h["exchCode"] == "US"))), F.lit(0))


def local_time(at: Column, zone: str = "America/New_York", pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A UTC time as text in a zone."""
    return F.date_format(F.from_utc_timestamp(at, zone), pattern)


def kept_line(line: Column, mode: str) -> Column:
    """Whether a mode of the log filter shows the line: errors_only, stats or summary (both show summaries and errors);
    any other mode shows all, to be deduplicated."""
    error, summary = any_phrase(F.upper(line), ERROR_MARKS), any_phrase(line, SUMMARY_MARKS)
    return error if mode == "errors_only" else error | summary if mode in ("stats", "summary") else F.lit(True)


def with_gaps(selected: Column, total: Column) -> Column:
    """Selected lines (struct of i, from 0, and line, in order) as text, with a note of how many are left out between and after them."""
    note = lambda n: F.concat(F.lit("[... "), n.cast("string"), F.lit(" lines omitted ...]\n"))
    gap = lambda x, k: F.when(k > 0, x["i"] - F.get(selected, k - 1)["i"] - 1).otherwise(0)
    parts = F.transform(selected, lambda x, k: F.concat(F.when(gap(x, k) > 0, note(gap(x, k))).otherwise(""), x["line"]))
    left = total - F.element_at(selected, -1)["i"] - 1
    end = F.when(left > 0, F.concat(F.lit("\n"), F.rtrim(F.regexp_replace(note(left), "\n", "")))).otherwise("")
    return F.when(F.size(selected) == 0, F.concat(F.lit("["), total.cast("string"), F.lit(" lines omitted]"))).otherwise(F.concat(F.array_join(parts, "\n"), end))
