"""Pay and experience rules as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentmill.functions import values as V
from talentmill.functions.text import first_of, is_missing, let, lookup, parse_number

# Number and currency tokens, and the pay patterns in order, as (pattern, groups of low, high and currencies).
NUMBER = r"\d[\d\s,._]*(?:\.\d+)?(?:\s*[kKmM])?"
TOKEN = r"(?:c\$|a\$|s\$|hk\$|us\$|£|€|\$|₽|₹|zł|₴|₸|¥|₩|₪|₺|USD|EUR|GBP|CAD|AUD|SGD|HKD|INR|RUB|RUR|PLN|UAH|KZT|JPY|KRW|CNY|RMB|BRL|MXN|ILS|NIS|TRY|AED|CHF|SEK|NOK|DKK|NZD|CZK|RON|HUF|BGN|ZAR)"
#: What every token before a number is: looked at first, as trying all tokens at each place of a text takes most of the time.
BEFORE = r"(?=\D{1,3}\s*\d)"
DASH = r"\s*(?:-|–|—|to)\s*"
TIERS = [
    (rf"{BEFORE}({TOKEN})\s*({NUMBER}){DASH}({TOKEN})?\s*({NUMBER})", 2, 4, (1, 3)),
    (rf"({NUMBER}){DASH}({NUMBER})\s*({TOKEN})", 1, 2, (3,)),
    (rf"(?:from|от)\s*({NUMBER})\s*(?:to|до)\s*({NUMBER})\s*({TOKEN})?", 1, 2, (3,)),
    (rf"{BEFORE}({TOKEN})\s*({NUMBER})", 2, 2, (1,)),
    (rf"({NUMBER})\s*({TOKEN})", 1, 1, (2,)),
]


def currency_code(c: Column) -> Column:
    t = F.upper(F.trim(c))
    return F.when(is_missing(c), None).otherwise(F.coalesce(lookup(V.CURRENCY_ALIASES, t), t))


def token_currency(token: Column) -> Column:
    """Code of a symbol, word or code; null for a blank."""
    t = F.lower(F.trim(token))
    return F.when(is_missing(token), None).otherwise(F.coalesce(lookup(V.CURRENCY_SYMBOLS | V.CURRENCY_WORDS, t), currency_code(token)))


def currency_in(c: Column) -> Column:
    """Currency named in a text: symbols, the longest first, then words."""
    t = F.lower(c)
    yen = F.when(t.rlike(r"\b(cny|rmb|yuan)\b"), "CNY").otherwise("JPY")
    symbols = [(F.contains(t, F.lit(x)), yen if x == "¥" else code) for x, code in sorted(reversed(V.CURRENCY_SYMBOLS.items()), key=lambda x: -len(x[0]))]
    words = [(t.rlike(rf"(?U)(?<!\w){word}(?!\w)"), code) for word, code in V.CURRENCY_WORDS.items()]
    return first_of([*symbols, *words], F.lit(None).cast("string"))


def any_of(patterns: list[str], flags: str = "") -> str:
    """One pattern for several."""
    return flags + "(?:" + "|".join(patterns) + ")"


def period_hint(c: Column) -> Column:
    return first_of([(c.rlike(any_of(words, "(?iU)")), period) for period, words in V.PERIOD_HINTS.items()], F.lit(None).cast("string"))


def _read(raw: Column, tier: tuple) -> Column:
    """Struct of low, high, the currency marks and the text of a tier's match; null without two numbers."""
    pattern, low, high, marks = tier
    part = lambda g: F.regexp_extract(raw, f"(?iu){pattern}", g)
    found = F.struct(parse_number(part(low)).alias("low"), parse_number(part(high)).alias("high"), F.array(*map(part, marks)).alias("marks"), raw.alias("raw"))
    return let(found, lambda s: F.when(s["low"].isNotNull() & s["high"].isNotNull(), s))


def _with_currency(found: Column, *others: Column) -> Column:
    """What ``_read`` found, with the currency of the first mark that has one, else named in the text, else the others."""

    def named(s: Column) -> Column:
        mark = F.get(F.filter(F.transform(s["marks"], token_currency), lambda code: code.isNotNull()), F.lit(0))
        return F.when(s.isNotNull(), F.struct(s["low"].alias("low"), s["high"].alias("high"), F.coalesce(mark, currency_in(s["raw"]), *others).alias("currency"), s["raw"].alias("raw")))

    return let(found, named)


def _in_context(text: Column, pattern: str, pay: int = 50, other: int = 40) -> Column:
    """First match with a pay word at most ``pay`` characters away and no benefit or business word within ``other``."""
    outside, inside = F.split(text, f"(?iu){pattern}", -1), F.regexp_extract_all(text, F.lit(f"(?iu){pattern}"), F.lit(0))
    each = F.arrays_zip(F.slice(outside, 1, F.size(inside)).alias("o"), inside.alias("m"))
    yes, no = any_of([re.escape(w) for w in V.PAY_WORDS]), any_of(V.NOT_PAY)

    def around(start: Column, end: Column, n: int) -> Column:
        begin = F.greatest(start - n, F.lit(0))
        return F.lower(F.substring(text, begin + 1, end + n - begin))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["o"])
        end = start + F.length(x["m"])
        fits = around(start, end, pay).rlike(yes) & ~around(start, end, other).rlike(no)
        return F.struct(end.alias("at"), F.when(acc["best"].isNotNull(), acc["best"]).when(fits, x["m"]).alias("best"))

    return F.aggregate(each, F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("best")), step, lambda acc: acc["best"])


def salary_from_text(c: Column) -> Column:
    """Struct of low, high, currency and raw text: the first tier with a match."""
    def tier(text: Column, t: tuple) -> Column:
        return let(F.nullif(F.regexp_extract(text, f"(?iu){t[0]}", 0), F.lit("")), lambda raw: _read(raw, t))

    return F.when(c.rlike("[0-9]"), let(c, lambda text: _with_currency(F.coalesce(*(tier(text, t) for t in TIERS)), currency_in(text))))


def salary_from_text_safe(c: Column) -> Column:
    """The same, only where a pay word stands within 50 characters and no benefit or business word within 40; of a tier,
    the first match with such surroundings."""
    def tier(text: Column, t: tuple) -> Column:
        return let(_in_context(text, t[0]), lambda raw: _read(raw, t))

    def found(text: Column) -> Column:
        ranges = F.when(text.rlike(f"(?iu){NUMBER}{DASH}"), F.coalesce(tier(text, TIERS[0]), tier(text, TIERS[1])))  # either has a number and a dash
        return _with_currency(F.coalesce(ranges, tier(text, TIERS[3]), tier(text, TIERS[4])))

    return F.when(c.rlike("[0-9]"), let(c, found))


def bounds(currency: Column) -> tuple[Column, Column]:
    cur = F.coalesce(currency_code(currency), F.lit("USD"))
    low, high = ({k: float(v[i]) for k, v in V.MONTHLY_BOUNDS.items()} for i in (0, 1))
    return F.coalesce(lookup(low, cur), F.lit(float(V.DEFAULT_BOUNDS[0]))), F.coalesce(lookup(high, cur), F.lit(float(V.DEFAULT_BOUNDS[1])))


def best_period(amount: Column, currency: Column, hint: Column) -> Column:
    """Period whose monthly value lies nearest the currency's bounds; the hinted one gets a bonus and goes first on ties."""
    low, high = bounds(currency)

    def scored(i: int, period: str, months: float) -> Column:
        v = amount * months
        miss = F.when(v < low, (low - v) / low).when(v > high, (v - high) / high).otherwise(0.0)
        hinted = F.coalesce(hint == period, F.lit(False))
        return F.struct((miss - F.when(hinted, 0.05).otherwise(0.0)).alias("score"), F.when(hinted, -1).otherwise(i).alias("place"), F.lit(period).alias("period"))

    return F.array_min(F.array(*(scored(i, p, m) for i, (p, m) in enumerate(V.PERIODS.items()))))["period"]


def period_name(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("annually", "annual", "yearly"), "year").when(t == "monthly", "month").when(t == "hourly", "hour").when(t == "daily", "day").when(t.isin(*V.PERIODS), t)


def to_monthly(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """Struct of both bounds per month, rounded half to even."""
    chosen = best_period(F.greatest(low.cast("double"), high.cast("double")), currency, period_name(period))
    months = lookup(V.PERIODS, chosen)
    return F.struct(F.bround(low * months).alias("low"), F.bround(high * months).alias("high"))


def sanitize_bounds(low: Column, high: Column, currency: Column) -> Column:
    """Plausible monthly bounds or nulls: order, absurd values, ratio, least pay, one side for both."""
    least, most = bounds(currency)
    a, b = F.when(low > 0, F.bround(low)), F.when(high > 0, F.bround(high))
    a, b = F.when(a > b, b).otherwise(a), F.when(a > b, a).otherwise(b)
    absurd = F.greatest(a, b) > F.greatest(most * 20, F.lit(1_000_000.0))
    spread = F.coalesce(a.isNotNull() & (b / F.greatest(a, F.lit(1.0)) > 20), F.lit(False))
    bad = F.coalesce(absurd, F.lit(False)) | spread
    a, b = F.when(~bad & (a >= least), a), F.when(~bad & (b >= least), b)
    return F.struct(F.coalesce(a, b).alias("low"), F.coalesce(b, a).alias("high"))


def sanitize_range(low: Column, high: Column, currency: Column) -> Column:
    """Second check: far above the bounds is dropped, slightly reversed bounds are swapped, others dropped."""
    _, most = bounds(currency)
    a = F.when(low.between(0, 10_000_000_000) & (low <= most * 5), F.bround(low))
    b = F.when(high.between(0, 10_000_000_000) & (high <= most * 5), F.bround(high))
    reversed_, near = F.coalesce(a > b, F.lit(False)), a <= b * 3
    return F.struct(F.when(reversed_, F.when(near, b)).otherwise(a).alias("low"), F.when(reversed_, F.when(near, a)).otherwise(b).alias("high"))


def default_currency(country: Column) -> Column:
    return F.coalesce(lookup(V.COUNTRY_CURRENCY, F.upper(F.trim(country))), F.lit("USD"))


def to_rub_fallback(amount: Column, currency: Column) -> Column:
    return F.bround(amount * lookup(V.FALLBACK_RUB, currency_code(currency)))


def years_safe(c: Column, most: int = 15) -> Column:
    """Struct of years (low, high): the first pattern with a match whose surroundings speak of a requirement."""
    def one(t: Column, pattern: str, groups: int) -> Column:
        def judged(raw: Column) -> Column:
            at = F.position(raw, t)
            begin = F.greatest(F.lit(1), at - 150)
            fits = let(F.substring(t, begin, at - begin + F.length(raw) + 150), lambda w: ~w.rlike(any_of(V.EXPERIENCE_NOT)) & w.rlike(any_of(V.EXPERIENCE_YES)))
            found = F.struct(F.regexp_extract(t, rf"(?s){pattern}", 1).try_cast("int").alias("low"), F.regexp_extract(t, rf"(?s){pattern}", groups).try_cast("int").alias("high"))
            return F.when(raw != "", let(found, lambda f: F.when(f["low"].between(1, most) & f["high"].between(1, most) & fits, f)))  # no groups or numbers of no match

        return let(F.regexp_extract(t, rf"(?s){pattern}", 0), judged)

    return F.when(c.rlike("[0-9]"), let(F.lower(c), lambda t: F.coalesce(*(one(t, p, 2 if i == 0 else 1) for i, p in enumerate(V.EXPERIENCE)))))


def years_of_row(requirements: Column, nice: Column, description: Column) -> Column:
    """From requirements, then nice-to-have, then a description that has a section of requirements."""
    return F.coalesce(years_safe(requirements), years_safe(nice), F.when(F.lower(description).rlike(any_of(V.EXPERIENCE_SECTIONS)), years_safe(description)))


def years_loose(c: Column, most: int = 25) -> Column:
    """Any number of years, in English or Russian, without regard to context."""
    t = F.replace(F.lower(c), F.lit(","), F.lit("."))
    unit = r"\s*(?:years?|yrs?|лет|года|год)"
    patterns = [(rf"(\d+(?:\.\d+)?)\s*[-–—]\s*(\d+(?:\.\d+)?){unit}", 2), (rf"(?:from|от)\s*(\d+(?:\.\d+)?){unit}", 1), (rf"(\d+(?:\.\d+)?)\+{unit}", 1), (rf"(\d+(?:\.\d+)?){unit}", 1)]

    def one(pattern: str, high: int) -> Column:
        a, b = (F.regexp_extract(t, pattern, g).try_cast("double") for g in (1, high))
        return F.when(a.between(0, most) & b.between(0, most), F.struct(a.alias("low"), b.alias("high")))

    return F.coalesce(*(one(p, g) for p, g in patterns))


# Plain ways to write years, in order, as (pattern, group of the upper bound).
PLAIN_YEARS = [
    (r"(\d+)\s*[-–—]\s*(\d+)\s*лет", 2), (r"(\d+)\s*[-–—]\s*(\d+)\s*years", 2), (r"от\s*(\d+)\s*лет", 1), (r"from\s*(\d+)\s*years", 1),
    (r"до\s*(\d+)\s*лет", 1), (r"up to\s*(\d+)\s*years", 1), (r"(\d+)\+\s*лет", 1), (r"(\d+)\+\s*years", 1), (r"(\d+)\s*год", 1), (r"(\d+)\s*year", 1),
]


def years_plain(c: Column) -> Column:
    """Struct of whole years (low, high) by the first plain pattern that a text holds, without bounds or context."""

    def one(t: Column, pattern: str, high: int) -> Column:
        low = F.regexp_extract(t, pattern, 1).try_cast("int")
        return F.when(low.isNotNull(), F.struct(low.alias("low"), F.regexp_extract(t, pattern, high).try_cast("int").alias("high")))

    return F.when(c.rlike("[0-9]"), let(F.lower(c), lambda t: F.coalesce(*(one(t, p, g) for p, g in PLAIN_YEARS))))
