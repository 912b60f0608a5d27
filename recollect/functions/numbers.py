"""Column functions on numbers and dates inside text, and the grounding check."""

from pyspark.sql import functions as F

from recollect import rules
from recollect.functions.text import col

NUMBER = r"([0-9][0-9.,:]*[0-9]|[0-9])"
MONTH = "|".join(rules.MONTHS)
MONTH_WORD = rf"(?i)\b({MONTH})\b"
DATED_MONTH = rf"(?i)(\b[0-9]{{1,2}}\s+(?:{MONTH})\b|\b(?:{MONTH})\.?\s+[0-9]{{1,4}}\b)"


def number_tokens(c):
    """Numbers with their inner separators."""
    return F.regexp_extract_all(col(c), F.lit(NUMBER), 1)


def num_value(tok):
    """The value of a token once thousands separators are dropped, or NULL."""
    return F.replace(tok, F.lit(","), F.lit("")).try_cast("double")


def num_core(tok):
    """Its digits without leading zeros."""
    core = F.regexp_replace(F.regexp_replace(tok, "[^0-9]", ""), "^0+", "")
    return F.when(core == "", F.lit("0")).otherwise(core)


def luhn(c):
    """Mod-10 check of a digit string."""
    return F.call_function("luhn_check", c)


def month_code(c):
    table = F.create_map(*[F.lit(x) for kv in rules.MONTHS.items() for x in kv])
    return F.try_element_at(table, F.lower(c))


def months_named(c):
    return F.array_distinct(F.transform(
        F.regexp_extract_all(col(c), F.lit(MONTH_WORD), 1), month_code))


def months_dated(c):
    """Codes of months that stand next to a number, in order of appearance."""
    hits = F.regexp_extract_all(col(c), F.lit(DATED_MONTH), 1)
    return F.transform(hits, lambda h: month_code(F.regexp_extract(h, rf"(?i)({MONTH})", 1)))


def ungrounded_numbers(answer, facts):
    """Answer numbers that the facts do not hold; bare single digits are ignored."""
    fact_toks = number_tokens(facts)
    vals = F.filter(F.transform(fact_toks, num_value), lambda v: v.isNotNull())
    cores = F.transform(F.filter(fact_toks, lambda t: num_value(t).isNull()), num_core)

    def missing(tok):
        v = num_value(tok)
        small = (F.floor(v) == v) & (F.abs(v) < 10)
        digits = F.length(F.regexp_replace(tok, "[^0-9]", ""))
        return F.when(v.isNotNull(), ~small & ~F.exists(vals, lambda f: F.abs(f - v) < 1e-6)) \
            .otherwise((digits >= 2) & ~F.array_contains(cores, num_core(tok)))

    return F.filter(number_tokens(answer), missing)


def ungrounded_months(answer, facts):
    named = months_named(facts)
    return F.filter(months_dated(answer), lambda m: ~F.array_contains(named, m))


def grounding_report(answer, facts):
    """struct(numbers, months) lacking support; both empty when grounded."""
    return F.struct(ungrounded_numbers(answer, facts).alias("numbers"),
                    ungrounded_months(answer, facts).alias("months"))


def is_grounded(answer, facts):
    return ((F.size(ungrounded_numbers(answer, facts)) == 0)
            & (F.size(ungrounded_months(answer, facts)) == 0))
