"""Text rules of the order-entry data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ten syllables of the TPC-C customer last name, by digit.
SYLLABLES = ["BAR", "OUGHT", "ABLE", "PRI", "PRES", "ESE", "ANTI", "CALLY", "ATION", "EING"]

# Marker put into some items' data, and the text limits.
ORIGINAL = "ORIGINAL"
DATA_LIMIT = 500
DATA_SHOWN = 200


def last_name(number: Column) -> Column:
    """Three syllables, one per digit of ``number``, hundreds first."""
    number = number.cast("int")
    words = F.array(*[F.lit(s) for s in SYLLABLES])
    digits = [F.pmod(F.floor(number / scale), F.lit(10)) for scale in (100, 10, 1)]
    return F.concat(*[F.element_at(words, (d + 1).cast("int")) for d in digits])


# The wording of addresses and customer texts in predictable data.
def predictable_address(kind: str, number: Column) -> dict[str, Column]:
    def part(name):
        return F.concat(F.lit(f"{name}-{kind}-"), number.cast("string"))

    return {
        "street1": part("street1"),
        "street2": part("street2"),
        "city": part("city"),
        "state": (number % 100).cast("string"),
        "zip": F.concat(F.lpad((number % 10000).cast("string"), 4, "0"), F.lit("11111")),
    }


def customer_data(c: Column, w: Column, d: Column) -> Column:
    text = F.concat(
        F.lit("Customer "), c.cast("string"), F.lit(" from warehouse "), w.cast("string"),
        F.lit(", district "), d.cast("string"),
    )
    return F.rpad(text, DATA_LIMIT, "*")


def bad_credit_prefix(c: Column, d: Column, w: Column, paying_d: Column, paying_w: Column, amount: Column) -> Column:
    """What one payment puts in front of a bad-credit customer's text."""
    return F.concat(*[x.cast("string") for x in (c, d, w, paying_d, paying_w, amount)])


def district_info(dist: Column, d: Column) -> Column:
    """The text for district 1..10; any other district is an error."""
    return F.when(d.between(1, 10), F.element_at(dist, d.cast("int"))).otherwise(
        F.raise_error(F.concat(F.lit("no district info for district "), d.cast("string")))
    )


def history_text(warehouse_name: Column, district_name: Column) -> Column:
    return F.concat(warehouse_name, F.lit("    "), district_name)


def credit_flag(credit: Column) -> Column:
    return F.when(credit == "GC", F.lit(1)).when(credit == "BC", F.lit(0))


def with_original(text: Column, position: Column) -> Column:
    """Overwrite eight characters, starting after ``position`` characters."""
    return F.overlay(text, F.lit(ORIGINAL), (position + 1).cast("int"))
