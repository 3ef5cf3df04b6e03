"""Prices, instalments and discounts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Written forms of a price, tried in this order.
COMMA_CENTS = r"(\d{1,3}(?:\.\d{3})+,\d{2}|\d+,\d{2})"
DOTTED_THOUSANDS = r"(\d{1,3}(?:\.\d{3})+)(?!\d)"
PLAIN = r"(\d+(?:\.\d{1,2})?)"
PLAIN_ANY = r"(\d+(?:[.,]\d{1,2})?)"
DOCUMENT = r"(?i)\d{2}\.\d{3}\.\d{3}/\d{4}|\d{3}\.\d{3}\.\d{3}-\d{2}|\b\d{5}-\d{3}\b|\(\d{2}\)\s*\d{4,5}-?\d{4}|\b(?:cnpj|cpf|cep|telefone|whatsapp)\b"
INSTALMENT = r"(?i)(?:(?<=(sem juros).{0,21})|)(\d{1,2})\s*x\s*(?:de\s*)?(?:R\$\s*)?(\d{1,3}(?:\.\d{3})*(?:,\d{2})?|\d+,\d{2})(?=(?:.{0,21}?(sem juros))?)"


def _first(x: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))


def _comma(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def read_price(x: Column) -> Column:
    """A price in Brazilian writing: 4.599,00, 1.234, 89,90 or 12.5; null unless it is above 0."""
    s = F.coalesce(x, F.lit(""))
    value = F.coalesce(_comma(_first(s, COMMA_CENTS)), _comma(_first(s, DOTTED_THOUSANDS)), _first(s, PLAIN).try_cast("double"))
    return F.when(value > 0, value)


def read_number(x: Column) -> Column:
    """As read_price, but 0 counts and a single comma is a decimal sign too."""
    s = F.coalesce(x, F.lit(""))
    return F.coalesce(_comma(_first(s, COMMA_CENTS)), _comma(_first(s, DOTTED_THOUSANDS)), F.replace(_first(s, PLAIN_ANY), F.lit(","), F.lit(".")).try_cast("double"))


def is_document(x: Column) -> Column:
    """A tax number, postcode or telephone, not a price."""
    return F.coalesce(x.rlike(DOCUMENT), F.lit(False))


def price_condition(after: Column) -> Column:
    """How the price must be paid, from the 60 characters after it; a percentage off says nothing."""
    s = F.lower(F.substring(after, 1, 60))
    return (
        F.when(s.rlike(r"\d+\s*%[^.]{0,30}(?:pix|[àa] vista)"), F.lit(None).cast("string"))
        .when(s.rlike(r"\bpix\b"), "pix")
        .when(s.rlike(r"(?:à|a) vista"), "à vista")
        .when(s.rlike(r"\bboleto\b"), "boleto")
        .when(s.rlike(r"transfer[eê]ncia"), "transferência")
    )


def best_instalments(text: Column, price: Column) -> Column:
    """struct(times, amount, no_interest, total): no interest (said within 30 characters) first, then the most
    instalments; totals must lie within 0.9 to 1.8 of the price."""
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(INSTALMENT), F.lit(i)).alias(c) for i, c in enumerate("btaf", 1)])

    def row(p: Column) -> Column:
        times, amount = p["t"].cast("int"), read_number(p["a"])
        free = (F.coalesce(p["b"], F.lit("")) != "") | (F.coalesce(p["f"], F.lit("")) != "")
        return F.struct(free.alias("no_interest"), times.alias("times"), amount.alias("amount"), (times * amount).alias("total"))

    good = F.filter(F.transform(parts, row), lambda r: (r["times"] >= 2) & r["total"].between(price * 0.9, price * 1.8))
    return F.array_max(good)


def with_coupon(price: Column, kind: Column, value: Column) -> Column:
    """The price after a coupon of a percentage or an amount, never below 0, in cents."""
    cut = F.when(kind == "percent", price * (1 - value / 100)).when(kind == "amount", price - value).otherwise(price)
    return F.round(F.greatest(cut, F.lit(0.0)), 2)


def effective_price(price: Column, coupons: Column, cash_percent: Column) -> Column:
    """The best single coupon (they do not add up), then the cash discount on what is left."""
    best = F.coalesce(F.array_min(F.transform(coupons, lambda c: with_coupon(price, c["kind"], c["value"]))), price)
    return F.round(F.when(F.coalesce(cash_percent, F.lit(0.0)) > 0, best * (1 - cash_percent / 100)).otherwise(best), 2)


def tracked_coupon(coupons: Column) -> Column:
    """The coupon that an offer keeps: among coupons of one kind the larger, else the first."""
    none = F.lit(None).cast("struct<kind:string,value:double>")
    take = lambda acc, c: F.when(acc.isNull() | ((acc["kind"] == c["kind"]) & (c["value"] > acc["value"])), F.struct(c["kind"].alias("kind"), c["value"].cast("double").alias("value"))).otherwise(acc)
    return F.aggregate(coupons, none, take)


def short_money(x: Column) -> Column:
    """R$ 2,3 mil / R$ 1,5 mi / R$ 350."""
    one = lambda v: F.translate(F.format_number(v, 1), ",.", ".,")
    return F.when(x >= 1_000_000, F.concat(F.lit("R$ "), one(x / 1_000_000), F.lit(" mi"))).when(x >= 1000, F.concat(F.lit("R$ "), one(x / 1000), F.lit(" mil"))).otherwise(F.concat(F.lit("R$ "), F.translate(F.format_number(x, 0), ",.", ".,")))


def money(x: Column) -> Column:
    """R$ 1.234,50."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(x, 2), ",.", ".,"))
