"""Store links, list lines and shared-basket payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from basketwise.fixed import MAX_NAME, MAX_UNIT
from basketwise.functions.numbers import number, plain_number
from basketwise.functions.text import is_key

# Short keys as they appear in a shared link: c catalog id, e product key, n name, u unit, q quantity, x custom.
PAYLOAD_SCHEMA = "array<struct<c string, e string, n string, u string, q string, x boolean>>"


def url_text(text: Column) -> Column:
    """Text escaped for a link, blanks as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def search_url(template: Column, name: Column) -> Column:
    """Search page of a store for a product name."""
    return F.replace(template, F.lit("{query}"), url_text(name))


def quantity_text(quantity: Column, unit: Column) -> Column:
    return F.concat_ws(" ", plain_number(quantity), unit)


def list_line(quantity: Column, unit: Column, name: Column, ean: Column) -> Column:
    """One line of a store list."""
    key = F.when(is_key(ean), F.concat(F.lit(" | EAN "), ean)).otherwise(F.lit(""))
    return F.concat(F.lit("- "), quantity_text(quantity, unit), F.lit(" "), name, key)


def payload_item(
    catalog_id: Column, ean: Column, name: Column, unit: Column, quantity: Column, is_custom: Column
) -> Column:
    """One basket line as it travels in a link: identity and quantity, never a price."""
    return F.struct(
        catalog_id.alias("c"),
        ean.alias("e"),
        F.substring(F.coalesce(name, F.lit("")), 1, MAX_NAME).alias("n"),
        F.substring(F.coalesce(unit, F.lit("pz")), 1, MAX_UNIT).alias("u"),
        F.coalesce(F.when(quantity != 0, quantity), F.lit(1.0)).alias("q"),
        is_custom.alias("x"),
    )


def _swapped(text: Column, old: str, new: str) -> Column:
    """Every character of one list as that of the other; a replacement searches bytes, translate looks up each character."""
    for a, b in zip(old, new):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def encode_payload(items: Column) -> Column:
    """Array of items as unpadded URL-safe base64 of its JSON."""
    coded = F.base64(F.encode(F.to_json(items), "UTF-8"))
    plain = F.regexp_replace(coded, "[\r\n]", "")
    return F.rtrim(_swapped(plain, "+/", "-_"), F.lit("="))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, however often the expression refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def decode_payload(payload: Column) -> Column:
    """Array of items in a link, null when the link does not hold one."""

    def readable_text(coded: Column) -> Column:
        padded = F.rpad(coded, (F.ceil(F.length(coded) / 4) * 4).cast("int"), F.lit("="))
        readable = lambda p: p.rlike("^[A-Za-z0-9+/]*={0,2}$") & (F.length(coded) % 4 != 1)
        return _once(padded, lambda p: F.when(readable(p), F.make_valid_utf8(F.unbase64(p).cast("string"))))

    text = _once(_swapped(payload, "-_", "+/"), readable_text)
    # A lone object would be read as a list of one.
    listed = _once(text, lambda t: F.when(F.ltrim(t).startswith("["), t))
    return F.from_json(listed, PAYLOAD_SCHEMA)


def payload_quantity(written: Column) -> Column:
    return number(written)
