"""Schemas of the tables the jobs exchange."""

from __future__ import annotations

from dataclasses import dataclass

# One observed price. Keys stay text: leading zeros occur.
OBSERVATION = (
    "ean string, store_id string, branch_id string, price double, currency string, "
    "captured_at timestamp_ntz, source string, source_url string, raw string"
)
# Columns that identify an observation: an exact repeat is dropped.
OBSERVATION_KEY = ["ean", "store_id", "branch_id", "captured_at"]

SUGGESTION = "clave string, veces bigint, ejemplo_precio double, motivo string"

PRICE_DOCUMENT = (
    "generatedAt string, source string, sourceLabel string, currency string, region string, "
    "postalCode string, products map<string, map<string, string>>"
)

SURVEY_ROW = (
    "producto string, presentacion string, marca string, categoria string, precio string, "
    "fecha_registro string, estado string, cadena_comercial string, nombre_comercial string, municipio string"
)

PRODUCT = (
    "ean string, slug string, name string, category string, unit string, "
    "pack struct<amount: double, unit: string>, aliases array<string>"
)

RUN = (
    "source string, status string, started_at timestamp_ntz, finished_at timestamp_ntz, "
    "products_seen bigint, prices_written bigint, n_errors bigint"
)

STORE = (
    "id string, name string, short_name string, color string, accent_color string, "
    "logo_text string, search_url_template string, is_active boolean"
)
BRANCH = "id string, store_id string, name string, zone string, postal_code string, lat double, lng double"
CATEGORY = "id string, name string, icon string"


@dataclass(frozen=True)
class Store:
    """A chain, in the order that settles ties."""

    id: str
    name: str
