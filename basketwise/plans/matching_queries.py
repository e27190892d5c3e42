"""Queries over text: normalising, parsing and matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketwise.fixed import BRANDS, FILLER_BASE, FILLER_FACTORS, SUGGESTIONS_KEPT, UNITS, VARIANT_STEMS
from basketwise.functions.text import branch_id, first_contained, is_key, normalise, numbers_in, slug
from basketwise.model import Store
from basketwise.operators.id_match import ids_to_review, match_offers, match_telemetry
from basketwise.operators.matching import match_aliases, match_terms, top_unmatched, unmatched_frequency
from basketwise.operators.plausibility import with_plausibility
from basketwise.operators.consolidation import median_prices
from basketwise.operators.optimise import optimise, savings
from basketwise.plans.baskets import list_lines, parse_lines, parse_lists, read_lines
from basketwise.plans.bindings import MEDIANS, OBS, branches, observations, products, table
from basketwise.plans.catalogue import query
from basketwise.sources.dimensions import search_catalog, searchable


@query(
    "normalised_text",
    r"""SELECT doc_id,
      md5(trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g'))) AS normal_md5,
      CAST(length(trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g'))) AS BIGINT) AS n_chars
    FROM documents""",
)
def normalised_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", normalise(F.col("text")).alias("normal"))
    return docs.select(
        "doc_id", F.md5("normal").alias("normal_md5"), F.length("normal").cast("bigint").alias("n_chars")
    )


SLUG_SQL = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', '-', 'g'), '-')"


@query(
    "slug_and_branch_id",
    f"""SELECT s_suppkey, {SLUG_SQL.format("s_name")} AS slug,
      lower(r_name) || '-' || {SLUG_SQL.format("n_name || ' ' || s_name")} AS branch_id
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def slugs(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat_ws(" ", "n_name", "s_name")
    return branches(spark, folder).select(
        "s_suppkey", slug(F.col("s_name")).alias("slug"), branch_id(F.col("store_id"), name).alias("branch_id")
    )


@query(
    "text_slugs",
    f"SELECT page_id, {SLUG_SQL.format('html')} AS slug FROM pages",
)
def text_slugs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", slug(F.col("html")).alias("slug"))


# The units of a list line, longest spelling first.
UNIT_PATTERN = "|".join(sorted(UNITS, key=len, reverse=True))
UNIT_VALUES = ", ".join(f"('{u}', '{d}', {f})" for u, (d, f) in UNITS.items())

READ_LINES = rf"""
units(unit, dimension, factor) AS (VALUES {UNIT_VALUES}),
texts AS (SELECT *, trim(lower(strip_accents(written)), chr(32) || chr(9) || chr(13)) AS t FROM written_lines),
amounts AS (SELECT *, regexp_extract(t, '^([0-9]+(?:[.,][0-9]+)?)', 1) AS a,
  regexp_replace(t, '^[0-9]+(?:[.,][0-9]+)?[ ]*', '') AS rest FROM texts),
split_units AS (SELECT *, CASE WHEN a <> '' THEN regexp_extract(rest, '^({UNIT_PATTERN})(?:[^a-zA-Z]|$)', 1) ELSE '' END AS u
  FROM amounts),
tails AS (SELECT *, CASE WHEN a <> '' THEN trim(regexp_replace(regexp_replace(substr(rest, length(u) + 1), '^[ ]*', ''), '^de[ ]+', ''),
  chr(32) || chr(9) || chr(13)) ELSE '' END AS tail FROM split_units),
read_lines AS (SELECT tails.*, coalesce(nullif(TRY_CAST(replace(a, ',', '.') AS DOUBLE), 0), 1) * coalesce(factor, 1) AS amount,
  dimension, CASE WHEN tail <> '' THEN tail ELSE t END AS term
  FROM tails LEFT JOIN units ON units.unit = tails.u)"""


@query(
    "parse_list",
    rf"""WITH pieces AS (
      SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS by_line, text FROM documents),
    cut AS (SELECT doc_id, CASE WHEN len(by_line) = 1 AND contains(text, ',') THEN string_split(text, ',') ELSE by_line END AS l FROM pieces),
    numbered AS (SELECT doc_id, unnest(l) AS piece, unnest(range(len(l))) AS line FROM cut),
    written_lines AS (SELECT doc_id AS basket_id, CAST(line AS BIGINT) AS line,
      trim(piece, chr(32) || chr(9) || chr(13)) AS written FROM numbered WHERE trim(piece, chr(32) || chr(9) || chr(13)) <> ''),
    {READ_LINES}
    SELECT basket_id, line, amount, dimension, term FROM read_lines""",
)
def parse_list(spark: SparkSession, folder: str) -> DataFrame:
    lists = table(spark, folder, "documents").withColumnRenamed("doc_id", "basket_id")
    return read_lines(list_lines(lists)).select(
        "basket_id", F.col("line").cast("bigint").alias("line"), "amount", "dimension", "term"
    )


def _written_term(name: Column, size: Column) -> Column:
    """Name of a product the way different people write it, by pack size."""
    first = F.substring_index(name, " ", 1)
    last = F.substring_index(name, " ", -1)
    ways = [
        F.concat_ws(" ", name, size),
        F.concat_ws(" ", last, size),
        F.concat_ws(" ", F.lit("fresh"), name, size, F.lit("extra")),
        F.concat_ws(" ", F.lit("my"), name),
        F.concat_ws(" ", last, F.lit("of"), first, size, F.lit("sort")),
        F.concat(F.lit("wanted-"), size, F.lit(" nothing")),
        F.concat_ws(" ", last, F.lit("for the"), last),
    ]
    return F.get(F.array(*ways), (size % len(ways)).cast("int"))


WRITTEN = """CASE p_size % 7 WHEN 0 THEN p_name || ' ' || p_size
  WHEN 1 THEN split_part(p_name, ' ', 2) || ' ' || p_size
  WHEN 2 THEN 'fresh ' || p_name || ' ' || p_size || ' extra'
  WHEN 3 THEN 'my ' || p_name
  WHEN 4 THEN split_part(p_name, ' ', 2) || ' of ' || split_part(p_name, ' ', 1) || ' ' || p_size || ' sort'
  WHEN 5 THEN 'wanted-' || p_size || ' nothing'
  ELSE split_part(p_name, ' ', 2) || ' for the ' || split_part(p_name, ' ', 2) END"""

ALIAS_MATCH = """
catalog AS (SELECT p_partkey AS pos, lower(p_name) AS name, [lower(p_name) || ' ' || p_size, lower(p_brand)] AS aliases FROM part),
texts AS (SELECT min(pos) AS pos, name, aliases, name || ' ' || array_to_string(aliases, ' ') AS blob FROM catalog GROUP BY name, aliases),
terms AS (SELECT DISTINCT term FROM asked WHERE term <> ''),
tried AS (
  SELECT term, pos,
    list_contains(aliases, term) AS s1,
    len(list_filter(aliases, lambda a: contains(term, a) OR contains(a, term))) > 0 AS s2,
    contains(name, term) OR contains(term, name) AS s3,
    len(list_filter(list_filter(regexp_split_to_array(term, '\\s+'), lambda w: length(w) > 2), lambda w: contains(blob, w))) AS score
  FROM terms CROSS JOIN texts),
staged AS (
  SELECT term, min(pos) FILTER (s1) AS p1, min(pos) FILTER (s2) AS p2, min(pos) FILTER (s3) AS p3,
    arg_min(pos, (-score, pos)) FILTER (score > 0) AS p4
  FROM tried GROUP BY term),
alias_match AS (
  SELECT term, CAST(CASE WHEN p1 IS NOT NULL THEN 1 WHEN p2 IS NOT NULL THEN 2 WHEN p3 IS NOT NULL THEN 3 ELSE 4 END AS BIGINT) AS stage,
    coalesce(p1, p2, p3, p4) AS catalog_pos
  FROM staged WHERE coalesce(p1, p2, p3, p4) IS NOT NULL)"""


@query(
    "alias_match",
    rf"WITH asked AS (SELECT {WRITTEN} AS term FROM part), {ALIAS_MATCH} SELECT term, stage, catalog_pos FROM alias_match",
)
def alias_match(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    terms = part.select(_written_term(F.col("p_name"), F.col("p_size")).alias("term"))
    return match_aliases(terms, searchable(products(spark, folder), "position"))


PARSED_SQL = rf"""WITH written_lines AS (
      SELECT l_orderkey AS basket_id, l_linenumber AS line,
        CAST(CAST(l_quantity AS BIGINT) * 100 AS VARCHAR) || CASE l_linenumber % 4 WHEN 0 THEN 'g ' WHEN 1 THEN ' ml de ' WHEN 2 THEN ' latas ' ELSE ' ' END || {WRITTEN} AS written
      FROM lineitem JOIN part ON p_partkey = l_partkey),
    {READ_LINES.replace("texts AS", "line_texts AS").replace("FROM texts", "FROM line_texts")},
    asked AS (SELECT term FROM read_lines), {ALIAS_MATCH},
    found AS (SELECT r.*, CAST(p_size AS DOUBLE) AS pack, ['g', 'ml', 'pz'][p_size % 3 + 1] AS pack_unit, p_partkey,
        ['mass', 'volume', 'count'][p_size % 3 + 1] AS pack_dim, p_partkey IS NULL AS is_custom
      FROM read_lines r LEFT JOIN alias_match m ON m.term = r.term LEFT JOIN part ON p_partkey = m.catalog_pos)
    SELECT basket_id, CAST(line AS BIGINT) AS line, CAST(p_partkey AS VARCHAR) AS ean, is_custom,
      CASE WHEN is_custom THEN CASE dimension WHEN 'mass' THEN 'kg' WHEN 'volume' THEN 'l' ELSE 'pz' END ELSE 'pz' END AS unit,
      CASE WHEN is_custom THEN CASE WHEN dimension IN ('mass', 'volume') THEN amount / 1000 ELSE amount END
           WHEN dimension IS NULL OR dimension = 'pack' THEN amount
           WHEN dimension = pack_dim THEN greatest(1.0, ceil(amount / pack))
           WHEN dimension = 'count' THEN amount ELSE 1.0 END AS quantity,
      CASE WHEN is_custom OR dimension IS NULL OR dimension = 'pack' THEN NULL
           WHEN dimension = pack_dim THEN
             CASE WHEN greatest(1.0, ceil(amount / pack)) = amount AND pack = 1 THEN NULL
             ELSE 'pediste ' || CAST(amount AS BIGINT) || ' ' || pack_unit || ' · cada presentación trae ' || CAST(pack AS BIGINT) || ' ' || pack_unit END
           WHEN dimension = 'count' THEN NULL
           ELSE 'no se pudo convertir ' || CAST(amount AS BIGINT) || CASE dimension WHEN 'mass' THEN ' g' ELSE ' ml' END || ' a presentaciones; se asumió 1' END AS measure_note,
      CASE WHEN is_custom THEN upper(substr(tail, 1, 1)) || substr(tail, 2) END AS custom_name
    FROM found"""


def _written_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines the way people write them."""
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    ways = F.array(*[F.lit(w) for w in ("g ", " ml de ", " latas ", " ")])
    written = F.concat(
        (F.col("l_quantity").cast("bigint") * 100).cast("string"),
        F.get(ways, (F.col("l_linenumber") % 4).cast("int")),
        _written_term(F.col("p_name"), F.col("p_size")),
    )
    return table(spark, folder, "lineitem").join(part, "l_partkey").select(
        F.col("l_orderkey").alias("basket_id"), F.col("l_linenumber").cast("bigint").alias("line"), written.alias("written")
    )


@query("pack_quantity", PARSED_SQL)
def pack_quantities(spark: SparkSession, folder: str) -> DataFrame:
    lines = _written_lines(spark, folder)
    catalog = products(spark, folder)
    parsed = parse_lines(lines, catalog, searchable(catalog, "position"))
    return parsed.select(
        "basket_id",
        "line",
        "ean",
        "is_custom",
        "unit",
        "quantity",
        "measure_note",
        F.when(F.col("is_custom"), F.col("name")).alias("custom_name"),
    )


# Chains under which the regions sell; the last one has no region.
LIST_STORES = {"africa": "aurrera", "america": "chedraui", "asia": "walmart", "europe": "lacomer", "middle east": "heb", "": "soriana"}
_NAMES = ", ".join(f"('{region}', '{store}', {n})" for n, (region, store) in enumerate(LIST_STORES.items()))
_FILLERS = ", ".join(f"('{s}', {int(FILLER_BASE * f * 10 + 0.5) / 10})" for s, f in FILLER_FACTORS.items())


@query(
    "list_savings",
    f"""WITH {OBS}, {MEDIANS}, parsed AS ({PARSED_SQL}), names(region, store_id, pos) AS (VALUES {_NAMES}),
    fillers(store_id, price) AS (VALUES {_FILLERS}),
    items AS MATERIALIZED (
      SELECT basket_id, ean AS item, ean, sum(quantity) AS quantity, min(line) AS first_line FROM parsed WHERE NOT is_custom GROUP BY basket_id, ean
      UNION ALL SELECT basket_id, 'line ' || row_number() OVER (), NULL, quantity, line FROM parsed WHERE is_custom),
    stores AS (SELECT store_id, pos FROM names),
    offers AS MATERIALIZED (
      SELECT basket_id, item, quantity, n.store_id, pos, price FROM items JOIN medians USING (ean) JOIN names n ON n.region = medians.store_id
      UNION ALL SELECT basket_id, item, quantity, store_id, pos, price FROM items JOIN fillers ON ean IS NULL JOIN stores USING (store_id)),
    priced AS MATERIALIZED (SELECT basket_id, item, quantity, min(price) AS best_price FROM offers GROUP BY ALL),
    basket_size AS (SELECT basket_id, count(*) AS n_priced, floor(sum(floor(best_price * 100 + 0.5) * quantity) + 0.5) / 100 AS split_total
      FROM priced GROUP BY basket_id),
    singles AS (SELECT b.basket_id, s.store_id, s.pos, any_value(b.n_priced) AS n_priced, count(o.item) AS coverage,
        floor(coalesce(sum(floor(o.price * 100 + 0.5) * o.quantity), 0) + 0.5) / 100 AS total
      FROM basket_size b CROSS JOIN stores s LEFT JOIN offers o ON o.basket_id = b.basket_id AND o.store_id = s.store_id GROUP BY ALL),
    ranked AS (SELECT *, coverage = n_priced AS is_complete,
        row_number() OVER (PARTITION BY basket_id ORDER BY coverage = n_priced DESC, coverage DESC, total, pos) AS rank FROM singles),
    ends AS (SELECT basket_id, arg_min({{'store_id': store_id, 'total': total}}, rank) AS b,
      arg_max({{'store_id': store_id, 'total': total}}, (is_complete, total, -rank)) AS w FROM ranked GROUP BY basket_id)
    SELECT basket_id, n_priced, split_total, b.store_id AS best_store, b.total AS best_total, w.store_id AS baseline_store,
      floor((w.total - split_total) * 100 + 0.5) / 100 AS savings_vs_worst FROM basket_size JOIN ends USING (basket_id)""",
)
def list_savings(spark: SparkSession, folder: str) -> DataFrame:
    """From written lists to savings, with items outside the catalog at their filler prices."""
    lines = _written_lines(spark, folder)
    ordered = F.array_sort(F.collect_list(F.struct("line", "written")))
    text = F.array_join(F.transform(ordered, lambda x: x["written"]), "\n")
    lists = lines.groupBy("basket_id").agg(text.alias("text"))
    catalog = products(spark, folder)
    baskets = parse_lists(lists, catalog, searchable(catalog, "position"))
    baskets = baskets.withColumn("item_id", F.coalesce("ean", F.concat(F.lit("line "), "line")))
    medians = median_prices(observations(spark, folder))
    named = F.create_map(*[F.lit(x) for pair in LIST_STORES.items() for x in pair])
    prices = medians.withColumn("store_id", F.element_at(named, F.col("store_id")))
    _, costs = optimise(baskets, prices, [Store(s, s.title()) for s in LIST_STORES.values()])
    return savings(costs).join(costs.select("basket_id", "n_priced"), "basket_id").select(
        "basket_id", "n_priced", "split_total", "best_store", "best_total", "baseline_store", "savings_vs_worst"
    )


@query(
    "catalog_search",
    """SELECT CAST(p_partkey AS VARCHAR) AS ean, p_name AS name FROM part
    WHERE p_type = 'PROMO' AND (contains(lower(p_name), 'gizmo') OR contains(lower(p_name || ' ' || p_size || ' ' || p_brand), 'brand#1'))""",
)
def catalog_search(spark: SparkSession, folder: str) -> DataFrame:
    catalog = products(spark, folder)
    by_name = search_catalog(catalog, "PROMO", "GIZMO")
    by_brand = search_catalog(catalog, "PROMO", "brand#1")
    return by_name.unionByName(by_brand).select("ean", "name").distinct()


@query(
    "key_format",
    r"""SELECT o_orderkey, o_custkey * 1000003 AS key_number,
      regexp_matches(CAST(o_custkey * 1000003 AS VARCHAR), '^[0-9]{8,14}$') AS is_key FROM orders""",
)
def key_format(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("o_custkey") * 1000003
    return table(spark, folder, "orders").select(
        "o_orderkey", number.alias("key_number"), is_key(number.cast("string")).alias("is_key")
    )


# Entries of a term mapping in the order that decides; one has nothing required.
TERMS = [
    ("E1", ["red", "widget"], ["promo"]),
    ("E2", [], ["blue"]),
    ("E3", ["ring", "brand#1"], ["small", "old"]),
    ("E4", ["Widget"], ["économy"]),
    ("E5", ["gear 1"], []),
    ("E6", ["hot", "standard"], []),
    ("E7", ["ring"], []),
    ("E8", ["anvil", "large"], ["cold"]),
    ("E9", ["bolt"], ["new", "old", "large", "promo"]),
]


def term_table(spark: SparkSession) -> DataFrame:
    rows = [(n, ean, required, excluded) for n, (ean, required, excluded) in enumerate(TERMS)]
    return spark.createDataFrame(rows, "entry_no int, ean string, requiere array<string>, excluye array<string>")


def _term_case() -> str:
    whens = []
    for ean, required, excluded in TERMS:
        if required:
            parts = [f"contains(text, lower(strip_accents('{t}')))" for t in required]
            parts += [f"NOT contains(text, lower(strip_accents('{t}')))" for t in excluded]
            whens.append(f"WHEN {' AND '.join(parts)} THEN '{ean}'")
    return "CASE " + " ".join(whens) + " END"


SOURCE_ROWS = """
rows AS (
  SELECT l_orderkey, l_shipdate, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price,
    p_name || ' | ' || p_brand || ' | ' || p_type || ' ' || p_size AS clave,
    lower(p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size) AS text
  FROM lineitem JOIN part ON p_partkey = l_partkey
)"""


def _source_rows(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").withColumnRenamed("p_partkey", "l_partkey")
    joined = table(spark, folder, "lineitem").join(part, "l_partkey")
    pack = F.concat_ws(" ", "p_type", "p_size")
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + F.lit(0.5)) / F.lit(100.0)
    return joined.select(
        "l_orderkey",
        "l_shipdate",
        price.alias("price"),
        F.concat_ws(" | ", "p_name", "p_brand", pack).alias("clave"),
        normalise(F.concat_ws(" ", "p_name", "p_brand", pack)).alias("text"),
    )


@query(
    "term_match",
    f"WITH {SOURCE_ROWS} SELECT l_orderkey, clave, price, {_term_case()} AS matched_ean FROM rows",
)
def term_match(spark: SparkSession, folder: str) -> DataFrame:
    matched = match_terms(_source_rows(spark, folder), "text", term_table(spark))
    return matched.select("l_orderkey", "clave", "price", "matched_ean")


# Words of the given prose as a mapping over whole documents.
PROSE = [
    ("P1", ["the", "with", "ing"], ["and"]),
    ("P2", ["de", "la", "é"], ["ou"]),
    ("P3", ["und"], ["zz"]),
    ("P4", ["el", "que"], []),
    ("P5", ["."], []),
]


@query(
    "document_term_match",
    "WITH d AS (SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g')) AS text FROM documents) SELECT doc_id, CASE "
    + " ".join(
        "WHEN "
        + " AND ".join(
            [f"contains(text, strip_accents('{t}'))" for t in required]
            + [f"NOT contains(text, strip_accents('{t}'))" for t in excluded]
        )
        + f" THEN '{ean}'"
        for ean, required, excluded in PROSE
    )
    + " END AS matched_ean FROM d",
)
def document_term_match(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", normalise(F.col("text")).alias("text"))
    rows = [(n, ean, required, excluded) for n, (ean, required, excluded) in enumerate(PROSE)]
    mapping = spark.createDataFrame(rows, "entry_no int, ean string, requiere array<string>, excluye array<string>")
    return match_terms(docs, "text", mapping).select("doc_id", "matched_ean")


@query(
    "unmatched_top",
    f"""WITH {SOURCE_ROWS}, u AS (SELECT * FROM rows WHERE {_term_case()} IS NULL)
    SELECT clave, count(*) AS veces, arg_min(price, (l_shipdate, price)) AS ejemplo_precio
    FROM u GROUP BY clave ORDER BY veces DESC, clave LIMIT {SUGGESTIONS_KEPT}""",
)
def unmatched_top(spark: SparkSession, folder: str) -> DataFrame:
    matched = match_terms(_source_rows(spark, folder), "text", term_table(spark))
    unmatched = matched.where(F.col("matched_ean").isNull())
    frequency = unmatched_frequency(unmatched, F.col("clave"), "price", F.struct("l_shipdate", "price"))
    return top_unmatched(frequency, SUGGESTIONS_KEPT)


N_BRANDS = len(BRANDS)
BRAND_LIST = "[" + ", ".join(f"'{b}'" for b in BRANDS) + "]"


def _expected_name(name: Column, key: Column, size: Column) -> Column:
    """Product name with a real brand and a pack, by key and size."""
    brand = F.get(F.array(*[F.lit(b) for b in BRANDS]), (key % N_BRANDS).cast("int"))
    tail = (
        F.when(size % 5 == 0, F.lit(" 1kg"))
        .when(size % 5 == 1, F.lit(" limón 500 g"))
        .when(size % 5 == 2, F.concat(F.lit(" 2.5 litros "), size))
        .otherwise(F.concat(F.lit(" "), size, F.lit(" piezas")))
    )
    return F.concat(F.initcap(brand), F.lit(" "), name, tail)


def _title(expected: Column, name: Column, key: Column, size: Column, kind: Column) -> Column:
    """Titles a search might return for the product, fitting or not, by line number."""
    other = F.get(F.array(*[F.lit(b) for b in BRANDS]), ((key + 1) % N_BRANDS).cast("int"))
    own = F.get(F.array(*[F.lit(b) for b in BRANDS]), (key % N_BRANDS).cast("int"))
    variant = F.get(F.array(*[F.lit(v) for v in VARIANT_STEMS]), (size % len(VARIANT_STEMS)).cast("int"))
    return (
        F.when(kind == 1, F.upper(expected))
        .when(kind == 2, F.concat_ws(" ", expected, variant))
        .when(kind == 3, F.concat_ws(" ", other, expected, F.lit("6 pack")))
        .when(kind == 4, F.concat_ws(" ", other, name, size))
        .when(kind == 5, F.concat(own, F.lit(" "), name, F.lit(" "), size + 1, F.lit(" pzas")))
        .when(kind == 6, F.concat(F.lit("Súper "), expected, F.lit(" c/u 2 kg")))
        .otherwise(F.lit(""))
    )


OFFERS = rf"""
titles AS (
  SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus, price, p_size, expected, own,
    CASE l_linenumber WHEN 1 THEN upper(expected)
      WHEN 2 THEN expected || ' ' || [{", ".join(f"'{v}'" for v in VARIANT_STEMS)}][p_size % {len(VARIANT_STEMS)} + 1]
      WHEN 3 THEN other || ' ' || expected || ' 6 pack'
      WHEN 4 THEN other || ' ' || p_name || ' ' || p_size
      WHEN 5 THEN own || ' ' || p_name || ' ' || (p_size + 1) || ' pzas'
      WHEN 6 THEN 'Súper ' || expected || ' c/u 2 kg'
      ELSE '' END AS title
  FROM (SELECT *, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price,
      {BRAND_LIST}[CAST(l_partkey % {N_BRANDS} AS INT) + 1] AS own,
      {BRAND_LIST}[CAST((l_partkey + 1) % {N_BRANDS} AS INT) + 1] AS other,
      array_to_string(list_transform(string_split({BRAND_LIST}[CAST(l_partkey % {N_BRANDS} AS INT) + 1], ' '), lambda w: upper(w[1]) || w[2:]), ' ')
        || ' ' || p_name || CASE p_size % 5 WHEN 0 THEN ' 1kg' WHEN 1 THEN ' limón 500 g'
          WHEN 2 THEN ' 2.5 litros ' || p_size ELSE ' ' || p_size || ' piezas' END AS expected
    FROM lineitem JOIN part ON p_partkey = l_partkey)
),
normal AS (SELECT *, trim(regexp_replace(lower(strip_accents(title)), '\s+', ' ', 'g')) AS t,
  trim(regexp_replace(lower(strip_accents(expected)), '\s+', ' ', 'g')) AS e FROM titles),
worded AS (SELECT *, list_filter(list_transform(string_split(e, ' '), lambda w: regexp_replace(w, '[^a-z]', '', 'g')), lambda w: length(w) > 3) AS words,
  list_filter({BRAND_LIST}, lambda b: contains(e, b))[1] AS brand FROM normal),
judged AS (
  SELECT *, (title <> ''
    AND (brand IS NULL OR CASE WHEN contains(brand, 'coca') THEN contains(t, 'coca') ELSE contains(t, brand) END)
    AND len(list_filter([{", ".join(f"'{v}'" for v in VARIANT_STEMS)}], lambda v: NOT contains(e, v) AND contains(t, v))) = 0
    AND (NOT contains(e, 'limon') OR contains(t, 'limon'))
    AND (NOT contains(e, 'super extra') OR contains(t, 'super extra'))
    AND len(words) > 0
    AND len(list_filter(words, lambda w: CASE
        WHEN w IN ('litros', 'litro') THEN regexp_matches(t, '\b(l|litro|litros)\b')
        WHEN w IN ('gramos', 'gramo') THEN regexp_matches(t, '\b(g|gr|gramo|gramos)\b')
        WHEN w IN ('kilos', 'kilo') THEN regexp_matches(t, '\b(kg|kilo|kilos|kilogramos)\b')
        WHEN w IN ('piezas', 'pieza') THEN regexp_matches(t, '\b(pz|pza|pzas|pieza|piezas)\b')
        ELSE contains(t, w) END)) >= ceil(len(words) / 2)
    AND NOT (NOT contains(e, 'pack') AND (regexp_matches(t, '\b\d+\s*pack\b') OR contains(t, '6 pack') OR contains(t, '4 pack')
        OR contains(t, '12 pack') OR contains(t, 'c/u')
        OR (regexp_matches(t, '\b\d+\s*pzas?\b') AND NOT contains(e, 'pzas') AND NOT contains(e, 'piezas'))))
    AND NOT ((contains(e, '1kg') OR contains(e, '1 kg')) AND (contains(t, '2 kg') OR contains(t, '2kg') OR contains(t, '3 kg')
        OR contains(t, '4 kg') OR contains(t, '4kg') OR contains(t, '500 g')))
    AND len(list_filter(list_transform(regexp_extract_all(e, '(\d+(\.\d+)?)', 1), lambda n: CAST(n AS DOUBLE)),
        lambda n: n >= 2 AND NOT list_contains(list_transform(regexp_extract_all(t, '(\d+(\.\d+)?)', 1), lambda m: CAST(m AS DOUBLE)), n))) = 0
    ) AS plausible
  FROM worded)"""


def _offers(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as offers found for their product."""
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    joined = table(spark, folder, "lineitem").join(part, "l_partkey")
    expected = _expected_name(F.col("p_name"), F.col("l_partkey"), F.col("p_size"))
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + F.lit(0.5)) / F.lit(100.0)
    return joined.withColumn("expected", expected).select(
        "l_partkey",
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "l_returnflag",
        "l_linestatus",
        "p_size",
        "expected",
        price.alias("price"),
        _title(F.col("expected"), F.col("p_name"), F.col("l_partkey"), F.col("p_size"), F.col("l_linenumber")).alias("title"),
    )


@query(
    "plausible_titles",
    f"""WITH {OFFERS} SELECT DISTINCT l_partkey, title, brand,
      array_to_string(list_transform(regexp_extract_all(t, '(\\d+(\\.\\d+)?)', 1), lambda n: CAST(CAST(n AS DOUBLE) AS VARCHAR)), ' ') AS numbers,
      plausible FROM judged""",
)
def plausible_titles(spark: SparkSession, folder: str) -> DataFrame:
    titles = _offers(spark, folder).select("l_partkey", "title", "expected", "p_size").distinct()
    judged = with_plausibility(
        titles, F.col("title"), F.col("expected"), F.lit("pz"), F.col("p_size").cast("double")
    )
    numbers = F.transform(numbers_in(normalise(F.col("title"))), lambda n: n.cast("string"))
    return judged.select(
        "l_partkey",
        "title",
        first_contained(normalise(F.col("expected")), BRANDS).alias("brand"),
        F.array_join(numbers, " ").alias("numbers"),
        "plausible",
    )


POSITION = "l_orderkey * 1000000 + l_linenumber * 100000 + l_suppkey"

MATCHES = rf"""{OFFERS},
wanted AS (
  SELECT p_partkey, any_value(expected) AS name,
    CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'W' || p_partkey END AS mapped_id
  FROM part LEFT JOIN titles ON l_partkey = p_partkey GROUP BY p_partkey),
offers AS (SELECT *, {POSITION} AS position, CASE WHEN l_returnflag = 'N' THEN NULL ELSE 'W' || (l_partkey + l_suppkey % 2) END AS item
  FROM judged),
direct AS (
  SELECT l_partkey, title, price, item FROM (SELECT * FROM offers WHERE l_linestatus = 'F'
    QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY position) = 1) WHERE plausible),
by_name AS (SELECT l_partkey, title, price, item FROM offers WHERE plausible
    QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY position) = 1),
matches AS (
  SELECT CAST(p_partkey AS VARCHAR) AS ean, w.name, mapped_id,
    CASE WHEN mapped_id IS NOT NULL AND d.l_partkey IS NOT NULL THEN 'direct_id' WHEN n.l_partkey IS NOT NULL THEN 'name_search' END AS matched_by,
    CASE WHEN mapped_id IS NOT NULL AND d.l_partkey IS NOT NULL THEN d.title ELSE n.title END AS title,
    CASE WHEN mapped_id IS NOT NULL AND d.l_partkey IS NOT NULL THEN d.price ELSE n.price END AS price,
    CASE WHEN mapped_id IS NOT NULL AND d.l_partkey IS NOT NULL THEN d.item ELSE n.item END AS us_item_id
  FROM wanted w LEFT JOIN direct d ON d.l_partkey = p_partkey LEFT JOIN by_name n ON n.l_partkey = p_partkey)"""


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    key = F.col("p_partkey")
    wanted = part.select(
        key.cast("string").alias("ean"),
        _expected_name(F.col("p_name"), key, F.col("p_size")).alias("name"),
        F.lit("pz").alias("unit"),
        F.col("p_size").cast("double").alias("pack_amount"),
        F.when(key % 4 != 0, F.concat(F.lit("W"), key)).alias("mapped_id"),
    )
    offers = _offers(spark, folder)
    item = F.when(
        F.col("l_returnflag") != "N", F.concat(F.lit("W"), F.col("l_partkey") + F.col("l_suppkey") % 2)
    )
    found = offers.select(
        F.col("l_partkey").cast("string").alias("ean"),
        "l_linestatus",
        F.expr(POSITION).alias("position"),
        F.struct("title", "price", item.alias("us_item_id")).alias("offer"),
    )
    # Offers of finished lines answer the id lookup, all of them the name search.
    return match_offers(wanted, found.where(F.col("l_linestatus") == "F"), found)


@query("id_then_name", f"WITH {MATCHES} SELECT ean, matched_by, title, price, us_item_id FROM matches")
def id_then_name(spark: SparkSession, folder: str) -> DataFrame:
    return _matches(spark, folder).select("ean", "matched_by", "offer.title", "offer.price", "offer.us_item_id")


@query(
    "rotated_ids",
    f"""WITH {MATCHES} SELECT ean, mapped_id AS old_id, us_item_id AS new_id FROM matches
    WHERE matched_by = 'name_search' AND us_item_id IS NOT NULL AND us_item_id IS DISTINCT FROM mapped_id""",
)
def rotated_ids(spark: SparkSession, folder: str) -> DataFrame:
    return ids_to_review(_matches(spark, folder)).select("ean", "old_id", "new_id")


@query(
    "match_telemetry",
    f"""WITH {MATCHES} SELECT count(*) AS n_targets, count(matched_by) AS n_priced, count(*) - count(matched_by) AS n_unpriced,
      count(*) FILTER (matched_by IS DISTINCT FROM 'direct_id') AS n_fallbacks,
      count(mapped_id) + count(*) FILTER (matched_by IS DISTINCT FROM 'direct_id') AS n_requests,
      count(*) FILTER (matched_by = 'name_search' AND us_item_id IS NOT NULL AND us_item_id IS DISTINCT FROM mapped_id) AS n_ids_discovered
    FROM matches""",
)
def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    return match_telemetry(_matches(spark, folder))
